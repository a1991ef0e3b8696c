"""routewise: transit analytics expressed as Spark DataFrame jobs.

Layers:
  sources/    table scans, stand-in entities, landing ingest, sinks
  functions/  Column-returning helpers (flags, encodings, safe ratios, statistics)
  operators/  reusable DataFrame operators (quality rules, ranking, reshaping,
              windows, dedupe, clustering, statistics)
  plans/      the models users run: staging -> intermediate -> marts, analyses,
              dashboard queries, experiment statistics, segmentation, pipeline
  streaming/  incremental (file-stream) ingest equal to the batch ingest
"""

__version__ = "0.1.0"
