"""Incremental arrival of landing files, with a state for each key.

A file-source stream (explicit schema, ``date`` partition discovered from the path)
processes whatever files have arrived (``trigger(availableNow)``).  Rows are cleaned and
validated as in the batch job (C12); then a streaming aggregation keeps for each key its
first row by (date, chunk, order) and the first and last trigger that had valid rows of
it.  A key is emitted by the trigger that is both; in later ones it has two and is not,
so a late file or a file that arrives twice adds no row to a loaded key.  Rows of a
trigger are combined before the shuffle, state is kept by Spark without a call for each
key, and nothing is read of what earlier triggers wrote.

Exactly-once: state and offsets commit together in the checkpoint; each micro-batch
writes its loaded and its rejected rows into its own ``epoch=<id>`` partition, which a
retry overwrites.  The number of state partitions is that of shuffle partitions at the
first start of a checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.validation import split_valid, trip_rules
from ..sources import landing as L

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def landing_stream(spark: SparkSession, root: str, entity: str, schema: T.StructType,
                   max_files: int | None = None) -> DataFrame:
    full = T.StructType(list(schema.fields) + [T.StructField("date", T.DateType())])
    r = spark.readStream.schema(full)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(f"{root.rstrip('/')}/{entity}").withColumnRenamed("date", "_date")


def first_writers(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The streaming first_writer_wins, in update mode: one row a key over the whole stream,
    the first by (date, chunk, order) of the first trigger that has rows of the key."""
    ranked = [*L.LINEAGE, *order]
    rest = [c for c in rows.columns if c not in ranked and c != key]
    # a struct's nulls come first, as min_by has it; a trigger has one timestamp, which a retry keeps
    got = (rows.withColumn("_trigger", F.current_timestamp()).groupBy(key)
           .agg(F.min(F.struct(*ranked, *rest)).alias("_w"), F.min("_trigger").alias("_since"), F.max("_trigger").alias("_until")))
    return got.where("_since = _until").select(key, "_w.*").select(*rows.columns)


def write_epoch(target: str, quarantine: str | None):
    """foreachBatch function: the loaded and the rejected rows of one micro-batch."""

    def run(batch: DataFrame, epoch_id: int) -> None:
        batch.persist()  # two sinks, one evaluation: state moves once
        try:
            for path, part in ((target, batch.where("failed_rules is null").drop("failed_rules")), (quarantine, batch.where("failed_rules is not null"))):
                if path:
                    (part.withColumn("epoch", F.lit(epoch_id)).write.mode("overwrite")
                         .option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(path))
        finally:
            batch.unpersist()

    return run


def start_trip_ingest(spark: SparkSession, landing_root: str, target: str, checkpoint: str,
                      quarantine: str | None = None, max_files: int | None = None) -> StreamingQuery:
    cleaned = L.clean_trips(landing_stream(spark, landing_root, "trips", L.TRIP_SCHEMA, max_files))
    valid, rejected = split_valid(cleaned, trip_rules())
    rows = first_writers(valid, "trip_id", L.TRIP_ORDER).withColumn("failed_rules", F.lit(None).cast("array<string>"))
    if quarantine:
        rows = rows.unionByName(rejected)
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)  # taken over by the query when it starts
    try:
        return (rows.writeStream.foreachBatch(write_epoch(target, quarantine))
                .outputMode("update").option("checkpointLocation", checkpoint)
                .trigger(availableNow=True).start())
    finally:
        spark.conf.set(PROVIDER, before)


def run_trip_ingest(spark: SparkSession, landing_root: str, target: str, checkpoint: str,
                    **kw) -> DataFrame:
    """Process every file that has arrived, then return the loaded table."""
    q = start_trip_ingest(spark, landing_root, target, checkpoint, **kw)
    q.awaitTermination()
    return spark.read.parquet(target).drop("epoch")
