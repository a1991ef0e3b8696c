"""End-to-end pipeline on sf0.001: every stage writes its outputs, and a stage whose
tests fail stops the run."""

import pytest
from pyspark.sql import functions as F

from routewise.plans import pipeline
from routewise.sources import deliveries
from routewise.sources.sinks import read_manifest
from tests.conftest import SF_SMALL


def test_pipeline_end_to_end(spark, tmp_path):
    out = str(tmp_path)
    timings = {}
    paths = pipeline.run(spark, SF_SMALL, out, timings=timings)
    assert set(timings) == {"ingest", "staging_tests", "marts", "quality", "segmentation", "label_marts",
                            "statistics", "exports"}
    inv = {r.name: r for r in spark.read.parquet(f"{out}/exports/inventory").collect()}
    assert all(r.present and r.rows is not None for r in inv.values())
    assert inv["mart_route_summary"].rows > 0
    assert read_manifest(spark, f"{out}/exports/manifest")["files"]
    assert spark.sql("DESCRIBE TABLE EXTENDED mart_route_summary").filter("col_name = 'Comment'").count() == 1
    stats = spark.read.parquet(paths["ab_test_statistics"])
    assert stats.count() == 3
    labelled = spark.read.parquet(f"{out}/raw/survey_v2")
    assert labelled.filter("cluster_id is null").count() == 0
    # what was quarantined on loading is nowhere downstream
    passengers = spark.read.parquet(f"{out}/raw/passengers").count()
    assert labelled.count() == passengers < spark.read.parquet(f"{out}/landing/passengers").count()
    assert spark.read.parquet(f"{out}/quarantine/experiment").where(F.array_contains("failed_rules", "passenger_id_known")).count() > 0
    tests = spark.read.parquet(f"{out}/quality/mart_tests")
    assert tests.select("model").distinct().count() == 4 and tests.where("failures > 0").count() == 0


def test_a_planted_violation_stops_the_run(spark, tmp_path, monkeypatch):
    """Loading takes zero load factors of full vehicles, staging tests don't take days that
    are no weekdays of the payload: the run stops before any mart."""
    trips = deliveries.DELIVERIES["trips"]
    planted = lambda E: trips(E).withColumn("passengers_boarded", F.lit(50))
    monkeypatch.setitem(deliveries.DELIVERIES, "trips", planted)
    from routewise.operators.quality import DataTest
    from routewise.plans import quality_suite as Q
    monkeypatch.setitem(Q.STAGING_TESTS, "stg_trips", [DataTest("accepted_range", "passengers_boarded", lo=1, hi=49)])
    with pytest.raises(AssertionError, match="staging_tests failed"):
        pipeline.run(spark, SF_SMALL, str(tmp_path), segment=False)
    assert not (tmp_path / "marts").exists() and (tmp_path / "quality" / "staging_tests").exists()
