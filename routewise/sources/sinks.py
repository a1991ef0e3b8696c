"""Sinks: full-refresh tables, exports, inventory, manifest, CSV, models
(S07, S10-S21)."""

from __future__ import annotations

import datetime as _dt
import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .months import recent_by_month
from .tables import path_exists


def write_table(df: DataFrame, path: str, sort_within: list[str] | None = None,
                partition_by: list[str] | None = None) -> str:
    """Full-refresh table.  Rows are clustered inside each file
    (``sortWithinPartitions``: no global sort, no extra shuffle) so min/max
    statistics prune well; optional partition columns (e.g. month)."""
    out = df.sortWithinPartitions(*sort_within) if sort_within else df
    w = out.write.mode("overwrite").option("compression", "snappy")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def write_sorted(df: DataFrame, path: str, order: list) -> str:
    """Presented exports with a total order (S10-S13): a distributed range
    sort; part files are in key order."""
    df.orderBy(*order).write.mode("overwrite").option("compression", "snappy").parquet(path)
    return path


COMMUTER_EXPORT = ["passenger_id", "origin_barangay", "origin_district", "destination_type",
                   "trip_purpose", "trips_per_week", "avg_fare_paid_php", "transfers_required",
                   "wait_time_min", "travel_time_min", "satisfaction_score", "income_bracket",
                   "prefers_aircon", "cluster_id", "cluster_label", "is_ab_test_eligible",
                   "refreshed_at"]
AB_EXPORT = ["experiment_record_id", "experiment_id", "passenger_id", "cluster_label", "group",
             "route_variant", "test_week", "simulated_travel_time_min", "simulated_fare_php",
             "transfers_needed", "satisfaction_score", "would_use_again", "p_value",
             "is_significant", "effect_size", "confidence_interval_low",
             "confidence_interval_high", "refreshed_at"]


def export_commuter_clusters(mart: DataFrame, path: str) -> str:
    """17 columns ordered by cluster, passenger."""
    return write_sorted(mart.select(*COMMUTER_EXPORT), path, ["cluster_id", "passenger_id"])


def export_ab_results(mart: DataFrame, path: str) -> str:
    """18 columns (origin district dropped) by passenger, week."""
    return write_sorted(mart.select(*AB_EXPORT), path, ["passenger_id", "test_week"])


def export_recent(spark: SparkSession, mart_path: str, path: str, key: str, days: int = 30) -> str:
    """Last ``days`` days (inclusive of max - days), newest first, of a mart in
    partitions by month: only the months that they reach into are read."""
    return write_sorted(recent_by_month(spark, mart_path, "trip_date", days), path, [F.desc("trip_date"), key])


def files_of(df: DataFrame, *by) -> DataFrame:
    """(by.., path, bytes, modified, rows) of each file behind a file scan, from the hidden
    ``_metadata`` column; no data column is read."""
    m = F.col("_metadata")
    return (df.select(*by, m["file_path"].alias("path"), m["file_size"].alias("bytes"), m["file_modification_time"].alias("modified"))
            .groupBy(*[c for c in df.select(*by).columns], "path").agg(F.max("bytes").alias("bytes"), F.max("modified").alias("modified"), F.count(F.lit(1)).alias("rows")))


def inventory(spark: SparkSession, outputs: dict[str, str]) -> DataFrame:
    """Per expected output: present, files, bytes, rows, newest change.  One plan over
    all outputs, with no job while it is built; files without rows don't count.  An absent
    path is a status; one that can't be read raises."""
    schema = "name string, path string, present boolean"
    there = {n: p for n, p in outputs.items() if path_exists(spark, p)}
    out = spark.createDataFrame([(n, p, n in there) for n, p in outputs.items()], schema)
    found = [files_of(spark.read.parquet(p), F.lit(n).alias("name")) for n, p in there.items()]
    if not found:
        return out.select("*", F.lit(0).cast("long").alias("files"), *[F.lit(None).cast(t).alias(c) for c, t in (("bytes", "long"), ("rows", "long"), ("modified", "timestamp"))])
    per = reduce(DataFrame.unionByName, found).groupBy("name").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.max("modified").alias("modified"))
    zero = lambda c: F.when(F.col("present"), F.coalesce(c, F.lit(0))).alias(c)
    return out.join(per, "name", "left").select("name", "path", "present", F.coalesce("files", F.lit(0)).alias("files"), zero("bytes"), zero("rows"), "modified")


def write_manifest(spark: SparkSession, path: str, outputs: dict[str, str]) -> dict:
    """Export time + output list, written as one small JSON document."""
    manifest = {"exported_at": _dt.datetime.now(_dt.timezone.utc).isoformat(),
                "files": sorted(outputs)}
    (spark.createDataFrame([(json.dumps(manifest),)], "value string")
          .coalesce(1).write.mode("overwrite").text(path))
    return manifest


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])


def export_csv(df: DataFrame, path: str) -> str:
    """CSV with a header (one folder of part files)."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def register_table(spark: SparkSession, name: str, path: str, comment: str) -> None:
    """Expose a written table in the session catalog with a comment.  An entry of
    that name is replaced only if it is external (dropping it leaves its files); a
    managed table or a view is refused."""
    if spark.catalog.tableExists(name):
        kind = spark.catalog.getTable(name).tableType
        if kind != "EXTERNAL":
            raise ValueError(f"{name} is there already, as {kind}")
        spark.sql(f"DROP TABLE {name}")
    safe = comment.replace("'", "''")
    spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{path}' COMMENT '{safe}'")
