"""Marts in partitions by month, and their newest days without a scan of the rest
(S12, S13)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONTH = "month"


def write_by_month(df: DataFrame, path: str, date_col: str, sort_within: list[str]) -> str:
    """A full refresh in folders ``month=YYYY-MM-01``.  Rows are dealt by ranges of (date,
    order), so a month is a few files and a hot month is split."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = df.withColumn(MONTH, F.trunc(date_col, "month")).repartitionByRange(n, date_col, *sort_within).sortWithinPartitions(date_col, *sort_within)
    out.write.mode("overwrite").option("partitionOverwriteMode", "static").option("compression", "snappy").partitionBy(MONTH).parquet(path)
    return path


def read_months(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn(MONTH, F.col(MONTH).cast("date"))


def newest_month(spark: SparkSession, path: str) -> dt.date | None:
    """From the folders' names: no file is opened."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [s.getPath().getName() for s in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p) if s.isDirectory()]
    months = [dt.date.fromisoformat(n.split("=", 1)[1]) for n in names if n.startswith(f"{MONTH}=") and not n.endswith("__")]
    return max(months, default=None)


def recent_by_month(spark: SparkSession, path: str, date_col: str, days: int) -> DataFrame:
    """Rows with date >= max(date) - days.  The newest date is in the newest month, and the
    days before it in the months that they reach back to: partition filters leave only
    those to be read, and the maximum reads one column of one month."""
    df = read_months(spark, path)
    last = newest_month(spark, path)
    if last is None:
        return df.drop(MONTH)
    newest = df.where(F.col(MONTH) == F.lit(last)).agg(F.max(date_col)).scalar()
    first = (last - dt.timedelta(days=days)).replace(day=1)
    return df.where((F.col(MONTH) >= F.lit(first)) & (F.col(date_col) >= F.date_sub(newest, days))).drop(MONTH)
