"""Scans of the driver's parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one table.  Column pruning and filter pushdown reach the parquet
    reader because every caller projects/filters declaratively afterwards."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, asked of its file system.  Storage errors raise: a store
    that can't be read is not an absent path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def register_tables(spark: SparkSession, sf_dir: str) -> None:
    """Register every table as a temp view (for SQL users, S22)."""
    for t in TABLES:
        read_table(spark, sf_dir, t).createOrReplaceTempView(t)


def query_parquet(spark: SparkSession, path: str, where: str | None = None) -> DataFrame:
    """Query a parquet file by SQL (``SELECT * FROM parquet.`path```)."""
    sql = f"SELECT * FROM parquet.`{path}`"
    if where:
        sql += f" WHERE {where}"
    return spark.sql(sql)
