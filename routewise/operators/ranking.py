"""Sorts, top-k, mode, argmax and repeatable sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _keys(cols):
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def top_k(df: DataFrame, k: int, by: str, tie: list[str], ascending: bool = False) -> DataFrame:
    """``ORDER BY by [DESC], tie... LIMIT k`` (TakeOrderedAndProject:
    each task keeps k rows, the driver merges k x tasks rows)."""
    o = F.col(by).asc_nulls_last() if ascending else F.col(by).desc_nulls_last()
    return df.orderBy(o, *_keys(tie)).limit(k)


def top_and_bottom(df: DataFrame, k: int, by: str, tie: list[str]) -> DataFrame:
    """Top k (descending) and bottom k (shown ascending), tagged."""
    top = top_k(df, k, by, tie).withColumn("rank_group", F.lit("top"))
    bottom = top_k(df, k, by, tie, ascending=True).withColumn("rank_group", F.lit("bottom"))
    return top.unionByName(bottom)


def restrict_to_top(df: DataFrame, ranked_keys: DataFrame, key: str) -> DataFrame:
    """Keep rows whose key is among the (bounded, k-row) top keys."""
    return df.join(F.broadcast(ranked_keys.select(key)), key, "left_semi")


def top_k_per_group(df: DataFrame, group: list[str], k: int, order: list[Column],
                    rank_col: str = "rank") -> DataFrame:
    """First k rows per group.  Feed it an aggregated frame (counts per
    value) so each window partition holds distinct values, not raw rows."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def value_counts(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Group sizes by one or more keys (partial aggregation map-side)."""
    return df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))


def mode(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Most frequent non-NULL value per group; ties go to the smallest
    value.  Counts are aggregated first, then one window over distinct values."""
    counts = value_counts(df.filter(F.col(value).isNotNull()), group, value)
    top = top_k_per_group(counts, group, 1, [F.col("n").desc(), F.col(value).asc()])
    return top.select(*group, F.col(value).alias(f"mode_{value}"), F.col("n").alias("mode_count"))


def argmax(df: DataFrame, key: str, score: str) -> DataFrame:
    """The key with the highest score; the first key wins ties."""
    return df.agg(F.max_by(F.col(key), F.struct(F.col(score), -F.col(key))).alias(key))


def seeded_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """Repeatable sample of at most n rows: order by a seeded hash of the
    key, which does not depend on partitioning (``sample`` does)."""
    return (df.withColumn("_h", F.md5(F.concat_ws(":", key, F.lit(seed))))
              .orderBy("_h", key).limit(n).drop("_h"))
