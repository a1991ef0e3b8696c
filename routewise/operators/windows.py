"""Window operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rolling_mean(df: DataFrame, partition: list[str], order: str, measure: str, n: int,
                 out: str | None = None) -> DataFrame:
    """Row-based mean over the last n rows (partial start allowed, gaps
    not filled).  Partitions are entities of an aggregated series (route-day),
    so a window partition holds one entity's days, not raw trips."""
    w = Window.partitionBy(*partition).orderBy(order).rowsBetween(-(n - 1), 0)
    return df.withColumn(out or measure, F.avg(measure).over(w))


def share_of_total(df: DataFrame, measure: str, out: str, scale: int = 3) -> DataFrame:
    """Value / grand total over an already-grouped (small) frame."""
    return df.withColumn(out, F.round(F.col(measure) / F.sum(measure).over(Window.partitionBy()), scale))


def minmax_scale(df: DataFrame, cols: list[str], suffix: str = "_scaled") -> DataFrame:
    """(x - min) / (max - min) across rows; a constant column divides by 1."""
    w = Window.partitionBy()
    out = df
    for c in cols:
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        rng = hi - lo
        out = out.withColumn(c + suffix, (F.col(c) - lo) / F.when(rng == 0, F.lit(1.0)).otherwise(rng))
    return out


def group_means_with_deviation(df: DataFrame, group: list[str], cols: list[str],
                               dev_suffix: str = "_dev") -> DataFrame:
    """Per-group means and their relative deviation from the overall
    mean, (g - m) / m, with a zero overall mean giving 0.

    One aggregation keeps (sum, count) per group; the overall mean is the
    ratio of their totals over a window on the grouped rows (one row per
    group), so there is no join and no second pass over the input."""
    aggs = []
    for c in cols:
        aggs += [F.sum(c).alias(f"_s_{c}"), F.count(c).alias(f"_n_{c}")]
    g = df.groupBy(*group).agg(*aggs)
    w = Window.partitionBy()
    for c in cols:
        mean = F.col(f"_s_{c}") / F.col(f"_n_{c}")
        overall = F.sum(f"_s_{c}").over(w) / F.sum(f"_n_{c}").over(w)
        g = g.withColumn(c, mean).withColumn(
            c + dev_suffix, F.coalesce((mean - overall) / F.when(overall != 0, overall), F.lit(0.0)))
    return g.drop(*[f"_s_{c}" for c in cols], *[f"_n_{c}" for c in cols])
