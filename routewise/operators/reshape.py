"""Pivots, crosstabs, unpivots and distribution summaries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pivot_mean(df: DataFrame, index: list[str], column: str, values: list, measure: str,
               scale: int | None = None) -> DataFrame:
    """Wide table of means with the listed pivot values (listing them
    avoids the extra distinct-values job)."""
    agg = F.avg(measure)
    if scale is not None:
        agg = F.round(agg, scale)
    out = df.groupBy(*index).pivot(column, values).agg(agg)
    return out


def crosstab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts of row-value x column-value, columns listed."""
    return df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0, [str(v) for v in values])


def five_number(df: DataFrame, group: list[str], measure: str, exact: bool = True,
                accuracy: int = 10000, scale: int = 6) -> DataFrame:
    """Min, q1, median, q3, max per group.

    ``exact`` uses ``percentile`` (linear interpolation; its buffer holds the
    distinct values of a group, fine on mart-grain input).  For raw fact
    input at scale use ``exact=False``: ``percentile_approx`` keeps a bounded
    sketch per group and merges partial sketches map-side."""
    m = F.col(measure)
    if exact:
        q = lambda p: F.round(F.percentile(m, p), scale)  # noqa: E731  (interpolation noise)
    else:
        q = lambda p: F.percentile_approx(m, p, accuracy).cast("double")
    return df.groupBy(*group).agg(
        F.count(m).alias("n"),
        F.min(m).cast("double").alias("min"),
        q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"),
        F.max(m).cast("double").alias("max"),
    )


def histogram(df: DataFrame, group: list[str], value: Column | str, alias: str = "bin") -> DataFrame:
    """Counts per (value or bin, group)."""
    v = F.col(value) if isinstance(value, str) else value
    return df.groupBy(v.alias(alias), *group).agg(F.count(F.lit(1)).alias("n"))


WHISKER = 1.5
BINS, GRID = 128, 64


def quartiles(df: DataFrame, group: list[str], measure: str, exact: bool = False, k: int = 800) -> DataFrame:
    """group, n, min, q1, median, q3, max.  By default from a KLL sketch for each group:
    partial sketches of bounded size are built map-side and merged, so a group of a third
    of all rows is no buffer of its values anywhere (rank error below 0.5 % at k = 800).
    exact interpolates by ``percentile``, for mart-grain input."""
    m = F.col(measure).cast("double")
    q = [0.25, 0.5, 0.75]
    ends = [F.count(m).alias("n"), F.min(m).alias("min"), F.max(m).alias("max")]
    if exact:
        out = df.groupBy(*group).agg(*ends, *[F.percentile(m, p).alias(c) for p, c in zip(q, ("q1", "median", "q3"))])
    else:
        out = df.where(m.isNotNull()).groupBy(*group).agg(*ends, F.kll_sketch_agg_double(m, F.lit(k)).alias("_s"))
        out = out.withColumn("_q", F.kll_sketch_get_quantile_double("_s", F.array(*[F.lit(p) for p in q])))
        out = out.withColumns({c: F.col("_q")[i] for i, c in enumerate(("q1", "median", "q3"))})
    return out.select(*group, "n", "min", "q1", "median", "q3", "max")


def box(df: DataFrame, group: list[str], measure: str, exact: bool = False, scale: int = 6) -> DataFrame:
    """A16, a box with whiskers: quartiles, the outermost values within WHISKER times the
    quartile distance, and the number of outliers beyond.  Two aggregations with map-side
    combining; outliers are counted, never collected."""
    m = F.col(measure).cast("double")
    q = quartiles(df, group, measure, exact)
    reach = WHISKER * (F.col("q3") - F.col("q1"))
    fences = q.withColumns({"_low": F.col("q1") - reach, "_high": F.col("q3") + reach})
    rows = df.select(*group, m.alias("_v")).where("_v is not null").join(fences, group)
    inside = F.col("_v").between(F.col("_low"), F.col("_high"))
    ends = rows.groupBy(*group).agg(F.min(F.when(inside, F.col("_v"))).alias("whisker_low"), F.max(F.when(inside, F.col("_v"))).alias("whisker_high"), F.count_if(~inside).alias("outliers"))
    numbers = ["min", "whisker_low", "q1", "median", "q3", "whisker_high", "max"]
    return q.join(ends, group).select(*group, "n", *[F.round(c, scale).alias(c) for c in numbers], "outliers")


def violin(df: DataFrame, group: list[str], measure: str, bins: int = BINS, grid: int = GRID, scale: int = 6) -> DataFrame:
    """A16, a violin: a Gaussian kernel density (Silverman's bandwidth) of each group at grid
    points from its least to its largest value.  Rows are counted in bins first, so the
    kernel sums run over bins x grid points, whatever the number of rows.  A group of one
    value has no density and no rows."""
    m = F.col(measure).cast("double")
    rows = df.select(*group, m.alias("_v")).where("_v is not null")
    shape = rows.groupBy(*group).agg(F.count("_v").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.stddev_samp("_v").alias("_s")).where("_s > 0")
    step = (F.col("_hi") - F.col("_lo")) / bins
    at = F.least(F.floor((F.col("_v") - F.col("_lo")) / step), F.lit(bins - 1))
    counts = rows.join(shape, group).groupBy(*group, at.alias("_b")).agg(F.count(F.lit(1)).alias("_c"))
    points = shape.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))).withColumns({
        "x": F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("point") / (grid - 1), "_h": F.lit(1.06) * F.col("_s") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))})
    z = (F.col("x") - (F.col("_lo") + (F.col("_b") + 0.5) * step)) / F.col("_h")
    mass = F.sum(F.col("_c") * F.exp(-z * z / 2)) / F.first(F.col("_n") * F.col("_h") * (2 * math.pi) ** 0.5)
    return (points.join(counts, group).groupBy(*group, "point").agg(F.round(F.first("x"), scale).alias("x"), F.round(mass, scale).alias("density")))
