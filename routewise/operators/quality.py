"""Declarative data-quality tests as Spark jobs.

A test returns its violating rows (pass = zero rows).  ``run_tests``
evaluates a whole suite for one model as a summary (model, test, column,
failures) in one scan of it; ``Watch`` takes the row tests of a model while it is
written.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C

ROW_KINDS = {"not_null", "accepted_values", "accepted_range", "positive", "expression"}


@dataclass(frozen=True)
class DataTest:
    kind: str                 # not_null | unique | accepted_values | relationships |
    column: str               # accepted_range | unique_combination | positive | expression
    values: tuple = ()        # accepted values
    lo: float | None = None   # range bounds (inclusive)
    hi: float | None = None
    where: str | None = None  # optional SQL filter for accepted_range
    parent: str | None = None  # relationships: parent model name
    parent_col: str | None = None
    columns: tuple = ()       # unique_combination
    predicate: str | None = None  # expression: SQL predicate that flags a violation
    name: str = field(default="")

    @property
    def test_name(self) -> str:
        return self.name or self.kind


def violation(t: DataTest) -> Column:
    """Row-level violation predicate (NULL never counts, as in SQL tests)."""
    c = F.col(t.column) if t.column and t.kind != "expression" else None
    if t.kind == "not_null":
        return c.isNull()
    if t.kind == "accepted_values":
        return ~c.isin(list(t.values))
    if t.kind == "accepted_range":
        conds = []
        if t.lo is not None:
            conds.append(c >= F.lit(t.lo))
        if t.hi is not None:
            conds.append(c <= F.lit(t.hi))
        v = ~C.conj(conds)
        return v & F.expr(t.where) if t.where else v
    if t.kind == "positive":
        return c <= 0
    if t.kind == "expression":
        return F.expr(t.predicate)
    raise ValueError(t.kind)


def violations(df: DataFrame, t: DataTest, parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """The failing rows of one test."""
    if t.kind in ROW_KINDS:
        return df.filter(F.coalesce(violation(t), F.lit(False)))
    if t.kind == "unique":
        return (df.filter(F.col(t.column).isNotNull()).groupBy(t.column)
                  .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1))
    if t.kind == "unique_combination":
        return (df.groupBy(*t.columns).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1))
    if t.kind == "relationships":
        p = parents[t.parent].select(F.col(t.parent_col).alias("_pk"))
        child = df.filter(F.col(t.column).isNotNull())
        return child.join(p, child[t.column] == p["_pk"], "left_anti")
    raise ValueError(t.kind)


KEY_KINDS = {"unique", "unique_combination", "relationships"}


def _column_name(t: DataTest) -> str:
    return t.column or ",".join(t.columns)


def _failures(model: str, agg: DataFrame, tests: list[DataTest]) -> DataFrame:
    """One row per test from the one row of agg with columns _t0, _t1, .."""
    recs = F.array(*[F.struct(F.lit(t.test_name).alias("test"), F.lit(_column_name(t)).alias("column_name"), F.coalesce(f"_t{i}", F.lit(0)).cast("long").alias("failures"))
                     for i, t in enumerate(tests)])
    return agg.select(F.inline(recs)).select(F.lit(model).alias("model"), "test", "column_name", "failures")


def _key_of(t: DataTest) -> Column:
    if t.kind == "unique_combination":  # a NULL is a value there
        return F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in t.columns])
    return F.col(t.column).cast("string")


def run_tests(model: str, df: DataFrame, tests: list[DataTest],
              parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """Summary of a suite: one row per test with its failure count.

    The model is scanned once, whatever the number of tests.  Each row gives a record
    (test, key) for each test on keys; the first also carries the row tests' violations.
    Parents give their keys as records of the same tests.  One aggregation by (test, key)
    with map-side combining then decides uniqueness and parents, and its sums are the
    row tests' failures."""
    row = [t for t in tests if t.kind in ROW_KINDS]
    keyed = [t for t in tests if t.kind in KEY_KINDS]
    broken = [F.coalesce(violation(t), F.lit(False)).cast("long") for t in row]
    if not keyed:
        return _failures(model, df.agg(*[F.sum(v).alias(f"_t{i}") for i, v in enumerate(broken)]), row)
    carried = [f"_t{i}" for i in range(len(row))]
    none = [F.lit(0).cast("long").alias(c) for c in carried]
    record = lambda j, key, n, parent, flags: [F.lit(j).alias("_test"), key.alias("_key"), F.lit(n).cast("long").alias("_n"), F.lit(parent).alias("_parent"), *flags]
    rows = df.select(F.inline(F.array(*[F.struct(*record(j, _key_of(t), 1, 0, [v.alias(c) for v, c in zip(broken, carried)] if j == 0 else none)) for j, t in enumerate(keyed)])))
    for j, t in enumerate(keyed):
        if t.kind == "relationships":
            rows = rows.unionByName(parents[t.parent].select(*record(j, F.col(t.parent_col).cast("string"), 0, 1, none)))
    per = rows.groupBy("_test", "_key").agg(F.sum("_n").alias("_n"), F.max("_parent").alias("_parent"), *[F.sum(c).alias(c) for c in carried])
    totals = [F.sum(c).alias(c) for c in carried]
    for j, t in enumerate(keyed):
        here = F.col("_test") == j
        if t.kind != "unique_combination":
            here = here & F.col("_key").isNotNull()
        bad = F.when(here & (F.col("_parent") == 0), F.col("_n")) if t.kind == "relationships" else F.when(here & (F.col("_n") > 1), 1)
        totals.append(F.sum(bad).alias(f"_t{len(row) + j}"))
    return _failures(model, per.agg(*totals), row + keyed)


class Watch:
    """Row tests and the row count of a model as metrics that Spark observes while the
    model is written: they cost no scan of their own."""

    def __init__(self, model: str, tests: list[DataTest]):
        self.model, self.tests = model, [t for t in tests if t.kind in ROW_KINDS]
        self._seen = Observation(f"{model}-{uuid.uuid4().hex}")

    def on(self, df: DataFrame) -> DataFrame:
        sums = [F.sum(F.coalesce(violation(t), F.lit(False)).cast("long")).alias(f"_t{i}") for i, t in enumerate(self.tests)]
        return df.observe(self._seen, F.count(F.lit(1)).alias("rows"), *sums)

    @property
    def rows(self) -> int:
        """Rows written; waits for the write."""
        return self._seen.get["rows"]

    def failures(self, spark: SparkSession) -> DataFrame:
        got = self._seen.get
        rows = [(self.model, t.test_name, _column_name(t), int(got[f"_t{i}"] or 0)) for i, t in enumerate(self.tests)]
        return spark.createDataFrame(rows, "model string, test string, column_name string, failures long")


def null_profile(df: DataFrame, threshold: float = 0.20) -> DataFrame:
    """NULL rate of every column in one pass, flagged above threshold."""
    cols = df.columns
    agg = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"_z{i}") for i, c in enumerate(cols)])
    recs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"_z{i}").alias("nulls"))
                     for i, c in enumerate(cols)])
    long = agg.select("_n", F.inline(recs))
    rate = C.safe_ratio("nulls", "_n", 4)
    return long.select("column_name", "nulls", rate.alias("null_rate"),
                       F.coalesce(rate > threshold, F.lit(False)).alias("flagged"))


def out_of_range(df: DataFrame, column: str, lo, hi) -> Column:
    """Rows outside [lo, hi]; a NULL counts as outside."""
    return C.count_if(~F.coalesce(F.col(column).between(lo, hi), F.lit(False)))


def row_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """Row count per named frame, unioned into one status frame."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("name"), "rows")
             for n, df in frames.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def assert_gate(df: DataFrame, condition: str, message: str) -> None:
    """Q16: stage gate; raises when any row of the (small) status frame
    violates ``condition``."""
    bad = df.filter(~F.coalesce(F.expr(condition), F.lit(False))).limit(5).collect()
    if bad:
        raise AssertionError(f"{message}: {bad}")
