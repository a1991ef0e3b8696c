"""Ranking, reshaping and window operators."""

import numpy as np
import pytest
from routewise.operators import reshape as RS
from routewise.sources import landing as L
from routewise.sources import months as M
from routewise.sources.sinks import inventory
from pyspark.sql import functions as F

from routewise.operators import ranking as R
from routewise.operators import windows as W


def test_mode_tie_break(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (1, "a"), (2, "c")], "g int, v string")
    got = {r.g: r.mode_v for r in R.mode(df, ["g"], "v").collect()}
    assert got == {1: "a", 2: "c"}


def test_top_and_bottom(spark):
    df = spark.createDataFrame([(i, i % 4) for i in range(10)], "id int, x int")
    got = R.top_and_bottom(df, 2, "x", ["id"]).collect()
    assert [(r.rank_group, r.id) for r in got if r.rank_group == "top"] == [("top", 3), ("top", 7)]
    assert sorted(r.id for r in got if r.rank_group == "bottom") == [0, 4]


def test_seeded_sample_independent_of_partitioning(spark):
    df = spark.range(0, 500).withColumnRenamed("id", "k")
    a = {r.k for r in R.seeded_sample(df, 50, "k", 7).collect()}
    b = {r.k for r in R.seeded_sample(df.repartition(13), 50, "k", 7).collect()}
    assert a == b and len(a) == 50


def test_rolling_mean_partial_start(spark):
    df = spark.createDataFrame([("r", i, float(i)) for i in range(1, 5)], "g string, d int, v double")
    got = [r.m for r in W.rolling_mean(df, ["g"], "d", "v", 3, "m").orderBy("d").collect()]
    assert got == [1.0, 1.5, 2.0, 3.0]


def test_deviation_zero_mean(spark):
    df = spark.createDataFrame([(1, 0.0, 2.0), (2, 0.0, 4.0)], "g int, z double, v double")
    got = {r.g: (r.z_dev, r.v_dev) for r in W.group_means_with_deviation(df, ["g"], ["z", "v"]).collect()}
    assert got == {1: (0.0, -1 / 3), 2: (0.0, 1 / 3)}


def test_minmax_constant_column(spark):
    df = spark.createDataFrame([(1, 5.0, 1.0), (2, 5.0, 3.0)], "g int, c double, v double")
    got = {r.g: (r.c_s, r.v_s) for r in W.minmax_scale(df, ["c", "v"], "_s").collect()}
    assert got == {1: (0.0, 0.0), 2: (0.0, 1.0)}


# -- boxes, violins, months, file lineage -----------------------------------------------
def _values(spark, n=20_000):
    rng = np.random.default_rng(11)
    v = np.concatenate([rng.normal(30, 5, n), rng.exponential(40, n // 10)])
    return v, spark.createDataFrame([("a" if i % 3 else "b", float(x)) for i, x in enumerate(v)] + [("a", None), ("one", 4.0), ("one", 4.0)], "g string, v double").repartition(5)


def test_sketch_quartiles_are_within_their_rank_error(spark):
    v, df = _values(spark)
    got = {r.g: r for r in RS.quartiles(df, ["g"], "v").collect()}
    exact = {r.g: r for r in RS.quartiles(df, ["g"], "v", exact=True).collect()}
    for g, rest in (("a", (1, 2)), ("b", (0,))):
        x = np.sort([y for i, y in enumerate(v) if i % 3 in rest])
        for q, c in ((0.25, "q1"), (0.5, "median"), (0.75, "q3")):
            assert abs(np.searchsorted(x, got[g][c]) / len(x) - q) < 0.005
            assert exact[g][c] == pytest.approx(np.quantile(x, q))
        assert got[g].n == len(x) and got[g].min == x[0] and got[g].max == x[-1]


def test_box_whiskers_and_outliers(spark):
    v, df = _values(spark)
    r = next(r for r in RS.box(df, ["g"], "v", exact=True).collect() if r.g == "b")
    x = np.array([y for i, y in enumerate(v) if i % 3 == 0])
    q1, q3 = np.quantile(x, [0.25, 0.75])
    inside = x[(x >= q1 - 1.5 * (q3 - q1)) & (x <= q3 + 1.5 * (q3 - q1))]
    assert (r.whisker_low, r.whisker_high) == pytest.approx((inside.min(), inside.max()), abs=1e-6) and r.outliers == len(x) - len(inside)


def test_violin_is_near_the_kernel_density_of_all_values(spark):
    v, df = _values(spark, 2000)
    got = sorted((r.x, r.density) for r in RS.violin(df, ["g"], "v").collect() if r.g == "b")
    x = np.array([y for i, y in enumerate(v) if i % 3 == 0])
    h = 1.06 * x.std(ddof=1) * len(x) ** -0.2
    want = [np.exp(-((p - x) / h) ** 2 / 2).sum() / (len(x) * h * np.sqrt(2 * np.pi)) for p, _ in got]
    assert np.abs(np.array(want) - [d for _, d in got]).max() < 0.03 * max(want)
    assert "one" not in {r.g for r in RS.violin(df, ["g"], "v").collect()}  # a single value has no density


def test_recent_reads_the_last_months_only(spark, tmp_path):
    df = spark.range(400).selectExpr("date_add(date'2023-01-01', cast(id as int)) as d", "id")
    path = M.write_by_month(df, str(tmp_path / "t"), "d", ["id"])
    assert str(M.newest_month(spark, path)) == "2024-02-01"
    got = M.recent_by_month(spark, path, "d", 30)
    assert sorted(r.id for r in got.collect()) == list(range(369, 400))
    text = got._jdf.queryExecution().toString()
    assert "month" in text and "PartitionFilters: [isnotnull(month" in text
    opened = {f.split("month=")[1][:10] for f in got.inputFiles()}
    assert opened <= {"2024-01-01", "2024-02-01"} | {f.split("month=")[1][:10] for f in spark.read.parquet(path).inputFiles()}
    empty = str(tmp_path / "none")
    M.write_by_month(df.limit(0), empty, "d", ["id"])
    assert M.newest_month(spark, empty) is None


def test_inventory_counts_files_bytes_and_rows_in_one_plan(spark, tmp_path):
    spark.range(100).repartition(3).write.parquet(str(tmp_path / "a"))
    spark.range(0).write.parquet(str(tmp_path / "b"))
    paths = {"a": str(tmp_path / "a"), "b": str(tmp_path / "b"), "c": str(tmp_path / "c")}
    got = {r.name: r for r in inventory(spark, paths).collect()}
    size = sum(p.stat().st_size for p in (tmp_path / "a").glob("part-*"))
    assert (got["a"].present, got["a"].files, got["a"].rows, got["a"].bytes) == (True, 3, 100, size)
    assert got["b"].present and got["b"].rows == 0 and not got["c"].present and got["c"].rows is None
    assert inventory(spark, {"c": paths["c"]}).first().files == 0


def test_receipt_of_landed_files(spark, tmp_path):
    df = spark.range(30).selectExpr("cast(id as string) as k", "cast(id % 4 as int) as _chunk", "date_add(date'2024-01-01', cast(id % 3 as int)) as _date")
    L.write_landing(df, str(tmp_path), "things")
    got = L.receipt_of_files(spark, str(tmp_path), "things").orderBy("partition_date").collect()
    assert [(str(r.partition_date), r.rows_written) for r in got] == [("2024-01-01", 10), ("2024-01-02", 10), ("2024-01-03", 10)]
    assert all(r.path.endswith(f"things/date={r.partition_date}") and r.bytes > 0 and r.files >= 1 and r.modified for r in got)
