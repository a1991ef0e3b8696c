"""Segmentation: scaling, median impute, remap, silhouette vs brute force,
K-Means invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from routewise.functions import constants as K
from routewise.operators import clustering as CL
from routewise.plans import segmentation as G
from routewise.sources.standin import Entities
from tests.conftest import SF_SMALL


def test_exact_median_and_population_scaling(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (9.0,), (None,)], "x double")
    imp = CL.impute_median(df, ["x"])
    assert sorted(r.x for r in imp.collect()) == [1.0, 2.0, 3.0, 4.0, 9.0]
    sc = [r.x_scaled for r in CL.standardize(imp, ["x"]).collect()]
    v = np.array([1.0, 2.0, 3.0, 4.0, 9.0])
    assert sorted(sc) == pytest.approx(sorted((v - v.mean()) / v.std()))


def test_remap_order_and_ties():
    rows = [{"raw_cluster": r, **{f"score_{i}": 0.0 for i in range(5)}} for r in range(5)]
    rows[4]["score_3"] = rows[4]["score_1"] = 2.0   # 3 chooses before 1
    rows[1]["score_2"] = 1.0
    assert CL.remap_clusters(rows, K.REMAP_ORDER) == {4: 3, 1: 2, 0: 0, 2: 4, 3: 1}
    with pytest.raises(ValueError):
        CL.remap_clusters(rows[:4], K.REMAP_ORDER)


@pytest.mark.parametrize("block", [2000, 9])
def test_silhouette_matches_brute_force(spark, block):
    """In one block, and in many."""
    rng = np.random.default_rng(3)
    pts = np.vstack([rng.normal(0, 1, (30, 2)), rng.normal(5, 1, (30, 2)), rng.normal((0, 6), 1, (5, 2))])
    lab = np.array([0] * 30 + [1] * 30 + [2] * 5)
    lab2 = (pts[:, 0] > 2.5).astype(int)
    rows = [(i, float(p[0]), float(p[1]), int(a), int(b)) for i, (p, a, b) in enumerate(zip(pts, lab, lab2))]
    df = spark.createDataFrame(rows, "_sid long, x double, y double, l1 int, l2 int")
    got = {r.labeling: r.s for r in CL.silhouette(df, "_sid", ["x", "y"], ["l1", "l2"], block=block)
           .groupBy("labeling").agg(F.avg("s").alias("s")).collect()}

    def brute(L):
        D = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1))
        s = []
        for i in range(len(pts)):
            own = L == L[i]
            if own.sum() <= 1:
                s.append(0.0)
                continue
            a = D[i, own].sum() / (own.sum() - 1)
            b = min(D[i, L == u].mean() for u in set(L) if u != L[i])
            s.append((b - a) / max(a, b))
        return np.mean(s)

    assert got["l1"] == pytest.approx(brute(lab))
    assert got["l2"] == pytest.approx(brute(lab2))


def test_kmeans_assignment_invariants(spark):
    E = Entities(spark, SF_SMALL)
    seg = G.Segmentation(E, k_range=[2, 3, 4], diag_restarts=2, final_restarts=3)
    a = seg.assignments()
    n = G.feature_matrix(E).count()
    assert a.count() == n and a.select("passenger_id").distinct().count() == n
    assert {r.cluster_id for r in a.select("cluster_id").distinct().collect()} <= set(range(5))
    wss = [r.wss for r in seg.elbow().orderBy("k").collect()]
    assert wss[0] >= wss[-1]
    assert set(seg.mapping.values()) == set(range(5))


def test_fits_run_in_partitions_and_equal_mllib(spark, monkeypatch):
    """Few passes over many partitions, with the centres and costs of MLlib's own fits."""
    from pyspark.ml.clustering import KMeans

    rng = np.random.default_rng(4)
    pts = np.vstack([rng.normal(c, 1, (60, 2)) for c in ((0, 0), (6, 1), (3, 7))])
    df = spark.createDataFrame([tuple(map(float, p)) for p in pts], "x double, y double").coalesce(1).checkpoint()
    got = CL.best_fits(df, ["x", "y"], [2, 3], [1, 2, 3], 50)
    X = CL.assemble(df.repartition(1), ["x", "y"])
    for k, fit in got.items():
        cost = min(KMeans(k=k, seed=s, maxIter=50).fit(X.select("features")).summary.trainingCost for s in (1, 2, 3))
        assert fit.cost == pytest.approx(cost) and len(fit.centers) == k
    passes = []
    monkeypatch.setattr(CL, "PART_ROWS", 20)
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, *a, _run=type(df).mapInArrow: passes.append(self.rdd.getNumPartitions()) or _run(self, *a))
    CL.best_fits(df, ["x", "y"], [2, 3], [1, 2, 3], 50)
    assert min(passes) == 9 and len(passes) <= 50


def _lloyd(x, c, max_iter):
    """Steps one by one over all rows: centres, cost, steps."""
    for step in range(1, max_iter + 1):
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        near, cost, old = d.argmin(1), d.min(1).sum(), c
        c = np.array([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
        if np.sqrt(((c - old) ** 2).sum(1)).max() <= CL.TOLERANCE:
            break
    return c, cost, step


@pytest.mark.parametrize("room, most", [(10_000, 10), (400, 50)])
def test_fits_take_many_exact_steps_a_pass(spark, monkeypatch, room, most):
    """Fits that need many steps take fewer passes over the rows, whether a fit's
    task has room for all rows or only for those near a border, and end where steps over
    all rows end."""
    x = np.random.default_rng(8).uniform(size=(3000, 2)) * 4
    df = spark.createDataFrame([tuple(map(float, p)) for p in x], "x double, y double").checkpoint()
    passes, starts = [], []
    monkeypatch.setattr(CL, "NEAR_ROWS", room)
    monkeypatch.setattr(CL, "LEAST_REACH", 2)
    monkeypatch.setattr(CL, "_starts", lambda *a, _run=CL._starts: starts.extend(_run(*a)) or starts)
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, *a, _run=type(df).mapInArrow: passes.append(1) or _run(self, *a))
    got = CL.best_fits(df, ["x", "y"], [6, 9], [1, 2], 300)
    want = [_lloyd(x, c, 300) for c in starts]
    for i, k in enumerate((6, 9)):
        centers, cost, _ = min(want[2 * i:2 * i + 2], key=lambda w: w[1])
        assert got[k].cost == pytest.approx(cost) and np.allclose(got[k].centers, centers, atol=1e-6)
    assert max(w[2] for w in want) > 50 and len(passes) <= most


def test_starts_of_all_fits_are_those_of_mllib(spark):
    """Drawn for all runs in the same passes, over several partitions, one of them empty."""
    from pyspark.ml.clustering import KMeans

    x = np.random.default_rng(6).normal(size=(4000, 3))
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "i long, a double, b double, c double").repartitionById(5, F.expr("int(i % 4)")).drop("i").checkpoint()
    runs = [(k, seed) for k in (2, 5, 9) for seed in (42, 43, -7)]
    got = CL._starts(CL._packed(df, ["a", "b", "c"]).persist(), 3, runs)
    for (k, seed), centers in zip(runs, got):
        assert np.allclose(centers, KMeans(k=k, seed=seed, maxIter=0).fit(CL.assemble(df, ["a", "b", "c"]).select("features")).clusterCenters())


def test_ties_and_equal_rows_in_fits(spark):
    """A row between two centres counts once; fewer different rows than centres end as the centres."""
    ones = np.array([[0.0, 1.0, 2.0, 1.0], [1.0] * 4])
    c = np.array([[[0.0]], [[2.0]], [[0.0]]])
    assert CL._totals(ones, c)[:, 0].tolist() == [[2.0, 3.0], [2.0, 1.0], [0.0, 0.0]]
    assert CL._assign(ones, c, np.ones((3, 1)))[0].tolist() == [[0, 0, 1, 0]]
    df = spark.createDataFrame([(float(i % 2), 1.0) for i in range(50)], "x double, y double")
    fit = CL.best_fits(df, ["x", "y"], [4], [1, 2], 20)[4]
    assert fit.cost == 0 and sorted(map(tuple, fit.centers)) == [(0.0, 1.0), (1.0, 1.0)]


def test_silhouette_of_equal_rows_is_zero(spark):
    """Distances of equal rows are exactly 0, in one block and between blocks."""
    df = spark.createDataFrame([(i, 0.1, 1e3, i % 2) for i in range(60)], "id long, x double, y double, l int")
    assert {r.s for r in CL.silhouette(df, "id", ["x", "y"], ["l"], block=16).collect()} == {0.0}


def test_exact_quantile_matches_numpy(spark):
    rng = np.random.default_rng(5)
    vals = rng.normal(size=1001).round(3)
    df = spark.createDataFrame([(float(v),) for v in vals] + [(None,)], "x double").repartition(7)
    for q in (0.5, 0.25, 0.9):
        assert CL.exact_quantile(df, "x", q) == pytest.approx(float(np.quantile(vals, q)))
    even = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (9.0,)], "x double")
    assert CL.exact_quantile(even, "x") == 3.0


def test_exact_quantile_sends_no_rows_through_python(spark, monkeypatch):
    df = spark.range(9).selectExpr("double(id) as x")
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", None)
    assert CL.exact_quantile(df, "x") == 4.0


def test_exact_quantile_with_hot_value(spark):
    vals = [5.0] * 400 + [float(i) for i in range(800)]
    df = spark.createDataFrame([(v,) for v in vals], "x double").repartition(5)
    for q in (0.25, 0.5, 0.75):
        assert CL.exact_quantile(df, "x", q) == pytest.approx(float(np.quantile(vals, q)))


def test_saved_model_labels_as_the_fitted_one(spark, tmp_path):
    from routewise.plans import segmentation as G
    from routewise.sources.standin import Entities
    from tests.conftest import SF_SMALL

    s = G.Segmentation(Entities(spark, SF_SMALL), final_restarts=2)
    path = s.save(str(tmp_path / "model"))
    got = {r.passenger_id: r.raw_cluster for r in G.apply_model(path, s.X).select("passenger_id", "raw_cluster").collect()}
    want = {r.passenger_id: r.raw_cluster for r in s.raw_labels().select("passenger_id", "raw_cluster").collect()}
    assert got == want and len(set(got.values())) == K.OPTIMAL_K


def test_scaler_round_trip_with_a_constant_column(spark, tmp_path):
    from routewise.operators.scaling import PopulationScaler, PopulationScalerModel

    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (6.0, 5.0)], "a double, b double")
    model = PopulationScaler(["a", "b"]).fit(df)
    model.write().overwrite().save(str(tmp_path / "s"))
    got = PopulationScalerModel.load(str(tmp_path / "s")).transform(df).orderBy("a").collect()
    assert [r.b_scaled for r in got] == [0, 0, 0]
    assert [r.a_scaled for r in got] == pytest.approx([(x - 3) / np.std([1, 2, 6]) for x in (1, 2, 6)])
