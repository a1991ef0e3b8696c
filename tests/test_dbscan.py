"""DBSCAN against a brute-force sequential implementation (the classic
algorithm: clusters grow in order of their first core point, border points
join the first cluster that reaches them), and its building blocks."""

import numpy as np
import pandas as pd
import pytest

from routewise.operators import dbscan as DB
from routewise.operators.graph import connected_components, numbered


def brute(X, eps, min_samples):
    n = len(X)
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    nbrs = [np.nonzero(D[i] <= eps)[0] for i in range(n)]
    core = np.array([len(nb) >= min_samples for nb in nbrs])
    labels = np.full(n, -1)
    c = 0
    for i in range(n):
        if labels[i] != -1 or not core[i]:
            continue
        stack = [i]
        labels[i] = c
        while stack:
            p = stack.pop()
            if not core[p]:
                continue
            for q in nbrs[p]:
                if labels[q] == -1:
                    labels[q] = c
                    if core[q]:
                        stack.append(q)
        c += 1
    return labels, core


def points(seed):
    rng = np.random.default_rng(seed)
    return np.vstack([rng.normal(0, 0.6, (60, 3)), rng.normal(4, 0.5, (50, 3)),
                      rng.uniform(-3, 7, (25, 3)), rng.normal((0, 5, 0), 0.3, (20, 3))])


def labelled(spark, X, eps, min_samples, **kw):
    rows = [(i, *map(float, x)) for i, x in enumerate(X)]
    cols = ["a", "b", "c"][:X.shape[1]]
    df = spark.createDataFrame(rows, ", ".join(["id long"] + [f"{c} double" for c in cols]))
    got = {r.id: (r.dbscan_label, r.is_core) for r in DB.dbscan(df, "id", cols, eps, min_samples, **kw).collect()}
    return [got[i][0] for i in range(len(X))], [got[i][1] for i in range(len(X))]


@pytest.mark.parametrize("seed,dup,eps,min_samples", [(0, False, 1.0, 6), (1, True, 1.0, 6), (2, False, 0.7, 4), (3, False, 1.5, 25)])
def test_dbscan_matches_brute_force(spark, seed, dup, eps, min_samples):
    X = points(seed)
    if dup:
        X = np.round(X)  # many identical vectors
    want, core = brute(X, eps, min_samples)
    got = labelled(spark, X, eps, min_samples, grid_dims=2, block=16, slice_rows=7)
    assert got[0] == list(want) and got[1] == list(core)


def test_hot_cell_and_one_dimension(spark):
    """Half of all rows within one cell, and links over cell borders only."""
    rng = np.random.default_rng(7)
    X = np.concatenate([rng.uniform(0, 0.2, 200), np.arange(40) * 0.9 + 1, [100, 100.5, 200]])[:, None]
    want, core = brute(X, 1.0, 3)
    got = labelled(spark, X, 1.0, 3, grid_dims=1, block=20)
    assert got[0] == list(want) and got[1] == list(core)


def test_no_core_rows_and_no_rows(spark):
    X = np.arange(5, dtype=float)[:, None] * 10
    assert labelled(spark, X, 1.0, 2) == ([-1] * 5, [False] * 5)
    df = spark.createDataFrame([], "id long, a double")
    assert DB.dbscan(df, "id", ["a"], 1.0, 2).collect() == []


@pytest.mark.parametrize("n", [100, 400])
def test_links_of_a_task_are_a_forest_of_its_cells(n):
    """Links grow with the cells, not with the pairs of nodes in them."""
    rng = np.random.default_rng(1)
    X = rng.uniform(0, 2, (n, 2))
    cell = (X // (1 / np.sqrt(2))).astype(int) @ [10, 1]
    pdf = pd.DataFrame({"node": np.arange(n), "a": X[:, 0], "b": X[:, 1], "cell": cell})
    both = pd.concat([pdf.assign(is_home=True), pdf.assign(is_home=False)])
    got = DB.link_cells(["a", "b"], 1.0, 16)(both)
    assert len(got) == len(set(cell)) - 1


def test_components_of_long_paths_and_stars(spark):
    rng = np.random.default_rng(3)
    path = [(i, i + 1) for i in range(1000, 1300)]
    star = [(5000, i) for i in range(5001, 5200)] + [(i, 9000) for i in range(5100, 5150)]
    pairs = [(int(a), int(b)) for a, b in rng.integers(10_000, 10_400, (250, 2))] + [(7, 7), (None, 3)]
    rows = path + star + pairs
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in rows:
        if a is not None:
            a, b = find(a), find(b)
            top[max(a, b)] = min(a, b)
    rng.shuffle(rows)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {x: find(x) for x in top}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_numbered_is_the_global_order(spark):
    values = [int(x) for x in np.random.default_rng(5).permutation(5000)[:900]]
    got = numbered(spark.createDataFrame([(v,) for v in values], "v long"), "v", "n").collect()
    assert {r.v: r.n for r in got} == {v: i for i, v in enumerate(sorted(values))}
    assert numbered(spark.createDataFrame([], "v long"), "v", "n").collect() == []
