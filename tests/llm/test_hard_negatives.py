"""Hard negatives (11)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from routewise.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, every=50, positives=5, negatives=3):
    ok = [(i, v, label) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ok = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in ok]
    out = []
    for a, (i, v, label) in enumerate(ok):
        if i % every:
            continue
        met = sorted((-sum(x * y for x, y in zip(v, w)), j, other == label) for b, (j, w, other) in enumerate(ok) if b != a and len(w) == len(v))
        for s, p, _ in [m for m in met if m[2]][:positives]:
            near = [(t, j) for t, j, same in met if not same and 50 * -s <= 100 * -t <= 95 * -s]
            out += [(i, p, k + 1, j, -s, -t) for k, (t, j) in enumerate(near[:negatives])]
    return sorted(out)


def mined(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(map(tuple, H.mine(df.repartition(3), **kw).collect()))


def some(n=700, dim=24, labels=4, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((12, dim))
    return [(i, (base[rng.integers(12)] + 0.7 * rng.standard_normal(dim)).tolist(), int(rng.integers(labels))) for i in range(n)]


@pytest.mark.parametrize("size", [H.ANCHOR_BYTES, 1000])
def test_equals_brute_force(spark, size):
    """Also with the anchors in many blocks."""
    rows = some()
    assert mined(spark, rows, anchor_bytes=size) == brute(rows)


def test_odd_rows(spark):
    rows = some(120, 3, 2)
    rows += [(None, [1.0, 2.0, 3.0], 1), (200, None, 1), (201, [1.0, None, 2.0], 0), (202, [1.0, math.inf, 2.0], 0), (203, [1.0, math.nan, 2.0], 0), (250, [1.0, 1.0, 1.0], None),
             (300, [], 1), (301, [], 1), (302, [], 0), (350, [0.0, 0.0, 0.0], 0), (-50, [1.0, -2.0, 0.5], 1),
             (400, [1.0, 2.0], 1), (401, [1.0, 2.0], 1), (402, [0.9, 1.6], 0), (403, [0.9, 1.6], 0)]
    rows += rows[50:52] + rows[:1] + rows[100:101]  # repeated rows
    assert mined(spark, rows) == brute(rows)


def test_large_components_are_exact(spark):
    rows = [(0, [1e6 + 1 / 3, 2e6, 3.0], 0), (1, [1e6, 2e6, 1.0], 0), (2, [8e5, 1.6e6, 9.0], 1), (3, [8e5, 1.6e6, 9.0], 1), (4, [3e6, -1.0, 0.0], 1)]
    assert mined(spark, rows) == brute(rows) and mined(spark, rows)


def test_empty_table_and_clashing_columns(spark):
    rows = some(130, 5, 2)
    df = spark.createDataFrame(rows, SCHEMA)
    odd = df.select("*", *[F.lit("z").alias(c) for c in ("row", "vec", "code", "align", "norm", "anchor", "range", "score", "rank", "dim")])
    assert sorted(map(tuple, H.mine(odd).collect())) == brute(rows)
    assert H.mine(df.limit(0)).collect() == [] and H.mine(df.where("vec_id % 50 <> 0")).collect() == []


@pytest.mark.parametrize("dim", [1, 17, 64, 100])
def test_intervals_hold_the_score(dim):
    """The bounds are deterministic, and tighter than lengths alone for some pairs."""
    rng = np.random.default_rng(dim)
    x = np.floor(256 * rng.standard_normal((300, dim)) * rng.exponential(1, (300, 1)))
    q = np.vstack([x[:20], np.zeros((1, dim))])
    a = H.Anchors(np.arange(21), np.arange(21), np.zeros(21), q)
    code, align = H.codes_of(H.rotated(x))
    norm = np.sqrt((x * x).sum(axis=1))
    low, high = a.intervals(slice(0, 21), code, align, norm)
    score = q @ x.T
    assert (low <= score).all() and (score <= high).all()
    assert ((high - low)[:20] < 1.8 * np.outer(a.norm[:20], norm)).mean() > 0.9


def test_rotation_keeps_inner_products():
    x = np.random.default_rng(0).standard_normal((40, 70))
    assert np.allclose(H.rotated(x) @ H.rotated(x).T, x @ x.T)
