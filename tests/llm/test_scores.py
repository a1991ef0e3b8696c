"""Toxicity CRF (1) and quality ranking (5)."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from routewise.llm import quality_bt, toxicity_crf
from routewise.llm.common import held_out

MID = "/root/testdata/sf0.01"


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(3)
    lengths = [1, 3, 2, 5]
    n = sum(lengths)
    emit, trans, start = rng.normal(size=n) * 3, rng.normal(size=(2, 2)), rng.normal(size=2)
    begins = np.zeros(n, bool)
    begins[np.cumsum([0, *lengths[:-1]])] = True
    got, pair = toxicity_crf.forward_backward(emit, begins, trans, start)
    at = 0
    for k in lengths:
        total, marg, tran = 0.0, np.zeros(k), np.zeros((k, 4))
        for tags in itertools.product((0, 1), repeat=k):
            w = start[tags[0]] + sum(emit[at + i] for i, t in enumerate(tags) if t) + sum(trans[a, b] for a, b in zip(tags, tags[1:]))
            p = np.exp(w)
            total += p
            for i, t in enumerate(tags):
                marg[i] += p * t
                if i:
                    tran[i, tags[i - 1] * 2 + t] += p
        assert np.allclose(got[at:at + k], marg / total)
        assert np.allclose(pair[:, at:at + k].T, tran / total)
        at += k


def test_long_chains_stay_finite():
    m, _ = toxicity_crf.forward_backward(np.full(5000, -40.0), np.arange(5000) == 0, np.zeros((2, 2)), np.zeros(2))
    assert np.isfinite(m).all() and (m < 1e-15).all()


@pytest.fixture(scope="module")
def mid(spark):
    return spark.read.parquet(f"{MID}/documents.parquet"), spark.read.parquet(f"{MID}/labels.parquet")


def confusion(rows, labels, column):
    got = rows.join(labels, "doc_id").where("held_out").select("predicted", column).collect()
    return np.array([[sum(r["predicted"] == p and r[column] == y for r in got) for y in (0, 1)] for p in (0, 1)])


def test_quality_on_held_out_rows(mid):
    docs, labels = mid
    rows = quality_bt.score(docs, quality_bt.train(docs, labels))
    c = confusion(rows, labels, "quality")
    assert c.trace() / c.sum() > 0.95
    assert rows.where("(score >= 0.7) <> (predicted = 1) or score < 0 or score > 1").count() == 0
    assert rows.count() == docs.count()


def test_toxicity_on_held_out_rows(mid):
    docs, labels = mid
    rows = toxicity_crf.score(docs, toxicity_crf.train(docs, labels)).cache()
    c = confusion(rows, labels, "toxic")
    assert c[1, 0] <= 0.03 * c[:, 0].sum()
    assert rows.where("score < 0 or score > 1 or (score >= 0.3) <> (predicted = 1)").count() == 0
    # offsets lie on words of the text
    r = rows.where("n_spans > 0").join(docs, "doc_id").select("text", "spans").first()
    s, e = map(int, r["spans"].split(",")[0].split(":"))
    assert 0 <= s < e <= len(r["text"]) and not r["text"][s:e].isspace()


def test_labels_of_held_out_rows_change_nothing(mid):
    docs, labels = mid
    flipped = labels.withColumn("quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality_bt.train(docs, labels) == quality_bt.train(docs, flipped)


@pytest.mark.parametrize("op", [quality_bt, toxicity_crf])
def test_odd_rows(spark, odd, empty, documents, labels, op):
    model = op.train(documents, labels)
    rows = op.score(odd, model).collect()
    assert len(rows) == odd.count() and all(r["score"] is not None and 0 <= r["score"] <= 1 for r in rows)
    assert op.score(empty, model).count() == 0
    bare = op.train(documents, labels.limit(0))
    assert op.score(odd, bare).count() == odd.count()


def test_accepted_keeps_columns(odd, documents, labels):
    kept = quality_bt.accepted(odd, quality_bt.train(documents, labels))
    assert kept.columns == odd.columns and kept.count() <= odd.count()


def test_quality_fit_takes_every_label(spark):
    """Each labelled row is in a group, rare labels in several; all of them are in pairs."""
    import inspect

    assert "max_labelled" not in inspect.signature(quality_bt.train).parameters
    m = len(quality_bt.NAMES)
    rows = spark.createDataFrame([(i, int(i % 100 > 0), [float(i)] * m) for i in range(3000)], "doc_id long, y int, x array<double>")
    got = quality_bt.grouped(rows, 3000, 2970, size=256, rare=8).collect()
    good, bad = ([set(np.frombuffer(r[c]).reshape(-1, m)[:, 0].astype(int).tolist()) for r in got] for c in ("good", "bad"))
    assert len(got) >= 3000 // 256 and sum(map(len, good)) == 2970 == len(set().union(*good))
    assert set().union(*bad) == set(range(0, 3000, 100)) and sum(map(len, bad)) > 30
    one, other = np.random.default_rng(0).normal(size=(2, 70, m))
    assert quality_bt.pair_sums(one, other[:7], np.zeros(m), 20)[-1] == 1400 == quality_bt.pair_sums(other[:7], one, np.zeros(m), 20)[-1]


def test_quality_features_of_labelled_rows_take_one_python_step(spark, documents, labels):
    """The id filter runs in the step that reads the texts: a task has one Python worker."""
    from routewise.llm.common import id_bitmap

    ids = labels.select("doc_id").where("doc_id % 3 = 0")
    got = quality_bt.featurize(documents, among=id_bitmap(ids))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan
    want = {r["doc_id"]: r["x"] for r in quality_bt.featurize(documents).join(ids, "doc_id", "left_semi").collect()}
    got = {r["doc_id"]: r["x"] for r in got.collect()}
    assert want and want.items() <= got.items() and len(got) < documents.count()
