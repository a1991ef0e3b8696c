"""Language identification (12)."""

import numpy as np
from pyspark.sql import functions as F

from routewise.llm import language_id as L
from routewise.llm import queries
from tests.llm.conftest import SF

VOCAB = L.Vocabulary([b"ab", b"a", b"abc", b"x9", "é".encode()], [b"bc", b"ab", b"b", b"cab", "éa".encode()])


def segmentations(unit: bytes, p, vocab):
    """(pieces) of every segmentation of a unit, by trying all cuts."""
    by_hash = dict(zip(vocab.keys.tolist(), vocab.ids.tolist()))

    def rest(x):
        if not x:
            yield []
        for e in range(1, len(x) + 1):
            i = x[0] if e == 1 else by_hash.get(L.Vocabulary._hash(x[:e]))
            if i is not None:
                for more in rest(x[e:]):
                    yield [i, *more]

    for more in rest(unit):
        yield [256, *more]
    for e in range(1, len(unit) + 1):
        i = by_hash.get(L.Vocabulary._hash(unit[:e]) ^ int(L._MARK))
        if i is not None:
            for more in rest(unit[e:]):
                yield [i, *more]


def spans(words):
    buf = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    return buf, ends - [len(w) for w in words], ends


WORDS = [b"abcab", b"a", b"abab", "éaé".encode(), b"cabcabab", b"zz", b"abc"]


def test_forward_sums_all_segmentations():
    p = np.random.default_rng(0).dirichlet(np.ones(VOCAB.size), 3).T
    got = L.log_probabilities(VOCAB, p, *spans(WORDS))
    want = [[sum(np.prod([p[i, k] for i in s]) for s in segmentations(w, p, VOCAB)) for k in range(3)] for w in WORDS]
    assert np.allclose(np.exp(got), want)


def test_expected_counts_over_all_segmentations():
    p = np.random.default_rng(1).dirichlet(np.ones(VOCAB.size))
    n = np.arange(1.0, len(WORDS) + 1)
    want = np.zeros(VOCAB.size)
    for w, k in zip(WORDS, n):
        all_ = [(s, np.prod(p[s])) for s in segmentations(w, p, VOCAB)]
        total = sum(v for _, v in all_)
        for s, v in all_:
            for i in s:
                want[i] += k * v / total
    assert np.allclose(L.expected_counts(VOCAB, p, *spans(WORDS), n), want)


def test_held_out_accuracy(spark, documents):
    got = queries.op12_language_id(spark, SF)
    assert got.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    rows = got.join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == documents.count()
    held = [r for r in rows if r["held_out"]]
    assert held and sum(r["lang_pred"] == r["lang"] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_score_ignores_other_columns(spark, documents):
    """Labels and sources are no input of a prediction."""
    m = L.train(documents, queries.tokenizer_path(queries.PIECES))
    other = documents.select("doc_id", "text", F.lit("xx").alias("lang"), F.lit("y").alias("source"))
    a, b = ({r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.predict(d, m).collect()} for d in (documents, other))
    assert a == b


def test_odd_and_empty(spark, documents, odd, empty):
    m = L.train(documents.select("doc_id", "text", "lang"), queries.tokenizer_path(queries.PIECES))
    rows = odd.select("*").union(odd.limit(1).select(F.lit(90).cast("long"), F.lit("12 34 !? €"), *odd.columns[2:])).union(
        odd.limit(1).select(F.lit(91).cast("long"), F.lit("漢字 かな"), *odd.columns[2:])).union(odd.limit(1).select(F.lit(92).cast("long"), F.lit("a" * 200_000), *odd.columns[2:]))
    got = {r["doc_id"]: r for r in L.predict(rows, m).collect()}
    assert len(got) == 12
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1, 2, 3, 90))
    assert all(got[i]["lang_pred"] in m.langs for i in (4, 5, 7, 8, 91, 92, None))
    assert L.predict(empty, m).collect() == []
    nothing = L.train(empty, queries.tokenizer_path(queries.PIECES))
    assert {r["lang_pred"] for r in L.predict(odd, nothing).collect()} == {"und"}


def test_sample_is_bounded_and_whole_texts_count(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("eins zwei").alias("text"), F.lit("de").alias("lang"))
    m = L.train(docs, queries.tokenizer_path(queries.PIECES), docs_per_lang=100, rounds=1)
    assert m.langs == ["de"] and np.allclose(m.p.sum(), 1, atol=1e-3)


def test_units_cut_long_runs():
    buf = np.frombuffer(b"a" * 70 + b" bb", np.uint8)
    starts, ends, rows = L.units(buf, np.array([0, 73]))
    assert (ends - starts).tolist() == [32, 32, 6, 2] and rows.tolist() == [0, 0, 0, 0]
