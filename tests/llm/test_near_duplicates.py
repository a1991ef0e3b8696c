"""N-gram Jaccard join (8) and embedding near-duplicates (9)."""

import re

import numpy as np
import pytest

from routewise.llm import embed_lsh, jaccard_join
from tests.llm.conftest import SF

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return frozenset(" ".join(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([" ".join(w)] if w else [])


def smallest(n, links, ids):
    label = list(range(n))

    def top(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i, j in links:
        label[top(i)] = top(j)
    low = {}
    for i in range(n):
        low[top(i)] = min(low.get(top(i), ids[i]), ids[i])
    return [low[top(i)] for i in range(n)]


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    return [len(s) for s in sets], smallest(len(rows), links, [i for i, _ in rows])


def planted():
    """Chains, groups of near copies at all distances, shared passages, size limits."""
    rng = np.random.default_rng(5)
    word = lambda: "w%04d" % rng.integers(0, 5000)
    passage = " ".join(word() for _ in range(60))
    texts = []
    for _ in range(12):  # a passage shared by unrelated texts
        texts.append(passage + " " + " ".join(word() for _ in range(40)))
    base = [word() for _ in range(120)]
    for k in range(50):  # near copies with 0 to 6 edits, so similarities on both sides of 0.8
        w = list(base)
        for at in rng.integers(0, len(w), k % 7):
            w[at] = word()
        texts.append(" ".join(w))
    chain = [word() for _ in range(100)]
    for k in range(10):  # each links to the next only
        texts.append(" ".join(chain[4 * k:4 * k + 60]))
    for n in (1, 2, 3, 4, 5, 6, 8, 9, 10, 50):
        texts += [" ".join(base[:n]), " ".join(base[:n]).upper() + " \n"]
    return texts


def test_jaccard_equals_brute_force(spark):
    rows = list(enumerate(planted()))
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).orderBy("doc_id").collect()
    n, comp = brute(rows)
    assert [r["n_shingles"] for r in got] == n and [r["component_id"] for r in got] == comp


def test_remaining_pairs_alone_are_exact(spark):
    """Without pivot rounds, with nearly all in tiles: all their pairs are compared."""
    rows = list(enumerate(planted()))
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), rounds=0, near=1).orderBy("doc_id").collect()
    assert [r["component_id"] for r in got] == brute(rows)[1]


def test_jaccard_on_documents(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").orderBy("doc_id").collect()]
    got = jaccard_join.near_duplicates(documents).orderBy("doc_id").collect()
    n, comp = brute(rows)
    assert [(r["n_shingles"], r["component_id"]) for r in got] == list(zip(n, comp))


def test_pairs_of_near_copies_stay_few(spark, monkeypatch):
    """In a large group of near copies pivots link most, before all that are left meet."""
    docs = spark.read.parquet("/root/testdata/check_h/documents.parquet").select("doc_id", "text")
    made, bound = [], jaccard_join.may_link
    monkeypatch.setattr(jaccard_join, "may_link", lambda pairs, *a: made.append(pairs.count()) or bound(pairs, *a))
    assert jaccard_join.near_duplicates(docs).count() == docs.count()
    assert max(made) < docs.count() / 2


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 62, 300).astype(np.uint64))
    b = np.unique(np.concatenate([a[30:], rng.integers(0, 1 << 62, 25).astype(np.uint64)]))
    s = jaccard_join.signature(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
    differ = int(np.bitwise_count(s[0] ^ s[1]).sum())
    assert differ <= len(np.setxor1d(a, b)) and differ > 30
    sets = [a, b, a[:260], a[:1], np.unique(rng.integers(0, 1 << 62, 3000).astype(np.uint64))]
    bits = jaccard_join.bitmaps(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
    assert [8 * len(x) for x in bits] == [512, 512, 512, 256, 4096]
    for x, p in zip(sets, bits):
        for y, q in zip(sets, bits):
            assert jaccard_join.differing(p, q) <= len(np.setxor1d(x, y))
    assert jaccard_join.differing(bits[0], bits[1]) > 40


def test_every_near_enough_pair_meets(spark):
    """Over batch ends, as a pair at once or in tiles; salted rows always in tiles."""
    rng = np.random.default_rng(6)
    rows = [(int(t), -1, int(c), int(5 + c % 23)) for t in range(12) for c in rng.choice(1000, 3 * t + 1, replace=False)]
    rows += rows[::7] + [(99, 4, 1, 5), (99, 7, 2, 5)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = jaccard_join.meetings(spark.createDataFrame(rows, "token long, salt int, cid long, n int"), near=3).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pairs = {(r["token"], frozenset((r["cid"], r["other"]))) for r in got if r["other"] is not None}
    tiles = [(r["token"], r["cid"]) for r in got if r["other"] is None]
    assert len(pairs) == sum(r["other"] is not None for r in got) and len(tiles) == len(set(tiles))
    assert {(99, 1), (99, 2)} <= set(tiles)
    lists = {}
    for t, salt, c, n in set(rows):
        lists.setdefault(t, []).append((c, n))
    for t, members in lists.items():
        for c, n in members:
            for d, m in members:
                if c < d and 5 * min(n, m) >= 4 * max(n, m):
                    assert (t, frozenset((c, d))) in pairs or {(t, c), (t, d)} <= set(tiles)
                elif c < d:
                    assert (t, frozenset((c, d))) not in pairs


def test_jaccard_odd_rows(odd, empty):
    got = jaccard_join.near_duplicates(odd).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] in (1, 2, 3, 4, 5, 6)) == [
        (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (4, 1, 4), (5, 2, 5), (6, 2, 5)]
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    assert jaccard_join.near_duplicates(empty).count() == 0


def test_one_of_each_keeps_one(odd):
    kept = jaccard_join.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect()) == sorted((i is None, i) for i in (1, 2, 3, 4, 5, 7, 8, None))


def test_one_of_each_decides_rows_that_share_an_id_by_their_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(3, a), (7, f"{a} more"), (7, b), (9, f"{b} more"),  # one row of 7 goes with 3, the other leads its own
            (2, c), (2, f"{c} more"), (4, c), (4, ""), (4, ""), (4, None)]  # near copies that share the smallest id
    kept = jaccard_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((r["doc_id"], r["text"] is None, (r["text"] or "")[:2]) for r in kept)
    assert got == [(2, False, "c0"), (3, False, "a0"), (4, False, ""), (4, True, ""), (7, False, "b0")]


# ---- embeddings ----------------------------------------------------------------------------------
def brute_vectors(rows, least=embed_lsh.LEAST):
    ok = [i for i, (_, v, label) in enumerate(rows) if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = {i: np.array(rows[i][1], float) / np.abs(rows[i][1]).max() for i in ok}
    x = {i: v / np.linalg.norm(v) for i, v in x.items()}
    links = [(i, j) for i in ok for j in ok if j < i and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]) and x[i] @ x[j] >= least]
    n = np.bincount([k for p in links for k in p], minlength=len(rows)) if links else np.zeros(len(rows), int)
    return n.tolist(), smallest(len(rows), links, [r[0] for r in rows])


@pytest.mark.parametrize("tile", [embed_lsh.TILE, 16])
def test_vectors_equal_brute_force(spark, tile):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(6, 24))
    rows = [(i, (base[i % 6] + 0.02 * (i % 9) * rng.normal(size=24)).tolist(), i % 2) for i in range(150)]
    rows += [(200 + i, base[0].tolist(), 0) for i in range(60)]  # equal vectors
    rows += [(300, None, 0), (301, [0.0] * 24, 0), (302, [float("nan")] + [1.0] * 23, 0), (303, [None, 1.0], 0), (304, base[0].tolist(), None),
             (305, [1.0], 0), (306, [2.0], 0), (307, [], 0), (308, (1e200 * base[0]).tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = embed_lsh.near_duplicates(df, tile=tile).orderBy("vec_id").collect()
    n, comp = brute_vectors(rows)
    close = [i for i, r in enumerate(got) if r["n_links"] == n[i]]
    assert len(close) >= 0.97 * len(rows) and all(r["n_links"] <= n[i] for i, r in enumerate(got))
    assert [r["component_id"] for r in got] == comp
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_recall_at_the_threshold():
    """Pairs at cosine 0.93 exactly share a bucket in at least 0.9 of the cases."""
    rng = np.random.default_rng(4)
    a = embed_lsh.unit(rng.normal(size=(3000, 64)))
    o = rng.normal(size=a.shape)
    o = embed_lsh.unit(o - (o * a).sum(1, keepdims=True) * a)
    b = 0.93 * a + np.sqrt(1 - 0.93 ** 2) * o
    met = (embed_lsh.bucket_keys(a) == embed_lsh.bucket_keys(b)).any(axis=1)
    assert met.mean() >= 0.93


def test_embeddings_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], list(r["embedding"]), r["label"]) for r in df.orderBy("vec_id").collect()]
    got = embed_lsh.near_duplicates(df).orderBy("vec_id").collect()
    n, comp = brute_vectors(rows)
    assert sum(r["n_links"] for r in got) >= 0.9 * sum(n) and len(got) == len(rows)
    assert embed_lsh.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1 << 18, 20])
def test_component_labels_in_one_and_in_many_tasks(spark, size):
    from routewise.llm.common import component_labels

    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1080)] + [(5, 5), (None, 1)]
    names = sorted({x for a, b in pairs if a is not None and a != b for x in (a, b)})
    at = {x: i for i, x in enumerate(names)}
    want = smallest(len(names), [(at[a], at[b]) for a, b in pairs if a is not None and a != b], names)
    got = {r["id"]: r["label"] for r in component_labels(spark.createDataFrame(pairs, "a long, b long").repartition(4), task_edges=size).collect()}
    assert got == dict(zip(names, want))
