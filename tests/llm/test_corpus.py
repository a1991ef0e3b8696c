"""Decontamination (6), mixing (10) and the pipeline."""

import tracemalloc
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from routewise.llm import decontam_sw, pfair_mix
from routewise.llm.queries import REST_WEIGHT, WEIGHTS
from tests.llm.conftest import SF


def smith_waterman(a, b):
    h, best, end = np.zeros((len(a) + 1, len(b) + 1), int), 0, 0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (1 if x == y else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
            if h[i, j] > best:
                best, end = h[i, j], j
    return best, end


def test_alignment_equals_textbook():
    rng = np.random.default_rng(0)
    items = [rng.integers(0, 4, rng.integers(1, 12)).astype(np.uint64) for _ in range(60)]
    windows = [rng.integers(0, 4, rng.integers(1, 30)).astype(np.uint64) for _ in range(60)]
    best, end = decontam_sw._align_in_batches(items, windows)
    for k in range(60):
        want = smith_waterman(items[k], windows[k])
        assert best[k] == want[0] and (want[0] == 0 or end[k] == want[1])


ITEM = "The quick brown fox jumps over the lazy dog while seven wizards brew green potions beneath an old stone bridge at midnight"


@pytest.fixture(scope="module")
def bench(spark):
    other = " ".join(f"b{i}" for i in range(30))
    return spark.createDataFrame([(1, ITEM), (2, other), (3, None), (4, ""), (5, "..."), (6, "zyx"), (7, "uno dos"), (1, ITEM)], "item_id long, text string")


def test_copies_and_edits_are_found_and_clean_texts_left(spark, bench):
    w = ITEM.split()
    filler = " ".join(f"f{i}" for i in range(80))
    edited = [x if i % 6 != 4 else "changed" for i, x in enumerate(w)]
    gapped = w[:7] + ["inserted", "words"] + w[7:13] + w[14:]
    docs = [(1, f"{filler} {ITEM} {filler}"), (2, f"{filler}\n{' '.join(edited).upper()}!! {filler}"), (3, " ".join(gapped)), (4, filler),
            (5, " ".join(w[:5]) + " " + filler), (6, "zyx"), (7, "and UNO, dos!"), (8, None), (9, ""), (10, " ".join(reversed(w)))]
    # the item in most of the corpus: its seeds are frequent, and still found
    docs += [(100 + i, f"{ITEM} tail{i}") for i in range(60)]
    got = decontam_sw.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    by = {(r["doc_id"], r["item_id"]): r for r in got}
    assert {d for d, _ in by} == {1, 2, 3, 6, 7} | {100 + i for i in range(60)}
    assert by[1, 1]["score"] == 1 and docs[0][1][by[1, 1]["start"]:by[1, 1]["end"]] == ITEM
    assert 0.5 <= by[2, 1]["score"] < 1 and 0.5 <= by[3, 1]["score"] < 1
    kept = decontam_sw.without_leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [4, 5, 8, 9, 10]


@pytest.mark.parametrize("n, copies", [(20, 0), (36, 0), (57, 0), (36, 3000)])
def test_edits_are_found_alone_and_beside_copies(spark, n, copies):
    """Every fifth word edited: most 3-grams occur nowhere, or only in exact copies."""
    w = [f"w{i}" for i in range(n)]
    bench = spark.createDataFrame([(1, " ".join(w))], "item_id long, text string")
    edited = [f"e{i}" if i % 5 == 4 else x for i, x in enumerate(w)]
    filler = " ".join(f"f{i}" for i in range(80))
    rows = [(1, f"{filler} {' '.join(edited)} {filler}"), (2, filler), (3, f"{' '.join(w[:4])} {filler}")] + [(10 + i, " ".join(w)) for i in range(copies)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in decontam_sw.find_leaks(docs, bench).collect()}
    assert set(got) == {1} | {10 + i for i in range(copies)}
    assert got[1] == smith_waterman(w, edited)[0] / n
    assert sorted(r["doc_id"] for r in decontam_sw.without_leaks(docs, bench).collect()) == [2, 3]


def test_no_window_is_lost_before_alignment():
    """Few words, so that seeds are frequent: every pair that shares a seed and scores at
    least so much is found, with that score."""
    rng = np.random.default_rng(1)
    items = [" ".join(rng.choice(list("abcdefgh"), rng.integers(3, 24))) for _ in range(30)]
    docs = []
    for k in range(120):
        w = items[k % 30].split()
        for _ in range(rng.integers(0, len(w) // 2 + 1)):
            at = rng.integers(0, len(w) + 1)
            w[at:at + rng.integers(0, 2)] = list(rng.choice(list("abcxyz"), rng.integers(0, 2)))
        docs.append(" ".join(list(rng.choice(list("abcxyz"), rng.integers(0, 40))) + w + list(rng.choice(list("abcxyz"), rng.integers(0, 40)))))
    buf, offs = decontam_sw.tb.string_buffer(decontam_sw.pa.array(docs))
    seeds = lambda w: {tuple(w[i:i + 3]) for i in range(len(w) - 2)}
    idx = decontam_sw.index([{"item_id": i, "text": x} for i, x in enumerate(items)])
    for least in (0.5, 0.7, 0.4):
        want = {}
        for d, x in enumerate(docs):
            for i, y in enumerate(items):
                score = smith_waterman(y.split(), x.split())[0] / len(y.split())
                if score >= least and seeds(x.split()) & seeds(y.split()):
                    want[d, i] = score
        row, item, score, _, _ = decontam_sw.leaks_of(buf, offs, idx, least)
        got = {(r, idx["ids"][i]): s for r, i, s in zip(row.tolist(), item.tolist(), score.tolist())}
        # short items can score by words that hold no seed, beside a seed elsewhere
        far = {k for k in want if k not in got and len(items[k[1]].split()) > 6}
        assert not far and got.items() <= want.items()


def test_leaks_equal_full_search(spark, documents):
    """Every document against every item by plain alignment, on texts that hold an
    item's words at all."""
    import re
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    words = lambda t: [x.lower() for x in re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", t or "")]
    items = [(r["item_id"], words(r["text"])) for r in bench.collect()]
    docs = documents.limit(60).collect()
    want = set()
    for d in docs:
        dw = words(d["text"])
        have = set(dw)
        for i, iw in items:
            # a score of half the length needs three quarters of its words matched at least
            if sum(x in have for x in iw) >= 0.5 * len(iw) and len(dw) < 2500 and smith_waterman(iw, dw)[0] >= 0.5 * len(iw):
                want.add((d["doc_id"], i))
    got = {(r["doc_id"], r["item_id"]) for r in decontam_sw.find_leaks(spark.createDataFrame(docs, documents.schema), bench).collect()}
    assert {g for g in got if len(words(next(d["text"] for d in docs if d["doc_id"] == g[0]))) < 2500} == want


def test_item_blocks_are_bounded_and_whole(spark, bench, monkeypatch):
    monkeypatch.setattr(decontam_sw, "BLOCK_BYTES", 100)
    parts = decontam_sw.blocks(bench)
    assert len(parts) > 1 and sum(map(len, parts)) == 6
    docs = spark.createDataFrame([(1, ITEM), (2, "x")], "doc_id long, text string")
    assert {r["doc_id"] for r in decontam_sw.find_leaks(docs, bench).collect()} == {1}


def test_decontam_odd_rows(odd, empty, bench):
    assert decontam_sw.find_leaks(odd, bench).count() == 0
    assert decontam_sw.find_leaks(empty, bench).count() == 0
    assert decontam_sw.find_leaks(odd, bench.limit(0)).count() == 0
    kept = decontam_sw.without_leaks(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count()


# ---- mixing --------------------------------------------------------------------------------------
def simulate(blocks, weights):
    """The stream (source, block) slot by slot, by the windows of the exact weights; each
    prefix of a phase is less than a block from them."""
    done, out = [0] * len(blocks), []
    while active := [i for i, n in enumerate(blocks) if done[i] < n]:
        exact = {i: Fraction(str(weights[i])) for i in active}
        rate = {i: w / sum(exact.values()) for i, w in exact.items()}
        given, t = {i: 0 for i in active}, 0
        while True:
            i = min((-((-(given[i] + 1) / rate[i]) // 1), i) for i in active if (given[i] / rate[i]) // 1 <= t)[1]
            if done[i] == blocks[i]:
                break
            out.append((i, done[i]))
            done[i] += 1
            given[i] += 1
            t += 1
            assert all(abs(given[j] - rate[j] * t) < 1 for j in active)
    return out


@pytest.mark.parametrize("blocks, weights", [([5, 9, 40], [0.5, 0.3, 0.2]), ([1, 1, 1], [1, 1, 1]), ([100, 3], [0.01, 0.99]), ([0, 7, 2], [1, 2, 3]), ([37, 41, 5, 60], [0.55, 0.2, 0.2, 0.05]),
                                             ([400, 300, 500], [1, 1, 1]), ([300, 900], [0.125, 0.875]), ([3, 2500], [0.001, 0.999]), ([900, 300, 150, 150, 20], [0.55, 0.2, 0.1, 0.1, 0.05]), ([60, 60], [0.1234, 0.8766])])
def test_schedule_equals_simulation(blocks, weights):
    """Also with weights that are no whole percents, and after sources have run out."""
    want = simulate(blocks, weights)
    schedule = pfair_mix.phases(blocks, weights)
    got = {}
    for i, n in enumerate(blocks):
        for k, slot in enumerate(pfair_mix.slots(schedule, i, np.arange(n)).tolist()):
            got[slot] = (i, k)
    assert [got[s] for s in range(sum(blocks))] == want


def test_weights_are_exact_or_refused():
    assert pfair_mix.whole_weights([1 / 3, 1 / 3, 1 / 3]) == [1, 1, 1] and pfair_mix.whole_weights([0.1 + 0.2, 0.7]) == [3, 7]
    assert pfair_mix.whole_weights([Fraction(1, 7), Fraction(2, 11)]) == [11, 14]
    for bad in ([1 / 7, 0.123457], [0, 1], [-1, 2]):
        with pytest.raises(ValueError):
            pfair_mix.whole_weights(bad)


def test_mix_is_a_whole_stream(spark):
    rows = [(i, "a" if i % 3 else ("b" if i % 2 else None)) for i in range(500)] + [(7, "a"), (7, "a"), (None, "b")]
    df = spark.createDataFrame(rows, "doc_id long, source string").repartition(4)
    got = pfair_mix.mix(df, {"a": 0.5, "b": 0.25}, 0.25, block_docs=8).select("doc_id", "source", "mix.*").orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(len(rows)))
    by = {s: sorted([i for i, x in rows if x == s], key=lambda i: (i is not None, i)) for s in ("a", "b", None)}
    number = {0: None, 1: "a", 2: "b"}
    want = []
    for s, k in simulate([-(-len(by[number[s]]) // 8) for s in range(3)], [0.25, 0.5, 0.25]):
        want += [(i, number[s]) for i in by[number[s]][8 * k:8 * k + 8]]
    assert [(r["doc_id"], r["source"] if r["source"] else None) for r in got] == want


def test_mix_odd_rows(odd, empty):
    assert pfair_mix.free_name(odd) == "mix_"
    m = pfair_mix.mix(odd, {"z": 1.0}, 1.0, out_col="mix_")
    assert sorted(r["position"] for r in m.select("mix_.position").collect()) == list(range(odd.count()))
    assert {r["mix"] for r in m.collect()} == {"z"}  # a column of the documents' own
    assert pfair_mix.mix(empty, WEIGHTS, REST_WEIGHT, out_col="mix_").count() == 0
    with pytest.raises(ValueError):
        pfair_mix.mix(odd, {"z": 1.0}, 1.0)
    back = pfair_mix.in_order(pfair_mix.mix(odd.drop("mix"), WEIGHTS, REST_WEIGHT))
    assert back.columns == odd.drop("mix").columns and back.count() == odd.count()
    with pytest.raises(ValueError):
        pfair_mix.mix(odd, {"z": 0.0}, 1.0, out_col="mix_")


# ---- pipeline ------------------------------------------------------------------------------------
def test_pipeline_equals_its_stages_by_hand(spark):
    import zlib

    from tokenizers import Tokenizer

    from routewise.llm import quality_bt
    from routewise.llm.common import stored
    from routewise.llm.queries import tokenizer_path
    from tests.llm.test_near_duplicates import brute

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality_bt.train(docs, labels)
    good = {r["doc_id"] for r in quality_bt.score(docs, model).where("predicted = 1").collect()}
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.orderBy("doc_id").collect() if r["doc_id"] in good]
    comp = brute([(i, t) for i, t, _ in rows])[1]
    rows = [r for r, c in zip(rows, comp) if r[0] == c]
    leaks = {r["doc_id"] for r in decontam_sw.find_leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    rows = [r for r in rows if r[0] not in leaks]
    names = [None, *WEIGHTS]
    by = [[r for r in rows if (r[2] if r[2] in WEIGHTS else None) == s] for s in names]
    have = [k for k in range(len(names)) if by[k]]
    stream = []
    for s, k in simulate([-(-len(by[i]) // pfair_mix.BLOCK_DOCS) for i in have], [[REST_WEIGHT, *WEIGHTS.values()][i] for i in have]):
        stream += by[have[s]][pfair_mix.BLOCK_DOCS * k:pfair_mix.BLOCK_DOCS * (k + 1)]
    tok, at, want = Tokenizer.from_file(tokenizer_path()), 0, []
    for i, text, _ in stream:
        ids = np.array([*tok.encode(text, add_special_tokens=False).ids, 1], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = corpus_pipeline.run(spark, SF).orderBy("start").collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got] == want
    assert stored(docs.limit(3), "x").count() == 3


def test_stages_keep_columns_and_take_odd_rows(spark, odd, empty):
    for df in (odd, empty):
        docs = df.select("doc_id", "text", "lang", "source", F.lit(1).cast("long").alias("n_chars"), F.lit("e").alias("mix"))
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "mix"], name
            assert {r["mix"] for r in docs.collect()} <= {"e"}, name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_texts_are_searched_in_a_few_megabytes():
    rng = np.random.default_rng(5)
    texts = pa.array([" ".join(f"w{x}" for x in rng.integers(0, 5000, 500)) for _ in range(1400)])
    idx = decontam_sw.index([{"item_id": 1, "text": texts[7].as_py()[:400]}])
    assert texts.nbytes > 3 << 20
    tracemalloc.start()
    clean = decontam_sw.clean_rows(texts, idx)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.flatnonzero(~clean).tolist() == [7]
    assert peak < 16 << 20
