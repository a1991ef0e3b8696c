"""Toxic spans and document scores from a linear-chain conditional random field.

Tokens are runs of letters and digits.  Labelled documents give labelled tokens: a
word of the induced lexicon (words and word beginnings frequent in many different
contexts of toxic documents, rare in clean ones) is toxic inside a toxic document; every other token is clean,
lexicon words of clean documents included.  The two-tag chain has a weight for each
lexicon word, for the strength class of the neighbouring words, for tag changes and
for the first tag, fitted by gradient steps on the exact log-likelihood.

Scoring runs forward-backward over every whole text.  The marginals of the toxic tag
give the offending offsets (runs of marginals >= 0.5) and the document's score,
1 - prod(1 - marginal) over tokens of at least FLOOR.

The chains of a batch are scanned together: the 2x2 step matrices of all texts stand
in one array, a text's first step forgets what is before it, and the products run over
blocks, so the work is a few vector operations a token at any mix of text lengths.

The fit takes a bounded sample: max_labelled labelled documents of the learning folds
with the smallest hash of their id, max_lexicon words, and of each document TRAIN_TOKENS
tokens around lexicon words or, where it has none, PLAIN_TOKENS.
Word counts are aggregated in Spark; scoring is one pass without a shuffle.

Defined cases: a null or empty text scores 0; repeated ids get a row each; labels that
are null or without a document are not used; without toxic labels every score is 0;
other columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routewise.llm import textblocks as tb
from routewise.llm.common import held_out, prepare

THRESHOLD = 0.3
MAX_LABELLED = 20_000
MAX_LEXICON = 4096
TRAIN_TOKENS = 48
PLAIN_TOKENS = 8
FLOOR = 0.05
LEAST_ODDS = 2.0
N_CLASSES = 5
MAX_KEYS = 1 << 18
#: Bytes of the word beginnings that the lexicon may hold besides words.
PREFIXES = (4, 5, 6, 7, 8, 9, 10)
BLOCK = 64


# ---- the chain -----------------------------------------------------------------------------------
def _scan(m: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Running row vectors of the products of 2x2 step matrices (m00, m01, m10, m11),
    each scaled to sum 1; the first step must not depend on what is before it."""
    n = len(m[0])
    k = max(1, -(-n // BLOCK))
    eye = (1.0, 0.0, 0.0, 1.0)
    steps = []
    for x, fill in zip(m, eye):
        full = np.full(k * BLOCK, fill)
        full[:n] = x
        steps.append(np.ascontiguousarray(full.reshape(k, BLOCK).T))
    a, b, c, d = (np.full(k, v) for v in eye)
    for s in range(BLOCK):
        m00, m01, m10, m11 = (x[s] for x in steps)
        a, b, c, d = a * m00 + b * m10, a * m01 + b * m11, c * m00 + d * m10, c * m01 + d * m11
        scale = 1 / (a + b + c + d)
        a, b, c, d = a * scale, b * scale, c * scale, d * scale
    u, v = np.empty(k), np.empty(k)
    x, y = 0.5, 0.5
    for i, (p, q, r, t) in enumerate(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist())):
        u[i], v[i] = x, y
        x, y = x * p + y * r, x * q + y * t
        z = x + y
        x, y = x / z, y / z
    out0, out1 = np.empty((BLOCK, k)), np.empty((BLOCK, k))
    for s in range(BLOCK):
        m00, m01, m10, m11 = (x[s] for x in steps)
        u, v = u * m00 + v * m10, u * m01 + v * m11
        scale = 1 / (u + v)
        u, v = u * scale, v * scale
        out0[s], out1[s] = u, v
    return out0.T.ravel()[:n], out1.T.ravel()[:n]


def forward_backward(emit: np.ndarray, begins: np.ndarray, trans: np.ndarray, start: np.ndarray):
    """Marginals of tag 1 and of the four tag pairs (previous, this; 0 at a text's
    first token).  emit: log weight of tag 1 against tag 0; begins: is a first token."""
    n = len(emit)
    if n == 0:
        return np.zeros(0), np.zeros((4, 0))
    low = np.minimum(emit, 0)
    e0, e1 = np.exp(-np.maximum(emit, 0)), np.exp(low)   # scaled so that the larger is 1
    t, s = np.exp(trans), np.exp(start)
    m = [np.where(begins, s[0], t[0, 0]) * e0, np.where(begins, s[1], t[0, 1]) * e1,
         np.where(begins, s[0], t[1, 0]) * e0, np.where(begins, s[1], t[1, 1]) * e1]
    f0, f1 = _scan(m)
    # backward: step i goes from token i to the one before it; a text's last token forgets
    last = np.empty(n, bool)
    last[-1], last[:-1] = True, begins[1:]
    nxt0, nxt1 = np.append(e0[1:], 1.0), np.append(e1[1:], 1.0)
    r = [np.where(last, 1.0, t[0, 0] * nxt0)[::-1], np.where(last, 1.0, t[1, 0] * nxt0)[::-1],
         np.where(last, 1.0, t[0, 1] * nxt1)[::-1], np.where(last, 1.0, t[1, 1] * nxt1)[::-1]]
    b0, b1 = (x[::-1] for x in _scan(r))
    p0, p1 = f0 * b0, f1 * b1
    prev0, prev1 = np.append(0.0, f0[:-1]), np.append(0.0, f1[:-1])
    pair = np.stack([prev0 * t[0, 0] * e0 * b0, prev0 * t[0, 1] * e1 * b1, prev1 * t[1, 0] * e0 * b0, prev1 * t[1, 1] * e1 * b1])
    pair[:, begins] = 0
    total = pair.sum(axis=0)
    return p1 / (p0 + p1), pair / np.where(total > 0, total, 1)


def emissions(ids: np.ndarray, begins: np.ndarray, classes: np.ndarray, model: dict) -> np.ndarray:
    """Log weight of the toxic tag of each token: ids are places in the lexicon, 0 if
    not there; classes the strength class by id."""
    cls = classes[ids]
    left, right = np.append(0, cls[:-1]), np.append(cls[1:], 0)
    left[begins] = 0
    ends = np.append(begins[1:], True) if len(ids) else begins
    right[ends] = 0
    return model["word"][ids] + model["left"][left] + model["right"][right]


def fit(ids: np.ndarray, begins: np.ndarray, y: np.ndarray, classes: np.ndarray, steps: int = 120, ridge: float = 1e-3) -> dict:
    """Weights by sign-adaptive gradient steps on the penalised log-likelihood."""
    sizes = {"word": len(classes), "left": N_CLASSES, "right": N_CLASSES, "trans": 4, "start": 2}
    at = np.cumsum([0, *sizes.values()])
    w, rate, before = np.zeros(at[-1]), np.full(at[-1], 0.3), np.zeros(at[-1])
    cut = lambda v: {k: v[a:b] for k, a, b in zip(sizes, at, at[1:])}
    cls = classes[ids]
    left, right = np.append(0, cls[:-1]), np.append(cls[1:], 0)
    ends = np.append(begins[1:], True)
    left[begins], right[ends] = 0, 0
    pairs = np.where(begins, -1, np.append(0, y[:-1]) * 2 + y)
    inner, firsts = ~begins, begins
    for _ in range(steps):
        p = cut(w)
        m, pair = forward_backward(emissions(ids, begins, classes, p), begins, p["trans"].reshape(2, 2), p["start"])
        gap = y - m
        g = np.concatenate([
            np.bincount(ids, gap, len(classes)), np.bincount(left, gap, N_CLASSES), np.bincount(right, gap, N_CLASSES),
            np.bincount(pairs[inner], minlength=4) - pair[:, inner].sum(axis=1),
            np.array([(1 - y[firsts]).sum() - (1 - m[firsts]).sum(), gap[firsts].sum()])]) / 100 - ridge * w
        rate = np.clip(np.where(g * before > 0, rate * 1.2, np.where(g * before < 0, rate * 0.5, rate)), 1e-5, 1.0)
        w, before = w + np.sign(g) * rate, g
    return cut(w)


# ---- lexicon and training tokens -----------------------------------------------------------------
def keys_of(buf: np.ndarray, offs: np.ndarray):
    """Tokens of a buffer as (hash and token index of the words and of their first k
    bytes for each k of PREFIXES, one array pair a kind), word hashes, starts, ends,
    row_word.  A prefix's hash is salted with its length."""
    starts, ends, row_word = tb.word_spans(buf, offs, tb.ALNUM)
    run = tb.prefix_hash(buf)
    words = tb.span_hash(run, starts, ends)
    kinds = [(words, np.arange(len(words)))]
    for k in PREFIXES:
        long = np.flatnonzero(ends - starts > k)
        kinds.append((tb.span_hash(run, starts[long], starts[long] + k) ^ tb.U64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1), long))
    return kinds, words, starts, ends, row_word


def _toxic_keys(docs: DataFrame) -> DataFrame:
    """(w, ctx): each toxic document's keys, with a hash of the words around the first
    sighting; documents that copy each other give the same rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offs in tb.row_chunks(b.column(1)):
                kinds, h, _, _, row_word = keys_of(buf, offs)
                row = np.repeat(np.arange(hi - lo), np.diff(row_word))
                ctx = np.append(tb.U64(0), h[:-1]) ^ (np.append(h[1:], tb.U64(0)) * tb.U64(3))
                for w, at in kinds:
                    order = np.lexsort((w, row[at]))  # stable: a document's first sighting leads
                    new = np.ones(len(w), bool)
                    new[1:] = (w[order][1:] != w[order][:-1]) | (row[at][order][1:] != row[at][order][:-1])
                    first = order[new]
                    yield pa.RecordBatch.from_arrays([pa.array(w[first].view(np.int64)), pa.array(ctx[at[first]].view(np.int64))], names=["w", "ctx"])

    return docs.where("y = 1").select("doc_id", "text").mapInArrow(run, "w long, ctx long")


def _clean_counts(docs: DataFrame, keys: np.ndarray) -> DataFrame:
    """(w, c): clean documents that hold a key, summed within each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(keys), np.int64)
        for b in batches:
            for lo, hi, buf, offs in tb.row_chunks(b.column(1)):
                kinds, _, _, _, row_word = keys_of(buf, offs)
                row = np.repeat(np.arange(hi - lo), np.diff(row_word))
                for w, at in kinds:
                    place = tb.find(w, keys)
                    some = np.flatnonzero(place)
                    total += np.bincount(np.unique(row[at[some]] * len(keys) + place[some] - 1) % len(keys), minlength=len(keys))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(total[some])], names=["w", "c"])

    return docs.where("y = 0").select("doc_id", "text").mapInArrow(run, "w long, c long")


def lexicon(docs: DataFrame, max_lexicon: int) -> list:
    """(key, lower bound of the log odds) of the words and word beginnings that mark
    toxic documents: seen in at least 5 different contexts of toxic documents (copies
    share their contexts and count once), and there over-represented.  At most
    max_lexicon, out of the MAX_KEYS most frequent in toxic documents."""
    n = {r["y"]: r["n"] for r in docs.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n.get(1):
        return []
    clean, toxic = n.get(0, 0) + 1.0, n[1] + 1.0
    # contexts first, so that a word of a third of all documents is combined before the shuffle
    seen = (_toxic_keys(docs).distinct().groupBy("w").agg(F.count("*").alias("t")).where("t >= 5")
            .orderBy(F.desc("t"), "w").limit(MAX_KEYS).checkpoint())
    keys = np.sort(seen.select("w").toArrow().column(0).to_numpy().view(np.uint64))
    if len(keys) == 0:
        return []
    per = seen.join(_clean_counts(docs, keys).groupBy("w").agg(F.sum("c").alias("c")), "w", "left").fillna(0, ["c"])
    t, c = F.col("t") + 0.5, F.col("c") + 0.5
    # two standard errors below the estimate, so that a few chance sightings don't count
    odds = F.log(t / F.lit(toxic)) - F.log(c / F.lit(clean)) - 2 * F.sqrt(1 / t + 1 / c)
    return per.select("w", odds.alias("o")).where(F.col("o") > LEAST_ODDS).orderBy(F.desc("o"), "w").limit(max_lexicon).collect()


def lookup(buf: np.ndarray, offs: np.ndarray, keys: np.ndarray, odds: np.ndarray):
    """Each token's place in the lexicon: that of the strongest of its keys, 0 for
    none; row_word, starts, ends."""
    kinds, words, starts, ends, row_word = keys_of(buf, offs)
    ids = np.zeros(len(words), np.int64)
    for h, at in kinds:
        place = tb.find(h, keys)
        some = np.flatnonzero(place)
        tok, new = at[some], place[some]
        ids[tok] = np.where(odds[new] > odds[ids[tok]], new, ids[tok])
    return ids, row_word, starts, ends


def _sequences(docs: DataFrame, keys: np.ndarray, odds: np.ndarray) -> DataFrame:
    """(doc_id, y, ids): tokens of each document as lexicon places: TRAIN_TOKENS of
    those around lexicon words, or PLAIN_TOKENS where there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offs in tb.row_chunks(b.column(1)):
                ids, row_word = lookup(buf, offs, keys, odds)[:2]
                out = []
                for a, z in zip(row_word[:-1], row_word[1:]):
                    x = ids[a:z]
                    near = np.convolve(x > 0, np.ones(9), "same") > 0 if len(x) >= 9 else np.ones(len(x), bool)
                    out.append((x[near][:TRAIN_TOKENS] if (x > 0).any() else x[:PLAIN_TOKENS]).tolist())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "y", "ids"])

    return docs.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y int, ids array<int>")


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_lexicon: int = MAX_LEXICON) -> dict:
    prepare(docs.sparkSession)
    picked = (labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
              .groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))
    # bounded by max_labelled rows of two numbers
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "y").checkpoint()
    words = sorted((int(np.int64(r["w"]).view(np.uint64)), float(r["o"])) for r in lexicon(sample, max_lexicon))
    keys = np.array([w for w, _ in words], np.uint64)
    odds = np.array([0.0] + [o for _, o in words])
    classes = np.minimum(np.ceil(odds), N_CLASSES - 1).astype(np.int64)
    empty = {"word": np.full(len(odds), -50.0), "left": np.zeros(N_CLASSES), "right": np.zeros(N_CLASSES), "trans": np.zeros(4), "start": np.zeros(2), "doc": np.zeros(4)}
    if len(keys) == 0:
        return {"keys": keys, "odds": odds, "classes": classes, **empty}
    rows = sorted(_sequences(sample, keys, odds).collect(), key=lambda r: (r["doc_id"], r["ids"]))
    ids = np.array([i for r in rows for i in r["ids"]], np.int64)
    n = np.array([len(r["ids"]) for r in rows])
    toxic = np.repeat([r["y"] for r in rows], n)
    begins = np.zeros(len(ids), bool)
    begins[(np.cumsum(n) - n)[n > 0]] = True
    y = ((ids > 0) & (toxic == 1)).astype(np.int64)
    model = {"keys": keys, "odds": odds, "classes": classes, **fit(ids, begins, y, classes)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offs in tb.row_chunks(b.column(1)):
                x = marginals(buf, offs, model)[0]
                yield pa.RecordBatch.from_arrays([b.column(2).slice(lo, hi - lo), *(pa.array(c) for c in x.T)], names=["y", "a", "b", "c"])

    # bounded by max_labelled rows of four numbers
    got = np.array(sorted(tuple(r) for r in sample.mapInArrow(run, "y int, a double, b double, c double").collect()), float)
    return {**model, "doc": fit_documents(got[:, 1:], got[:, 0])}


def fit_documents(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Logistic weights, the intercept last."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
    return w


def marginals(buf: np.ndarray, offs: np.ndarray, model: dict):
    """Document features, marginal of each token, its row, begins, starts, ends."""
    n = len(offs) - 1
    ids, row_word, starts, ends = lookup(buf, offs, model["keys"], model["odds"])
    begins = np.zeros(len(ids), bool)
    begins[row_word[:-1][np.diff(row_word) > 0]] = True
    row = np.repeat(np.arange(n), np.diff(row_word))
    m, _ = forward_backward(emissions(ids, begins, model["classes"], model), begins, model["trans"].reshape(2, 2), model["start"])
    keep = np.flatnonzero(m >= FLOOR)
    some = np.abs(np.expm1(np.bincount(row[keep], np.log1p(-np.minimum(m[keep], 1 - 1e-12)), minlength=n)))
    number = np.bincount(row[keep], m[keep], minlength=n)
    share = 1000 * number / np.maximum(np.diff(row_word), 1)
    return np.column_stack([some, np.log1p(number), np.log1p(share)]), m, row, begins, starts, ends


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score, predicted, n_spans, spans (start:end in code points,
    comma-joined) of every document."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offs in tb.row_chunks(b.column(1)):
                n = hi - lo
                x, m, row, begins, starts, ends = marginals(buf, offs, model)
                p = np.where(x[:, 0] > 0, 1 / (1 + np.exp(-np.clip(np.column_stack([x, np.ones(n)]) @ model["doc"], -500, 500))), 0.0)
                hit = np.flatnonzero(m >= 0.5)
                spans, count = [""] * n, np.zeros(n, np.int64)
                if len(hit):
                    new = np.ones(len(hit), bool)
                    new[1:] = (hit[1:] != hit[:-1] + 1) | begins[hit[1:]]
                    first, last = hit[new], hit[np.append(np.flatnonzero(new)[1:] - 1, len(hit) - 1)]
                    s, e = tb.char_index(buf, offs, starts[first], row[first]), tb.char_index(buf, offs, ends[last], row[first])
                    count = np.bincount(row[first], minlength=n)
                    for i, x, z in zip(row[first].tolist(), s.tolist(), e.tolist()):
                        spans[i] += f"{',' if spans[i] else ''}{x}:{z}"
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, n), pa.array(p), pa.array(count), pa.array(spans, pa.string())], names=["doc_id", "score", "n_spans", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, n_spans long, spans string")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_spans", "spans")
