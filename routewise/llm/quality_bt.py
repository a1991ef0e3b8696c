"""Quality scores learnt from preference pairs (Bradley-Terry).

A document is a vector of byte-level features: shares of byte classes, word and
line shapes, repetition.  Labelled documents give preference pairs (good over bad);
the weights minimise the logistic loss of the pairs' feature differences.  The score
is the logistic of the strength relative to a threshold, which is the quantile of the
training documents' strengths at their share of bad labels; it maps to THRESHOLD, so
predicted = score >= THRESHOLD cuts at that quantile.

The fit takes all labelled documents of the learning folds: means and deviations are
aggregations, the threshold is an exact quantile, and each document of the more frequent
label is paired with PARTNERS of the other, which take turns.  Documents meet in bounded
groups by a hash of the id; the Newton steps are sums over the groups, so the driver
holds a gradient and a matrix of features by features.  Scoring covers every document whole, in vectorised passes over Arrow buffers, without
a shuffle.

Defined cases: a null or empty text has the zero feature vector (its score follows from
the weights); repeated ids get a row each; labels that are null or without a document
are not used; without labels of both kinds every score is THRESHOLD; other columns are
ignored; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routewise.llm import textblocks as tb
from routewise.llm.common import SMALL_BATCH_BYTES, bitmap_place, held_out, id_bitmap, in_bitmap, prepare, releasing, stored
from routewise.operators.clustering import exact_quantile

THRESHOLD = 0.7
PARTNERS = 20
#: Documents of a group, about, and of the rarer label in it at least, on average.
GROUP = 4096
RARE = 64

_CLASS = np.full(256, 0)          # letters a-z
_CLASS[65:91] = 1                 # A-Z
_CLASS[48:58] = 2                 # digits
_CLASS[[9, 11, 12, 13, 32]] = 3   # spaces
_CLASS[10] = 4                    # line feeds
_CLASS[[44, 46, 59, 58, 39]] = 5  # , . ; : '
_CLASS[[33, 63]] = 6              # ! ?
_CLASS[[40, 41, 45, 34, 47]] = 7  # ( ) - " /
_CLASS[128:] = 8                  # non-ASCII
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum() and c not in (44, 46, 59, 58, 39, 33, 63, 40, 41, 45, 34, 47)]] = 9
_CLASS[:9] = _CLASS[14:32] = _CLASS[127] = 10
N_CLASSES = 11
CLASS = _CLASS.astype(np.uint8)
NAMES = [f"class_{i}" for i in range(N_CLASSES)] + [
    "word_length", "log_words", "words_per_line", "distinct_words", "repeated_lines", "longest_run", "symbol_ends", "capital_words", "short_words"]


def features(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One feature row for each text of the buffer."""
    n = len(offs) - 1
    out = np.zeros((n, len(NAMES)))
    size = np.diff(offs)
    kind = CLASS[buf]
    row = np.repeat(np.arange(n), size)
    counts = np.bincount(row * N_CLASSES + kind, minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    out[:, :N_CLASSES] = counts / np.maximum(size, 1)[:, None]
    h, starts, ends, row_word = tb.word_hashes(buf, offs, tb.NOT_SPACE)
    words = np.diff(row_word)
    some = np.maximum(words, 1)
    wrow = np.repeat(np.arange(n), words)
    length = ends - starts
    per_row = lambda x: np.bincount(wrow, x, minlength=n)
    out[:, N_CLASSES] = per_row(length) / some / 10
    out[:, N_CLASSES + 1] = np.log1p(words) / 10
    line = np.concatenate([[0], np.cumsum(buf == 10)])
    lines = line[offs[1:]] - line[offs[:-1]] + 1
    out[:, N_CLASSES + 2] = np.log1p(words / lines) / 5
    # share of distinct words, less what length alone explains (Heaps' law)
    order = np.lexsort((h, wrow))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (wrow[order][1:] != wrow[order][:-1])
    out[:, N_CLASSES + 3] = np.bincount(wrow[order], new, minlength=n) / some ** 0.8 / 2
    # share of lines that repeat an earlier one of the text
    ls, le, row_line = tb.word_spans(buf, offs, np.arange(256) != 10)
    lh, lrow = tb.span_hash(tb.prefix_hash(buf), ls, le), np.repeat(np.arange(n), np.diff(row_line))
    order = np.lexsort((lh, lrow))
    same = np.zeros(len(lh), bool)
    same[1:] = (lh[order][1:] == lh[order][:-1]) & (lrow[order][1:] == lrow[order][:-1])
    out[:, N_CLASSES + 4] = np.bincount(lrow[order], same, minlength=n) / np.maximum(np.diff(row_line), 1)
    if len(h):
        longest = np.zeros(n)
        np.maximum.at(longest, wrow, length)
        out[:, N_CLASSES + 5] = np.log1p(longest) / 5
        first, last = kind[starts], kind[ends - 1]
        out[:, N_CLASSES + 6] = per_row((last == 9) | (first == 9)) / some
        out[:, N_CLASSES + 7] = per_row((first == 1) & ((last == 1) | (last == 6)) & (length > 1)) / some
        out[:, N_CLASSES + 8] = per_row(length <= 2) / some
    return out


def featurize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", among: np.ndarray | None = None) -> DataFrame:
    """(doc_id, x array<double>) of every document; with a bitmap (common.id_bitmap), of
    those whose ids it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if among is not None:
                b = b.filter(pa.array(in_bitmap(b.column(2), among)))
            for lo, hi, buf, offs in tb.row_chunks(b.column(1), tb.SMALL_CHUNK_BYTES):
                x = features(buf, offs)
                cut = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(cut, pa.array(x.ravel()))], names=["doc_id", "x"])

    place = [] if among is None else [bitmap_place(id_col, among).alias("at")]
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *place)
            .mapInArrow(releasing(run), "doc_id long, x array<double>"))


def pair_sums(good: np.ndarray, bad: np.ndarray, w: np.ndarray, partners: int) -> np.ndarray:
    """Gradient, Hessian and number of the logistic losses of a group's pairs, as one row."""
    many, few, sign = (good, bad, 1) if len(good) >= len(bad) else (bad, good, -1)
    m, out = len(w), np.zeros(len(w) * (len(w) + 1) + 1)
    if not len(few):
        return out
    for lo in range(0, len(many), GROUP):
        at = np.arange(lo, min(lo + GROUP, len(many)))
        # partners take turns, so that each of the few is in pairs
        pick = (at[:, None] * partners + np.arange(partners)) % len(few)
        d = sign * (many[at, None, :] - few[pick]).reshape(-1, m)
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))       # chance of the wrong order
        out += np.concatenate([-d.T @ p, ((d * (p * (1 - p))[:, None]).T @ d).ravel(), [len(d)]])
    return out


def fit_pairs(groups: DataFrame, mean: np.ndarray, sd: np.ndarray, partners: int = PARTNERS, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights of least mean logistic loss over good-minus-bad differences in the groups
    (good binary, bad binary), by Newton steps."""
    m = len(mean)
    w = np.zeros(m)
    for _ in range(steps):
        def run(batches: Iterator[pa.RecordBatch], w=w) -> Iterator[pa.RecordBatch]:
            total = np.zeros(m * (m + 1) + 1)
            for b in batches:
                for good, bad in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    total += pair_sums(*(np.clip((np.frombuffer(x).reshape(-1, m) - mean) / sd, -8, 8) for x in (good, bad)), w, partners)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["at", "v"])

        got = groups.select("good", "bad").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").toArrow()
        v = got.column("v").to_numpy()
        grad = ridge * w + v[:m] / max(v[-1], 1)
        hess = v[m:-1].reshape(m, m) / max(v[-1], 1) + ridge * np.eye(m)
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def grouped(rows: DataFrame, n: int, good: int, size: int = GROUP, rare: int = RARE) -> DataFrame:
    """(good binary, bad binary): the feature rows (doc_id, y, x) in groups of about size.
    Where the rarer label is too rare for so many, its rows go to several groups."""
    few = min(good, n - good)
    deals = max(1, min(-(-n // size), few // rare))
    copies = max(1, -(-n // (size * deals)))
    h = F.xxhash64("doc_id")
    is_few = F.col("y") == (1 if few == good else 0)
    part = F.when(is_few, F.sequence(F.lit(0), F.lit(copies - 1))).otherwise(F.array(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(copies)).cast("int")))
    dealt = rows.select("y", "x", h.alias("h"), F.pmod(h, F.lit(deals)).cast("int").alias("deal"), F.explode(part).alias("part")).repartition(min(deals * copies, 4096), "deal", "part")

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("h")
        y = t.column("y").to_numpy()
        x = np.array(t.column("x").to_pylist(), float)
        return pa.table({"good": pa.array([x[y == 1].tobytes()], pa.binary()), "bad": pa.array([x[y == 0].tobytes()], pa.binary())})

    return dealt.groupBy("deal", "part").applyInArrow(pack, "good binary, bad binary")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> dict:
    """Model from all labelled documents of the learning folds."""
    prepare(docs.sparkSession, SMALL_BATCH_BYTES)
    picked = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
              .groupBy("doc_id").agg(F.max("y").alias("y")))
    # texts are filtered and read where they lie, by one Python worker a task; only features are shuffled
    chosen = featurize(docs.where(~held_out()).select("doc_id", "text"), among=id_bitmap(picked.select("doc_id")))
    rows = stored(chosen.join(picked, "doc_id").groupBy("doc_id", "y").agg(F.min("x").alias("x")), "quality-features")
    dims = range(len(NAMES))
    of = rows.agg(F.count("*").alias("n"), F.sum("y").alias("good"), *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in dims], *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in dims]).first()
    n, good = of["n"], of["good"] or 0
    if not 0 < good < n:
        return {"mean": [0.0] * len(NAMES), "w": [0.0] * len(NAMES), "cut": 0.0, "scale": 1.0}
    mean, sd = np.array([of[f"m{i}"] for i in dims]), np.array([of[f"s{i}"] for i in dims]) + 1e-6
    w = fit_pairs(stored(grouped(rows, n, good), "quality-groups"), mean, sd)
    model = {"mean": mean.tolist(), "sd": sd.tolist(), "w": w.tolist()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0).flatten().to_numpy().reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([pa.array(strength(x, model))], names=["s"])

    s = stored(rows.select("x").mapInArrow(run, "s double"), "quality-strengths")
    spread = s.agg(F.stddev_pop("s")).first()[0]
    return {**model, "cut": exact_quantile(s, "s", 1 - good / n), "scale": float(spread / 4 + 1e-9)}


def strength(x: np.ndarray, model: dict) -> np.ndarray:
    z = np.clip((x - np.array(model["mean"])) / np.array(model.get("sd", [1.0] * x.shape[1])), -8, 8)
    return z @ np.array(model["w"])


def to_score(s: np.ndarray, model: dict) -> np.ndarray:
    """0 to 1, THRESHOLD at the cut."""
    return 1 / (1 + np.exp(-np.clip((s - model["cut"]) / model["scale"] + np.log(THRESHOLD / (1 - THRESHOLD)), -700, 700)))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    prepare(docs.sparkSession, SMALL_BATCH_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offs in tb.row_chunks(b.column(1), tb.SMALL_CHUNK_BYTES):
                s = strength(features(buf, offs), model)
                p = to_score(s, model)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(p), pa.array((s >= model["cut"]).astype(np.int32))], names=["doc_id", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(releasing(run), "doc_id long, score double, predicted int")
    # at the cut itself, rounding must not take the score below the threshold
    s = F.when(F.col("predicted") == 1, F.greatest("score", F.lit(THRESHOLD))).otherwise(F.least("score", F.lit(float(np.nextafter(THRESHOLD, 0)))))
    return rows.select("doc_id", held_out().alias("held_out"), s.alias("score"), "predicted")


def accepted(docs: DataFrame, model: dict) -> DataFrame:
    """The documents at or above the threshold, with all their columns."""
    prepare(docs.sparkSession, SMALL_BATCH_BYTES)

    @F.arrow_udf("boolean")
    def good(text: pa.Array) -> pa.Array:
        parts = [strength(features(buf, offs), model) >= model["cut"] for _, _, buf, offs in tb.row_chunks(text, tb.SMALL_CHUNK_BYTES)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0, bool))

    return docs.where(good(F.col("text").cast("string")))
