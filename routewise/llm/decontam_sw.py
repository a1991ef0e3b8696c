"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Benchmark items are the query set; all documents are searched.  Words are runs of
letters and digits, ASCII-lower-cased.  An item's seeds are all its SEED-word n-grams,
however frequent they are and whichever of them an edit has left.  A seed found in a
document gives a window around the place where the item would lie, if the item's words
there and the seeds around can make up the least score (a bound that loses no alignment,
see _promising); overlapping windows of an item merge.  Item and
window words are aligned locally (match +1, mismatch -1, gap -1); the score is the
best alignment's divided by the item's length.  Documents with a score of at least
LEAST are reported with the aligned span.

Items go to the tasks in blocks of about BLOCK_BYTES of text, one pass over the
documents for each block, so what a task holds is bounded whatever the benchmark's
size.  Nothing is shuffled.  Alignments of a batch run together, one numpy row step for
all windows.

Defined cases: items and documents that are null, empty or without words match
nothing; items shorter than SEED words are their own seed; a document with no SEED
unbroken words of an item does not match it; repeated items and
documents each get their rows; other columns are ignored, whatever their names; empty
tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routewise.llm import textblocks as tb
from routewise.llm.common import SMALL_BATCH_BYTES, prepare, releasing, union_all

SEED = 3
LEAST = 0.5
BLOCK_BYTES = 4 << 20
#: Hits, and words of windows, that are looked at together.
CELLS = 1 << 20
SCHEMA = "doc_id long, item_id long, score double, start long, end long"


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> list[list]:
    """Items in lists of about BLOCK_BYTES of text, dealt by a hash of the item."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("length(text) > 0")
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    k = max(1, -(-size // BLOCK_BYTES))
    if n == 0:
        return []
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(k)) == i).collect() for i in range(k)]


def index(items: list) -> dict:
    """Word hashes of the items, and their n-grams as sorted distinct keys with the
    (item, position) pairs of each key."""
    items = sorted(items, key=lambda r: (r["item_id"] is None, r["item_id"], r["text"]))
    buf, offs = tb.string_buffer(pa.array([r["text"] for r in items], pa.string()))
    words, _, _, row_word = tb.word_hashes(buf, offs, tb.ALNUM)
    n = np.diff(row_word)
    grams, item, pos = [], [], []
    for size in range(1, SEED + 1):
        h, row, at = tb.ngram_hashes(words, row_word, size)
        keep = (n[row] == size) | ((size == SEED) & (n[row] > size))
        grams.append(h[keep])
        item.append(row[keep])
        pos.append(at[keep] - row_word[row[keep]])
    h, item, pos = (np.concatenate(x) for x in (grams, item, pos))
    keys, inv = np.unique(h, return_inverse=True)
    order = np.argsort(inv, kind="stable")
    # the words of each item, as item * (words + 1) + place in vocab, and how often
    vocab = np.unique(words)
    item_word, times = np.unique(np.repeat(np.arange(len(items)), n) * (len(vocab) + 1) + tb.find(words, vocab), return_counts=True)
    return {"vocab": vocab, "item_word": item_word, "times": times, "ids": [r["item_id"] for r in items], "words": words, "begin": row_word, "keys": keys, "item": item[order], "pos": pos[order],
            "at": np.searchsorted(inv[order], np.arange(len(keys) + 1)), "sizes": [k for k in range(1, SEED + 1) if len(grams[k - 1])]}


def _hits(words, row_word, idx):
    """(place of the key, row, word index) of the items' n-grams among the documents'."""
    out = []
    for size in idx["sizes"]:
        h, row, at = tb.ngram_hashes(words, row_word, size)
        place = tb.find(h, idx["keys"])
        some = np.flatnonzero(place)
        out.append((place[some] - 1, row[some], at[some]))
    return tuple(np.concatenate(x) for x in zip(*out))


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each (item, window) pair and the window word it
    ends before.  Pairs are padded to common lengths; pads match nothing."""
    n, li, lw = len(items), max(map(len, items)), max(map(len, windows))
    a, b = np.zeros((n, li), np.uint64), np.ones((n, lw), np.uint64)
    for k, (x, y) in enumerate(zip(items, windows)):
        a[k, :len(x)], b[k, :len(y)] = x, y
    real = np.arange(lw)[None, :] < np.array([len(w) for w in windows])[:, None]
    ramp = np.arange(lw, dtype=np.int32)
    h = np.zeros((n, lw + 1), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    rows = np.arange(n)
    for i in range(li):
        inside = np.array([i < len(x) for x in items])[:, None]
        s = np.where((a[:, i:i + 1] == b) & real & inside, 1, -1).astype(np.int32)
        t = np.maximum(np.maximum(h[:, :-1] + s, h[:, 1:] - 1), 0)
        # a gap in the item: the best of what is to the left, less its distance
        t = np.maximum.accumulate(t + ramp, axis=1) - ramp
        h[:, 1:] = t
        at = t.argmax(axis=1)
        top = t[rows, at]
        better = top > best
        best[better], end[better] = top[better], at[better] + 1
    return best, end


def _align_in_batches(items, windows, cells: int = 1 << 20):
    """align() over pairs of like lengths, with bounded cells a batch."""
    order = sorted(range(len(items)), key=lambda k: (len(windows[k]), len(items[k])))
    best, end = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi + 1 - lo) * len(windows[order[hi]]) <= cells // 8 and len(windows[order[hi]]) <= 2 * len(windows[order[lo]]) + 16:
            hi += 1
        part = order[lo:hi]
        best[part], end[part] = align([items[k] for k in part], [windows[k] for k in part])
        lo = hi
    return best, end


def _pad(length, least: float):
    """Words that an alignment of the least score can reach past its item's length: with
    m <= length matches it has at most m - least * length gaps and mismatches."""
    return np.maximum(length // 2, np.ceil((1 - least) * length).astype(np.int64)) + 2


def _promising(row, item, diagonal, words, row_word, idx, least):
    """Which hits, sorted by row, item and diagonal, an alignment of at least the least
    score can go through.

    Runs of SEED matches or more consist of hits, whose diagonals differ by at most the
    pad; let them hold a matches.  All other runs are shorter and cost an error each, so
    a SEED - 1 of their matches count for SEED - 2 at most.  With m words of the item in
    the window, the score is at most a + (m - a) * (SEED - 2) / (SEED - 1): no alignment
    of the least score is lost."""
    length = idx["begin"][item + 1] - idx["begin"][item]
    pad = _pad(length, least)
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1])
    # hits of the same pair at most the pad away: diagonals are set apart by pair
    apart = (np.cumsum(new) - 1) * (1 << 42) + diagonal
    near = np.searchsorted(apart, apart + pad, "right") - np.searchsorted(apart, apart - pad)
    a = np.minimum(SEED * near, length)
    need = np.ceil(((SEED - 1) * least * length - a) / (SEED - 2) - 1e-9)
    # a window for each diagonal of a pair
    lead = new.copy()
    lead[1:] |= diagonal[1:] != diagonal[:-1]
    begin = np.flatnonzero(lead)
    first = np.maximum(diagonal - pad, row_word[row])[begin]
    size = np.minimum(diagonal + length + pad, row_word[row + 1])[begin] - first
    good = np.zeros(len(begin), bool)
    n_words, n_pairs = len(idx["vocab"]) + 1, len(idx["item_word"])
    reach = np.cumsum(size)
    lo = 0
    while lo < len(begin):
        hi = max(lo + 1, int(np.searchsorted(reach, reach[lo] + CELLS, "right")))
        n = size[lo:hi]
        w = np.repeat(np.arange(hi - lo), n)
        at = np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[lo:hi], n)
        key = item[begin[lo:hi]][w] * n_words + words[at]
        slot = np.minimum(np.searchsorted(idx["item_word"], key), n_pairs - 1)
        held = idx["item_word"][slot] == key
        # words of the item in the window; then the item's words that are there, each once
        some = np.bincount(w[held], minlength=hi - lo) >= need[begin[lo:hi]]
        held &= some[w]
        pair = np.unique(w[held] * n_pairs + slot[held])
        m = np.bincount(pair // n_pairs, idx["times"][pair % n_pairs], minlength=hi - lo)
        good[lo:hi] = some & (m >= need[begin[lo:hi]])
        lo = hi
    return good[np.cumsum(lead) - 1]


def _windows(key, row, at, words, row_word, idx, least):
    """Merged (row, item, first word, end word) windows around the hits."""
    n = idx["at"][key + 1] - idx["at"][key]
    k = np.repeat(idx["at"][key], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    item, row = idx["item"][k], np.repeat(row, n)
    diagonal = np.repeat(at, n) - idx["pos"][k]
    order = np.lexsort((diagonal, item, row))
    row, item, diagonal = row[order], item[order], diagonal[order]
    keep = _promising(row, item, diagonal, words, row_word, idx, least)
    row, item, diagonal = row[keep], item[keep], diagonal[keep]
    length = idx["begin"][item + 1] - idx["begin"][item]
    pad = _pad(length, least)
    first = np.maximum(diagonal - pad, row_word[row])
    last = np.minimum(diagonal + length + pad, row_word[row + 1])
    # of a sorted run, a window starts anew where it lies after all before it
    same = np.zeros(len(row), bool)
    same[1:] = (row[1:] == row[:-1]) & (item[1:] == item[:-1])
    group = np.cumsum(~same)
    reach = np.maximum.accumulate(last + group * (1 << 40)) - group * (1 << 40)
    new = ~same
    new[1:] |= first[1:] > reach[:-1]
    begin = np.flatnonzero(new)
    return row[begin], item[begin], first[begin], np.maximum.reduceat(last, begin) if len(begin) else last


def _windows_by_rows(key, row, at, words, row_word, idx, least):
    """_windows() over ranges of rows with a bounded number of (hit, item) pairs, one row
    at least."""
    ids = tb.find(words, idx["vocab"])
    order = np.argsort(row, kind="stable")
    key, row, at = key[order], row[order], at[order]
    begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    ends = np.r_[begin[1:], len(row)]
    pairs = np.cumsum(idx["at"][key + 1] - idx["at"][key])[ends - 1]
    out, lo, done = [], 0, 0
    while lo < len(begin):
        hi = max(lo + 1, int(np.searchsorted(pairs, done + CELLS, "right")))
        part = slice(begin[lo], ends[hi - 1])
        out.append(_windows(key[part], row[part], at[part], ids, row_word, idx, least))
        lo, done = hi, pairs[hi - 1]
    return tuple(np.concatenate(x) for x in zip(*out))


def leaks_of(buf: np.ndarray, offs: np.ndarray, idx: dict, least: float):
    """(row, item, score, start, end) of the buffer's texts: the best window of each
    text and item that scores at least so much; None if there is none."""
    words, starts, ends, row_word = tb.word_hashes(buf, offs, tb.ALNUM)
    key, row, at = _hits(words, row_word, idx)
    if not len(key):
        return None
    row, item, first, last = _windows_by_rows(key, row, at, words, row_word, idx, least)
    if not len(row):
        return None
    own = [idx["words"][idx["begin"][i]:idx["begin"][i + 1]] for i in item.tolist()]
    win = [words[a:z] for a, z in zip(first.tolist(), last.tolist())]
    best, end = _align_in_batches(own, win)
    score = best / np.array([len(x) for x in own])
    # the best window of each pair, the leftmost of equal ones
    order = np.lexsort((first, -score, item, row))
    lead = np.ones(len(order), bool)
    lead[1:] = (row[order][1:] != row[order][:-1]) | (item[order][1:] != item[order][:-1])
    good = [k for k in order[lead].tolist() if score[k] >= least]
    if not good:
        return None
    # the start: the same alignment backwards from its end
    back = _align_in_batches([own[k][::-1] for k in good], [win[k][:end[k]][::-1] for k in good])[1]
    w0 = np.array([first[k] + end[k] - z for k, z in zip(good, back.tolist())])
    w1 = np.array([first[k] + end[k] - 1 for k in good])
    r = row[good]
    return r, item[good], score[good], tb.char_index(buf, offs, starts[w0], r), tb.char_index(buf, offs, ends[w1], r)


def clean_rows(text: pa.Array, idx: dict, least: float = LEAST) -> np.ndarray:
    """Which texts hold no copy of an item.  It goes over them in small chunks, so that it
    takes a few megabytes beside the texts."""
    out = np.ones(len(text), bool)
    for lo, _, buf, offs in tb.row_chunks(text, tb.SMALL_CHUNK_BYTES):
        got = leaks_of(buf, offs, idx, least)
        if got:
            out[lo + got[0]] = False
    return out


def search(docs: DataFrame, idx: dict, least: float = LEAST) -> DataFrame:
    """Rows of SCHEMA for a block's index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offs in tb.row_chunks(b.column(1), tb.SMALL_CHUNK_BYTES):
                got = leaks_of(buf, offs, idx, least)
                if got:
                    row, item, score, start, end = got
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo).take(pa.array(row)), pa.array([idx["ids"][i] for i in item.tolist()], pa.int64()),
                                                      pa.array(score), pa.array(start), pa.array(end)], names=["doc_id", "item_id", "score", "start", "end"])

    return docs.mapInArrow(releasing(run), SCHEMA)


def indexes(benchmark: DataFrame) -> Iterator[dict]:
    """The seeds of each block of items."""
    for items in blocks(benchmark):
        idx = index(items)
        if len(idx["keys"]):
            yield idx


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """doc_id, item_id, score, start, end (code points): documents that hold a copy,
    whole or edited, of a benchmark item."""
    spark = docs.sparkSession
    prepare(spark, SMALL_BATCH_BYTES)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = [search(d, idx, least) for idx in indexes(benchmark)]
    return union_all(found) if found else spark.createDataFrame([], SCHEMA)


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", least: float = LEAST) -> DataFrame:
    """The documents that hold no copy of a benchmark item, with all their columns."""
    prepare(docs.sparkSession, SMALL_BATCH_BYTES)

    def clean(idx):
        @F.arrow_udf("boolean")
        def is_clean(text: pa.Array) -> pa.Array:
            return pa.array(clean_rows(text, idx, least))

        return is_clean(F.col(text_col).cast("string"))

    for idx in indexes(benchmark):
        docs = docs.where(clean(idx))
    return docs
