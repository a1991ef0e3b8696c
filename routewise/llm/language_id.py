"""Language identification by segmentation-marginalised unigrams.

A text is its units: runs of ASCII letters and non-ASCII bytes, with ASCII capitals as
small letters, cut after UNIT bytes.  A unit is a word mark and its bytes; a
segmentation cuts it into pieces of a fixed public vocabulary, of which some hold the
mark and some bytes within a word, or into single bytes, which are pieces too.  A
language has a probability for each piece, and a unit's probability is the sum over all
of its segmentations of the product of its pieces' probabilities:

  f(0) = p(mark),  f(e) = p(mark + u[0:e]) + sum over s < e of f(s) p(u[s:e]),

the forward algorithm, taken in doubles: a unit's value is above 1e-300 as pieces have at
least FLOOR.  A text's score is the sum of its units' logarithms and of the language's
log share; the prediction is the best, its score the posterior probability.

Probabilities are learnt by expectation maximisation: ROUNDS of expected piece counts
over all segmentations (forward-backward), smoothed by the counts of all languages
together.  Units of the sampled texts are counted on the executors first, and only the
expected counts, at most languages x pieces, reach the driver.  The sample is bounded:
DOCS documents of a language in expectation, by a hash of the id; whole texts of these.

Defined cases: null texts and texts without a letter are `und` with score 0; if there is
no document to learn from, all are; null languages and null ids are not learnt from
(a null id is of the learning fold, as null is not 1, but carries no id to sample by);
repeated ids get a row each; of languages with equal scores the first by name; other
columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routewise.llm import textblocks as tb
from routewise.llm.common import prepare, stored

UNKNOWN = "und"
#: Documents of a language that are learnt from, in expectation.
DOCS = 2000
ROUNDS = 3
#: Bytes of a unit and of a piece at most.
UNIT, PIECE = 32, 16
#: Weight of all languages' counts in each language's, in pieces.
POOLED = 100.0
FLOOR = 1e-9
#: Numbers in a block's table of forward values at most.
CELLS = 1 << 22

LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
ASCII_LETTER = LETTER.copy()
ASCII_LETTER[128:] = False
_STEP = tb.U64(0xD6E8FEB86659FD93)
_MARK = tb.U64(0xA0761D6478BD642F)
_BITS = 22


class Vocabulary:
    """Pieces with the word mark and within words, by hash.  Ids: 0 to 255 the single
    bytes, 256 the mark alone, then the others."""

    def __init__(self, marked: list[bytes], inner: list[bytes]):
        small = lambda x: x.translate(bytes(tb.LOWER))
        fits = lambda x, least: least <= len(x) <= PIECE and LETTER[np.frombuffer(x, np.uint8)].all()
        pieces = sorted({(True, small(x)) for x in marked if fits(x, 1)} | {(False, small(x)) for x in inner if fits(x, 2)})
        key = np.array([self._hash(x) ^ (int(_MARK) if mark else 0) for mark, x in pieces], np.uint64)
        order = np.argsort(key)
        self.keys, self.ids = key[order], order + 257
        self.size = len(pieces) + 257
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[self.keys & tb.U64((1 << _BITS) - 1)] = True

    @staticmethod
    def _hash(x: bytes) -> int:
        h = 0
        for c in x:
            h = (h * int(_STEP) + int(tb.BYTE_VALUE[c])) & (1 << 64) - 1
        return h

    @classmethod
    def of_model(cls, path: str) -> Vocabulary:
        """The pieces of a sentencepiece model."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_byte(i) or m.is_unknown(i))]
        mark = "▁"
        return cls([p[1:].encode() for p in pieces if p.startswith(mark)], [p.encode() for p in pieces if mark not in p])

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, ids) of the hashes that are pieces."""
        at = np.flatnonzero(self.maybe[h & tb.U64((1 << _BITS) - 1)])
        if not len(self.keys):
            return at, at
        place = np.searchsorted(self.keys, h[at])
        place[place == len(self.keys)] = 0
        hit = self.keys[place] == h[at]
        return at[hit], self.ids[place[hit]]


def units(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, rows) of the units."""
    starts, ends, row_word = tb.word_spans(buf, offs, LETTER)
    rows = np.repeat(np.arange(len(offs) - 1), np.diff(row_word))
    parts = -(-(ends - starts) // UNIT)
    if (parts > 1).any():
        i = np.repeat(np.arange(len(parts)), parts)
        k = np.arange(len(i)) - np.repeat(np.cumsum(parts) - parts, parts)
        starts, ends, rows = starts[i] + UNIT * k, np.minimum(starts[i] + UNIT * (k + 1), ends[i]), rows[i]
    return starts, ends, rows


def matrix(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(longest, n) bytes of units; what is beyond a unit's end is of no meaning."""
    w = int((ends - starts).max(initial=0))
    at = np.minimum(starts[None, :] + np.arange(w)[:, None], max(len(buf) - 1, 0))
    return tb.LOWER[buf[at]] if len(buf) else np.zeros((0, len(starts)), np.uint8)


def lattice(vocab: Vocabulary, u: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(s, e, units, pieces) of all pieces u[s:e], s -1 for those with the mark; by s,
    from the mark on.  Units are in order of size, the longest first."""
    many = np.searchsorted(-size, -np.arange(len(u) + 1), "right")  # units of at least e bytes
    value = tb.BYTE_VALUE[u]
    for s in range(-1, len(u)):
        h = np.zeros(many[max(s, 0) + 1] if len(u) else 0, np.uint64)
        a = max(s, 0)
        for e in range(a + 1, min(a + PIECE, len(u)) + 1):
            m = many[e]
            if not m:
                break
            h = h[:m] * _STEP + value[e - 1, :m]
            if s >= 0 and e == a + 1:
                yield s, e, np.arange(m), u[a, :m].astype(np.int64)
                continue
            got = vocab.find(h ^ _MARK if s < 0 else h)
            if len(got[0]):
                yield s, e, *got


def log_probabilities(vocab: Vocabulary, p: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(units, languages) log probabilities, summed over all segmentations; p (pieces,
    languages)."""
    size, langs = ends - starts, p.shape[1]
    out = np.zeros((len(size), langs))
    order = np.argsort(-size, kind="stable")
    block = max(64, CELLS // ((UNIT + 1) * max(langs, 1)))
    for lo in range(0, len(order), block):
        at = order[lo:lo + block]
        u = matrix(buf, starts[at], ends[at])
        f = np.zeros((len(u) + 1, len(at), langs))
        f[0] = p[256]
        for s, e, i, piece in lattice(vocab, u, size[at]):
            f[e, i] += p[piece] if s < 0 else f[s, i] * p[piece]
        out[at] = np.log(f[size[at], np.arange(len(at))])
    return out


def expected_counts(vocab: Vocabulary, p: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Expected number of each piece, p the probabilities of one language."""
    size = ends - starts
    total = np.zeros(len(p))
    order = np.argsort(-size, kind="stable")
    block = max(64, CELLS // (4 * (UNIT + 1)))
    for lo in range(0, len(order), block):
        at = order[lo:lo + block]
        n, many = size[at], np.arange(len(at))
        u = matrix(buf, starts[at], ends[at])
        steps = list(lattice(vocab, u, n))
        f, g = np.zeros((len(u) + 1, len(at))), np.zeros((len(u) + 1, len(at)))
        f[0] = p[256]
        for s, e, i, piece in steps:
            f[e, i] += p[piece] if s < 0 else f[s, i] * p[piece]
        g[n, many] = 1
        weight = count[at] / f[n, many]
        for s, e, i, piece in reversed(steps):  # by s downwards, so g[e] is complete
            if s >= 0:
                g[s, i] += p[piece] * g[e, i]
            # what a step gives: all before it times the piece times all after it
            total += np.bincount(piece, (1 if s < 0 else f[s, i]) * p[piece] * g[e, i] * weight[i], len(p))
        total[256] += (f[0] * g[0] * weight).sum()
    return total


def unit_counts(sample: DataFrame) -> DataFrame:
    """(lang, unit, n) from (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offs in tb.row_chunks(b.column(1)):
                code = b.column(0).slice(lo, hi - lo).dictionary_encode()
                starts, ends, rows = units(buf, offs)
                if not len(starts):
                    continue
                lang = code.indices.to_numpy()[rows]
                h = tb.span_hash(tb.prefix_hash(buf), starts, ends) ^ tb.mix(lang.astype(np.uint64))
                _, first, n = np.unique(h, return_index=True, return_counts=True)
                raw = tb.LOWER[buf].tobytes()
                yield pa.RecordBatch.from_arrays([code.dictionary.take(pa.array(lang[first])), pa.array([raw[a:z] for a, z in zip(starts[first].tolist(), ends[first].tolist())], pa.binary()), pa.array(n)],
                                                 names=["lang", "unit", "n"])

    return sample.select("lang", "text").mapInArrow(run, "lang string, unit binary, n long").groupBy("lang", "unit").agg(F.sum("n").alias("n"))


def expectation(counted: DataFrame, vocab: Vocabulary, langs: list[str], p: np.ndarray) -> np.ndarray:
    """(pieces, languages) expected counts over the units (lang, unit, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), vocab.size))
        for b in batches:
            lang = np.array([langs.index(x) for x in b.column(0).to_pylist()], np.int64)
            buf, offs = tb.string_buffer(b.column(1))
            n = b.column(2).to_numpy().astype(float)
            for i in np.unique(lang).tolist():
                at = np.flatnonzero(lang == i)
                total[i] += expected_counts(vocab, np.ascontiguousarray(p[:, i]), buf, offs[:-1][at], offs[1:][at], n[at])
        i, piece = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(total[i, piece])], names=["lang", "piece", "n"])

    got = counted.mapInArrow(run, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((vocab.size, len(langs)))
    out[got.column("piece").to_numpy(), got.column("lang").to_numpy()] = got.column("n").to_numpy()
    return out


class Model:
    """Languages, their log shares and (pieces, languages) probabilities."""

    def __init__(self, vocab: Vocabulary, langs: list[str], share: np.ndarray, p: np.ndarray):
        self.vocab, self.langs, self.share, self.p = vocab, langs, share, p


def smoothed(n: np.ndarray) -> np.ndarray:
    """Probabilities from (pieces, languages) counts."""
    if not n.shape[1]:
        return n
    pool = n.sum(axis=1) + 1.0
    p = n + POOLED * (pool / pool.sum())[:, None]
    return np.maximum(p / p.sum(axis=0), FLOOR)


def learning_fold():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 != 1, F.lit(True))


def train(docs: DataFrame, vocabulary: str, docs_per_lang: int = DOCS, rounds: int = ROUNDS) -> Model:
    """A model from the learning folds of docs (doc_id, text, lang); vocabulary is the path
    of a sentencepiece model."""
    spark = docs.sparkSession
    prepare(spark)
    vocab = Vocabulary.of_model(vocabulary)
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(learning_fold() & F.expr("lang is not null and text is not null and doc_id is not null"))
    seen = sorted((r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect())  # one row a language
    langs = [lang for lang, _ in seen]
    share = np.log([n for _, n in seen]) - np.log(sum(n for _, n in seen)) if seen else np.zeros(0)
    if not langs:
        return Model(vocab, langs, share, np.zeros((vocab.size, 0)))
    parts = 1 << 30
    keep = F.broadcast(spark.createDataFrame([(lang, min(parts, docs_per_lang * parts // n)) for lang, n in seen], "lang string, below long"))
    sample = rows.join(keep, "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) < F.col("below"))
    counted = stored(unit_counts(sample), "language-units")
    p = np.full((vocab.size, len(langs)), 1 / vocab.size)
    for _ in range(rounds):
        p = smoothed(expectation(counted, vocab, langs, p))
    return Model(vocab, langs, share, p)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    prepare(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([*model.langs, UNKNOWN], pa.string())
        for b in batches:
            for lo, hi, buf, offs in tb.row_chunks(b.column(2)):
                total = np.tile(model.share, (hi - lo, 1))
                starts, ends, rows = units(buf, offs)
                lettered = np.zeros(hi - lo, bool)
                if len(starts):
                    _, first, which = np.unique(tb.span_hash(tb.prefix_hash(buf), starts, ends), return_index=True, return_inverse=True)
                    logs = log_probabilities(model.vocab, model.p, buf, starts[first], ends[first])
                    for i in range(len(model.langs)):
                        total[:, i] += np.bincount(rows, logs[which, i], hi - lo)
                    ascii_ = np.append(0, np.cumsum(ASCII_LETTER[buf]))
                    lettered = ascii_[offs[1:]] > ascii_[offs[:-1]]
                    for i in np.setdiff1d(rows, np.flatnonzero(lettered)).tolist():
                        lettered[i] = any(map(str.isalpha, buf[offs[i]:offs[i + 1]].tobytes().decode("utf-8", "ignore")))
                if model.langs:
                    best = total.argmax(axis=1)
                    score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                else:
                    lettered[:], best, score = False, np.zeros(hi - lo, np.int64), np.zeros(hi - lo)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), names.take(pa.array(np.where(lettered, best, len(model.langs)))),
                                                  pa.array(np.where(lettered, score, 0.0))], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", (~learning_fold()).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
