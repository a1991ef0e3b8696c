"""Token-ID output in patched frame-of-reference blocks.

Texts are tokenized once, put in ascending id order over range shards and
written as chunks.  A chunk holds whole documents (at least CHUNK_IDS ids unless
it is a shard's last) as blocks of BLOCK ids.  Each block stores the ids minus
the block's minimum, packed at the width that the PERCENTILE-th offset needs;
the offsets that do not fit are exceptions (position, offset).  A chunk's payload:

    uint32 number of ids
    for each block: uint32 start of its packed bytes in the payload,
                    uint32 minimum, uint8 width, uint16 number of exceptions
    packed offsets of each block, most significant bit first
    uint16 position in the block and uint32 offset of each exception, block by block

all little-endian, the field arrays stored one after another.  Chunks are the
rows of a Parquet folder (shard, chunk, first id's place in the shard, document
ids and lengths, payload), so any store that Spark writes to can hold them and a
lost executor's files are written again by Spark's commit protocol.

Defined cases: a null or empty text is just the end id; null document ids come
first; repeated ids are kept, ordered by length and checksum; other columns are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routewise.llm import textblocks as tb
from routewise.llm.common import SMALL_BATCH_BYTES, new_folder, prepare, releasing

BLOCK = 512
PERCENTILE = 0.95
CHUNK_IDS = 1 << 16
END_ID = 1
#: Distinct units whose ids a task keeps; beyond, it starts a new table.
CACHE_UNITS = 1_000_000
#: Byte classes: letters, single digits, other visible ASCII; 0 for all whose part in a
#: word takes more than the byte to tell (then the word is left whole): non-ASCII,
#: control characters, the apostrophe of contractions, and < of special tokens.
_UNIT = np.zeros(256, np.uint8)
_UNIT[33:127] = 3
_UNIT[48:58] = 2
_UNIT[65:91] = _UNIT[97:123] = 1
_UNIT[[39, 60]] = 0


# ---- codec ---------------------------------------------------------------------------------------
def pack(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """Payload of a chunk."""
    n = len(ids)
    if n == 0:
        return struct.pack("<I", 0)
    nb = -(-n // BLOCK)
    x = np.empty(nb * BLOCK, np.uint32)
    x[:n] = ids
    x[n:] = x[n - 1]
    x = x.reshape(nb, BLOCK)
    base = x.min(axis=1)
    x = x - base[:, None]
    at = min(BLOCK - 1, max(0, int(np.ceil(BLOCK * percentile)) - 1))
    width = np.ceil(np.log2(np.partition(x, at, axis=1)[:, at].astype(np.float64) + 1)).astype(np.uint8)
    over = (x >> width[:, None].astype(np.uint32)) > 0
    over[width >= 32] = False
    blk, pos = np.nonzero(over)
    exc_val = x[over]
    size = width.astype(np.int64) * (BLOCK // 8)
    head = 4 + nb * 11
    start = head + np.concatenate([[0], np.cumsum(size)[:-1]])
    body = np.empty(int(size.sum()), np.uint8)
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            bits = np.unpackbits(x[rows].astype(">u4").view(np.uint8).reshape(len(rows), BLOCK, 4), axis=2) \
                if w > 16 else np.unpackbits((x[rows] & 0xFFFF).astype(">u2").view(np.uint8).reshape(len(rows), BLOCK, 2), axis=2)
            packed = np.packbits(bits[:, :, bits.shape[2] - w:].reshape(len(rows), -1), axis=1)
            body[(start[rows] - head)[:, None] + np.arange(packed.shape[1])] = packed
    return b"".join([struct.pack("<I", n), start.astype("<u4").tobytes(), base.astype("<u4").tobytes(), width.tobytes(),
                     np.bincount(blk, minlength=nb).astype("<u2").tobytes(), body.tobytes(),
                     pos.astype("<u2").tobytes(), exc_val.astype("<u4").tobytes()])


def unpack(payload: bytes) -> np.ndarray:
    """The ids of a payload, as little-endian uint32."""
    raw = np.frombuffer(payload, np.uint8)
    n = struct.unpack_from("<I", payload)[0]
    if n == 0:
        return np.zeros(0, "<u4")
    nb = -(-n // BLOCK)
    start = np.frombuffer(payload, "<u4", nb, 4).astype(np.int64)
    base = np.frombuffer(payload, "<u4", nb, 4 + 4 * nb)
    width = raw[4 + 8 * nb:4 + 9 * nb]
    n_exc = np.frombuffer(payload, "<u2", nb, 4 + 9 * nb).astype(np.int64)
    x = np.zeros((nb, BLOCK), np.uint32)
    for w in np.unique(width):
        if w:
            rows, full = np.flatnonzero(width == w), 16 if w <= 16 else 32
            bits = np.zeros((len(rows), BLOCK, full), np.uint8)
            packed = raw[start[rows][:, None] + np.arange(int(w) * BLOCK // 8)]
            bits[:, :, full - w:] = np.unpackbits(packed, axis=1).reshape(len(rows), BLOCK, w)
            x[rows] = np.packbits(bits.reshape(len(rows), -1), axis=1).view(f">u{full // 8}")
    if n_exc.sum():
        at = int(start[-1]) + int(width[-1]) * BLOCK // 8
        pos = np.frombuffer(payload, "<u2", int(n_exc.sum()), at)
        x[np.repeat(np.arange(nb), n_exc), pos] = np.frombuffer(payload, "<u4", int(n_exc.sum()), at + 2 * len(pos))
    return (x + base[:, None]).reshape(-1)[:n].astype("<u4")


# ---- tokenizing ----------------------------------------------------------------------------------
def unit_spans(buf: np.ndarray, offs: np.ndarray):
    """(starts, ends, row_unit): words cut into runs of letters, single digits and runs
    of other characters, as a word-level pre-tokenizer has them.  Latin-1 letters count
    as letters; words with other non-ASCII characters stay whole."""
    starts, ends, _ = tb.word_spans(buf, offs, tb.NOT_SPACE)
    n = len(buf)
    if n == 0 or not len(starts):
        return starts, ends, np.searchsorted(starts, offs)
    kind = _UNIT[buf]
    # two-byte letters U+00C0 to U+00FF, without the signs for times and division
    second = (buf[1:] >= 0x80) & (buf[1:] <= 0xBF) & (buf[1:] != 0x97) & (buf[1:] != 0xB7) & (buf[:-1] == 0xC3)
    at = np.flatnonzero(second)
    kind[at] = kind[at + 1] = 1
    odd = np.concatenate([[0], np.cumsum(kind == 0)])
    whole = odd[ends] > odd[starts]
    cut = np.zeros(n, bool)
    cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    # of whole words only the start counts
    step = np.zeros(n + 1, np.int32)
    step[starts[whole]] += 1
    step[ends[whole]] -= 1
    cut &= (np.cumsum(step)[:n] == 0) & tb.NOT_SPACE[buf]
    cut[starts] = True
    first = np.flatnonzero(cut)
    last = np.append(first[1:], n)
    # a unit ends with its word
    last = np.minimum(last, ends[np.searchsorted(starts, first, "right") - 1])
    return first, last, np.searchsorted(first, offs)


class WordEncoder:
    """Ids of texts by a tokenizer whose result is the joined results of the text's
    units (unit_spans), as with word-level pre-tokenizers that drop white space.  Every
    distinct unit goes to the tokenizer once while the table holds it; texts are then
    put together by table look-up."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.clear()

    def fits(self) -> bool:
        """Whether the tokenizer is of the kind that units serve: it takes capitals as small
        letters, as units' hashes do, and a text's ids are its units' joined."""
        ids = lambda x: self.tok.encode(x, add_special_tokens=False).ids
        letters = "".join(map(chr, range(65, 91)))
        if any(ids(x) != ids(x.lower()) for x in (letters, *letters, "The Quick-BROWN fOX")):
            return False
        text = "The quick  Brown\tfox, jumps over 13 d0gs!\n\"It's\" \u00dcber-na\u00efve caf\u00e9 #tags: a_b+c=d; x@y.example \u6f22\u5b57 e\u0301 end. "
        raw = np.frombuffer(text.encode(), np.uint8)
        starts, ends, _ = unit_spans(raw, np.array([0, len(raw)]))
        return ids(text) == [i for a, z in zip(starts.tolist(), ends.tolist()) for i in ids(raw[a:z].tobytes().decode())]

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)   # sorted word hashes
        self.slot = np.zeros(0, np.int64)    # their place in starts
        self.starts = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, keys, buf, starts, ends) -> None:
        raw = buf.tobytes()
        words = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist())]
        new = [e.ids for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]
        n = np.fromiter(map(len, new), np.int64, len(new))
        flat = np.fromiter((i for x in new for i in x), np.uint32, int(n.sum()))
        slots = len(self.starts) - 1 + np.arange(len(new))
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(n)])
        self.ids = np.concatenate([self.ids, flat])
        at = np.searchsorted(self.keys, keys)  # both are sorted
        self.keys, self.slot = np.insert(self.keys, at, keys), np.insert(self.slot, at, slots)

    def _find(self, keys):
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return at, (self.keys[at] == keys) if len(self.keys) else np.zeros(len(keys), bool)

    def rows(self, buf: np.ndarray, offs: np.ndarray):
        """(ids, ends): the ids of all rows, END_ID after each, and where rows end."""
        starts, ends, row_word = unit_spans(buf, offs)
        h = tb.span_hash(tb.prefix_hash(buf), starts, ends)
        keys, first, inv = np.unique(h, return_index=True, return_inverse=True)
        at, known = self._find(keys)
        if not known.all():
            if len(self.keys) + (~known).sum() > CACHE_UNITS:
                self.clear()
                known[:] = False
            miss = np.flatnonzero(~known)
            self._learn(keys[miss], buf, starts[first[miss]], ends[first[miss]])
            at, known = self._find(keys)
        slot = self.slot[at][inv] if len(keys) else np.zeros(0, np.int64)
        lens = self.starts[slot + 1] - self.starts[slot]
        # one more id after each row: shift each row's words by the rows before it
        word_row = np.repeat(np.arange(len(offs) - 1), np.diff(row_word))
        place = np.concatenate([[0], np.cumsum(lens)])
        ends_out = place[row_word[1:]] + np.arange(1, len(offs))
        out = np.empty(int(place[-1]) + len(offs) - 1, np.uint32)
        out[ends_out - 1] = END_ID
        total = int(place[-1])
        if total:
            within = np.arange(total) - np.repeat(place[:-1], lens)
            out[np.arange(total) + np.repeat(word_row, lens)] = self.ids[np.repeat(self.starts[slot], lens) + within]
        return out, ends_out


class TextEncoder:
    """Ids of whole texts, for any other tokenizer."""

    def __init__(self, tok):
        self.tok = tok

    def rows(self, buf: np.ndarray, offs: np.ndarray):
        raw, at = buf.tobytes(), offs.tolist()
        got = [[*e.ids, END_ID] for e in self.tok.encode_batch_fast([raw[a:z].decode("utf-8", "replace") for a, z in zip(at[:-1], at[1:])], add_special_tokens=False)]
        return np.fromiter((i for x in got for i in x), np.uint32), np.cumsum([len(x) for x in got], dtype=np.int64)


def encoder(path: str) -> WordEncoder | TextEncoder:
    words = WordEncoder(path)
    return words if words.fits() else TextEncoder(words.tok)


def tokenized(docs: DataFrame, tokenizer_path: str, bounds: list[int], id_col: str, text_col: str, order_col: str, chunk_bytes: int = tb.CHUNK_BYTES) -> DataFrame:
    """(doc_id, ord, shard, n, crc, ids): ids little-endian, 2 bytes each where the
    vocabulary allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        kind = np.dtype("<u2" if enc.tok.get_vocab_size() <= 1 << 16 else "<u4")
        edges = np.array(bounds, np.int64)
        for b in batches:
            for lo, hi, buf, offs in tb.row_chunks(b.column(2), chunk_bytes):
                ids, ends = enc.rows(buf, offs)
                begins = np.concatenate([[0], ends[:-1]])
                wide, narrow = memoryview(ids.astype("<u4").tobytes()), ids.astype(kind).tobytes()
                crc = [zlib.crc32(wide[4 * a:4 * z]) for a, z in zip(begins.tolist(), ends.tolist())]
                at = (np.concatenate([[0], ends]) * kind.itemsize).astype(np.int32)
                own, order = b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo)
                shard = np.searchsorted(edges, order.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), "left")
                yield pa.RecordBatch.from_arrays(
                    [own, order, pa.array(shard.astype(np.int32)), pa.array(ends - begins, pa.int64()), pa.array(crc, pa.int64()),
                     pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(narrow)])],
                    names=["doc_id", "ord", "shard", "n", "crc", "ids"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(order_col).cast("long").alias("ord"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(releasing(run), "doc_id long, ord long, shard int, n long, crc long, ids binary"))


# ---- writing and reading -------------------------------------------------------------------------
CHUNK_SCHEMA = "shard int, chunk int, first long, n long, doc_ids array<long>, doc_lens array<long>, payload binary"


def write_tokens(docs: DataFrame, out: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", order_col: str | None = None, chunk_bytes: int = tb.CHUNK_BYTES) -> None:
    """Write the chunks of all documents, in ascending order (of the ids, if no other
    column is named) over shards.  The shards' bounds are quantiles of the order
    column, read alone beforehand, so the text is read once and only packed ids are
    shuffled."""
    spark = docs.sparkSession
    prepare(spark, max(SMALL_BATCH_BYTES, 2 * chunk_bytes))
    shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order_col = order_col or id_col
    cuts = docs.select(F.col(order_col).cast("long").alias("i")).agg(
        F.percentile_approx("i", [k / shards for k in range(1, shards)] or [0.5], 100 * shards)).first()[0]
    bounds = sorted(set(cuts or []))
    rows = tokenized(docs, tokenizer_path, bounds, id_col, text_col, order_col, chunk_bytes)
    rows = rows.repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("shard", F.col("ord").asc_nulls_first(), "n", "crc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, chunk, first = None, 0, 0
        doc_ids: list = []
        lens: list[int] = []
        parts: list[bytes] = []
        size, total = 2, 0

        def flush():
            nonlocal chunk, first, doc_ids, lens, parts, total
            ids = np.frombuffer(b"".join(parts), f"<u{size}")
            row = pa.RecordBatch.from_pylist([{"shard": shard, "chunk": chunk, "first": first, "n": total, "doc_ids": doc_ids,
                                               "doc_lens": lens, "payload": pack(ids)}], schema=pa.schema([
                                                   ("shard", pa.int32()), ("chunk", pa.int32()), ("first", pa.int64()), ("n", pa.int64()),
                                                   ("doc_ids", pa.list_(pa.int64())), ("doc_lens", pa.list_(pa.int64())), ("payload", pa.binary())]))
            chunk, first, doc_ids, lens, parts, total = chunk + 1, first + total, [], [], [], 0
            return row

        for b in batches:
            for doc, s, n, raw in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(5)):
                if s != shard:
                    if lens:
                        yield flush()
                    shard, chunk, first = s, 0, 0
                raw = raw.as_py()
                size = len(raw) // n
                doc_ids.append(doc)
                lens.append(n)
                parts.append(raw)
                total += n
                if total >= CHUNK_IDS:
                    yield flush()
        if lens:
            yield flush()

    rows.mapInArrow(releasing(run), CHUNK_SCHEMA).write.parquet(out)


def read_chunks(spark, path: str) -> DataFrame:
    return spark.read.schema(CHUNK_SCHEMA).parquet(path)


def shard_offsets(chunks: DataFrame) -> DataFrame:
    """(shard, offset): ids in all shards before; one row per shard."""
    per = chunks.groupBy("shard").agg(F.sum("n").alias("n"))
    return per.select("shard", (F.expr("sum(n) over (order by shard)") - F.col("n")).alias("offset"))


def read_documents(spark, path: str, with_ids: bool = False) -> DataFrame:
    """Decode every chunk: doc_id, start (place of its first id among all ids),
    n_tokens, ids_crc32 and, if asked for, the ids.  Each chunk is decoded by
    itself, so there is no shuffle but that of the per-shard sums."""
    chunks = read_chunks(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, first, doc_ids, lens, payload in zip(*(b.column(i).to_pylist() for i in range(4)), b.column(4)):
                ids = unpack(payload.as_py())
                raw, ends = memoryview(ids.tobytes()), np.cumsum(lens)
                cut = [(int(z - n), int(z)) for z, n in zip(ends, lens)]
                cols = [pa.array(doc_ids, pa.int64()), pa.array([shard] * len(lens), pa.int32()), pa.array([first + a for a, _ in cut], pa.int64()),
                        pa.array(lens, pa.int64()), pa.array([zlib.crc32(raw[4 * a:4 * z]) for a, z in cut], pa.int64())]
                names = ["doc_id", "shard", "place", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array([ids[a:z].astype(np.int64) for a, z in cut], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, shard int, place long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    out = chunks.select("shard", "first", "doc_ids", "doc_lens", "payload").mapInArrow(run, schema)
    # one row per shard: as many as the job that wrote them had partitions
    return (out.join(F.broadcast(shard_offsets(chunks)), "shard")
            .select("doc_id", (F.col("place") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])))


def encode_documents(docs: DataFrame, tokenizer_path: str, out: str | None = None, id_col: str = "doc_id", text_col: str = "text", order_col: str | None = None, chunk_bytes: int = tb.CHUNK_BYTES) -> DataFrame:
    """Write docs and read the files back; see read_documents()."""
    out = out or new_folder(docs.sparkSession, "pfor")
    write_tokens(docs, out, tokenizer_path, id_col, text_col, order_col, chunk_bytes=chunk_bytes)
    return read_documents(docs.sparkSession, out)
