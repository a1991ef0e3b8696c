"""Vectorised text primitives over Arrow string columns.

Spark hands each task Arrow batches whose string column already is one UTF-8
byte buffer with row offsets.  The helpers here work on that buffer directly
with numpy: word boundaries come from a 256-entry byte-class table and word
identities from a polynomial hash of the bytes, so no Python object is made per
word.  Batches are cut into row chunks of a few megabytes, which bounds the
memory of a task whatever the batch holds (one row is never cut).

Nulls count as empty texts everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
#: For stages that pass whole rows on beside the work in Python: the arrays of a chunk take
#: some 60 times its bytes, and at this size they stay in a core's cache.
SMALL_CHUNK_BYTES = 1 << 17

U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser: spreads every input bit over the 64 output bits."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_GOLD = U64(0x9E3779B97F4A7C15)
_POW = {"p": np.ones(1, U64), "q": np.ones(1, U64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least n of each."""
    if len(_POW["p"]) < n:
        for key, base in (("p", _BASE), ("q", _INV)):
            a = np.full(n, base, U64)
            a[0] = 1
            _POW[key] = np.multiply.accumulate(a)
    return _POW["p"], _POW["q"]


#: A value for each byte; A-Z as a-z.
_LOWER = np.arange(256)
_LOWER[65:91] += 32
BYTE_VALUE = mix((np.arange(256).astype(U64) + U64(1)) * _GOLD)[_LOWER]
LOWER = _LOWER.astype(np.uint8)

#: Byte classes of a word: anything but ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Letters, digits, and all bytes of non-ASCII characters.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def string_buffer(arr) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of an Arrow string array, null as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    offs = np.frombuffer(arr.buffers()[1], np.int64 if wide else np.int32, len(arr) + 1 + arr.offset)
    offs = offs[arr.offset:].astype(np.int64)
    data = arr.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0]:offs[-1]], offs - offs[0]


def row_chunks(arr, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges (lo, hi, bytes, offsets) of at most max_bytes, but one row at least."""
    if len(arr) == 0:
        return
    buf, offs = string_buffer(arr)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + max_bytes, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, buf[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi


def word_spans(buf: np.ndarray, offs: np.ndarray, word_byte: np.ndarray):
    """(starts, ends, row_word): byte spans of maximal runs of word bytes; a run
    ends at its row's end.  row_word[i]:row_word[i + 1] are the words of row i."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    m = word_byte[buf]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = m[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = m[1:]
    inner = offs[(offs > 0) & (offs < n)]
    before[inner] = False
    after[inner - 1] = False
    starts = np.flatnonzero(m & ~before)
    ends = np.flatnonzero(m & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Running polynomial hash; span_hash() takes any span's hash from it."""
    n = len(buf)
    p, _ = _powers(n + 1)
    out = np.zeros(n + 1, U64)
    np.cumsum(BYTE_VALUE[buf] * p[:n], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the (ASCII-lower-cased) bytes of each span."""
    _, q = _powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * q[starts])


def word_hashes(buf, offs, word_byte):
    """(hashes, starts, ends, row_word) of all words."""
    starts, ends, row_word = word_spans(buf, offs, word_byte)
    return span_hash(prefix_hash(buf), starts, ends), starts, ends, row_word


def ngram_hashes(words: np.ndarray, row_word: np.ndarray, n: int):
    """Hashes of n consecutive words and their row; n-grams that cross a row's
    end are left out.  Returns (hash, row, index of the first word)."""
    k = len(words) - n + 1
    if k <= 0:
        z = np.zeros(0, np.int64)
        return z.astype(U64), z, z
    h = np.full(k, n * int(_GOLD) & (1 << 64) - 1, U64)
    for i in range(n):
        h = (h ^ words[i:i + k]) * U64(0xD6E8FEB86659FD93)
        h ^= h >> U64(32)
    row = np.repeat(np.arange(len(row_word) - 1), np.diff(row_word))
    keep = np.flatnonzero(row[:k] == row[n - 1:])
    return mix(h[keep]), row[keep], keep


def find(h: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places (1 on, 0 for none) of hashes in the sorted distinct keys."""
    out = np.zeros(len(h), np.int64)
    if len(keys):
        # most are none: a bitmap of the hashes' low bits leaves few to search
        low = np.zeros(1 << 16, bool)
        low[keys & U64(0xFFFF)] = True
        maybe = np.flatnonzero(low[h & U64(0xFFFF)])
        at = np.searchsorted(keys, h[maybe])
        at[at == len(keys)] = 0
        out[maybe] = np.where(keys[at] == h[maybe], at + 1, 0)
    return out


def char_index(buf: np.ndarray, offs: np.ndarray, at: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Code-point positions within their rows of byte positions."""
    lead = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=lead[1:])
    return lead[at] - lead[offs[row]]
