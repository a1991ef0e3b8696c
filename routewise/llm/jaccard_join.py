"""N-gram Jaccard self-join in size-banded tiles with hashed bitmap signatures.

A document's set holds the 64-bit hashes of its distinct WORDS-word shingles (white
space words, ASCII-lower-cased; the whole sequence where there are fewer words).  Two
documents link when 100 * |A & B| >= 80 * |A | B|.

1. Equal sets form a class (by a 128-bit digest), which stands for its documents.
2. Shingles are put in an order, those of frequent hash slots last.  Linked sets share
   a shingle among the first n - ceil(0.8 n) + 1 of each (prefix filter); any order is
   right, a rare-first one keeps the lists short.
3. A shingle's classes are streamed in order of size.  A class meets those before it
   that are near enough in size; up to NEAR of them become candidate pairs at once.
   Classes with more, and those of frequent slots, which are salted and not gathered,
   are paired with the one before them and go to tiles: a shingle with two adjacent size bands (ratio 1.25), which hold all
   sets that may link to each other by size.
4. A pair is first bounded from above: bitmaps hold the parity of the hashes by slot,
   the bits in which they differ are at most |A ^ B|, and a link needs
   |A ^ B| <= (|A| + |B|) / 9.  A set of n has a bitmap of n to 2 n bits; of two
   lengths the longer is folded.  A short one of fixed length is compared within the
   tiles' join.  What passes is intersected exactly, as sorted arrays.
5. Pairs within one component need no comparison.  The candidate pairs merge most of a
   group of near copies, as a class has another predecessor in each list.  In tiles
   with more than one component left, classes are compared to a few pivots of the tile,
   round by round while that finds links, and then those outside the tile's largest
   component to all of the tile that are apart from them.  Components are exact.

Texts are read whole, in vectorised passes; no set is stored.  Two different shingles
or classes with equal hashes would count as one (chance below n**2 / 2**65 for the n
different ones that meet).

Defined cases: a null or empty text, or one of white space only, has an empty set and
links with nothing; null ids link with nothing and keep component null; repeated ids
get a row each and are separate documents; other columns are ignored, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routewise.llm import textblocks as tb
from routewise.llm.common import SMALL_BATCH_BYTES, component_labels, may_be_among, prepare, releasing, stored

WORDS = 5
#: Similarity as a fraction.
NUM, DEN = 4, 5
SLOTS = 1 << 20
#: Shingles after which a task passes its slot counts on.
FLUSH = 1 << 22
#: Length of the short bitmaps, in 64-bit words; least bits of the others.
SIGNATURE = 8
LEAST_BITS = 256
#: Rounds of comparisons to pivots, at most, before all remaining pairs of the tiles, and
#: pivots of a tile in a round.
PIVOT_ROUNDS = 2
PIVOTS = 8
#: Classes before a class in its shingle's list that it is paired with at once.
NEAR = 8
#: Classes that a task remembers to have sent already.
SEEN = 1 << 20


SIG = [f"s{i}" for i in range(SIGNATURE)]


def shingle_sets(buf: np.ndarray, offs: np.ndarray, words: int = WORDS):
    """(hashes, cut): the sorted distinct shingle hashes of row i are
    hashes[cut[i]:cut[i + 1]]."""
    h, _, _, row_word = tb.word_hashes(buf, offs, tb.NOT_SPACE)
    n = np.diff(row_word)
    out, row, _ = tb.ngram_hashes(h, row_word, words)
    parts, rows = [out], [row]
    for k in range(1, words):
        if (n == k).any():
            s, r, _ = tb.ngram_hashes(h, row_word, k)
            parts.append(s[n[r] == k])
            rows.append(r[n[r] == k])
    if len(parts) > 1:
        out, row = np.concatenate(parts), np.concatenate(rows)
        order = np.argsort(row, kind="stable")
        out, row = out[order], row[order]
    cut = np.searchsorted(row, np.arange(len(n) + 1))
    for a, z in zip(cut[:-1].tolist(), cut[1:].tolist()):
        out[a:z].sort()
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    place = np.concatenate([[0], np.cumsum(new)])
    return out[new], place[cut]


def signature(hashes: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Parity bitmaps (rows, SIGNATURE) of the sets."""
    n, bits = len(cut) - 1, 64 * SIGNATURE
    row = np.repeat(np.arange(n), np.diff(cut))
    at = row * bits + (tb.mix(hashes) % tb.U64(bits)).astype(np.int64)
    odd = (np.bincount(at, minlength=n * bits) & 1).astype(np.uint8).reshape(n, bits)
    return np.packbits(odd, axis=1, bitorder="little").view("<u8")


def bitmaps(hashes: np.ndarray, cut: np.ndarray) -> list[bytes]:
    """Parity bitmaps of the sets, each of the least power of two bits that its size
    does not exceed."""
    n = np.diff(cut)
    bits = np.maximum(LEAST_BITS, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(bits)])
    at = np.repeat(first[:-1], n) + (tb.mix(hashes) & np.repeat(bits - 1, n).astype(np.uint64)).astype(np.int64)
    raw = np.packbits((np.bincount(at, minlength=first[-1]) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [raw[a:z] for a, z in zip((first[:-1] // 8).tolist(), (first[1:] // 8).tolist())]


def differing(a: bytes, b: bytes) -> int:
    """Bits in which two bitmaps differ, the longer one folded."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    short = 8 * min(len(a), len(b))
    mask = (1 << short) - 1
    while x >> short:
        x = (x & mask) ^ (x >> short)
    while y >> short:
        y = (y & mask) ^ (y >> short)
    return (x ^ y).bit_count()


def class_key(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def summaries(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, digest, s0 .., bits, slot, seen): a row with the bitmaps of each
    document, and rows with a null digest for hash slots that are frequent within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, size = np.zeros(SLOTS, np.int64), 0
        names = ["doc_id", "n", "digest", *SIG, "bits", "slot", "seen"]

        def flush():
            at = np.flatnonzero(total >= 4 + -(-4 * size // SLOTS))
            return pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.binary()),
                                               *[pa.nulls(len(at), pa.int64())] * SIGNATURE, pa.nulls(len(at), pa.binary()), pa.array(at.astype(np.int32)), pa.array(total[at])], names=names)

        for b in batches:
            for lo, hi, buf, offs in tb.row_chunks(b.column(1), tb.SMALL_CHUNK_BYTES):
                h, cut = shingle_sets(buf, offs, words)
                total += np.bincount((h & tb.U64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
                size += len(h)
                raw = memoryview(h.astype("<u8").tobytes())
                digest = [hashlib.blake2b(raw[8 * a:8 * z], digest_size=16).digest() for a, z in zip(cut[:-1].tolist(), cut[1:].tolist())]
                n = hi - lo
                short = signature(h, cut).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, n), pa.array(np.diff(cut)), pa.array(digest, pa.binary()),
                                                  *(pa.array(np.ascontiguousarray(short[:, i])) for i in range(SIGNATURE)), pa.array(bitmaps(h, cut), pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())], names=names)
                if size >= FLUSH:
                    yield flush()
                    total[:], size = 0, 0
        yield flush()

    return docs.mapInArrow(releasing(run), "doc_id long, n long, digest binary, " + "".join(f"{c} long, " for c in SIG) + "bits binary, slot int, seen long")


def slot_ranks(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(slots, ranks) of the frequent slots, rank log2 of the count; at most SLOTS."""
    got = rows.where("digest is null").groupBy("slot").agg(F.sum("seen").alias("seen")).toArrow()
    slot, seen = got.column("slot").to_numpy(), got.column("seen").to_numpy()
    order = np.argsort(slot)
    return slot[order].astype(np.int32), np.ceil(np.log2(np.maximum(seen[order], 2))).astype(np.uint8)


def prefix_lists(docs: DataFrame, slots: np.ndarray, ranks: np.ndarray, words: int) -> DataFrame:
    """(token, salt, cid, n, pos): prefix shingles of each class, with their places in its
    order; salt -1, or 0 on for shingles of frequent slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank_of = np.zeros(SLOTS, np.uint8)
        rank_of[slots] = ranks
        sent: set[int] = set()
        for b in batches:
            for lo, hi, buf, offs in tb.row_chunks(b.column(1), tb.SMALL_CHUNK_BYTES):
                h, cut = shingle_sets(buf, offs, words)
                rank = rank_of[(h & tb.U64(SLOTS - 1)).astype(np.int64)]
                raw = memoryview(h.astype("<u8").tobytes())
                ids = b.column(0).slice(lo, hi - lo).is_valid().to_pylist()
                picks, cids, sizes, places = [], [], [], []
                for ok, a, z in zip(ids, cut[:-1].tolist(), cut[1:].tolist()):
                    if z == a or not ok:
                        continue
                    cid = class_key(hashlib.blake2b(raw[8 * a:8 * z], digest_size=16).digest())
                    if cid in sent:
                        continue
                    if len(sent) >= SEEN:
                        sent.clear()
                    sent.add(cid)
                    n = z - a
                    k = n - -(-NUM * n // DEN) + 1
                    r = rank[a:z]
                    # sorted by hash already: a stable sort by rank gives the order
                    picks.append(a + (np.argsort(r, kind="stable")[:k] if r.any() else np.arange(k)))
                    cids.append(np.full(k, cid, np.int64))
                    sizes.append(np.full(k, n, np.int32))
                    places.append(np.arange(k, dtype=np.int32))
                if picks:
                    at, cid = np.concatenate(picks), np.concatenate(cids)
                    salt = np.where(rank[at] > 0, (cid.view(np.uint64) >> tb.U64(7)).astype(np.int64) % 256, -1).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(salt), pa.array(cid), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(places))],
                                                     names=["token", "salt", "cid", "n", "pos"])

    return docs.mapInArrow(releasing(run), "token long, salt int, cid long, n int, pos int")


def meetings(lists: DataFrame, near: int = NEAR) -> DataFrame:
    """(token, cid, n, pos, other): candidate pairs (other set), and the rows that go to
    tiles (other null).  A task streams its shingles' lists in order of size and holds
    near + 1 rows of the last list between batches."""
    n = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if "pos" not in lists.columns:  # without places, any shingle may be the first in common
        lists = lists.withColumn("pos", F.lit(0))
    rows = lists.repartition(n, "token", "salt").sortWithinPartitions("token", "salt", "n", "cid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 5
        tiled = np.zeros(0, bool)  # held rows that went to tiles already
        for b in batches:
            old = len(tiled)
            token, salt, cid, size, pos = (np.concatenate([x, b.column(i).to_numpy()]) for i, x in enumerate(held))
            went = np.append(tiled, np.zeros(len(token) - old, bool))
            # rows that repeat a class go
            keep = np.append(True, (token[1:] != token[:-1]) | (salt[1:] != salt[:-1]) | (cid[1:] != cid[:-1])) if len(token) else np.zeros(0, bool)
            keep[:old] = True
            token, salt, cid, size, pos, went = (x[keep] for x in (token, salt, cid, size, pos, went))
            k = len(token)
            if not k:
                continue
            group = np.cumsum(np.append(False, (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])))
            # the first row of the list that is near enough in size
            key = group * (1 << 32) + size
            low = np.searchsorted(key, group * (1 << 32) + -(-NUM * size // DEN))
            at = np.arange(k)
            many = (at - low > near) & (salt < 0)
            rest = size - pos
            out = [[], [], [], []]
            for d in range(1, near + 1):
                i = at[max(old, d):]
                i = i[(i - d >= low[i]) & ((d == 1) | (~many[i] & (salt[i] < 0)))]
                # a shingle that comes too late in one of the sets can't be their first in common
                i = i[(NUM + DEN) * np.minimum(rest[i], rest[i - d]) >= NUM * (size[i] + size[i - d])]
                for x, y in zip(out, (token[i], cid[i], size[i], cid[i - d])):
                    x.append(y)
            # rows with many before them meet the others of those in tiles
            tile = salt >= 0
            for d in range(min(near + 2, k)):
                tile[:k - d] |= (many & (at - d >= low))[d:]
            tile &= ~went
            names = ["token", "cid", "n", "pos", "other"]
            a, b_, c, d_ = (np.concatenate(x) for x in out)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b_), pa.array(c.astype(np.int32)), pa.nulls(len(a), pa.int32()), pa.array(d_)], names=names)
            if tile.any():
                yield pa.RecordBatch.from_arrays([pa.array(token[tile]), pa.array(cid[tile]), pa.array(size[tile].astype(np.int32)), pa.array(pos[tile].astype(np.int32)),
                                                  pa.nulls(int(tile.sum()), pa.int64())], names=names)
            last = np.flatnonzero(group == group[-1])[-(near + 1):]
            held, tiled = [x[last] for x in (token, salt, cid, size, pos)], (went | tile)[last]

    return rows.mapInArrow(releasing(run), "token long, cid long, n int, pos int, other long")


def texts_of(docs: DataFrame, reps: DataFrame, words: int) -> DataFrame:
    """(cid, text) of the classes' first documents: reps (cid, doc_id).  Other documents'
    texts are filtered out before the join's shuffle."""
    rows = docs.where(may_be_among(reps.select("doc_id"), "doc_id")).join(reps.select("doc_id", F.col("cid").alias("want")), "doc_id").select("doc_id", "text", "want")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offs in tb.row_chunks(b.column(1), tb.SMALL_CHUNK_BYTES):
                h, cut = shingle_sets(buf, offs, words)
                raw = memoryview(h.astype("<u8").tobytes())
                cid = np.array([class_key(hashlib.blake2b(raw[8 * a:8 * z], digest_size=16).digest()) for a, z in zip(cut[:-1].tolist(), cut[1:].tolist())], np.int64)
                # of a repeated id, the document that is in the class
                keep = np.flatnonzero(cid == b.column(2).slice(lo, hi - lo).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(cid[keep]), b.column(1).slice(lo, hi - lo).take(pa.array(keep))], names=["cid", "text"])

    return rows.mapInArrow(releasing(run), "cid long, text string")


def size_fits(a: str, b: str):
    return (F.col(f"{a}.n") * DEN >= F.col(f"{b}.n") * NUM) & (F.col(f"{b}.n") * DEN >= F.col(f"{a}.n") * NUM)


def place_fits(a: str, b: str):
    """Whether a shingle can be the first in common, in the shared order, of two sets that
    link: all they share comes from there on, at least s / (1 + s) (|A| + |B|)."""
    return F.least(F.col(f"{a}.n") - F.col(f"{a}.pos"), F.col(f"{b}.n") - F.col(f"{b}.pos")) * (NUM + DEN) >= (F.col(f"{a}.n") + F.col(f"{b}.n")) * NUM


def short_fits(a: str, b: str):
    """The bound by short bitmaps, in SQL: |A ^ B| = |A| + |B| - 2 |A & B| and
    |A & B| >= s / (1 + s) (|A| + |B|)."""
    differ = sum((F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(SIGNATURE)), F.lit(0))
    return differ * (NUM + DEN) <= (F.col(f"{a}.n") + F.col(f"{b}.n")) * (DEN - NUM)


def may_link(pairs: DataFrame, a: str, b: str, sigs: DataFrame) -> DataFrame:
    """The rows of pairs whose classes in columns a and b pass the bounds."""

    @F.arrow_udf("boolean")
    def bits_fit(n: pa.Array, bits: pa.Array, m: pa.Array, other: pa.Array) -> pa.Array:
        return pa.array([differing(x, y) * (NUM + DEN) <= (k + j) * (DEN - NUM)
                         for k, x, j, y in zip(n.to_pylist(), bits.to_pylist(), m.to_pylist(), other.to_pylist())], pa.bool_())

    short = sigs.drop("bits")
    got = (pairs.join(short.alias("x"), F.col(a) == F.col("x.cid")).join(short.alias("y"), F.col(b) == F.col("y.cid"))
           .where(size_fits("x", "y") & short_fits("x", "y")).select(*[pairs[c] for c in pairs.columns], F.col("x.n").alias("_n"), F.col("y.n").alias("_m")))
    # the long bitmaps travel only with pairs that passed the short ones
    long = sigs.select("cid", "bits")
    got = got.join(long.alias("x"), F.col(a) == F.col("x.cid")).join(long.alias("y"), F.col(b) == F.col("y.cid"))
    return got.where(bits_fit("_n", "x.bits", "_m", "y.bits")).select(*pairs.columns)


def verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, words: int) -> DataFrame:
    """The pairs (a, b) that link, by exact intersection.  Only the texts of their classes
    are fetched."""
    pairs = pairs.select("a", "b").checkpoint()
    ask = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
    wanted = reps.join(ask, "cid", "left_semi").checkpoint()
    texts = stored(texts_of(docs, wanted, words), "jaccard-texts")
    rows = (pairs.join(texts.select(F.col("cid").alias("a"), F.col("text").alias("ta")), "a")
            .join(texts.select(F.col("cid").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offs in tb.row_chunks(b.column(2), tb.SMALL_CHUNK_BYTES):
                ha, ca = shingle_sets(buf, offs, words)
                hb, cb = shingle_sets(*tb.string_buffer(b.column(3).slice(lo, hi - lo)), words)
                keep = []
                for i in range(hi - lo):
                    x, y = ha[ca[i]:ca[i + 1]], hb[cb[i]:cb[i + 1]]
                    at = np.searchsorted(x, y)
                    at[at == len(x)] = 0
                    both = int((x[at] == y).sum()) if len(x) else 0
                    keep.append(DEN * both >= NUM * (len(x) + len(y) - both) and both > 0)
                at = pa.array(np.flatnonzero(keep))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo).take(at), b.column(1).slice(lo, hi - lo).take(at)], names=["a", "b"])

    return rows.mapInArrow(releasing(run), "a long, b long")


def merged(comp: DataFrame | None, links: DataFrame) -> DataFrame:
    """(cid, comp) after more links (a, b) between classes."""
    if comp is not None and links.isEmpty():
        return comp
    if comp is not None:
        # components of components: earlier links are in the labels already
        for c in ("a", "b"):
            links = links.join(comp.select(F.col("cid").alias(c), F.col("comp").alias(f"{c}2")), c, "left").withColumn(c, F.coalesce(f"{c}2", c)).drop(f"{c}2")
    label = component_labels(links)
    new = label.select(F.col("id").alias("cid"), F.col("label").alias("comp"))
    if comp is not None:
        old = comp.join(label, F.col("comp") == F.col("id"), "left").select("cid", F.coalesce("label", "comp").alias("comp"))
        new = old.unionByName(new.join(comp, "cid", "left_anti"))
    return new.checkpoint()


def class_components(docs: DataFrame, sums: DataFrame, slots, ranks, words: int, rounds: int, near: int) -> DataFrame:
    """(cid, comp) of the classes that link to another one."""
    met = stored(meetings(prefix_lists(docs, slots, ranks, words), near), "jaccard-met")
    pairs = met.where("other is not null").select(F.col("cid").alias("a"), F.col("other").alias("b")).distinct().checkpoint()
    tiled = met.where("other is null").select("token", "cid", "n", "pos").distinct().checkpoint()
    in_tiles = tiled.select("cid").distinct()
    ours = sums.where("digest is not null and n > 0 and doc_id is not null")
    classes = (ours.groupBy(F.col("k").alias("cid")).agg(F.min("doc_id").alias("doc_id"), F.min("n").cast("int").alias("n"), *[F.min(c).alias(c) for c in SIG], F.min("bits").alias("bits"))
               .join(pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).union(in_tiles).distinct(), "cid", "left_semi").checkpoint())
    sigs, reps = classes.drop("doc_id"), classes.select("cid", "doc_id")
    comp = merged(None, verified(may_link(pairs, "a", "b", sigs), docs, reps, words).checkpoint())
    if tiled.isEmpty():
        return comp
    sigs = sigs.join(in_tiles, "cid", "left_semi").checkpoint()
    # whole lists first: most are within one component by now
    rows = tiled.join(comp, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    open_lists = rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(DEN / NUM))).cast("int")
    tiles = rows.join(open_lists, "token", "left_semi").select("token", "cid", "n", "pos", F.explode(F.array(band, band + 1)).alias("band")).checkpoint()
    key = ["token", "band"]
    r = 0
    while True:
        rows = tiles.join(comp, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
        # by component first, so that a large one is a row of its tile
        seeds = [r * PIVOTS + i for i in range(PIVOTS)] if r < rounds else []
        parts = rows.groupBy(*key, "comp").agg(F.count("*").alias("k"), *[F.min(F.struct(F.xxhash64("cid", F.lit(x)).alias("h"), "cid", "n", "pos", "comp")).alias(f"p{x}") for x in seeds])
        open_tiles = (parts.groupBy(*key).agg(F.max(F.struct("k", "comp")).alias("most"), F.count("*").alias("parts"), *[F.min(f"p{x}").alias(f"p{x}") for x in seeds])
                      .where("parts > 1").select(*key, F.col("most.comp").alias("major"), *[f"p{x}" for x in seeds]))
        rows = rows.join(open_tiles, key).checkpoint()
        if rows.isEmpty():
            return comp  # all tiles are closed
        tiles = rows.select("token", "cid", "n", "pos", "band")
        if r < rounds:
            cand = (rows.select(F.struct("n", "pos").alias("x"), "cid", "comp", F.explode(F.array(*[f"p{x}" for x in seeds])).alias("p")).where((F.col("comp") != F.col("p.comp")) & place_fits("x", "p"))
                    .select(F.col("cid").alias("mine"), F.col("p.cid").alias("pivot")).distinct())
            found = may_link(cand, "mine", "pivot", sigs).select(F.least("mine", "pivot").alias("a"), F.greatest("mine", "pivot").alias("b")).distinct()
        else:
            sized = rows.select(*key, "cid", "comp", "pos", (F.col("comp") != F.col("major")).alias("minor")).join(sigs.drop("bits"), "cid")
            found = (sized.where("minor").alias("x").join(sized.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.band") == F.col("y.band"))
                                                        & (F.col("x.comp") != F.col("y.comp")) & (~F.col("y.minor") | (F.col("x.cid") < F.col("y.cid")))
                                                        & size_fits("x", "y") & place_fits("x", "y") & short_fits("x", "y"))
                     .select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b")).distinct())
            found = may_link(found, "a", "b", sigs)
        links = verified(found, docs, reps, words).checkpoint()
        comp = merged(comp, links)
        if r >= rounds:
            return comp
        # pivots that link to nothing any more leave the rest to all pairs
        r = rounds if links.isEmpty() else r + 1


def _components(docs: DataFrame, id_col: str, text_col: str, words: int, rounds: int, near: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, cid) of every row, the class null where it links with nothing; and (cid,
    low, comp) of every class, low its smallest id."""
    prepare(docs.sparkSession, SMALL_BATCH_BYTES)
    d = _slim(docs, id_col, text_col)
    raw = stored(summaries(d, words), "jaccard-sets")
    slots, ranks = slot_ranks(raw)
    low8 = F.concat(*[F.substring(F.hex("digest"), 2 * i + 1, 2) for i in range(7, -1, -1)])
    # the digest's first 8 bytes as a signed little-endian number, as class_key() has it
    sums = raw.withColumn("k", F.conv(low8, 16, -10).cast("long"))
    comp = class_components(d, sums, slots, ranks, words, rounds, near)
    rows = sums.where("digest is not null").select("doc_id", "n", F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("k")).alias("cid"))
    # the smallest id of each class first, so that a class of a third of all rows is one row from here
    low = (rows.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("low")).join(comp, "cid", "left")
           .withColumn("comp", F.coalesce("comp", "cid")))
    return rows, low


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, rounds: int = PIVOT_ROUNDS,
                    near: int = NEAR) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    rows, low = _components(docs, id_col, text_col, words, rounds, near)
    of = low.groupBy("comp").agg(F.min("low").alias("component_id"))
    label = low.join(of, "comp").select("cid", "component_id")
    return (rows.join(label, "cid", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")))


def class_of(words: int):
    """The class key of a text, null for an empty set."""

    @F.arrow_udf("long")
    def key(text: pa.Array) -> pa.Array:
        out = []
        for _, _, buf, offs in tb.row_chunks(text, tb.SMALL_CHUNK_BYTES):
            h, cut = shingle_sets(buf, offs, words)
            raw = memoryview(h.astype("<u8").tobytes())
            out += [class_key(hashlib.blake2b(raw[8 * a:8 * z], digest_size=16).digest()) if z > a else None for a, z in zip(cut[:-1].tolist(), cut[1:].tolist())]
        return pa.array(out, pa.int64())

    return key


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row for each component, of its smallest id, with all its columns; of several
    with that id one of the smallest class.  Of rows without shingles that repeat both id
    and text one stays.  Null ids stay.

    Rows are told apart by id and class, so rows that share an id but not their text are
    decided each on its own.  Only documents that may go or repeat are shuffled; the
    others are passed on.  They are written first: the id filter and the classes each ask
    Python, and a stage that holds both has two workers a task, which stay."""
    rows, low = _components(docs, id_col, text_col, words, PIVOT_ROUNDS, NEAR)
    lead = low.groupBy("comp").agg(F.min(F.struct("low", "cid")).alias("lead"))
    label = low.join(lead, "comp").select("cid", F.col("lead.low").alias("lead_id"), F.col("lead.cid").alias("lead_cid"))
    found = stored(rows.join(label, "cid", "left").select("doc_id", "cid", F.expr("cid is not null and (cid <> lead_cid or doc_id <> lead_id)").alias("goes")), "jaccard-components")
    gone = found.where("goes").select("doc_id", "cid").distinct()
    again = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    asked = F.coalesce(may_be_among(gone.select("doc_id").union(again), id_col), F.lit(False))
    cid, same = "class of one_of_each", "what repeats in one_of_each"
    kept = (stored(docs.where(asked), "jaccard-asked").withColumn(cid, class_of(words)(F.col(text_col).cast("string")))
            .join(gone.select(F.col("doc_id").alias(id_col), F.col("cid").alias(cid)), [id_col, cid], "left_anti")
            .withColumn(same, F.when(F.col(cid).isNull(), F.col(text_col).cast("string"))).dropDuplicates([id_col, cid, same]).select(*docs.columns))
    return docs.where(~asked).unionByName(kept)


#: DuckDB SQL of near_duplicates(documents): all pairs that share a shingle, counted.
ORACLE = r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D ]+'), lambda x: x <> '') as ws
  from documents),
s as (
  select distinct doc_id, unnest(case when len(ws) >= 5 then list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                      when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as shingle from w),
n as (select doc_id, count(*) as n from s group by doc_id),
links as (
  select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as k from s x join s y using (shingle) where x.doc_id <> y.doc_id group by all)
  join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * k >= 80 * (na.n + nb.n - k)),
reach as (select distinct a as id, a as r from links union select reach.id, links.b from reach join links on links.a = reach.r)
select doc_id, coalesce(n.n, 0) as n_shingles, coalesce(c, doc_id) as component_id
from documents left join n using (doc_id) left join (select id as doc_id, min(r) as c from reach group by id) using (doc_id)
"""
