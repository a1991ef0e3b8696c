"""Conversation prefix trie in minimal-perfect-hash node tables.

Nodes are the distinct sequences of first turns of rebuilt conversations.  A turn's
digest is the SHA-256 of its role and text, cut to 128 bits.  A prefix's digest is the
sum, modulo 2**64 in each of two lanes, of its turns' digests mixed with their places,
so it is a running sum that can be taken in parts.

1. Rows are dealt by ranges of (conversation, turn); a task numbers its rows and sums its
   prefixes, and what a conversation brought from earlier ranges is added from a row
   for each range.  A conversation of any length is so spread over tasks.
2. Conversations with equal whole digests form a class, which goes on as one path with
   a weight, however many there are.  A third lane must agree within a class.
3. Paths are cut into shards: whole subtrees of at most LIMIT rows, at the first depth
   1, 2, 4, .. where the rows below a prefix are few enough.
4. A shard enumerates its distinct prefix digests and gives each a slot by a minimal
   perfect hash (levels of bitmaps of the keys that are alone in their place, slots by
   rank).  Each row's second lane, turn and parent must equal its slot's, else the
   digests collide and the job raises.  Counts are scattered into flat arrays by slot,
   and sums over subtrees go up through the array of parent slots in order of depth.
5. The crown above the cuts takes a shard's totals from its top.  A node belongs to its
   smallest member; what a path owns is summed from its end upwards, and a crown node's
   totals are the sums of its paths' parts.  No step loops over depths there.
6. A node's ends are hashed as they stream by in order, from texts of many ids that
   range tasks have joined, so that even a third of all ids is few rows for one task.

Defined cases: rows without a conversation id are left out; null roles and texts are
empty; null turns come first; rows of a conversation with equal turns are in order of
the SHA-256 of their role's length in bytes, a colon, role and text, so repeated rows
are turns of their own; a conversation without turns after rebuilding is a member of
the root; other columns are ignored, whatever their names; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routewise.llm import textblocks as tb
from routewise.llm.common import prepare, stored

#: Conversations that share a base, and the most turns they take from it.
FAMILY, SHARED = 20, 3
#: Rows of a shard at most.
LIMIT = 1 << 17
#: Ids that are joined to one text.
PIECE = 4096
#: Rows of a side that is broadcast at most.
SMALL = 10_000
NO_ENDS = hashlib.sha256(b"").hexdigest()
U64 = tb.U64


# ---- running sums -------------------------------------------------------------------

def running(df: DataFrame, key: str, order: list, adds: list[str], name: str) -> DataFrame:
    """df with the long columns adds as running sums modulo 2**64 over the rows of a key
    in this order, and <add>_before without the row's own.  Ranges of (key, order) are
    tasks of their own; a row for each range, of at most all shuffle partitions, passes
    through the driver to carry a key's sums on."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, key, *order).sortWithinPartitions(key, *order)
    cols = df.columns
    rest = [i for i, c in enumerate(cols) if c not in adds]
    names = [cols[i] for i in rest] + [c for a in adds for c in (a, f"{a}_before")] + ["part", "edge"]
    types = dict(df.dtypes)
    schema = ", ".join(f"`{cols[i]}` {types[cols[i]]}" for i in rest) + "".join(f", {a} long, {a}_before long" for a in adds) + ", part int, edge int"
    at, where = [cols.index(a) for a in adds], cols.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last_key, carry, held, first = None, [U64(0)] * len(at), None, True
        for b in batches:
            m = len(b)
            if not m:
                continue
            k = b.column(where).to_numpy()
            starts = np.append(True, k[1:] != k[:-1])
            group = np.cumsum(starts) - 1
            head = np.flatnonzero(starts)
            out = [b.column(i) for i in rest]
            for j, i in enumerate(at):
                v = b.column(i).to_numpy().view(np.uint64)
                total = np.cumsum(v, dtype=np.uint64)
                base = np.where(head > 0, total[head - 1], U64(0))
                total = total - base[group]
                if last_key is not None and k[0] == last_key:
                    total[group == 0] += carry[j]
                carry[j] = total[-1]
                out += [pa.array(total.view(np.int64)), pa.array((total - v).view(np.int64))]
            last_key = k[-1]
            edge = np.zeros(m, np.int32)
            edge[0] |= int(first)
            first = False
            if held is not None:
                yield pa.RecordBatch.from_arrays(held, names=names)
            held = [*out, pa.array(np.full(m, part, np.int32)), pa.array(edge)]
        if held is not None:
            edge = held[-1].to_numpy().copy()
            edge[-1] |= 2
            yield pa.RecordBatch.from_arrays([*held[:-1], pa.array(edge)], names=names)

    got = stored(rows.mapInArrow(run, schema), name)
    ends: dict[int, dict[int, tuple]] = {}
    for r in got.where("edge > 0").select("part", "edge", key, *adds).collect():  # two rows a range at most
        for bit in (1, 2):
            if r["edge"] & bit:
                ends.setdefault(r["part"], {})[bit] = (r[key], [r[a] % (1 << 64) for a in adds])
    carried: dict[int, tuple[int, list[int]]] = {}
    before = None
    for p in sorted(ends):
        (first_key, _), (last_key, sums) = ends[p][1], ends[p][2]
        if before is not None and before[0] == first_key:
            carried[p] = before
            if last_key == first_key:
                sums = [(x + y) % (1 << 64) for x, y in zip(sums, before[1])]
        before = (last_key, sums)
    out = [c for c in got.columns if c not in ("part", "edge")]
    if not carried:
        return got.select(*out)
    here, kept = got.columns, [got.columns.index(c) for c in out]
    moved = [(here.index(c), j) for j, a in enumerate(adds) for c in (a, f"{a}_before")]
    k_at, p_at = here.index(key), here.index("part")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, k = b.column(p_at).to_numpy(), b.column(k_at).to_numpy()
            arrays = list(b.columns)
            for p in np.unique(part).tolist():
                if p in carried:
                    rows = (part == p) & (k == carried[p][0])
                    for i, j in moved:
                        v = arrays[i].to_numpy(zero_copy_only=False).view(np.uint64).copy()
                        v[rows] += U64(carried[p][1][j])
                        arrays[i] = pa.array(v.view(np.int64))
            yield pa.RecordBatch.from_arrays([arrays[i] for i in kept], names=out)

    return got.mapInArrow(add, got.select(*out).schema)


# ---- turns, rebuilt conversations, prefix digests -----------------------------------

def turn_digests(df: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, turn, digest, words, idx): idx is 1 for each row, to be summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offs in tb.row_chunks(b.column(3)):
                _, _, row_word = tb.word_spans(buf, offs, tb.NOT_SPACE)
                raw, at = buf.tobytes(), offs.tolist()
                digest = []
                for i, role in enumerate(b.column(2).slice(lo, hi - lo).to_pylist()):
                    role = (role or "").encode()
                    digest.append(hashlib.sha256(b"%d:%s%s" % (len(role), role, raw[at[i]:at[i + 1]])).digest()[:16])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(digest, pa.binary()), pa.array(np.diff(row_word).astype(np.int64)),
                                                  pa.array(np.ones(hi - lo, np.int64))], names=["conv_id", "turn", "digest", "words", "idx"])

    rows = df.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    return rows.where("conv_id is not null").mapInArrow(run, "conv_id long, turn long, digest binary, words long, idx long")


def shared_turns(conv: str = "conv_id"):
    """Turns that a conversation takes from its base."""
    return (F.crc32(F.col(conv).cast("string")) % (SHARED + 1)).cast("long")


def rebuilt(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (conv_id, idx, digest, words): convs (conv_id, len) and the rows (conv_id,
    len, pos, digest, words) of the rebuilt conversations."""
    of_base = F.col("conv_id") - F.col("conv_id") % FAMILY
    count = numbered.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("base", of_base).withColumn("h", shared_turns())
    bases = count.where("conv_id = base").select("base", F.col("n").alias("n_base"))
    convs = (count.join(bases, "base", "left").withColumn("m", F.least("h", F.coalesce("n_base", F.lit(0))))
             .select("conv_id", "h", "m", (F.greatest(F.col("n") - F.col("h"), F.lit(0)) + F.col("m")).alias("len")))
    convs = stored(convs, "trie-convs")
    own = (numbered.join(convs, "conv_id").where("idx > h")
           .select("conv_id", "len", (F.col("idx") - F.col("h") + F.col("m")).alias("pos"), "digest", "words"))
    # ids are on both sides of a base that is 0, else on the side away from 0
    member = F.explode(F.array(*[F.lit(i) for i in range(1 - FAMILY, FAMILY)]))
    lent = (numbered.where((F.col("conv_id") == of_base) & (F.col("idx") <= SHARED))
            .select(F.col("conv_id").alias("base"), "idx", "digest", "words", member.alias("off"))
            .select("base", "idx", "digest", "words", F.try_add(F.col("base"), F.col("off").cast("long")).alias("conv_id"))
            .where((of_base == F.col("base")) & (F.col("idx") <= shared_turns()))
            .join(convs.select("conv_id", "len"), "conv_id").select("conv_id", "len", F.col("idx").alias("pos"), "digest", "words"))
    return convs.select("conv_id", "len"), own.unionByName(lent)


_PLACE = [U64(0xA24BAED4963EE407), U64(0x9FB21C651E98DF25), U64(0xD1342543DE82EF95)]


def placed(rows: DataFrame) -> DataFrame:
    """rows with the digest as two numbers (la, lb) and its parts of the prefix digests
    (ha, hb, hc) at its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = np.frombuffer(b"".join(b.column(3).to_pylist()), "<u8").reshape(-1, 2)
            la, lb, pos = d[:, 0].copy(), d[:, 1].copy(), b.column(2).to_numpy().view(np.uint64)
            adds = [tb.mix(v + tb.mix(pos ^ s)) for v, s in zip((la, lb, la ^ tb.mix(lb)), _PLACE)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(4), *(pa.array(x.view(np.int64)) for x in (la, lb, *adds))],
                                             names=["conv_id", "len", "pos", "words", "la", "lb", "ha", "hb", "hc"])

    return rows.select("conv_id", "len", "pos", "digest", "words").mapInArrow(run, "conv_id long, len long, pos long, words long, la long, lb long, ha long, hb long, hc long")


# ---- classes of equal conversations, with the hash of their ids ---------------------

def classes(ends: DataFrame) -> DataFrame:
    """From (conv_id, len, ha, hb, hc) of whole conversations: (cid, len, ha, hb, n, ends),
    cid the smallest of n equal ones, ends the hash of all their ids."""
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["ha", "hb", "len"]

    def join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(i).to_numpy() for i in range(5)]
            ids = cols[4]
            new = np.ones(len(ids), bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0) if len(ids) else False
            cut = np.flatnonzero(new).tolist() + [len(ids)]
            at = [(i, min(i + PIECE, z)) for a, z in zip(cut[:-1], cut[1:]) for i in range(a, z, PIECE)]
            first = np.array([a for a, _ in at], np.int64)
            text = [",".join(map(str, ids[a:z].tolist())) for a, z in at]
            yield pa.RecordBatch.from_arrays([*(pa.array(c[first]) for c in cols), pa.array([z - a for a, z in at], pa.int64()), pa.array(text, pa.string())],
                                             names=["ha", "hb", "len", "hc", "cid", "n", "ids"])

    def hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("cid", pa.int64()), ("len", pa.int64()), ("ha", pa.int64()), ("hb", pa.int64()), ("n", pa.int64()), ("ends", pa.string())])
        now, check, cid, count, sha, out = None, None, 0, 0, None, []
        for b in batches:
            for ha, hb, size, hc, first, k, ids in zip(*(b.column(i).to_pylist() for i in range(7))):
                if now != (ha, hb, size):
                    if now:
                        out.append((cid, now[2], now[0], now[1], count, sha.hexdigest()))
                    now, check, cid, count, sha = (ha, hb, size), hc, first, 0, hashlib.sha256()
                elif hc != check:
                    raise RuntimeError("digests of different conversations collide")
                sha.update((("," if count else "") + ids).encode())
                count += k
            if len(out) >= 1 << 14:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if now:
            out.append((cid, now[2], now[0], now[1], count, sha.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    # the third lane is not part of a class; it only has to agree
    pieces = (ends.select(*key, "hc", "conv_id").repartitionByRange(n, *key, "conv_id").sortWithinPartitions(*key, "conv_id")
              .mapInArrow(join_ids, "ha long, hb long, len long, hc long, cid long, n long, ids string"))
    return (pieces.repartition(n, *key).sortWithinPartitions(*key, "cid")
            .mapInArrow(hash_ids, "cid long, len long, ha long, hb long, n long, ends string"))


# ---- node tables --------------------------------------------------------------------

class Slots:
    """Minimal perfect hash of distinct 64-bit keys onto 0 .. n - 1, in levels: a key
    has its slot at the first level where it is alone in its place."""

    def __init__(self, keys: np.ndarray):
        self.levels, rest, given = [], keys, 0
        while len(rest):
            size = max(16, 2 * len(rest))
            at = self._place(rest, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append(np.where(alone, np.cumsum(alone) - 1 + given, -1))
            given += int(alone.sum())
            rest = rest[~alone[at]]
            if len(self.levels) > 200:
                raise RuntimeError("keys of the node table are not distinct")
        self.key = np.zeros(given, np.uint64)
        self.key[self._find(keys)] = keys

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (tb.mix(keys ^ tb.mix(np.array([level + 1], np.uint64))) % U64(size)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for i, level in enumerate(self.levels):
            got = level[self._place(keys[open_], i, len(level))]
            out[open_] = got
            open_ = open_[got < 0]
        return out

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Slots of keys; raises for one that isn't in the table."""
        out = self._find(keys)
        if len(out) and (out.min() < 0 or (self.key[out] != keys).any()):
            raise RuntimeError("a prefix is not in its shard's node table")
        return out


def node_table(pos, top, ha, hb, pa_, pb, la, lb, words, cid, n):
    """The nodes of whole shards from their rows: flat arrays by slot.  top marks rows
    of the shards' uppermost nodes, whose parents are elsewhere."""
    slots = Slots(np.unique(ha))
    size = len(slots.key)
    slot = slots.of(ha)
    depth, lane, turn_a, turn_b, word, up_b = (np.zeros(size, x.dtype) for x in (pos, hb, la, lb, words, pb))
    uppermost = np.zeros(size, bool)
    for flat, x in ((depth, pos), (lane, hb), (turn_a, la), (turn_b, lb), (word, words), (up_b, pb), (uppermost, top)):
        flat[slot] = x
    if any((flat[slot] != x).any() for flat, x in ((depth, pos), (lane, hb), (turn_a, la), (turn_b, lb), (uppermost, top))):
        raise RuntimeError("digests of different prefixes collide")
    up_a = np.zeros(size, np.uint64)
    up_a[slot] = pa_
    parent = np.full(size, -1, np.int64)
    inner = np.flatnonzero(~uppermost)
    parent[inner] = slots.of(up_a[inner])
    if (lane[parent[inner]] != up_b[inner]).any() or (depth[parent[inner]] != depth[inner] - 1).any() or (up_a[slot] != pa_).any() or (up_b[slot] != pb).any():
        raise RuntimeError("digests of different prefixes collide")
    convs = np.zeros(size, np.int64)
    np.add.at(convs, slot, n)
    least = np.full(size, np.iinfo(np.int64).max)
    np.minimum.at(least, slot, cid)
    children = np.zeros(size, np.int64)
    np.add.at(children, parent[inner], 1)
    leaves, saved = (children == 0).astype(np.int64), (convs - 1) * word
    order = inner[np.argsort(-depth[inner], kind="stable")]
    ends = np.append(np.flatnonzero(np.diff(depth[order])) + 1, len(order)) if len(order) else []
    lo = 0
    for hi in ends:  # one depth at a time, the deepest first
        at = order[lo:hi]
        np.add.at(leaves, parent[at], leaves[at])
        np.add.at(saved, parent[at], saved[at])
        lo = hi
    above = np.where(parent >= 0, least[parent], 0)
    return slot, {"depth": depth, "ha": slots.key, "hb": lane, "pa": up_a, "pb": up_b, "conv_id": least, "parent_conv_id": above, "n_convs": convs, "n_children": children,
                  "n_leaves": leaves, "saved_tokens": saved}, uppermost


NODE = "depth long, ha long, hb long, pa long, pb long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def shard_nodes(rows: DataFrame, limit: int) -> DataFrame:
    """Nodes of all shards from rows (ka, kb, cut, pos, ha, hb, pa, pb, la, lb, words,
    cid, n, ends), ends null but at a path's end."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = ["ka", "kb", "pos", "cut", "ha", "hb", "pa", "pb", "la", "lb", "words", "cid", "n", "ends"]
    lanes = {"ha", "hb", "pa", "pb", "la", "lb"}

    def nodes(t: pa.Table) -> pa.RecordBatch:
        x = {c: t.column(c).to_numpy().view(np.uint64) if c in lanes else t.column(c).to_numpy() for c in cols[2:-1]}
        slot, flat, top = node_table(x["pos"], x["pos"] == x["cut"], x["ha"], x["hb"], x["pa"], x["pb"], x["la"], x["lb"], x["words"], x["cid"], x["n"])
        here = np.flatnonzero(t.column("ends").is_valid().to_numpy())
        from_row = np.full(len(top), -1, np.int64)
        from_row[slot[here]] = here
        ends = t.column("ends").combine_chunks().take(pa.array(from_row, mask=from_row < 0))
        out = [pa.array(v.view(np.int64)) for v in flat.values()]
        i = list(flat).index("parent_conv_id")
        out[i] = pa.array(flat["parent_conv_id"], mask=top)
        return pa.RecordBatch.from_arrays([*out, ends, pa.array(top)], names=[*flat, "ends", "top"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not len(b):
                continue
            held.append(b)
            if sum(len(x) for x in held) < limit:
                continue
            # whole shards only: the last one may go on in the next batch
            t = pa.Table.from_batches(held)
            ka, kb = t.column("ka").to_numpy(), t.column("kb").to_numpy()
            start = int(np.flatnonzero((ka != ka[-1]) | (kb != kb[-1]))[-1]) + 1 if ka[0] != ka[-1] or kb[0] != kb[-1] else 0
            if start:
                yield nodes(t.slice(0, start))
            held = t.slice(start).to_batches()
        if held:
            yield nodes(pa.Table.from_batches(held))

    return (rows.select(*cols).repartition(n, "ka", "kb").sortWithinPartitions("ka", "kb", "pos")
            .mapInArrow(run, NODE + ", ends string, top boolean"))


# ---- crown --------------------------------------------------------------------------

def crown_nodes(rows: DataFrame, tops: DataFrame) -> DataFrame:
    """Nodes above the cuts, from the rows (cid, n, pos, ha, hb, pa, pb, la, lb, words,
    ends) there and the shards' uppermost nodes."""
    spark = rows.sparkSession
    at = ["pos", "ha", "hb"]
    same = [F.min(c).eqNullSafe(F.max(c)) for c in ("la", "lb", "pa", "pb")]
    nodes = (rows.groupBy(*at).agg(F.sum("n").alias("n_convs"), F.min("cid").alias("conv_id"), F.min("words").alias("words"), F.min("pa").alias("pa"), F.min("pb").alias("pb"),
                                   F.max("ends").alias("ends"), (same[0] & same[1] & same[2] & same[3]).alias("one"))
             .withColumn("n_convs", F.when(F.col("one"), F.col("n_convs")).otherwise(F.raise_error(F.lit("digests of different prefixes collide")).cast("long"))).drop("one"))
    nodes = stored(nodes, "trie-crown")
    under = nodes.where("pos > 0").select((F.col("pos") - 1).alias("pos"), F.col("pa").alias("ha"), F.col("pb").alias("hb")).unionByName(
        tops.select((F.col("depth") - 1).alias("pos"), F.col("pa").alias("ha"), F.col("pb").alias("hb")))
    kids = under.groupBy(*at).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(kids, at, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-crown")
    # what a path owns: crown nodes of which it is the smallest member, and a shard's totals
    own = nodes.select(F.col("conv_id").alias("cid"), "pos", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaves"))
    given = tops.select(F.col("conv_id").alias("cid"), F.col("depth").alias("pos"), F.col("saved_tokens").alias("saved"), F.col("n_leaves").alias("leaves"))
    owners = own.select("cid").union(given.select("cid")).distinct()
    steps = (rows.select("cid", *at).join(owners, "cid", "left_semi").join(own, ["cid", "pos"], "left")
             .unionByName(given, allowMissingColumns=True)
             .select("cid", (-F.col("pos")).alias("up"), "ha", "hb", F.coalesce("saved", F.lit(0)).alias("saved"), F.coalesce("leaves", F.lit(0)).alias("leaves")))
    total = (running(stored(steps, "trie-steps"), "cid", ["up"], ["saved", "leaves"], "trie-crown-sums").where("ha is not null")
             .groupBy((-F.col("up")).alias("pos"), "ha", "hb").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves")))
    out = nodes.join(total, at)
    above = nodes.select((F.col("pos") + 1).alias("pos"), F.col("ha").alias("pa"), F.col("hb").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    small = nodes.count() <= SMALL
    above = F.broadcast(above) if small else above
    out = out.join(above, ["pos", "pa", "pb"], "left").withColumnRenamed("pos", "depth")
    tops = tops.drop("parent_conv_id").join(above.withColumnRenamed("pos", "depth"), ["depth", "pa", "pb"])
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    return out.select(*cols).unionByName(tops.select(*cols))


def trie(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    prepare(df.sparkSession)
    numbered = running(stored(turn_digests(df, id_col, turn_col, role_col, text_col), "trie-turns"), "conv_id", ["turn", "digest"], ["idx"], "trie-numbered")
    convs, rows = rebuilt(numbered.drop("idx_before", "turn"))
    paths = running(stored(placed(rows), "trie-rows"), "conv_id", ["pos"], ["ha", "hb", "hc"], "trie-paths").drop("hc_before")
    zero = [F.lit(0).cast("long").alias(c) for c in ("ha", "hb", "hc")]
    whole = paths.where("pos = len").select("conv_id", "len", "ha", "hb", "hc").unionByName(convs.where("len = 0").select("conv_id", "len", *zero))
    groups = stored(classes(whole), "trie-classes")
    # from here each class is one path, with the hash of its ids at its end
    path = stored(paths.join(groups.select(F.col("cid").alias("conv_id"), "n", "ends"), "conv_id")
                  .select(F.col("conv_id").alias("cid"), "n", "len", "pos", "ha", "hb", F.col("ha_before").alias("pa"), F.col("hb_before").alias("pb"), "la", "lb", "words",
                          F.when(F.col("pos") == F.col("len"), F.col("ends")).alias("ends")), "trie-classpaths")
    heavy = stored(path.where("(pos & (pos - 1)) = 0").groupBy("pos", "ha", "hb").agg(F.sum(F.col("len") - F.col("pos") + 1).alias("below")).where(F.col("below") > limit), "trie-heavy")
    if heavy.isEmpty():
        path = path.withColumn("cut", F.lit(1).cast("long"))
    else:
        cuts = path.where("(pos & (pos - 1)) = 0").join(heavy, ["pos", "ha", "hb"], "left_semi").groupBy("cid").agg((2 * F.max("pos")).alias("cut"))
        path = stored(path.join(cuts, "cid", "left").withColumn("cut", F.coalesce("cut", F.lit(1).cast("long"))), "trie-cut")
    keys = path.where("pos = cut").select("cid", F.col("ha").alias("ka"), F.col("hb").alias("kb"))
    low = stored(shard_nodes(path.where("pos >= cut").join(keys, "cid"), limit), "trie-nodes")
    cols = ["cid", "n", "pos", "ha", "hb", "pa", "pb", "la", "lb", "words", "ends"]
    none = [F.lit(None).cast("long").alias(c) for c in ("pa", "pb", "la", "lb")]
    root = groups.select("cid", "n", F.lit(0).cast("long").alias("pos"), *zero[:2], *none, F.lit(0).cast("long").alias("words"), F.when(F.col("len") == 0, F.col("ends")).alias("ends"))
    high = crown_nodes(path.where("pos < cut").select(*cols).unionByName(root.select(*cols)), low.where("top").drop("top"))
    return (low.where("not top").select(*high.columns).unionByName(high)
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256")))


#: DuckDB SQL of trie(conversations).  SQL has crc32 neither in DuckDB nor elsewhere by
#: standard, so it is computed: eight steps of the reflected polynomial for each digit.
ORACLE = r"""
with recursive t as (
  select conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as d,
         len(list_filter(string_split_regex(coalesce(text, ''), '[\x09-\x0D ]+'), lambda x: x <> '')) as w
  from conversations where conv_id is not null),
i as (select conv_id, d, w, row_number() over (partition by conv_id order by turn nulls first, d) as i from t),
crc as (
  select conv_id, conv_id::varchar as s, 0 as k, 4294967295::bigint as c from (select distinct conv_id from t)
  union all
  select conv_id, s, k + 1, list_reduce(list_concat([xor(c, ascii(s[k // 8 + 1])::bigint * (k % 8 = 0)::int)], [1::bigint]),
         lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384::bigint) else x >> 1 end)
  from crc where k < 8 * len(s)),
h as (select conv_id, conv_id - conv_id % 20 as base, xor(c, 4294967295::bigint) % 4 as h from crc where k = 8 * len(s)),
r as (
  select h.conv_id, i.i, i.d, i.w, 0 as own from h join i on i.conv_id = h.base and i.i <= h.h
  union all select h.conv_id, i.i, i.d, i.w, 1 from h join i on i.conv_id = h.conv_id and i.i > h.h),
q as (select h.conv_id, coalesce(list(r.d order by r.own, r.i) filter (r.d is not null), []) as p, coalesce(list(r.w order by r.own, r.i) filter (r.d is not null), []) as ws
      from h left join r using (conv_id) group by h.conv_id),
m as (select conv_id, len(p) as size, unnest(range(len(p) + 1)) as depth, p, ws from q),
node as (
  select p[:depth] as k, depth, min(conv_id) as conv_id, count(*) as n_convs, min(case when depth = 0 then 0 else ws[depth] end) as w,
         sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (size = depth), '')) as ends_sha256
  from m group by 1, 2),
kid as (select k[:depth - 1] as k, depth - 1 as depth, count(*) as n from node where depth > 0 group by 1, 2),
one as (select node.*, coalesce(kid.n, 0) as n_children from node left join kid using (k, depth)),
below as (select k[:d] as k, d as depth, sum((n_children = 0)::int) as n_leaves, sum((n_convs - 1) * w) as saved_tokens
          from (select *, unnest(range(depth + 1)) as d from one) group by 1, 2)
select one.conv_id, one.depth, up.conv_id as parent_conv_id, one.n_convs, one.n_children, below.n_leaves::bigint as n_leaves, below.saved_tokens::bigint as saved_tokens, one.ends_sha256
from one join below using (k, depth) left join node up on up.depth = one.depth - 1 and up.k = one.k[:one.depth - 1]
"""
