"""Hard negatives by rotated one-bit codes with stored code-vector alignment.

Components become whole numbers, floor(SCALE * x).  A vector v is rotated (random signs
and Walsh-Hadamard transforms, twice; lengths are kept) to y; its code holds the signs of
y, read as the unit vector c with components +-1/sqrt(D).  With each code its alignment
a = <y, c> = |y|_1 / sqrt(D) and the vector's length are stored, so y = a c + r, where r
is orthogonal to c and |r|^2 = |y|^2 - a^2.

An anchor q is rotated alike and quantised to PLANES bits, q = q' + e.  <q', c> is a sum
of popcounts of the code with the bit planes of q'.  From t = <q', c> follows

  <q, v> = a <q, c> + <q, r>,   |<q, c> - t| <= |e|,   |<q, r>| <= |q - <q, c> c| |r|

(Cauchy-Schwarz), an interval that holds the score for sure.  Vectors whose interval
can't reach an anchor's open range are left out; the others are scored in whole numbers.

1. Anchors go to the tasks in blocks of ANCHOR_BYTES, a bounded broadcast; all rows of
   the stored index are read for a block, none is shuffled.  A task keeps the best
   positives of each anchor, and only those leave it.
2. The merged positive scores give each anchor its score ranges; a second pass keeps the
   best negatives of each range alike.

Defined cases: rows with a null id, label or vector, or with a null or non-finite
component take no part; vectors of different lengths don't meet; an empty vector scores
0 with empty ones; rows that repeat an id, or all of a row, are rows of their own and
other rows to each other; ties go by the smaller id; a negative positive score has no
range and so no negatives; other columns are ignored, whatever their names; an empty
table gives an empty result.  A score beyond 64 bits raises OverflowError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routewise.llm.common import new_folder, prepare, stored

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
#: A negative's score in percent of the positive's.
LEAST, MOST = 50, 95
EVERY = 50
#: Bits of a quantised anchor component.
PLANES = 6
#: Vectors of anchors that a pass sends to the tasks, in bytes of 8 for a component.
ANCHOR_BYTES = 8 << 20
#: Anchors and rows that are compared at once in a task.
TILE_ANCHORS, TILE_ROWS = 256, 2048
#: Stands for no score.
NONE = -np.iinfo(np.int64).max


def padded(dim: int) -> int:
    """Length of the rotated vectors: a power of two, whole 64-bit words."""
    return max(64, 1 << max(dim - 1, 0).bit_length())


def rotated(x: np.ndarray) -> np.ndarray:
    """The rows of x, padded and rotated."""
    n, size = len(x), padded(x.shape[1])
    y = np.zeros((n, size))
    y[:, :x.shape[1]] = x
    rng = np.random.RandomState(40_009 + size)
    for _ in range(2):
        y *= rng.choice([-1.0, 1.0], size)
        h = 1
        while h < size:
            z = y.reshape(n, size // (2 * h), 2, h)
            y = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], axis=2).reshape(n, size)
            h *= 2
        y /= np.sqrt(size)
    return y


def codes_of(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, alignments): sign bits in 64-bit words, and |y|_1 / sqrt(D)."""
    return np.packbits(y >= 0, axis=1, bitorder="little").view("<u8"), np.abs(y).sum(axis=1) / np.sqrt(y.shape[1])


def whole(values: np.ndarray) -> bytes:
    """Whole numbers in 2 bytes each where they fit, else as doubles, which hold
    floor() of any double exactly."""
    return values.astype("<i2" if not len(values) or np.abs(values).max() < 1 << 15 else "<f8").tobytes()


def unpacked(raw: list[bytes], dim: int) -> np.ndarray:
    return np.stack([np.frombuffer(v, "<i2" if len(v) == 2 * dim else "<f8").astype(np.float64) for v in raw]) if raw else np.zeros((0, dim))


def index(df: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """(row, vec_id, label, dim, vec, code, align, norm) of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(2)
            at = v.offsets.to_numpy().astype(np.int64)
            # raw values: a null is told by the validity, not by its value
            flat = v.values.fill_null(np.nan).to_numpy(zero_copy_only=False)
            size = np.diff(at)
            for dim in np.unique(size).tolist():
                rows = np.flatnonzero(size == dim)
                x = flat[at[rows][:, None] + np.arange(dim)]
                fine = np.isfinite(x).all(axis=1)
                rows, x = rows[fine], np.floor(SCALE * x[fine])
                y = rotated(x)
                code, align = codes_of(y)
                part = b.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.full(len(rows), dim, np.int32)), pa.array([whole(r) for r in x], pa.binary()),
                                                  pa.array([c.tobytes() for c in code], pa.binary()), pa.array(align), pa.array(np.sqrt((x * x).sum(axis=1)))],
                                                 names=["vec_id", "label", "dim", "vec", "code", "align", "norm"])

    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where("vec_id is not null and label is not null and v is not null").mapInArrow(run, "vec_id long, label string, dim int, vec binary, code binary, align double, norm double")
    return stored(rows.select(F.monotonically_increasing_id().alias("row"), "*"), "negatives-index")


class Anchors:
    """A block's anchors of one length: vectors, bit planes and error bounds."""

    def __init__(self, number: np.ndarray, row: np.ndarray, label: np.ndarray, x: np.ndarray):
        self.number, self.row, self.label, self.x = number, row, label, x
        y = rotated(x)
        low = y.min(axis=1, keepdims=True)
        step = np.maximum((y.max(axis=1, keepdims=True) - low) / ((1 << PLANES) - 1), 1e-300)
        q = np.rint((y - low) / step).astype(np.uint8)
        self.low, self.step, self.total = low[:, 0], step[:, 0], q.sum(axis=1, dtype=np.int64)
        self.plane = np.stack([np.packbits(q >> j & 1, axis=1, bitorder="little").view("<u8") for j in range(PLANES)], axis=1)
        self.error = np.sqrt(((y - low - step * q) ** 2).sum(axis=1))
        self.norm = np.sqrt((x * x).sum(axis=1))
        self.size = y.shape[1]

    def intervals(self, a: slice, code: np.ndarray, align: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(low, high) bounds of the scores of anchors a with the rows of these codes."""
        got = np.zeros((a.stop - a.start, len(code)), np.int32)
        for j in range(PLANES):
            for w in range(code.shape[1]):
                got += np.bitwise_count(self.plane[a, j, w][:, None] & code[:, w][None, :]).astype(np.int32) << j
        ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
        # <q', c> = (2 * the components where the code has a one, less all) / sqrt(D)
        t = (2 * (self.low[a, None] * ones + self.step[a, None] * got) - (self.low[a] * self.size + self.step[a] * self.total[a])[:, None]) / np.sqrt(self.size)
        e = self.error[a, None]
        off = np.sqrt(np.maximum(self.norm[a, None] ** 2 - np.maximum(np.abs(t) - e, 0) ** 2, 0))
        rest = np.sqrt(np.maximum(norm ** 2 - align ** 2, 0))
        wide = align * e + off * rest + 1e-9 * self.norm[a, None] * norm + 1e-3  # the last two for rounding
        return align * t - wide, align * t + wide


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exactly, as 64-bit ones."""
    if not a.shape[1] or a.shape[1] * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) < 1 << 53:
        return np.rint(a @ b.T).astype(np.int64)
    whole_a, whole_b = ([[int(v) for v in r] for r in m] for m in (a, b))
    return np.array([[sum(x * y for x, y in zip(r, s)) for s in whole_b] for r in whole_a], dtype=object).astype(np.int64)


def scores(anchors: Anchors, a: slice, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Scores of the pairs that mask holds, NONE elsewhere."""
    out = np.full(mask.shape, NONE)
    rows, cols = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    if len(rows) and len(cols):
        sub = np.ix_(rows, cols)
        out[sub] = np.where(mask[sub], exact(anchors.x[a][rows], x[cols]), NONE)
    return out


def best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of the k highest in each row of score; columns are in order of id,
    so the first of equal ones is the smallest id.  Changes score."""
    got, who = np.full((len(score), k), NONE), np.zeros((len(score), k), np.int64)
    at = np.arange(len(score))
    for i in range(k if score.shape[1] else 0):
        top = score.argmax(axis=1)
        got[:, i], who[:, i] = score[at, top], ids[top]
        score[at, top] = NONE
    return got, who


def joined(score: np.ndarray, ids: np.ndarray, more: np.ndarray, more_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best of two lists, along the last axis."""
    k = score.shape[-1]
    s, i = np.concatenate([score, more], axis=-1), np.concatenate([ids, more_ids], axis=-1)
    order = np.lexsort((i, -s), axis=-1)
    return np.take_along_axis(s, order, -1)[..., :k], np.take_along_axis(i, order, -1)[..., :k]


def scan(rows: DataFrame, anchors: list[Anchors], k: int, low: np.ndarray | None, high: np.ndarray | None) -> DataFrame:
    """(anchor, range, score, vec_id): the k best rows that each task has for the ranges
    of each anchor.  Without ranges: rows of the anchor's label; with low and high (anchor,
    range): rows of other labels with a score between them."""
    ranges = 1 if low is None else low.shape[1]
    count = sum(len(a.number) for a in anchors)
    cols = ["row", "vec_id", "label", "dim", "vec", "code", "align", "norm"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, who = np.full((count, ranges, k), NONE), np.zeros((count, ranges, k), np.int64)
        for b in batches:
            dims = b.column(3).to_numpy()
            for anch in anchors:
                dim = anch.x.shape[1]
                mine = np.flatnonzero(dims == dim)
                mine = mine[np.argsort(b.column(1).to_numpy()[mine], kind="stable")]
                for lo in range(0, len(mine), TILE_ROWS):
                    part = b.take(pa.array(mine[lo:lo + TILE_ROWS]))
                    n = len(part)
                    row, ids, label = part.column(0).to_numpy(), part.column(1).to_numpy(), np.array(part.column(2).to_pylist(), object)
                    x = unpacked(part.column(4).to_pylist(), dim)
                    code = np.frombuffer(b"".join(part.column(5).to_pylist()), "<u8").reshape(n, -1)
                    align, norm = part.column(6).to_numpy(), part.column(7).to_numpy()
                    for s in range(0, len(anch.number), TILE_ANCHORS):
                        a = slice(s, min(s + TILE_ANCHORS, len(anch.number)))
                        at = anch.number[a]
                        same = anch.label[a][:, None] == label[None, :]
                        below, above = anch.intervals(a, code, align, norm)
                        # a row must be able to enter one of the anchor's lists; bounds that are no number pass
                        worst = top[at][:, :, -1]
                        if low is None:
                            mask = same & (anch.row[a][:, None] != row[None, :]) & ~(above < worst[:, :1])
                        else:
                            open_ = low[at] <= high[at]
                            need = np.where(open_, np.maximum(worst, low[at]), np.iinfo(np.int64).max).min(axis=1)
                            mask = ~same & ~(above < need[:, None]) & ~(below > np.where(open_, high[at], NONE).max(axis=1)[:, None])
                        got = scores(anch, a, x, mask)
                        for r in range(ranges):
                            inside = got if low is None else np.where((got >= low[at][:, r:r + 1]) & (got <= high[at][:, r:r + 1]), got, NONE)
                            top[at, r], who[at, r] = joined(top[at, r], who[at, r], *best(inside, ids, k))
        i, r, j = np.nonzero(top > NONE)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(r.astype(np.int32)), pa.array(top[i, r, j]), pa.array(who[i, r, j])], names=["anchor", "range", "score", "vec_id"])

    return rows.select(*cols).mapInArrow(run, "anchor int, range int, score long, vec_id long")


def firsts(found: DataFrame, k: int) -> DataFrame:
    """found with rank 1 to k within (anchor, range)."""
    order = Window.partitionBy("anchor", "range").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def block_anchors(rows: DataFrame) -> tuple[pa.Table, list[Anchors]]:
    """The anchors of a block, numbered from 0."""
    t = rows.select("row", "vec_id", "label", "dim", "vec").toArrow()
    label, dims = np.array(t.column("label").to_pylist(), object), t.column("dim").to_numpy()
    out = []
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        out.append(Anchors(at, t.column("row").to_numpy()[at], label[at], unpacked(t.column("vec").take(pa.array(at)).to_pylist(), dim)))
    return t, out


def mine(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, every: int = EVERY,
         positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each
    anchor (an id divisible by every) and each of its first positives the first negatives
    with least to most percent of the positive's score."""
    spark = df.sparkSession
    prepare(spark)
    rows = index(df, id_col, vector_col, F.col("label") if label is None else label)
    anchors = rows.where(F.col("vec_id") % every == 0)
    size = anchors.agg(F.coalesce(F.sum(8 * (F.col("dim") + 8)), F.lit(0))).first()[0]
    blocks = max(1, -(-size // anchor_bytes))
    out = new_folder(spark, "negatives")
    for i in range(blocks):
        t, block = block_anchors(anchors.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == i))
        ids = t.column("vec_id").to_numpy()
        pos = firsts(scan(rows, block, positives, None, None), positives).select("anchor", "rank", "score", "vec_id").toArrow()
        at, rank = pos.column("anchor").to_numpy(), pos.column("rank").to_numpy() - 1
        score, who = np.full((len(ids), positives), -1), np.zeros((len(ids), positives), np.int64)
        score[at, rank], who[at, rank] = pos.column("score").to_numpy(), pos.column("vec_id").to_numpy()
        # least * p <= 100 * n <= most * p in whole numbers; a negative p has no n
        low = np.array([[-(-least * p // 100) if p >= 0 else 0 for p in r] for r in score.tolist()], np.int64).reshape(score.shape)
        high = np.array([[most * p // 100 if p >= 0 else -1 for p in r] for r in score.tolist()], np.int64).reshape(score.shape)
        names = pa.table({"anchor": pa.array(np.repeat(np.arange(len(ids), dtype=np.int32), positives)), "range": pa.array(np.tile(np.arange(positives, dtype=np.int32), len(ids))),
                          "anchor_id": pa.array(np.repeat(ids, positives)), "positive_id": pa.array(who.reshape(-1)), "positive_score": pa.array(score.reshape(-1))})
        (firsts(scan(rows, block, negatives, low, high), negatives).join(F.broadcast(spark.createDataFrame(names)), ["anchor", "range"])  # at most the block's anchors
         .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
         .write.mode("append").parquet(out))
    return spark.read.schema("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long").parquet(out)


def shifted_label(every: int = 7, labels: int = 10) -> Column:
    """The query's labels: those of ids divisible by every move on by one."""
    return F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))


#: DuckDB SQL of mine(embeddings, label=shifted_label()).
ORACLE = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as e
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, coalesce(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i])), 0)::bigint as score
  from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where a.vec_id % 50 = 0),
p as (select * from s where same qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5)
select p.anchor_id, p.other_id as positive_id, (row_number() over (partition by p.anchor_id, p.other_id order by s.score desc, s.other_id))::int as rank,
       s.other_id as negative_id, p.score as positive_score, s.score as negative_score
from p join s on s.anchor_id = p.anchor_id and not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score
qualify row_number() over (partition by p.anchor_id, p.other_id order by s.score desc, s.other_id) <= 3
"""
