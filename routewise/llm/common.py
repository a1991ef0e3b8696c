"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routewise.session import ensure_checkpoint_dir, scratch_path, ship_package


#: Bytes of an Arrow batch that goes to Python.
BATCH_BYTES = 4 << 20
#: For operators that look at small chunks anyway.  The JVM's Arrow buffers are at most twice
#: as large, so they come from its pool; larger ones are allocated anew for each batch, and
#: what is free again stays scattered over the process.
SMALL_BATCH_BYTES = 1 << 20


def prepare(spark: SparkSession, batch_bytes: int = BATCH_BYTES) -> None:
    """Make the shared checkpoint folder known, ship this package to the executors, whose
    Python path need not hold it, and bound the Arrow batches by bytes: a batch of texts
    is held by the JVM and by Python at once."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))


def release_memory() -> None:
    """Give back what the allocators of this process hold for later use."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, with release_memory() at the task's end: Spark keeps the workers
    of earlier stages beside those that work."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release_memory()

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder."""
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage and survives lost
    executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that is never learnt from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


#: Edges that one task may hold.
TASK_EDGES = 1 << 18


def _forest(edges: DataFrame, tasks: int) -> DataFrame:
    """Edges (a, b), b < a, of a spanning forest of what each of so many tasks holds: a
    node and the smallest one of its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if len(b)]
        if not got:
            return
        names, code = np.unique(np.concatenate([x for pair in zip(*got) for x in pair]), return_inverse=True)
        n = sum(len(x) for x, _ in got)
        a, b = code[:n], code[n:]
        top = np.arange(len(names))
        while True:  # each edge hooks the larger top to the smaller, then tops are followed to their ends
            x, y = top[a], top[b]
            if (x == y).all():
                break
            np.minimum.at(top, np.maximum(x, y), np.minimum(x, y))
            while (top[top] != top).any():
                top = top[top]
        low = np.flatnonzero(top != np.arange(len(names)))
        yield pa.RecordBatch.from_arrays([pa.array(names[low]), pa.array(names[top[low]])], names=["a", "b"])

    return edges.select("a", "b").coalesce(tasks).mapInArrow(run, "a long, b long")


def component_labels(edges: DataFrame, max_rounds: int = 60, task_edges: int = TASK_EDGES) -> DataFrame:
    """Connected components of an undirected graph: edges (a long, b long) to
    (id, label), label the smallest id of its component; ids without an edge are
    absent.

    Tasks of at most task_edges edges reduce theirs to spanning forests; a graph that
    fits in one is done then.  A larger one goes on in alternating large-star and
    small-star rounds: each is two aggregations by node with map-side combining and two
    joins that AQE may split, so a node that touches a third of all edges is no single
    task.  Rounds grow with the logarithm of the component sizes; the edge list is
    checkpointed each round.  Raises if it has not converged after max_rounds.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    n = e.count()
    e = _forest(e, max(1, -(-n // task_edges))).checkpoint()
    if n > task_edges:
        e = _stars(e, max_rounds)
    low = e.groupBy("a").agg(F.min("b").alias("label"))
    return low.withColumnRenamed("a", "id").union(low.select(F.col("label").alias("id"), "label").distinct())


def _stars(e: DataFrame, max_rounds: int) -> DataFrame:
    """Edges (node, smallest node of its component) from edges (a, b), b < a."""
    before = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: every larger neighbour points to the smallest of the star
        e = (both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
             .where("a <> b").distinct())
        # small star: all smaller neighbours and the node itself point to the smallest
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        down = e.join(low, "a")
        e = (down.select(F.col("b").alias("a"), F.col("m").alias("b"))
             .union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct().checkpoint())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return e
        before = now
    raise RuntimeError(f"components did not converge in {max_rounds} rounds")


#: Bits of an id filter at most (2 MB).
MAX_FILTER_BITS = 1 << 24


def id_bitmap(ids: DataFrame) -> np.ndarray:
    """Packed bits of the hashed ids of a one-column frame, 16 bits an id up to
    MAX_FILTER_BITS in all."""
    ids = ids.toDF("id").where("id is not null")
    n = ids.count()
    size = min(MAX_FILTER_BITS, 1 << max(16, (16 * n).bit_length()))
    at = ids.select(F.pmod(F.xxhash64("id"), F.lit(size)).cast("int").alias("at")).distinct().toArrow().column(0).to_numpy()
    bits = np.zeros(size, bool)
    bits[at] = True
    return np.packbits(bits, bitorder="little")


def bitmap_place(col: str, packed: np.ndarray) -> Column:
    """The place of the ids of a column in a bitmap of id_bitmap."""
    return F.pmod(F.xxhash64(F.col(col).cast("long")), F.lit(8 * len(packed))).cast("int")


def in_bitmap(at: pa.Array, packed: np.ndarray) -> np.ndarray:
    x = at.to_numpy(zero_copy_only=False)
    return (packed[x >> 3] >> (x & 7) & 1).astype(bool)


def may_be_among(ids: DataFrame, col: str) -> Column:
    """A filter for the column col that lets all values of the one-column frame ids pass
    and few others, before an exact join: a bitmap of hashed ids.  Past MAX_FILTER_BITS it
    lets more pass, never less.  It runs in Python workers of its own: a Python step over
    the same rows asks in_bitmap itself and has one worker a task, not two."""
    packed = id_bitmap(ids)

    @F.arrow_udf("boolean")
    def among(at: pa.Array) -> pa.Array:
        return pa.array(in_bitmap(at, packed))

    return among(bitmap_place(col, packed))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
