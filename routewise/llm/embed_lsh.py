"""Embedding near-duplicates by Euclidean p-stable hashing, with exact cosine checks.

Equal vectors of a label are one class, which stands for its members from then on.
Vectors are normalised; table t hashes them to DEPTH quantised random projections,
floor((a.v + b) / WIDTH).  Classes that share a table's bucket are compared by their
exact cosine in double precision; a pair that met in an earlier table is skipped there,
so each link counts once.  Per bucket only each class's number of links and its
component's root leave the task, never the pairs.

With DEPTH 6, WIDTH 1.5 and 12 tables, a pair at cosine 0.93 (distance 0.374) meets
with probability 0.97, closer pairs with more; tests measure recall against brute force.
A vector is shuffled once for each table, in its own precision: few tables with larger
buckets cost less than many with small ones, as the comparisons are matrix products.  A bucket of more than TILE classes is cut into chunks by a hash and each pair
of chunks is a tile of its own, so a task holds two chunks at most; every pair of the
bucket is still compared.

Defined cases: vectors that are null, empty, all zero or hold null or non-finite
components, and vectors without a label, link with nothing; vectors of different
lengths don't link; repeated ids get a row each, and their rows are other vectors to
each other; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routewise.llm import textblocks as tb
from routewise.llm.common import component_labels, prepare, stored

LEAST = 0.93
DEPTH = 6
TABLES = 12
WIDTH = 1.5
TILE = 2048


def projections(dim: int, tables: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.RandomState(20_011)
    return rng.standard_normal((dim, tables * depth)), rng.uniform(0, WIDTH, tables * depth)


def bucket_keys(x: np.ndarray, tables: int = TABLES, depth: int = DEPTH) -> np.ndarray:
    """A 64-bit key of each row of unit vectors for each table."""
    a, b = projections(x.shape[1], tables, depth)
    q = np.floor((x @ a + b) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(x), tables, depth)
    h = np.zeros((len(x), tables), np.uint64)
    for k in range(depth):
        h = tb.mix(h * tb.U64(31) + q[:, :, k] + tb.U64(k + 1))
    return h


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # first by the largest, so that squares don't overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def precision(df: DataFrame, vector_col: str) -> str:
    """Numpy type of the stored components: that of the column."""
    return "<f4" if df.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"


def read_vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, digest, vec): vec the components as little-endian numbers of
    precision() bytes, null with its digest where the vector links with nothing."""
    kind = precision(df, vector_col)
    as_type = "array<float>" if kind == "<f4" else "array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, digest = [], []
            for v, label in zip(b.column(2), b.column(1)):
                x = None
                if label.is_valid and v.is_valid and len(v.values) and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False).astype(kind) + np.dtype(kind).type(0)  # no negative zeros
                    x = x if np.isfinite(x).all() and x.any() else None
                raw.append(None if x is None else x.tobytes())
                digest.append(None if x is None else hashlib.blake2b(raw[-1], digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(digest, pa.binary()), pa.array(raw, pa.binary())], names=["vec_id", "label", "digest", "vec"])

    return (df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast(as_type).alias("v"))
            .mapInArrow(run, "vec_id long, label string, digest binary, vec binary"))


def _index(classes: DataFrame, kind: str, tables: int, depth: int) -> DataFrame:
    """(label, dim, t, key, cid, weight, vec): a row for each class and table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vecs = b.column(3).to_pylist()
            size = np.array([len(v) for v in vecs])
            for s in np.unique(size):
                rows = np.flatnonzero(size == s)
                x = np.frombuffer(b"".join(vecs[i] for i in rows.tolist()), kind).reshape(len(rows), -1)
                part = b.take(pa.array(rows))
                keys = bucket_keys(unit(x), tables, depth)
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(len(rows), s // np.dtype(kind).itemsize, np.int32)), pa.array(np.full(len(rows), t, np.int32)),
                                                      pa.array(keys[:, t].view(np.int64)), part.column(1), part.column(2), part.column(3)],
                                                     names=["label", "dim", "t", "key", "cid", "weight", "vec"])

    return (classes.select("label", "cid", "weight", "vec")
            .mapInArrow(run, "label string, dim int, t int, key long, cid long, weight long, vec binary"))


def compare(x: np.ndarray, cid: np.ndarray, weight: np.ndarray, side: np.ndarray, t: int, least: float, tables: int, depth: int):
    """(linked rows, links, roots) of one tile.  side: 0 and 1 for the two chunks of a
    cut bucket, of which only pairs across count; -1 in a tile of one chunk."""
    n = len(x)
    x = unit(x)
    adj = x @ x.T >= least
    adj[np.arange(n), np.arange(n)] = False
    if side[0] >= 0:
        adj &= side[:, None] != side[None, :]
    some = np.flatnonzero(adj.any(axis=1))
    if not len(some):
        return None
    adj = adj[np.ix_(some, some)]
    keys = bucket_keys(x[some], tables, depth)
    for u in range(t):  # met before
        adj &= keys[:, u][:, None] != keys[:, u][None, :]
    links = adj @ weight[some].astype(np.float64)
    # components by smallest reachable id
    root = cid[some].copy()
    far = np.iinfo(np.int64).max
    while True:
        near = np.minimum(root, np.where(adj, root[None, :], far).min(axis=1))
        if (near == root).all():
            break
        root = near
    keep = links > 0
    return some[keep], links[keep].astype(np.int64), root[keep]


def links(classes: DataFrame, kind: str, least: float = LEAST, tables: int = TABLES, depth: int = DEPTH, tile: int = TILE) -> DataFrame:
    """(cid, links, root) for each class and tile in which it has links."""
    spark = classes.sparkSession
    index = _index(classes, kind, tables, depth)
    bucket = ["label", "dim", "t", "key"]
    # few by nature; the join's side is chosen by its measured size
    large = index.groupBy(*bucket).agg(F.count("*").alias("n")).where(F.col("n") > tile).select(*bucket, F.ceil(F.col("n") / (tile // 2)).cast("int").alias("chunks"))
    cut = index.join(large, bucket, "left")
    chunk = F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int")
    # a chunk meets every chunk of its bucket, itself included
    parts = F.when(F.col("chunks").isNull(), F.array(F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(-1).alias("side")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(
            F.least(o, chunk).alias("lo"), F.greatest(o, chunk).alias("hi"),
            F.when(o == chunk, -1).otherwise((chunk > o).cast("int")).alias("side"))))
    rows = cut.select(*bucket, "cid", "weight", "vec", F.explode(parts).alias("p")).select(
        F.xxhash64(*bucket, "p.lo", "p.hi").alias("tile"), "t", "cid", "weight", "vec", F.col("p.side").alias("side"), "label", "key", "dim", F.col("p.lo").alias("lo"), F.col("p.hi").alias("hi"))
    key = ["tile", "label", "dim", "t", "key", "lo", "hi"]
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "tile").sortWithinPartitions(*key, "cid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compared(b):
            ids = [b.column(n).to_numpy(zero_copy_only=False) for n in ("tile", "key", "dim", "t", "lo", "hi")]
            label = b.column("label").dictionary_encode().indices.to_numpy(zero_copy_only=False)
            new = np.ones(len(label), bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in (*ids, label)], axis=0)
            begin = np.append(np.flatnonzero(new), len(label))
            cid, weight, side = (b.column(n).to_numpy(zero_copy_only=False) for n in ("cid", "weight", "side"))
            vec, out = b.column("vec"), []
            for a, z in zip(begin[:-1].tolist(), begin[1:].tolist()):
                if z - a > 1:
                    x = np.frombuffer(b"".join(vec.slice(a, z - a).to_pylist()), kind).reshape(z - a, -1)
                    got = compare(x, cid[a:z], weight[a:z], side[a:z], int(ids[3][a]), least, tables, depth)
                    if got:
                        out.append((cid[a:z][got[0]], got[1], got[2]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["cid", "links", "root"])

        rest = None
        for b in batches:
            b = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            b = b.combine_chunks().to_batches()[0]
            # the last tile may go on in the next batch
            last = b.column("tile").to_numpy(zero_copy_only=False)
            cut_at = int(np.searchsorted(last, last[-1], "left"))
            rest = pa.Table.from_batches([b.slice(cut_at)])
            if cut_at:
                yield from compared(b.slice(0, cut_at))
        if rest is not None:
            yield from compared(rest.combine_chunks().to_batches()[0])

    return rows.mapInArrow(run, "cid long, links long, root long")


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = LEAST,
                    tables: int = TABLES, depth: int = DEPTH, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    prepare(df.sparkSession)
    rows = stored(read_vectors(df, id_col, vector_col, label_col), "vectors")
    classes = (rows.where("digest is not null").groupBy("label", "digest")
               .agg(F.min("vec_id").alias("low"), F.count("*").alias("weight"), F.min("vec").alias("vec"))
               # a class's key; ids may be null or repeat in other classes
               .withColumn("cid", F.xxhash64("label", "digest")))
    found = stored(links(classes, precision(df, vector_col), least, tables, depth, tile), "vector-links")
    per = found.groupBy("cid").agg(F.sum("links").alias("links"))
    label = component_labels(found.select(F.col("cid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "cid")
    ids = classes.select("cid", "low", "weight").join(label, "cid", "left").select("cid", "low", "weight", F.coalesce("label", "cid").alias("comp"))
    low = ids.groupBy("comp").agg(F.min("low").alias("component_id"))
    ids = ids.join(low, "comp").join(per, "cid", "left").select("cid", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("vec_id", F.when(F.col("digest").isNotNull(), F.xxhash64("label", "digest")).alias("cid")).join(ids, "cid", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
