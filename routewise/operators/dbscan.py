"""DBSCAN (K09) over a graph of cells.

1. Identical vectors are collapsed to one weighted node (survey answers repeat a lot),
   with the smallest row id.
2. Space is cut into cells of side eps / sqrt(d), so any two nodes of a cell are
   neighbours.  A cell that weighs min_samples or more has core nodes only, and its
   nodes need no count; the core nodes of a cell are one vertex of the cluster graph.
3. Only nodes of lighter cells count their neighbours.
4. Two cells are linked if any core node of one is a neighbour of one of the other.  A
   task compares a cell with those that are not yet in one set with it, so it sends a
   spanning forest of its cells and never pairs of nodes; a cell of m nodes costs no
   edges of its own, whatever m.
5. Components of the cells; clusters are numbered by their first core row, and a border
   row takes the lowest number among its core neighbours, as the sequential algorithm
   has it; the rest is noise (-1).

Comparisons are dealt by blocks of side eps on ``grid_dims`` dimensions: a node's
neighbours lie in the adjacent blocks, to which it is sent as a guest.  A block's home
and guest nodes are both cut into chunks of about ``block`` nodes, and a task has one
chunk of each, so a block that holds a third of all nodes is spread over many tasks of
bounded size.  Distances are taken in numpy, in slices; only counts, cell links and
cluster numbers leave a task.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .graph import connected_components, numbered


def cells(df: DataFrame, id_col: str, cols: list[str], eps: float, min_samples: int) -> tuple[DataFrame, DataFrame]:
    """nodes (node, w, cols, cell, dense), cell the smallest node of its cell; and the
    rows' nodes (id_col, node)."""
    nodes = df.groupBy(*cols).agg(F.min(id_col).cast("long").alias("node"), F.count(F.lit(1)).alias("w"))
    members = df.join(nodes.select(*cols, "node"), cols).select(id_col, "node")
    side = eps / math.sqrt(len(cols)) * (1 - 1e-9)  # a hair less, for rounding
    box = F.array(*[F.floor(F.col(c) / side).cast("long") for c in cols])
    nodes = nodes.withColumn("_box", box)
    light = nodes.groupBy("_box").agg(F.min("node").alias("cell"), (F.sum("w") >= min_samples).alias("dense"))
    return nodes.join(light, "_box").drop("_box"), members


def dealt(home: DataFrame, guest: DataFrame, cols: list[str], eps: float, grid_dims: int, block: int) -> DataFrame:
    """Rows of home and guest by (block, hc, gc), with is_home; every home node meets all
    guests of its own and the adjacent blocks."""
    dims = cols[:grid_dims]
    at = F.array(*[F.floor(F.col(c) / eps).cast("long") for c in dims])
    steps = F.array(*[F.array(*[F.lit(x) for x in o]) for o in itertools.product([-1, 0, 1], repeat=len(dims))])
    # chunks from counts by block, never from the nodes themselves
    homes = home.groupBy(at.alias("at")).agg(F.count(F.lit(1)).alias("n"))
    guests = (guest.groupBy(at.alias("at")).agg(F.count(F.lit(1)).alias("m")).withColumn("s", F.explode(steps))
              .groupBy(F.zip_with("at", "s", lambda a, b: a + b).alias("at")).agg(F.sum("m").alias("m")))
    size = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / block)).cast("int")
    plan = homes.join(guests, "at").select("at", size("n").alias("h"), size("m").alias("g"))
    chunk = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    mine = home.withColumn("at", at).join(plan, "at").withColumn("hc", chunk("h")).withColumn("gc", every("g")).withColumn("is_home", F.lit(True))
    other = (guest.withColumn("s", F.explode(steps)).withColumn("at", F.zip_with(at, "s", lambda a, b: a + b)).drop("s").join(plan, "at")
             .withColumn("gc", chunk("g")).withColumn("hc", every("h")).withColumn("is_home", F.lit(False)))
    return mine.drop("h", "g").unionByName(other.drop("h", "g"), allowMissingColumns=True)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, by differences, so equal rows are exactly 0 apart."""
    return ((a[:, None, :] - b[None, :, :]) ** 2).sum(-1)


def count_neighbours(cols: list[str], eps: float, rows: int):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        home, guest = pdf[pdf.is_home], pdf[~pdf.is_home]
        x, y, w = home[cols].to_numpy(float), guest[cols].to_numpy(float), guest["w"].to_numpy()
        n = [((distances(x[i:i + rows], y) <= eps * eps) * w).sum(1) for i in range(0, len(x), rows)]
        return pd.DataFrame({"node": home["node"].to_numpy(), "n": np.concatenate(n) if n else np.zeros(0, np.int64)}).astype({"n": "int64"})

    return fn


def link_cells(cols: list[str], eps: float, rows: int):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        home, guest = (x.sort_values("cell", kind="stable") for x in (pdf[pdf.is_home], pdf[~pdf.is_home]))
        names, code = np.unique(np.concatenate([home["cell"].to_numpy(), guest["cell"].to_numpy()]), return_inverse=True)
        mine, other = code[:len(home)], code[len(home):]
        x, y = home[cols].to_numpy(float), guest[cols].to_numpy(float)
        top, out = np.arange(len(names)), []
        if not len(mine) or not len(other):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        start = np.flatnonzero(np.append(True, other[1:] != other[:-1]))
        cell = other[start]
        low, high = np.minimum.reduceat(y, start), np.maximum.reduceat(y, start)
        size = np.diff(np.append(start, len(other)))
        for c in np.unique(mine).tolist():
            part = x[mine == c]
            for i in range(0, len(part), rows):
                p = part[i:i + rows]
                # cells whose box is near, but for those already in one set with this cell
                gap = np.maximum(np.maximum(low - p.max(0), p.min(0) - high), 0)
                ask = np.flatnonzero(((gap * gap).sum(1) <= eps * eps) & (top[cell] != top[c]))
                if not len(ask):
                    continue
                at = np.repeat(start[ask], size[ask]) + np.arange(size[ask].sum()) - np.repeat(np.cumsum(size[ask]) - size[ask], size[ask])
                for j in range(0, len(at), 16 * rows):
                    some = at[j:j + 16 * rows]
                    near = (distances(p, y[some]) <= eps * eps).any(0)
                    for d in np.unique(other[some[near]]).tolist():
                        if top[d] != top[c]:
                            top[top == top[d]] = top[c]
                            out.append((names[c], names[d]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return fn


def lowest_cluster(cols: list[str], eps: float, rows: int):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        home, guest = pdf[pdf.is_home], pdf[~pdf.is_home].sort_values("cluster", kind="stable")
        x, y, number = home[cols].to_numpy(float), guest[cols].to_numpy(float), guest["cluster"].to_numpy()
        nodes, got = [], []
        for i in range(0, len(x) if len(y) else 0, rows):
            near = distances(x[i:i + rows], y) <= eps * eps
            any_ = near.any(1)
            nodes.append(home["node"].to_numpy()[i:i + rows][any_])
            got.append(number[near.argmax(1)[any_]])  # the first is the lowest
        none = [np.zeros(0, np.int64)]
        return pd.DataFrame({"node": np.concatenate(nodes or none), "cluster": np.concatenate(got or none)}).astype("int64")

    return fn


def dbscan(df: DataFrame, id_col: str, cols: list[str], eps: float, min_samples: int,
           grid_dims: int = 3, block: int = 2000, slice_rows: int = 256) -> DataFrame:
    """Label every row: ``dbscan_label`` (-1 = noise) and ``is_core``.
    ``id_col`` gives the row order used for numbering (smallest first)."""
    ensure_checkpoint_dir(df.sparkSession)
    nodes, members = cells(df, id_col, cols, eps, min_samples)
    nodes = nodes.checkpoint()
    task = ["at", "hc", "gc"]
    coords = ["node", *cols]

    def compared(home: DataFrame, guest: DataFrame, fn, schema: str) -> DataFrame:
        return dealt(home, guest, cols, eps, grid_dims, block).groupBy(*task).applyInPandas(fn, schema)

    light = nodes.where("not dense")
    counts = compared(light.select(*coords, "w"), nodes.select(*coords, "w"), count_neighbours(cols, eps, slice_rows), "node long, n long")
    enough = counts.groupBy("node").agg(F.sum("n").alias("n")).where(F.col("n") >= min_samples).select("node", F.lit(True).alias("_enough"))
    nodes = nodes.join(enough, "node", "left").withColumn("core", F.col("dense") | F.coalesce("_enough", F.lit(False))).drop("_enough").checkpoint()

    core = nodes.where("core").select(*coords, "cell")
    links = compared(core, core, link_cells(cols, eps, slice_rows), "a long, b long")
    own = core.select(F.col("cell").alias("a"), F.col("cell").alias("b"))  # cells without a link
    comp = connected_components(links.unionByName(own).distinct().checkpoint()).select(F.col("node").alias("cell"), "root")
    core = core.join(comp, "cell")
    first = numbered(core.groupBy("root").agg(F.min("node").alias("first")), "first", "cluster")
    core = core.join(first.select("root", "cluster"), "root").select(*coords, "cluster").checkpoint()

    border = compared(nodes.where("not core").select(*coords), core, lowest_cluster(cols, eps, slice_rows), "node long, cluster long")
    labels = core.select("node", "cluster").unionByName(border.groupBy("node").agg(F.min("cluster").alias("cluster")))
    return (members.join(nodes.select("node", "core"), "node").join(labels, "node", "left")
            .select(id_col, F.coalesce("cluster", F.lit(-1)).alias("dbscan_label"), F.col("core").alias("is_core")))


def summary(labels: DataFrame) -> DataFrame:
    """Cluster count, noise count and share."""
    return labels.agg(
        F.countDistinct(F.when(F.col("dbscan_label") >= 0, F.col("dbscan_label"))).alias("n_clusters"),
        F.count(F.when(F.col("dbscan_label") < 0, 1)).alias("n_noise"),
        F.round(F.count(F.when(F.col("dbscan_label") < 0, 1)) * 100.0 / F.count(F.lit(1)), 2).alias("noise_pct"))
