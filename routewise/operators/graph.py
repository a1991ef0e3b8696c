"""Connected components and global numbering without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root) of every node of the edges (a long, b long); root is the smallest node
    of its component.

    Each round hooks a vertex to its smallest smaller neighbour, shortens the chains of
    hooks by pointer jumping (their length halves with each join), and contracts the
    edges, so both the edges and the rounds left shrink quickly.  Hooks are aggregates
    with map-side combining: a node with a third of all edges is combined before the
    shuffle.  Raises if edges are left after max_rounds."""
    ensure_checkpoint_dir(edges.sparkSession)
    # loops keep lone nodes in the result, and are no edges
    ends = edges.where("a is not null and b is not null")
    parent = ends.select(F.col("a").alias("node")).union(ends.select("b")).distinct().withColumn("root", F.col("node")).checkpoint()
    left = _ordered(ends)
    for _ in range(max_rounds):
        if left.isEmpty():
            return parent
        hook = _jumped(left.groupBy("a").agg(F.min("b").alias("to")).checkpoint())
        left = _ordered(_renamed(_renamed(left, "a", hook), "b", hook))
        parent = _renamed(parent, "root", hook).checkpoint()
    raise RuntimeError(f"components did not converge in {max_rounds} rounds")


def _ordered(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller node, loops left out."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()


def _renamed(df: DataFrame, col: str, hook: DataFrame) -> DataFrame:
    h = hook.select(F.col("a").alias(col), F.col("to").alias("_to"))
    return df.join(h, col, "left").withColumn(col, F.coalesce("_to", col)).select(*df.columns)


def _jumped(hook: DataFrame, max_jumps: int = 70) -> DataFrame:
    """Hooks (a, to) followed to their ends."""
    for _ in range(max_jumps):
        nxt = hook.select(F.col("a").alias("to"), F.col("to").alias("_next"))
        both = hook.join(nxt, "to", "left").checkpoint()
        if both.where("_next is not null").isEmpty():
            return hook
        hook = both.select("a", F.coalesce("_next", "to").alias("to"))
    raise RuntimeError(f"hooks are longer than 2 ** {max_jumps}")


def numbered(df: DataFrame, by: str, out: str) -> DataFrame:
    """df with its rows' positions, from 0, in the order of the distinct values by.
    Range partitions are numbered each on its own; a count for each partition, as many
    as there are shuffle partitions, gives their offsets."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # ids that grow within a partition and hold its number in their upper bits
    ranged = df.repartitionByRange(n, by).sortWithinPartitions(by).withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("_at", 33)
    sizes = {r["p"]: r["n"] for r in ranged.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, total = [], 0
    for p in sorted(sizes):
        offsets.append((p, total))
        total += sizes[p]
    off = F.broadcast(spark.createDataFrame(offsets, "_p long, _off long"))  # one row a partition
    return (ranged.withColumn("_p", part).join(off, "_p")
            .withColumn(out, F.col("_off") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_p", "_off", "_at"))
