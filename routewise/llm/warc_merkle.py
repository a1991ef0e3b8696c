"""Merkle fixity audit of web-archive replicas.

A record is a WARC-like entry: an offset (its place in the archive's order) and a
payload.  Its hash is the SHA-256 of the payload fields.  Leaves are ordered offset
ranges of FANOUT offsets; a node of a higher level covers FANOUT nodes of the level
below, and its hash is the SHA-256 of its children's numbers and hashes in order.
Each replica's tree is written level by level.  An audit compares the roots and, level
by level, joins only the children of nodes that differ, down to the records: damage is
located by reading the branches above it, not the replicas.

All steps are DataFrame aggregations and joins.  A node is aggregated from at most
FANOUT children.  Records that repeat an offset are folded first into one digest
(their number and the sums of their hashes' words, which do not depend on order), by
an aggregation with map-side combining, so an offset that a third of all records share
is not gathered anywhere.

Defined cases: null payload fields hash differently from empty ones; records with a
null offset form the range before offset 0; negative offsets raise; a repeated record
counts with its multiplicity; a replica may be empty (its tree has no nodes); other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routewise.llm.common import new_folder, prepare

FANOUT = 64
MISSING, EXTRA, ALTERED = "missing", "extra", "altered"


def record_hash(fields: list[str]) -> Column:
    """SHA-256 (hex) of the fields, each with its length in bytes."""
    parts = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-")) for c in fields]
    return F.sha2(F.concat_ws(",", *parts), 256)


def leaves(records: DataFrame, offset_col: str, fields: list[str]) -> DataFrame:
    """(offset, hash): one row for each offset; -1 for a null one."""
    r = records.select(F.coalesce(F.col(offset_col).cast("long"), F.lit(-1)).alias("offset"), *[F.col(c).cast("string").alias(f"f{i}") for i, c in enumerate(fields)])
    r = r.select("offset", record_hash([f"f{i}" for i in range(len(fields))]).alias("h"))
    words = [F.sum(F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("long")).alias(f"w{i}") for i in range(8)]
    folded = r.groupBy("offset").agg(F.count("*").alias("n"), *words)
    return folded.select("offset", F.sha2(F.concat_ws(",", "offset", "n", *[f"w{i}" for i in range(8)]), 256).alias("hash"))


def depth(*replicas: DataFrame, offset_col: str, fanout: int = FANOUT) -> int:
    """Levels above the records that give a single root for all replicas."""
    ends = [r.agg(F.min(F.col(offset_col).cast("long")), F.max(F.col(offset_col).cast("long"))).first() for r in replicas]
    if any(lo is not None and lo < 0 for lo, _ in ends):
        raise ValueError("offsets must not be negative")
    top, levels = max([hi for _, hi in ends if hi is not None], default=0) + 1, 1
    while fanout ** levels <= top:
        levels += 1
    return levels


def write_tree(records: DataFrame, path: str, offset_col: str, fields: list[str], levels: int, fanout: int = FANOUT) -> None:
    """Levels 0 (records; node = offset + 1, so 0 stands for a null offset) to levels
    (the root, node 0) as Parquet folders level=k of (node, parent, hash)."""
    spark = records.sparkSession
    level = leaves(records, offset_col, fields).select((F.col("offset") + 1).alias("node"), "hash")
    for k in range(levels + 1):
        parent = F.floor(F.col("node") / fanout).cast("long")
        level.select("node", parent.alias("parent"), "hash").write.parquet(f"{path}/level={k}")
        if k < levels:
            below = read_level(spark, path, k)
            level = below.groupBy(F.col("parent").alias("node")).agg(
                F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "hash"))), lambda x: F.concat_ws(":", x["node"], x["hash"])), ","), 256).alias("hash"))


def read_level(spark, path: str, k: int) -> DataFrame:
    return spark.read.schema("node long, parent long, hash string").parquet(f"{path}/level={k}")


def mismatches(spark, left: str, right: str, levels: int) -> DataFrame:
    """(node, status) of the differing records of two written trees, by descent from
    the root.  Differing nodes of each level are checkpointed; they are as many as the
    damage makes."""
    suspects = None
    for k in range(levels, -1, -1):
        a, b = read_level(spark, left, k), read_level(spark, right, k)
        if suspects is not None:
            a, b = (x.join(suspects, "parent", "left_semi") for x in (a, b))
        both = a.select("node", F.col("hash").alias("ha")).join(b.select("node", F.col("hash").alias("hb")), "node", "full")
        bad = both.where(~F.col("ha").eqNullSafe(F.col("hb"))).checkpoint()
        suspects = bad.select(F.col("node").alias("parent"))
    status = F.when(F.col("hb").isNull(), MISSING).when(F.col("ha").isNull(), EXTRA).otherwise(ALTERED)
    return bad.select("node", status.alias("status"))


def audit(primary: DataFrame, replica: DataFrame, offset_col: str, fields: list[str], fanout: int = FANOUT) -> DataFrame:
    """(offset, status, range_start, range_end): the records that the replica lacks
    (missing), has besides (extra) or holds otherwise (altered), with the offset range
    of the leaf that led to them."""
    spark = primary.sparkSession
    prepare(spark)
    levels = depth(primary, replica, offset_col=offset_col, fanout=fanout)
    paths = [new_folder(spark, "merkle") for _ in range(2)]
    for records, path in zip((primary, replica), paths):
        write_tree(records, path, offset_col, fields, levels, fanout)
    offset = F.col("node") - 1
    first = F.floor(F.col("node") / fanout).cast("long") * fanout - 1
    return mismatches(spark, *paths, levels).select(
        F.when(offset >= 0, offset).alias("offset"), "status", F.greatest(first, F.lit(0)).alias("range_start"), (first + fanout).alias("range_end"))


def aged_copy(pages: DataFrame) -> DataFrame:
    """A second replica of the pages as bad storage leaves it, by rules on the records'
    own hash: some are lost, some cut short, some re-encoded, some written twice."""
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", "page_id", "url")), 1, 4), 16, 10).cast("int") % 400
    html = (F.when(draw == 1, F.substring("html", 1, 200)).when(draw == 2, F.translate("html", "éèñüß", "?????")).otherwise(F.col("html")))
    kept = pages.select("page_id", "url", html.alias("html"), draw.alias("draw")).where("draw <> 0")
    return kept.unionByName(kept.where("draw = 3")).drop("draw")


#: DuckDB SQL of audit(pages, aged_copy(pages)) over distinct page ids: records compared directly.
ORACLE = f"""
with p as (select page_id, html, cast('0x' || substr(md5(concat_ws('|', page_id, url)), 1, 4) as int) % 400 as draw from pages)
select page_id, case when draw = 0 then '{MISSING}' else '{ALTERED}' end as status,
  greatest((page_id + 1) // {FANOUT} * {FANOUT} - 1, 0) as range_start, (page_id + 1) // {FANOUT} * {FANOUT} + {FANOUT - 1} as range_end
from p where draw in (0, 3) or (draw = 1 and html <> substr(html, 1, 200)) or (draw = 2 and html <> translate(html, 'éèñüß', '?????'))
"""
