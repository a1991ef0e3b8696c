"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in id order, form blocks.  A source of weight w (the share of
the stream it should have) gets for its block k the release time floor(k / w) and the
deadline ceil((k + 1) / w) in slots; each slot goes to the released block with the
earliest deadline (ties: order of listing).  While all sources last, the number of
blocks of a source in any first t slots is less than one block from w * t.

Weights are exact: fractions as given, or a float's nearest fraction with a denominator up
to DENOMINATOR.  In whole shares without common factor they add up to the period after
which the schedule repeats, so it is worked out for one period only, and a block's slot
then is arithmetic on its number.  A period of more than MAX_PERIOD slots raises
ValueError; nothing is rounded.  When a source runs out, a new phase begins with the
weights of the others, and the same bound from its first slot on; no document is dropped
or repeated.

Named sources are bounded by the weights given; all others, null included, share the
weight REST as one source.  Ranking within a source needs no window over it: sources
are cut into id ranges by quantiles, in numbers that follow their sizes, so one that
holds a third of all rows fills a third of the partitions; a row's rank is its range's
offset plus its place in the sorted range.  Only counts by range reach the driver.

Defined cases: null ids come first in their source; repeated ids keep all their rows;
texts don't matter; all columns are kept as they are, and a column named like the result
raises ValueError (free_name gives one that is not taken); an empty table gives an empty
result.
"""

from __future__ import annotations

from fractions import Fraction
from heapq import heappop, heappush
from math import gcd, lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routewise.llm.common import SMALL_BATCH_BYTES, prepare

#: Of the fraction that a float is read as, at most; slots after which a schedule repeats, at most.
DENOMINATOR = 10**6
MAX_PERIOD = 1 << 20
BLOCK_DOCS = 16
#: Source 0 of a schedule: all that have no weight of their own.
REST = 0


def whole_weights(weights: list, denominator: int = DENOMINATOR) -> list[int]:
    """Whole shares in exactly the proportion of the weights, without common factor."""
    exact = [w if isinstance(w, Fraction) else Fraction(w).limit_denominator(denominator) for w in weights]
    if min(exact) <= 0:
        raise ValueError("weights must be positive")
    scale = lcm(*(w.denominator for w in exact))
    out = [int(w * scale) for w in exact]
    k = gcd(*out)
    if sum(out) // k > MAX_PERIOD:
        raise ValueError(f"weights {weights} repeat after {sum(out) // k} slots, more than {MAX_PERIOD}")
    return [x // k for x in out]


def period(shares: list[int]) -> list[int]:
    """The source of each slot of one period: earliest deadline first among released
    blocks."""
    total, given, out = sum(shares), [0] * len(shares), []
    # release floor(k * total / share), deadline ceil((k + 1) * total / share)
    waiting = [(0, i) for i in range(len(shares))]
    ready: list[tuple[int, int]] = []
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            i = heappop(waiting)[1]
            heappush(ready, (-(-(given[i] + 1) * total // shares[i]), i))
        i = heappop(ready)[1]
        given[i] += 1
        if given[i] < shares[i]:
            heappush(waiting, (given[i] * total // shares[i], i))
        out.append(i)
    return out


def phases(blocks: list[int], weights: list) -> list[dict]:
    """The schedule of sources with so many blocks: for each phase its first slot,
    period, and by source the blocks before, blocks within and slots in a period."""
    done, slot, out = [0] * len(blocks), 0, []
    while active := [i for i, n in enumerate(blocks) if done[i] < n]:
        shares = whole_weights([weights[i] for i in active])
        order = [active[i] for i in period(shares)]
        share = dict(zip(active, shares))
        full = min((blocks[i] - done[i]) // share[i] for i in active)
        left = {i: blocks[i] - done[i] - full * share[i] for i in active}
        extra = 0
        for i in order:  # a part of a period, up to the first source that has none left
            if left[i] == 0:
                break
            left[i] -= 1
            extra += 1
        now = {i: blocks[i] - done[i] - left[i] for i in active}
        out.append({"slot": slot, "period": len(order), "before": {i: done[i] for i in active}, "within": now,
                    "places": {i: [t for t, x in enumerate(order) if x == i] for i in active}})
        slot += full * len(order) + extra
        for i in active:
            done[i] += now[i]
    return out


def slots(schedule: list[dict], source: int, block: np.ndarray) -> np.ndarray:
    """Slots of a source's blocks, given by number."""
    out = np.full(len(block), -1, np.int64)
    for p in schedule:
        if source in p["before"]:
            k = block - p["before"][source]
            at = (k >= 0) & (k < p["within"][source])
            places = np.array(p["places"][source])
            out[at] = p["slot"] + k[at] // len(places) * p["period"] + places[k[at] % len(places)]
    return out


def free_name(docs: DataFrame, name: str = "mix") -> str:
    """name, with as many underscores as make it no column of docs."""
    while name in docs.columns:
        name += "_"
    return name


def mix(docs: DataFrame, weights: dict[str, float], rest: float, block_docs: int = BLOCK_DOCS, id_col: str = "doc_id",
        source_col: str = "source", out_col: str = "mix") -> DataFrame:
    """docs with a column out_col: struct<source int, block long, slot long, position long>;
    position is the row's place in the mixed stream."""
    spark = docs.sparkSession
    prepare(spark, SMALL_BATCH_BYTES)
    names = list(weights)
    share = [rest, *weights.values()]
    if min(share) <= 0:
        raise ValueError("weights must be positive")
    if out_col in docs.columns:
        raise ValueError(f"the documents have a column {out_col}")
    source = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in names]), F.col(source_col).cast("string")), F.lit(0)).cast("int") if names else F.lit(0)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    slim = docs.select(source.alias("s"), key.alias("k"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # one row for each named source and the rest
    stats = slim.groupBy("s").agg(F.count("*").alias("n"), F.percentile_approx("k", [i / parts for i in range(1, parts)] or [0.5], 20 * parts).alias("q")).collect()
    total = sum(r["n"] for r in stats)
    cuts, first = {}, {}
    for r in sorted(stats, key=lambda r: r["s"]):
        n = max(1, round(parts * r["n"] / total))
        cuts[r["s"]] = np.array(sorted({r["q"][min(len(r["q"]) - 1, i * parts // n - 1)] for i in range(1, n)}), np.int64)
        first[r["s"]] = sum(len(cuts[s]) + 1 for s in first)
    n_ranges = sum(len(c) + 1 for c in cuts.values()) or 1

    @F.arrow_udf("int")
    def range_of(s: pa.Array, k: pa.Array) -> pa.Array:
        s, k = s.to_numpy(zero_copy_only=False), k.to_numpy(zero_copy_only=False)
        out = np.zeros(len(s), np.int32)
        for x in np.unique(s).tolist():
            at = s == x
            out[at] = first[x] + np.searchsorted(cuts[x], k[at], "left")
        return pa.array(out)

    per = {r["r"]: r["n"] for r in slim.select(range_of("s", "k").alias("r")).groupBy("r").agg(F.count("*").alias("n")).collect()}
    offset, number = np.zeros(n_ranges, np.int64), {}
    for s, c in cuts.items():
        sizes = [per.get(first[s] + i, 0) for i in range(len(c) + 1)]
        offset[first[s]:first[s] + len(sizes)] = np.cumsum([0, *sizes[:-1]])
        number[s] = sum(sizes)
    sources = sorted(number)
    schedule = phases([-(-number[s] // block_docs) for s in sources], [share[s] for s in sources])
    place = {s: i for i, s in enumerate(sources)}
    # a source's last block may be short: all later slots lie nearer by as much
    short = sorted((int(slots(schedule, place[s], np.array([-(-number[s] // block_docs) - 1]))[0]), -number[s] % block_docs) for s in sources)
    short_at, short_by = np.array([a for a, _ in short]), np.cumsum([0, *(n for _, n in short)])

    @F.arrow_udf("struct<block long, slot long, position long>")
    def scheduled(s: pa.Array, r: pa.Array, local: pa.Array) -> pa.Array:
        s, rank = s.to_numpy(zero_copy_only=False), offset[r.to_numpy(zero_copy_only=False)] + local.to_numpy(zero_copy_only=False)
        block, slot = rank // block_docs, np.zeros(len(rank), np.int64)
        for x in np.unique(s).tolist():
            at = s == x
            slot[at] = slots(schedule, place[x], block[at])
        position = slot * block_docs + rank % block_docs - short_by[np.searchsorted(short_at, slot, "left")]
        return pa.StructArray.from_arrays([pa.array(x) for x in (block, slot, position)], names=["block", "slot", "position"])

    rows = docs.select(F.struct(*docs.columns).alias("row"), source.alias("s"), key.alias("k")).withColumn("r", range_of("s", "k"))
    # the other columns order rows of a repeated id
    rows = rows.repartitionById(n_ranges, "r").sortWithinPartitions("r", "k", F.xxhash64("row"))
    rows = rows.withColumn("local", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    rows = rows.withColumn("m", scheduled("s", "r", "local"))
    return rows.select("row.*", F.struct(F.col("s").alias("source"), "m.block", "m.slot", "m.position").alias(out_col))


def in_order(mixed: DataFrame, col: str = "mix") -> DataFrame:
    """The rows in stream order over range partitions, without the mix column."""
    n = max(1, int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    top = F.col(f"{col}.position")
    return mixed.repartitionByRange(n, top).sortWithinPartitions(top).drop(col)
