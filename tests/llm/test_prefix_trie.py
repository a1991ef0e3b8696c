"""Conversation prefix trie (13)."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from routewise.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trunc(c):
    return c - int(np.fmod(c, 20))


def brute(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            turns[c].append(((t is not None, t or 0, key), (role, text)))
    turns = {c: [x for _, x in sorted(v)] for c, v in turns.items()}
    convs = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        convs[c] = tuple(turns.get(trunc(c), [])[:h] + turns[c][h:])
    members = defaultdict(list)
    for c, p in convs.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in members:
        own = (len(members[p]) - 1) * len(re.findall("[^\x20\x09-\x0d]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += own
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(kids[p]), leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p)))).encode()).hexdigest()) for p, m in members.items())


def built(df, **kw):
    return sorted(tuple(-1 if x is None else x for x in r) for r in P.trie(df, **kw).select(*COLUMNS).collect())


def some(seed=1, n=160):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        for t in range(int(rng.integers(0, 9))):
            rows.append((c, t, ["user", "assistant"][t % 2], "hello there" if rng.random() < 0.6 else "word " * int(rng.integers(0, 4))))
    return rows


@pytest.mark.parametrize("limit", [P.LIMIT, 40, 2])
def test_equals_brute_force(spark, limit):
    """With one node above the shards, and with most nodes there."""
    rows = some()
    assert built(spark.createDataFrame(rows, SCHEMA).repartition(5), limit=limit) == brute(rows)


def test_hot_conversations(spark):
    """A third of all rows in one conversation, a third with one text, and ids that end
    in one node."""
    rows = some(2, 40)
    rows += [(1000, t, "user", f"t{t % 7}") for t in range(700)]
    rows += [(1001, t, "user", f"t{t % 7}") for t in range(650)]
    rows += [(2000 + c, t, "user", "same") for c in range(300) for t in range(2)]
    assert built(spark.createDataFrame(rows, SCHEMA).repartition(5), limit=100) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "x"), (3, None, None, None), (3, 2, "", ""), (3, 2, "", ""), (3, 1, "a", "b c"), (3, 1, "b", "a"), (21, 0, "user", "only one"), (22, 5, "user", "x"),
            (-7, 0, "user", "below"), (-20, 0, "system", "base"), (-21, 0, "x", "y"), (-21, 1, "x", "z"), (2**63 - 1, 0, "u", "t"), (-2**63, 0, "u", "t"),
            (0, 0, "user", "zero"), (0, 1, "user", "one"), (5, 0, "user", "w " * 40_000), (20, 0, "user", "\t \n"), (23, 0, "1:ab", "c"), (24, 0, "1", ":abc")]
    df = spark.createDataFrame(rows, SCHEMA)
    extra = ["n", "len", "pos", "idx", "ha", "hb", "words", "cid", "cut", "part", "edge", "digest", "ends", "depth", "base", "h", "m"]
    want = brute(rows)
    assert built(df.select("*", *[F.lit("z").alias(c) for c in extra])) == want and built(df, limit=1) == want
    assert built(df.limit(0)) == []


def test_slots_are_minimal_and_perfect():
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64))
        s = P.Slots(keys)
        assert sorted(s.of(keys).tolist()) == list(range(len(keys)))
        if n:
            with pytest.raises(RuntimeError):
                s.of(keys + np.uint64(1))


def test_running_sums_over_ranges(spark):
    rng = np.random.default_rng(4)
    rows = [(int(k), i, int(v)) for i, (k, v) in enumerate(zip(np.where(rng.random(2000) < 0.5, 7, rng.integers(0, 50, 2000)), rng.integers(-2**63, 2**63 - 1, 2000)))]
    got = P.running(spark.createDataFrame(rows, "k long, at long, v long").repartition(6), "k", ["at"], ["v"], "test-running").collect()
    sums, want = defaultdict(int), {}
    for k, at, v in rows:
        before = sums[k]
        sums[k] += v
        want[at] = tuple((x + 2**63) % 2**64 - 2**63 for x in (before, sums[k]))
    assert {r["at"]: (r["v_before"], r["v"]) for r in got} == want


def test_differing_rows_of_a_digest_raise():
    one = np.ones(2, np.int64)
    u = np.array([5, 5], np.uint64)
    args = [one, np.array([True, True]), u, u, 0 * u, 0 * u, u, np.array([5, 6], np.uint64), one, one, one]
    with pytest.raises(RuntimeError):
        P.node_table(*args)
