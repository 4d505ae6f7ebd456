"""The trie of conversations against a brute-force one."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from voxmeter.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, n long, k1 string, level int, part int"


def brute(convs):
    members, kids = defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for k in members:
        if k:
            kids[k[:-1]].add(k)
    saved, leaves = defaultdict(int), defaultdict(int)
    for k, m in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * (len(k[-1][1]) if k else 0)
            leaves[k[:d]] += not kids[k]
    out = []
    for k, m in members.items():
        ends = sorted(c for c in m if len(convs[c]) == len(k))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def rebuilt(own):
    base = lambda c: c - (abs(c) % 100) * (1 if c >= 0 else -1)
    return {c: own.get(base(c), [])[: (h := zlib.crc32(str(c).encode()) % 6)] + t[h:] for c, t in own.items()}


def rows_of(own, rng):
    rows = [(c, None if i == 0 and c % 3 == 0 else i, r, t, 1, "a", 2, 3) for c, turns in own.items() for i, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    return rows


def told(df):
    return sorted(map(tuple, df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


@pytest.mark.parametrize("shard", [1 << 14, 23])
def test_trie(spark, monkeypatch, shard):
    """Many shared prefixes, a large group of copies, absent and short bases, conversations of several levels that share them."""
    monkeypatch.setattr(trie, "SHARD_ROWS", shard)
    rng, own = random.Random(3), {}
    for c in range(-130, 420):
        if c in (200, -100):
            continue
        turns = [(rng.choice(["user", "assistant"]), "w" * rng.randint(0, 3)) for _ in range(rng.choice([1, 2, 3, 5, 8]))]
        own[c] = [("user", "ü" * 7)] * 6 if c % 3 == 0 else turns
    for c in (11, 12, 13, 14, 15, 311, 312):
        own[c] = [("user", "z" * (i % 5)) for i in range({11: 64, 12: 65, 13: 128, 14: 300, 15: 300, 311: 299, 312: 200}[c])] + [("user", "end")] * (c % 2)
    df = spark.createDataFrame(rows_of(own, rng) + [(None, 1, "user", "x", 1, "a", 2, 3)], SCHEMA).repartition(6)
    assert told(trie.prefix_trie(df)) == brute(own)
    assert told(trie.nodes(*trie.with_heads(trie.numbered(df)))) == brute(rebuilt(own))


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert not trie.prefix_trie(empty).collect()
    assert not trie.nodes(*trie.with_heads(trie.numbered(empty))).collect()
    long = "é" * 3_000_000
    # Ties by role, then text; equal rows are turns of their own; nulls are empty; ids without turns are members of the root.
    rows = [(5, 1, "b", "x"), (5, 1, "a", "z"), (5, 1, "a", "y"), (5, None, None, None), (5, 1, "a", "y"), (7, 3, "", ""), (7, None, "q", long), (8, 1, "", None)]
    df = spark.createDataFrame([(*r, 1, "a", 2, 3) for r in rows], SCHEMA)
    want = {5: [("", ""), ("a", "y"), ("a", "y"), ("a", "z"), ("b", "x")], 7: [("q", long), ("", "")], 8: [("", "")]}
    assert told(trie.prefix_trie(df)) == brute(want)
    held = trie.numbered(df)
    ids = spark.createDataFrame([(i,) for i in (5, 7, 8, 9)], "conv_id long")
    assert told(trie.nodes(held, ids)) == brute({**want, 9: []})
    assert told(trie.nodes(held.where("false"), ids)) == brute({i: [] for i in (5, 7, 8, 9)})


def test_a_hot_conversation_is_numbered_in_many_tasks(spark):
    """Ranges split one conversation, also among equal rows."""
    df = spark.range(20000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("conv_id"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("turn"), F.lit("user").alias("role"), F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = trie.numbered(df).where("conv_id = -1").orderBy("pos").collect()
        parts = trie.numbered(df)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r["pos"] for r in rows] == list(range(len(rows)))
    nulls = sum(1 for i in range(20000) if i % 3 and i % 2)
    assert all(r["n"] == 0 for r in rows[:nulls]) and all(r["n"] > 0 for r in rows[nulls:])
    assert parts.count() == 20000
