"""Connected components, and links within groups of any size, for the near-duplicate operators."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmeter.llm.common import join_small, materialize

#: Rows of a group that one comparison holds on a side, and bytes of their payloads.
BLOCK_ROWS, BLOCK_BYTES = 256, 4 << 20
#: Up to so many blocks of rows that their leader doesn't link are met block by block, so a row travels eight times on average at most.
MIXED_PARTS = 4
#: A token in more rows of a group than that gets its count by a join of measured size, so no task gathers its rows.
OFTEN = 4096


def components(edges: DataFrame) -> DataFrame:
    """id, component (its smallest id) of every id in the edges (a, b), by alternating large-star and small-star rounds.

    Each round is a shuffle by id with partial minima first, so a centre with very many links costs one row a task; the
    rounds end when the edges no longer change, after about the logarithm of the longest path. Loops and repeated edges
    do no harm; ids in no edge get no row.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        told = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if told == before or not told[0]:
            break
        before = told
        # Large-star: every larger neighbour of u links to the smallest of u and its neighbours.
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small-star: u and its smaller neighbours link to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        near = large.join(low, "a")
        small = near.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        now = materialize(small.distinct(), "edges")
    found = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return found.unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest connected index of each of n items under the links (i, j)."""
    out = np.arange(n)
    while len(i):
        before = out.copy()
        low = np.minimum(out[i], out[j])
        np.minimum.at(out, i, low)
        np.minimum.at(out, j, low)
        out = out[out]
        if (out == before).all():
            break
    return out


#: Similar (list of payloads of the left side, of the right side or None for the left with itself) -> linked index pairs.
Similar = Callable[[list[bytes], list[bytes] | None], tuple[np.ndarray, np.ndarray]]


def _whole(batches: Iterator[pa.RecordBatch], similar: Similar) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = [], []
        for ids, held in zip(batch.column(0), batch.column(1), strict=True):
            ids = np.array(ids.values.to_numpy())
            order = np.argsort(ids, kind="stable")
            ids, held = ids[order], held.values.take(pa.array(order)).to_pylist()
            i, j = similar(held, None)
            root = labels(len(ids), i, j)
            moved = np.flatnonzero(root != np.arange(len(ids)))
            a.append(ids[moved])
            b.append(ids[root[moved]])
        yield _edges(a, b)


def _edges(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    none = [np.zeros(0, np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a or none), pa.int64()), pa.array(np.concatenate(b or none), pa.int64())], names=["a", "b"])


def _led(batches: Iterator[pa.RecordBatch], similar: Similar) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        linked = np.zeros(batch.num_rows, bool)
        leaders, held = batch.column(3).to_pylist(), batch.column(2).to_pylist()
        at = 0
        while at < len(held):
            to = at + 1
            while to < len(held) and to - at < BLOCK_ROWS and leaders[to] == leaders[at]:
                to += 1
            linked[at + similar(held[at:to], [leaders[at]])[0]] = True
            at = to
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 1, 2, 4)), pa.array(linked)], names=["grp", "id", "payload", "leader", "linked"])


def _blocks(batches: Iterator[pa.RecordBatch], similar: Similar) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = [], []
        for row in range(batch.num_rows):
            ids, held, of, against = (batch.column(k)[row].values for k in range(4))
            if not len(ids) or not len(of):
                continue
            left, right = np.array(ids), np.array(of)
            i, j = similar(held.to_pylist(), against.to_pylist())
            n = len(left)
            root = labels(n + len(right), i, j + n)
            every = np.concatenate([left, right])
            moved = np.flatnonzero(root != np.arange(len(every)))
            a.append(every[moved])
            b.append(every[root[moved]])
        yield _edges(a, b)


#: Payload -> distinct 64-bit tokens of a row.
Tokens = Callable[[bytes], np.ndarray]


def _tokens(batches: Iterator[pa.RecordBatch], tokens: Tokens, share: float) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, BLOCK_ROWS):
            batch = whole.slice(at, BLOCK_ROWS)
            held = [tokens(x) for x in batch.column(2).to_pylist()]
            size = np.array([len(x) for x in held], np.int64)
            # Of two rows that share that part of their tokens, each has a common one among so many of its first, in any fixed order.
            first = size - np.ceil(size * share - 1e-9).astype(np.int64) + 1
            row = np.repeat(np.arange(len(held)), size)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).take(pa.array(row)) for k in (0, 1, 3)), pa.array(np.concatenate([*held, np.zeros(0, np.int64)]).astype(np.int64)), pa.array(size[row]), pa.array(first[row])],
                names=["key", "grp", "linked", "token", "size", "first"],
            )


def _by_rare_tokens(mixed: DataFrame, tokens: Tokens, share: float) -> DataFrame:
    """Rows (grp, id, payload) of smaller groups in which all similar pairs of mixed (grp, id, payload, linked) with an unlinked row meet.

    Tokens of a group are ordered by the number of its rows that hold them; two rows that share the given part of their
    tokens share one of their rarest. Rows travel as tokens and numbers first; whole payloads go only to tokens that two
    rows have among their rarest, and of tokens with equal rows to one. Tokens of one row need no place in a shuffle.
    """
    keyed = mixed.withColumn("key", F.xxhash64("grp", "id", "payload"))
    made = keyed.select("key", "grp", "payload", "linked").mapInArrow(functools.partial(_tokens, tokens=tokens, share=share), f"key long, grp {mixed.schema['grp'].dataType.simpleString()}, linked boolean, token long, size long, first long")
    made = materialize(made, "tokens")
    on = ["grp", "token"]
    counts = materialize(made.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "tallies")
    held = join_small(made, counts.where(F.col("n") > OFTEN), on, "left")
    held = held.where("n is not null").unionByName(join_small(held.where("n is null").drop("n"), counts.where(F.col("n") <= OFTEN), on, "inner").select(*held.columns))
    # The rarest are those that no other row has; what is left of a row's first tokens are its rarest shared ones.
    shared = held.groupBy("key", "grp", "linked", "size", "first").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("x"))
    places = F.greatest(F.col("first") - F.col("size") + F.size("x"), F.lit(0)).cast("int")
    rare = materialize(shared.select("key", "grp", "linked", F.explode(F.slice("x.token", F.lit(1), places)).alias("token")), "rare")
    met = rare.groupBy(*on).agg(F.count(F.lit(1)).alias("n"), F.bool_or(~F.col("linked")).alias("open"), F.sum(F.col("key").cast("decimal(38,0)")).alias("total"), F.bit_xor("key").alias("bits"))
    kept = materialize(met.where("n > 1 and open").groupBy("grp", "n", "total", "bits").agg(F.min("token").alias("token")).select(*on), "kept")
    members = join_small(rare, kept, on, "left_semi").select("key", F.xxhash64(*on).alias("at"))
    return materialize(members.join(keyed.select("key", "id", "payload").hint("merge"), "key").select(F.col("at").alias("grp"), "id", "payload"), "members")


def link_groups(rows: DataFrame, similar: Similar, tokens: Tokens | None = None, share: float = 0.0) -> DataFrame:
    """Edges (a, b) that connect, within each grp of rows (grp, id, payload), whatever its similar pairs connect.

    A group that fits a block is compared whole. A larger one is first compared with its smallest id (rows that are
    similar to it are connected already); the others, and only they, are then compared with every row of the group in
    pairs of blocks. So no task holds a group, a group of near copies costs as many comparisons as it has rows, and no
    similar pair goes unseen. Links of one block come out as a spanning forest, never as all pairs. Where similar rows have
    the given share of each one's tokens in common, a group with many others is split by their rare tokens instead, and
    only what stays large and mixed under one rare token is compared by blocks.
    """
    sizes = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("payload")).alias("bytes"))
    parts = F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    sizes = materialize(sizes.where("n > 1").select("grp", parts.alias("parts")), "sizes")
    few = join_small(rows, sizes.where("parts <= 1").select("grp"), "grp", "left_semi")
    few = few.groupBy("grp").agg(F.collect_list(F.struct("id", "payload")).alias("x")).select(F.col("x.id").alias("ids"), F.col("x.payload").alias("held"))
    edges = few.mapInArrow(functools.partial(_whole, similar=similar), "a long, b long")
    large = sizes.where("parts > 1")
    if large.isEmpty():
        return edges
    many = join_small(rows, large.select("grp"), "grp", "left_semi")
    leaders = many.groupBy("grp").agg(F.min(F.struct("id", "payload")).alias("l")).select("grp", F.col("l.id").alias("leader"), F.col("l.payload").alias("lead"))
    leaders = materialize(leaders, "leaders")
    # With few leaders rows stay where they are: a large group isn't gathered in one task.
    led = join_small(many, leaders, "grp", "inner").select("grp", "id", "payload", "lead", "leader")
    led = materialize(led.mapInArrow(functools.partial(_led, similar=similar), f"grp {rows.schema['grp'].dataType.simpleString()}, id long, payload binary, leader long, linked boolean"), "led")
    edges = edges.unionByName(led.where("linked and id <> leader").select(F.col("id").alias("a"), F.col("leader").alias("b")))
    rest = led.where(~F.col("linked"))
    left = rest.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("payload")).alias("bytes")).select("grp", parts.alias("rest_parts"))
    left = materialize(left, "left")
    if tokens is not None:
        mixed = left.where(F.col("rest_parts") > MIXED_PARTS).select("grp")
        if not mixed.isEmpty():
            split = _by_rare_tokens(join_small(led.select("grp", "id", "payload", "linked"), mixed, "grp", "left_semi"), tokens, share)
            edges = edges.unionByName(link_groups(split, similar))
            left = left.where(F.col("rest_parts") <= MIXED_PARTS)
    at = F.xxhash64("id")
    led = join_small(join_small(led, left, "grp", "inner"), large.select("grp", "parts"), "grp", "inner")
    lone = led.where(~F.col("linked")).select("grp", F.pmod(at, "rest_parts").cast("int").alias("u"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("v"), "id", "payload", F.lit(True).alias("left"))
    every = led.select("grp", F.explode(F.sequence(F.lit(0), F.col("rest_parts") - 1)).alias("u"), F.pmod(at, "parts").cast("int").alias("v"), "id", "payload", F.lit(False).alias("left"))
    item = F.struct("id", "payload")
    met = lone.unionByName(every).groupBy("grp", "u", "v").agg(F.collect_list(F.when(F.col("left"), item)).alias("x"), F.collect_list(F.when(~F.col("left"), item)).alias("y"))
    met = met.select(F.col("x.id").alias("i"), F.col("x.payload").alias("p"), F.col("y.id").alias("j"), F.col("y.payload").alias("q"))
    return edges.unionByName(met.mapInArrow(functools.partial(_blocks, similar=similar), "a long, b long"))
