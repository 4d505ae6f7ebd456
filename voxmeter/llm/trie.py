"""The prefix trie of conversations: padded turn-id matrices in range shards, whose boundary nodes recombine."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxmeter.llm.common import join_small, materialize, mix64

#: Turns in a row of a matrix: longer conversations take several rows, one for each level. Rows of a shard, ids of a piece.
WIDTH, SHARD_ROWS, PIECE = 64, 1 << 14, 4096
#: Levels of a conversation that one window adds up; above them a second window adds the groups.
GROUP = 4096
#: Keys of nodes are two sums of 62 bits, so that sums over levels fit decimals.
MASK = (1 << 62) - 1
NODE = "kind int, level long, depth long, k1 long, k2 long, q1 long, q2 long, far boolean, parent long, conv_id long, n_convs long, n_ends long, n_children long, n_leaves long, suffix long, distinct long, length long, path array<long>, first long, ends string"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def numbered(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, pos (from 0), k1, k2 (two hashes of role and text), n (code points): each conversation's turns in order.

    Order: turn, null first, then role and text; equal rows stay, as turns of their own. Null roles and texts are empty; rows
    of a null conv_id take no part. Turns are numbered in ranges of (conv_id, turn), so one conversation may fill many tasks;
    the ranges' counts are then added up. Texts travel only where turns of one conversation and number tie.
    """
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = turns.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), F.xxhash64(role, text).alias("k1"), F.xxhash64(F.lit(1), role, text).alias("k2"),
        F.length(text).alias("n"), F.xxhash64(id_col, turn_col).alias("t"), F.pmod(F.monotonically_increasing_id(), F.lit(1024)).alias("salt"))
    ties = materialize(rows.groupBy("t").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("t", F.lit(True).alias("tied")), "ties")
    rows = rows.withColumn("tied", F.lit(False)) if ties.isEmpty() else join_small(rows, ties, "t", "left")
    # Equal rows may lie in any order, so the salt splits them.
    order = ["conv_id", "turn", "role", "text", "salt"]
    lean = rows.select("conv_id", "turn", F.when(F.col("tied"), F.col("role")).alias("role"), F.when(F.col("tied"), F.col("text")).alias("text"), "salt", "k1", "k2", "n")
    ranged = lean.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "k1", "k2", "n")
    held = materialize(ranged.mapInArrow(_number, "conv_id long, part int, at long, k1 long, k2 long, n int"), "turns")
    edges = held.groupBy("part").agg(F.min("conv_id").alias("a"), F.max("conv_id").alias("b")).select("part", F.explode(F.array_distinct(F.array("a", "b"))).alias("conv_id"))
    spans = materialize(edges.groupBy("conv_id").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1").select("conv_id"), "spans")
    if spans.isEmpty():
        return held.select("conv_id", F.col("at").alias("pos"), "k1", "k2", "n")
    counts = join_small(held.select("conv_id", "part"), spans, "conv_id", "left_semi").groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("m"))
    before = counts.select("conv_id", "part", (F.sum("m").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("m")).alias("before"))
    placed = join_small(held, materialize(before, "before"), ["conv_id", "part"], "left")
    return placed.select("conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("pos"), "k1", "k2", "n")


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows -> with the task's number and each row's place among its conversation's rows in this task."""
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column(0).to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], conv[1:] != conv[:-1])))
        at = np.arange(len(conv)) - np.repeat(starts, np.diff(np.append(starts, len(conv))))
        if conv[0] == last:
            at[: starts[1] if len(starts) > 1 else len(at)] += seen
        last, seen = conv[-1], at[-1] + 1
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(conv), part, np.int32)), pa.array(at), *(batch.column(i) for i in (1, 2, 3))], names=["conv_id", "part", "at", "k1", "k2", "n"])


def with_heads(rows: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Numbered turns and ids of conversations that begin as another does: c's first h turns, h = crc32(c) % most, become those
    of conversation c - c % every (fewer or none if it has no more); c's own turns from h on follow."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)).cast("int")
    heads = rows.where((F.col("conv_id") % every == 0) & (F.col("pos") < most - 1)).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "k1", "k2", "n"))).alias("head"))
    ids = rows.select("conv_id").distinct().select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    plan = materialize(ids.join(heads, "base", "left").select("conv_id", "h", F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.array().cast("array<struct<pos:bigint,k1:bigint,k2:bigint,n:int>>")).alias("head")), "heads")
    shifts = plan.where(F.size("head") < F.col("h")).select("conv_id", (F.col("h") - F.size("head")).alias("shift"))
    own = join_small(rows.where(F.col("pos") >= h), materialize(shifts, "shifts"), "conv_id", "left").select("conv_id", (F.col("pos") - F.coalesce("shift", F.lit(0))).alias("pos"), "k1", "k2", "n")
    return own.unionByName(plan.select("conv_id", F.explode("head").alias("x")).select("conv_id", "x.*")), plan.select("conv_id")


def _mixed(k: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """62 bits of a turn at its place; a prefix's key is the sum over its turns."""
    with np.errstate(over="ignore"):
        return mix64(k.astype(np.uint64, copy=False) ^ mix64(pos.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03))) & np.uint64(MASK)


def _chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of up to WIDTH turns in any order -> turns in order, the sums of their keys and of their code points."""
    for batch in batches:
        lists = batch.column(2)
        rows = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        items = lists.flatten()
        at, k1, k2, n = (np.asarray(items.field(c)) for c in ("at", "k1", "k2", "n"))
        order = np.lexsort((at, rows))
        rows, at, k1, k2, n = (x[order] for x in (rows, at, k1, k2, n))
        pos = at + batch.column(1).to_numpy()[rows] * WIDTH
        sums = []
        for k in (k1, k2):
            s = np.zeros(batch.num_rows, np.uint64)
            np.add.at(s, rows, _mixed(k.view(np.uint64), pos))
            sums.append((s & np.uint64(MASK)).astype(np.int64))
        offsets = np.searchsorted(rows, np.arange(batch.num_rows + 1)).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets * 2), pa.array(np.stack([k1, k2], axis=1).reshape(-1)))
        total = np.bincount(rows, n, batch.num_rows).astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ids, pa.ListArray.from_arrays(pa.array(offsets), pa.array(n)), *map(pa.array, (*sums, total))], names=["conv_id", "level", "ids", "n", "s1", "s2", "total"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of id lists, sorted by node and first id -> each node's SHA-256. A digest is sequential, so a node's pieces
    stream through one task, which holds a batch of them at a time."""
    now, digest = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*now, digest.hexdigest()), (*[pa.int64()] * 3, pa.string()), strict=True)], names=["depth", "k1", "k2", "ends_sha256"])

    for batch in batches:
        for *key, ends in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if key != now:
                if now is not None:
                    yield out()
                now, digest = key, hashlib.sha256()
                digest.update(ends.encode())
            else:
                digest.update(("," + ends).encode())
    if now is not None:
        yield out()


def _matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a shard -> its nodes. Only nodes that hold the shard's first or last row can go on in another shard; they
    come as parts (kind 1, and their ends in pieces as kind 2), without what only all their parts together tell."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    column = lambda name: table.column(name).combine_chunks()
    conv, level, p1, p2, after, more, x_children, x_leaves, x_distinct = (np.asarray(column(c)) for c in ("conv_id", "level", "p1", "p2", "after", "more", "x_children", "x_leaves", "x_distinct"))
    lens = np.diff(column("n").offsets.to_numpy())
    n, keys = np.asarray(column("n").flatten()), np.asarray(column("ids").flatten()).reshape(-1, 2)
    count, width = len(conv), int(lens.max())
    row = np.repeat(np.arange(count), lens)
    at = np.arange(len(n)) - np.repeat(np.cumsum(lens) - lens, lens)
    # A turn's id in the matrix is the rank of its hashes, so rows are ordered here as shards are; 0 is the padding.
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    ranked = keys[order]
    ids = np.empty(len(n), np.int32)
    ids[order] = np.cumsum(np.concatenate(([True], (ranked[1:] != ranked[:-1]).any(axis=1))))[: len(n)]
    turns, points = np.zeros((count, width), np.int32), np.zeros((count, width), np.int64)
    turns[row, at], points[row, at] = ids, n
    sums = np.zeros((2, count, width + 1), np.uint64)
    sums[0, :, 0], sums[1, :, 0] = p1, p2
    for lane in (0, 1):
        sums[lane, row, at + 1] = _mixed(keys[:, lane].copy().view(np.uint64), at + level[row] * WIDTH)
    order = np.lexsort((conv, *turns.T[::-1], p2, p1, level))
    conv, level, after, more, x_children, x_leaves, x_distinct, lens, turns, points = (x[order] for x in (conv, level, after, more, x_children, x_leaves, x_distinct, lens, turns, points))
    with np.errstate(over="ignore"):
        sums = (np.cumsum(sums[:, order], axis=2, dtype=np.uint64) & np.uint64(MASK)).astype(np.int64)
    new = np.ones((count, width + 1), bool)
    new[1:, 0] = (level[1:] != level[:-1]) | (sums[:, 1:, 0] != sums[:, :-1, 0]).any(axis=0)
    new[1:, 1:] = turns[1:] != turns[:-1]
    new = np.logical_or.accumulate(new, axis=1)
    rest = np.cumsum(points[:, ::-1], axis=1)[:, ::-1] + after[:, None] if width else np.zeros((count, 0), np.int64)
    rest = np.concatenate((rest[:, :1] if width else after[:, None], rest), axis=1)
    leaves, distinct, children = x_leaves.copy(), x_distinct.copy(), np.zeros(count, np.int64)
    below: dict | None = None

    def out(node: dict) -> pa.RecordBatch:
        m = len(node["depth"])
        empty = np.zeros(m, np.int64)
        path = node.pop("path", None)
        columns = []
        for field in NODE.split(", "):
            name, kind = field.split(" ")
            if name == "path":
                columns.append(pa.array(path if path is not None else [None] * m, pa.list_(pa.int64())))
            else:
                columns.append(pa.array(node.get(name, [None] * m if kind == "string" else empty), {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}[kind]))
        return pa.RecordBatch.from_arrays(columns, names=[f.split(" ")[0] for f in NODE.split(", ")])

    for d in range(width, -1, -1):
        idx = np.flatnonzero(lens >= d)
        if not len(idx):
            continue
        s = np.flatnonzero(new[idx, d])
        heads, size = idx[s], np.diff(np.append(s, len(idx)))
        least = np.minimum.reduceat(conv[idx], s)
        ended = (lens[idx] == d) & ~more[idx]
        n_ends = np.add.reduceat(ended.astype(np.int64), s)
        bound = np.zeros(len(s), bool)
        bound[0] = idx[0] == 0
        bound[-1] |= idx[-1] == count - 1
        length = points[heads, d - 1] if d else np.zeros(len(s), np.int64)
        leaves[heads] += (n_ends == size) & ~bound
        distinct[heads] += np.where(bound, 0, length)
        if below is not None:
            parent = np.searchsorted(heads, below["head"], "right") - 1
            below["parent"] = least[parent]
            below["far"] = bound[parent] | ((d == 0) & (below["level"] > 0)) | (below["kind"] == 1)
            yield out(below)
        stays = np.where((lens[idx] == d) & more[idx], x_children[idx], 0) + children[idx]
        node = {"kind": bound.astype(np.int32), "level": level[heads], "depth": level[heads] * WIDTH + d, "k1": sums[0, heads, d], "k2": sums[1, heads, d], "conv_id": least, "n_convs": size, "n_ends": n_ends, "n_children": np.add.reduceat(stays, s)}
        node |= {"n_leaves": np.add.reduceat(leaves[idx], s), "suffix": np.add.reduceat(rest[idx, d], s), "distinct": np.add.reduceat(distinct[idx], s), "length": length, "head": heads}
        if d:
            node |= {"q1": sums[0, heads, d - 1], "q2": sums[1, heads, d - 1]}
        node["path"] = [sums[:, h, :d].T.reshape(-1) if b else None for h, b in zip(heads, bound, strict=True)] if bound.any() else None
        told, own = conv[idx[ended]], np.repeat(np.arange(len(s)), size)[ended]
        edges = np.searchsorted(own, np.arange(len(s) + 1))
        text = np.array([None] * len(s), object)
        for i in np.flatnonzero(n_ends > 0):
            members = told[edges[i] : edges[i + 1]].tolist()
            if not bound[i]:
                text[i] = hashlib.sha256(",".join(map(str, members)).encode()).hexdigest()
                continue
            first = range(0, len(members), PIECE)
            piece = {c: np.full(len(first), node[c][i]) for c in ("level", "depth", "k1", "k2")} | {"kind": np.full(len(first), 2, np.int32)}
            yield out(piece | {"first": np.array([members[j] for j in first]), "ends": [",".join(map(str, members[j : j + PIECE])) for j in first]})
        node["ends"] = text
        children[:] = 0
        children[heads] = ~bound
        below = node
    below["far"] = below["kind"] == 1
    yield out(below)


def _shards(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of rows (see _matrix): those whole in a shard, and those of several, recombined; level, depth, k1, k2 are their key."""
    parts = max(1, math.ceil(rows.count() / SHARD_ROWS))
    ranged = rows.repartitionByRange(parts, "level", "p1", "p2", "ids", "conv_id")
    told = materialize(ranged.mapInArrow(_matrix, NODE), "nodes")
    key, of_key = ["level", "depth", "k1", "k2"], lambda c: F.first(c).alias(c)
    added = [F.sum(c).alias(c) for c in ("n_convs", "n_ends", "n_children", "n_leaves", "suffix", "distinct")]
    shared = told.where("kind = 1").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), *added, *map(of_key, ("length", "path", "q1", "q2")))
    shared = materialize(shared.withColumn("leaf", (F.col("n_ends") == F.col("n_convs")).cast("long")), "shared")
    # Each shared node counts once for itself and for all above it in its row; these are shared too.
    steps = F.expr(f"transform(sequence(0, size(path) div 2 - 1), i -> struct(level * {WIDTH} + i AS depth, path[2 * i] AS k1, path[2 * i + 1] AS k2, CAST(i = size(path) div 2 - 1 AS bigint) AS child))")
    above = shared.where(F.size("path") > 0).select("level", "leaf", "length", F.explode(steps).alias("x")).select("level", "x.*", "leaf", "length")
    above = above.unionByName(shared.select("level", "depth", "k1", "k2", F.lit(0).cast("long").alias("child"), "leaf", "length"))
    above = above.groupBy(*key).agg(*(F.sum(c).alias(f"up_{c}") for c in ("child", "leaf", "length")))
    pieces = told.where("kind = 2").select("depth", "k1", "k2", "ends", "first").repartition("depth", "k1", "k2").sortWithinPartitions("depth", "k1", "k2", "first")
    digests = pieces.drop("first").mapInArrow(_digests, "depth long, k1 long, k2 long, ends_sha256 string")
    whole = shared.join(above, key).join(digests, ["depth", "k1", "k2"], "left").select(
        *key, "q1", "q2", F.lit(True).alias("far"), F.lit(None).cast("long").alias("parent"), "conv_id", "n_convs", (F.col("n_children") + F.col("up_child")).alias("n_children"), (F.col("n_leaves") + F.col("up_leaf")).alias("n_leaves"),
        "suffix", (F.col("distinct") + F.col("up_length")).alias("distinct"), F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))
    alone = told.where("kind = 0").select(*key, "q1", "q2", "far", "parent", "conv_id", "n_convs", "n_children", "n_leaves", "suffix", "distinct", F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"))
    return alone, materialize(whole, "whole")


def _by_level(chunks: DataFrame) -> DataFrame:
    """conv_id, level, p1, p2, after, more of conversations with several levels: key sums before, code points behind."""
    long = materialize(chunks.where("level = 1").select("conv_id"), "long")
    rows = join_small(chunks.select("conv_id", "level", "s1", "s2", "total", F.floor(F.col("level") / GROUP).alias("g")), long, "conv_id", "left_semi")
    sums = ("s1", "s2", "total")
    rows = rows.select("conv_id", "level", "g", *(F.col(c).cast("decimal(38,0)").alias(c) for c in sums))
    groups = rows.groupBy("conv_id", "g").agg(*(F.sum(c).alias(f"g_{c}") for c in sums), F.max("level").alias("last"))
    outer, all_of = Window.partitionBy("conv_id").orderBy("g"), Window.partitionBy("conv_id")
    groups = groups.select("conv_id", "g", *((F.sum(f"g_{c}").over(outer) - F.col(f"g_{c}")).alias(f"b_{c}") for c in sums), F.sum("g_total").over(all_of).alias("all"), F.max("last").over(all_of).alias("last"))
    inner = Window.partitionBy("conv_id", "g").orderBy("level")
    rows = rows.select("conv_id", "level", "g", *((F.sum(c).over(inner) - F.col(c)).alias(f"i_{c}") for c in sums), "total").join(groups, ["conv_id", "g"])
    before = lambda c: F.col(f"i_{c}") + F.col(f"b_{c}")
    key = lambda c: (before(c) % (MASK + 1)).cast("long")
    return rows.select("conv_id", "level", key("s1").alias("p1"), key("s2").alias("p2"), (F.col("all") - before("total") - F.col("total")).cast("long").alias("after"), (F.col("level") < F.col("last")).alias("more"))


def _below(rows: DataFrame, levels: DataFrame, deepest: int) -> DataFrame:
    """conv_id, level, x_*: what hangs under the last node of a row that goes on, at the row of its smallest member.

    Sums over all levels below come by doubling: after k rounds a node has those of 2^k levels.
    """
    alone, whole = _shards(rows.where("level > 0"))
    tops = alone.unionByName(whole).where(F.col("depth") == F.col("level") * WIDTH).select("level", "k1", "k2", "conv_id", F.col("n_children").alias("x_children"), F.col("n_leaves").alias("x_leaves"), F.col("distinct").alias("x_distinct"))
    step = 1
    while step < deepest:
        up = tops.where(F.col("level") > step).select("conv_id", (F.col("level") - step).alias("level"), "x_leaves", "x_distinct").join(levels.select("conv_id", "level", F.col("p1").alias("k1"), F.col("p2").alias("k2")), ["conv_id", "level"])
        up = up.groupBy("level", "k1", "k2").agg(F.sum("x_leaves").alias("u_leaves"), F.sum("x_distinct").alias("u_distinct"))
        more = lambda c: (F.col(f"x_{c}") + F.coalesce(f"u_{c}", F.lit(0))).alias(f"x_{c}")
        tops = materialize(tops.join(up, ["level", "k1", "k2"], "left").select("level", "k1", "k2", "conv_id", "x_children", more("leaves"), more("distinct")), "tops")
        step *= 2
    return tops.select("conv_id", (F.col("level") - 1).alias("level"), "x_children", "x_leaves", "x_distinct")


def nodes(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """The trie of numbered conversations (conv_id, pos, k1, k2, n; see numbered()): one row for each distinct prefix.

    conv_id: the smallest member; depth: turns of the prefix, 0 at the root; parent_conv_id: the parent's smallest member, null
    at the root; n_convs: conversations that start so; n_children; n_leaves: childless nodes from here on; saved_tokens: over
    the nodes from here on, (n_convs - 1) times the code points of the node's last text; ends_sha256: SHA-256 of the decimal
    ids, ascending, joined by commas, of the conversations that end here. ids adds conversations, such as those without turns.

    A conversation is rows of WIDTH turns; a row's key is the level and the sum of the hashes before it. Rows are dealt by
    ranges of (level, key, turn ids, conv_id): a group of copies splits like any other. In a shard the rows are one matrix,
    sorted by columns; where a column changes, or one before it, a node starts, and reduceat adds up each depth. Nodes that
    reach a shard's edge are recombined by their keys. Two different prefixes share a key with a chance of 2^-124 a pair.
    """
    turn = F.struct((F.col("pos") % WIDTH).cast("long").alias("at"), "k1", "k2", "n")
    held = rows.select("conv_id", F.floor(F.col("pos") / WIDTH).cast("long").alias("level"), turn.alias("turn"))
    every = (ids if ids is not None else rows.where("pos = 0").select("conv_id")).select("conv_id", F.lit(0).cast("long").alias("level"), F.lit(None).cast(held.schema["turn"].dataType).alias("turn"))
    grouped = held.unionByName(every).groupBy("conv_id", "level").agg(F.collect_list("turn").alias("turns"))
    chunks = materialize(grouped.mapInArrow(_chunk, "conv_id long, level long, ids array<long>, n array<int>, s1 long, s2 long, total long"), "chunks")
    deepest = chunks.agg(F.max("level")).first()[0] or 0
    zero = F.lit(0).cast("long")
    none = {"x_children": zero, "x_leaves": zero, "x_distinct": zero}
    if deepest:
        levels = materialize(_by_level(chunks), "levels")
        chunks = join_small(chunks, levels, ["conv_id", "level"], "left").select("conv_id", "level", "ids", "n", F.coalesce("p1", zero).alias("p1"), F.coalesce("p2", zero).alias("p2"), F.coalesce("after", zero).alias("after"), F.coalesce("more", F.lit(False)).alias("more"))
        below = materialize(_below(chunks.withColumns(none), levels, deepest), "below")
        chunks = join_small(chunks, below, ["conv_id", "level"], "left").withColumns({c: F.coalesce(c, zero) for c in none})
    else:
        chunks = chunks.select("conv_id", "level", "ids", "n", zero.alias("p1"), zero.alias("p2"), zero.alias("after"), F.lit(False).alias("more")).withColumns(none)
    alone, whole = _shards(chunks)
    mine = (F.col("depth") > F.col("level") * WIDTH) | (F.col("level") == 0)
    alone, whole = alone.where(mine), whole.where(mine)
    # Parents outside the shard: shared nodes, and the last nodes of rows that go on.
    parents = whole.unionByName(alone.where((F.col("depth") == (F.col("level") + 1) * WIDTH) & (F.col("n_children") > 0)))
    parents = materialize(parents.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("conv_id").alias("far_parent")), "parents")
    far = join_small(alone.where("far").unionByName(whole), parents, ["depth", "q1", "q2"], "left").withColumn("parent", F.when(F.col("depth") > 0, F.col("far_parent"))).drop("far_parent")
    found = alone.where("not far").withColumn("parent", F.when(F.col("depth") > 0, F.col("parent"))).unionByName(far)
    return found.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", (F.col("suffix") - F.col("distinct")).alias("saved_tokens"), "ends_sha256")


def prefix_trie(conversations: DataFrame, **columns: str) -> DataFrame:
    """nodes() of conversations as they are. Empty tables give no rows; other columns are ignored. See numbered() for the order
    of turns and what becomes of nulls, ties and repeated rows; texts of any length count by hash and code points alone."""
    return nodes(numbered(conversations, **columns))
