"""Hard negatives: exact integer scores by residue-number products in single precision, then windowed selection."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxmeter.llm.common import materialize
from voxmeter.llm.embeddings import usable

#: Moduli, each odd, so residues and digits can be centred. Products of centred residues over SPAN components stay below
#: 2^24, where single precision is exact.
PRIMES = (251, 241, 239, 233, 229, 227, 223, 211)
SPAN = (1 << 24) // 125**2
#: Rows of a block, bytes of its vectors, anchors of a tile, rows of a tile at most, anchors worked on at a time.
BLOCK_ROWS, BLOCK_BYTES, TILE_ANCHORS, TILE_ROWS, STRIP = 4096, 2 << 20, 4096, 1 << 20, 256
#: Bytes of vectors that wait for their block to fill, over all labels.
WAITING = 16 << 20
#: Scores beyond this are refused.
MOST = 1 << 54


def residues(x: np.ndarray, primes: tuple[int, ...]) -> list[np.ndarray]:
    """Whole numbers (as doubles) modulo each prime, centred, in single precision."""
    out = []
    for p in primes:
        r = np.fmod(x, p)
        r -= p * np.rint(r / p)
        out.append(r.astype(np.float32))
    return out


def _centred(s: np.ndarray, p: int) -> np.ndarray:
    s -= np.float32(p) * np.rint(s * np.float32(1 / p))
    # One step more where rounding of 1/p took the neighbour.
    half = np.float32(p // 2)
    s -= np.float32(p) * (s > half)
    s += np.float32(p) * (s < -half)
    return s


def moduli(bound: float) -> tuple[int, ...]:
    """As many primes as tell apart all whole numbers up to the bound, of either sign."""
    product = 1
    for i, p in enumerate(PRIMES):
        product *= p
        if (product - 1) // 2 >= bound:
            return PRIMES[: i + 1]
    raise OverflowError("inner products are too large")


def products(a: list[np.ndarray], b: list[np.ndarray], primes: tuple[int, ...]) -> np.ndarray:
    """The integer matrix a @ b.T from residues: one single-precision product a prime, then Chinese remaindering.

    Remaindering is by mixed radix with centred digits: x = d0 + p0 (d1 + p1 (d2 + ...)), which gives the sign by itself.
    """
    digits: list[np.ndarray] = []
    for i, p in enumerate(primes):
        s = np.zeros((len(a[i]), len(b[i])), np.float32)
        for at in range(0, a[i].shape[1], SPAN):
            s += _centred(a[i][:, at : at + SPAN] @ b[i][:, at : at + SPAN].T, p)
            s = _centred(s, p)
        for q, d in zip(primes[:i], digits, strict=True):
            s = _centred(_centred(s - d, p) * np.float32(pow(q, -1, p)), p)
        digits.append(s)
    out = digits[-1].astype(np.int64)
    for p, d in zip(primes[-2::-1], digits[-2::-1], strict=True):
        out *= p
        out += d.astype(np.int64)
    return out


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, label, v, then lists that anchors carry) -> blocks of one label and dimension, in the order of ids."""
    held: dict[tuple, list[tuple]] = {}
    waiting = 0

    def out(key: tuple) -> pa.RecordBatch:
        ids, vectors, *lists = zip(*held.pop(key), strict=True)
        order = np.argsort(ids, kind="stable")
        x = np.array(vectors)[order]
        small = np.abs(x).max(initial=0) < 1 << 15
        x = x.astype(np.int16) if small else x
        columns = [pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int32()), pa.array([bool(small)]), pa.array([np.array(ids)[order].tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())]
        columns += [pa.array([[v[i] for i in order]], pa.list_(pa.list_(pa.int64()))) for v in lists]
        return pa.RecordBatch.from_arrays(columns, names=["label", "dim", "small", "ids", "x", "others", "scores"][: len(columns)])

    for batch in batches:
        ids, names = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        edges, flat = batch.column(2).offsets.to_numpy(), batch.column(2).values.to_numpy()
        lists = [batch.column(i).to_pylist() for i in range(3, batch.num_columns)]
        for i in range(batch.num_rows):
            v = flat[edges[i] : edges[i + 1]]
            key = (names[i], len(v))
            # A copy, so that no batch stays as long as one of its vectors waits.
            held.setdefault(key, []).append((ids[i], v.copy(), *(x[i] for x in lists)))
            waiting += v.nbytes + 128
            if len(held[key]) >= max(1, min(rows, BLOCK_BYTES // (8 * len(v)))):
                waiting -= sum(x[1].nbytes + 128 for x in held[key])
                yield out(key)
            elif waiting > WAITING:
                for k in list(held):
                    yield out(k)
                waiting = 0
    for k in list(held):
        yield out(k)


def _vectors(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(row["x"], np.int16 if row["small"] else np.float64).astype(np.float64).reshape(len(ids), -1)


class _Side:
    """Vectors of one dimension with their residues, made once for each number of primes."""

    def __init__(self, x: np.ndarray):
        self.x, self.norm, self.held = x, float(np.sqrt((x * x).sum(axis=1).max(initial=0))), {}

    def residues(self, primes: tuple[int, ...]) -> list[np.ndarray]:
        if primes not in self.held:
            self.held[primes] = residues(self.x, primes)
        return self.held[primes]


def _first(group: np.ndarray, score: np.ndarray, ids: np.ndarray, keep: int) -> np.ndarray:
    """Places of the first `keep` of each group: by score, high to low, then id."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    starts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.zeros(0, int)
    return order[np.arange(len(g)) - np.repeat(starts, np.diff(np.append(starts, len(g)))) < keep]


class _Strip:
    """Some anchors of one label and dimension, with the best rows so far in each of their windows."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, label: str, windows: list[list[tuple[int, int, int, int]]], keep: int):
        self.ids, self.label, self.keep, self.side = ids, label, keep, _Side(x)
        flat = [(i, *w) for i, ws in enumerate(windows) for w in ws]
        self.row, self.other, self.score, self.low, self.high = (np.array([w[k] for w in flat], np.int64) for k in range(5))
        n = len(flat)
        # Windows of a rank go together: at most one of an anchor.
        place = np.concatenate([np.arange(len(ws)) for ws in windows]) if n else np.zeros(0, int)
        self.ranks = [np.flatnonzero(place == k) for k in range(int(place.max(initial=-1)) + 1)]
        self.last = np.full(n, np.iinfo(np.int64).max)
        self.best = tuple(np.zeros(0, np.int64) for _ in range(3))

    def meet(self, ids: np.ndarray, block: _Side) -> None:
        bound = self.side.norm * block.norm * (1 + 1e-9) + 1
        if bound >= MOST:
            raise OverflowError("inner products are too large")
        primes = moduli(bound)
        s = products(self.side.residues(primes), block.residues(primes), primes)
        found = [self.best]
        for at in self.ranks:
            rows = self.row[at]
            part = s if len(rows) == len(s) and (rows == np.arange(len(s))).all() else s[rows]
            low, high, last = self.low[at][:, None], self.high[at][:, None], self.last[at][:, None]
            near = (part >= low) & (part <= high)
            i, j = np.nonzero(near)
            # The kth so far holds against equal scores of larger ids.
            new = (ids[j] != self.ids[rows[i]]) & ((part[i, j] > low[i, 0]) | (ids[j] < last[i, 0]))
            i, j = i[new], j[new]
            found.append((at[i], part[i, j], ids[j]))
        group, score, who = (np.concatenate(c) for c in zip(*found, strict=True))
        if len(group) > len(self.best[0]):
            first = _first(group, score, who, self.keep)
            self.best = group, score, who = group[first], score[first], who[first]
            full = np.flatnonzero(np.bincount(group, minlength=len(self.low))[group] == self.keep)
            ends = full[self.keep - 1 :: self.keep]
            self.low[group[ends]], self.last[group[ends]] = score[ends], who[ends]


def _mine(batches: Iterator[pa.RecordBatch], keep: int, same: bool, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """Tiles, anchors first: each anchor's best rows of the same label, or of another one in each positive's window."""
    now, strips = None, []

    def out() -> Iterator[pa.RecordBatch]:
        for s in strips:
            group, score, who = s.best
            columns = (s.ids[s.row[group]], s.other[group], s.score[group], who, score)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["anchor_id", "positive_id", "positive_score", "id", "score"])

    for batch in batches:
        for row in batch.to_pylist():
            if row["tile"] != now:
                yield from out()
                now, strips = row["tile"], []
            ids, x = _vectors(row)
            if row["anchors"]:
                limits = (-(1 << 62), 1 << 62)
                for at in range(0, len(ids), STRIP):
                    if same:
                        windows = [[(0, 0, *limits)] for _ in ids[at : at + STRIP]]
                    else:
                        told = zip(row["others"][at : at + STRIP], row["scores"][at : at + STRIP], strict=True)
                        windows = [[(o, p, -(-low * p // 100), high * p // 100) for o, p in zip(os, ps, strict=True)] for os, ps in told]
                    strips.append(_Strip(ids[at : at + STRIP], x[at : at + STRIP], row["label"], windows, keep))
                continue
            block = _Side(x)
            for s in strips:
                if s.side.x.shape[1] == row["dim"] and (s.label == row["label"]) == same:
                    s.meet(ids, block)
    yield from out()


BLOCK = "label string, dim int, small boolean, ids binary, x binary"


def _tiled(blocks: DataFrame, anchors: DataFrame, rows: int, n: int, keep: int, same: bool, low: int, high: int) -> DataFrame:
    """Every block of rows meets every block of anchors, in tiles: tile (i, j) is a task with part i of one side, j of the other.

    A row of b bytes is copied once for each part of the anchors, to be multiplied with TILE_ANCHORS vectors there, so the
    copies cost little beside the products; no side is broadcast, and each task holds its anchors and one block.
    """
    spark = blocks.sparkSession
    across = max(1, math.ceil(n / TILE_ANCHORS))
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    down = max(1, math.ceil(rows / TILE_ROWS), math.ceil(tasks / across))
    deal = lambda parts: F.pmod(F.xxhash64("ids"), F.lit(parts))
    lists = "array<array<bigint>>"
    if same:
        anchors = anchors.withColumns({"others": F.lit(None).cast(lists), "scores": F.lit(None).cast(lists)})
    columns = ["label", "dim", "small", "ids", "x"]
    none = [F.lit(None).cast(lists).alias(c) for c in ("others", "scores")]
    left = anchors.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(down - 1)))).select((deal(across) * down + F.col("part")).cast("int").alias("tile"), F.lit(True).alias("anchors"), *columns, "others", "scores")
    right = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(across - 1)))).select((F.col("part") * down + deal(down)).cast("int").alias("tile"), F.lit(False).alias("anchors"), *columns, *none)
    tiles = left.unionByName(right).repartitionById(across * down, F.col("tile")).sortWithinPartitions("tile", F.desc("anchors"), "ids")
    return tiles.mapInArrow(functools.partial(_mine, keep=keep, same=same, low=low, high=high), "anchor_id long, positive_id long, positive_score long, id long, score long")


def hard_negatives(
    vectors: DataFrame, anchors: F.Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256, positives: int = 5, keep: int = 10, low: int = 30, high: int = 90
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Components become floor(scale * x), x as double; a score is the integer inner product with the anchor, higher first, ties
    to the smaller id. An anchor's positives are its first `positives` other rows of the same label; for each of them the first
    `keep` rows of other labels come with low * positive_score <= 100 * negative_score <= high * positive_score.

    Scores are exact: residues modulo small primes are multiplied in single precision, and put together by Chinese
    remaindering; the primes needed follow from the vectors' lengths. Rows are in blocks of one label, so positives multiply
    only blocks of the anchor's label and negatives only others. Rows with a null id, label or vector, an empty vector, or a
    null or non-finite component take no part; vectors of another dimension never meet. Rows of the anchor's own id are no
    candidates; of anchors with one id that of the smallest label and vector counts, while repeated candidates each take a
    rank. Vectors whose product of lengths reaches 2^54 raise OverflowError. Other columns are ignored; an empty table, or one
    without anchors, gives no rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(anchors, F.lit(False)).alias("asked"))
    # Beyond 2^53 doubles are whole numbers, which floor() would cut to 64 bits.
    whole = lambda x: F.when(F.abs(x * scale) < float(1 << 53), F.floor(x * scale).cast("double")).otherwise(x * scale)
    rows = rows.where(usable("v") & F.col("id").isNotNull() & F.col("label").isNotNull()).withColumn("v", F.transform("v", whole))
    blocks = materialize(rows.select("id", "label", "v").mapInArrow(functools.partial(_blocks, rows=BLOCK_ROWS), BLOCK), "blocks")
    asked = materialize(rows.where("asked").groupBy("id").agg(F.min(F.struct("label", "v")).alias("a")).select("id", "a.label", "a.v"), "anchors")
    n, count = asked.count(), blocks.agg(F.sum(F.length("ids") / 8)).first()[0] or 0
    shape = functools.partial(_tiled, blocks, rows=count, n=n, low=low, high=high)
    near = shape(anchors=asked.mapInArrow(functools.partial(_blocks, rows=TILE_ANCHORS), BLOCK), keep=positives, same=True)
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    best = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= positives).groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("r", "id", "score"))).alias("p"))
    # Repeated positives have one window.
    once = F.array_distinct(F.transform("p", lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score"))))
    best = materialize(best.select(F.col("anchor_id").alias("id"), once.alias("p")), "positives")
    carried = asked.join(best, "id").select("id", "label", "v", F.col("p.id").alias("others"), F.col("p.score").alias("scores"))
    found = shape(anchors=carried.mapInArrow(functools.partial(_blocks, rows=TILE_ANCHORS), f"{BLOCK}, others array<array<long>>, scores array<array<long>>"), keep=keep, same=False)
    order = Window.partitionBy("anchor_id", "positive_id", "positive_score").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
