"""Embedding operators: near-duplicates by sign hashing, and exact top-k search by vector approximations."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxmeter.llm.common import BROADCAST_BYTES, join_small, materialize
from voxmeter.llm.connect import _edges, components, labels

THRESHOLD = 0.98
#: Share of links at the threshold that the tables together may miss, at most.
MISS = 1e-5
#: Vectors that an average bucket of all labels together should hold, and vectors that one comparison takes on a side.
#: Larger buckets need fewer bits, so fewer tables, so less to shuffle; comparing some hundred vectors costs little.
BUCKET, BLOCK = 512, 512
SEED = 5
#: Candidates of a query that one task reads.
CANDIDATES = 256
#: Share of links at the threshold that the comparison of codes may take for strangers, at most.
STRANGERS = 1e-7
#: Vectors in a block of an approximation file, queries in a block, bytes of either at most, and bits of a cell.
CELL_BLOCK, QUERY_BLOCK, BLOCK_BYTES, BITS = 4096, 512, 1 << 20, 8


def plan_tables(rows: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """Bits of a hash and number of tables: bits grow with the logarithm of the rows, tables keep the missed share."""
    bits = max(4, min(30, math.ceil(math.log2(max(2, rows / BUCKET)))))
    same = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-min(same, 1 - 1e-12))))


def most_apart(n: int, threshold: float) -> int:
    """Bits of n in which two vectors at the threshold differ at most, but for a share of STRANGERS of them."""
    p = math.acos(min(1.0, threshold)) / math.pi
    if p <= 0:
        return 0
    tail, k = 1.0, -1
    while tail > STRANGERS and k < n:
        k += 1
        tail -= math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    return k


def _codes(batches: Iterator[pa.RecordBatch], bits: int, tables: int) -> Iterator[pa.RecordBatch]:
    """Each vector, in 32 bits if that loses nothing, and its code in every table. Planes depend on the seed and dimension alone."""
    planes: dict[int, np.ndarray] = {}
    weights = 1 << np.arange(bits, dtype=np.int32)
    for batch in batches:
        lists = batch.column(4)
        size = np.diff(lists.offsets.to_numpy()) if batch.num_rows else np.zeros(0, int)
        for d in np.unique(size):
            at = np.flatnonzero(size == d)
            part = batch.take(pa.array(at))
            x = part.column(4).flatten().to_numpy().astype(np.float64).reshape(-1, d)
            if d not in planes:
                planes[d] = np.random.default_rng(SEED).standard_normal((d, bits * tables))
            code = ((_units(x) @ planes[d] > 0).reshape(len(x), tables, bits) * weights).sum(axis=2, dtype=np.int32)
            with np.errstate(over="ignore", under="ignore"):
                short = x.astype(np.float32)
            x = short if (short == x).all() else x
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(4)), pa.array(np.full(len(at), d, np.int32)), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(list(code), pa.list_(pa.int32()))], names=["u", "rep", "label", "n", "dim", "held", "codes"])


def _meet(batches: Iterator[pa.RecordBatch], apart: int) -> Iterator[pa.RecordBatch]:
    """Rows of buckets (table, bucket, then codes of one or two sides) -> those that meet one of few other bits there first."""
    for batch in batches:
        out: list[tuple[np.ndarray, int, int]] = []
        for row in range(batch.num_rows):
            table, bucket = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
            sides = []
            for k in (2, 3):
                items = batch.column(k)[row].values
                if items is not None and len(items):
                    sides.append((np.array(items.field("u")), np.array(items.field("codes").flatten()).reshape(len(items), -1)))
            if len(sides) < 1 or len(batch.column(2)[row].values) == 0:
                continue
            (u, x), (w, y) = sides[0], sides[-1]
            bits, earlier = np.zeros((len(u), len(w)), np.int32), np.zeros((len(u), len(w)), bool)
            for t in range(x.shape[1]):
                other = x[:, t, None] ^ y[None, :, t]
                bits += np.bitwise_count(other)
                if t < table:
                    earlier |= other == 0
            near = (bits <= apart) & ~earlier
            if len(sides) == 1:
                np.fill_diagonal(near, False)
                out.append((u[near.any(axis=1)], bucket, table))
            else:
                out += [(u[near.any(axis=1)], bucket, table), (w[near.any(axis=0)], bucket, table)]
        columns = [np.concatenate([x[0] for x in out]), *(np.repeat(np.array([x[i] for x in out], np.int64), [len(x[0]) for x in out]) for i in (1, 2))] if out else [np.zeros(0, np.int64)] * 3
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2].astype(np.int32))], names=["u", "bucket", "table"])


def _in_blocks(members: DataFrame, columns: list[str]) -> DataFrame:
    """table, bucket, x, y: the members (bucket, table, columns) of each bucket, in blocks of BLOCK, each with each from it on.

    y is empty where a block meets itself. Buckets of one member meet nobody.
    """
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("bucket", F.ceil(F.col("m") / BLOCK).cast("int").alias("parts"))
    sizes = materialize(sizes, "buckets")
    item = F.struct(*columns)
    few = join_small(members, sizes.where("parts = 1").select("bucket"), "bucket", "left_semi")
    met = few.groupBy("bucket", "table").agg(F.collect_list(item).alias("x")).select("table", "bucket", "x", F.filter("x", lambda _: F.lit(False)).alias("y"))
    large = sizes.where("parts > 1")
    if large.isEmpty():
        return met
    many = join_small(members, large, "bucket", "inner").withColumn("part", F.pmod(F.xxhash64("u"), "parts").cast("int"))
    ahead = many.select("bucket", "table", F.col("part").alias("p"), F.explode(F.sequence(F.col("part"), F.col("parts") - 1)).alias("q"), item.alias("item"), F.lit(True).alias("left"))
    behind = many.where("part > 0").select("bucket", "table", F.explode(F.sequence(F.lit(0), F.col("part") - 1)).alias("p"), F.col("part").alias("q"), item.alias("item"), F.lit(False).alias("left"))
    pairs = ahead.unionByName(behind).groupBy("bucket", "table", "p", "q").agg(F.collect_list(F.when(F.col("left"), F.col("item"))).alias("x"), F.collect_list(F.when(~F.col("left"), F.col("item"))).alias("y"))
    return met.unionByName(pairs.where("p = q or size(y) > 0").select("table", "bucket", "x", "y"))


def _units(x: np.ndarray) -> np.ndarray:
    """The vectors with their lengths made 1, in double precision, whatever the lengths."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _stack(held: list[bytes], d: int) -> np.ndarray:
    return np.stack([np.frombuffer(v, np.float32 if len(v) == 4 * d else np.float64) for v in held]).astype(np.float64)


def _links(ids: np.ndarray, n: np.ndarray, x: np.ndarray, codes: np.ndarray, other: tuple | None, table: int, threshold: float) -> tuple:
    """Linked pairs of a block with itself, or with another block, that no earlier table holds in one bucket."""
    ids_b, n_b, y, codes_b = other or (ids, n, x, codes)
    i, j = np.nonzero(x @ y.T >= threshold - 1e-9)
    if other is None:
        i, j = i[i < j], j[i < j]
    exact = np.einsum("ij,ij->i", x[i], y[j]) >= threshold
    i, j = i[exact], j[exact]
    new = ~(codes[i, :table] == codes_b[j, :table]).any(axis=1)
    return i, j, new


def _compare(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows of buckets (table, then the vectors of one or two sides) -> id, links, and the smallest id linked to within the block."""
    for batch in batches:
        out_id, out_n, out_to = [], [], []
        for row in range(batch.num_rows):
            table = batch.column(0)[row].as_py()
            sides = []
            for k in (2, 3):
                items = batch.column(k)[row].values
                if items is None or not len(items):
                    sides.append(None)
                    continue
                ids, n = np.array(items.field("rep")), np.array(items.field("n"))
                held, d = items.field("held").to_pylist(), items.field("dim")[0].as_py()
                codes = np.array(items.field("codes").flatten()).reshape(len(ids), -1)
                sides.append((ids, n, _units(_stack(held, d)), codes))
            if sides[0] is None:
                continue
            i, j, new = _links(*sides[0], sides[1], table, threshold)
            left, right = sides[0], sides[1] or sides[0]
            m = len(left[0])
            shift = m if sides[1] is not None else 0
            every = np.concatenate([left[0], right[0]]) if shift else left[0]
            links = np.zeros(len(every), np.int64)
            np.add.at(links, i[new], right[1][j[new]])
            np.add.at(links, j[new] + shift, left[1][i[new]])
            order = np.argsort(every, kind="stable")
            place = np.empty(len(every), np.int64)
            place[order] = np.arange(len(every))
            root = labels(len(every), place[i], place[j + shift])
            to = every[order][root[place]]
            keep = (links > 0) | (to != every)
            out_id.append(every[keep])
            out_n.append(links[keep])
            out_to.append(to[keep])
        none = [np.zeros(0, np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x or none), pa.int64()) for x in (out_id, out_n, out_to)], names=["rep", "links", "root"])


def usable(col: str) -> F.Column:
    """Not null, not empty, no null or non-finite component."""
    finite = F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(F.col(col).isNotNull() & (F.size(col) > 0) & finite, F.lit(False))


def keys() -> dict[str, F.Column]:
    """Two hashes of a vector v: equal vectors meet by 128 bits instead of by all components."""
    return {"k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit(1), "v")}


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row: links between vectors of equal label and cosine >= threshold.

    Random hyperplanes give each vector a sign code in several tables (see plan_tables); vectors with one label, dimension
    and code meet. First only codes travel: of those that meet, the ones whose codes of all tables differ in few bits (see
    most_apart) may be linked. Only these are then fetched, and compared exactly, in double precision; a pair counts in the
    first table where it meets. Equal vectors of a label stand for one another, and count as linked. A large bucket is split
    into blocks, compared pair of blocks by pair, so no task holds a bucket. n_links counts other rows linked directly;
    component_id is the smallest vec_id that links reach; kept says that it is the row's own. Vectors that are null, empty,
    zero or hold null or non-finite components, and rows with null label or vec_id, link with nothing. Repeated rows link
    with one another like other equal vectors. Other columns are ignored; an empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    fits = usable("v") & F.exists("v", lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = rows.select("vec_id", F.when(fits, F.col("v")).alias("v"), "label").withColumns(keys())
    rows = materialize(rows, "vectors")
    classes = rows.where("v is not null").groupBy("label", "k1", "k2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    classes = materialize(classes.withColumn("u", F.monotonically_increasing_id()), "classes")
    bits, tables = plan_tables(rows.count(), threshold)
    label = rows.schema["label"].dataType.simpleString()
    coded = classes.select("u", "rep", "label", "n", "v").mapInArrow(functools.partial(_codes, bits=bits, tables=tables), f"u long, rep long, label {label}, n long, dim int, held binary, codes array<int>")
    coded = materialize(coded, "codes")
    spread = coded.select("u", "codes", "label", "dim", F.posexplode("codes").alias("table", "code")).select("u", "codes", "table", F.xxhash64("label", "dim", "table", "code").alias("bucket"))
    met = _in_blocks(spread, ["u", "codes"]).mapInArrow(functools.partial(_meet, apart=most_apart(bits * tables, threshold)), "u long, bucket long, table int")
    members = materialize(met.distinct(), "members")
    fetched = materialize(members.join(coded.select("u", "rep", "n", "dim", "held", "codes"), "u"), "fetched")
    compared = _in_blocks(fetched, ["rep", "n", "dim", "held", "codes"]).mapInArrow(functools.partial(_compare, threshold=threshold), "rep long, links long, root long")
    compared = materialize(compared, "links")
    linked = compared.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = components(compared.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    known = classes.select("label", "k1", "k2", "rep", "n").join(linked, "rep", "left").join(comp.withColumnRenamed("id", "rep"), "rep", "left")
    known = known.select("label", "k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    known = materialize(known.where("n_links > 0"), "known")
    named = join_small(rows.select("vec_id", F.when(F.col("v").isNotNull(), F.col("label")).alias("label"), "k1", "k2"), known, ["label", "k1", "k2"], "left")
    return named.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _grid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors (u, v) in blocks: each component's grid, and the number of each vector's cell in it."""
    for d, us, x in _gathered(batches, CELL_BLOCK):
        low = x.min(axis=0)
        step = np.maximum(1, np.ceil((x.max(axis=0) - low + 1) / (1 << BITS)))
        cells = np.minimum(np.floor((x - low) / step), (1 << BITS) - 1).astype(np.uint8)
        # Large numbers are rounded here, so a cell reaches as far as its vectors do.
        step = np.maximum(step, (x - (low + cells * step)).max(axis=0) + 1)
        yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in (us, low, step, cells))], names=["dim", "us", "low", "step", "cells"])


def _gathered(batches: Iterator[pa.RecordBatch], size: int, extra: bool = False) -> Iterator[tuple]:
    """Rows (id, vector, and with extra a number) by dimension, in blocks of so many rows and BLOCK_BYTES at most."""
    kept: dict[int, list[tuple]] = {}
    for batch in batches:
        dims = np.diff(batch.column(1).offsets.to_numpy()) if batch.num_rows else np.zeros(0, int)
        for d in np.unique(dims).tolist():
            most = max(1, min(size, BLOCK_BYTES // (8 * d)))
            part = batch.take(pa.array(np.flatnonzero(dims == d)))
            columns = [part.column(0).to_numpy(), part.column(1).flatten().to_numpy().reshape(-1, d), *([part.column(2).to_numpy()] if extra else [])]
            held = kept.setdefault(d, [])
            held.append(tuple(columns))
            if sum(len(x[0]) for x in held) >= most:
                every = [np.concatenate(x) for x in zip(*kept.pop(d), strict=True)]
                whole = len(every[0]) // most * most
                for at in range(0, whole, most):
                    yield (d, *(x[at : at + most] for x in every))
                if whole < len(every[0]):
                    kept[d] = [tuple(x[whole:] for x in every)]
    for d, held in kept.items():
        yield (d, *(np.concatenate(x) for x in zip(*held, strict=True)))


def _queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries (id, v, least) in blocks. least: the score that a row must be able to reach."""
    for d, ids, x, least in _gathered(batches, QUERY_BLOCK, True):
        yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in (ids, x, least))], names=["q_dim", "q_ids", "q_exact", "q_least"])


def _bounds(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries' vectors with the lower and upper bounds of their scores with a block's vectors, from the cells alone.

    A cell is as wide as the next along each component, so the bounds are one product and two sums for each query.
    """
    d = row["dim"]
    low, step = np.frombuffer(row["low"], np.float64), np.frombuffer(row["step"], np.float64)
    q = np.frombuffer(row["q_exact"], np.float64).reshape(-1, d)
    least = low + np.frombuffer(row["cells"], np.uint8).reshape(-1, d) * step
    base = q @ least.T
    # Room for rounding where numbers are large.
    room = np.finfo(float).eps * 8 * d * (np.abs(q) @ np.maximum(np.abs(least), np.abs(least + step)).max(axis=0))
    room[room < 0.25] = 0
    return q, base + (np.minimum(q, 0) @ (step - 1) - room)[:, None], base + (np.maximum(q, 0) @ (step - 1) + room)[:, None]


def _sure(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Each query's k highest lower bounds in this task's blocks."""
    held: dict[bytes, np.ndarray] = {}
    for batch in batches:
        for row in batch.to_pylist():
            _, lower, _ = _bounds(row)
            if row["q_ids"] in held:
                lower = np.concatenate([held[row["q_ids"]], lower], axis=1)
            held[row["q_ids"]] = -np.partition(-lower, k - 1, axis=1)[:, :k] if lower.shape[1] > k else lower
    for ids, lower in held.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.frombuffer(ids, np.int64), lower.shape[1])), pa.array(lower.reshape(-1))], names=["id", "lower"])


def _maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that can reach what their query asks at least, with their upper bounds."""
    for batch in batches:
        for row in batch.to_pylist():
            _, _, upper = _bounds(row)
            i, j = np.nonzero(upper >= np.frombuffer(row["q_least"], np.float64)[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row["q_ids"], np.int64)[i]), pa.array(np.frombuffer(row["us"], np.int64)[j]), pa.array(upper[i, j])], names=["id", "u", "upper"])


def _exact(x: np.ndarray, q: np.ndarray) -> list[int]:
    """Integer inner products, of whatever size."""
    if np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * len(q) < 1 << 52:
        return (x @ q).astype(np.int64).tolist()
    whole = [sum(int(a) * int(b) for a, b in zip(row, q, strict=True)) for row in x]
    if any(abs(v) >= 1 << 63 for v in whole):
        raise OverflowError("a score does not fit a long")
    return whole


def _certain(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Exact vectors of each query (and part of its candidates) in the order of their bounds, until no bound reaches the kth score."""
    now, last, best, done = None, None, [], False

    def out() -> pa.RecordBatch:
        n = len(best)
        return pa.RecordBatch.from_arrays([pa.array([now] * n, pa.int64()), pa.array(range(1, n + 1), pa.int32()), pa.array([i for _, i in best], pa.int64()), pa.array([-s for s, _ in best], pa.int64())], names=["query_id", "rank", "vec_id", "score"])

    for batch in batches:
        ids, upper = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        parts = batch.column(5).to_numpy()
        edges = [0, *(np.flatnonzero((np.diff(ids) != 0) | (np.diff(parts) != 0)) + 1).tolist(), len(ids)]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if lo == hi:
                continue
            if (ids[lo], parts[lo]) != (now, last):
                if now is not None:
                    yield out()
                now, last, best, done = int(ids[lo]), int(parts[lo]), [], False
            q = batch.column(4)[lo].values.to_numpy()
            while lo < hi and not done:
                if len(best) == k and upper[lo] < -best[-1][0]:
                    done = True
                    break
                part = batch.slice(lo, min(2 * k, hi - lo))
                lo += part.num_rows
                scores = _exact(part.column(3).flatten().to_numpy().reshape(-1, len(q)), q)
                best += [(-s, i) for s, own in zip(scores, part.column(2).to_pylist(), strict=True) for i in own if i != now]
                best = sorted(best)[:k]
    if now is not None:
        yield out()


def _chunks(queries: DataFrame, most: int) -> list[DataFrame]:
    """Query blocks in parts that hold `most` bytes each, by hash; no more parts than blocks, which hold BLOCK_BYTES each."""
    size = F.length("q_exact") + F.length("q_ids") + F.length("q_least") + 256
    total, rows = queries.agg(F.sum(size), F.count(F.lit(1))).first()
    n = max(1, min(math.ceil((total or 0) / most), rows))
    while n < rows:
        part = F.pmod(F.xxhash64("q_ids"), F.lit(n))
        if (queries.groupBy(part.alias("part")).agg(F.sum(size).alias("bytes")).agg(F.max("bytes")).first()[0] or 0) <= most:
            break
        n = min(2 * n, rows)
    return [queries.where(F.pmod(F.xxhash64("q_ids"), F.lit(n)) == i) for i in range(n)] if n > 1 else [queries]


def top_k(vectors: DataFrame, queries: F.Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, scale: int = 1024, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k rows of highest integer inner product, ties to the smaller vec_id.

    Components become floor(scale * x), x as double. An approximation file holds cells only: each component's cell in a grid
    of its block. A first scan of the cells gives each query a score that k rows are sure to reach, over all blocks; a second
    one the rows that can reach it. Only these rows' exact vectors are fetched, and read in the order of their bounds until
    the kth result is certain. Equal vectors count as one, with the ids of k + 1 rows, so a vector that very many rows share
    costs no more. Queries, a stated set, meet the cells in parts of broadcast_bytes, one after another. Vectors that are null, empty, or hold
    null or non-finite components take no part; nor do null ids. Vectors of another dimension than the query's are no
    candidates. Rows with the query's own id are no candidates either; of queries with one id the smallest vector counts,
    while repeated candidates each take a rank. Scores beyond a long raise. An empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asked"))
    # Beyond 2^53 doubles are whole numbers, which floor() would cut to 64 bits.
    whole = lambda x: F.when(F.abs(x * scale) < float(1 << 53), F.floor(x * scale).cast("double")).otherwise(x * scale)
    rows = rows.where(usable("v") & F.col("id").isNotNull()).select("id", F.transform("v", whole).alias("v"), "asked").withColumns(keys())
    first = Window.partitionBy("k1", "k2").orderBy("id")
    exact = rows.select("id", "v", "k1", "k2").withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).groupBy("k1", "k2").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("v").alias("v"))
    exact = materialize(exact.select(F.monotonically_increasing_id().alias("u"), "ids", "v"), "exact")
    files = materialize(exact.select("u", "v").mapInArrow(_grid, "dim int, us binary, low binary, step binary, cells binary"), "cells")
    asked = materialize(rows.where("asked").groupBy("id").agg(F.min("v").alias("v")), "asked")
    blocks = "q_dim int, q_ids binary, q_exact binary, q_least binary"

    def scanned(held: DataFrame, scan: Callable, ddl: str) -> DataFrame:
        held = materialize(held.mapInArrow(_queries, blocks), "queries")
        # Parts are measured, so each may be broadcast; each is a job of its own, so that no two are held at a time.
        met = [files.join(F.broadcast(part), F.col("dim") == F.col("q_dim")).drop("q_dim").mapInArrow(scan, ddl) for part in _chunks(held, broadcast_bytes)]
        return met[0] if len(met) == 1 else functools.reduce(DataFrame.unionByName, [materialize(m, "scanned") for m in met])

    # One of the k + 1 may be the query's own row.
    lower = scanned(asked.withColumn("least", F.lit(0.0)), functools.partial(_sure, k=k + 1), "id long, lower double")
    order = Window.partitionBy("id").orderBy(F.desc("lower"))
    least = lower.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).groupBy("id").agg(F.min("lower").alias("lower"), F.count(F.lit(1)).alias("n"))
    held = asked.join(least, "id", "left").select("id", "v", F.when(F.col("n") > k, F.col("lower")).otherwise(float("-inf")).alias("least"))
    maybe = materialize(scanned(held, _maybe, "id long, u long, upper double"), "maybe")
    # A query that very many rows can answer is split, so that no task reads them all; its parts' results are merged.
    many = maybe.groupBy("id").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > CANDIDATES).select("id", F.ceil(F.col("m") / CANDIDATES).cast("int").alias("parts"))
    part = F.coalesce(F.pmod(F.xxhash64("u"), "parts").cast("int"), F.lit(0))
    split = join_small(maybe, materialize(many, "many"), "id", "left").withColumn("part", part)
    near = split.join(exact, "u").join(asked.withColumnRenamed("v", "q"), "id").select("id", "upper", "ids", "v", "q", "part")
    near = near.repartition("id", "part").sortWithinPartitions("id", "part", F.desc("upper"))
    found = near.mapInArrow(functools.partial(_certain, k=k), "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
