"""What several operators share: tables in the shared folder, size-checked joins, word hashing on Arrow buffers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxmeter.sources.session import shared_dir

#: A side of a join is broadcast only up to so many measured bytes; beyond them Spark shuffles both sides.
BROADCAST_BYTES = 16 << 20
#: Bytes of a row in a hash table besides its columns.
ROW_BYTES = 48
#: Texts are worked on in slices of about so many bytes, so a task's memory does not follow the batch size.
SLICE_BYTES = 1 << 20


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def byte_size(value: F.Column, kind: T.DataType) -> F.Column:
    """Bytes that a value takes in a row: its own, those of its items, and a word for each of them."""
    if isinstance(kind, T.StringType | T.BinaryType):
        size = F.octet_length(value) + 16
    elif isinstance(kind, T.ArrayType):
        fixed = not isinstance(kind.elementType, T.StringType | T.BinaryType | T.ArrayType | T.StructType | T.MapType)
        size = F.size(value) * 8 + 24 if fixed else F.aggregate(value, F.lit(24).cast("long"), lambda n, x: n + byte_size(x, kind.elementType))
    elif isinstance(kind, T.StructType):
        size = sum((byte_size(value[f.name], f.dataType) for f in kind.fields), F.lit(16))
    elif isinstance(kind, T.MapType):
        return byte_size(F.map_keys(value), T.ArrayType(kind.keyType)) + byte_size(F.map_values(value), T.ArrayType(kind.valueType))
    else:
        return F.lit(8).cast("long")
    return F.coalesce(size.cast("long"), F.lit(8))


def measured(df: DataFrame) -> int:
    """Bytes of all rows of a materialized table in a broadcast's hash table, from the rows themselves."""
    row = sum((byte_size(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(ROW_BYTES))
    return df.agg(F.sum(row)).first()[0] or 0


def join_small(left: DataFrame, right: DataFrame, on: str | list[str], how: str) -> DataFrame:
    """Join with `right` (a materialized table), broadcast only if its measured bytes fit BROADCAST_BYTES; else a shuffle join."""
    return left.join(F.broadcast(right) if measured(right) <= BROADCAST_BYTES else right.hint("merge"), on, how)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of an Arrow string column, without copying; null rows are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    held = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return held, offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about `limit` bytes; one longer text makes a run of its own."""
    _, offsets = text_buffers(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeded(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 32)) * np.uint64(0x9E3779B97F4A7C15))


BYTE_HASH = seeded(256, 7)
POWER_BASE = np.uint64(0x9E3779B97F4A7C55)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of A-Z-lower-cased texts, for all rows at once.

    Returns their 64-bit hashes, start and end bytes, and the first word of each row (with one entry past the end).
    """
    n, rows = len(data), len(offsets) - 1
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(rows + 1, np.int64)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = ~space
    starts[1:] &= space[:-1] | edge[1:n]
    ends = ~space
    ends[:-1] &= space[1:] | edge[1:n]
    ends = np.flatnonzero(ends) + 1
    at = np.flatnonzero(starts)
    first = np.searchsorted(at, offsets)
    if not len(at):
        return np.zeros(0, np.uint64), at, ends, first
    length = ends - at
    powers = np.cumprod(np.full(int(length.max()), POWER_BASE, np.uint64))
    inside = np.flatnonzero(~space)
    begin = np.concatenate(([0], np.cumsum(length)[:-1]))
    lower = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)[inside]
    held = BYTE_HASH[lower] * powers[np.arange(len(inside)) - np.repeat(begin, length)]
    return mix64(np.add.reduceat(held, begin) + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), at, ends, first


def shingles_of(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each row's k-word shingles, in order, and the first shingle of each row.

    A row of fewer than k words (but some) gives its whole sequence as one shingle; a row without words none.
    """
    count = np.diff(first)
    out_count = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    out_first = np.concatenate(([0], np.cumsum(out_count)))
    out = np.zeros(out_first[-1], np.uint64)
    factors = seeded(k, 11) | np.uint64(1)
    if len(words) >= k:
        held = np.zeros(len(words) - k + 1, np.uint64)
        for j in range(k):
            held += words[j : j + len(held)] * factors[j]
        long = count >= k
        n = out_count[long]
        to, begin = np.repeat(out_first[:-1][long], n), np.repeat(first[:-1][long], n)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out[to + step] = mix64(held[begin + step])
    for i in np.flatnonzero((count > 0) & (count < k)):
        w = words[first[i] : first[i + 1]]
        out[out_first[i]] = mix64((w * factors[: len(w)]).sum(keepdims=True) + np.array([len(w)], np.uint64) * np.uint64(0xA0761D6478BD642F))[0]
    return out, out_first
