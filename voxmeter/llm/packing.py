"""Packing: concatenate and cut. Token totals of partitions give global offsets by two passes of prefix sums; fixed windows cut the stream."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxmeter.llm import bpe, tokens
from voxmeter.llm.common import join_small, materialize, slices

WINDOW = 2048


def encoder(path: str) -> Callable[[list[str]], list[np.ndarray]]:
    """Texts -> ids as the file's library gives them without added special tokens: by merge rounds, or by the library itself
    where the file isn't a plain byte-level vocabulary."""
    if tokens.vocabulary(path).plain:
        return bpe.Words(path).encode
    return lambda texts: [np.array(x.ids, np.int64) for x in tokens.library(path).encode_batch(texts, add_special_tokens=False)]


def _tokenize(batches: Iterator[pa.RecordBatch], path: str, end_id: int | None, wide: bool) -> Iterator[pa.RecordBatch]:
    encode, part, at = encoder(path), TaskContext.get().partitionId(), 0
    kind = np.dtype("<u4" if wide else "<u2")
    tail = [] if end_id is None else [end_id]
    for whole in batches:
        for batch in slices(whole, "text"):
            held = [np.append(x, tail).astype(kind) for x in encode([text or "" for text in batch.column(1).to_pylist()])]
            n = np.array([len(x) for x in held], np.int64)
            before = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(before), pa.array(n), pa.array([x.tobytes() for x in held], pa.binary())], names=["doc_id", "part", "before", "doc_tokens", "ids"])


def _cut(batches: Iterator[pa.RecordBatch], window: int, wide: bool, crc: bool) -> Iterator[pa.RecordBatch]:
    """A row for each piece of a document: the boundary records of the windows that it meets."""
    width = 4 if wide else 2
    for batch in batches:
        doc, base, n = (batch.column(i) for i in range(3))
        base, n = base.to_numpy(), n.to_numpy()
        pieces = np.where(n > 0, (base + n - 1) // window - base // window + 1, 0)
        row = np.repeat(np.arange(len(n)), pieces)
        seq = (base // window)[row] + np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin, end = np.maximum(base[row], seq * window), np.minimum((base + n)[row], (seq + 1) * window)
        start, length = begin - base[row], end - begin
        arrays = [doc.take(pa.array(row)), pa.array(start), pa.array(length)]
        held = [memoryview(x) for x in batch.column(3).to_pylist()]
        cut = [held[r][s * width : (s + m) * width] for r, s, m in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)]
        if crc:
            arrays.append(pa.array([zlib.crc32(np.frombuffer(x, "<u4" if wide else "<u2").astype("<u4").tobytes()) for x in cut], pa.int64()))
        else:
            arrays.append(pa.array([np.frombuffer(x, "<u4" if wide else "<u2").astype(np.int32) for x in cut], pa.list_(pa.int32())))
        yield pa.RecordBatch.from_arrays([*arrays, pa.array(n[row]), pa.array(seq), pa.array(begin - seq * window)], names=["doc_id", "start", "length", "ids_crc32" if crc else "ids", "doc_tokens", "sequence_id", "offset"])


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, window: int = WINDOW, end_id: int | None = 1, digest: bool = False) -> DataFrame:
    """Cut all documents, one after another, into sequences of `window` tokens. A row for each piece of a document.

    Columns: doc_id, start (its document's tokens before it), length, ids (or with digest their CRC-32 as little-endian
    32-bit numbers), doc_tokens, sequence_id, offset (in the sequence, gapless). Only the last sequence can be shorter.
    Pass 1 tokenizes once, and writes each document's tokens with the partition's tokens before it. The totals, a row for
    each partition, get their prefix sums; pass 2 adds them and cuts. No row is moved between partitions.
    Null text: empty, so the document is its end token alone (with end_id None it has no piece). Null or repeated ids stay
    as they are: a row is a document. An empty table gives no rows; other columns are ignored.
    """
    path = path or tokens.default_path()
    wide = max(tokens.vocabulary(path).n, (end_id or 0) + 1) > 1 << 16
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    told = materialize(source.mapInArrow(functools.partial(_tokenize, path=path, end_id=end_id, wide=wide), f"doc_id {kind}, part int, before long, doc_tokens long, ids binary"), "tokens")
    totals = told.groupBy("part").agg(F.sum("doc_tokens").alias("n"))
    # One row for each partition of the input goes through this window, whatever the rows in it.
    bases = materialize(totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base")), "bases")
    placed = join_small(told, bases, "part", "inner").select("doc_id", (F.col("base") + F.col("before")).alias("base"), "doc_tokens", "ids")
    last = "ids_crc32 long" if digest else "ids array<int>"
    return placed.mapInArrow(functools.partial(_cut, window=window, wide=wide, crc=digest), f"doc_id {kind}, start long, length long, {last}, doc_tokens long, sequence_id long, offset long")
