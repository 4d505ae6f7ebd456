"""Document fingerprints: threshold-scaled sketches of word shingles, and their containment estimates."""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmeter.llm.common import mix64, shingles_of, slices, text_buffers, words_of

#: Words of a shingle, and the share of shingle hashes that a sketch keeps.
K, SHARE = 5, 1 / 8
#: Bytes of text in a range of documents, and ranges at most.
RANGE_BYTES, MOST_RANGES = 48 << 20, 1 << 15


def sketches(texts: pa.Array, share: float = SHARE, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's sketch, in one array, and where each text's begin."""
    words, _, _, first = words_of(*text_buffers(texts))
    hashes, edges = shingles_of(words, first, k)
    row = np.repeat(np.arange(len(texts)), np.diff(edges))
    # The shingle's own hash is mixed once more, so that its size says nothing about the shingle.
    hashes = mix64(hashes ^ np.uint64(0x5851F42D4C957F2D))
    least = np.full(len(texts), np.uint64(0xFFFFFFFFFFFFFFFF))
    some = np.flatnonzero(np.diff(edges))
    if len(some):
        least[some] = np.minimum.reduceat(hashes, edges[some])
    keep = (hashes < np.uint64(int(share * 2**64) - 1)) | (hashes == least[row])
    row, hashes = row[keep], hashes[keep]
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1]))) if len(row) else np.zeros(0, bool)
    row, hashes = row[new], hashes[new]
    return hashes, np.searchsorted(row, np.arange(len(texts) + 1))


def merge(a: np.ndarray, b: np.ndarray, share: float = SHARE) -> np.ndarray:
    """The sketch of two texts' shingles together, from their sketches alone."""
    both = np.union1d(a, b)
    return both[(both < np.uint64(int(share * 2**64) - 1)) | (np.arange(len(both)) == 0)]


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the smaller sketch that is in the other one, an estimate of the same share of shingles; two empty ones are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def text_of(sketch: np.ndarray) -> str:
    """Hashes in hexadecimal, ascending, 16 digits each."""
    return sketch.astype(">u8").tobytes().hex()


def sketch_of(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u8").astype(np.uint64)


def _sketch(batches: Iterator[pa.RecordBatch], share: float, k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            hashes, edges = sketches(part.column(1), share, k)
            told = [text_of(hashes[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(told, pa.string())], names=["doc_id", "fingerprint"])


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE, k: int = K) -> DataFrame:
    """doc_id, fingerprint of each row: no shuffle.

    A fingerprint holds every hash of a text's distinct k-word shingles that is below a fixed share of all 64-bit hashes, and
    the smallest one in any case, so only texts without words have none. A text of fewer words than k is one shingle. So
    fingerprints of any two texts can be compared, however unequal their lengths, and merge() gives that of both together.
    Words are `[^\\x20\\x09-\\x0D]+`, A-Z in lower case. Null texts are empty; empty texts have an empty fingerprint. Repeated
    rows and null ids stay as they are; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(functools.partial(_sketch, share=share, k=k), f"doc_id {docs.schema[id_col].dataType.simpleString()}, fingerprint string")


def _edited(batches: Iterator[pa.RecordBatch], share: float) -> Iterator[pa.RecordBatch]:
    """Documents of ranges, each followed by a guest, the first document of the next range: their edited texts and likenesses."""
    last: tuple | None = None

    def steps() -> Iterator[list[tuple]]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, edges = sketches(part.column(3), share)
                rows = zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), [hashes[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)], strict=True)
                yield list(rows)

    for rows in steps():
        rows = [last, *rows] if last is not None else rows
        # A guest is no document of this range, and the range's last document is followed by its guest.
        pairs = [(a, b) for a, b in zip(rows[:-1], rows[1:], strict=True) if not a[1] and a[0] == b[0]]
        last = rows[-1]
        if not pairs:
            continue
        texts = [a[3][: len(a[3]) - len(a[3]) // 2] + b[3][: len(a[3]) // 2] for a, b in pairs]
        hashes, edges = sketches(pa.array(texts, pa.large_string()), share)
        edited = [hashes[x:y] for x, y in zip(edges[:-1], edges[1:], strict=True)]
        columns = [
            pa.array([a[2] for a, _ in pairs], pa.int64()), pa.array([len(a[3]) for a, _ in pairs], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
            pa.array([text_of(a[4]) for a, _ in pairs], pa.string()), pa.array([text_of(e) for e in edited], pa.string()),
            pa.array([containment(a[4], e) for (a, _), e in zip(pairs, edited, strict=True)], pa.float64()), pa.array([containment(a[4], b[4]) for a, b in pairs], pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many of the next row's;
    rows are in descending doc_id (null last; equal ids by their texts' hashes), and the first follows the last. Likeness is
    containment(). Documents lie in ranges of doc_id, of about RANGE_BYTES of text, from quantiles; a range's first document
    goes to the range before it too, so texts are shuffled once. Equal rows count as many times as they come. See
    fingerprint() for nulls, empty texts and other columns; an empty table gives no rows, and a single row follows itself.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") + 32)).first()[0] or 0
    n = min(MOST_RANGES, max(math.ceil(total / RANGE_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000 + 4 * n)).first()[0] if n > 1 else None
    bounds = np.unique(np.array(cuts or [], np.int64))
    none = len(bounds) + 1  # the range of null ids

    @F.pandas_udf("int")
    def range_of(ids: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series(np.where(known, len(bounds) - np.searchsorted(bounds, ids, "right"), none))

    known, whole_id = F.col("doc_id").isNotNull(), F.coalesce("doc_id", F.lit(0))
    # As many rows as ranges: the first id of each that has any.
    tops = sorted((r["part"], r["top"]) for r in rows.select("doc_id", range_of(whole_id, known).alias("part")).groupBy("part").agg(F.max("doc_id").alias("top")).collect())
    first, before = np.full(none + 1, 0, np.int64), np.full(none + 1, -1)
    for i, (part, top) in enumerate(tops):
        first[part], before[part] = top or 0, tops[i - 1][0]

    @F.pandas_udf("int")
    def guest_of(ids: pd.Series, known: pd.Series) -> pd.Series:
        part = np.where(known, len(bounds) - np.searchsorted(bounds, ids, "right"), none)
        return pd.Series(np.where(first[part] == ids, before[part], -1))

    stays = rows.select("doc_id", "text", F.array(F.struct(range_of(whole_id, known).alias("part"), F.lit(False).alias("guest")), F.struct(guest_of(whole_id, known).alias("part"), F.lit(True).alias("guest"))).alias("at"))
    dealt = stays.select(F.explode("at").alias("at"), "doc_id", "text").where("at.part >= 0").select("at.part", "at.guest", "doc_id", "text")
    ranged = dealt.repartitionById(none + 1, F.col("part")).sortWithinPartitions("part", "guest", F.desc_nulls_last("doc_id"), F.xxhash64("text"))
    return ranged.mapInArrow(functools.partial(_edited, share=share), EDITED)
