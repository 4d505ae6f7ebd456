"""MinHash near-duplicates by a chosen-path set similarity join."""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmeter.llm.common import join_small, materialize, seeded, shingles_of, slices, text_buffers, words_of
from voxmeter.llm.connect import components, link_groups

SHINGLE, PERCENT = 5, 80
#: Depth of a tree, the size up to which a node is a leaf, and the share of threshold pairs that all trees may miss.
DEPTH, LEAF, MISSED = 4, 64, 2e-6
#: Minwise tokens kept of a document at least.
LEAST_SIGNATURE = 64


def trees(percent: int) -> int:
    """Independent trees that keep the missed share even where every node is so large that all go to the full depth."""
    whole = (percent / 100) ** DEPTH
    return 1 if whole >= 1 else math.ceil(math.log(MISSED) / math.log1p(-whole))


def width(percent: int) -> int:
    """Minwise tokens of a signature: no two levels or trees share one."""
    return max(LEAST_SIGNATURE, trees(percent) * DEPTH)


def _sets(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingle hashes, sorted, in one flat array, and where they begin."""
    words, _, _, first = words_of(*text_buffers(batch.column(1)))
    held, begin = shingles_of(words, first, k)
    order = np.lexsort((held, np.repeat(np.arange(batch.num_rows), np.diff(begin))))
    held, row = held[order], np.repeat(np.arange(batch.num_rows), np.diff(begin))
    keep = np.append(True, (held[1:] != held[:-1]) | (row[1:] != row[:-1]))[: len(held)]
    return held[keep], np.concatenate(([0], np.cumsum(np.bincount(row[keep], minlength=batch.num_rows))))


def _features(batches: Iterator[pa.RecordBatch], k: int, tokens_of: int) -> Iterator[pa.RecordBatch]:
    factors = seeded(tokens_of, 23) | np.uint64(1)
    for whole in batches:
        for batch in slices(whole, "text"):
            held, begin = _sets(batch, k)
            n = np.diff(begin)
            some = np.flatnonzero(n)
            tokens = np.zeros((batch.num_rows, tokens_of), np.uint32)
            for j, factor in enumerate(factors if len(some) else ()):
                tokens[some, j] = np.minimum.reduceat(held * factor, begin[some]) >> np.uint64(32)
            digests = [hashlib.md5(held[a:b].tobytes()).digest() for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array([x.tobytes() for x in tokens], pa.binary())], names=["doc_id", "n_shingles", "digest", "signature"])


def _paths(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """For each document and tree the hash of its path at each depth: the minwise tokens chosen so far."""
    factors, n = seeded(DEPTH, 31) | np.uint64(1), trees(percent)
    for batch in batches:
        tokens = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(batch.num_rows, -1).astype(np.uint64)
        chosen = tokens[:, : n * DEPTH].reshape(-1, n, DEPTH)
        path = np.broadcast_to(seeded(n, 37), chosen.shape[:2])
        out = []
        for depth in range(DEPTH):
            path = (path ^ (chosen[:, :, depth] * np.uint64(0x9E3779B97F4A7C15))) * factors[depth]
            path = path ^ (path >> np.uint64(29))
            out.append(path.reshape(-1).view(np.int64))
        row = pa.array(np.repeat(np.arange(batch.num_rows), n))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(row), *map(pa.array, out)], names=["id", *(f"p{d}" for d in range(DEPTH))])


def _alike(least: float, left: list[bytes], right: list[bytes] | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose signatures agree in that share of tokens at least."""
    a = np.frombuffer(b"".join(left), np.uint32).reshape(len(left), -1)
    b = a if right is None else np.frombuffer(b"".join(right), np.uint32).reshape(len(right), -1)
    same = np.zeros((len(a), len(b)), np.uint8 if a.shape[1] < 256 else np.uint16)
    for j in range(a.shape[1]):
        same += a[:, None, j] == b[None, :, j]
    i, j = np.nonzero(same >= least * a.shape[1])
    return (i[i < j], j[i < j]) if right is None else (i, j)


def _close(percent: int, left: list[bytes], right: list[bytes] | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose whole sets A, B have 100 |A and B| >= percent * |A or B|, from exact counts of common shingles."""
    sets = [np.frombuffer(x, np.uint64) for x in (left if right is None else left + right)]
    size = np.array([len(x) for x in sets], np.int64)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    owner, value = np.repeat(np.arange(len(sets)), size)[order], flat[order]
    first = np.append(True, value[1:] != value[:-1])
    column = np.cumsum(first) - 1
    often = np.bincount(column) > 1
    kept = often[column]
    number = np.cumsum(often) - 1
    owner, column, width = owner[kept], number[column[kept]], int(often.sum())
    n = len(left) if right is None else len(left)
    common = np.zeros((n, len(sets) - (0 if right is None else n)), np.float64)
    begin = 0
    for at in range(0, width, 4096):
        to = int(np.searchsorted(column, at + 4096))
        block = np.zeros((len(sets), min(4096, width - at)), np.float32)
        block[owner[begin:to], column[begin:to] - at] = 1
        common += block[:n] @ (block if right is None else block[n:]).T
        begin = to
    common = common.astype(np.int64)
    union = size[:n, None] + (size if right is None else size[n:])[None, :] - common
    i, j = np.nonzero((100 * common >= percent * union) & (union > 0))
    return (i[i < j], j[i < j]) if right is None else (i, j)


def _places(signature: bytes) -> np.ndarray:
    """A signature's minwise tokens, each with its place."""
    held = np.frombuffer(signature, np.uint32)
    return (held.astype(np.int64) << 16) | np.arange(len(held))


def _shingles(held: bytes) -> np.ndarray:
    return np.frombuffer(held, np.int64)


def _payloads(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            held, begin = _sets(batch, k)
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), pa.array([held[a:b].tobytes() for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)], pa.binary())], names=["grp", "id", "payload"])


def candidates(distinct: DataFrame, percent: int) -> DataFrame:
    """Edges between the ids of (id, payload: signature) that share a leaf in one of the trees and look alike there.

    A node of at most LEAF documents is a leaf; a larger one branches by the next chosen minwise token, down to DEPTH. Of
    documents of similarity s a tree that stops at depth d keeps a share s^d together, so n trees miss (1 - s^d)^n of
    them. Their number is that for d = DEPTH: MISSED at the threshold however large the nodes are, less in small nodes.
    Signatures agree within 4.5 standard deviations of the threshold.
    """
    s = percent / 100
    least = s - 4.5 * (s * (1 - s) / width(percent)) ** 0.5
    paths = distinct.mapInArrow(functools.partial(_paths, percent=percent), "id long, " + ", ".join(f"p{d} long" for d in range(DEPTH)))
    leaves = None
    for depth in range(DEPTH):
        at = f"p{depth}"
        counts = materialize(paths.groupBy(at).count().where("count > 1"), "counts")
        end = counts if depth == DEPTH - 1 else counts.where(f"count <= {LEAF}")
        ended = join_small(paths, end.select(at), at, "left_semi").select(F.col(at).alias("grp"), "id")
        leaves = ended if leaves is None else leaves.unionByName(ended)
        large = counts.where(f"count > {LEAF}").select(at)
        if depth == DEPTH - 1 or large.isEmpty():
            break
        paths = materialize(join_small(paths, large, at, "left_semi"), "nodes")
    # Paths are short; signatures join only the few documents that share a leaf.
    return link_groups(materialize(leaves.join(distinct, "id").select("grp", "id", "payload"), "leaves"), functools.partial(_alike, least), _places, least)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, k: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row: components of documents linked by the similarity of shingle sets.

    Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased; the set holds the distinct k-word shingles (of
    fewer words the whole sequence), by 64-bit hashes. Sets with Jaccard similarity of percent/100 at least are linked;
    candidates come from the trees, and every link is confirmed on full sets. Documents with equal sets stand for one
    another. component_id is the smallest doc_id that links reach, kept says that it is the row's own. Null and empty
    texts have no shingle and no link; rows that repeat a doc_id are one document each time, with one common id; a row
    whose doc_id is null is linked with nothing and kept. Other columns are ignored; an empty table gives no rows.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    told = materialize(source.mapInArrow(functools.partial(_features, k=k, tokens_of=width(percent)), "doc_id long, n_shingles long, digest binary, signature binary"), "features")
    some = told.where("n_shingles > 0 and doc_id is not null")
    # Of equal sets the smallest id takes part; partial minima are taken before the shuffle.
    classes = some.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("signature", True).alias("signature"), F.count(F.lit(1)).alias("n"))
    classes = materialize(classes, "classes")
    # A repeated doc_id can stand for several sets; its edges join them, as they are one id.
    found = candidates(classes.select(F.col("rep").alias("id"), F.col("signature").alias("payload")), percent)
    maybe = materialize(components(found), "maybe")
    wanted = maybe.select(F.col("id").alias("doc_id"), F.col("component").alias("grp"))
    near = join_small(source, wanted, "doc_id", "inner")
    full = near.select("doc_id", "text", "grp").mapInArrow(functools.partial(_payloads, k=k), "grp long, id long, payload binary")
    linked = components(link_groups(materialize(full, "sets"), functools.partial(_close, percent), _shingles, percent / 100))
    linked = materialize(linked.withColumnRenamed("id", "rep"), "linked")
    joined = join_small(classes.select("digest", "rep"), linked, "rep", "left")
    if classes.where("n > 1").isEmpty() and linked.isEmpty():
        named = told.withColumn("component_id", F.col("doc_id"))
    else:
        moved = joined.select("digest", F.coalesce("component", "rep").alias("component_id"))
        # Only sets with more than one document, or with a link, say anything new.
        news = materialize(moved.join(classes.where("n > 1").select("digest", F.lit(True).alias("many")), "digest", "left").join(linked.select(F.col("component").alias("component_id")).distinct().withColumn("met", F.lit(True)), "component_id", "left").where("many or met").select("digest", "component_id"), "news")
        named = join_small(told, news, "digest", "left").withColumn("component_id", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")))
    return named.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
