"""Substring dedup by collinear chaining: shared k-mer seeds are chained with gap costs, and chains aligned to fuzzy passages."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxmeter.llm.common import join_small, materialize, mix64, seeded, shingles_of, slices, text_buffers, words_of

#: Words of a seed. Every k-mer is one: 50 words of which any 10 differ still share 7 (50 - K + 1 - 10 * K).
K = 4
#: Places of the words of a spaced seed, of which one in five is kept: where short seeds are common, these are rare, so a passage meets
#: its partner and not only the first and the last document that has its short seeds. They begin with a k-mer, and match as one.
SPACED, KEPT = (0, 1, 2, 3, 5, 8, 11, 13), 5
#: Words that a passage has at least, and share of them that is equal in both texts.
LEAST_WORDS, SIMILAR = 50, 0.8
#: Words that a chain covers at least (7 neighbouring seeds do); cost of a word between anchors; words between anchors that are still aligned.
LEAST_CHAIN, GAP, WIDEST = 10, 0.2, 60
#: Words between two spans of a document that are one passage.
BRIDGE = 3
#: Ungapped extension ends when its score falls so far.
DROP = 4
#: Bytes of text whose seeds make a bucket, seeds that are packed by bucket at once, and seeds of a batch that is sent.
BUCKET, PACKED, SENT = 6 << 20, 3 << 19, 1 << 17
#: A seed with so many occurrences, or with this share of all, is linked by ranges of documents and not in its bucket; at most
#: 1 / FREQUENT_SHARE seeds are. Occurrences of one among PACKED that make it count, and rows of frequent seeds in a range.
FREQUENT, FREQUENT_SHARE, TOLD, RANGE = 1 << 20, 2e-6, 16, 1 << 20


def seeds_of(batch_text: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, word position and hash of every k-mer of each row, and of one in KEPT of its spaced seeds, by their hashes."""
    words, _, _, first = words_of(*batch_text)
    held, begin = shingles_of(words, first, K)
    n = np.diff(begin)
    row = np.repeat(np.arange(len(n)), n)
    at = np.flatnonzero((np.diff(first) >= K)[row])
    row, pos, held = row[at], at - begin[:-1][row[at]], held[at]
    total = np.zeros(max(len(words) - SPACED[-1], 0), np.uint64)
    for place, factor in zip(SPACED, seeded(len(SPACED), 41) | np.uint64(1), strict=True):
        total += words[place : place + len(total)] * factor
    total = mix64(total)
    kept = np.flatnonzero(total % np.uint64(KEPT) == 0)
    of = np.searchsorted(first, kept, "right") - 1
    inside = kept + SPACED[-1] < first[of + 1]
    kept, of = kept[inside], of[inside]
    return np.append(row, of), np.append(pos, kept - first[of]), np.append(held, total[kept])


def _planes(x: np.ndarray) -> bytes:
    """The bytes of numbers, all first ones before all second ones: those that are equal compress."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _unplanes(data: bytes, kind: type, width: int) -> np.ndarray:
    n = len(data) // width
    out = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, n).T
    return out.reshape(-1).view(kind)


def among(h: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which hashes are in an ordered list."""
    if not len(ordered):
        return np.zeros(len(h), bool)
    at = np.searchsorted(ordered, h)
    return ordered[np.minimum(at, len(ordered) - 1)] == h


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of the seeds that TOLD of PACKED are, and under a null seed those of all."""
    held: list[np.ndarray] = []

    def told() -> pa.RecordBatch:
        h = np.concatenate(held)
        held.clear()
        h.sort()
        begin = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
        n, total = np.diff(np.append(begin, len(h))), len(h)
        h, n = h[begin[n >= TOLD]], n[n >= TOLD]
        return pa.RecordBatch.from_arrays([pa.array([*h.view(np.int64).tolist(), None], pa.int64()), pa.array([*n.tolist(), total], pa.int64())], names=["h", "n"])

    for whole in batches:
        for batch in slices(whole, "text"):
            held.append(seeds_of(text_buffers(batch.column(0)))[2])
            if sum(len(x) for x in held) >= PACKED:
                yield told()
    if held:
        yield told()


def frequent(texts: DataFrame) -> np.ndarray:
    """Hashes of the seeds that are linked by ranges of documents, in order: 1 / FREQUENT_SHARE of them at most.

    Counts are summed over all texts; what a seed misses of its own are fewer than TOLD occurrences in PACKED.
    """
    counts = texts.select("text").mapInArrow(_counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    held = materialize(counts.where(f"h is null or n >= {FREQUENT}"), "frequent")
    total = held.where("h is null").agg(F.sum("n")).first()[0] or 0
    rows = held.where(f"h is not null and n >= {max(FREQUENT, total * FREQUENT_SHARE)}").select("h").collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))


def _occurrences(batches: Iterator[pa.RecordBatch], ordered: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Occurrences of the given seeds: seed, doc and the positions in it."""
    for whole in batches:
        for batch in slices(whole, "text"):
            row, pos, h = seeds_of(text_buffers(batch.column(1)))
            at = np.flatnonzero(among(h, ordered))
            at = at[np.lexsort((pos[at], h[at], row[at]))]
            begin = np.flatnonzero(np.append(True, (h[at][1:] != h[at][:-1]) | (row[at][1:] != row[at][:-1]))[: len(at)])
            lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(at)).astype(np.int32)), pa.array(pos[at].astype(np.int32)))
            one = at[begin]
            yield pa.RecordBatch.from_arrays([pa.array(h[one].view(np.int64)), pa.array(batch.column(0).to_numpy()[row[one]]), lists], names=["h", "doc", "pos"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Positions of a document's occurrences of a seed and of another document's, as links."""
    for batch in batches:
        pos, other = batch.column(2), batch.column(3)
        offsets = [c.offsets.to_numpy() for c in (pos, other)]
        n, m = (np.diff(x) for x in offsets)
        at, rank, front, back = facing(n, m)
        mine, theirs = (c.values.to_numpy().astype(np.int64) for c in (pos, other))
        x = mine[offsets[0][:-1][at] + rank] << 32
        front, back = x | theirs[offsets[1][:-1][at] + front], x | theirs[offsets[1][:-1][at] + back]
        # Two links of each occurrence, equal ones among them: those of a pair of documents are made distinct before chaining.
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(2 * n)).astype(np.int32)), pa.array(np.stack([front, back], 1).reshape(-1)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["doc", "owner", "m"])


def by_ranges(texts: DataFrame, ordered: np.ndarray) -> DataFrame:
    """The links of the given seeds, as `links` gives them, with the documents of a seed in ranges that are tasks of their own.

    A range hands on each seed's first and last document; a seed's first document is that of its first range, and the
    document before a range's first one is the last of the range before.
    """
    seen = texts.select("doc", "text").mapInArrow(functools.partial(_occurrences, ordered=ordered), "h long, doc long, pos array<int>")
    each = materialize(seen.groupBy("h", "doc").agg(F.array_sort(F.flatten(F.collect_list("pos"))).alias("pos")), "occurrences")
    ranges = each.count() // RANGE + 1
    spread = materialize(each.repartitionByRange(ranges, "doc").withColumn("part", F.spark_partition_id()), "ranges")
    it = F.struct("doc", "pos")
    edges = spread.groupBy("h", "part").agg(F.min_by(it, "doc").alias("head"), F.max_by(it, "doc").alias("last"))
    along = Window.partitionBy("h").orderBy("part")
    edges = materialize(edges.select("h", "part", F.first("head").over(along).alias("head"), F.lag("last").over(along).alias("before")), "edges")
    inside = Window.partitionBy("h", "part").orderBy("doc")
    rows = join_small(spread.withColumn("near", F.lag(it).over(inside)), edges, ["h", "part"], "inner")
    rows = rows.withColumn("near", F.coalesce("near", "before")).where("near is not null")
    to = F.explode(F.when(F.col("near.doc") == F.col("head.doc"), F.array("head")).otherwise(F.array("head", "near"))).alias("to")
    met = rows.select("doc", "pos", to).select("doc", F.col("to.doc").alias("owner"), "pos", F.col("to.pos").alias("other"))
    return met.mapInArrow(_meet, "doc long, owner long, m array<long>")


def _seeds(batches: Iterator[pa.RecordBatch], buckets: int, without: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Seeds by bucket, packed: a bucket is a range of hashes, told by the upper 16 bits; the lower 48 stay in a seed."""
    held: tuple[list[np.ndarray], ...] = ([], [], [])

    def packed() -> Iterator[pa.RecordBatch]:
        # Column by column, and sent in parts: several copies of all the seeds at once would be most of a task's memory.
        columns = []
        for parts in held:
            columns.append(np.concatenate(parts))
            parts.clear()
        h, doc, pos = columns
        at = ((h >> np.uint64(48)) * np.uint64(buckets) >> np.uint64(16)).astype(np.uint16)
        order = np.argsort(at, kind="stable").astype(np.uint32)
        to = np.append(0, np.cumsum(np.bincount(at, minlength=buckets)))
        some = np.flatnonzero(np.diff(to))
        for part in np.split(some, np.flatnonzero(np.diff(to[some] // SENT)) + 1):
            picked = order[to[part[0]] : to[part[-1] + 1]]
            low, d, w = h[picked].view(np.uint8).reshape(-1, 8)[:, :6], doc[picked], pos[picked]
            cut = [slice(to[i] - to[part[0]], to[i + 1] - to[part[0]]) for i in part]
            binary = [[low[c].T.tobytes() for c in cut], [_planes(d[c]) for c in cut], [_planes(w[c]) for c in cut]]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *(pa.array(x, pa.binary()) for x in binary)], names=["bucket", "h", "doc", "pos"])

    for whole in batches:
        for batch in slices(whole, "text"):
            row, pos, h = seeds_of(text_buffers(batch.column(1)))
            if len(without):
                row, pos, h = (x[~among(h, without)] for x in (row, pos, h))
            for parts, x in zip(held, (h, batch.column(0).to_numpy()[row], pos.astype(np.uint32)), strict=True):
                parts.append(x)
            if sum(len(x) for x in held[0]) >= PACKED:
                yield from packed()
    if sum(len(x) for x in held[0]):
        yield from packed()


def facing(n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of runs of n occurrences that meet runs of m: run and rank of each occurrence, and the ranks it meets from the front and from the back."""
    at = np.repeat(np.arange(len(n)), n)
    rank = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    return at, rank, np.minimum(rank, m[at] - 1), m[at] - np.minimum(n[at] - rank, m[at])


def links(h: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences of a seed with those in the first document that has it, and in the document before: doc, owner, x, y.

    The n-th occurrence of a document meets the n-th of the other one, counted from the front and from the back (or the
    last there is): a text that repeats a phrase meets its copy along its whole length, in as many links as it has words.
    """
    # Seeds that come once meet nobody: one quick sort leaves them out of the slow one.
    order = np.argsort(h)
    again = h[order][1:] == h[order][:-1]
    order = order[np.append(again, False) | np.append(False, again)] if len(h) else order
    order = order[np.lexsort((pos[order], doc[order], h[order]))]
    h, doc, pos = h[order], doc[order], pos[order]
    new = np.append(True, h[1:] != h[:-1])[: len(h)]
    fresh = new | np.append(True, doc[1:] != doc[:-1])[: len(h)]
    # Runs of one seed in one document: begin, end, and the seed's first run.
    begin = np.flatnonzero(fresh)
    end = np.append(begin[1:], len(h))
    head = np.flatnonzero(new[begin])[np.cumsum(new[begin]) - 1] if len(begin) else begin
    later = np.flatnonzero(head != np.arange(len(begin)))
    far = later[later - 1 != head[later]]
    run, to = np.append(later, far), np.append(head[later], far - 1)
    at, rank, front, back = facing(end[run] - begin[run], end[to] - begin[to])
    x, front, back = begin[run][at] + rank, begin[to][at] + front, begin[to][at] + back
    more = np.flatnonzero(front != back)
    x, y = np.append(x, x[more]), np.append(front, back[more])
    return doc[x], doc[y], pos[x], pos[y]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a partition's buckets, which come in order, one bucket at a time."""
    held: list[tuple[bytes, bytes, bytes]] = []
    last = None

    def met() -> Iterator[pa.RecordBatch]:
        h, doc, pos = (np.concatenate([_unplanes(x[k], kind, width) for x in held]) for k, kind, width in ((0, np.uint64, 6), (1, np.int64, 8), (2, np.uint32, 4)))
        held.clear()
        d, o, x, y = links(h, doc, pos.astype(np.int64))
        # Those of a pair of documents lie together, so that they are one list before the shuffle.
        order = np.lexsort((x, o, d))
        d, o, m = d[order], o[order], (x << 32 | y)[order]
        begin = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (o[1:] != o[:-1]))[: len(d)])
        lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(d)).astype(np.int32)), pa.array(m))
        out = pa.RecordBatch.from_arrays([pa.array(d[begin]), pa.array(o[begin]), lists], names=["doc", "owner", "m"])
        for at in range(0, out.num_rows, 10_000):
            yield out.slice(at, 10_000)

    for batch in batches:
        for bucket, *packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != last and held:
                yield from met()
            last = bucket
            held.append(tuple(packed))
    if held:
        yield from met()


class Fenwick:
    """Prefix maxima of (score, item) over ranks."""

    def __init__(self, n: int):
        self.best: list[tuple[float, int]] = [(0.0, -1)] * (n + 1)

    def put(self, rank: int, score: float, item: int) -> None:
        rank += 1
        while rank < len(self.best):
            if score > self.best[rank][0] or self.best[rank][1] < 0:
                self.best[rank] = (score, item)
            rank += rank & -rank

    def top(self, rank: int) -> tuple[float, int]:
        """The best of the ranks before `rank`."""
        out = (float("-inf"), -1)
        while rank > 0:
            if self.best[rank][1] >= 0 and self.best[rank][0] > out[0]:
                out = self.best[rank]
            rank -= rank & -rank
        return out


def anchors(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int]]:
    """Matches (x, y) of seeds, with those that follow one another on a diagonal made one anchor (x, y, words)."""
    order = np.lexsort((x, x - y))
    x, y = x[order], y[order]
    new = np.append(True, (np.diff(x - y) != 0) | (np.diff(x) > K))
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(x)) - 1
    return sorted(zip(x[begin].tolist(), y[begin].tolist(), (x[end] - x[begin] + K).tolist(), strict=True))


def chains(found: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Disjoint chains of anchors in order in both texts, best first: words covered minus GAP for each word between anchors.

    The best anchor before another is a prefix maximum over ends in y, kept by a Fenwick tree while a sweep goes along x;
    the cost of a gap is a sum of both texts' coordinates, so it splits into a part of each anchor.
    """
    out: list[list[tuple[int, int, int]]] = []
    left = found
    while left:
        ys = sorted({y + n for _, y, n in left})
        rank = {y: i for i, y in enumerate(ys)}
        ordered = np.array(ys)
        tree, score, before = Fenwick(len(ys)), [0.0] * len(left), [-1] * len(left)
        by_end = sorted(range(len(left)), key=lambda i: left[i][0] + left[i][2])
        ended = 0
        for i, (x, y, n) in enumerate(left):
            # Neighbouring anchors may share the words of a seed but one.
            while ended < len(by_end) and left[by_end[ended]][0] + left[by_end[ended]][2] <= x + K - 1:
                j = by_end[ended]
                if j < i:
                    tree.put(rank[left[j][1] + left[j][2]], score[j] + GAP * (left[j][0] + left[j][1] + 2 * left[j][2]), j)
                ended += 1
            best, j = tree.top(int(np.searchsorted(ordered, y + K - 1, "right")))
            gain = best - GAP * (x + y)
            if j >= 0 and left[j][0] + left[j][2] > x or j >= 0 and left[j][1] + left[j][2] > y:
                gain -= max(left[j][0] + left[j][2] - x, left[j][1] + left[j][2] - y) * (1 + GAP)
            score[i], before[i] = (n + gain, j) if j >= 0 and gain > 0 else (float(n), -1)
        end = max(range(len(left)), key=score.__getitem__)
        if score[end] < LEAST_CHAIN:
            break
        chain, i = set(), end
        while i >= 0:
            chain.add(i)
            i = before[i]
        picked = [left[i] for i in sorted(chain)]
        out.append(picked)
        top, low = picked[-1][0] + picked[-1][2], picked[0][0]
        # Anchors inside the chain's stretch of the text say nothing new.
        left = [a for i, a in enumerate(left) if i not in chain and (a[0] + a[2] <= low or a[0] >= top)]
    return out


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32()), ("n", pa.int32())]))
    for batch in batches:
        doc, owner, held = [], [], []
        rows = batch.column(2)
        offsets, items = rows.offsets.to_numpy(), rows.values
        parts, flat = items.offsets.to_numpy(), items.values.to_numpy()
        for i, (d, o) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            m = np.unique(flat[parts[offsets[i]] : parts[offsets[i + 1]]])
            found = anchors(m >> 32, m & 0xFFFFFFFF)
            if sum(n for _, _, n in found) < LEAST_CHAIN:
                continue
            for chain in chains(found):
                doc.append(d)
                owner.append(o)
                held.append([{"x": p, "y": q, "n": n} for p, q, n in chain])
        yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(owner, pa.int64()), pa.array(held, kind)], names=["doc", "owner", "chain"])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            words, _, _, first = words_of(*text_buffers(batch.column(1)))
            short = (words >> np.uint64(32)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([short[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], pa.binary())], names=["doc", "words"])


def common(x: list[int], y: list[int]) -> int:
    """Length of the longest common subsequence of two short word lists."""
    row = [0] * (len(y) + 1)
    for a in x:
        diagonal = 0
        for j, b in enumerate(y):
            diagonal, row[j + 1] = row[j + 1], diagonal + 1 if a == b else max(row[j + 1], row[j])
    return row[-1]


def extend(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """Words and equal words of the best ungapped beginning of both."""
    n = min(len(x), len(y))
    if not n:
        return 0, 0
    same = x[:n] == y[:n]
    total = np.cumsum(np.where(same, 1, -1))
    stop = np.flatnonzero(np.maximum(np.maximum.accumulate(total), 0) - total >= DROP)
    total = total[: stop[0] if len(stop) else n]
    if not len(total) or total.max() <= 0:
        return 0, 0
    best = int(total.argmax()) + 1
    return best, int(same[:best].sum())


def grown(x: np.ndarray, y: np.ndarray, far: bool) -> np.ndarray:
    """Equal words of each length of the best ungapped beginning of both, from 0; or of all until its score has fallen by DROP."""
    n = min(len(x), len(y)) if far else extend(x, y)[0]
    same = x[:n] == y[:n]
    total = np.cumsum(np.where(same, 1, -1))
    stop = np.flatnonzero(np.maximum(np.maximum.accumulate(total), 0) - total >= DROP) if n else []
    return np.append(0, np.cumsum(same[: stop[0] if len(stop) else n]))


def longest(before: np.ndarray, behind: np.ndarray, equal: int, length: int) -> tuple[int, int]:
    """The lengths of two ends that together are the longest which leave an equal share of SIMILAR, each ending in an equal word.

    before and behind: equal words of each length of either end. What an end has above the share pays for the other one: for
    each length of the one, the longest of the other that it can pay for is found by search, so ends may be of any length.
    """
    ends = [np.flatnonzero(np.append(True, np.diff(g) > 0)) for g in (before, behind)]
    spare = [g[e] - SIMILAR * e for g, e in zip((before, behind), ends, strict=True)]
    # The most that this length of the end behind, or a longer one, has to spare: never rising.
    most = np.maximum.accumulate(spare[1][::-1])[::-1]
    need = SIMILAR * length - equal - spare[0] - 1e-9
    at = np.searchsorted(-most, -need, "right") - 1
    reach = np.where(at >= 0, ends[0] + ends[1][np.maximum(at, 0)], -1)
    best = int(reach.argmax())
    return (0, 0) if reach[best] < 0 else (int(ends[0][best]), int(ends[1][at[best]]))


def align(x: np.ndarray, y: np.ndarray, chain: list[tuple[int, int, int]], least: int = LEAST_WORDS) -> list[tuple[int, int, int, int]]:
    """Passages (begin and end in x, begin and end in y) along the chain whose words are equal in a share of SIMILAR at least."""
    out = []
    # Begin and end of each piece in both texts, and the equal words between it and the piece before.
    held: list[tuple[int, int, int, int, int]] = []

    def close() -> None:
        """The longest stretch of pieces that is equal in the share, then those before and behind it."""
        told = np.array(held, np.int64).T
        held.clear()
        todo = [(0, told.shape[1])]
        total_ = np.cumsum(told[4])
        while todo:
            lo, hi = todo.pop()
            if lo >= hi:
                continue
            bx, ex, by, ey = told[:4, lo:hi]
            total, own, found = total_[lo:hi], ex - bx, (0, 0, 0)
            for i in range(hi - lo):
                if found[0] >= max(ex[-1] - bx[i], ey[-1] - by[i]):
                    break
                length = np.maximum(ex[i:] - bx[i], ey[i:] - by[i])
                fit = np.flatnonzero(total[i:] - total[i] + own[i] >= SIMILAR * length)
                if length[fit[-1]] > found[0]:
                    found = int(length[fit[-1]]), i, i + int(fit[-1])
            _, i, j = found
            p, q, r, s = int(bx[i]), int(ex[j]), int(by[i]), int(ey[j])
            low = (int(ex[i - 1]), int(ey[i - 1])) if i else (0, 0)
            top = (int(bx[j + 1]), int(by[j + 1])) if j + 1 < hi - lo else (len(x), len(y))
            before, behind = (x[low[0] : p][::-1], y[low[1] : r][::-1]), (x[q : top[0]], y[s : top[1]])
            # Of both ends together the most that leaves the share; ends that match badly only where the passage needs them.
            for far in (False, True):
                a, b = longest(grown(*before, far), grown(*behind, far), int(total[j] - total[i] + own[i]), max(q - p, s - r))
                if q - p + a + b >= least:
                    break
            out.append((p - a, q + b, r - a, s + b))
            todo += [(lo, lo + i), (lo + j + 1, hi)]

    bx, by, n = chain[0]
    ex, ey = bx + n, by + n
    held.append((bx, ex, by, ey, n))
    for cx, cy, n in chain[1:]:
        over = max(ex - cx, ey - cy, 0)
        cx, cy, n = cx + over, cy + over, n - over
        if n <= 0:
            continue
        dx, dy = cx - ex, cy - ey
        if max(dx, dy) > WIDEST:
            close()
        between = common(x[ex:cx].tolist(), y[ey:cy].tolist()) if held and dx and dy else 0
        ex, ey = cx + n, cy + n
        held.append((cx, ex, cy, ey, n + between))
    close()
    return out


def _align(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        chains_, left, right = batch.column(2), batch.column(3), batch.column(4)
        for i, (d, o) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            items = chains_[i].values
            chain = list(zip(*(items.field(k).to_pylist() for k in ("x", "y", "n")), strict=True))
            x, y = (np.frombuffer(c[i].as_buffer(), np.uint32) for c in (left, right))
            out += [(d, o, *p) for p in align(x, y, chain, least)]
        columns = list(zip(*out, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc", "owner", "start", "end", "source_start", "source_end"])


def _merge(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for d, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            spans.sort(key=lambda s: (s["start"], s["end"]))
            begin, end, owners = None, None, set()
            for s in [*spans, None]:
                if s is not None and begin is not None and s["start"] <= end + BRIDGE:
                    end = max(end, s["end"])
                    owners.add(s["owner"])
                    continue
                if begin is not None and end - begin >= least:
                    out.append((d, begin, end, min(owners), sorted(owners)))
                if s is not None:
                    begin, end, owners = s["start"], s["end"], {s["owner"]}
        columns = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.list_(pa.int64()))], names=["doc_id", "start_word", "end_word", "source_id", "source_ids"])


def _count(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            n = np.diff(words_of(*text_buffers(batch.column(1)))[3])
            at = pa.array(np.flatnonzero(n >= least))
            source = batch.column(2).take(at)
            sources = pa.array([[x] for x in source.to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(np.zeros(len(at), np.int64)), pa.array(n[n >= least]), source, sources], names=["doc_id", "start_word", "end_word", "source_id", "source_ids"])


RESULT = "doc_id long, start_word long, end_word long, source_id long, source_ids array<long>"


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """A row for each passage of `least` words or more that an earlier document (smaller id) has too, exactly or nearly.

    doc_id, start_word, end_word (words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased, from 0, end excluded), source_id (the
    smallest document it was found in), source_ids. Seeds are all k-mers of words and a fifth of longer spaced ones, which stay
    rare where k-mers are common; each occurrence is joined with the seed's first document and with the one before it, never with all, so a passage that very
    many documents share costs two rows for each. Matches of a pair of documents are chained with gap costs and aligned;
    aligned stretches of one document that touch are one passage, whatever documents hold its parts. Documents of equal
    text stand for one another: a later copy is a passage as a whole. The first document that has a passage gets no row
    for it. Null, empty and short texts and null ids have no passage; rows of one id are one document; other columns are
    ignored; an empty table gives no rows.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where("doc is not null and text is not null and text <> ''")
    digests = source.select("doc", F.md5("text").alias("digest"))
    firsts = digests.groupBy("digest").agg(F.min("doc").alias("rep"), F.max("doc").alias("most"))
    firsts = firsts.where("rep <> most").select("digest", "rep")
    copies = materialize(join_small(digests, materialize(firsts, "firsts"), "digest", "inner").where("doc <> rep").select("doc", "rep"), "copies")
    distinct = join_small(source, copies.select("doc"), "doc", "left_anti")
    size = distinct.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(max(size // BUCKET, 16), 1 << 16)
    often = frequent(distinct)
    seeds = distinct.select("doc", "text").mapInArrow(functools.partial(_seeds, buckets=buckets, without=often), "bucket int, h binary, doc binary, pos binary")
    # A partition is one bucket: hashed numbers would put up to five of them into one task's memory.
    met = seeds.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(_links, "doc long, owner long, m array<long>")
    if len(often):
        met = met.unionByName(by_ranges(distinct, often))
    # A chain of LEAST_CHAIN words has three seeds at least.
    pairs = met.groupBy("doc", "owner").agg(F.collect_list("m").alias("matches")).where("aggregate(matches, 0, (n, m) -> n + size(m)) > 2")
    found = materialize(pairs.mapInArrow(_chains, "doc long, owner long, chain array<struct<x:int,y:int,n:int>>"), "chains")
    wanted = materialize(found.select("doc").unionByName(found.select(F.col("owner").alias("doc"))).distinct(), "wanted")
    words = materialize(join_small(source, wanted, "doc", "left_semi").select("doc", "text").mapInArrow(_words, "doc long, words binary"), "words")
    both = found.join(words, "doc").join(words.select(F.col("doc").alias("owner"), F.col("words").alias("other")), "owner")
    aligned = both.select("doc", "owner", "chain", "words", "other").mapInArrow(functools.partial(_align, least=least), "doc long, owner long, start long, end long, source_start long, source_end long")
    spans = aligned.groupBy("doc").agg(F.collect_list(F.struct("start", "end", "owner")).alias("spans"))
    merged = spans.mapInArrow(functools.partial(_merge, least=least), RESULT)
    whole = join_small(source, copies, "doc", "inner")
    return merged.unionByName(whole.select("doc", "text", "rep").mapInArrow(functools.partial(_count, least=least), RESULT))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            texts = batch.column(1).to_pylist()
            for i, spans in enumerate(batch.column(2).to_pylist()):
                if not spans or not texts[i]:
                    continue
                data = texts[i].encode()
                _, begin, end, _ = words_of(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
                parts, at = [], 0
                for s in sorted(spans, key=lambda s: s["start_word"]):
                    a, b = s["start_word"], min(s["end_word"], len(begin))
                    if a < b:
                        parts.append(data[at : max(at, int(begin[a]))])
                        at = max(at, int(end[b - 1]))
                texts[i] = b"".join([*parts, data[at:]]).decode(errors="replace")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])


def remove(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the passages of `found` cut from their texts; the first document that has a passage keeps it. All columns stay.

    Columns keep their names, whatever these are. Rows without a passage, null ids and null texts stay as they are; a document that consists of passages keeps its row
    with what is left, white space or an empty text.
    """
    spans = materialize(found.groupBy("doc_id").agg(F.collect_list(F.struct("start_word", "end_word")).alias("spans")), "spans")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    marked = join_small(docs.select(row.alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), spans, "doc_id", "left")
    plain = marked.where("spans is null").select("row.*")
    texts = marked.where("spans is not null").select(F.struct("doc_id", "row").alias("key"), "text", "spans")
    done = texts.mapInArrow(_cut_rows, f"row struct<{', '.join(f'`{f.name}`:{f.dataType.simpleString()}' for f in docs.schema)}>, cut string")
    out = done.select(*[F.col("cut").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
    return plain.unionByName(out)


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held = batch.column(0).field("row")
        part = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(1), batch.column(2)], names=["doc_id", "text", "spans"])
        texts = [t for x in _cut(iter([part])) for t in x.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([held, pa.array(texts, pa.string())], names=["row", "cut"])
