"""Edit-aware token counts: segment trees over each document's pre-tokens; edits re-encode only the regions that they touch."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmeter.llm import tokens
from voxmeter.llm.bpe import Words
from voxmeter.llm.common import slices

EDITS = "array<struct<start:int,end:int,text:string>>"
#: Characters past an edit that are split again at first; doubled until the old boundaries are met.
AHEAD = 64
#: Leaves of a chunk; built trees leave a quarter of them free, for leaves to come, and so do chunks that are dealt anew.
CHUNK, FULL = 32, 24


def update(tree: np.ndarray, first: int, values: np.ndarray) -> None:
    """Set leaves from `first` on and renew the sums above them, level by level. Node k has children 2k and 2k + 1."""
    low = first + len(tree) // 2
    high = low + len(values)
    tree[low:high] = values
    while low > 1:
        low, high = low // 2, (high + 1) // 2
        tree[low:high] = tree[2 * low : 2 * high : 2] + tree[2 * low + 1 : 2 * high : 2]


def find(tree: np.ndarray, place: int) -> tuple[int, int]:
    """The leaf that holds the given unit of the sum, and the sum before it, in logarithmic time."""
    half, node, before = len(tree) // 2, 1, 0
    while node < half:
        left = int(tree[2 * node])
        node *= 2
        if place >= before + left:
            before += left
            node += 1
    return node - half, before


def prefix(tree: np.ndarray, leaf: int) -> int:
    """The sum of the leaves before `leaf`, in logarithmic time."""
    node, total = leaf + len(tree) // 2, 0
    if leaf >= len(tree) // 2:
        return int(tree[1])
    while node > 1:
        if node % 2:
            total += int(tree[node - 1])
        node //= 2
    return total


def size_of(word: str) -> int:
    """Characters of a pre-token (a special token's carries a mark before it)."""
    return len(word) - (word[:1] == "\0" and len(word) > 1)


def spread(values: np.ndarray, chunks: int) -> np.ndarray:
    """The values dealt evenly to chunks, in order, each chunk filled from its left, with zeros behind."""
    out = np.zeros((chunks, CHUNK), np.int64)
    n = len(values)
    chunk = np.arange(n) * chunks // max(n, 1)
    first = -(-np.arange(chunks) * n // chunks)
    out[chunk, np.arange(n) - first[chunk]] = values
    return out.reshape(-1)


class Document:
    """Two segment trees over one row of leaves: characters and tokens of each pre-token. A leaf of no characters is free."""

    __slots__ = ("chars", "tokens", "touched")

    def __init__(self, chars: np.ndarray, counts: np.ndarray):
        self.chars, self.tokens = chars, counts
        #: Leaves whose tokens may still be a number of a new pre-token, as -1 - number.
        self.touched: list[tuple[int, int]] = []

    @staticmethod
    def of(chars: np.ndarray, counts: np.ndarray) -> Document:
        chunks = 1 << max(0, -(-len(chars) // FULL) - 1).bit_length()
        trees = []
        for values in (chars, counts):
            tree = np.zeros(2 * chunks * CHUNK, np.int64)
            update(tree, 0, spread(values, chunks))
            trees.append(tree)
        return Document(*trees)

    @property
    def n(self) -> int:
        """Leaves, free ones included."""
        return len(self.chars) // 2

    def leaves(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        chars = self.chars[self.n + lo : self.n + hi]
        held = chars > 0
        return chars[held], self.tokens[self.n + lo : self.n + hi][held]

    def replace(self, first: int, last: int, chars: np.ndarray, counts: np.ndarray) -> None:
        """Put leaves in place of those from first to last (excluded); their chunks, or so many around them that all have room, are dealt anew."""
        width, new = CHUNK, ()
        while True:
            lo = first // width * width
            hi = min(self.n, -(-max(last, first + 1) // width) * width)
            before, behind = self.leaves(lo, first), self.leaves(last, hi)
            new = [np.concatenate([x, y, z]) for x, y, z in zip(before, (chars, counts), behind, strict=True)]
            room = hi - lo
            if len(new[0]) <= (room if room == CHUNK else room * FULL // CHUNK):
                break
            if not lo and hi == self.n:
                grown = Document.of(*new)
                self.chars, self.tokens, self.touched = grown.chars, grown.tokens, [(0, grown.n)]
                return
            width *= 2
        update(self.chars, lo, spread(new[0], room // CHUNK))
        self.tokens[self.n + lo : self.n + hi] = spread(new[1], room // CHUNK)
        self.touched.append((lo, hi))

    def settle(self, counts: np.ndarray) -> None:
        """Give new pre-tokens their token counts, and renew the sums above touched leaves."""
        for lo, hi in self.touched:
            values = self.tokens[self.n + lo : self.n + hi].copy()
            values[values < 0] = counts[-1 - values[values < 0]]
            update(self.tokens, lo, values)
        self.touched.clear()


class Counter:
    def __init__(self, path: str):
        self.words = Words(path)
        #: So far before an edit a pre-token can depend on it: the longest special token, and the pattern's looking ahead.
        self.reach = max([3, *(len(x) + 1 for x in self.words.names)])

    def build(self, texts: list[str]) -> list[Document]:
        numbers = self.words.numbers([self.words.pretokens(t) for t in texts])
        return [Document.of(self.words.chars[x], self.words.n[x]) for x in numbers]

    def region(self, new: str, document: Document, a: int, b: int, size: int) -> tuple[int, int, list[str]]:
        """Leaves (first, last) that the edit of old characters a to b touches, and the pre-tokens in their place.

        new is the text after the edit, in which `size` characters stand for those from a to b.
        """
        total = int(document.chars[1])
        if not total:
            return 0, document.n, self.words.pretokens(new)
        first, begin = find(document.chars, min(max(a - self.reach, 0), total - 1))
        window = AHEAD
        while True:
            stop = min(len(new), a + size + self.reach + window)
            sure = stop if stop == len(new) else stop - self.reach - 2
            found, place = [], begin
            for word in self.words.pretokens(new[begin:stop]):
                old = place - size + b - a
                if place >= a + size and old < total:
                    leaf, start = find(document.chars, old)
                    if leaf > first and start == old:
                        # From here on the text is split as before.
                        return first, leaf, found
                if place + size_of(word) > sure:
                    break
                found.append(word)
                place += size_of(word)
            else:
                if stop == len(new):
                    return first, document.n, found
            window *= 2

    def edit(self, rows: list[tuple[str, Document, list[tuple[int, int, str]]]]) -> list[tuple[str, int]]:
        """Of each (text, document, edits) the new text, and how many pre-tokens were encoded for it; the documents change.

        Edits are in order and do not overlap; they are made from the last to the first. The new words of all rows are
        encoded together, and then get their places in the trees.
        """
        held, out = [], []
        for text, document, edits in rows:
            encoded = 0
            for a, b, word in reversed(edits):
                text = text[:a] + word + text[b:]
                first, last, found = self.region(text, document, a, b, len(word))
                document.replace(first, last, np.array([size_of(w) for w in found], np.int64), -1 - np.arange(len(held), len(held) + len(found)))
                held += found
                encoded += len(found)
            out.append((text, encoded))
        (numbers,) = self.words.numbers([held])
        for _, document, _ in rows:
            document.settle(self.words.n[numbers])
        return out


def _binary(tree: np.ndarray) -> bytes:
    return tree.astype("<i4").tobytes()


def _build(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    counter = Counter(path)
    for whole in batches:
        for batch in slices(whole, "text"):
            built = counter.build([t or "" for t in batch.column(1).to_pylist()])
            trees = [pa.array([_binary(x) for x in trees], pa.binary()) for trees in ([d.chars for d in built], [d.tokens for d in built])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *trees, pa.array([int(d.tokens[1]) for d in built], pa.int64())], names=[*batch.schema.names, "chars", "tree", "n_tokens"])


def clean(edits: list[dict] | None, n: int) -> list[tuple[int, int, str]]:
    """Edits in order, within the n characters of the text, none before the end of the one before."""
    out, at = [], 0
    for e in sorted((e for e in edits or () if e and e["start"] is not None), key=lambda e: (e["start"], e["end"] if e["end"] is not None else e["start"])):
        a = min(max(e["start"], at), n)
        b = min(max(e["end"] if e["end"] is not None else a, a), n)
        out.append((a, b, e["text"] or ""))
        at = b
    return out


def _edit(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    counter = Counter(path)
    for whole in batches:
        for batch in slices(whole, "text"):
            rows = []
            for text, chars, counts, edits in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
                document = Document(*(np.frombuffer(x, "<i4").astype(np.int64) for x in (chars, counts)))
                rows.append((text or "", document, clean(edits, len(text or ""))))
            before = [int(d.tokens[1]) for _, d, _ in rows]
            texts, encoded = zip(*counter.edit(rows), strict=True)
            trees = [pa.array([_binary(x) for x in trees], pa.binary()) for trees in ([d.chars for _, d, _ in rows], [d.tokens for _, d, _ in rows])]
            after = [int(d.tokens[1]) for _, d, _ in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), *trees, *(pa.array(x, pa.int64()) for x in (before, after, encoded))], names=["doc_id", "text", "chars", "tree", "n_tokens_before", "n_tokens", "n_encoded"])


def build_trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, path: str | None = None) -> DataFrame:
    """doc_id, text, the columns of keep, chars and tree, n_tokens: segment trees of each text's pre-tokens.

    chars and tree are binary, 32-bit little-endian numbers: characters and tokens of the pre-tokens, sums above them. Save
    them as a table, and give it with edits to apply_edits. Null text: empty, with no pre-token and 0 tokens. Rows stay row
    by row, whatever their ids; columns not in keep are ignored, and one of keep that has a name of these columns raises; an
    empty table gives no rows.
    """
    keep = keep or []
    if clash := {c.lower() for c in keep} & {"doc_id", "text", "chars", "tree", "n_tokens"}:
        raise ValueError(f"names of the trees' own columns: {sorted(clash)}")
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *(F.col(f"`{c}`") for c in keep))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
    return source.mapInArrow(functools.partial(_build, path=path or tokens.default_path()), f"{ddl}, chars binary, tree binary, n_tokens long")


def apply_edits(trees: DataFrame, edits_col: str = "edits", path: str | None = None) -> DataFrame:
    """The trees after each row's edits: doc_id, text, chars, tree, n_tokens_before, n_tokens, n_encoded (pre-tokens encoded anew).

    edits: array<struct<start, end, text>>, in characters of the old text. They are taken in the order of their starts;
    one that overlaps the one before begins at its end; bounds beyond the text are moved to it; null arrays, edits and starts
    change nothing, a null end inserts, a null text deletes. Only the pre-tokens near an edit are split and encoded again,
    up to the first old boundary behind it. Each of them becomes a leaf of its own, in free places of the tree (if there are
    none left near it, leaves around are dealt anew, without encoding), and sums above are renewed. So any number of edits,
    one after another, costs as little as the first. The counts are those of encoding the new text as a whole.
    """
    source = trees.select("doc_id", "text", "chars", "tree", F.col(edits_col).cast(EDITS).alias("edits"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(functools.partial(_edit, path=path or tokens.default_path()), f"doc_id {kind}, text string, chars binary, tree binary, n_tokens_before long, n_tokens long, n_encoded long")
