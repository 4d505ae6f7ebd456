"""BPE encoding and decoding by batched numpy merge rounds over many words at once."""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmeter.llm import tokens
from voxmeter.llm.common import slices

#: Encoded words that a task keeps, and characters in them; beyond either it starts anew, so memory stays bounded.
KEPT_WORDS, KEPT_CHARS = 200_000, 4 << 20
#: Bytes from which a word goes through rounds that touch only the places of their merges.
LONG = 256
NO_RANK = np.int64(1 << 62)


def every_second(joined: np.ndarray) -> np.ndarray:
    """Of items of which some are joined with the next (joined: for all but the last), every second of each run, from its first."""
    first = np.append(True, ~joined)
    begin = np.flatnonzero(first)
    return (np.arange(len(first)) - begin[np.cumsum(first) - 1]) % 2 == 0


class Merger:
    """Merge rounds: the symbols of many words lie in one flat array; each round merges every word's lowest-ranked pair."""

    def __init__(self, path: str):
        v = tokens.vocabulary(path)
        if not v.plain:
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        self.vocabulary, self.width = v, np.int64(v.n)
        merges = np.array(v.merges, np.int64).reshape(-1, 3)
        keys = merges[:, 0] * self.width + merges[:, 1]
        order = np.argsort(keys)
        self.keys, self.rank, self.product = keys[order], order.astype(np.int64), merges[order, 2]
        self.of_rank = np.argsort(order)
        self.of_byte = np.array([v.ids[bytes([b])] for b in range(256)], np.int64)
        pieces = [b""] * v.n
        for text, i in v.ids.items():
            pieces[i] = text
        for text, i in v.special.items():
            pieces[i] = text.encode()
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.bytes_n = np.array([len(x) for x in pieces], np.int64)
        self.bytes_at = np.cumsum(self.bytes_n) - self.bytes_n

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols (NO_RANK if none merges them), by binary search over the sorted keys."""
        pair = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.rank[at], NO_RANK)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all words and the number of each word's ids."""
        long = np.array([len(w) > LONG for w in words], bool)
        parts = [(self._rounds, np.flatnonzero(~long)), (self._long_rounds, np.flatnonzero(long))]
        held = [(merge([words[i] for i in some]), some) for merge, some in parts if len(some)]
        if not held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ids, of = np.concatenate([x[0] for x, _ in held]), np.concatenate([some[x[1]] for x, some in held])
        order = np.argsort(of, kind="stable")
        return ids[order], np.bincount(of, minlength=len(words))

    def _flat(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all words, a byte each, and the word that each belongs to."""
        return self.of_byte[np.frombuffer(b"".join(words), np.uint8)], np.repeat(np.arange(len(words)), [len(w) for w in words])

    def _rounds(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their words: each round merges every word's lowest-ranked pair; words that have none are done."""
        live, owner = self._flat(words)
        rank = self._beside(live, owner, np.arange(len(live)))
        done_ids, done_owner = [], []
        while len(live):
            begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            size = np.diff(np.append(begin, len(live)))
            best = np.repeat(np.minimum.reduceat(rank, begin), size)
            gone = best == NO_RANK
            if gone.any():
                done_ids.append(live[gone])
                done_owner.append(owner[gone])
            chosen = np.flatnonzero((rank == best) & ~gone)
            if len(chosen):
                # Equal symbols in a row give overlapping pairs: of each run every second one merges, from the left.
                chosen = chosen[every_second(np.diff(chosen) == 1)]
                live[chosen] = self.product[self.of_rank[rank[chosen]]]
                gone[chosen + 1] = True
            kept = ~gone
            place = np.cumsum(kept) - 1
            live, owner, rank = live[kept], owner[kept], rank[kept]
            # Only pairs beside a merge are looked up again.
            touched = place[chosen]
            touched = np.concatenate([touched, touched[touched > 0] - 1])
            rank[touched] = self._beside(live, owner, touched)
        return (np.concatenate(done_ids), np.concatenate(done_owner)) if done_ids else (live, owner)

    def _beside(self, live: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank of the pair that begins at each place; none at the end of a word."""
        follower = np.minimum(at + 1, len(live) - 1)
        inside = (owner[at] == owner[follower]) & (follower > at)
        out = np.full(len(at), NO_RANK)
        out[inside] = self.ranks(live[at[inside]], live[follower[inside]])
        return out

    def _long_rounds(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for long words, in one order of ranks for all: a round looks up only pairs beside its merges.

        Merged symbols stay as gaps between linked neighbours until half of the array is gaps.
        """
        live, owner = self._flat(words)
        live, owner = np.append(live, 0), np.append(owner, -1)  # the end is no word's
        while True:
            n = len(live) - 1
            after, before = np.arange(1, n + 2), np.arange(-1, n)
            rank = np.full(n + 1, NO_RANK)
            rank[:-1] = np.where(owner[:-1] == owner[1:], self.ranks(live[:-1], live[1:]), NO_RANK)
            dead = np.zeros(n + 1, bool)
            gaps = 0
            while gaps * 2 <= n:
                best = rank.min()
                if best == NO_RANK:
                    return live[~dead][:-1], owner[~dead][:-1]
                chosen = np.flatnonzero(rank == best)
                if len(chosen) > 1:
                    chosen = chosen[every_second(after[chosen[:-1]] == chosen[1:])]
                gone = after[chosen]
                live[chosen] = self.product[self.of_rank[best]]
                after[chosen] = after[gone]
                before[after[gone]] = chosen
                dead[gone], rank[gone] = True, NO_RANK
                gaps += len(gone)
                touched = np.concatenate([chosen, before[chosen]])
                touched = touched[touched >= 0]
                follower = after[touched]
                rank[touched] = np.where(owner[touched] == owner[follower], self.ranks(live[touched], live[follower]), NO_RANK)
            live, owner = live[~dead], owner[~dead]

    def decode(self, ids: np.ndarray) -> bytes:
        n = self.bytes_n[ids]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return self.bytes[np.repeat(self.bytes_at[ids], n) + step].tobytes()


@functools.lru_cache(4)
def merger(path: str) -> Merger:
    return Merger(path)


class Words:
    """Pre-tokens by number, each with its ids; only new ones go through merge rounds."""

    def __init__(self, path: str):
        self.merger, self.split = merger(path), regex.compile(tokens.PATTERN).findall
        names = sorted(self.merger.vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.names = set(names)
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for name in self.names:
            self.number[f"\0{name}"] = len(self.number)
        self.ids = np.array([self.merger.vocabulary.special[x] for x in self.names], np.int64)
        self.n = np.ones(len(self.names), np.int64)
        #: Characters of each word; a special token's carries a mark before it.
        self.chars = np.array([len(x) for x in self.names], np.int64)
        self.at = np.arange(len(self.names))
        self.kept = 0

    def pretokens(self, text: str) -> list[str]:
        if self.special is None or not any(x in text for x in self.names):
            return self.split(text)
        return [w for part in self.special.split(text) for w in ([f"\0{part}"] if part in self.names else self.split(part))]

    def numbers(self, words: list[list[str]]) -> list[np.ndarray]:
        """The number of each pre-token of each text, after new ones have been encoded together."""
        if len(self.number) > KEPT_WORDS or self.kept > KEPT_CHARS:
            self.clear()
        number = self.number
        out = [np.fromiter(map(number.get, ws, itertools.repeat(-1)), np.int64, len(ws)) for ws in words]
        missed = [(ws, x, np.flatnonzero(x < 0)) for ws, x in zip(words, out, strict=True)]
        new = list(dict.fromkeys(ws[i] for ws, _, at in missed for i in at.tolist()))
        if new:
            ids, n = self.merger.encode([w.encode() for w in new])
            for w in new:
                number[w] = len(number)
            self.ids, self.n = np.concatenate([self.ids, ids]), np.concatenate([self.n, n])
            self.chars = np.concatenate([self.chars, np.fromiter(map(len, new), np.int64, len(new))])
            self.at = np.cumsum(self.n) - self.n
            self.kept += int(self.chars[-len(new) :].sum())
            for ws, x, at in missed:
                x[at] = [number[ws[i]] for i in at.tolist()]
        return out

    def gather(self, numbers: np.ndarray) -> np.ndarray:
        n = self.n[numbers]
        return self.ids[np.repeat(self.at[numbers], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [self.gather(x) for x in self.numbers([self.pretokens(t) for t in texts])]


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    words = Words(path)
    for whole in batches:
        for batch in slices(whole, "text"):
            ids = words.encode([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], names=["doc_id", "ids"])


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    m = merger(path)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = [None if x is None else m.decode(np.array(x, np.int64)).decode(errors="replace") for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])


def _digest(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    words = Words(path)
    for whole in batches:
        for batch in slices(whole, "text"):
            n, ids, texts = [], [], []
            for x in words.encode([t or "" for t in batch.column(1).to_pylist()]):
                n.append(len(x))
                ids.append(hashlib.sha256(x.astype("<u4").tobytes()).hexdigest())
                texts.append(hashlib.sha256(words.merger.decode(x).decode(errors="replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _source(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return source, source.schema["doc_id"].dataType.simpleString()


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, ids (array<int>) of each row's whole text, without added special tokens.

    A special token's own text becomes its id. Null text: empty, no ids. Null and repeated ids stay, row by row; other
    columns are ignored; an empty table gives no rows. No shuffle: rows stay in their partitions.
    """
    source, kind = _source(docs, id_col, text_col)
    return source.mapInArrow(functools.partial(_encode, path=path or tokens.default_path()), f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """doc_id, text of each row's ids; bytes that are no UTF-8 become U+FFFD. Null ids give null text, empty ids an empty one."""
    source = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return source.mapInArrow(functools.partial(_decode, path=path or tokens.default_path()), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, text string")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """encode, then decode, in one pass: doc_id, n_tokens, and SHA-256 of the ids (little-endian 32-bit) and of the decoded text."""
    source, kind = _source(docs, id_col, text_col)
    return source.mapInArrow(functools.partial(_digest, path=path or tokens.default_path()), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
