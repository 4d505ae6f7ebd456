"""Shortest edits of many pairs of texts at once, in numpy."""

from __future__ import annotations

import math

import numpy as np

#: Cells of distance tables that a batch of pairs holds.
CELLS = 1 << 22
MATCH, SUB, DEL, INS = range(4)
NAMES = ("", "sub", "del", "ins")


def _codes(texts: list[str], width: int, filler: int) -> np.ndarray:
    out = np.full((len(texts), width), filler, np.int64)
    for row, t in zip(out, texts, strict=True):
        row[: len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def _below(row: np.ndarray, char: np.ndarray, other: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The next row of all pairs' tables: steps down and across first, then steps to the right by a running minimum."""
    best = row + 1
    np.minimum(best[:, 1:], row[:, :-1] + (char[:, None] != other), out=best[:, 1:])
    return np.minimum.accumulate(best - at, axis=1) + at


def _batch(a: list[str], b: list[str]) -> list[list[dict]]:
    """Each pair's edits. Only every sqrt(m)-th row is kept; the way back works out the rows between them again, block by block."""
    i, j = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    m, n = int(i.max()), int(j.max())
    x, y = _codes(a, m, -1), _codes(b, n, -2)
    at = np.arange(n + 1)
    step = max(1, math.isqrt(m))
    row = np.tile(at, (len(a), 1))
    kept = {0: row}
    for k in range(1, m + 1):
        row = _below(row, x[:, k - 1], y, at)
        if k % step == 0:
            kept[k] = row
    told = []
    for low in range(max(m - 1, 0) // step * step, -1, -step):
        rows = [kept[low]]
        for k in range(low + 1, min(low + step, m) + 1):
            rows.append(_below(rows[-1], x[:, k - 1], y, at))
        table = np.stack(rows)
        while len(pair := np.flatnonzero((i > low) | ((low == 0) & (j > 0)))):
            p, q = i[pair], j[pair]
            down, right = p > 0, q > 0
            here, up = table[p - low, pair, q], np.maximum(p - 1 - low, 0)
            across = table[up, pair, np.maximum(q - 1, 0)]
            both = down & right
            equal = both & (x[pair, np.maximum(p - 1, 0)] == y[pair, np.maximum(q - 1, 0)]) if m and n else both
            kind = np.select([equal & (here == across), both & (here == across + 1), down & (here == table[up, pair, q] + 1)], [MATCH, SUB, DEL], INS)
            some = kind != MATCH
            told.append((pair[some], kind[some], p[some], q[some]))
            i[pair] -= kind != INS
            j[pair] -= kind != DEL
    out: list[list[dict]] = [[] for _ in a]
    for pair, kind, p, q in reversed(told):
        for k, op, u, v in zip(pair.tolist(), kind.tolist(), p.tolist(), q.tolist(), strict=True):
            out[k].append({"op": NAMES[op], "a": a[k][u - 1] if op != INS else "", "b": b[k][v - 1] if op != DEL else ""})
    return out


def scripts(a: list[str], b: list[str]) -> list[list[dict]]:
    """Substitutions, deletions and insertions (op, a, b) of a shortest edit of each pair; where several ways are as short, the
    way back from the end takes a match, else a substitution, else a deletion, else an insertion."""
    out: list[list[dict]] = [[] for _ in a]
    order = sorted(range(len(a)), key=lambda k: (len(a[k]), len(b[k])))
    held: list[int] = []

    def cells(keys: list[int]) -> int:
        # Pairs are in the order of their first lengths.
        m, n = len(a[keys[-1]]), max(len(b[k]) for k in keys)
        return len(keys) * (n + 1) * (2 * math.isqrt(m) + 2)

    def flush() -> None:
        for k, ops in zip(held, _batch([a[k] for k in held], [b[k] for k in held]), strict=True):
            out[k] = ops

    for k in order:
        if held and cells([*held, k]) > CELLS or len(held) >= 4096:
            flush()
            held = []
        held.append(k)
    if held:
        flush()
    return out
