"""Edits in batches, waves in blocks, joins by rare members, nearest anchors in parts, and parsers."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxmeter.functions import edits, text
from voxmeter.operators import intervals, joins, stats, waves, windows


def slow_script(a, b):
    d = np.zeros((len(a) + 1, len(b) + 1), int)
    d[0], d[:, 0] = range(len(b) + 1), range(len(a) + 1)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            d[i, j] = min(d[i - 1, j - 1] + (x != y), d[i - 1, j] + 1, d[i, j - 1] + 1)
    out, i, j = [], len(a), len(b)
    while (i, j) != (0, 0):
        ways = []
        if i and j and a[i - 1] == b[j - 1] and d[i, j] == d[i - 1, j - 1]:
            ways.append(("", i - 1, j - 1))
        if i and j and d[i, j] == d[i - 1, j - 1] + 1:
            ways.append(("sub", i - 1, j - 1))
        if i and d[i, j] == d[i - 1, j] + 1:
            ways.append(("del", i - 1, j))
        ways.append(("ins", i, j - 1))
        op, p, q = ways[0]
        if op:
            out.insert(0, {"op": op, "a": a[p] if p < i else "", "b": b[q] if q < j else ""})
        i, j = p, q
    return out


@pytest.mark.parametrize("cells", [1 << 22, 50])
def test_edit_scripts(monkeypatch, cells):
    monkeypatch.setattr(edits, "CELLS", cells)
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("ab打😀") for _ in range(n))
    pairs = [(word(rng.randint(0, 14)), word(rng.randint(0, 14))) for _ in range(250)] + [("", ""), ("", "ab"), ("ab", ""), ("kitten", "sitting")]
    got = edits.scripts([a for a, _ in pairs], [b for _, b in pairs])
    for (a, b), ops in zip(pairs, got, strict=True):
        assert ops == slow_script(a, b)


def test_long_edits_keep_few_rows():
    import time

    rng, began = random.Random(4), time.time()
    a = "".join(rng.choice("abcdef") for _ in range(4000))
    b = "".join(c if rng.random() < 0.8 else rng.choice("xyz") for c in a)
    (ops,) = edits.scripts([a], [b])
    assert len(ops) == sum(x != y for x, y in zip(a, b, strict=True)) and time.time() - began < 20


def test_long_signals_in_blocks(spark):
    rng = np.random.default_rng(5)
    for size, taps in ((16, 5), (16, 40), (7, 7), (64, 1)):
        h = rng.standard_normal(taps)
        signals = {k: rng.standard_normal(n) for k, n in (("a", 200), ("b", 13), ("c", 1))}
        df = spark.createDataFrame([(k, i, float(v)) for k, x in signals.items() for i, v in enumerate(x)], "sig string, i long, v double")
        blocks = waves.in_blocks(df.repartition(5), "sig", "i", "v", size)
        got = waves.convolved(blocks, "sig", h.tolist(), size).collect()
        for k, x in signals.items():
            y = np.concatenate([r["x"] for r in sorted((r for r in got if r["sig"] == k), key=lambda r: r["block"])])
            want = np.convolve(x, h)
            assert np.allclose(y[: len(want)], want) and np.allclose(y[len(want) :], 0)
    with pytest.raises(ValueError):
        waves.convolved(blocks, "sig", [], 4)


def test_babble_and_perturbations(spark):
    pool = spark.createDataFrame([(1, [1.0, 2.0]), (2, [10.0]), (3, [100.0, 200.0, 300.0]), (4, [])], "place int, v array<double>")
    rows = spark.range(20)
    got = {r["id"]: r["x"] for r in waves.babble(rows, "id", pool, "v", 4, voices=2, seed=1).collect()}
    tiled = [[1.0, 2.0, 1.0, 2.0], [10.0] * 4, [100.0, 200.0, 300.0, 100.0]]
    pairs = [[(x + y) / 2 for x, y in zip(a, b, strict=True)] for a, b in combinations(tiled, 2)]
    assert len(got) == 20 and all(any(np.allclose(x, p) for p in pairs) for x in got.values()) and len({tuple(x) for x in got.values()}) > 1
    assert got == {r["id"]: r["x"] for r in waves.babble(rows.repartition(3), "id", pool, "v", 4, voices=2, seed=1).collect()}
    every = waves.babble(rows.limit(1), "id", pool, "v", 1, voices=9).first()["x"]
    assert every == pytest.approx([(1 + 10 + 100) / 3])
    x = F.array(*[F.lit(float(i)) for i in range(1, 9)])
    r = spark.range(1).select(waves.louder(x, 20.0).alias("l"), waves.later(x, 100).alias("t"), waves.hissing(F.array_repeat(F.lit(0.0), 20000), F.lit(3), -20.0).alias("h"), waves.hissing(F.array_repeat(F.lit(0.0), 20000), F.lit(3), -20.0).alias("again")).first()
    assert r["l"] == pytest.approx([10.0 * i for i in range(1, 9)]) and r["t"] == [0.0, 0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0]
    assert r["h"] == r["again"] and abs(np.std(r["h"]) - 0.1) < 0.005 and abs(np.mean(r["h"])) < 0.005


def test_common_members_meet_by_rare_ones(spark):
    rng = random.Random(6)
    held = {g: set(rng.sample(range(30), rng.randint(1, 12))) | {99} for g in range(60)}
    df = spark.createDataFrame([(g, m) for g, ms in held.items() for m in ms] * 2 + [(None, 1), (1, None)], "g long, m long")
    for least in (1, 3, 6):
        want = {(a, b, len(held[a] & held[b])) for a, b in combinations(sorted(held), 2) if len(held[a] & held[b]) >= least}
        assert {tuple(r) for r in joins.common_members(df, "g", "m", least).collect()} == want


def test_nearest_anchor_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, [float(v) for v in rng.standard_normal(4)], i % 9) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, v array<double>, c int")
    whole = sorted(map(tuple, intervals.nearest_anchor(df, "id", "v", "c").collect()))
    monkeypatch.setattr(intervals, "ANCHOR_BYTES", 200)
    assert sorted(map(tuple, intervals.nearest_anchor(df, "id", "v", "c").collect())) == whole
    x = np.array([r[1] for r in rows])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    means = np.stack([unit[[r[2] == c for r in rows]].mean(axis=0) for c in range(9)])
    means /= np.linalg.norm(means, axis=1, keepdims=True)
    got = {r["id"]: (r["anchor"], r["max_sim"]) for r in intervals.nearest_anchor(df, "id", "v", "c", unit=True).collect()}
    for i, s in enumerate(unit @ means.T):
        assert got[i][0] == int(s.argmax()) and got[i][1] == pytest.approx(s.max())


def test_percentiles_and_rank_replicates_within_keys(spark):
    rng = np.random.default_rng(9)
    rows = [(k, float(v)) for k, n in (("a", 1), ("b", 2), ("c", 500)) for v in np.round(rng.standard_normal(n), 1)]
    df = spark.createDataFrame(rows, "k string, v double")
    for r in windows.percentiles(df, "v", {"low": 0.1, "middle": 0.5, "high": 0.975}, ("k",)).collect():
        x = [v for k, v in rows if k == r["k"]]
        assert [r["low"], r["middle"], r["high"]] == pytest.approx(np.percentile(x, [10, 50, 97.5]).tolist())
    two = spark.createDataFrame([(i, float(i % 7), float((i * i) % 11)) for i in range(200)], "i long, x double, y double")
    assert stats.bootstrap_spearman(two, "i", "x", "y", 5).count() == 5


def test_answers_and_invented_texts(spark):
    def told(f, *values):
        return [spark.range(1).select(f(F.lit(v)).alias("x")).first()["x"] for v in values]

    assert told(text.parse_choice, " b.", "the answer", "cab", "no", None, "B or A") == ["B", "A", "A", None, None, "B"]
    assert told(text.parse_yes_no, "是的", "Yes!", "NO", "否", "他说是", "不否认", "maybe yes", "I know", "?", None, "是否") == [True, True, False, False, True, False, True, False, None, None, True]
    by = {n: [spark.range(1).select(text.is_invented(F.lit(t), F.lit("打开空调"), p).alias("x")).first()["x"] for t in ("", "打开空调", "哈哈哈哈", "hello world", "今日同比上涨了", "你好", "灯", "空调" * 20)] for n, p in text.INVENTED_LIMITS.items()}
    assert by == {
        "baseline": [False, False, True, True, True, False, False, True], "extended": [False, False, True, True, True, True, False, True],
        "extended_strict": [False, False, True, True, True, True, False, True], "news_only": [False, False, False, False, True, False, False, False]}
