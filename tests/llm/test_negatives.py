"""Hard negatives and their products against plain integer arithmetic."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxmeter.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, score long, anchors string, tile int"


@pytest.mark.parametrize("size,d", [(3, 5), (300, 64), (40_000, 1500), (1 << 21, 3000)])
def test_products(size, d):
    rng = np.random.default_rng(size)
    a, b = (rng.integers(-size, size + 1, (n, d)) for n in (7, 11))
    primes = negatives.moduli(float(size) * size * d)
    assert (negatives.products(negatives.residues(a.astype(float), primes), negatives.residues(b.astype(float), primes), primes) == a @ b.T).all()


def test_moduli_cover_their_bound():
    for bound in (1, 125, 126, 10**6, negatives.MOST):
        assert np.prod([float(p) for p in negatives.moduli(bound)]) >= 2 * bound + 1
    assert len(negatives.moduli(72_000)) == 3


def brute(rows, anchors=100, positives=5, keep=10):
    held = [(i, [int(np.floor(256 * x)) for x in v], l) for i, v, l in rows if i is not None and l is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    ask = {}
    for i, v, l in held:
        if i % anchors == 0:
            ask[i] = min(ask.get(i, (str(l), v)), (str(l), v))
    out = []
    for a, (label, v) in ask.items():
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, str(l) == label) for i, w, l in held if i != a and len(w) == len(v))
        for p, pi in sorted({(p, i) for p, i, same in [s for s in scored if s[2]][:positives]}):
            near = [(n, i) for n, i, same in scored if not same and 30 * -p <= 100 * -n <= 90 * -p][:keep]
            out += [(a, pi, r, i, -p, -n) for r, (n, i) in enumerate(near, 1)]
    return sorted(out)


def told(df):
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in df.collect())


@pytest.mark.parametrize("block,strip", [(4096, 256), (16, 3)])
def test_hard_negatives(spark, monkeypatch, block, strip):
    """A hot vector, ties, repeated rows, nulls, other dimensions, several blocks of anchors and rows."""
    for name, value in (("BLOCK_ROWS", block), ("TILE_ANCHORS", block), ("STRIP", strip)):
        monkeypatch.setattr(negatives, name, value)
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.25, 0.5, 1.0]) + (1.0 if i % 3 else 0.3) for _ in range(6)], rng.choice([0, 1, 2])) for i in range(900)]
    rows += [(i, [0.5] * 6, i % 2) for i in range(2000, 2400)]
    rows += [(3000 + i, [rng.random() for _ in range(3)], i % 2) for i in range(101)]
    rows += [(200, rows[200][1], 1), (201, rows[201][1], rows[201][2]), (202, [9.0] * 6, 1), (202, [9.0] * 6, 1), (300, None, 1), (None, [1.0] * 6, 1), (5001, [1.0, None], 1), (5002, [float("nan")] * 6, 0), (5003, [], 0), (5004, [1.0] * 6, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 5, "x", 2) for r in rows], SCHEMA).repartition(7)
    got = told(negatives.hard_negatives(df, F.col("vec_id") % 100 == 0))
    assert got == brute(rows) and len(got) > 200


def test_edges(spark):
    df = spark.createDataFrame([(i, [float(i + 1), 1e150 if i == 9 else 1.0], i % 2, 1, "a", 1) for i in range(10)], SCHEMA)
    assert not negatives.hard_negatives(df.where("false"), F.col("vec_id") == 0).collect()
    assert not negatives.hard_negatives(df, F.lit(None).cast("boolean")).collect()
    with pytest.raises(Exception, match="too large"):
        negatives.hard_negatives(df, F.col("vec_id") == 0).collect()
    large = [(i, [float(i * 3_000_000 + 1), 5.0], i % 2) for i in range(12)]
    got = told(negatives.hard_negatives(spark.createDataFrame([(*r, 1, "a", 1) for r in large], SCHEMA), F.col("vec_id") == 0))
    assert got == brute(large, anchors=100) and got
