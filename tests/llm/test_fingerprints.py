"""Fingerprints against sets of shingles."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from voxmeter.llm import fingerprints

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, part int, guest string, n_chars int"


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def whole(text):
    """Every shingle's hash: a sketch of all of them."""
    hashes, _ = fingerprints.sketches(pa.array([text or ""]), 1.0)
    return hashes


def prose(rng, n):
    return " ".join("".join(rng.choice("bdgklm") + rng.choice("aeiou") for _ in range(3)) for _ in range(n))


def test_sketches_keep_what_they_say():
    rng = random.Random(1)
    texts = [prose(rng, n) for n in (0, 1, 4, 5, 6, 30, 200, 3000)] + ["a b c d e f " * 50, "Ünï cödé " * 9, " \n\t", "ONE two"]
    hashes, edges = fingerprints.sketches(pa.array(texts))
    for text, a, b in zip(texts, edges[:-1], edges[1:], strict=True):
        every = whole(text)
        assert len(every) == len(shingles(text))
        want = [h for i, h in enumerate(np.sort(every)) if i == 0 or int(h) < int(2**64 * fingerprints.SHARE) - 1]
        assert hashes[a:b].tolist() == want
        assert fingerprints.sketch_of(fingerprints.text_of(hashes[a:b])).tolist() == want


def test_containment_of_unequal_texts_and_merging():
    rng = random.Random(2)
    small, large = prose(rng, 2000), prose(rng, 30_000)
    held = large + " " + small
    one = lambda t: fingerprints.sketches(pa.array([t]))[0]
    assert fingerprints.containment(one(small), one(held)) == 1.0
    half = small[: len(small) // 2] + prose(rng, 1000)
    exact = len(shingles(small) & shingles(half)) / min(len(shingles(small)), len(shingles(half)))
    assert abs(fingerprints.containment(one(small), one(half)) - exact) < 0.1
    assert fingerprints.containment(one(small), one(large)) < 0.01
    a, b = set(one(small).tolist()), set(one(half).tolist())
    assert fingerprints.merge(one(small), one(half)).tolist() == sorted(a | b)
    assert fingerprints.containment(one(""), one(" ")) == 1.0 and fingerprints.containment(one(""), one("a")) == 0.0
    assert fingerprints.merge(one("a b"), one("c d")).size >= 1


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for i, (doc, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        n = len(text)
        edited = text[: n - n // 2] + after[: n // 2]
        a, e, b = (fingerprints.sketches(pa.array([t], pa.large_string()))[0] for t in (text, edited, after))
        out.append((str(doc), n, hashlib.sha256(edited.encode()).hexdigest(), fingerprints.text_of(a), fingerprints.text_of(e), fingerprints.containment(a, e), fingerprints.containment(a, b)))
    return sorted(out)


def told(df):
    return sorted((str(r["doc_id"]), *(r[c] for c in ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"))) for r in df.collect())


@pytest.mark.parametrize("ranges", [1 << 20, 4000])
def test_edited(spark, monkeypatch, ranges):
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", ranges)
    rng = random.Random(3)
    texts = [prose(rng, rng.choice([0, 1, 3, 20, 100, 400])) for _ in range(120)] + [None, "", "é😀" * 50, "x " * 200_000, "y" * 500_000]
    rows = [(i * 7 - 300, t) for i, t in enumerate(texts)] + [(None, "no id at all")]
    rows += [(5000 + i, texts[40]) for i in range(50)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "g", 2) for r in rows], SCHEMA).repartition(5)
    assert told(fingerprints.edited(df)) == brute(rows)


def test_edges(spark):
    one = lambda rows: spark.createDataFrame([(*r, 1, "g", 2) for r in rows], SCHEMA)
    assert fingerprints.edited(one([])).count() == 0 and fingerprints.fingerprint(one([])).count() == 0
    for rows in ([(1, "alone in the table here")], [(None, "abc def")], [(None, None)]):
        assert told(fingerprints.edited(one(rows))) == brute(rows)
    # Equal rows and ids: each comes once for each row; of equal texts the fingerprints are equal.
    same = fingerprints.edited(one([(4, "one two three four five six")] * 9 + [(4, "other words"), (9, "z")])).collect()
    assert len(same) == 11 and len({r["fingerprint"] for r in same if r["doc_id"] == 4}) == 2
    assert [r["fingerprint"] for r in fingerprints.fingerprint(one([(1, None)])).collect()] == [""]
