"""Near-duplicates, search, passages and the pipeline against brute force."""

import functools
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from voxmeter.llm import connect, embeddings, minhash, packing, passages, registry

SF = Path("/root/testdata/sf0.001")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, component_id long, grp long, n_chars long"


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def corpus(seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bdgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    base = [[word() for _ in range(rng.randint(30, 200))] for _ in range(25)]
    texts = [" ".join(w) for w in base]
    for w in base[:12]:
        for _ in range(rng.randint(1, 5)):
            v = list(w)
            for _ in range(rng.randint(0, 3)):
                v[rng.randrange(len(v))] = word()
            texts.append((" " if rng.random() < 0.5 else "\n").join(v).upper() if rng.random() < 0.3 else " ".join(v))
    hot = [word() for _ in range(80)]
    for i in range(600):  # one large group of near copies, larger than a block
        v = list(hot)
        v[i % 80] = word()
        texts.append(" ".join(v))
    texts += [texts[0]] * 40 + ["", None, " \n ", "one two", "One  two", "x " * 5000, "x " * 5000]
    rng.shuffle(texts)
    return texts


def components(ids, links):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def near(texts, percent):
    sets = {}
    for i, t in enumerate(texts):
        w = words(t)
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    held = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            held[x].append(i)
    common = Counter((a, b) for v in held.values() for k, b in enumerate(v) for a in v[:k])
    links = [p for p, n in common.items() if 100 * n >= percent * (len(sets[p[0]]) + len(sets[p[1]]) - n)]
    return sets, components(sets, links)


@pytest.mark.parametrize("percent", [80, 85])
def test_minhash(spark, percent):
    texts = corpus()
    sets, want = near(texts, percent)
    df = spark.createDataFrame([(i, t, "en", 7, 8, 9) for i, t in enumerate(texts)] + [(None, texts[0], "en", 1, 1, 1)], SCHEMA).repartition(5)
    out = minhash.near_duplicates(df, percent=percent).collect()
    assert len(out) == len(texts) + 1
    for r in out:
        if r["doc_id"] is None:
            assert r["kept"]
            continue
        assert r["n_shingles"] == len(sets[r["doc_id"]])
        assert r["component_id"] == want[r["doc_id"]]
        assert r["kept"] == (r["component_id"] == r["doc_id"])
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("percent", [80, 85])
def test_trees_keep_threshold_pairs_at_full_depth(percent):
    """Where every node is large, pairs must still share one of the deepest."""
    rng, n = np.random.default_rng(1), 6000
    held = minhash.trees(percent) * minhash.DEPTH
    a = rng.integers(0, 1 << 32, (n, held), np.uint32)
    b = np.where(rng.random(a.shape) < percent / 100, a, rng.integers(0, 1 << 32, a.shape, np.uint32))
    rows = pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(n), 2)), pa.array([x.tobytes() for x in np.concatenate([a, b])], pa.binary())], names=["id", "payload"])
    deepest = np.concatenate([x.column(minhash.DEPTH).to_numpy() for x in minhash._paths(iter([rows]), percent)]).reshape(2, n, -1)
    assert (deepest[0] == deepest[1]).any(axis=1).all()
    assert minhash.width(percent) >= held


def test_large_groups_are_linked_whole(spark):
    """Rows that the group's first one isn't like still find each other, across blocks."""
    old, connect.BLOCK_ROWS = connect.BLOCK_ROWS, 8
    try:
        rows = [(1, i, bytes([i % 3 + 1 if i else 0])) for i in range(100)]
        df = spark.createDataFrame(rows, "grp long, id long, payload binary")

        def same(a, b):
            i, j = np.nonzero(np.array([[x == y for y in (b if b is not None else a)] for x in a]).reshape(len(a), -1))
            return (i[i < j], j[i < j]) if b is None else (i, j)

        got = {r["id"]: r["component"] for r in connect.components(connect.link_groups(df, same)).collect()}
        assert {i: got.get(i, i) for i in range(100)} == {i: (0 if i == 0 else min(j for j in range(1, 100) if j % 3 == i % 3)) for i in range(100)}
    finally:
        connect.BLOCK_ROWS = old


@pytest.mark.parametrize("often", [20, 4096])
@pytest.mark.parametrize("percent", [80, 85])
def test_mixed_groups_are_split_by_rare_tokens(spark, monkeypatch, percent, often):
    """Of a template's many texts few are alike: the links are those of all pairs, and whole sets travel few times."""
    monkeypatch.setattr(connect, "BLOCK_ROWS", 8)
    monkeypatch.setattr(connect, "OFTEN", often)
    rng, n = np.random.default_rng(percent), 600
    template = rng.integers(1, 1 << 62, 120)
    sets = []
    for i in range(n):
        if i % 5 == 4:  # near the threshold, above and below it
            old = sets[rng.integers(0, i)]
            gone = rng.integers(0, 30)
            sets.append(np.unique(np.concatenate([rng.permutation(old)[gone:], rng.integers(1, 1 << 62, rng.integers(0, 12))])))
        else:
            sets.append(np.unique(np.concatenate([rng.permutation(template)[: rng.integers(60, 120)], rng.integers(1, 1 << 62, rng.integers(20, 80))])))
    held = [x.astype(np.uint64).tobytes() for x in sets]
    rows = [(g, 1000 * g + i, held[i]) for g, m in ((1, n), (2, 100), (3, 5)) for i in range(m)] + [(1, 1003, held[3]), (1, 1004, held[7])]
    df = spark.createDataFrame(rows, "grp long, id long, payload binary").repartition(4)
    sent = []
    whole = connect.materialize
    monkeypatch.setattr(connect, "materialize", lambda d, name: sent.append(whole(d, name)) or sent[-1] if name == "members" else whole(d, name))
    got = {r["id"]: r["component"] for r in connect.components(connect.link_groups(df, functools.partial(minhash._close, percent), minhash._shingles, percent / 100)).collect()}
    of = {x: set(np.frombuffer(x, np.uint64).tolist()) for x in held}
    common = {(x, y): len(of[x] & of[y]) for x in held for y in held}
    links = [(a, b) for k, (g, a, x) in enumerate(rows) for h, b, y in rows[:k] if g == h and 100 * common[x, y] >= percent * (len(of[x]) + len(of[y]) - common[x, y])]
    want = components({r[1] for r in rows}, links)
    assert {i: got.get(i, i) for i in want} == want
    assert len(set(want.values())) > n / 2
    # In pairs of blocks every set would travel some 150 times.
    assert len(sent) == 1 and sent[0].count() < 4 * n


def test_mixed_groups_of_signatures(spark, monkeypatch):
    monkeypatch.setattr(connect, "BLOCK_ROWS", 8)
    rng, n, least = np.random.default_rng(5), 300, 0.66
    base = rng.integers(0, 1 << 32, 72, np.uint32)
    held = []
    for i in range(n):
        of, share = (base, 0.5) if i % 3 else (held[i // 2] if i else base, 0.75)
        held.append(np.where(rng.random(72) < share, of, rng.integers(0, 1 << 32, 72, np.uint32)))
    rows = [(7, i, x.tobytes()) for i, x in enumerate(held)]
    df = spark.createDataFrame(rows, "grp long, id long, payload binary")
    got = {r["id"]: r["component"] for r in connect.components(connect.link_groups(df, functools.partial(minhash._alike, least), minhash._places, least)).collect()}
    want = components(range(n), [(a, b) for a in range(n) for b in range(a) if (held[a] == held[b]).sum() >= least * 72])
    assert {i: got.get(i, i) for i in range(n)} == {i: want[i] for i in range(n)}
    assert 1 < len(set(want.values())) < n


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["id"]: r["component"] for r in connect.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    ids = {x for e in edges for x in e}
    assert got == {i: c for i, c in components(ids, edges).items() if i in got}
    assert set(got) == ids
    assert connect.components(spark.createDataFrame([], "a long, b long")).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, rep long, score double"


def vectors(seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(300, 16))
    hot = base[0] + rng.normal(size=(700, 16)) * 0.08  # more than a block of near copies
    rows = [(i, [float(x) for x in v], i % 3) for i, v in enumerate(base)]
    rows += [(1000 + i, [float(x) for x in v], 0) for i, v in enumerate(hot)]
    rows += [(3000 + i, rows[5][1], rows[5][2]) for i in range(20)]
    rows += [(4000, None, 0), (4001, [0.0] * 16, 0), (4002, [float("nan")] + [1.0] * 15, 0), (4003, [None] + [1.0] * 15, 0), (4004, rows[1][1], None), (4005, [], 0), (4006, [1.0, 2.0], 0), (4007, [2.0, 4.0], 0), (None, rows[2][1], 2)]
    return [(*r, 1, 2.0) for r in rows]


def test_embedding_duplicates(spark):
    rows = vectors()
    out = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()}
    assert len(out) == len(rows)
    f = {r[0]: (np.array(r[1], np.float32).astype(float), r[2]) for r in rows if r[0] is not None and r[0] not in (4000, 4001, 4002, 4003, 4004, 4005)}
    ids = sorted(f)
    links = []
    for a_i, a in enumerate(ids):
        for b in ids[a_i + 1 :]:
            (x, la), (y, lb) = f[a], f[b]
            if la == lb and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98:
                links.append((a, b))
    n, comp = Counter(x for e in links for x in e), components([r[0] for r in rows if r[0] is not None], links)
    assert len(links) > 10000
    for i, r in out.items():
        assert r["n_links"] == n[i], i
        assert r["component_id"] == (comp[i] if i is not None else None)
        assert r["kept"] == (i is None or comp[i] == i)
    assert embeddings.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


@pytest.mark.parametrize("candidates", [5, 256])
def test_top_k(spark, monkeypatch, candidates):
    monkeypatch.setattr(embeddings, "CANDIDATES", candidates)
    rows = vectors(2)
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = defaultdict(list)
    for r in embeddings.top_k(df, F.col("vec_id") % 100 == 0, k=7).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    f = {r[0]: [int(np.floor(1024 * float(np.float32(x)))) for x in r[1]] for r in rows if r[0] is not None and r[0] not in (4000, 4002, 4003, 4005)}
    want = {}
    for q in (i for i in f if i % 100 == 0):
        s = sorted((-sum(a * b for a, b in zip(f[q], v, strict=True)), i) for i, v in f.items() if i != q and len(v) == len(f[q]))
        want[q] = [(k + 1, i, -x) for k, (x, i) in enumerate(s[:7])]
    assert {q: sorted(v) for q, v in got.items()} == want
    huge = spark.createDataFrame([(0, [1e6, 3.0]), (1, [1e6, 1.0]), (2, [1e6, 2.0])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in embeddings.top_k(huge, F.col("vec_id") == 0).orderBy("rank").collect()] == [(i, 1024000000**2 + 3072 * 1024 * i) for i in (2, 1)]
    assert embeddings.top_k(spark.createDataFrame([], VECTORS), F.col("vec_id") == 0).count() == 0
    assert embeddings.top_k(df, F.col("vec_id") % 100 == 0, k=7, broadcast_bytes=1000).count() == sum(map(len, want.values()))


def test_top_k_of_vectors_that_many_rows_share_and_of_huge_ones(spark):
    rows = [(i, [1.0, 2.0]) for i in range(500)] + [(i, [-1.0, float(i)]) for i in range(500, 700)] + [(3, [9.0, 9.0]), (950, [5e12, 0.0]), (901, [0.0, 1e-3])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = embeddings.top_k(df, F.col("vec_id") % 100 == 0, k=4).collect()
    whole = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows]
    for q in (0, 100, 600):
        own = next(v for i, v in whole if i == q)
        want = sorted((-sum(a * b for a, b in zip(own, v, strict=True)), i) for i, v in whole if i != q)[:4]
        assert [(-r["score"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == want
    with pytest.raises(Exception, match="fit a long"):
        embeddings.top_k(spark.createDataFrame([(0, [1e16, 0.0]), (1, [1e16, 0.0])], "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()


@pytest.mark.parametrize("bits", [7, 20])
def test_embedding_links_with_codes_of_many_bits(spark, monkeypatch, bits):
    """Recall at the bits and tables that 65 thousand and 500 million rows get, of pairs right above the threshold."""
    rng = np.random.default_rng(bits)
    base = rng.normal(size=(500, 64))
    rows = []
    for i, v in enumerate(base):
        v = v / np.linalg.norm(v)
        side = rng.normal(size=64)
        side -= side @ v * v
        cos = 0.9801 + 0.004 * rng.random()
        other = cos * v + (1 - cos**2) ** 0.5 * side / np.linalg.norm(side)
        rows += [(2 * i, v.tolist(), 0), (2 * i + 1, other.tolist(), 0)]
    monkeypatch.setattr(embeddings, "BUCKET", len(rows) / 2**bits)
    assert embeddings.plan_tables(len(rows), 0.98)[0] == bits
    out = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    found = sum(out[2 * i + 1]["component_id"] == 2 * i for i in range(500))
    assert found >= 499


def test_bits_apart_cover_the_threshold():
    rng = np.random.default_rng(1)
    p = np.arccos(0.98) / np.pi
    for n in (32, 84, 840):
        assert (rng.binomial(n, p, 200_000) > embeddings.most_apart(n, 0.98)).mean() < 1e-5
        assert embeddings.most_apart(n, 0.98) < n * 0.4


def test_passages(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("bdgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    run = lambda n: [word() for _ in range(n)]
    common, half = run(70), run(60)
    fuzzy = [word() if i % 17 == 9 else w for i, w in enumerate(common)]
    rows = [(0, run(100) + common + run(20)), (1, run(30)), (2, common + run(150)), (3, run(40) + fuzzy + run(40)), (4, run(200)), (5, run(20) + half), (6, run(90) + half[:30] + run(90)), (7, half + run(9)), (8, common[:45] + run(60))]
    rows = [(i, " ".join(w)) for i, w in rows] + [(9, " ".join(rows[4][1]))] + [(10, ""), (11, None), (12, "a b")]
    rows += [(20 + i, f"{' '.join(run(15))} {' '.join(common)} {' '.join(run(15))}") for i in range(60)] + [(None, rows[0][1])]
    df = spark.createDataFrame([(i, t, "en", 1, 2, len(t or "")) for i, t in rows], SCHEMA).repartition(4)
    found = passages.passages(df).cache()
    got = {r["doc_id"]: (r["start_word"], r["end_word"], r["source_ids"]) for r in found.collect()}
    assert set(got) == {2, 3, 7, 9, *range(20, 80)}
    assert got[2] == (0, 70, [0])
    assert got[3][0] <= 41
    assert got[3][1] >= 109
    assert got[7][:2] == (0, 60)
    assert got[9] == (0, 200, [4])
    assert all(got[i][:2] == (15, 85) and got[i][2][0] == 0 for i in range(20, 80))
    left = passages.remove(df, found)
    assert left.columns == df.columns
    texts = {r["doc_id"]: r["text"] for r in left.collect()}
    assert len(texts) == len(rows)
    old = dict(rows)
    assert texts[2].split() == old[2].split()[70:]
    assert texts[9] == ""
    assert all(texts[i] == old[i] for i in (0, 1, 4, 5, 6, 8, 10, 11, 12, None))
    assert passages.passages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_passages_down_to_the_threshold(spark):
    rng = random.Random(3)
    run = lambda n: [f"w{rng.getrandbits(40)}" for _ in range(n)]
    rows, want = [], set()
    for i in range(160):
        n = rng.choice((50, 60, 80))
        text = run(n)
        # Either evenly spread or anywhere but at the ends; a fifth of the words at most.
        changed = set(range(2, n, 5)) if i % 4 == 0 else set(rng.sample(range(1, n - 1), rng.randint(n // 8, n // 5)))
        copy = [f"x{i}-{j}" if j in changed else w for j, w in enumerate(text)]
        rows += [(2 * i, run(30) + text + run(30)), (2 * i + 1, run(12) + copy + run(12))]
        want.add(2 * i + 1)
    for i in range(400, 440, 2):
        text = run(60)
        copy = [f"x{i}-{j}" if j % 3 == 1 else w for j, w in enumerate(text)]
        rows += [(i, text), (i + 1, copy)]
    df = spark.createDataFrame([(i, " ".join(w), "en", 1, 2, 9) for i, w in rows], SCHEMA).repartition(4)
    found = passages.passages(df).collect()
    assert {r["doc_id"] for r in found} == want
    assert all(12 <= r["start_word"] <= r["end_word"] - 50 and r["end_word"] <= len(rows[r["doc_id"]][1]) - 12 for r in found)


def test_passages_that_repeat_a_phrase(spark):
    rng = random.Random(5)
    run = lambda n: [f"w{rng.getrandbits(40)}" for _ in range(n)]
    rows, want = [], {}
    for i, period in enumerate((1, 2, 3, 4, 5, 6, 7, 9, 12)):
        text = (run(period) * 100)[: 100 + i]
        longer = (text * 3)[: 2 * period * (100 // period)] if period < 4 else text
        rows += [run(20) + longer + run(20), run(33) + text + run(10)]
        want[2 * i + 1] = (33, 133 + i)
    df = spark.createDataFrame([(i, " ".join(w), "en", 1, 2, 9) for i, w in enumerate(rows)], SCHEMA).repartition(4)
    assert {r["doc_id"]: (r["start_word"], r["end_word"]) for r in passages.passages(df).collect()} == want


def test_links_of_frequent_seeds(spark, monkeypatch):
    """Documents of a frequent seed in ranges give the links that one task gives, and the same passages."""
    rng = random.Random(12)
    run = lambda n: [f"w{rng.getrandbits(40)}" for _ in range(n)]
    hot, line = run(60), run(6)
    rows = []
    for i in range(240):
        rows.append((3 * i, run(12) + (hot if i % 3 else []) + line * (i % 5) + run(9)))
    rows += [(7, hot + hot), (9, line * 40), (10, line * 55), (3, run(4) + hot)]
    df = spark.createDataFrame([(i, " ".join(w), "en", 1, 2, 9) for i, w in rows], SCHEMA).repartition(6)
    told = lambda found: sorted((r["doc_id"], r["start_word"], r["end_word"], r["source_id"], tuple(r["source_ids"])) for r in found.collect())
    whole = told(passages.passages(df))
    assert len(whole) > 150
    monkeypatch.setattr(passages, "FREQUENT", 20)
    monkeypatch.setattr(passages, "FREQUENT_SHARE", 0)
    monkeypatch.setattr(passages, "RANGE", 500)
    texts = df.selectExpr("doc_id doc", "text").cache()
    often = passages.frequent(texts)
    row, pos, h = passages.seeds_of(passages.text_buffers(pa.array([" ".join(w) for _, w in rows])))
    values, n = np.unique(h, return_counts=True)
    assert often.tolist() == values[n >= 20].tolist()
    at = np.flatnonzero(passages.among(h, often))
    want = set(zip(*(x.tolist() for x in passages.links(h[at], np.array([i for i, _ in rows])[row[at]], pos[at])), strict=True))
    got = passages.by_ranges(texts, often)
    assert {(r["doc"], r["owner"], m >> 32, m & 0xFFFFFFFF) for r in got.collect() for m in r["m"]} == want
    assert told(passages.passages(df)) == whole
    # As many seeds as documents, each as frequent as all: their number is bounded, whatever the number of documents.
    monkeypatch.setattr(passages, "FREQUENT_SHARE", 0.01)
    assert len(passages.frequent(texts)) <= 100


def test_ends_of_passages_by_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(400):
        before, behind = (np.append(0, np.cumsum(rng.random(rng.integers(0, 40)) < 0.7)) for _ in range(2))
        length = int(rng.integers(1, 30))
        equal = int(rng.integers(int(0.8 * length), length + 1)) if rng.random() < 0.8 else length
        ends = [[k for k in range(len(g)) if not k or g[k] > g[k - 1]] for g in (before, behind)]
        fits = [a + b for a in ends[0] for b in ends[1] if before[a] + behind[b] + equal >= passages.SIMILAR * (length + a + b) - 1e-9]
        a, b = passages.longest(before, behind, equal, length)
        assert a + b == max(fits, default=0)


def test_passages_with_ends_longer_than_any_window():
    """One anchor in 3000 words of which every fifth differs: the passage reaches from end to end."""
    x = np.arange(3000, dtype=np.uint32)
    y = np.where(np.arange(3000) % 6 == 5, x + 100_000, x).astype(np.uint32)
    assert passages.align(x, y, [(1500, 1500, 5)]) == [(0, 2999, 0, 2999)]


@pytest.mark.parametrize("vocabulary,edits,least", [(9, 0, 0.9), (9, 0.1, 0.6), (7, 0, 0.9)])
def test_passages_of_common_words_meet_their_partner(spark, vocabulary, edits, least):
    """Each four-word seed comes 18 or 50 times by chance; a copied passage is found by its longer seeds."""
    rng = random.Random(vocabulary)
    docs = [[f"w{rng.randrange(vocabulary)}" for _ in range(150)] for _ in range(800)]
    planted = []
    for _ in range(30):
        a, b = sorted(rng.sample(range(800), 2))
        i, j = rng.randint(0, 90), rng.randint(0, 90)
        piece = docs[a][i : i + 60]
        for p in rng.sample(range(60), int(60 * edits)):
            piece[p] = f"x{rng.random()}"
        docs[b][j : j + 60] = piece
        planted.append((b, j))
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    found = [(r["doc_id"], r["start_word"], r["end_word"]) for r in passages.passages(df).collect()]
    assert sum(any(d == b and s <= j + 8 and e >= j + 52 for d, s, e in found) for b, j in planted) >= least * 30


def test_removal_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a b c d", 1, 2, 3, 4), (None, "x", 1, 2, 3, 4)], "doc_id long, text string, _row int, spans int, _before int, row int")
    found = spark.createDataFrame([(1, 1, 3)], "doc_id long, start_word long, end_word long")
    out = passages.remove(df, found).orderBy("text").collect()
    assert [tuple(r) for r in out] == [(1, "a  d", 1, 2, 3, 4), (None, "x", 1, 2, 3, 4)]


def test_chains_by_brute_force():
    """The Fenwick sweep finds as good a chain as trying every predecessor."""
    rng = random.Random(6)
    for _ in range(100):
        found = sorted({(rng.randint(0, 150), rng.randint(0, 150), rng.randint(passages.K, 20)) for _ in range(rng.randint(1, 12))})
        best = [0.0] * len(found)
        for i, (x, y, n) in enumerate(found):
            best[i] = n
            for j, (a, b, m) in enumerate(found[:i]):
                if a + m <= x and b + m <= y:
                    best[i] = max(best[i], n + best[j] - passages.GAP * (x - a - m + y - b - m))
        got = passages.chains(found)
        top = max(best)
        if top < passages.LEAST_CHAIN:
            continue
        c = got[0]
        score = sum(n for _, _, n in c) - sum(passages.GAP * (max(0, q[0] - p[0] - p[2]) + max(0, q[1] - p[1] - p[2])) for p, q in zip(c, c[1:], strict=False))
        assert score >= top - 2 * passages.K


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for p in SF.iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    mine = registry.QUERIES[name](spark, str(SF))
    cur = con.execute(registry.ORACLE[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(mine.columns)
    assert sorted(tuple(r[c] for c in cols) for r in mine.collect()) == sorted(cur.fetchall())


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_pipeline(spark, tmp_path):
    base = registry.table(spark, str(SF), "documents")
    docs, kept = base, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(SF)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs
        if name != "packing":
            assert docs.columns == base.columns
    scored = {r["doc_id"] for r in registry.op10_toxicity(spark, str(SF)).where("predicted = 0").collect()}
    clean = {r["doc_id"]: r["text"] for r in kept["toxicity"].collect()}
    assert set(clean) == scored
    ids = sorted(clean)
    _, comp = near([clean[i] for i in ids], corpus_pipeline.NEAR_PERCENT)
    assert {r["doc_id"] for r in kept["near_duplicates"].collect()} == {ids[k] for k, c in comp.items() if k == c}
    assert kept["passages"].count() == kept["near_duplicates"].count()
    assert passages.passages(kept["passages"]).count() == 0
    pieces = kept["packing"].groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t"))
    assert pieces.where("n <> t").count() == 0
    assert pieces.count() == kept["passages"].count()
    assert packing.WINDOW == 2048


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_stages_take_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "some words", "en", "s", 10), (3, "same words " * 40, "en", "s", 1), (3, "same words " * 40, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:3]:
        for df in (docs, docs.limit(0)):
            out = stage(spark, df, str(SF))
            assert out.columns == df.columns
            assert out.count() <= df.count()
    assert corpus_pipeline.keep_one_of_each_group(spark, docs, str(SF)).count() == 5


@pytest.mark.parametrize(("slots", "sent", "packed", "buckets"), [(1, 1, 1, 16), (5, 7, 40, 16), (3, 1 << 17, 2 << 20, 1 << 16)])
def test_packed_seeds_are_all_seeds(monkeypatch, slots, sent, packed, buckets):
    """Whatever is packed and sent at once, every seed comes once, in the bucket of its hash; and counts are those of all."""
    monkeypatch.setattr(passages, "SENT", sent)
    monkeypatch.setattr(passages, "PACKED", packed)
    monkeypatch.setattr(passages, "TOLD", 1)
    texts = [*corpus()[:60], "", None, "one two three", "a a a a a a a a"]
    row, pos, h = passages.seeds_of(passages.text_buffers(pa.array(texts, pa.string())))
    ids = np.arange(len(texts), dtype=np.int64) * 3 - 7
    whole = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(texts, pa.string())], names=["doc", "text"])
    batches = [whole.slice(i, slots) for i in range(0, len(texts), slots)]
    low = np.uint64((1 << 48) - 1)
    want = Counter(zip(((h >> np.uint64(48)) * np.uint64(buckets) >> np.uint64(16)).tolist(), (h & low).tolist(), ids[row].tolist(), pos.tolist(), strict=True))
    got = Counter()
    for out in passages._seeds(iter(batches), buckets, np.zeros(0, np.uint64)):
        for bucket, *columns in zip(*(c.to_pylist() for c in out.columns), strict=True):
            held = [passages._unplanes(x, kind, width).tolist() for x, kind, width in zip(columns, (np.uint64, np.int64, np.uint32), (6, 8, 4), strict=True)]
            got.update((bucket, *x) for x in zip(*held, strict=True))
    assert got == want
    counts = Counter()
    for out in passages._counts(b.select(["text"]) for b in batches):
        for seed, n in zip(*(c.to_pylist() for c in out.columns), strict=True):
            counts[seed] += n
    assert counts.pop(None) == len(h)
    assert counts == Counter(h.view(np.int64).tolist())
    assert list(passages._seeds(iter(batches), buckets, np.sort(h))) == []
