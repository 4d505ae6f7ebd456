"""Packing, BPE, sharding, counts and toxicity against brute force, and their defined results in odd cases."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxmeter.llm import bpe, counts, packing, sharding, tokens, toxicity

ODD = ["", None, "<|endoftext|>", "a<|endoftext|> b", "aaaaaaaaaaaaaaa", "  \n\n  x", "²½ 12٣ don't I'LL", "  　x", "日本語テキスト" * 50, " " * 100, "\0x", "é" * 33, "🙂🙂👍🏽", "word " * 3000, "word " * 3000]
SCHEMA = "doc_id long, text string, row string, shard string, ids string, score double"


@pytest.fixture(scope="module")
def docs(spark):
    """Odd texts, a repeated and a null id, and columns whose names operators use themselves."""
    rows = [(i, t, "r", "s", "x", 1.0) for i, t in enumerate(ODD)] + [(3, "again", "r", "s", "x", 1.0), (None, "no id", None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def ids_of(text):
    return tokens.library(tokens.default_path()).encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(docs, none):
    rows = packing.pack(docs, window=64).collect()
    stream = {}
    for r in rows:
        assert len(r["ids"]) == r["length"] <= 64 - r["offset"]
        for i, x in enumerate(r["ids"]):
            stream[r["sequence_id"] * 64 + r["offset"] + i] = x
    whole = [ids_of(t) + [1] for t in (r["text"] for r in docs.collect())]
    assert sorted(stream) == list(range(sum(map(len, whole))))
    text = bytes(str([stream[i] for i in range(len(stream))])[1:-1], "ascii")
    for ids in whole:
        assert bytes(str(ids)[1:-1], "ascii") in text
    got = packing.pack(docs.where("doc_id = 13"), digest=True).collect()
    want = ids_of(ODD[13]) + [1]
    assert sorted((r["start"], r["ids_crc32"]) for r in got) == [(a, crc(want[a : a + 2048])) for a in range(0, len(want), 2048)]
    assert packing.pack(none).count() == 0


def test_wide_ids_pack_too(docs):
    """An end token beyond 16 bits widens what is stored."""
    rows = packing.pack(docs.where("doc_id = 5"), end_id=70000).collect()
    assert rows[-1]["ids"][-1] == 70000


def test_bpe(docs, none):
    got = {(r["doc_id"], r["ids_sha256"], r["decoded_sha256"], r["n_tokens"]) for r in bpe.digests(docs).collect()}
    want = set()
    for r in docs.collect():
        ids = ids_of(r["text"])
        back = tokens.library(tokens.default_path()).decode(ids, skip_special_tokens=False)
        want.add((r["doc_id"], hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), len(ids)))
    assert got == want
    turned = bpe.decode(bpe.encode(docs.where("doc_id is not null")))
    assert {(r["doc_id"], r["text"]) for r in turned.collect()} == {(r["doc_id"], r["text"] or "") for r in docs.where("doc_id is not null").collect()}
    assert bpe.digests(none).count() == 0


def test_bpe_merges_like_the_library():
    rng, words = random.Random(5), bpe.Words(tokens.default_path())
    texts = ["".join(rng.choice("aab  \n'st0é日🙂<|") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    assert [x.tolist() for x in words.encode(texts)] == [ids_of(t) for t in texts]
    assert [x.tolist() for x in packing.encoder(tokens.default_path())(texts)] == [ids_of(t) for t in texts]


def test_long_words_merge_like_the_library_and_fast():
    rng, words = random.Random(6), bpe.Words(tokens.default_path())
    letters = lambda n, some="etaoinshrdlucmfwypvbgkqjxz": "".join(rng.choice(some) for _ in range(n))
    texts = [letters(n) for n in (255, 256, 257, 300, 5000)] + [letters(3000, "ab"), "a" * 999, letters(2000, "aé日"), letters(700) + " short " + letters(900)]
    assert [x.tolist() for x in words.encode(texts)] == [ids_of(t) for t in texts]
    for text, least in ((letters(60_000), 2), (letters(300_000), 20), (" " * 1_000_000 + "x", 10), ("ab" * 200_000, 10)):
        began = time.time()
        (got,) = words.encode([text])
        assert time.time() - began < least
        assert got.tolist() == ids_of(text)
    assert words.kept > bpe.KEPT_CHARS / 8
    assert len(words.encode(["x y"] * 2)) == 2


def test_packing_of_very_long_texts(spark):
    texts = [" " * 1_000_000 + "x", "".join(random.Random(1).choice("abcdefgh") for _ in range(300_000)), ""]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), digest=True).collect()
    for i, text in enumerate(texts):
        own, want = sorted((r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == i), [*ids_of(text), 1]
        assert own == [(a, n, crc(want[a : a + n])) for a, n, _ in own]
        assert sum(n for _, n, _ in own) == len(want)


def test_sharding(docs, none, spark):
    many = docs.unionByName(docs).unionByName(docs)
    out = sharding.shard(many, shards=5, bucket_bytes=4096)
    rows = out.collect()
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(v) for v in by.values()]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    key = lambda r: (str(r["doc_id"]), str(r["text"]))
    assert sorted(map(key, rows)) == sorted(map(key, many.collect()))
    assert out.columns == ["doc_id", "text", "row", "ids", "score", "shard", "slot"]
    assert sharding.shard(none).count() == 0
    order = [r["id"] for r in sharding.shard(spark.range(200).withColumn("text", F.lit("same")), id_col="id").orderBy("slot", "shard").collect()]
    assert order != sorted(order)
    names = " ".join(str(out._jdf.queryExecution().executedPlan()).split())
    assert "Python" not in names
    assert "Arrow" not in names


def test_sharding_of_an_input_that_changes_when_read_again(spark):
    """Slots are gapless and no row repeats, though the input's values and order are new each time that it is computed."""
    df = spark.range(2000, numPartitions=7).select(F.col("id").alias("doc_id"), F.expr("uuid()").alias("text")).orderBy(F.rand())
    rows = sharding.shard(df, bucket_bytes=20_000).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(2000))
    assert {(r["shard"], r["slot"]) for r in rows} == {(i % 8, i // 8) for i in range(2000)}


def test_sharding_of_equal_rows_and_long_texts(spark):
    df = spark.createDataFrame([(1, "same")] * 3000 + [(2, "x" * 3_000_000), (None, None)], "doc_id long, text string")
    rows = sharding.shard(df, bucket_bytes=100_000).collect()
    assert {(r["shard"], r["slot"]) for r in rows} == {(i % 8, i // 8) for i in range(3002)}
    assert max(len(r["text"] or "") for r in rows) == 3_000_000


def test_counts(docs, none):
    edits = F.array(*[F.struct(F.lit(a).cast("int").alias("start"), F.lit(b).cast("int").alias("end"), F.lit(t).alias("text")) for a, b, t in ((2, 5, "'s"), (0, 0, "<|end"), (7, None, "x y"), (4, 6, ""), (10**6, 10**6, "!"), (None, 3, "no"))])
    trees = counts.build_trees(docs.withColumn("edits", edits), keep=["edits"])
    for r in trees.select("text", "n_tokens", "chars").collect():
        assert r["n_tokens"] == len(ids_of(r["text"]))
        assert np.frombuffer(r["chars"], "<i4")[1] == len(r["text"])
    for r in counts.apply_edits(trees).collect():
        assert r["n_tokens"] == len(ids_of(r["text"])), r["text"]
    assert counts.apply_edits(counts.build_trees(none.withColumn("edits", edits), keep=["edits"])).count() == 0
    same = counts.apply_edits(trees.withColumn("edits", F.lit(None).cast(counts.EDITS))).collect()
    assert all(r["n_tokens"] == r["n_tokens_before"] and r["n_encoded"] == 0 for r in same)


def whole(document):
    """The leaves hold the pre-tokens' characters, and all sums are right."""
    for tree in (document.chars, document.tokens):
        half = len(tree) // 2
        assert (tree[1:half] == tree[2::2] + tree[3::2]).all()
        assert (tree >= 0).all()


def test_counts_fuzz():
    rng, c = random.Random(2), counts.Counter(tokens.default_path())
    parts = ["a", "b", " ", "  ", "\n", "'s", "'", "1", "23", "é", "日本", "<|endoftext|>", "<|", "|>", "...", "hello", " world", "x" * 30]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
        (document,) = c.build([text])
        for _ in range(3):
            edits, at = [], 0
            for _ in range(rng.randint(0, 4)):
                a = rng.randint(at, len(text))
                at = rng.randint(a, min(len(text), a + rng.choice([0, 1, 3, 20])))
                edits.append((a, at, "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 2, 3, 200])))))
            ((text, _),) = c.edit([(text, document, edits)])
            whole(document)
            assert document.tokens[1] == len(ids_of(text))
            assert document.leaves(0, document.n)[0].tolist() == [counts.size_of(w) for w in c.words.pretokens(text)]
            assert counts.prefix(document.tokens, document.n) == document.tokens[1]


def test_counts_encode_little_however_often_a_text_is_edited():
    """100 rounds on one document, a long insertion first: the tree stays over pre-tokens, and each edit encodes few."""
    rng, c = random.Random(3), counts.Counter(tokens.default_path())
    text = "some words here " * 5000
    (document,) = c.build([text])
    ((text, _),) = c.edit([(text, document, [(40000, 40004, " long insertion" * 3000)])])
    for k in range(100):
        a = rng.randint(0, len(text)) if k % 2 else 41000
        ((text, encoded),) = c.edit([(text, document, [(a, min(len(text), a + rng.choice([0, 3])), rng.choice(["other", "", " two words", "x"]))])])
        assert encoded < 60
        assert document.chars[document.n :].max() < 40
    whole(document)
    assert document.tokens[1] == len(ids_of(text))
    assert document.n < 6 * len(c.words.pretokens(text))


def test_counts_hold_for_trees_edited_again(spark):
    """What apply_edits returns is the input of the next one."""
    df = spark.createDataFrame([(1, "one two three"), (2, None), (3, "x" * 500)], "doc_id long, text string")
    trees = counts.build_trees(df)
    for k in range(4):
        edits = F.array(F.struct(F.lit(3 * k).alias("start"), F.lit(3 * k + 1).alias("end"), F.lit(f" new{k} words").alias("text")))
        trees = counts.apply_edits(trees.withColumn("edits", edits))
    for r in trees.collect():
        assert r["n_tokens"] == len(ids_of(r["text"]))
        assert "new3" in r["text"]
    with pytest.raises(ValueError, match="names"):
        counts.build_trees(df.withColumn("tree", F.lit(1)), keep=["tree"])


def marked(n, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bdgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 3)))
    out = []
    for i in range(n):
        ws = [word() for _ in range(rng.randint(5, 300))]
        bad = i % 4 == 0
        if bad:
            for _ in range(rng.randint(1, 3)):
                ws.insert(rng.randint(0, len(ws)), rng.choice(["vilewort", "grumzel", "snarfex" + word(), "SNARFEX" + word()]))
        out.append((i, " ".join(ws), int(bad)))
    return out


def test_toxicity(spark, docs, none):
    rows = marked(800)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(df, df.where("doc_id < 500").select("doc_id", "toxic"))
    out = {r["doc_id"]: r for r in toxicity.score(df, model).collect()}
    held = [(out[i]["score"] >= toxicity.REJECT, bool(y)) for i, _, y in rows[500:]]
    right = sum(p == y for p, y in held) / len(held)
    assert right >= 0.97
    spans = [(rows[i][1][s["start"] : s["end"]].lower(), s["score"]) for i in range(500, 800) for s in out[i]["spans"]]
    assert spans
    assert sum(w.startswith(("vilewort", "grumzel", "snarfex")) for w, _ in spans) / len(spans) >= 0.97
    odd = toxicity.score(docs, model).collect()
    assert len(odd) == docs.count()
    assert all(0 <= r["score"] <= 1 for r in odd)
    assert all(r["score"] == 0 for r in odd if r["doc_id"] in (0, 1))
    assert toxicity.score(none, model).count() == 0
    assert all(r["score"] == 0 for r in toxicity.score(df, None).collect())
    assert toxicity.fit(["a b"], [0]) is None
    assert toxicity.fit(["", None], [0, 1]) is None


def test_marginals_are_those_of_all_tag_sequences():
    rng = np.random.default_rng(3)
    counts, stay = np.array([5, 1, 0, 3, 9]), rng.normal(size=(2, 2))
    emit = rng.normal(size=counts.sum())
    want, want_pairs = np.zeros(len(emit)), np.zeros((2, 2))
    for at, n in zip((np.cumsum(counts) - counts).tolist(), counts.tolist(), strict=True):
        total, one, two = 0.0, np.zeros(n), np.zeros((2, 2))
        for code in range(2**n):
            y = [code >> k & 1 for k in range(n)]
            w = np.exp(sum(emit[at + k] for k in range(n) if y[k]) + sum(stay[y[k - 1], y[k]] for k in range(1, n)))
            total += w
            for k in range(n):
                one[k] += w * y[k]
            for k in range(1, n):
                two[y[k - 1], y[k]] += w
        want[at : at + n], want_pairs = one / total, want_pairs + two / total
    for block in (1, 2, 3, 64):
        got, pairs = toxicity.marginals(emit, counts, stay, block, True)
        assert np.allclose(got, want)
        assert np.allclose(pairs, want_pairs)


def test_marginals_do_not_follow_the_block_length():
    """A chain is a whole text: tokens 40 apart still tell of one another, and blocks change nothing."""
    rng = np.random.default_rng(4)
    counts = np.array([1, 20_000, 0, 64, 65, 300, 128])
    emit, stay = rng.normal(size=counts.sum()) * 8, np.array([[4.0, -4.0], [-4.0, 4.0]])
    whole, pairs = toxicity.marginals(emit, counts, stay, 1 << 20, True)
    for block in (1, 7, 64, 1000):
        got, two = toxicity.marginals(emit, counts, stay, block, True)
        assert np.allclose(got, whole, atol=1e-9)
        assert np.allclose(pairs, two)
    extreme, _ = toxicity.marginals(np.array([1e6, -1e6, np.float64(0)] * 500), np.array([1500]), stay)
    assert np.isfinite(extreme).all()
    far = np.zeros(200)
    far[100] = 30.0
    assert toxicity.marginals(far, np.array([200]), np.array([[5.0, -5.0], [-5.0, 5.0]]))[0][130] > 0.6


def test_toxicity_sample_is_bounded_and_the_same_in_any_layout(spark):
    rows = marked(300) + [(1000, "vilewort " * 200_000, 1), (0, "another text", 1), (0, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = df.select("doc_id", "toxic")
    models = [toxicity.learn(df.repartition(n), labels.repartition(n), sample_bytes=1 << 20) for n in (1, 7)]
    assert models[0].weights == models[1].weights
    assert np.array_equal(models[0].stay, models[1].stay)
    assert toxicity.learn(df, labels, sample_bytes=80) is None
