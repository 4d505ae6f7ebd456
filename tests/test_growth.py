"""Phrases, corrections, linkage and accumulators against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxmeter.functions import phrases, text
from voxmeter.operators import corrections, intervals, linkage
from voxmeter.plans import catalog
from voxmeter.streaming import accumulate


def expected(sequence, known):
    out = {p[0] for p in known}
    for p in known:
        for n in range(min(len(sequence), len(p) - 1), 0, -1):
            if sequence[-n:] == p[:n]:
                out.add(p[n])
                break
    return sorted(out)


def test_phrases_against_brute_force(spark):
    rng = random.Random(2)
    known = [[rng.randint(0, 3) for _ in range(rng.randint(1, 5))] for _ in range(12)]
    rows = [(i, [rng.randint(0, 3) for _ in range(rng.randint(0, 9))]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, s array<int>").withColumn("known", F.lit(known))
    states = phrases.open_states(F.col("s"), F.col("known"))
    last = F.when(F.size("s") > 0, F.element_at(states, -1)).otherwise(F.array().cast("array<struct<phrase:int,length:int>>"))
    told = df.select("id", "s", phrases.candidates(F.col("s"), F.col("known")).alias("c"), phrases.expected(last, F.col("known")).alias("e"), F.size(states).alias("n")).collect()
    for r in told:
        assert r["c"] == r["e"] == expected(r["s"], known) and r["n"] == len(r["s"])
    table = spark.createDataFrame(list(enumerate(known)), "p long, t array<int>")
    joined = {r["id"]: r["candidates"] for r in phrases.next_tokens(df, "id", "s", table, "p", "t").collect()}
    assert joined == {i: expected(s, known) for i, s in rows}


def test_scores_are_raised_only_among_the_best(spark):
    def run(scores, tokens, bias, k):
        return spark.range(1).select(phrases.boosted(F.lit(scores), F.lit(tokens), bias, k).alias("x")).first()["x"]

    base = [0.0, 0.1, 0.9, 0.2, 1.0]
    assert run(base, [2], 1.5, 2) == pytest.approx([0.0, 0.1, 2.4, 0.2, 1.0])
    assert run(base, [2], 1.5, 1) == base
    assert run([0.0, -5.0, -4.0, 2.0, 1.0], [1], 10.0, 2)[1] == -5.0
    assert run([1.0, 1.0, 1.0], [0, 2], 1.0, 2) == [2.0, 1.0, 1.0]
    for bad in ({"bias": 0.0}, {"k": 0}):
        with pytest.raises(ValueError):
            phrases.boosted(F.lit(base), F.lit([1]), **bad)


def corrected(t, vocabulary, pairs, sounds):
    """Straight from the rule: at each place the longest span with a word one character away and a known pair."""
    out, i = "", 0
    while i < len(t):
        for n in (4, 3, 2):
            span = t[i : i + n]
            near = []
            for w in vocabulary:
                if len(span) == n == len(w) and sum(a != b for a, b in zip(span, w, strict=True)) == 1:
                    k = next(k for k in range(n) if span[k] != w[k])
                    if (span[k], w[k]) in pairs:
                        alike = span[k] in sounds and sounds[span[k]] == sounds.get(w[k])
                        near.append((not alike, -k, w))
            if near:
                out, i = out + min(near)[2], i + n
                break
        else:
            out, i = out + t[i], i + 1
    return out


def test_longest_spans_are_corrected_first(spark):
    rng = random.Random(5)
    letters = "打开空调关灯风"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    vocabulary = sorted({word(rng.randint(2, 4)) for _ in range(40)} | {"abcde"})
    pairs = {(a, b) for a in letters for b in letters if a != b and rng.random() < 0.4}
    sounds = dict(zip(letters, "112233x", strict=True))
    texts = [(i, word(rng.randint(0, 12))) for i in range(200)] + [(900, None), (901, "")]
    df = spark.createDataFrame(texts, "id long, t string")
    got = corrections.fuzzy_corrected(df, "id", "t", spark.createDataFrame([(w,) for w in vocabulary], "w string"), "w", spark.createDataFrame(sorted(pairs), "wrong string, right string"), sounds)
    rows = {r["id"]: r for r in got.collect()}
    assert len(rows) == len(texts)
    for i, t in texts:
        want = corrected(t or "", vocabulary, pairs, sounds)
        assert rows[i]["after"] == want
        assert [(c["place"], c["was"], c["is"]) for c in rows[i]["changes"]] == [(k + 1, a, b) for k, (a, b) in enumerate(zip(t or "", want, strict=True)) if a != b]
    assert sum(rows[i]["after"] != (t or "") for i, t in texts) > 50


def slow_clusters(x, cutoff):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    dist, groups = 1 - x @ x.T, [[i] for i in range(len(x))]
    while len(groups) > 1:
        best, i, j = min((dist[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        if best >= cutoff:
            break
        groups[i] += groups.pop(j)
    return sorted(sorted(g) for g in groups)


@pytest.mark.parametrize("large", [4096, 10])
def test_average_linkage(spark, monkeypatch, large):
    """In one task and in rounds of blocks: the groups that merging the nearest pair at a time gives."""
    monkeypatch.setattr(linkage, "BLOCK", 16)
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((6, 8))
    held = {"a": centres[rng.integers(0, 6, 70)] + 0.5 * rng.standard_normal((70, 8)), "b": rng.standard_normal((40, 8)), "c": rng.standard_normal((1, 8)), "d": np.repeat(rng.standard_normal((3, 8)), [9, 5, 1], axis=0)}
    rows = [(r, i, [float(v) for v in x]) for r, xs in held.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "rec string, id long, v array<double>").repartition(5)
    got = linkage.clustered(df, "rec", "id", "v", 0.6, large=large).collect()
    for r, xs in held.items():
        by = {}
        for row in got:
            if row["rec"] == r:
                by.setdefault(row["cluster"], []).append(row["id"])
        assert sorted(sorted(g) for g in by.values()) == slow_clusters(xs, 0.6)
        assert all(min(g) == c for c, g in by.items())
    counts = {r["rec"]: (r["n"], r["clusters"]) for r in intervals.clusters(df, "rec", "v", 0.6).collect()}
    assert counts == {r: (len(xs), len(slow_clusters(xs, 0.6))) for r, xs in held.items()}


def test_two_thousand_vectors_take_seconds():
    import time

    rng, began = np.random.default_rng(1), time.time()
    x = rng.standard_normal((2000, 64))
    assert len(set(linkage.linked(x / np.linalg.norm(x, axis=1, keepdims=True), 0.5).tolist())) > 1
    assert time.time() - began < 10


def test_totals_go_on_after_a_restart(spark, tmp_path):
    """Stopped between files, killed within a trigger, and begun again: the totals are those of all rows, each once."""
    source, state = tmp_path / "in", str(tmp_path / "acc")
    rng, want = random.Random(3), Counter()

    def more(n):
        rows = [(rng.choice("xyz"), rng.randint(0, 9)) for _ in range(n)]
        for k, v in rows:
            want[k] += v
        spark.createDataFrame(rows, "k string, v long").coalesce(1).write.mode("append").parquet(str(source))

    def held():
        acc = accumulate.Accumulator(spark, state, ["k"], {"total": F.col("v"), "n": F.lit(1)}, compact=3)
        stream = spark.readStream.schema("k string, v long").option("maxFilesPerTrigger", 1).parquet(str(source))
        return acc, stream

    source.mkdir()
    acc, stream = held()
    assert acc.totals("k string, total long, n long").count() == 0
    for n in (50, 20, 1, 7, 90):
        more(n)
        acc, stream = held()
        acc.update(stream)
        assert {r["k"]: r["total"] for r in acc.totals().collect()} == dict(want)
    acc.update(stream)
    assert {r["k"]: r["total"] for r in acc.totals().collect()} == dict(want)
    more(30)
    more(30)
    acc, stream = held()
    failing = stream.withColumn("v", F.when(F.rand() < 2, F.raise_error(F.lit("killed"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="killed"):
        acc.update(failing)
    acc, stream = held()
    acc.update(stream)
    assert {r["k"]: r["total"] for r in acc.totals().collect()} == dict(want)
    acc.reset()
    assert acc.totals("k string, total long, n long").count() == 0
    acc.update(stream)
    assert {r["k"]: r["total"] for r in acc.totals().collect()} == dict(want)
    runs = spark.createDataFrame([("a",), ("b",)], "run string")
    assert [r["run"] for r in accumulate.missing_runs(runs, runs.where("run = 'a'"), "run").collect()] == ["b"]


def like_its_sql(spark, duck, d, name):
    """Whether a query gives the rows of its SQL over a folder's tables."""
    df = catalog.queries()[name](spark, str(d))
    cols = ", ".join(f'"{c}"' for c in df.columns)
    mine = [tuple(r) for r in df.collect()]
    theirs = duck.execute(f"SELECT {cols} FROM ({catalog.oracle_sql()[name]})").fetchall()
    return mine and sorted(mine, key=str) == sorted(theirs, key=str)


def test_empty_segments_inside_others_count(spark, tmp_path):
    """Events of no length, at the edges of others and inside them, over bins' bounds, and events that end before they start."""
    import duckdb

    values = "list_value(0.0, 0.0, 30.0, 1300.0, 4.0, -2.0)"
    duck = duckdb.connect()
    duck.execute(f"CREATE TABLE events AS SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_seconds(CASE WHEN i % 7 = 0 THEN i * 600 // 7 ELSE i * 37 % 4000 END) AS ts, i % 3 AS user_id, 'kind' || i % 4 AS event_type, ({values})[i % 6 + 1]::DOUBLE AS value, '' AS props FROM range(400) t(i)")
    duck.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    assert like_its_sql(spark, duck, tmp_path, "j17_overlap_join")


def test_routes_work_each_text_out_once(spark, tmp_path):
    """Marks of both texts are stripped once each in the plan, and the gate's run is that of the loop over characters."""
    spark.createDataFrame([(i, i % 11) for i in range(40)], "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    plan = catalog.queries()["t29_routes"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 2
    rng = random.Random(4)
    said = spark.createDataFrame([("".join(rng.choice("灯\n𠀀a") for _ in range(rng.randint(0, 9))),) for _ in range(300)], "t string")
    t = F.col("t")
    told = said.select((text.longest_run(t) >= 3).alias("want"), text.has_run(t, 3).alias("got"), (text.words_held(t, ["灯", "𠀀a"]) > 0).alias("held"), text.any_held(t, ["灯", "𠀀a"]).alias("any")).collect()
    assert all(r["want"] == r["got"] and r["held"] == r["any"] for r in told) and {r["got"] for r in told} == {r["any"] for r in told} == {True, False}


def test_copies_are_one_group_and_few_groups_end_the_rounds(spark, monkeypatch):
    """Sixty copies take no rounds of their own, vectors without length stay alone, and what is left ends in one task."""
    monkeypatch.setattr(linkage, "BLOCK", 16)
    names, inner = [], linkage.written
    monkeypatch.setattr(linkage, "written", lambda df, name: names.append(name) or inner(df, name))
    rng = np.random.default_rng(3)
    x = np.concatenate([np.repeat(rng.standard_normal((2, 6)), [60, 7], axis=0), rng.standard_normal((40, 6)), np.zeros((3, 6))])
    df = spark.createDataFrame([("r", i, [float(v) for v in row]) for i, row in enumerate(x)], "rec string, id long, v array<double>")
    got, by = linkage.clustered(df, "rec", "id", "v", 0.6, large=20).collect(), {}
    for row in got:
        by.setdefault(row["cluster"], []).append(row["id"])
    want = slow_clusters(x[:107], 0.6) + [[107], [108], [109]]
    assert sorted(sorted(g) for g in by.values()) == want and all(min(g) == c for c, g in by.items())
    assert 1 <= names.count("merged") <= 3


def test_phrases_that_overlap_themselves(spark):
    """Phrases and sequences of two tokens, copies of phrases, long ends that come again inside: brute force."""
    rng = random.Random(9)
    for _ in range(3):
        known = [[rng.randint(0, 1) for _ in range(rng.randint(1, 7))] for _ in range(9)]
        known += known[:4] + [[0, 0, 0, 1], [0, 0, 1], [1, 0, 1, 0, 1, 1]]
        rows = [(i, [rng.randint(0, 1) for _ in range(rng.randint(0, 10))]) for i in range(200)] + [(900, None)]
        df, table = spark.createDataFrame(rows, "id long, s array<int>"), spark.createDataFrame(list(enumerate(known)), "p long, t array<int>")
        got = [(r["id"], r["candidates"]) for r in phrases.next_tokens(df, "id", "s", table, "p", "t").collect()]
        assert sorted(got) == [(i, expected(s or [], known)) for i, s in rows]


def test_rows_do_not_meet_each_phrase(spark):
    """Thirty thousand rows end with what thirty thousand phrases begin with: not one pair of both is made."""
    import time

    began = time.time()
    df = spark.range(30_000).selectExpr("id", "array('x', 'a') AS s")
    table = spark.range(30_000).selectExpr("id AS p", "array('a', concat('b', id % 3), 'c') AS t")
    told = phrases.next_tokens(df, "id", "s", table, "p", "t").groupBy("candidates").count().collect()
    assert [tuple(r) for r in told] == [(["a", "b0", "b1", "b2"], 30_000)] and time.time() - began < 60
