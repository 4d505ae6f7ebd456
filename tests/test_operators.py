"""Goldens of the operators on small relations."""

import pytest
from pyspark.sql import functions as F

from voxmeter.operators import aggregates as agg
from voxmeter.operators import audit, intervals, joins, sampling, seams, stats, sweep, windows


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_joins(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    b = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (4, "z", 3)], "k int, w string, o int")
    assert rows(joins.last_wins(b, "k", "o").select("k", "w"), "k") == [(1, "y"), (4, "z")]
    hit, miss = joins.matched(a, b.select("k").distinct(), "k")
    assert (hit.count(), rows(miss.select("k"), "k")) == (1, [(2,), (3,)])
    assert rows(joins.left_default(a, b.where("o = 2"), "k", {"w": "no"}).select("k", "w"), "k") == [(1, "y"), (2, "no"), (3, "no")]
    assert rows(joins.overlay(a, b.where("o = 1"), "k", "v", "w", F.col("w") == "x").select("k", "v"), "k") == [(1, "x"), (2, "b"), (3, None)]
    assert rows(joins.first_source([a.where("k = 1"), a], "k").select("k", "source"), "k") == [(1, 0), (2, 1), (3, 1)]
    s = spark.createDataFrame([("r", 0.0, 4.0), ("r", 5.0, 5.0), ("r", 3.0, 9.0)], "rec string, start double, end double")
    met = joins.overlapping(s.withColumn("i", F.monotonically_increasing_id()), s, "rec", 2.0)
    assert met.count() == 4
    g = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 2)], "g string, m int")
    assert rows(joins.common_members(g, "g", "m", 2)) == [("a", "b", 2)]


def test_interval_merge(spark):
    s = spark.createDataFrame([(1, 8, 12), (1, -2, 3), (1, 3, 5), (1, 20, 20)], "k int, start int, end int")
    clipped = s.select("k", F.greatest("start", F.lit(0)).alias("start"), F.least("end", F.lit(10)).alias("end"))
    assert rows(windows.merge_intervals(clipped, ["k"]), "start") == [(1, 0, 5), (1, 8, 10)]
    assert rows(windows.islands(spark.createDataFrame([(1, x) for x in (1, 2, 3, 7, 9, 10)], "k int, f int"), ["k"], "f", 2), "start") == [(1, 1, 4), (1, 9, 11)]
    assert spark.range(1).select(windows.window_starts(F.lit(40), 15, 10)).first()[0] == [0, 10, 20, 25]
    assert spark.range(1).select(windows.window_starts(F.lit(9), 15, 10)).first()[0] == [0]
    p = windows.pieces(s.where("end > start"), ["k"])
    assert rows(p, "start") == [(1, -2, 3, 1), (1, 3, 5, 1), (1, 8, 12, 1)]


def test_ranks_and_quartiles(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 1, 2, 3, 4, 5, 6, 7, 8, 9)], "v double")
    assert rows(windows.mean_ranks(df, "v"), "v")[:2] == [(1.0, 1.5, 2), (2.0, 3.0, 1)]
    parts = dict(rows(windows.quartile(df, "v").groupBy("part").count()))
    assert parts == {1: 2, 2: 2, 3: 2, 4: 4}


def test_auc_and_curve(spark):
    df = spark.createDataFrame([(0.9, True), (0.5, True), (0.5, False), (0.1, False)], "s double, y boolean")
    assert rows(stats.auc(df, "s", "y")) == [(0.875, 2, 2)]
    assert rows(stats.auc(df.where("y"), "s", "y")) == [(None, 2, 0)]
    assert [(r[1], r[2]) for r in rows(stats.pr_curve(df, "s", "y"), F.desc("thr"))] == [(1, 0), (2, 1), (2, 2)]
    line = spark.createDataFrame([(float(i), float(i * i)) for i in range(6)], "x double, y double")
    assert abs(rows(stats.spearman(line, "x", "y"))[0][0] - 1) < 1e-12


def test_threshold_fit(spark):
    df = spark.createDataFrame([("s", 0.1, 5, 1), ("s", 0.2, 5, 2), ("t", 0.8, 2, 7), ("t", None, 1, 0)], "g string, f double, raw int, enh int")
    assert rows(stats.fit_threshold(df.where("f is not null"), "f", "raw", "enh").select("accepted", "errors", "thr")) == [(2, 5, 0.2)]
    folds = {r[0]: (r[1], r[2]) for r in rows(stats.leave_one_out(df, "g", "f", "raw", "enh"))}
    assert folds == {"s": (float("-inf"), 10), "t": (0.2, 3)}


def test_leave_one_out_by_brute_force(spark):
    import random

    rng = random.Random(7)
    data = [(rng.choice("abcde"), rng.choice([None, *map(float, range(12))]), rng.randint(0, 9), rng.randint(0, 9)) for _ in range(150)] + [("z", None, 3, 4), ("y", 40.0, 9, 0), ("y", 41.0, 9, 0)]
    got = {r[0]: (r[1], r[2]) for r in rows(stats.leave_one_out(spark.createDataFrame(data, "g string, f double, raw int, enh int"), "g", "f", "raw", "enh"))}
    for g in {x[0] for x in data}:
        rest = [x for x in data if x[0] != g]
        score = lambda some, t: sum(e if f is not None and f <= t else r for _, f, r, e in some)
        fits = [(score(rest, t), sum(x[1] is not None and x[1] <= t for x in rest), t) for t in {float("-inf"), *(float(x[1]) for x in rest if x[1] is not None)}]
        thr = min(fits)[2]
        assert got[g] == (thr, score([x for x in data if x[0] == g], thr)), g


def test_sweep_and_policies(spark):
    df = spark.createDataFrame([(0.1, 0.2, False, 2, 10), (0.6, 0.0, False, 0, 10), (0.2, 0.0, True, 0, 5), (0.7, 1.0, True, 5, 5)], "sim double, cer double, neg boolean, e int, n int")
    got = {round(r["thr"], 2): r for r in sweep.threshold_sweep(df, sweep.grid(df, 0.0, 0.5, 3), "sim", "cer", "neg").collect()}
    assert got[0.5]["pos_cer"] == 0.5
    assert got[0.5]["neg_rr"] == 0.5
    assert got[1.0]["neg_rr"] == 1.0
    p = {r["policy"]: r for r in sweep.policies(df, {"all": F.lit(True), "none": F.lit(False)}, "e", "n", "neg").collect()}
    assert p["none"]["cer_final"] == 1.0
    assert p["all"]["cer_final"] == 0.1


def test_aggregates(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("a", "y", 3), ("b", "x", 4)], "k string, v string, o int")
    assert [r[:2] for r in rows(agg.top_values(df, "k", "v", "o", 1).select("k", "v"), "k")] == [("a", "y"), ("b", "x")]
    assert rows(agg.by_each(df, ["k"], [F.count(F.lit(1)).alias("n")]), "value") == [("k", "a", 3), ("all", "all", 4), ("k", "b", 1)]
    d = agg.decompose(spark.createDataFrame([(1.0,), (-3.0,)], "d double"), "d", F.when(F.col("d") > 0, "up").otherwise("down"))
    assert sum(r["delta"] for r in d.collect()) == -2.0


def test_audits(spark):
    df = spark.createDataFrame([("train", 1, "p"), ("dev", 1, "q"), ("dev", 2, "q")], "split string, spk int, path string")
    assert rows(audit.split_overlap(df, "split", ["spk", "path"])) == [("spk", "1", "dev|train")]
    assert rows(audit.duplicates(df, ["path"])) == [("q", 2)]
    assert rows(audit.depends(df, "path", "spk")) == [("q", 2)]
    assert rows(audit.group_contract(df, "split", {"two": F.count(F.lit(1)) == 2})) == [("two", "train")]
    assert rows(audit.fingerprint(df)) == rows(audit.fingerprint(df.orderBy("path")))
    assert audit.rows_differ(df, df, "spk", "path").count() >= 0


def test_sampling(spark):
    df = spark.range(100).select("id", (F.col("id") % 4).alias("g"))
    assert sampling.stratified(df, "g", "id", 20).groupBy("g").count().select("count").distinct().collect()[0][0] == 5
    assert rows(sampling.stratified(df, "g", "id", 20).select("id"), "id") == rows(sampling.stratified(df.repartition(7), "g", "id", 20).select("id"), "id")
    s = sampling.disjoint_split(df, "g", [("a", 0.5), ("b", 0.5)])
    assert s.groupBy("g").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    assert rows(sampling.replacement_pairs(spark.createDataFrame([("cat", "cut"), ("dog", "fig"), ("sun", "sun")], "a string, b string"), "a", "b")) == [("u", "a", 1)]
    assert sampling.counterfactuals(df, "id").count() == 300


def test_frames_and_clusters(spark):
    s = spark.createDataFrame([("r", "t", 0, 50), ("r", "o", 20, 40), ("r", "o", 60, 60)], "rec string, spk string, start int, end int")
    assert rows(intervals.stno(intervals.frames(s, ["rec", "spk"], 10), "rec", "spk", "frame", "t")) == [("r", 3, 0, 2)]
    v = spark.createDataFrame([("r", [1.0, 0.0]), ("r", [0.99, 0.01]), ("r", [0.0, 1.0])], "rec string, v array<double>")
    assert rows(intervals.clusters(v, "rec", "v", 0.5)) == [("r", 3, 2)]


def test_model_seam(spark):
    def make():
        def model(batch):
            if len(batch) > 1 or batch["id"].iloc[0] == 2:
                raise ValueError("out of memory")
            return batch.assign(text="t")

        return model

    out = seams.apply_model(spark.range(4).coalesce(1), make, "id long, text string", key="id")
    assert rows(out, "id") == [(0, "t", None), (1, "t", None), (2, None, "ValueError: out of memory"), (3, "t", None)]


def test_bootstrap_holds_the_delta(spark):
    df = spark.range(200).select(F.col("id").alias("k"), F.lit(10).alias("n"), F.lit(3).alias("b"), (F.lit(3) + F.col("id") % 2).alias("a"))
    r = stats.bootstrap_delta(df, "k", "n", "b", "a", 50).first()
    assert r["lo"] < r["delta"] == 0.05 < r["hi"]


def test_rotation_and_layers(spark):
    from collections import Counter
    from itertools import combinations

    from voxmeter.operators import sampling

    for n, rounds in ((27, 9), (29, 9), (36, 6), (9, 3)):
        rows = sampling.rotation(spark.range(n), "id", rounds).collect()
        assert len(rows) == rounds * (n // 3)
        assert max(Counter(p for r in rows for p in combinations(sorted((r.A, r.B, r.C)), 2)).values()) == 1
        roles = Counter((s, role) for r in rows for role, s in zip("ABC", (r.A, r.B, r.C), strict=True))
        assert set(roles.values()) == {rounds // 3}
        assert len(roles) == 3 * (n - n % 3)
        assert all(len({s for r in rows if r["round"] == k for s in (r.A, r.B, r.C)}) == n - n % 3 for k in range(rounds))
    for n, rounds in ((27, 4), (12, 3), (0, 3)):
        with pytest.raises(ValueError, match="rounds"):
            sampling.rotation(spark.range(n), "id", rounds)
    pools = {"a": F.col("id") % 2 == 0, "b": F.col("id") % 4 == 0, "c": F.col("id") < 30}
    got = {r["id"]: r["layer"] for r in sampling.layers(spark.range(100), "id", pools, {"a": 40, "b": 20, "c": 5}).collect()}
    taken = Counter(got.values())
    assert taken["a"] == 40
    assert taken["b"] == sum(1 for i in range(0, 100, 4) if got.get(i) != "a")
    assert taken["c"] == 5
    assert sampling.layers(spark.range(0), "id", pools, {"a": 1, "b": 1, "c": 1}).count() == 0
