"""Goldens of the protocol operators."""

from pyspark.sql import functions as F

from voxmeter.operators import protocol


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_label_matrix(spark):
    mix = spark.createDataFrame([(1, ["a", "b"]), (2, ["c", "z"]), (3, [])], "m int, s array<string>")
    bank = spark.createDataFrame([("q1", "a"), ("q2", "b"), ("q3", "c"), ("q9", "a")], "q string, spk string")
    assert rows(protocol.label_matrix(mix, bank, "m", "s", "q", "spk"), "m") == [(1, ["q1", "q2"], 1), (2, ["q3"], 2), (3, [], 3)]


def test_groups_and_gates(spark):
    g = spark.createDataFrame([(1, True, 0.9), (1, True, 0.7), (1, False, 0.2), (2, True, 1.0)], "g int, p boolean, s double")
    out = rows(protocol.group_response(g, "g", "p", "s"))
    assert out[0][0] == 1
    assert abs(out[0][1] - 0.6) < 1e-12
    assert len(out) == 1
    m = spark.createDataFrame([("auc", 0.9), ("cer", 0.2)], "name string, value double")
    r = spark.createDataFrame([("auc", ">=", 0.8), ("cer", "<=", 0.1), ("rtf", "<=", 1.0)], "name string, op string, bound double")
    assert rows(protocol.gate(m, r)) == [(False, {"auc": True, "cer": False, "rtf": False})]


def test_rotation(spark):
    good = [(s, r, "ABC"[(i + r) % 3], 0) for r in range(3) for i, s in enumerate("xyz")]
    df = spark.createDataFrame(good, "spk string, rnd int, role string, grp int")
    assert rows(protocol.rotation_audit(df, "spk", "rnd", "role", "grp", 3)) == []
    assert len(rows(protocol.rotation_audit(df, "spk", "rnd", "role", "grp", 2))) == 3
    assert ("roles", "w") in rows(protocol.rotation_audit(df.unionByName(df.limit(1).withColumn("spk", F.lit("w"))), "spk", "rnd", "role", "grp", 9))


def test_corrections(spark):
    df, vocab = spark.createDataFrame([("打开空条",), ("空调",)], "t string"), spark.createDataFrame([("空调",), ("打开",)], "w string")
    assert rows(protocol.wildcard_matches(df, "t", vocab, "w", 2)) == [("打开空条", 2, "空条", "空调")]
    sounds = F.create_map(F.lit("条"), F.lit("tiao2"), F.lit("调"), F.lit("tiao2"), F.lit("水"), F.lit("shui3"))
    fix = lambda a, b: spark.range(1).select(protocol.substitutions_only(F.lit(a), F.lit(b), sounds)).first()[0]
    assert (fix("空条", "空调"), fix("空条", "空水"), fix("空条", "空调了")) == ("空调", "空条", "空条")
    texts = F.create_map(F.lit("a"), F.lit("开灯"), F.lit("b"), F.lit("打开空调"))
    for said, want in ((("accept", "reject"), ("开灯", "unique")), (("accept", "accept"), ("打开空调", "longest")), (("reject", "reject"), ("", "none"))):
        v = F.create_map(F.lit("a"), F.lit(said[0]), F.lit("b"), F.lit(said[1]))
        assert tuple(spark.range(1).select(protocol.pick_of_many(texts, v).alias("x")).first()[0]) == want


def test_kinds_batches_and_controls(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (2, "y"), (2, "y"), (2, "x")], "k int, c string")
    assert rows(protocol.dominant(df, "k", "c", ["y", "x"]), "k") == [(1, "y"), (2, "y")]
    b = protocol.batches(spark.range(1000), "id", 10, parts=4)
    assert {r[1] for r in rows(b.groupBy("batch").count())} == {10}
    assert b.select("id").distinct().count() == b.count() > 950
    p = rows(protocol.permuted(spark.createDataFrame([(1, "a", 0), (2, "b", 0), (3, "c", 0)], "k int, v string, g int"), "k", "v", "g"), "k")
    assert [r[1] for r in p] == ["b", "c", "a"]


def test_batches_leave_one_remainder_at_most(spark):
    from voxmeter.operators import protocol as operators

    out = operators.batches(spark.range(1000).withColumnRenamed("id", "k"), "k", 32).groupBy("batch").count().collect()
    assert sorted(r["batch"] for r in out) == list(range(31))
    assert {r["count"] for r in out} == {32}


def test_clusters_of_a_recording_of_any_size(spark, monkeypatch):
    from voxmeter.operators import intervals, linkage

    df = spark.createDataFrame([("a", [1.0, float(i)]) for i in range(5)], "rec string, v array<double>")
    assert intervals.clusters(df, "rec", "v", 0.5).first()["n"] == 5
    monkeypatch.setattr(linkage, "LARGE", 4)
    assert intervals.clusters(df, "rec", "v", 0.5).first()["n"] == 5
