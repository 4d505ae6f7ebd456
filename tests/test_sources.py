"""Readers and sinks on small files."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from voxmeter.sources import readers, session, sinks, sound


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_json(spark, tmp_path):
    for name, held in (("a", [{"id": 1}, {"id": 2}]), ("b", {"n": 2, "rows": [{"id": 1}, {"id": 2}]}), ("c", {"results": [{"id": 1}, {"id": 2}]})):
        (tmp_path / f"{name}.json").write_text(json.dumps(held))
        assert rows(readers.json_rows(spark, str(tmp_path / f"{name}.json")).select("id"), "id") == [(1,), (2,)]
    (tmp_path / "m.json").write_text(json.dumps({"u1": "x", "u2": "y"}))
    assert rows(readers.json_lookup(spark, str(tmp_path / "m.json")), "key") == [("u1", "x"), ("u2", "y")]
    (tmp_path / "l.jsonl").write_text('{"id": 1}\n\n{"id": 2}\n')
    assert readers.json_lines(spark, str(tmp_path / "l.jsonl"), "id int", True).count() == 2
    (tmp_path / "bad.jsonl").write_text('{"id": 1}\nnot json\n')
    with pytest.raises(Exception, match=r"bad\.jsonl:2"):
        readers.json_lines(spark, str(tmp_path / "bad.jsonl"), "id int", True).collect()
    for run in ("A_1", "A_2", "B_1"):
        (tmp_path / f"{run}.json").write_text(json.dumps([{"u": 1}]))
    assert rows(readers.runs(spark, str(tmp_path / "[AB]_*.json")).select("run_id", "dim"), "run_id") == [("A_1", "A"), ("A_2", "A"), ("B_1", "B")]


def test_text_files(spark, tmp_path):
    (tmp_path / "t.txt").write_text("u1 打 开 空调\nu2\n\nu3  关 灯\n")
    assert rows(readers.transcripts(spark, str(tmp_path / "t.txt")), "utt") == [("u1", "打开空调"), ("u3", "关灯")]
    (tmp_path / "p.txt").write_text("# note\n a \nb\n\na\n")
    assert rows(readers.phrases(spark, str(tmp_path / "p.txt")).select("phrase"), "phrase") == [("a",), ("b",)]
    (tmp_path / "p.json").write_text('["x", " ", "y", "x"]')
    assert rows(readers.phrases(spark, str(tmp_path / "p.json")).select("phrase"), "phrase") == [("x",), ("y",)]
    (tmp_path / "c.csv").write_bytes("\ufeffuid,tag\n1,a;b\n".encode())
    assert readers.csv_rows(spark, str(tmp_path / "c.csv")).columns == ["uid", "tag"]
    (tmp_path / "g.csv").write_bytes("uid,tag\n1,灯\n".encode("gb18030"))
    assert rows(readers.csv_rows(spark, str(tmp_path / "g.csv"), "GB18030")) == [("1", "灯")]


def test_sound_headers(spark, tmp_path):
    (tmp_path / "d").mkdir()
    data = b"\0" * 32000
    head = b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 16000, 32000, 2, 16) + b"data" + struct.pack("<I", len(data))
    (tmp_path / "d" / "x.wav").write_bytes(head + data)
    (tmp_path / "d" / "y.wav").write_bytes(b"no sound")
    assert [r[1] for r in rows(sound.wav_seconds(spark, str(tmp_path)), "path")] == [1.0, 0.0]
    assert readers.listing(spark, str(tmp_path)).count() == 2


def test_names_and_vectors(spark):
    df = spark.createDataFrame([("E:/x\\y/utt0012_cmd_3.wav", "b", None)], "p string, b string, a string")
    assert rows(df.select(readers.strip_run(readers.utt_id(F.col("p"))), readers.first_of(df, ["z", "a", "b"]))) == [("cmd_3", "b")]
    got = spark.range(1).select(readers.speaker_blocks(F.lit("[s1] <|zh|>打 开 [s2]关")).alias("x")).first()[0]
    assert [tuple(x) for x in got] == [("s1", "打开"), ("s2", "关")]
    v = spark.createDataFrame([([1.0, float("nan")],)], "v array<double>")
    with pytest.raises(Exception, match="finite vector"):
        readers.vectors(v, "v", 2).collect()


def test_sinks(spark, tmp_path):
    man = spark.createDataFrame([(1, "打开"), (2, None), (3, "关灯")], "id int, ref string")
    res = spark.createDataFrame([(1, "打开", False), (2, "x", False), (3, "", True)], "id int, text string, rejected boolean")
    assert rows(sinks.submission(res, man), "id") == [(1, "accept", "打开", "0.0"), (2, "accept", "x", ""), (3, "reject", "", "1.0")]
    assert rows(sinks.merge(man.select("id"), man.select("id")), "id")[0] == ("neg_1",)
    doc = json.loads(sinks.document(res, "id", task="t").first()[0])
    assert (doc["task"], doc["n"], [r["id"] for r in doc["results"]]) == ("t", 3, [1, 2, 3])
    sinks.json_lines(man, str(tmp_path / "o"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        sinks.json_lines(man, str(tmp_path / "o"))
    sinks.csv_table(man, str(tmp_path / "t"))


def test_submission_summary_and_marked_tables(spark, tmp_path):
    man = spark.createDataFrame([(1, "打开", 1.5), (2, "", 0.5), (3, "关灯", 1.0), (4, None, 2.0)], "id int, ref string, infer_sec double")
    sub = spark.createDataFrame([(1, "accept", "打开"), (2, "accept", "x"), (3, "reject", ""), (4, "reject", "")], "id int, label string, text string")
    assert rows(sinks.submission_summary(sub, man)) == [(0.5, 0.5, 5.0)]
    assert rows(sinks.submission_summary(sub, man, wall=9.0, infer=3.0)) == [(0.5, 0.5, 9.0)]
    assert rows(sinks.submission_summary(sub, man, given=1.0, wall=9.0)) == [(0.5, 0.5, 1.0)]
    assert rows(sinks.submission_summary(sub, man, wall=0.0, infer=3.0))[0][2] == 3.0
    assert rows(sinks.submission_summary(sub.where("id = 1"), man)) == [(0.0, None, 1.5)]
    sinks.csv_table(man.coalesce(1), str(tmp_path / "m"), mark=True)
    (part,) = (tmp_path / "m").glob("part-*")
    assert part.read_bytes().startswith(b"\xef\xbb\xbfid,ref")


def test_arrow_batches_get_a_smaller_bound_unless_the_session_set_one(spark):
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    session.prepare(spark)
    assert spark.conf.get(bound) == session.ARROW_BYTES
    sizes = spark.range(400).selectExpr("repeat('x', 100000) as t").coalesce(1).mapInPandas(lambda it: (x.assign(n=x.t.str.len().sum())[["n"]][:1] for x in it), "n long")
    assert max(r.n for r in sizes.collect()) < 8 << 20
    spark.conf.set(bound, "1m")
    try:
        assert session.prepare(spark).conf.get(bound) == "1m"
    finally:
        spark.conf.set(bound, session.ARROW_BYTES)
