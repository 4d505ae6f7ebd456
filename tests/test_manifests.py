"""Manifests, documents in parts, nine quality signals, slices, caches by content, batches, paired folders."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxmeter.functions import errors, signal
from voxmeter.operators import joins, protocol
from voxmeter.sources import readers, sinks


def test_names_and_modes(spark):
    df = spark.createDataFrame([(1, "a.wav", "b.wav", "打开")], "id int, `唤醒音频` string, `识别音频` string, `识别文本` string")
    assert readers.renamed(df).first().asDict() == {"id": 1, "enrollment": "a.wav", "recognition": "b.wav", "ref": "打开", "kws_txt": None}
    with pytest.raises(ValueError, match="recognition"):
        readers.renamed(df.drop("识别音频"))
    refs = spark.createDataFrame([("",), (None,), ("x",)], "ref string")
    assert [sinks.mode_of(d, "ref").first()["mode"] for d in (refs, refs.where("ref = ''"), refs.where("false"))] == ["pos", "neg", "neg"]


def test_documents_in_parts(spark, tmp_path):
    rows = [(i, f"名 {i}", None if i % 2 else i / 2) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, name string, v double").repartition(7)
    for n, name in ((500, "a"), (1, "b"), (0, "c")):
        sinks.document_parts(df.where(f"id < {n}"), "id", str(tmp_path / name), task="t")
        told = json.loads("".join(p.read_text() for p in sorted((tmp_path / name).glob("part-*"))))
        assert (told["task"], told["n"]) == ("t", n) and [tuple(r.values()) for r in told["results"]] == rows[:n]


def test_quality_signals(spark):
    t = np.arange(16000) / 16000
    rng = np.random.default_rng(1)
    held = {"tone": 0.5 * np.sin(2 * np.pi * 1000 * t), "high": 0.5 * np.sin(2 * np.pi * 6000 * t), "hiss": 0.1 * rng.standard_normal(16000), "loud": np.clip(3 * np.sin(2 * np.pi * 50 * t), -1, 1), "gaps": np.where(t % 0.5 < 0.2, 0.0, np.sin(2 * np.pi * 440 * t)), "short": np.ones(63), "brief": np.sin(np.arange(100))}
    df = spark.createDataFrame([(k, [float(v) for v in x]) for k, x in held.items()], "k string, x array<double>")
    got = {r["k"]: r["q"] for r in df.select("k", signal.quality(F.col("x")).alias("q")).collect()}
    assert got["short"] == (None,) * 9 and None not in got["brief"]
    assert got["tone"]["rms"] == pytest.approx(0.5 / 2**0.5, rel=1e-3) and got["tone"]["peak"] == pytest.approx(0.5)
    assert got["tone"]["spectral_centroid"] == pytest.approx(1000, rel=0.01) and got["high"]["high_freq_ratio"] > 0.99 > 0.01 > got["tone"]["high_freq_ratio"]
    assert got["tone"]["zero_crossing_rate"] == pytest.approx(1000, rel=0.1)
    assert got["hiss"]["spectral_flatness"] > 0.4 > 0.01 > got["tone"]["spectral_flatness"]
    assert got["loud"]["clipping_rate"] > 0.7 and got["gaps"]["silence_ratio"] > 0.2 and got["gaps"]["snr_est"] > 1e6


def test_slices_fall_back_to_the_whole(spark):
    x = F.array(*[F.lit(i) for i in range(100)])
    seg = lambda *ab: F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ab])
    r = spark.range(1).select(signal.target_slice(x, seg((2.0, 2.5), (0.0, 0.31)), 10).alias("a"), signal.target_slice(x, seg((9.8, 20.0)), 10).alias("b"), signal.target_slice(x, F.lit(None).cast("array<struct<start:double,end:double>>"), 10).alias("c")).first()
    assert r["a"] == [0, 1, 2, 20, 21, 22, 23, 24] and r["b"] == list(range(100)) == r["c"]


def test_caches_by_content(spark):
    man = spark.createDataFrame([(1, "x", None), (2, "y", "z"), (3, "x", None), (4, None, None)], "id int, a string, b string")
    cache = man.where("id = 1").select(joins.content_key("a", "b").alias("key"), F.lit(7).alias("v"))
    got = joins.with_cached(man, cache, ["a", "b"], "v")
    assert sorted((r["id"], r["hit"], r["v"]) for r in got.collect()) == [(1, True, 7), (2, False, None), (3, True, 7), (4, False, None)]
    assert joins.misses(got, ["a", "b"]).count() == 2


def test_short_batches(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    sizes = lambda **a: sorted(r["count"] for r in protocol.batches(df, "k", 32, **a).groupBy("batch").count().collect())
    assert sizes() == [32] * 3 and sizes(short="keep") == [4, 32, 32, 32]
    with pytest.raises(ValueError, match="100 rows"):
        protocol.batches(df, "k", 32, short="error")
    assert protocol.batches(df, "k", 25, short="error").count() == 100


def test_paired_folders(spark, tmp_path):
    for d, held in (("ref", {"a": "打开空调", "b": "关灯", "c": ""}), ("hyp", {"a": "打开空调", "b": "开灯了", "z": "x"})):
        (tmp_path / d).mkdir()
        for n, t in held.items():
            (tmp_path / d / f"{n}.txt").write_text(t)
    told = errors.batch_rates(readers.paired_texts(spark, str(tmp_path / "hyp"), str(tmp_path / "ref")).where("utt <> 'c'"))
    assert sorted((r["utt"], r["cer"], r["mean"]) for r in told.collect()) == [("a", 0.0, 0.5), ("b", 1.0, 0.5)]
