"""PDF text, numbered lines, CSV of any encoding, sound headers by ranged reads, and pools of noise files."""

import json
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from voxmeter.sources import lines, pdf, readers, sound


def pdf_file(contents, deflate=True, length=True):
    out = b"%PDF-1.4\n"
    for i, c in enumerate(contents, 1):
        body = zlib.compress(c) if deflate else c
        out += b"%d 0 obj\n<< %s%s >>\nstream\n%s\nendstream\nendobj\n" % (i, b"/Length %d" % len(body) if length else b"/Length 99 0 R", b" /Filter /FlateDecode" if deflate else b"", body)
    return out + b"trailer\n%%EOF\n"


def test_text_operators():
    shown = pdf.shown
    assert shown(b"BT /F1 12 Tf (Hello) Tj 10 0 Td [(W) -20 (or) 3 (ld)] TJ ET") == ["Hello", "W", "or", "ld"]
    assert shown(rb"(a\(b\)c (nested (deep)) \\ \101\n) Tj (next line) ' 1 2 (spaced) " + b'"') == ["a(b)c (nested (deep)) \\ A\n", "next line", "spaced"]
    assert shown(b"<48 65 6C6C 6F> Tj <7> Tj <FEFF6253> Tj") == ["Hello", "p", "打"]
    assert shown(b"% (comment) Tj\n(said) Tj (never shown) Td /Name (x) gs") == ["said"]
    assert shown(b"BI /W 1 ID \xff(\x00 Tj EI (after) Tj") == ["after"]
    assert shown(b"(open") == [] and shown(b"") == [] and shown(b"Tj TJ") == []


def test_streams_are_found_whatever_their_lengths_say(spark, tmp_path):
    one, two = b"BT (first endstream page) Tj ET", b"[(sec) (ond)] TJ"
    for deflate in (True, False):
        for length in (True, False):
            got = [x for s in pdf.streams(pdf_file([one, two], deflate, length)) for x in pdf.shown(s)]
            assert got[-2:] == ["sec", "ond"] and (not length or got[0] == "first endstream page")
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.pdf").write_bytes(pdf_file([one, two]))
    (tmp_path / "sub" / "b.pdf").write_bytes(b"1 0 obj << /Filter /FlateDecode >>\nstream\nbroken bytes\nendstream" + pdf_file([two]))
    (tmp_path / "sub" / "c.pdf").write_bytes(b"no pdf")
    (tmp_path / "d.txt").write_text("(x) Tj")
    got = {r["path"].rsplit("/", 1)[1]: r["text"] for r in pdf.pdf_text(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": "first endstream page sec ond", "b.pdf": "sec ond", "c.pdf": ""}
    assert [(r["place"], r["text"]) for r in pdf.pdf_pieces(spark, str(tmp_path / "a.pdf")).orderBy("place").collect()] == [(0, "first endstream page"), (1, "sec"), (2, "ond")]


def test_hostile_files_take_linear_time():
    import time

    began = time.time()
    pdf.shown(b"(" * 300_000)
    pdf.shown(b"[" * 300_000 + b"(a)" * 100_000)
    list(pdf.streams(b"stream\n" * 100_000))
    list(pdf.streams(b"obj stream\nx endstream " * 50_000))
    assert time.time() - began < 20


def test_numbers_of_lines_across_splits(spark, tmp_path):
    rng = random.Random(1)
    held = {n: [json.dumps({"id": i, "t": "x" * rng.randint(0, 60)}) if rng.random() < 0.9 else "" for i in range(3000)] for n in ("a.jsonl", "b.jsonl")}
    for n, v in held.items():
        (tmp_path / n).write_text("\n".join(v) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        got = {(r["file"].rsplit("/", 1)[1], r["line"]): r["value"] for r in lines.numbered(spark, str(tmp_path)).collect()}
        assert got == {(n, i): v for n, vs in held.items() for i, v in enumerate(vs, 1)}
        assert lines.json_objects(spark, str(tmp_path), "id int, t string").count() == sum(1 for vs in held.values() for v in vs if v)
        held["b.jsonl"][1777], held["b.jsonl"][2500] = '{"id": 1', "[1, 2]"
        (tmp_path / "b.jsonl").write_text("\n".join(held["b.jsonl"]) + "\n")
        bad = sorted((r["line"], r["why"]) for r in lines.bad_json(spark, str(tmp_path), "id int, t string").collect())
        assert bad == [(1778, "invalid"), (2501, "not an object")]
        with pytest.raises(ValueError, match=r"b\.jsonl:1778"):
            readers.json_lines(spark, str(tmp_path), "id int, t string", True)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "empty.jsonl").write_text("\n\n")
    with pytest.raises(ValueError, match="empty manifest"):
        readers.json_lines(spark, str(tmp_path / "empty.jsonl"), "id int", True)


@pytest.mark.parametrize("encoding", ["gb18030", "utf-8-sig", "utf-16", "big5"])
def test_csv_of_any_encoding(spark, tmp_path, encoding):
    (tmp_path / "a.csv").write_bytes('uid,難點,note\n1,"頭,中","他說\n""好"""\n2,㐀高,\n'.replace("㐀", "" if encoding == "big5" else "㐀").encode(encoding))
    (tmp_path / "b.csv").write_bytes('note,uid\r\n"x\r\ny",3\r\n'.encode(encoding))
    got = sorted(tuple(r) for r in readers.csv_rows(spark, str(tmp_path), {"utf-8-sig": "UTF-8"}.get(encoding, encoding)).select("uid", "難點", "note").collect())
    assert got == [("1", "頭,中", '他說\n"好"'), ("2", ("" if encoding == "big5" else "㐀") + "高", None), ("3", None, got[2][2])]
    assert got[2][2].split() == ["x", "y"]


def riff(frames, rate=16000, width=2, before=(), long=False, broken=False):
    data = b"\0" * (frames * width)
    chunks = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * width, width, 8 * width)
    chunks = (b"ds64" + struct.pack("<IQQQI", 28, 0, len(data), frames, 0) if long else b"") + chunks
    for name, size in before:
        chunks += name + struct.pack("<I", size) + b"\1" * (size + size % 2)
    chunks += b"data" + struct.pack("<I", 0xFFFFFFFF if long else len(data)) + data
    return (b"RF64" if long else b"RIFF") + struct.pack("<I", 4 + len(chunks)) + (b"WAVX" if broken else b"WAVE") + chunks


def test_sound_headers_by_ranged_reads(spark, tmp_path):
    (tmp_path / "deep dir").mkdir()
    files = {"a.wav": (riff(32000), 2.0), "b.wav": (riff(8000, before=[(b"LIST", 1_000_001), (b"junk", 7)]), 0.5), "c.wav": (riff(16000, long=True), 1.0), "d.wav": (riff(10, broken=True), -1.0), "e.wav": (b"RIFF", -1.0), "f.wav": (riff(24000)[:60], 1.5), "g 1%.wav": (riff(4800, rate=48000, width=4), 0.1)}
    for name, (data, _) in files.items():
        (tmp_path / "deep dir" / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[1]: r["seconds"] for r in sound.wav_seconds(spark, str(tmp_path), -1.0).collect()}
    assert got == {n: s for n, (_, s) in files.items()}
    read = []

    class Watched:
        def read_at(self, n, at):
            read.append(n)
            return files["b.wav"][0][at : at + n]

    assert sound.wav_shape(Watched(), len(files["b.wav"][0])) == (8000, 16000) and sum(read) < 200


def test_noise_pools(spark, tmp_path):
    for kind, n in (("noise/free", 30), ("music", 5), ("speech/x/y", 2)):
        (tmp_path / kind).mkdir(parents=True)
        for i in range(n):
            (tmp_path / kind / f"{i}.wav").write_bytes(b"x")
    got = sound.noise_pool(spark, str(tmp_path), 10, seed=3).collect()
    by = {k: sorted(r["place"] for r in got if r["kind"] == k) for k in ("noise", "music", "speech")}
    assert by == {"noise": list(range(1, 11)), "music": list(range(1, 6)), "speech": [1, 2]}
    assert {r["path"] for r in got} == {r["path"] for r in sound.noise_pool(spark, str(tmp_path), 10, seed=3).repartition(7).collect()}
    assert {r["path"] for r in got if r["kind"] == "noise"} != {r["path"] for r in sound.noise_pool(spark, str(tmp_path), 10, seed=4).where("kind = 'noise'").collect()}
    many = spark.range(5000).select(F.concat(F.lit("p"), "id").alias("path"))
    assert sound.pool(many, F.lit("one"), 7).count() == 7
