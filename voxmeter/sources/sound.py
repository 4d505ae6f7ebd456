"""Sound files: lengths by ranged reads of their headers, and pools of noise files."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxmeter.functions.hashing import unit_hash
from voxmeter.sources.readers import listing
from voxmeter.sources.session import prepare


def opened(path: str) -> pa.NativeFile:
    """A file by the path that Spark lists, for reading at any place: local ones, and stores that pyarrow knows (s3, gs, hdfs ...)."""
    scheme, _, rest = path.partition(":")
    if scheme == "file" or not _:
        return fs.LocalFileSystem().open_input_file("/" + (rest if _ else path).lstrip("/"))
    store, name = fs.FileSystem.from_uri(scheme + ":" + quote(rest))
    return store.open_input_file(name)


def wav_shape(f: pa.NativeFile, size: int) -> tuple[int, int]:
    """Frames and rate of a WAV file, from chunk to chunk: only chunk heads, the format and 64-bit sizes are read, never samples."""
    head = f.read_at(12, 0)
    if head[:4] not in (b"RIFF", b"RF64") or head[8:12] != b"WAVE":
        return 0, 0
    at, rate, width, long = 12, 0, 0, 0
    while at + 8 <= size:
        head = f.read_at(8, at)
        name, length = head[:4], int.from_bytes(head[4:8], "little")
        if name == b"ds64":
            long = int.from_bytes(f.read_at(16, at + 8)[8:16], "little")
        elif name == b"fmt ":
            told = f.read_at(16, at + 8)
            rate, width = int.from_bytes(told[4:8], "little"), int.from_bytes(told[12:14], "little")
        elif name == b"data":
            length = long if length == 0xFFFFFFFF and long else length
            return (length // width, rate) if rate and width else (0, 0)
        at += 8 + length + length % 2
    return 0, 0


def _headers(batches: Iterator[pa.RecordBatch], failed: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seconds = []
        for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                with opened(path) as f:
                    frames, rate = wav_shape(f, size)
                seconds.append(frames / rate if rate else failed)
            except OSError:
                seconds.append(failed)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(seconds, pa.float64())], names=["path", "seconds"])


def wav_seconds(spark: SparkSession, path: str, failed: float = 0.0) -> DataFrame:
    """path, seconds of the sound files under a path, by their headers; `failed` (0, or -1) for what can't be read.

    Files are listed by Spark without their contents; a task reads some bytes at each chunk of a file, wherever the samples begin.
    """
    files = listing(prepare(spark), path).repartition("path")
    return files.mapInArrow(functools.partial(_headers, failed=failed), "path string, seconds double")


def pool(files: DataFrame, kind: Column, most: int, seed: int = 0, path: str = "path") -> DataFrame:
    """kind, path, place (from 1): at most `most` files of each kind, the same in every run (smallest hash of path and seed first).

    The hash orders a kind, and a first cut in each of 64 parts of it leaves at most 64 * most rows of a kind to one window.
    """
    told = files.select(kind.alias("kind"), F.col(path).alias("path")).where("kind is not null").withColumn("_u", unit_hash(F.col("path"), seed=seed))
    part = F.pmod(F.xxhash64("path"), F.lit(64))
    some = told.withColumn("_r", F.row_number().over(Window.partitionBy("kind", part).orderBy("_u", "path"))).where(F.col("_r") <= most)
    place = F.row_number().over(Window.partitionBy("kind").orderBy("_u", "path"))
    return some.withColumn("place", place).where(F.col("place") <= most).select("kind", "path", "place")


def noise_pool(spark: SparkSession, root: str, most: int, seed: int = 0) -> DataFrame:
    """kind, path, place of a noise collection `root/kind/...wav`: the kind is the folder right under the root."""
    kind = F.regexp_extract("path", "^.*?" + _quoted(root.rstrip("/")) + "/+([^/]+)/.+$", 1)
    return pool(listing(spark, root), F.nullif(kind, F.lit("")), most, seed)


def _quoted(text: str) -> str:
    return "\\Q" + text.split("://")[-1].removeprefix("file:") + "\\E"
