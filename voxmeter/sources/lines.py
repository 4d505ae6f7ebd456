"""Lines with their numbers, across the splits of large files, and JSON lines that say where they are broken."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from voxmeter.sources.session import prepare


def _in_split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of splits (file, begin, marked, value) -> marked ones with their number in the split; the split's count as a row too."""
    now, seen = None, 0
    names = ["file", "begin", "at", "value", "count"]

    def total() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.string()), pa.array([now[1]], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.string()), pa.array([seen], pa.int64())], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        file, begin = batch.column(0), batch.column(1).to_numpy()
        coded = file.dictionary_encode().indices.to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], (coded[1:] != coded[:-1]) | (begin[1:] != begin[:-1]))))
        for a, b in zip(starts, np.append(starts[1:], batch.num_rows), strict=True):
            key = (file[int(a)].as_py(), int(begin[a]))
            if key != now:
                if now is not None:
                    yield total()
                now, seen = key, 0
            some = np.flatnonzero(np.asarray(batch.column(2).slice(a, b - a).to_numpy(zero_copy_only=False)))
            if len(some):
                part = batch.take(pa.array(some + a))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(some + seen), part.column(3), pa.array([None] * len(some), pa.int64())], names=names)
            seen += b - a
    if now is not None:
        yield total()


def numbered(spark: SparkSession, path: str, marked: F.Column | None = None) -> DataFrame:
    """file, line (from 1), value of the text lines under a path; with `marked`, of those lines alone.

    A file's splits are counted where they are read; only their counts are added up, and no line is shuffled. Spark's reader
    gives a split's lines in order, and each split by its first byte.
    """
    text = prepare(spark).read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), "value")
    marked = F.lit(True) if marked is None else F.coalesce(marked, F.lit(False))
    told = text.select("file", "begin", marked.alias("marked"), "value").mapInArrow(_in_split, "file string, begin long, at long, value string, count long")
    counts = told.where("count is not null").select("file", "begin", "count")
    by = Window.partitionBy("file").orderBy("begin")
    before = counts.select("file", "begin", (F.sum("count").over(by) - F.col("count")).alias("before"))
    return told.where("at is not null").join(before, ["file", "begin"]).select("file", (F.col("before") + F.col("at") + 1).alias("line"), "value")


def bad_json(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """file, line, value, why of each line that isn't blank and isn't a JSON object of the schema: no JSON, or no object."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    value = F.col("value")
    broken = "_broken"
    while broken in kind.fieldNames():
        broken += "_"
    held = F.from_json(value, T.StructType([*kind.fields, T.StructField(broken, T.StringType())]), {"columnNameOfCorruptRecord": broken})
    blank = F.trim(F.regexp_replace(value, r"\s", "")) == ""
    object_ = F.regexp_replace(value, r"^\s+", "").startswith("{")
    bad = ~blank & (~object_ | held.isNull() | held[broken].isNotNull())
    return numbered(spark, path, bad).select("file", "line", "value", F.when(~object_, "not an object").otherwise("invalid").alias("why"))


def json_objects(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The rows of a file of JSON lines, blank ones skipped; a broken line raises with its file and number, no row at all too."""
    first = bad_json(spark, path, schema).orderBy("file", "line").limit(1).collect()
    if first:
        raise ValueError(f"JSONL line {first[0]['why']} at {first[0]['file']}:{first[0]['line']}")
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if rows.isEmpty():
        raise ValueError(f"empty manifest: {path}")
    return rows
