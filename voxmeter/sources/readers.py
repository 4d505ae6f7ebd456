"""Readers of manifests, results, transcripts, annotations and sound headers. All rows come from Spark's own sources."""

from __future__ import annotations

import codecs
import csv
import functools
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxmeter.sources.session import prepare


def json_rows(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A JSON array, or a document whose rows or results hold one: a row for each item."""
    reader = spark.read.option("multiLine", True)
    df = reader.json(path) if schema is None else reader.schema(schema).json(path)
    for name in ("rows", "results"):
        if name in df.columns and isinstance(df.schema[name].dataType, T.ArrayType):
            return df.select(F.explode(name).alias("_r")).select("_r.*")
    return df


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """A row for each line that isn't blank; strict: a line that isn't an object of the schema raises with its file and number."""
    if strict:
        from voxmeter.sources.lines import json_objects

        return json_objects(spark, path, schema)
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def json_lookup(spark: SparkSession, path: str) -> DataFrame:
    """key, value of each entry of a flat JSON object."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>")))


#: Bytes of a file that its header may take, and different headers that one table may have.
HEADER_BYTES, MOST_HEADERS = 1 << 16, 1000


def _header(batches: Iterator[pa.RecordBatch], encoding: str) -> Iterator[pa.RecordBatch]:
    """Paths -> the names in each file's first record, from its first bytes alone."""
    from voxmeter.sources.sound import opened

    for batch in batches:
        names = []
        for path in batch.column(0).to_pylist():
            with opened(path) as f:
                text = codecs.getincrementaldecoder(encoding)("replace").decode(f.read(HEADER_BYTES))
            names.append(next(csv.reader(io.StringIO(text.lstrip("\ufeff"), newline="")), []))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.list_(pa.string()))], names=["path", "names"])


def csv_rows(spark: SparkSession, path: str, encoding: str = "UTF-8", pattern: str = "*.csv") -> DataFrame:
    """CSV files, each with its own header; a byte order mark before the first name goes. Columns that a file lacks are null.

    Any encoding that Java knows, such as gb18030: Spark's reader decodes and splits a file as a stream, so quoted cells may
    hold commas, quotes (doubled) and line breaks, and a file may be larger than memory. Only the headers' distinct forms come
    to the driver; files of one form are one scan.
    """
    prepare(spark)
    # Spark refuses most charsets unless this is set.
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path")
    told = files.mapInArrow(functools.partial(_header, encoding=encoding), "path string, names array<string>")
    forms = told.groupBy("names").agg(F.collect_list("path").alias("paths")).limit(MOST_HEADERS + 1).collect()
    if len(forms) > MOST_HEADERS:
        raise ValueError(f"more than {MOST_HEADERS} different headers")
    reader = spark.read.option("header", True).option("multiLine", True).option("encoding", encoding).option("quote", '"').option("escape", '"')
    tables = [reader.schema(T.StructType([T.StructField(n, T.StringType()) for n in f["names"]])).csv(f["paths"]) for f in sorted(forms, key=lambda f: f["names"])]
    if not tables:
        raise ValueError(f"no files: {path}")
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """utt, text of lines `utt words ...`; blanks of the text go, and lines without a text."""
    parts = spark.read.text(path).select(F.regexp_extract("value", r"^\s*(\S+)\s+(.*)$", 1).alias("utt"), F.regexp_replace(F.regexp_extract("value", r"^\s*(\S+)\s+(.*)$", 2), r"\s", "").alias("text"))
    return parts.where("utt <> '' and text <> ''")


def phrases(spark: SparkSession, path: str) -> DataFrame:
    """place, phrase of a JSON array or of lines (those with # are comments): trimmed, without blanks, the first of equal ones."""
    text = spark.read.text(path, wholetext=True)
    listed = F.coalesce(F.from_json("value", "array<string>"), F.filter(F.split("value", "\r?\n"), lambda x: ~F.trim(x).startswith("#")))
    rows = text.select(F.posexplode(listed).alias("place", "phrase")).select("place", F.trim("phrase").alias("phrase")).where("phrase <> ''")
    return rows.groupBy("phrase").agg(F.min("place").alias("place")).select("place", "phrase")


def listing(spark: SparkSession, path: str, pattern: str = "*.wav") -> DataFrame:
    """path, length of files at any depth, contents unread; Spark lists no empty files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "length")


def utt_id(path: Column) -> Column:
    """The base name without its ending."""
    return F.regexp_extract(path, r"([^/\\]+?)(?:\.[^.]*)?$", 1)


def strip_run(utt: Column) -> Column:
    """Without the prefix uttNNNN_ of a run."""
    return F.regexp_replace(utt, r"^utt\d+_", "")


def runs(spark: SparkSession, glob: str) -> DataFrame:
    """Rows of all files that match, with run_id (the file's name) and dim (its first part); unreadable files are skipped."""
    df = spark.read.option("multiLine", True).option("ignoreCorruptFiles", True).json(glob)
    run = utt_id(F.col("_metadata.file_name"))
    return df.select("*", run.alias("run_id"), F.split(run, "_")[0].alias("dim"))


def vectors(df: DataFrame, col: str, dim: int) -> DataFrame:
    """The rows, or an error in the job that meets a vector of another length or with a component that isn't finite."""
    good = F.col(col).isNotNull() & (F.size(col) == dim) & F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return df.withColumn(col, F.when(good, F.col(col)).otherwise(F.raise_error(F.lit(f"{col}: not a finite vector of {dim}"))))


def speaker_blocks(text: Column) -> Column:
    """array<struct<spk, text>> of blocks `[speaker] words`; marks `<|...|>` and white space go."""
    spk = F.regexp_extract_all(text, F.lit(r"\[([^\]]+)\]([^\[]*)"), F.lit(1))
    said = F.transform(F.regexp_extract_all(text, F.lit(r"\[([^\]]+)\]([^\[]*)"), F.lit(2)), lambda x: F.regexp_replace(x, r"<\|[^|]*\|>|\s", ""))
    return F.arrays_zip(spk.alias("spk"), said.alias("text"))


def first_of(df: DataFrame, names: list[str]) -> Column:
    """The first value that isn't null among the columns that exist; an error if none does."""
    held = [F.col(n) for n in names if n in df.columns]
    if not held:
        raise ValueError(f"none of {names} is a column")
    return F.coalesce(*held)


# The names that recordings' manifests give their columns, and those used here.
MANIFEST_NAMES = {"唤醒音频": "enrollment", "识别音频": "recognition", "识别文本": "ref", "唤醒文本": "kws_txt"}


def renamed(df: DataFrame, names: dict[str, str] | None = None, required: tuple[str, ...] = ("enrollment", "recognition")) -> DataFrame:
    """Manifest columns under the names used here; others stay. A column that is required and missing raises, one that isn't is null."""
    names = names or MANIFEST_NAMES
    held = {old: new for old, new in names.items() if old in df.columns}
    missing = [new for new in names.values() if new not in held.values() and new not in df.columns]
    if bad := [m for m in missing if m in required]:
        raise ValueError(f"columns are missing: {bad}")
    return df.withColumnsRenamed(held).withColumns({m: F.lit(None).cast("string") for m in missing})


def paired_texts(spark: SparkSession, hyp_dir: str, ref_dir: str, pattern: str = "*.txt") -> DataFrame:
    """utt, hyp, ref of two folders' text files by base name; a file that the first lacks is an empty hyp."""
    told = lambda d, c: spark.read.option("pathGlobFilter", pattern).text(d, wholetext=True).select(utt_id(F.col("_metadata.file_path")).alias("utt"), F.trim("value").alias(c))
    return told(ref_dir, "ref").join(told(hyp_dir, "hyp"), "utt", "left").select("utt", F.coalesce("hyp", F.lit("")).alias("hyp"), "ref")
