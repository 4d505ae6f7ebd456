"""Evaluation relations over the given tables: each is a projection of a whole table, the same text for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmeter.functions.errors import errors, units
from voxmeter.sources.session import prepare

#: Utterances: the parts' names as references, with two systems' hypotheses, similarities and groups.
UTT = [
    "p_partkey AS uid",
    "p_name AS ref",
    "CASE p_partkey % 5 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name, 'e', '') WHEN 2 THEN concat(p_name, ', ') WHEN 3 THEN concat(p_name, ' ', lower(p_type)) ELSE '' END AS hyp",
    "CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN replace(replace(p_name, 'i', 'y'), 'r', 'l') WHEN 2 THEN lower(p_type) ELSE concat(p_name, '.') END AS hyp_b",
    "CAST((p_partkey * 37) % 101 AS DOUBLE) / 101 AS sim",
    "CAST((p_partkey * 53 + p_size) % 97 AS DOUBLE) / 97 AS sim_b",
    "p_size % 3 = 0 AS negative",
    "CASE WHEN p_size % 5 < 3 THEN 'accept' ELSE 'reject' END AS verdict",
    "p_type AS noise",
    "p_brand AS spk",
    "p_size % 4 AS overlap",
    "CAST(p_size AS DOUBLE) / 2 AS audio_sec",
    "p_retailprice / 1000 AS wall_sec",
]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With errors and units of both systems (err, err_b, n) and their rates (cer, cer_b)."""
    from voxmeter.functions.errors import rate

    rows = read(spark, sf_dir, "part").selectExpr(*UTT)
    ref = F.col("ref")
    rows = rows.withColumns({"err": errors(F.col("hyp"), ref, ascii_only=True), "err_b": errors(F.col("hyp_b"), ref, ascii_only=True), "n": units(ref, ascii_only=True)})
    return rows.withColumns({"cer": rate(F.col("err"), F.col("n")), "cer_b": rate(F.col("err_b"), F.col("n"))})


UTT_SQL = f"""utt0 AS (SELECT {", ".join(UTT)} FROM part),
utt1 AS (SELECT *, regexp_replace(lower(ref), '[\\p{{P}}\\s]', '', 'g') AS nr, regexp_replace(lower(hyp), '[\\p{{P}}\\s]', '', 'g') AS nh, regexp_replace(lower(hyp_b), '[\\p{{P}}\\s]', '', 'g') AS nb FROM utt0),
utt2 AS (SELECT *, levenshtein(nr, nh)::BIGINT AS err, levenshtein(nr, nb)::BIGINT AS err_b, length(nr)::BIGINT AS n FROM utt1),
utt AS (SELECT *, CASE WHEN n > 0 THEN err / n WHEN err > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS cer, CASE WHEN n > 0 THEN err_b / n WHEN err_b > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS cer_b FROM utt2)"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec, spk, seg, start, end: each event from its time for value seconds, in whole microseconds of seconds."""
    e = read(spark, sf_dir, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(F.col("user_id").alias("rec"), F.col("event_type").alias("spk"), F.col("event_id").alias("seg"), at.alias("start"), (at + F.bround(F.col("value") * 1000000, 0).cast("long")).alias("end"))


SEG_SQL = """seg AS (SELECT user_id AS rec, event_type AS spk, event_id AS seg, epoch_us(ts) AS s, epoch_us(ts) + round_even(value * 1000000, 0)::BIGINT AS e FROM events)"""


def weight_sql(key: str, replicate: str, seed: int = 42) -> str:
    """SQL of a Poisson(1) count by MD5, as stats.poisson_weights gives it."""
    bounds, total, p = [], 0.0, 0.36787944117144233
    for k in range(8):
        total += p
        bounds.append(total)
        p /= k + 1
    u = f"(('0x' || substr(md5(concat_ws('|', {key}, {replicate}, '{seed}')), 1, 8))::BIGINT / 4294967296.0)"
    return "(" + " + ".join(f"({u} >= {b!r})::INT" for b in bounds) + ")"
