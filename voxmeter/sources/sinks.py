"""Sinks: documents, lines, tables and submissions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str) -> None:
    """One object a line, names in order; refuses a path that is there."""
    df.select(*sorted(df.columns)).write.mode("errorifexists").json(path)


def csv_table(df: DataFrame, path: str, mark: bool = False) -> None:
    """CSV with a header; with mark, each file begins with a byte order mark (spreadsheets then read it as UTF-8)."""
    if mark:
        df = df.withColumnsRenamed({df.columns[0]: "\ufeff" + df.columns[0]})
    df.write.mode("errorifexists").option("header", True).option("quoteAll", False).csv(path)


def document(df: DataFrame, order: str, **head: object) -> DataFrame:
    """One row, value: a JSON document with `head` and the rows as results. For reports: the rows must fit one row."""
    rows = F.array_sort(F.collect_list(F.struct(order, *[c for c in df.columns if c != order])))
    told = df.agg(rows.alias("results"))
    return told.select(F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in head.items()], F.size("results").alias("n"), "results"), {"pretty": "true"}).alias("value"))


def document_parts(df: DataFrame, order: str, path: str, **head: object) -> None:
    """A JSON document of any size in part files: joined in the order of their names they are one document with `head`, n and
    the rows, one a line, as results. Rows are dealt by ranges of `order` (a key of its own for each row), and no task holds all."""
    import json

    first = df.agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).first()
    rows = df.select(F.col(order).alias("_o"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("_row")).repartitionByRange(F.col("_o"))
    line = F.concat(F.when(F.col("_o") == F.lit(first["first"]), "  ").otherwise("  ,"), F.col("_row"))
    opening = json.dumps({**head, "n": first["n"]}, ensure_ascii=False)[:-1] + ', "results": [\n'
    ends = df.sparkSession.createDataFrame([(0, opening.rstrip("\n")), (2, "]}")], "side int, value string")
    sides = [ends.where("side = 0").select("value").coalesce(1), rows.sortWithinPartitions("_o").select(line.alias("value")), ends.where("side = 2").select("value").coalesce(1)]
    # A union keeps its sides' partitions in order, and part files are numbered by partition.
    sides[0].unionByName(sides[1]).unionByName(sides[2]).write.mode("errorifexists").text(path)


def mode_of(df: DataFrame, ref: str) -> DataFrame:
    """mode: pos if any row has a reference that isn't empty, else neg."""
    return df.agg(F.when(F.coalesce(F.bool_or(F.coalesce(F.col(ref), F.lit("")) != ""), F.lit(False)), "pos").otherwise("neg").alias("mode"))


def submission(results: DataFrame, manifest: DataFrame) -> DataFrame:
    """id, label, text, cer of scored results: cer is '' for negatives, 1.0 for rejected positives."""
    from voxmeter.functions.errors import errors, rate, units

    both = manifest.join(results, "id", "left")
    low = F.coalesce(F.col("rejected"), F.lit(True))
    negative = F.coalesce(F.col("ref"), F.lit("")) == ""
    cer = rate(errors(F.col("text"), F.col("ref")), units(F.col("ref")))
    return both.select("id", F.when(low, "reject").otherwise("accept").alias("label"), F.when(low, "").otherwise(F.coalesce("text", F.lit(""))).alias("text"), F.when(negative, "").when(low, "1.0").otherwise(cer.cast("string")).alias("cer"))


def submission_summary(submitted: DataFrame, manifest: DataFrame, given: float | None = None, wall: float | None = None, infer: float | None = None) -> DataFrame:
    """final_cer, avg_rr, duration of a submission (see submission()), in one pass.

    final_cer pools errors over positives, rejected ones in full, to 3 places (0 without positives); avg_rr is the share of
    negatives rejected, to 4 places (null without negatives). The duration is the first there is of the one given, the timed
    wall clock, the timed inference, and the sum of the rows' own infer_sec (manifest).
    """
    from voxmeter.functions.errors import errors, pooled, units

    both = manifest.join(submitted.select("id", "label", "text"), "id")
    negative = F.coalesce(F.col("ref"), F.lit("")) == ""
    err, n = errors(F.col("text"), F.col("ref")), units(F.col("ref"))
    told = next((x for x in (given, wall or None, infer or None) if x is not None), None)
    seconds = F.coalesce(F.sum("infer_sec"), F.lit(0.0)) if told is None else F.lit(float(told))
    return both.agg(
        F.round(pooled(F.when(~negative, err), F.when(~negative, n)), 3).alias("final_cer"),
        F.round(F.avg(F.when(negative, (F.col("label") == "reject").cast("double"))), 4).alias("avg_rr"), F.round(seconds, 3).alias("duration"))


def merge(pos: DataFrame, neg: DataFrame) -> DataFrame:
    """Two submissions as one, ids with their side before them."""
    side = lambda df, p: df.withColumn("id", F.concat(F.lit(p), F.col("id").cast("string")))
    return side(pos, "pos_").unionByName(side(neg, "neg_"))
