"""Character error rates, each dialect by its own name. Errors and lengths are columns, so pooling is a plain sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmeter.functions.text import normalize, or_empty

#: Dialects: how both texts are prepared.
DIALECTS = {
    "official": lambda c, a: normalize(c, a),
    "legacy": lambda c, a: F.regexp_replace(F.lower(or_empty(c)), "[ \\n]", ""),
    "punct": lambda c, a: F.regexp_replace(F.lower(or_empty(c)), "[\\s,.!?;:'\"，。！？；：、“”‘’]", ""),
    "raw": lambda c, a: or_empty(c),
}


def errors(hyp: Column, ref: Column, dialect: str = "official", ascii_only: bool = False) -> Column:
    """Edit distance of the prepared texts."""
    prepare = DIALECTS[dialect]
    return F.levenshtein(prepare(ref, ascii_only), prepare(hyp, ascii_only)).cast("long")


def units(ref: Column, dialect: str = "official", ascii_only: bool = False) -> Column:
    """Characters of the prepared reference."""
    return F.length(DIALECTS[dialect](ref, ascii_only)).cast("long")


def rate(err: Column, n: Column) -> Column:
    """errors / units; of an empty reference 0 without errors, else 1. May exceed 1."""
    return F.when(n > 0, err / n).otherwise(F.when(err > 0, 1.0).otherwise(0.0))


def pooled(err: Column, n: Column) -> Column:
    """The aggregate: sum of errors over sum of units, by the same rule."""
    return rate(F.coalesce(F.sum(err), F.lit(0)), F.coalesce(F.sum(n), F.lit(0)))


def rejected_errors(err: Column, n: Column, rejected: Column) -> Column:
    """Errors of a row that may be rejected: all of its reference is then missing."""
    return F.when(rejected, n).otherwise(err)


def batch_rates(pairs: DataFrame, dialect: str = "official") -> DataFrame:
    """utt, cer, mean of paired texts (utt, hyp, ref): each row's rate, and the mean of all rows' rates beside it."""
    each = pairs.select("utt", rate(errors(F.col("hyp"), F.col("ref"), dialect), units(F.col("ref"), dialect)).alias("cer"))
    # One row.
    return each.crossJoin(F.broadcast(each.agg(F.avg("cer").alias("mean"))))
