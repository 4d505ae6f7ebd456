"""Aggregations of evaluation data. Each is one pass with partial sums before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxmeter.functions.errors import pooled


def count_if(c: Column) -> Column:
    return F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")


def share(c: Column) -> Column:
    """Share of rows for which the condition holds; null is no."""
    return F.avg(F.when(c, 1.0).otherwise(0.0))


def by_each(df: DataFrame, keys: list[str], aggs: list[Column], total: bool = True) -> DataFrame:
    """The aggregates by each key alone and in all: dimension, value, then the aggregates. One pass over the rows."""
    sides = [F.struct(F.lit(k).alias("dimension"), F.col(k).cast("string").alias("value")) for k in keys]
    if total:
        sides.append(F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("value")))
    return df.withColumn("_d", F.explode(F.array(*sides))).groupBy(F.col("_d.dimension").alias("dimension"), F.col("_d.value").alias("value")).agg(*aggs)


def error_summary(df: DataFrame, keys: list[str], err: str, n: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), pooled(F.col(err), F.col(n)).alias("pooled_cer"))


def confusion(df: DataFrame, gold: str, found: str) -> DataFrame:
    return df.groupBy(gold, found).agg(F.count(F.lit(1)).alias("n"))


def precision_recall(positive: Column, predicted: Column) -> list[Column]:
    """tp, fp, tn, fn, precision, recall, f1, accuracy; a share of nothing is 0."""
    tp, fp, tn, fn = (count_if(c) for c in (positive & predicted, ~positive & predicted, ~positive & ~predicted, positive & ~predicted))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return [
        tp.alias("tp"), fp.alias("fp"), tn.alias("tn"), fn.alias("fn"), ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"),
    ]


def deltas(before: Column, after: Column, band: float = 0.0) -> list[Column]:
    """better, same, worse counts of paired rates (lower is better) with a dead band, and the mean change."""
    d = after - before
    return [count_if(d < -band).alias("better"), count_if(F.abs(d) <= band).alias("same"), count_if(d > band).alias("worse"), F.avg(d).alias("mean_delta")]


def decompose(df: DataFrame, delta: str, bucket: Column) -> DataFrame:
    """Sum, count and share of a change by exhaustive buckets."""
    out = df.withColumn("bucket", bucket).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(delta).alias("delta"))
    return out.withColumn("share", F.col("delta") / F.nullif(F.sum("delta").over(Window.partitionBy()), F.lit(0.0)))


def weighted_mean(v: Column, w: Column) -> Column:
    """Null without weight; NaN counts as missing."""
    known = v.isNotNull() & ~F.isnan(v) & w.isNotNull()
    return F.sum(F.when(known, v * w)) / F.nullif(F.sum(F.when(known, w)), F.lit(0.0))


def top_values(df: DataFrame, key: str, value: str, order: str, k: int = 3) -> DataFrame:
    """Each key's k most frequent values, ties to the one that came first: key, rank, value, n."""
    counted = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first"))
    by = Window.partitionBy(key).orderBy(F.desc("n"), "_first", value)
    return counted.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).drop("_first")


def volatility(df: DataFrame, keys: list[str], value: str, group: str) -> DataFrame:
    """Share of a group's keys whose value is not the same in all of their runs."""
    each = df.groupBy(*dict.fromkeys([*keys, group])).agg((F.countDistinct(value) > 1).alias("varies"))
    return each.groupBy(group).agg(F.count(F.lit(1)).alias("n"), share(F.col("varies")).alias("volatility"))


def histogram(df: DataFrame, value: Column, bounds: list[float]) -> DataFrame:
    from voxmeter.functions.scores import bucket

    told = df.select(bucket(value, bounds).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    return told.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def first_best(value: Column, score: Column, order: Column) -> Column:
    """The value of the highest score, the first of equal ones by order."""
    return F.max_by(value, F.struct(score, -order))


def item_at(values: Column, q: float, how: str) -> Column:
    """A percentile of a sorted array by nearest rank (half to even) or by floor of n * q."""
    n = F.size(values)
    at = F.bround((n - 1) * F.lit(q), 0) if how == "nearest" else F.floor(n * F.lit(q))
    return F.element_at(values, F.least(at.cast("int"), n - 1) + 1)
