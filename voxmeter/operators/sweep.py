"""Threshold sweeps and policy tables: one pass of facts against a small grid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmeter.functions.errors import pooled

#: Weights of the two legs of a total score.
CER_LEG, REJECT_LEG = 40.0, 30.0
#: A grid is made by range() and may be broadcast: it has so many rows at most, whatever the facts.
GRID = 10_000


def grid(df: DataFrame, start: float, step: float, n: int) -> DataFrame:
    if n > GRID:
        raise ValueError(f"a grid of {n} thresholds; {GRID} at most")
    return df.sparkSession.range(n).select(F.bround(F.lit(start) + F.col("id") * step, 6).alias("thr"))


def threshold_sweep(df: DataFrame, thresholds: DataFrame, sim: str, rate: str, negative: str) -> DataFrame:
    """thr, pos_cer, neg_rr, pos_correct, total: rows below a threshold are rejected, which costs a positive row all.

    Facts are first summed by distinct similarity, so the grid meets those sums and not every row.
    """
    pos, neg = ~F.col(negative), F.col(negative)
    told = df.groupBy(F.col(sim).alias("_s")).agg(
        F.sum(F.when(pos, 1).otherwise(0)).alias("p"), F.sum(F.when(pos, F.col(rate)).otherwise(0.0)).alias("e"),
        F.sum(F.when(pos & (F.col(rate) < 0.5), 1).otherwise(0)).alias("ok"), F.sum(F.when(neg, 1).otherwise(0)).alias("n"),
    )
    met = told.crossJoin(F.broadcast(thresholds)).withColumn("low", F.coalesce(F.col("_s") < F.col("thr"), F.lit(True)))
    out = met.groupBy("thr").agg(
        (F.sum(F.when(F.col("low"), F.col("p").cast("double")).otherwise(F.col("e"))) / F.sum("p")).alias("pos_cer"),
        (F.sum(F.when(F.col("low"), F.col("n")).otherwise(0)) / F.sum("n")).alias("neg_rr"),
        (F.sum(F.when(F.col("low"), 0).otherwise(F.col("ok"))) / F.sum("p")).alias("pos_correct"),
    )
    return out.withColumn("total", (1 - F.col("pos_cer")) * CER_LEG + F.col("neg_rr") * REJECT_LEG)


def best(sweep: DataFrame, score: str = "total", near: float = 0.1) -> DataFrame:
    """The threshold of the highest score (the smallest of equal ones), and the range of those within `near` of it."""
    top = sweep.agg(F.max_by(F.struct("*"), F.struct(F.bround(F.col(score), 9), -F.col("thr"))).alias("b")).select("b.*")
    joined = sweep.select(F.col("thr").alias("t"), F.col(score).alias("s")).crossJoin(F.broadcast(top))
    return joined.where(F.col("s") >= F.col(score) - near).groupBy(*top.columns).agg(F.min("t").alias("plateau_from"), F.max("t").alias("plateau_to"))


def policies(df: DataFrame, accepts: dict[str, Column], err: str, n: str, negative: str) -> DataFrame:
    """A row for each policy: n, accept_rate, reject_rate of negatives, cer_final, cer_accepted, correct_rate; one pass."""
    sides = F.array(*[F.struct(F.lit(k).alias("policy"), F.coalesce(c, F.lit(False)).alias("ok")) for k, c in accepts.items()])
    rows = df.withColumn("_p", F.explode(sides)).select("*", F.col("_p.policy").alias("policy"), F.col("_p.ok").alias("ok"))
    pos = ~F.col(negative)
    e, u = F.col(err), F.col(n)
    return rows.groupBy("policy").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("ok").cast("double")).alias("accept_rate"),
        F.avg(F.when(F.col(negative), (~F.col("ok")).cast("double"))).alias("reject_rate"),
        pooled(F.when(pos, F.when(F.col("ok"), e).otherwise(u)), F.when(pos, u)).alias("cer_final"),
        pooled(F.when(pos & F.col("ok"), e), F.when(pos & F.col("ok"), u)).alias("cer_accepted"),
        F.avg((F.col("ok") == pos).cast("double")).alias("correct_rate"),
    )


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
