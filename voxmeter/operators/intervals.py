"""Frames of timelines, and vectors of speakers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxmeter.functions import vectors
from voxmeter.operators.aggregates import count_if
from voxmeter.sources.session import written

#: Bytes of anchors that are broadcast at a time.
ANCHOR_BYTES = 8 << 20


def frames(df: DataFrame, keys: list[str], width: int) -> DataFrame:
    """keys, frame: distinct frames of `width` that an interval (start, end) meets; empty intervals meet none."""
    at = F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width)))
    return df.where("end > start").select(*keys, at.alias("frame")).distinct()


def stno(frames_: DataFrame, rec: str, spk: str, frame: str, target: str) -> DataFrame:
    """rec, target, others, overlap: frames of the target alone, of others alone, and of both."""
    each = frames_.groupBy(rec, frame).agg(F.bool_or(F.col(spk) == target).alias("t"), F.bool_or(F.col(spk) != target).alias("o"))
    t, o = F.col("t"), F.col("o")
    return each.groupBy(rec).agg(count_if(t & ~o).alias("target"), count_if(~t).alias("others"), count_if(t & o).alias("overlap"))


def stno_ratios(frames_: DataFrame, rec: str, spk: str, frame: str, target: str) -> DataFrame:
    """rec, exclusive, active: shares of a recording's frames, from its first to its last, in which the target speaks alone, and at all."""
    span = frames_.groupBy(rec).agg((F.max(frame) - F.min(frame) + 1).alias("_t"))
    told = stno(frames_, rec, spk, frame, target).join(span, rec)
    return told.select(rec, (F.col("target") / F.col("_t")).alias("exclusive"), ((F.col("target") + F.col("overlap")) / F.col("_t")).alias("active"))


def top_share_mean(df: DataFrame, key: str, value: str, order: str, share: float) -> DataFrame:
    """Mean of the largest share of each key's values, one at least."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    told = df.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(value), order))).join(n, key)
    return told.where(F.col("_k") <= F.greatest(F.ceil(F.col("_n") * share), F.lit(1))).groupBy(key).agg(F.avg(value).alias("top_mean"))


def mean_vectors(df: DataFrame, key: str, vector: str, unit: bool = False) -> DataFrame:
    """key, mean: the mean vector of each key, component by component; with unit, of vectors of length 1, itself of length 1.

    A vector without length takes no part then.
    """
    if unit:
        df = df.withColumn(vector, vectors.unit(F.col(vector)))
    each = df.select(key, F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    told = each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))
    return told.withColumn("mean", vectors.unit(F.col("mean"))) if unit else told


def nearest_anchor(df: DataFrame, id_col: str, vector: str, label: str, unit: bool = False) -> DataFrame:
    """id, anchor, max_sim: the class whose mean vector has the highest cosine, the first of equal ones.

    Anchors are written, measured and cut into parts of ANCHOR_BYTES; a part is one row, an array of anchors, so each vector
    meets a part in its own row and no pair of them is one. Parts are broadcast one after another, never two at a time.
    """
    anchors = written(mean_vectors(df, label, vector, unit), "anchors")
    size = anchors.agg(F.sum(F.size("mean") * 8 + 64)).first()[0] or 0
    parts = max(1, -(-size // ANCHOR_BYTES))
    found = None
    for p in range(parts):
        held = anchors.where(F.pmod(F.xxhash64(label), F.lit(parts)) == p).agg(F.collect_list(F.struct(F.col(label).alias("label"), "mean")).alias("_held"))
        sim = lambda a: vectors.cosine(F.col(vector), a["mean"])
        best = F.array_max(F.transform("_held", lambda a: F.struct(F.round(sim(a), 9).alias("r"), (-a["label"]).alias("k"), sim(a).alias("sim"), a["label"].alias("anchor"))))
        each = df.select(id_col, vector).crossJoin(F.broadcast(held)).select(id_col, best.alias("b")).where("b is not null")
        if parts == 1:
            return each.select(id_col, "b.anchor", F.col("b.sim").alias("max_sim"))
        each = written(each, "nearest")
        found = each if found is None else found.unionByName(each)
    return found.groupBy(id_col).agg(F.max("b").alias("b")).select(id_col, "b.anchor", F.col("b.sim").alias("max_sim"))


def clusters(df: DataFrame, rec: str, vector: str, cutoff: float) -> DataFrame:
    """rec, n, clusters: average-linkage clusters of a recording's vectors by cosine distance, merged below the cutoff.

    Vectors are numbered once; see linkage.clustered for recordings of any size.
    """
    from voxmeter.operators import linkage

    rows = written(df.select(rec, F.col(vector).cast("array<double>").alias(vector), F.monotonically_increasing_id().alias("_id")), "vectors")
    return linkage.clusters(rows, rec, "_id", vector, cutoff)


def overlap_intervals(explicit: Column, unit: Column, single: Column, target: Column, other: Column, length: Column, total: int, rate: int) -> Column:
    """array<struct<start, end>> in samples: the intervals told (in samples or seconds), else the single one, else from the
    later of two beginnings for `length`; within the recording, empty ones left out, in order."""
    scale = F.when(unit.isin("second", "seconds", "sec"), rate).otherwise(1)
    told = F.transform(explicit, lambda x: F.struct(F.bround(x["start"] * scale).cast("long").alias("start"), F.bround(x["end"] * scale).cast("long").alias("end")))
    begin = F.greatest(F.coalesce(target, F.lit(0)), F.coalesce(other, F.lit(0)))
    computed = F.when(F.coalesce(length, F.lit(0)) > 0, F.array(F.struct(begin.cast("long").alias("start"), (begin + length).cast("long").alias("end"))))
    one = F.when(single["start"].isNotNull(), F.array(F.struct(single["start"].cast("long").alias("start"), single["end"].cast("long").alias("end"))))
    every = F.coalesce(told, one, computed, F.array().cast("array<struct<start:bigint,end:bigint>>"))
    clipped = F.transform(every, lambda x: F.struct(F.greatest(x["start"], F.lit(0)).alias("start"), F.least(x["end"], F.lit(total)).alias("end")))
    return F.array_sort(F.filter(clipped, lambda x: x["end"] > x["start"]))


def with_context(interval: Column, total: int, context: int) -> Column:
    """The interval with context on both sides, within the recording."""
    return F.struct(F.greatest(interval["start"] - context, F.lit(0)).alias("start"), F.least(interval["end"] + context, F.lit(total)).alias("end"))


def target_seconds(own: Column, whole: Column, least: float = 0.3) -> Column:
    """Seconds of a target's joined segments, or of the whole recording where they are less than `least`."""
    return F.when(own >= least, own).otherwise(whole)
