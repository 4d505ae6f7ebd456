"""Sequence operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Rows of a range of values that one task sums up, and ranges at most: their boundaries are literals of a plan.
RANGE_ROWS, MOST_RANGES = 1_000_000, 4096


def bounds_of(df: DataFrame, col: str) -> list[float]:
    """Boundaries that cut the column's values into about equal parts: as many as the rows call for."""
    parts = min(MOST_RANGES, max(64, -(-df.count() // RANGE_ROWS)))
    got = df.agg(F.percentile_approx(col, [i / parts for i in range(1, parts)], 10000)).first()[0]
    return sorted(set(got or []))


def _place(value: Column, edges: list[float]) -> Column:
    """How many of the sorted edges are at or below the value: first among every 64th, then among the 64 behind it."""
    if not edges:
        return F.lit(0)
    blocks = [edges[i : i + 64] for i in range(0, len(edges), 64)]
    among = lambda some: F.size(F.filter(some, lambda x: x <= value))
    block = among(F.array(*[F.lit(b[0]) for b in blocks])) - 1
    held = F.array(*[F.array(*[F.lit(x) for x in b]) for b in blocks])
    return F.when(block < 0, 0).otherwise(block * 64 + among(F.get(held, block)))


def cumulative(df: DataFrame, by: str, sums: dict[str, Column], descending: bool = False, within: tuple[str, ...] = ()) -> DataFrame:
    """by, then for each sum its value at `by` (x), up to and with it (x_upto), and in all (x_all). Ties are one row.

    Values are grouped first and cut into ranges; sums of ranges and sums within a range add up, so no task sees all rows.
    With keys in `within` (replicates, labels) each of them has sums of its own, over the same ranges.
    """
    grouped = df.where(F.col(by).isNotNull()).groupBy(*within, by).agg(*[c.alias(k) for k, c in sums.items()])
    edges = bounds_of(grouped, by)
    part = _place(F.col(by), edges)
    grouped = grouped.withColumn("_part", -part if descending else part)
    order = F.desc(by) if descending else F.asc(by)
    inside = Window.partitionBy(*within, "_part").orderBy(order)
    parts = grouped.groupBy(*within, "_part").agg(*[F.sum(k).alias(f"_{k}") for k in sums])
    # One row for each range (of a key) goes through this window.
    upto = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*within, "_part", *[F.coalesce(F.sum(f"_{k}").over(upto), F.lit(0)).alias(f"_{k}_base") for k in sums], *[F.sum(f"_{k}").over(Window.partitionBy(*within)).alias(f"{k}_all") for k in sums])
    told = grouped.withColumns({f"{k}_upto": F.sum(k).over(inside) for k in sums}).join(parts if within else F.broadcast(parts), [*within, "_part"])
    return told.select(*within, by, *sums, *[(F.col(f"{k}_upto") + F.col(f"_{k}_base")).alias(f"{k}_upto") for k in sums], *[f"{k}_all" for k in sums])


def percentiles(df: DataFrame, value: str, at: dict[str, float], within: tuple[str, ...] = ()) -> DataFrame:
    """Keys of `within` and a column for each share: interpolated between the two values around it, from cumulative counts."""
    told = cumulative(df, value, {"_n": F.count(F.lit(1))}, within=within)
    place = lambda q: q * (F.col("_n_all") - 1)
    first = lambda k: F.min(F.when(F.col("_n_upto") > k, F.col(value)))
    sides = {n: F.struct(first(F.floor(place(q))).alias("lo"), first(F.ceil(place(q))).alias("hi"), F.max(place(q) - F.floor(place(q))).alias("w")) for n, q in at.items()}
    held = told.groupBy(*within).agg(*[c.alias(n) for n, c in sides.items()])
    return held.select(*within, *[(F.col(f"{n}.lo") + (F.col(f"{n}.hi") - F.col(f"{n}.lo")) * F.col(f"{n}.w")).alias(n) for n in at])


def mean_ranks(df: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """value, rank (from 1; equal values share the mean of theirs), n."""
    told = cumulative(df, value, {"n": F.count(F.lit(1))})
    return told.select(value, (F.col("n_upto") - F.col("n") + (F.col("n") + 1) / 2).alias(name), "n")


def quartile(df: DataFrame, value: str, parts: int = 4) -> DataFrame:
    """Each row's part by the count of rows of smaller values; the remainder goes to the last part, ties stay together."""
    told = cumulative(df, value, {"n": F.count(F.lit(1))})
    at = F.floor((F.col("n_upto") - F.col("n")) / F.greatest(F.floor(F.col("n_all") / parts), F.lit(1)))
    return df.join(told.select(value, (F.least(at, F.lit(parts - 1)) + 1).cast("int").alias("part")), value)


def islands(df: DataFrame, keys: list[str], at: str, least: int = 1) -> DataFrame:
    """Runs of consecutive whole numbers: keys, start, end (excluded), for runs of `least` or more."""
    one = df.select(*keys, at).distinct()
    isle = one.withColumn("_i", F.col(at) - F.row_number().over(Window.partitionBy(*keys).orderBy(at)))
    return isle.groupBy(*keys, "_i").agg(F.min(at).alias("start"), (F.max(at) + 1).alias("end")).where(F.col("end") - F.col("start") >= least).drop("_i")


def merge_intervals(df: DataFrame, keys: list[str], gap: Column | float = 0.0) -> DataFrame:
    """Union of (start, end) intervals that overlap or touch (within gap): keys, start, end; empty ones go."""
    by = Window.partitionBy(*keys).orderBy("start", "end")
    told = df.where("end > start").withColumn("_top", F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    isle = told.withColumn("_i", F.sum(F.when(F.col("_top").isNull() | (F.col("start") > F.col("_top") + gap), 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return isle.groupBy(*keys, "_i").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_i")


def dilated(hits: DataFrame, keys: list[str], frame: str, score: str, before: int = 3, after: int = 3) -> DataFrame:
    """keys, start, end, frames, mean: frames that hit, each widened on both sides, as a timeline (end excluded, from 0) where
    those that overlap or touch are one; with how many frames hit in it and their mean score. A frame counts once."""
    by = Window.partitionBy(*keys).orderBy(frame)
    once = hits.groupBy(*keys, frame).agg(F.max(score).alias(score))
    far = F.coalesce(F.col(frame) - F.lag(frame).over(by) > before + after + 1, F.lit(True))
    told = once.withColumn("_far", far).withColumn("_i", F.sum(F.col("_far").cast("long")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    end = (F.max(frame) + after + 1).alias("end")
    return told.groupBy(*keys, "_i").agg(F.greatest(F.min(frame) - before, F.lit(0)).alias("start"), end, F.count(F.lit(1)).alias("frames"), F.avg(score).alias("mean")).drop("_i")


def padded(df: DataFrame, keys: list[str], pad: float, total: Column) -> DataFrame:
    """Segments with ends moved out by pad, not beyond the next segment or the recording; the first also begins earlier."""
    by = Window.partitionBy(*keys).orderBy("start")
    later = F.coalesce(F.lead("start").over(by), total)
    first = F.row_number().over(by) == 1
    told = df.withColumns({"_s": F.when(first, F.greatest(F.lit(0.0), F.col("start") - pad)).otherwise(F.col("start")), "_e": F.least(F.col("end") + pad, later)})
    return told.withColumn("start", F.col("_s")).withColumn("end", F.col("_e")).drop("_s", "_e")


def window_starts(n: Column, size: int, hop: int) -> Column:
    """Starts of windows, with one more that ends with the signal; one start 0 if the signal is shorter."""
    last = n - size
    return F.when(last <= 0, F.array(F.lit(0).cast("int"))).otherwise(F.array_distinct(F.concat(F.sequence(F.lit(0), last.cast("int"), F.lit(hop)), F.array(last.cast("int")))))


def pieces(df: DataFrame, keys: list[str]) -> DataFrame:
    """Intervals cut at every bound of their key: keys, start, end, depth (how many intervals hold the piece)."""
    ends = df.where("end > start").select(*keys, F.explode(F.array(F.struct(F.col("start").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end").alias("t"), F.lit(-1).alias("d")))).alias("e"))
    steps = ends.groupBy(*keys, F.col("e.t").alias("start")).agg(F.sum("e.d").alias("d"))
    by = Window.partitionBy(*keys).orderBy("start")
    return steps.select(*keys, "start", F.lead("start").over(by).alias("end"), F.sum("d").over(by).alias("depth")).where("end is not null and depth > 0")


def trend(df: DataFrame, order: str, value: str) -> DataFrame:
    """Rises and falls of a value over few ordered buckets (one row each, already aggregated)."""
    d = df.select((F.col(value) - F.lag(value).over(Window.orderBy(order))).alias("d"))
    return d.agg(F.sum(F.when(F.col("d") > 0, 1).otherwise(0)).cast("long").alias("rises"), F.sum(F.when(F.col("d") < 0, 1).otherwise(0)).cast("long").alias("falls"))


def cap(df: DataFrame, key: str, order: list[Column | str], n: int) -> DataFrame:
    """At most n rows of each key, the first by order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def round_robin(df: DataFrame, stratum: str, order: str) -> DataFrame:
    """Column turn: the row's number in its stratum; ordered by (turn, stratum) strata take turns."""
    return df.withColumn("turn", F.row_number().over(Window.partitionBy(stratum).orderBy(order)).cast("int"))
