"""Deterministic sampling, splitting and construction: by hashes of keys, so every run and engine agrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxmeter.functions.hashing import unit_hash


def hash_order(key: str, seed: int = 0) -> Column:
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))


def stratified(df: DataFrame, stratum: str, key: str, total: int, seed: int = 0) -> DataFrame:
    """About `total` rows: of each stratum its share, rounded half to even, one at least."""
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_take", F.greatest(F.lit(1), F.bround(F.col("_n") * total / F.sum("_n").over(Window.partitionBy()), 0).cast("int")))
    by = Window.partitionBy(stratum).orderBy(hash_order(key, seed), key)
    return df.withColumn("_r", F.row_number().over(by)).join(sizes, stratum).where("_r <= _take").drop("_r", "_n", "_take")


def weighted_choice(df: DataFrame, key: str, options: list[tuple[str, float]], name: str, seed: int = 0) -> DataFrame:
    """One of the options for each row, by weight."""
    total, upto, out = sum(w for _, w in options), 0.0, F.lit(None).cast("string")
    u = unit_hash(F.col(key), F.lit(name), seed=seed)
    cases = []
    for option, w in options:
        upto += w / total
        cases.append((upto, option))
    for bound, option in reversed(cases):
        out = F.when(u < bound, F.lit(option)).otherwise(out)
    return df.withColumn(name, F.coalesce(out, F.lit(options[-1][0])))


def disjoint_split(df: DataFrame, group: str, shares: list[tuple[str, float]], seed: int = 0) -> DataFrame:
    """Column split by the group's hash, so a group's rows are all in one split."""
    return weighted_choice(df, group, shares, "split", seed)


def chunks(df: DataFrame, partition: str, key: str, size: int, seed: int = 0) -> DataFrame:
    """Columns chunk and place: rows of a partition in hash order, `size` to a chunk."""
    by = Window.partitionBy(partition).orderBy(hash_order(key, seed), key)
    n = F.row_number().over(by) - 1
    return df.withColumns({"chunk": F.floor(n / size).cast("int"), "place": (n % size).cast("int")})


def counterfactuals(df: DataFrame, base: str) -> DataFrame:
    """A row for each role A, B, C of a mixture; C is the absent one."""
    out = df.withColumn("role", F.explode(F.array(F.lit("A"), F.lit("B"), F.lit("C"))))
    return out.withColumns({"query_id": F.concat_ws("_", F.col(base).cast("string"), "role"), "present": F.col("role") != "C"})


def eligible(df: DataFrame, group: str, item: str, least: int) -> DataFrame:
    """Groups with `least` distinct items or more, and how many."""
    return df.groupBy(group).agg(F.countDistinct(item).alias("items")).where(F.col("items") >= least)


def replacement_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """Characters that stand for others in texts of equal length that differ in one place: wrong, right, n."""
    both = df.where(F.length(a) == F.length(b)).select(F.filter(F.arrays_zip(F.split(a, "").alias("x"), F.split(b, "").alias("y")), lambda p: p["x"] != p["y"]).alias("d"))
    return both.where(F.size("d") == 1).select(F.get("d", F.lit(0))["y"].alias("wrong"), F.get("d", F.lit(0))["x"].alias("right")).groupBy("wrong", "right").agg(F.count(F.lit(1)).alias("n"))


def numbered(df: DataFrame, key: str) -> DataFrame:
    """The rows with place (from 1, without gaps, by key) and all (how many keys): a key of its own for each row.

    Places come from cumulative counts over ranges of keys, so no task sees all rows.
    """
    from voxmeter.operators.windows import cumulative

    told = cumulative(df, key, {"_k": F.max(F.lit(1).cast("long"))}).select(key, F.col("_k_upto").alias("place"), F.col("_k_all").alias("all"))
    return df.join(told, key)


def placed(target: Column, other: Column, u: Column) -> Column:
    """start, overlap, total of a second source put at a random place (u in [0, 1)) of a target, half of it past the end at most."""
    start = u * F.greatest(target - other / 2, F.lit(0.0))
    end = start + other
    return F.struct(start.alias("start"), F.greatest(F.least(target, end) - start, F.lit(0.0)).alias("overlap"), F.greatest(target, end).alias("total"))


def layers(df: DataFrame, key: str, pools: dict[str, Column], take: dict[str, int], seed: int = 0) -> DataFrame:
    """Rows and their layer: of each pool in turn the first take[layer] in hash order that no layer before has taken.

    The pools' names and numbers are few, so each layer is a top-k; what is taken so far is small and is kept out by an anti-join.
    """
    out = None
    for layer, belongs in pools.items():
        left = df.where(belongs)
        if out is not None:
            left = left.join(F.broadcast(out.select(key)), key, "left_anti")
        one = left.orderBy(hash_order(key, seed), key).limit(take[layer]).withColumn("layer", F.lit(layer))
        out = one if out is None else out.unionByName(one)
    return out


def rotation(df: DataFrame, speaker: str, rounds: int, seed: int = 0) -> DataFrame:
    """round, grp, A, B, C: in each round every speaker is in one group; over three rounds each takes each role.

    Speakers in hash order form three classes of g; in round r the i-th of the first class meets the (i + r)-th and the
    (i + 2r)-th of the others. These differences are all distinct for up to g rounds (g / 2 if g is even), so no two
    speakers ever meet twice and nothing has to be searched. One or two speakers sit out where the number is no multiple
    of three; rounds that are no multiple of three, or too many for that, are refused.
    """
    from voxmeter.operators.protocol import batches

    g = df.count() // 3
    if rounds < 3 or rounds % 3:
        raise ValueError("rounds must be a positive multiple of three")
    if rounds > (g if g % 2 else g // 2):
        raise ValueError(f"{3 * g} speakers can't meet others in {rounds} rounds")
    told = batches(df.select(speaker), speaker, 3, seed)
    place = F.row_number().over(Window.partitionBy("batch").orderBy(unit_hash(F.col(speaker), seed=seed), speaker)) - 1
    each = told.withColumn("class", place).withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    grp = F.pmod(F.col("batch") - F.col("class") * F.col("round"), F.lit(g))
    role = (F.col("class") + F.col("round")) % 3
    return each.groupBy("round", grp.alias("grp")).agg(*[F.max(F.when(role == i, F.col(speaker))).alias(name) for i, name in enumerate("ABC")])
