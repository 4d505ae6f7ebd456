"""Operators of identity protocols: mixtures, queries, groups of counterfactuals, gates and corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxmeter.functions.text import grams


def label_matrix(mixtures: DataFrame, bank: DataFrame, mix: str, speakers: str, query: str, speaker: str) -> DataFrame:
    """mix, query, present: positives by a join on the speaker, negatives as counts only.

    Every mixture's row says how many queries are present and absent, so no pair without a common speaker is formed.
    """
    unique = bank.groupBy(speaker).agg(F.min(query).alias(query))
    total = unique.agg(F.count(F.lit(1)).alias("_all"))
    found = mixtures.select(mix, F.explode(F.array_distinct(F.col(speakers))).alias(speaker)).join(unique, speaker)
    each = found.groupBy(mix).agg(F.array_sort(F.collect_set(query)).alias("present"))
    out = mixtures.select(mix).join(each, mix, "left").crossJoin(F.broadcast(total))
    none = F.array().cast(f"array<{bank.schema[query].dataType.simpleString()}>")
    return out.select(mix, F.coalesce("present", none).alias("present"), (F.col("_all") - F.coalesce(F.size("present"), F.lit(0))).alias("absent"))


def group_response(df: DataFrame, group: str, present: str, score: str) -> DataFrame:
    """group, response: mean score of two present queries minus that of the absent one; groups of another shape get none."""
    p = F.col(present)
    told = df.groupBy(group).agg(F.sum(F.when(p, 1).otherwise(0)).alias("np"), F.sum(F.when(p, 0).otherwise(1)).alias("na"), F.avg(F.when(p, F.col(score))).alias("sp"), F.avg(F.when(~p, F.col(score))).alias("sa"))
    return told.where("np = 2 and na = 1").select(group, (F.col("sp") - F.col("sa")).alias("response"))


def gate(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """passed, checks: metrics (name, value) against rules (name, op, bound); a missing metric fails."""
    both = rules.join(metrics, "name", "left")
    ok = F.coalesce(F.when(F.col("op") == ">=", F.col("value") >= F.col("bound")).otherwise(F.col("value") <= F.col("bound")), F.lit(False))
    return both.agg(F.bool_and(ok).alias("passed"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", ok.alias("ok"))))).alias("checks"))


def rotation_audit(df: DataFrame, speaker: str, round_: str, role: str, group: str, most_pairs: int = 1) -> DataFrame:
    """rule, detail: speakers without each role once, speakers twice in a round, and pairs that meet more than most_pairs times."""
    roles = df.groupBy(speaker).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(role).alias("r")).where("n <> r or r <> 3").select(F.lit("roles").alias("rule"), F.col(speaker).cast("string").alias("detail"))
    twice = df.groupBy(speaker, round_).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("twice").alias("rule"), F.col(speaker).cast("string").alias("detail"))
    a, b = df.select(round_, group, F.col(speaker).alias("a")), df.select(round_, group, F.col(speaker).alias("b"))
    # A group has three members, so pairs within it are at most three.
    pairs = a.join(b, [round_, group]).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_pairs)
    return roles.unionByName(twice).unionByName(pairs.select(F.lit("pairs").alias("rule"), F.concat_ws("|", F.col("a").cast("string"), F.col("b").cast("string")).alias("detail")))


def capacity(df: DataFrame, group: str, item: str, per_group: int, official: int) -> Column:
    """How many groups a source can give: the smaller of what there is and what is allowed; less than one raises."""
    n = df.groupBy(group).agg(F.countDistinct(item).alias("n")).where(F.col("n") >= per_group).count()
    if min(n, official) < 1:
        raise ValueError("no group has items enough")
    return F.lit(min(n, official))


def wildcard_matches(df: DataFrame, text: str, vocabulary: DataFrame, word: str, n: int) -> DataFrame:
    """text, place, found, word: n-grams of a text that differ from a vocabulary word in exactly one character.

    Both sides are joined on their forms with one character left open, so no text meets a word that isn't near.
    """
    forms = lambda c: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.substr(c, F.lit(1), i - 1), F.lit("*"), F.substr(c, i + 1)))
    have = df.select(text).distinct().select(text, F.posexplode(grams(F.col(text), n)).alias("place", "found")).select("*", F.explode(forms(F.col("found"))).alias("_form"))
    want = vocabulary.where(F.length(word) == n).select(word, F.explode(forms(F.col(word))).alias("_form"))
    return have.join(want, "_form").where(F.col("found") != F.col(word)).select(text, "place", "found", word)


def substitutions_only(before: Column, after: Column, sounds: Column) -> Column:
    """A correction, taken back unless it has the same length and changes characters only to ones of equal sound (a map)."""
    x, y = F.split(before, ""), F.split(after, "")
    same = F.forall(F.arrays_zip(x.alias("x"), y.alias("y")), lambda p: (p["x"] == p["y"]) | F.coalesce(sounds[p["x"]] == sounds[p["y"]], F.lit(False)))
    return F.when((F.length(before) == F.length(after)) & same, after).otherwise(before)


def pick_of_many(texts: Column, verdicts: Column) -> Column:
    """Of a map of texts by speaker: the only accepted one, else the longest accepted one, else none; and which case it was."""
    ok = F.filter(F.map_entries(texts), lambda e: F.coalesce(F.element_at(verdicts, e["key"]) == "accept", F.lit(False)))
    longest = F.aggregate(ok, F.lit(""), lambda best, e: F.when(F.length(e["value"]) > F.length(best), e["value"]).otherwise(best))
    return F.when(F.size(ok) == 1, F.struct(ok[0]["value"].alias("text"), F.lit("unique").alias("mode"))).when(F.size(ok) > 1, F.struct(longest.alias("text"), F.lit("longest").alias("mode"))).otherwise(F.struct(F.lit("").alias("text"), F.lit("none").alias("mode")))


def dominant(df: DataFrame, key: str, kind: str, priority: list[str]) -> DataFrame:
    """key, kind: the most frequent kind of each key, ties by priority."""
    counted = df.groupBy(key, kind).agg(F.count(F.lit(1)).alias("n"))
    place = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(p) for p in priority]), F.col(kind)), F.lit(0)), F.lit(len(priority) + 1))
    return counted.groupBy(key).agg(F.max_by(kind, F.struct("n", -place, kind)).alias(kind))


def batches(df: DataFrame, key: str, size: int, seed: int = 0, parts: int | None = None, short: str = "drop") -> DataFrame:
    """Column batch: rows in a seeded order, `size` to a batch, numbered over all hash ranges (one for each million rows).

    What the rows leave over, less than a batch, goes (drop), makes a short batch (keep), or raises (error): an epoch then
    must divide into batches.
    """
    from voxmeter.functions.hashing import unit_hash

    if short not in ("drop", "keep", "error"):
        raise ValueError(f"short batches: {short}")
    if short == "error" or parts is None:
        n = df.count()
        if short == "error" and n % size:
            raise ValueError(f"{n} rows don't make whole batches of {size}")
        parts = max(64, -(-n // 1_000_000)) if parts is None else parts
    told = df.withColumns({"_u": unit_hash(F.col(key), seed=seed)}).withColumn("_p", F.floor(F.col("_u") * parts).cast("int"))
    counts = told.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    # A row for each range: the rows of the ranges before it, and all rows.
    every = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = counts.select("_p", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_o"), F.sum("_c").over(every).alias("_n"))
    n = F.row_number().over(Window.partitionBy("_p").orderBy("_u", key)) - 1
    told = told.withColumn("_r", n).join(F.broadcast(before), "_p").withColumn("batch", F.floor((F.col("_o") + F.col("_r")) / size))
    return (told if short == "keep" else told.where((F.col("batch") + 1) * size <= F.col("_n"))).drop("_u", "_p", "_r", "_o", "_n")


def permuted(df: DataFrame, key: str, value: str, group: str) -> DataFrame:
    """A negative control: each row gets the value of the next key of its group."""
    by = Window.partitionBy(group).orderBy(key)
    return df.withColumn(value, F.coalesce(F.lead(value).over(by), F.first(value).over(by)))
