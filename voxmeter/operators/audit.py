"""Data-quality audits: each gives rows of what is wrong, none if all is well."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_overlap(df: DataFrame, split: str, fields: list[str]) -> DataFrame:
    """field, value, splits: values of a field that more than one split has."""
    long = df.select(split, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("i")).select(split, "i.field", "i.value").where("value is not null").distinct()
    return long.groupBy("field", "value").agg(F.array_join(F.array_sort(F.collect_set(split)), "|").alias("splits"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def depends(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that have more than one value: the value doesn't depend on the key."""
    return df.groupBy(key).agg(F.countDistinct(value).alias("n_values")).where("n_values > 1")


def group_contract(df: DataFrame, group: str, rules: dict[str, Column]) -> DataFrame:
    """rule, group: groups for which an aggregate condition doesn't hold."""
    told = df.groupBy(group).agg(*[F.coalesce(c, F.lit(False)).alias(k) for k, c in rules.items()])
    bad = F.filter(F.array(*[F.when(~F.col(k), F.lit(k)) for k in rules]), lambda x: x.isNotNull())
    return told.select(F.explode(bad).alias("rule"), group)


def rows_differ(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose values differ between two runs, or that one run lacks."""
    both = a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key, "full_outer")
    return both.where(~F.col("a").eqNullSafe(F.col("b")))


def fingerprint(df: DataFrame) -> DataFrame:
    """rows and a sum of row hashes: the same for the same rows in any order, of any number."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.conv(F.substr(F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in df.columns])), F.lit(1), F.lit(12)), 16, 10).cast("decimal(38,0)")).alias("digest"))


def expect(df: DataFrame, message: str) -> None:
    """Raise if there is a row; for strict inputs."""
    if not df.isEmpty():
        raise ValueError(f"{message}: {df.take(3)}")


def all_of(found: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def verify_digests(df: DataFrame, declared: DataFrame, key: str, content: str, digest: str) -> DataFrame:
    """All rows with ok: whether the content's SHA-256 is the declared one; rows that nobody declared are not."""
    both = df.join(declared.select(key, digest), key, "left")
    return both.withColumn("ok", F.coalesce(F.sha2(F.col(content).cast("binary"), 256) == F.lower(digest), F.lit(False)))
