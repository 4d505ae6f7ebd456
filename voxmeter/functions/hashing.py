"""Deterministic splits, seeds and digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_half(uid: Column, seed: int) -> Column:
    """0 or 1 by the parity of the MD5 of 'uid|seed=s'."""
    last = F.right(F.md5(F.concat(uid.cast("string"), F.lit(f"|seed={seed}"))), F.lit(1))
    return F.conv(last, 16, 10).cast("int") % 2


def universe_digest(uid: Column) -> Column:
    """SHA-1 of all sorted ids, for data that fit a row; see audit.fingerprint for any size."""
    return F.sha1(F.array_join(F.array_sort(F.collect_list(uid.cast("string"))), "|"))


def unit_hash(*cols: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from the MD5 of the columns and a seed: the same in any engine."""
    told = F.md5(F.concat_ws("|", *[c.cast("string") for c in cols], F.lit(str(seed))))
    return F.conv(F.substr(told, F.lit(1), F.lit(8)), 16, 10).cast("double") / 4294967296.0


def text_seed(text: Column, seed: int) -> Column:
    """Struct of high and low: the first eight bytes of a text's SHA-256 as two 32-bit numbers, the base seed in the low one."""
    told = F.sha2(text, 256)
    part = lambda at: F.conv(F.substr(told, F.lit(at), F.lit(8)), 16, 10).cast("long")
    return F.struct(part(1).alias("high"), part(9).bitwiseXOR(F.lit(seed)).alias("low"))


def pair_key(a: Column, b: Column) -> Column:
    """The two ids in order; an id with itself raises."""
    return F.when(a == b, F.raise_error(F.lit("a pair needs two ids"))).otherwise(F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))


def role(i: Column, round_: Column) -> Column:
    """A, B or C in rotation."""
    return F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), ((i + round_) % 3 + 1).cast("int"))
