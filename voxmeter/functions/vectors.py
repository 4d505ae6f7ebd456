"""Vectors as arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def unit(a: Column) -> Column:
    n = F.nullif(norm(a), F.lit(0.0))
    return F.transform(a, lambda x: x.cast("double") / n)


def top_mean(values: Column, share: float = 0.25) -> Column:
    """Mean of the largest share of the values, one at least."""
    n = F.greatest(F.ceil(F.size(values) * share), F.lit(1)).cast("int")
    return F.aggregate(F.slice(F.sort_array(values, False), F.lit(1), n), F.lit(0.0), lambda s, v: s + v) / F.least(n, F.size(values))


def blend(enroll: Column, mean: Column, weight: float, times: int) -> Column:
    """weight * e + (1 - weight) * mean, made a unit vector, so many times over."""
    step = lambda e, _: unit(F.zip_with(e, mean, lambda x, y: weight * x + (1 - weight) * y))
    return F.aggregate(F.sequence(F.lit(1), F.lit(times)), F.transform(enroll, lambda x: x.cast("double")), step)
