"""Vector functions on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def l2(a: Column, b: Column) -> Column:
    """Squared distance."""
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """0 if either is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def normalised(a: Column) -> Column:
    n = norm(a)
    return F.when(n == 0, a.cast("array<double>")).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def similarity(distance: Column) -> Column:
    """1 / (1 + d); 0 for a negative distance."""
    return F.when(distance >= 0, 1 / (1 + distance)).otherwise(0.0)


def hashed_embedding(terms: Column, dims: int = 32) -> Column:
    """Stand-in for an embedding model: counts of terms by hash bucket. Deterministic, and the same in SQL."""
    buckets = F.transform(terms, lambda t: F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint") % dims)
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.size(F.filter(buckets, lambda b: b == d)).cast("double"))
