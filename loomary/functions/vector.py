"""Vectors as ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def normalise(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    n = norm(v)
    return F.transform(v, lambda x: F.coalesce(F.try_divide(x, n), F.lit(0.0)))


def clamp(x: Column) -> Column:
    """To [0, 1]; NaN gives 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def raw_cosine(a: Column, b: Column) -> Column:
    """In [-1, 1]; 0 where a vector has no length."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    return clamp(raw_cosine(a, b))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def keyword_vector(keywords: Column, vocabulary: list[str]) -> Column:
    """One entry per vocabulary word that the keywords hold, unit length; unknown words are ignored."""
    hot = F.array(*[F.when(F.array_contains(keywords, w), 1.0).otherwise(0.0) for w in vocabulary])
    return normalise(hot)


def usable(v: Column) -> Column:
    """Has entries, none of them null, and a length."""
    return F.coalesce(F.size(v) > 0, F.lit(False)) & ~F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x)), F.lit(False)) & F.coalesce(norm(v) > 0, F.lit(False))
