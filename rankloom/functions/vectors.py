"""Arithmetic on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    norms = F.sqrt(dot(a, a) * dot(b, b))
    return F.coalesce(F.try_divide(dot(a, b), F.when(norms > 0, norms)), F.lit(0.0))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def top_mean(v: Column, n: int) -> Column:
    """Mean of the n largest elements (of all, where there are fewer); 0 without elements."""
    best = F.slice(F.sort_array(doubles(v), asc=False), 1, n)
    return F.coalesce(F.try_divide(total(best), F.size(best)), F.lit(0.0))


def clip01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
