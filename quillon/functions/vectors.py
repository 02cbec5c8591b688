"""Columns over arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 where a vector is zero."""
    size = norm(a) * norm(b)
    return dot(a, b) / F.when(size == 0, F.lit(1.0)).otherwise(size)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def unit(a: Column) -> Column:
    size = norm(a)
    return F.transform(a, lambda x: x / F.when(size == 0, F.lit(1.0)).otherwise(size))


def standardized(a: Column, mean: Column, std: Column) -> Column:
    return F.zip_with(F.zip_with(a, mean, lambda x, m: x - m), std, lambda x, s: x / s)
