"""Points as arrays of doubles; of two lengths the shorter counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _zip(a: Column, b: Column, f) -> Column:
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), f)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(_zip(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def plus(a: Column, b: Column) -> Column:
    return _zip(a, b, lambda x, y: x + y)


def minus(a: Column, b: Column) -> Column:
    return _zip(a, b, lambda x, y: x - y)


def divided(a: Column, n: Column) -> Column:
    return F.transform(a, lambda x: x / n)
