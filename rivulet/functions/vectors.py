"""Vector functions as Column expressions on arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 where a vector is all zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))


def unit(a: Column) -> Column:
    """The vector over its length; an all-zero vector stays."""
    n = F.sqrt(dot(a, a))
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def sparse(a: Column, over: float) -> Column:
    """Map from position to value of the entries over a threshold."""
    at = F.filter(F.transform(a, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: s["x"] > over)
    return F.map_from_entries(at)
