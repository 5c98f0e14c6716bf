"""Vectors as arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column, epsilon: float = 0.0) -> Column:
    return F.transform(a, lambda x: x.cast("double") / (norm(a) + epsilon))


def cosine(a: Column, b: Column) -> Column:
    """null for a null or zero vector."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))
