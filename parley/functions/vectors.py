"""Expressions over array<double> vectors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def normalize(v: Column) -> Column:
    """v over its length; a zero vector stays as it is."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - a.b for unit vectors; 1 when one is null or empty or the sizes differ."""
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.when(F.coalesce(usable, F.lit(False)), 1 - dot(a, b)).otherwise(F.lit(1.0))
