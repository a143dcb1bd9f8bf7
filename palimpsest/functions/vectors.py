"""Vector expressions over array<double> columns, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v))


def cosine(a: Column, b: Column, clamp: bool = True) -> Column:
    """Cosine; 0 for empty or unequal vectors and zero norms; in [0, 1] if clamped."""
    value = F.when((F.size(a) != F.size(b)) | (F.size(a) <= 0), 0.0).otherwise(F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0)))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)) if clamp else value


def truncate_unit(a: Column, dims: int) -> Column:
    """The first components, scaled to length one; a zero vector stays."""
    short = F.slice(a, 1, dims)
    return F.when(norm(short) > 0, F.transform(short, lambda v: v / norm(short))).otherwise(short)


def relevance(distance: Column) -> Column:
    """Cosine of unit vectors from their L2 distance."""
    return F.lit(1.0) - distance * distance / 2.0
