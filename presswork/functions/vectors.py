"""Vector expressions over array columns; everything is computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Clamped cosine; null where dimensions differ or a vector has no length."""
    value = F.try_divide(dot(a, b), norm(a) * norm(b))
    return F.when((F.size(a) == F.size(b)) & value.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)))


def is_valid(v: Column, dims: int) -> Column:
    """Exactly dims finite components and a positive norm; null vectors aren't valid."""
    finite = F.forall(doubles(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == dims) & finite & (norm(v) > 0), F.lit(False))


def normalised(v: Column, dims: int) -> Column:
    """Unit vector; null for a wrong dimension, a non-finite part or a norm of 1e-12 or less."""
    return F.when(is_valid(v, dims) & (norm(v) > 1e-12), F.transform(doubles(v), lambda x: x / norm(v)))
