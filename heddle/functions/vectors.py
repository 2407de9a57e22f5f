"""Vector expressions on array<float> columns, in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _squares(v: Column) -> Column:
    return F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x)


def norm(v: Column) -> Column:
    return F.sqrt(_squares(v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, from -1 to 1; null where a vector is null or zero or the lengths differ.

    One root of both squares: that of equal whole numbers is exact, and equal vectors are at no distance.
    """
    likeness = F.try_divide(dot(a, b), F.sqrt(_squares(a) * _squares(b)))
    within = lambda x: F.when(F.isnan(x), x).when(x > 1, F.lit(1.0)).when(x < -1, F.lit(-1.0)).otherwise(x)
    return F.when(F.size(a) == F.size(b), F.get(F.transform(F.array(likeness), within), F.lit(0)))


def truncate_normalise(v: Column, size: int | None) -> Column:
    """The first ``size`` components scaled to unit length; a zero vector stays; None leaves the vector as it is."""
    if size is None:
        return v
    cut = doubles(F.slice(v, 1, size))
    length = F.aggregate(cut, F.lit(0.0), lambda s, x: s + x * x)
    return F.transform(cut, lambda x: x / F.sqrt(F.when(length == 0, F.lit(1.0)).otherwise(length)))
