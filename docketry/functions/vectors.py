"""Column functions over array columns that hold vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    """Scaled to length 1; a zero vector stays as it is."""
    size = norm(a)
    return F.when(size > 0, F.transform(a, lambda x: x.cast("double") / size)).otherwise(F.transform(a, lambda x: x.cast("double")))


def check_dimension(a: Column, size: int) -> Column:
    """The vector, or an error that names both dimensions; null stays null."""
    message = F.concat(F.lit("dimension "), F.size(a).cast("string"), F.lit(f" instead of {size}"))
    return F.when(a.isNull() | (F.size(a) == size), a).otherwise(F.raise_error(message).cast("array<double>"))
