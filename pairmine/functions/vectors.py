"""Vector expressions over array columns; all arithmetic in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the smallest norm a vector is divided by, so that a zero vector stays zero.
NORM_FLOOR = 1e-12


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def l2_norm(vector: Column) -> Column:
    squares = F.aggregate(
        vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")
    )
    return F.sqrt(squares)


def l2_normalise(vector: Column) -> Column:
    norm = F.greatest(l2_norm(vector), F.lit(NORM_FLOOR))
    return F.transform(vector, lambda x: x.cast("double") / norm)


def round6(value: Column) -> Column:
    """Six decimal places, without a negative zero."""
    rounded = F.round(value, 6)
    return F.when(rounded == 0, F.lit(0.0)).otherwise(rounded)
