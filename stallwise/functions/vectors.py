"""Vector columns (arrays of float or double)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EPSILON = 1e-10


def l2_norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def normalise(vector: Column) -> Column:
    """Unit length in double precision; the zero vector stays zero."""
    norm = l2_norm(vector)
    return F.transform(vector, lambda x: x.cast("double") / (norm + F.lit(EPSILON)))


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)
