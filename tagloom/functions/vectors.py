"""Vector column expressions. Float inputs are widened before anything is summed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def magnitude(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine, 0 when either norm is 0 or a side is missing."""
    norms = magnitude(a) * magnitude(b)
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def normalised(a: Column) -> Column:
    m = magnitude(a)
    return F.when(m > 0, F.transform(a, lambda x: x.cast("double") / m)).otherwise(F.transform(a, lambda x: x.cast("double")))
