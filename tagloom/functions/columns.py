"""Small column helpers used by every plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp01(c: Column) -> Column:
    """Clamp to [0, 1]; a missing value counts as 0."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def positive(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.coalesce(c, F.lit(0.0)))


def zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def r6(c: Column, name: str) -> Column:
    return F.round(c, 6).alias(name)


def n64(c: Column, name: str) -> Column:
    return c.cast("bigint").alias(name)
