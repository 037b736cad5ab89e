"""Null rules and lenient conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_greatest(left: Column, right: Column) -> Column:
    """Larger value, null if either side is null (Spark's ``greatest`` skips nulls)."""
    return F.when(left.isNotNull() & right.isNotNull(), F.greatest(left, right))


def lenient(text: Column, dtype: str) -> Column:
    """Null instead of an error for text that is not of the type."""
    return text.try_cast(dtype)


def kilograms(grams: Column) -> Column:
    return F.round(grams / F.lit(1000.0), 3)


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def sum_if(condition: Column, weight: Column | None = None) -> Column:
    """Sum of 1 (or of a row weight) where the condition holds, 0 elsewhere."""
    value = F.lit(1).cast("bigint") if weight is None else weight
    return F.sum(F.when(condition, value).otherwise(F.lit(0).cast("bigint")))


def nulls_last(**directions: str) -> list[Column]:
    """Sort keys with nulls at the end in both directions, as the reports order them."""
    return [F.col(c).desc_nulls_last() if d == "desc" else F.col(c).asc_nulls_last() for c, d in directions.items()]
