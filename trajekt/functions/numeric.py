"""Small numeric Column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(value) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def fixed(value, digits: int = 6) -> Column:
    """Round half up on the binary value; the same IEEE steps in every engine, never -0.0. NaN and infinities become NULL."""
    scale, value = float(10**digits), as_col(value)
    return F.when(F.abs(value) < float("inf"), F.floor(value * scale + 0.5) / scale)


def finite(value) -> Column:
    """NaN and infinities become NULL, once, at ingest."""
    value = as_col(value)
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def clip(value, low, high) -> Column:
    """Clamp, keeping NULL as NULL (least/greatest alone would skip it)."""
    value = as_col(value)
    return F.when(value.isNotNull(), F.least(F.greatest(value, as_col(low)), as_col(high)))


def ratio(num, den, floor: float = 0.0) -> Column:
    """num/den, NULL unless the denominator exceeds ``floor``."""
    den = as_col(den)
    return F.when(den > floor, as_col(num) / den)


def share(predicate: Column) -> Column:
    """Aggregate: fraction of rows where the predicate holds; NULL counts as false."""
    return F.avg(F.when(predicate, 1.0).otherwise(0.0))


def count_where(predicate: Column) -> Column:
    return F.coalesce(F.sum(F.when(predicate, 1).otherwise(0)), F.lit(0)).cast("long")


def positive_mean(value) -> Column:
    value = as_col(value)
    return F.avg(F.when(value > 0, value))


def mean_of(*values: Column) -> Column:
    """Row-wise mean over the non-null arguments, NULL when all are null."""
    total = sum((F.coalesce(v, F.lit(0.0)) for v in values), F.lit(0.0))
    count = sum((F.when(v.isNotNull(), 1).otherwise(0) for v in values), F.lit(0))
    return F.when(count > 0, total / count)


def reasons(*pairs: tuple[Column, str]) -> Column:
    """Array of the names whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in pairs]))
