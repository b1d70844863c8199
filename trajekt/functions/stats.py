"""Reusable aggregate builders for groups of bounded size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import as_col


def distribution(value, prefix: str = "") -> list[Column]:
    """count/mean/median/p95/max in one pass. ``percentile`` keeps the group's distinct values in
    memory, so use it where the group is bounded (a frame, a window); see
    ``operators.quantiles`` for unbounded groups."""
    value = as_col(value)
    return [
        F.count(value).alias(f"{prefix}count"),
        F.avg(value).alias(f"{prefix}mean"),
        F.median(value).alias(f"{prefix}median"),
        F.percentile(value, F.lit(0.95)).alias(f"{prefix}p95"),
        F.max(value).alias(f"{prefix}max"),
    ]
