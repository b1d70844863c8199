"""Exact quantiles of groups too large for one task.

``percentile`` keeps every distinct value of a group in memory. Here a coarse order-preserving bucket is
counted first (map-side combined) and finds where each wanted rank falls, an even split of that bucket's
own range narrows it down, and only the values of the part with the rank are counted and ordered exactly.
Linear interpolation between the two neighbouring ranks. NaN and infinities count as missing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import finite
from ..session import materialise

#: Even parts of a bucket; values that crowd in one bucket still spread over them.
PARTS = 4096


def value_bucket(value: Column, per_octave: int = 64) -> Column:
    """Monotone bucket number: logarithmic in the magnitude, so at most ~2·2100·per_octave buckets exist."""
    magnitude = F.abs(value)
    level = F.floor((F.log2(F.greatest(magnitude, F.lit(1e-300))) + 1024.0) * per_octave)
    return F.when(value > 0, level).when(value < 0, -level).otherwise(F.lit(0)).cast("int")


def _parts(values: DataFrame, buckets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The values of the wanted buckets with the even part __p of their bucket that holds them."""
    share = (F.col("__v") - F.col("__low")) / (F.col("__high") - F.col("__low"))
    part = F.when(F.col("__high") > F.col("__low"), F.least(F.floor(share * PARTS), F.lit(PARTS - 1))).otherwise(0).cast("int")
    return values.join(buckets, [*keys, "__b"]).withColumn("__p", part).drop("__low", "__high")


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: Column, probs: Mapping[str, float]
) -> DataFrame:
    """One row per key with one column per wanted quantile; groups without values do not appear."""
    keys = list(keys)
    # three passes read the values; no pass holds more of them than a task's buckets and the parts with a wanted rank
    values = df.select(*keys, finite(value.cast("double")).alias("__v")).where(F.col("__v").isNotNull())
    source = materialise(values, "values").withColumn("__b", value_bucket(F.col("__v")))
    anchor = keys or [F.lit(0)]
    by_bucket = Window.partitionBy(*anchor).orderBy("__b")
    histogram = (
        source.groupBy(*keys, "__b")
        .agg(F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
        .withColumn("__before", F.coalesce(F.sum("__n").over(by_bucket.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("__total", F.sum("__n").over(Window.partitionBy(*anchor)))
    )

    def ranks(p: float) -> tuple[Column, Column, Column]:
        position = (F.col("__total") - 1) * F.lit(float(p))
        return F.floor(position), F.ceil(position), position - F.floor(position)

    def inside(rank: Column, start: Column, count: Column) -> Column:
        return (rank >= start) & (rank < start + count)

    wanted = F.lit(False)
    for p in probs.values():
        low, high, _ = ranks(p)
        wanted = wanted | inside(low, F.col("__before"), F.col("__n")) | inside(high, F.col("__before"), F.col("__n"))
    near = _parts(source, materialise(histogram.where(wanted).drop("__n"), "buckets"), keys)
    by_part = Window.partitionBy(*keys, "__b").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    parts = near.groupBy(*keys, "__b", "__p").agg(F.count(F.lit(1)).alias("__n"), F.max("__before").alias("__before"), F.max("__total").alias("__total"))
    parts = parts.withColumn("__before", F.col("__before") + F.coalesce(F.sum("__n").over(by_part), F.lit(0))).where(wanted).drop("__n")
    ordered = Window.partitionBy(*keys, "__b", "__p").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    inner = near.drop("__before", "__total").join(parts, [*keys, "__b", "__p"])
    exact = inner.groupBy(*keys, "__b", "__p", "__before", "__total", "__v").agg(F.count(F.lit(1)).alias("__m")).withColumn(
        "__start", F.col("__before") + F.coalesce(F.sum("__m").over(ordered), F.lit(0))
    )
    aggregates = []
    for name, p in probs.items():
        low, high, fraction = ranks(p)
        at = lambda rank: F.max(F.when(inside(rank, F.col("__start"), F.col("__m")), F.col("__v")))
        aggregates += [at(low).alias(f"__lo_{name}"), at(high).alias(f"__hi_{name}"), F.max(fraction).alias(f"__fr_{name}")]
    picked = exact.groupBy(*keys).agg(*aggregates)
    return picked.select(
        *keys,
        *[
            (F.col(f"__lo_{n}") + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * F.col(f"__fr_{n}")).alias(n)
            for n in probs
        ],
    )


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per-group values back on the rows. No hint: AQE broadcasts the small side from its measured
    size and otherwise splits a skewed key."""
    return df.join(stats, list(keys), "left")


def median_mad(df: DataFrame, keys: Sequence[str], value: Column, median: str = "median", mad: str = "mad") -> DataFrame:
    """Median and median absolute deviation per key."""
    keys = list(keys)
    base = df.select(*keys, value.alias("__x"))
    center = exact_quantiles(base, keys, F.col("__x"), {median: 0.5})
    spread = exact_quantiles(base.join(center, keys), keys, F.abs(F.col("__x") - F.col(median)), {mad: 0.5})
    return center.join(spread, keys)


def weighted_median(df: DataFrame, keys: Sequence[str], value: Column, weight: Column, out: str = "weighted_median") -> DataFrame:
    """Smallest value whose cumulative weight reaches half of the total; not interpolated."""
    keys = list(keys)
    counts = (
        df.select(*keys, finite(value.cast("double")).alias("__v"), finite(weight.cast("double")).alias("__w"))
        .where("__v IS NOT NULL AND __w > 0")
        .withColumn("__b", value_bucket(F.col("__v")))
        .groupBy(*keys, "__b", "__v").agg(F.sum("__w").alias("__m"))
    )
    by_bucket = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    histogram = (
        counts.groupBy(*keys, "__b").agg(F.sum("__m").alias("__n"))
        .withColumn("__before", F.coalesce(F.sum("__n").over(by_bucket), F.lit(0.0)))
        .withColumn("__half", 0.5 * F.sum("__n").over(Window.partitionBy(*keys)))
    )
    # the first bucket that reaches half, or the last one if rounding keeps every sum just below it
    reach = F.struct(F.when(F.col("__before") + F.col("__n") >= F.col("__half"), 0).otherwise(1), F.when(F.col("__before") + F.col("__n") >= F.col("__half"), F.col("__b")).otherwise(-F.col("__b")))
    target = histogram.groupBy(*keys).agg(F.min_by(F.struct("__b", "__before", "__half"), reach).alias("__t")).select(*keys, "__t.*")
    ordered = Window.partitionBy(*keys, "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    inside = counts.join(target, [*keys, "__b"]).withColumn("__cum", F.col("__before") + F.sum("__m").over(ordered))
    return inside.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(F.col("__cum") >= F.col("__half"), F.col("__v"))), F.max("__v")).alias(out)
    )
