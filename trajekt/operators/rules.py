"""I: sequence alignment, rule joins, interval decisions and order-dependent de-duplication."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import count_where


def violations(df: DataFrame, entity: Sequence[str], checks: Mapping[str, Column]) -> DataFrame:
    """One row per entity and violated check: contract validation as a query."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in checks.items()]))
    return df.select(*entity, F.explode(found).alias("violation"))


def positional_alignment(segments: DataFrame, session: str, ordinal: str, segment: str, movements: Sequence[str]) -> DataFrame:
    """Segments paired with the expected movements by position; the surplus of either side is reported.

    The expected list is the specification's own (fixed, short) list, so it rides along as a literal.
    """
    names = F.array(*map(F.lit, movements))
    matched = segments.select(
        session, F.col(ordinal).alias("position"), segment, F.get(names, F.col(ordinal).cast("int")).alias("movement_id")
    )
    counts = segments.groupBy(session).agg(F.count(F.lit(1)).alias("__n"))
    rest = counts.where(F.col("__n") < len(movements)).withColumn(
        "position", F.explode(F.sequence(F.col("__n"), F.lit(len(movements) - 1).cast("long")))
    )
    missing = rest.select(session, "position", F.lit(None).cast(dict(segments.dtypes)[segment]).alias(segment), F.get(names, F.col("position").cast("int")).alias("movement_id"))
    both = matched.unionByName(missing)
    issue = F.when(F.col(segment).isNull(), "unmatched_movement").when(F.col("movement_id").isNull(), "unmatched_segment").otherwise("aligned")
    return both.withColumn("issue", issue)


def position_costs(segments: DataFrame, start: str, end: str, frame_count: str, movements: int) -> DataFrame:
    """Adds ``costs``: distance between the segment's relative middle and each movement slot."""
    where = (F.col(start) + F.col(end)) / 2 / F.when(F.col(frame_count) > 0, F.col(frame_count))
    slots = F.array(*[F.lit((j + 0.5) / movements) for j in range(movements)])
    return segments.withColumn("costs", F.transform(slots, lambda s: F.abs(F.coalesce(where, F.lit(0.0)) - s)))


def pose_costs(poses: DataFrame, expected: DataFrame, spec: str, pts: str = "pts") -> DataFrame:
    """Adds ``costs``: mean joint distance to every expected pose over the joints both show (NULL = none in common).

    ``expected`` has one row per specification with its poses as an array; the join is on the specification.
    """

    def distance(exp: Column) -> Column:
        gaps = F.filter(
            F.zip_with(pts, exp, lambda a, b: F.sqrt((a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2 + (a["z"] - b["z"]) ** 2)),
            lambda d: d.isNotNull(),
        )
        return F.when(F.size(gaps) > 0, F.aggregate(gaps, F.lit(0.0), lambda s, d: s + d) / F.size(gaps))

    return poses.join(expected, spec).withColumn("costs", F.transform("expected", distance)).drop("expected")


def pairwise_min_gap(expected: DataFrame, spec: str, fraction: float = 0.7, default: float = 0.1) -> DataFrame:
    """Skip penalty per specification: a fraction of the smallest positive distance between two expected poses."""

    def gap(a: Column, b: Column) -> Column:
        d = F.filter(
            F.zip_with(a, b, lambda p, q: F.sqrt((p["x"] - q["x"]) ** 2 + (p["y"] - q["y"]) ** 2 + (p["z"] - q["z"]) ** 2)),
            lambda v: v.isNotNull(),
        )
        mean = F.aggregate(d, F.lit(0.0), lambda s, v: s + v) / F.size(d)
        return F.when(F.size(d) > 0, F.when(mean > 0, mean))

    pairs = F.transform("expected", lambda a: F.array_min(F.transform("expected", lambda b: gap(a, b))))
    smallest = F.array_min(pairs)
    return expected.select(spec, F.coalesce(smallest * fraction, F.lit(default)).alias("skip_penalty"))


def spread_anchors(phases: Column, start: Column, end: Column) -> Column:
    """Phase anchors evenly over a segment, non-decreasing and inside it: a fold over the short phase list."""
    count = F.size(phases)
    span = (end - start).cast("double")

    def step(state, phase):
        i = F.size(state)
        raw = F.when(count == 1, start).otherwise(start + F.rint(span * i / (count - 1)).cast("long"))
        raw = F.greatest(start, F.least(end, raw))
        last = F.when(i > 0, F.try_element_at(state, F.lit(-1))["frame"]).otherwise(start - 1)
        frame = F.least(F.when(raw <= last, last + 1).otherwise(raw), end)
        return F.concat(state, F.array(F.struct(phase.alias("phase"), frame.cast("long").alias("frame"))))

    empty = F.array().cast("array<struct<phase:string,frame:bigint>>")
    return F.aggregate(phases, empty, step)


def automatic_timeline(path: DataFrame, segments: DataFrame, session: str, margin: float = 0.03) -> DataFrame:
    """One timeline row per segment with a match: its cheapest movement, confidence and label state.

    ``segments`` carries start_frame, end_frame, phases and skip_penalty.
    """
    pairs = path.where("segment IS NOT NULL")
    best = pairs.groupBy(session, "segment").agg(F.min(F.struct("cost", "movement")).alias("b"))
    near = lambda c: F.abs(c - F.col("skip_penalty")) <= margin
    limits = segments.select(session, "skip_penalty").distinct()
    unsure = pairs.join(limits, session).where(near(F.col("cost"))).select(session, "movement").distinct().withColumn("unsure", F.lit(True))
    rows = best.select(session, "segment", F.col("b.movement").alias("movement"), F.col("b.cost").alias("cost"))
    rows = rows.join(unsure, [session, "movement"], "left").join(segments, [session, "segment"])
    doubtful = F.coalesce("unsure", F.lit(False))
    base = F.when(F.col("skip_penalty") > 0, F.greatest(F.lit(0.0), 1.0 - F.col("cost") / (2.0 * F.col("skip_penalty")))).otherwise(1.0)
    score = F.least(F.greatest(base, F.when(doubtful, 0.6).otherwise(0.5)), F.lit(0.99))
    return rows.select(
        session, "segment", "movement", "start_frame", "end_frame", F.rint(score * 10000).alias("__c"),
        F.when(doubtful, "ambiguous").otherwise("confirmed").alias("label_status"),
        spread_anchors(F.col("phases"), F.col("start_frame"), F.col("end_frame")).alias("anchors"),
    ).withColumn("confidence", F.col("__c") / 10000).drop("__c")


def rule_applies(stances: Column, techniques: Column, stance: Column, used: Column) -> Column:
    """Empty selector = any."""
    return ((F.size(stances) == 0) | F.array_contains(stances, stance)) & ((F.size(techniques) == 0) | F.arrays_overlap(techniques, used))


def interval_status(operator: Column, lo: Column, hi: Column, guard: Column, value: Column, uncertainty: Column, floor: Column) -> Column:
    """Confirmed only when the whole interval lies outside the guarded limit, inside only when wholly inside."""
    u = F.greatest(F.coalesce(uncertainty, F.lit(0.0)), floor)
    low, high = value - u, value + u
    above = (low > hi + guard)
    outside = F.when(operator == "max", above).otherwise(above | (high < lo - guard))
    inside = F.when(operator == "max", high <= hi - guard).otherwise((low >= lo + guard) & (high <= hi - guard))
    return (
        F.when(value.isNull(), "not_measurable").when(outside, "confirmed_minor").when(inside, "within_range").otherwise("boundary_uncertain")
    )


def first_eligible(df: DataFrame, unit: Sequence[str], order: Column, eligible: Column, out: str = "is_first") -> DataFrame:
    """Marks the first eligible row of every unit in the given order (its order is ``first_order``). The winner is a map-side combined
    minimum joined back, so a unit with very many rows never sits in one task."""
    tagged = df.withColumns({"__o": order, "__e": eligible})
    winner = tagged.where("__e").groupBy(*[F.col(k).alias(f"__k_{k}") for k in unit]).agg(F.min("__o").alias("__w"))
    cond = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in unit]
    joined = tagged.join(winner, cond, "left").drop(*[f"__k_{k}" for k in unit])
    return joined.withColumn(out, F.coalesce(F.col("__e") & (F.col("__o") == F.col("__w")), F.lit(False))).drop("__o", "__e").withColumnRenamed("__w", "first_order")


def summarise(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """count / median / min / max and the inclusive quartile range (four samples or more)."""
    from .quantiles import exact_quantiles

    keys = list(keys)
    plain = df.groupBy(*keys).agg(F.count(value).alias("sample_count"), F.min(value).alias("min_value"), F.max(value).alias("max_value"))
    q = exact_quantiles(df, keys, F.col(value), {"__q1": 0.25, "median": 0.5, "__q3": 0.75})
    iqr = F.when(F.col("sample_count") >= 4, F.col("__q3") - F.col("__q1"))
    return plain.join(q, keys, "left").withColumn("iqr", iqr).drop("__q1", "__q3")


def status_counts(df: DataFrame, keys: Sequence[str], column: str, names: Sequence[str]) -> list[Column]:
    return [count_where(F.col(column) == n).alias(f"n_{n}") for n in names]
