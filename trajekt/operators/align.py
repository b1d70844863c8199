"""B: time alignment and joins between streams.

Nearest, tolerance and interval joins are one union ordered by time plus a block-wise carry: linear
in the rows, never a range join that compares all pairs.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import count_where
from .blocks import carry, expand_range, ordinal, with_halo
from .quantiles import attach, exact_quantiles, median_mad


def common_timeline(streams: DataFrame, session: str, stream: str, t: str, period: float) -> DataFrame:
    """Evenly spaced times covered by every stream of a session: columns ``output_idx``, ``target_t``.
    Sessions with one stream, a stream with one sample, or no overlap have none."""
    ends = streams.groupBy(session, stream).agg(F.min(t).alias("__a"), F.max(t).alias("__z"), F.count(F.lit(1)).alias("__n"))
    span = ends.groupBy(session).agg(
        F.max("__a").alias("__start"), F.min("__z").alias("__end"), F.count(F.lit(1)).alias("__k"), F.min("__n").alias("__least")
    ).where("__k >= 2 AND __least >= 2 AND __end > __start")
    count = F.floor((F.col("__end") - F.col("__start")) / period + 1e-9)
    rows = expand_range(span, [session], F.lit(0), count, "output_idx")
    rows = rows.withColumn("target_t", (F.col("__start") + F.rint(F.col("output_idx") * F.lit(float(period)))).cast("long"))
    return rows.where("target_t <= __end").select(session, "output_idx", "target_t")


def bracket(
    targets: DataFrame, sources: DataFrame, keys: Sequence[str], t: str, payload: Sequence[str], block: Column, equal_is_before: bool = False
) -> DataFrame:
    """Targets with the neighbouring sources as structs ``prev`` and ``next`` (t plus payload).

    A source at exactly the target's time counts as ``next``, or as ``prev`` with ``equal_is_before``.
    """
    keys = list(keys)
    rank = {"target": 1, "source": 0} if equal_is_before else {"target": 0, "source": 1}
    fields = [t, *payload]
    extra = [c for c in targets.columns if c not in keys and c != t]
    left = targets.select(*keys, t, F.lit(rank["target"]).alias("__side"), F.struct(*(extra or [F.lit(1).alias("one")])).alias("__t"),
                          F.lit(None).cast(_struct_type(sources, fields)).alias("__s"))
    right = sources.select(*keys, t, F.lit(rank["source"]).alias("__side"), F.lit(None).cast(_struct_type(targets, extra)).alias("__t"),
                           F.struct(*fields).alias("__s"))
    both = left.unionByName(right)
    filled = carry(both, keys, [t, "__side"], block, last={"prev": F.col("__s")}, first={"next": F.col("__s")})
    return filled.where(F.col("__side") == rank["target"]).select(*keys, t, *[F.col(f"__t.{c}").alias(c) for c in extra], "prev", "next")


def _struct_type(df: DataFrame, names: Sequence[str]) -> str:
    kinds = dict(df.dtypes)
    if not names:
        return "struct<one:int>"
    return "struct<" + ",".join(f"`{n}`:{kinds[n]}" for n in names) + ">"


def nearest(targets: DataFrame, sources: DataFrame, keys: Sequence[str], t: str, payload: Sequence[str], block: Column) -> DataFrame:
    """Every target with its closest source as struct ``near``; a tie takes the earlier one."""
    rows = bracket(targets, sources, keys, t, payload, block)
    before, after = F.col(t) - F.col(f"prev.{t}"), F.col(f"next.{t}") - F.col(t)
    pick = F.when(F.col("prev").isNull(), F.col("next")).when(F.col("next").isNull() | (before <= after), F.col("prev")).otherwise(F.col("next"))
    return rows.withColumn("near", pick).drop("prev", "next")


def mapping_report(mapping: DataFrame, sources: DataFrame, keys: Sequence[str], t: str, source_id: str, period: float, unit: float) -> DataFrame:
    """Per series: unused and reused sources, repeated outputs, residual statistics."""
    keys = list(keys)
    residual = F.abs(F.col(f"near.{t}") - F.col(t)) / unit
    rows = mapping.where("near IS NOT NULL").select(*keys, F.col(f"near.{source_id}").alias("__src"), residual.alias("__r"))
    use = rows.groupBy(*keys, "__src").agg(F.count(F.lit(1)).alias("__c"))
    reuse = use.groupBy(*keys).agg(
        count_where(F.col("__c") > 1).alias("source_reused"), F.sum(F.col("__c") - 1).alias("repeated_outputs"),
        F.count(F.lit(1)).alias("__used"), F.sum("__c").alias("output_count"),
    )
    total = sources.groupBy(*keys).agg(F.count(F.lit(1)).alias("source_count"))
    worst = rows.groupBy(*keys).agg(F.max("__r").alias("max_residual"), count_where(F.col("__r") > 0.75 * period / unit).alias("large_residuals"))
    q = exact_quantiles(rows, keys, F.col("__r"), {"median_residual": 0.5, "p95_residual": 0.95})
    out = total.join(reuse, keys).join(worst, keys).join(q, keys)
    return out.withColumn("source_unused", F.col("source_count") - F.col("__used")).drop("__used")


def synchronised_frames(cameras: DataFrame, session: str, camera: str, target_fps: Column | None = None) -> DataFrame:
    """Global frames for which every camera has a local frame (columns frame_count, fps, frame_offset, time_offset_sec)."""
    offset = F.col("time_offset_sec") + F.col("frame_offset") / F.col("fps")
    cams = cameras.withColumns({"__off": offset, "__end": offset + (F.col("frame_count") - 1) / F.col("fps")})
    span = cams.groupBy(session).agg(
        F.max("__off").alias("__s"), F.min("__end").alias("__e"), F.min("fps").alias("__f"), F.count(F.lit(1)).alias("__cams"),
        F.min("frame_count").alias("__least"),
        F.collect_list(F.struct(camera, "frame_count", "fps", "__off")).alias("__rig"),
    ).where("__least > 0")
    span = span.withColumn("__f", target_fps if target_fps is not None else F.col("__f"))
    first, last = F.ceil(F.col("__s") * F.col("__f") - 1e-9), F.floor(F.col("__e") * F.col("__f") + 1e-9)
    rows = expand_range(span, [session], first, last, "global_frame_idx").withColumn("t_sec", F.col("global_frame_idx") / F.col("__f"))
    # the rig (a handful of cameras) travels with the session row, so keeping only complete frames needs no shuffle
    local = F.transform(
        "__rig",
        lambda c: F.struct(
            c[camera].alias(camera), F.rint((F.col("t_sec") - c["__off"]) * c["fps"]).cast("long").alias("local_frame_idx"), c["frame_count"].alias("n")
        ),
    )
    rows = rows.withColumn("__local", local).where(F.forall("__local", lambda c: (c["local_frame_idx"] >= 0) & (c["local_frame_idx"] < c["n"])))
    return rows.select(session, "global_frame_idx", "t_sec", F.explode("__local").alias("__c")).select(
        session, "global_frame_idx", "t_sec", F.col(f"__c.{camera}").alias(camera), F.col("__c.local_frame_idx").alias("local_frame_idx")
    )


def match_one_to_one(predicted: DataFrame, truth: DataFrame, keys: Sequence[str], t: str, pred_order: str, truth_id: str, tolerance: float, block: Column) -> DataFrame:
    """Nearest truth within the tolerance; a truth serves only its earliest prediction, later ones drop out."""
    keys = list(keys)
    near = nearest(predicted, truth, keys, t, [truth_id], block)
    delta = F.col(f"near.{t}") - F.col(t)
    kept = near.where(F.abs(delta) <= tolerance).select(
        *keys, F.col(f"near.{truth_id}").alias(truth_id), F.struct(F.col(pred_order), F.col(t).alias("pred_t"), delta.alias("delta")).alias("__p")
    )
    first = kept.groupBy(*keys, truth_id).agg(F.min("__p").alias("__p"))
    return first.select(*keys, truth_id, F.col(f"__p.{pred_order}").alias(pred_order), F.col("__p.pred_t").alias("pred_t"), F.col("__p.delta").alias("delta"))


def inferred_rate(df: DataFrame, keys: Sequence[str], idx: str, t: str, out: str = "fps") -> DataFrame:
    """1 / median of the positive steps."""
    stepped = with_halo(df, keys, idx, 1, 0, lambda w: {"__d": F.col(t) - F.lag(t).over(w)})
    q = exact_quantiles(stepped, keys, F.when(F.col("__d") > 0, F.col("__d")), {"__m": 0.5})
    return q.select(*keys, (1.0 / F.col("__m")).alias(out))


class Pool:
    """Unused detections of a stream in time order. What lies before the window of the reference asked last is dropped, as references come in order."""

    def __init__(self):
        self.times, self.ids, self.start = [], [], 0

    def add(self, when, ident) -> None:
        self.times.append(when)
        self.ids.append(ident)

    def nearest(self, when, tolerance):
        """Place of the detection nearest to a time, the earlier and first added of equal ones; None if none is near enough."""
        times = self.times
        self.start = bisect_left(times, when - tolerance, self.start)
        if self.start > 4096 and 2 * self.start > len(times):
            del self.times[: self.start], self.ids[: self.start]
            self.start = 0
        right = bisect_left(times, when, self.start)
        left = bisect_left(times, times[right - 1], self.start) if right > self.start else None
        right = right if right < len(times) and times[right] - when <= tolerance else None
        if left is None or right is None:
            return right if left is None else left
        return left if when - times[left] <= times[right] - when else right

    def take(self, place: int):
        del self.times[place]
        return self.ids.pop(place)


def greedy_match(detections: DataFrame, session: str, stream: str, t: str, det: str, reference: str, streams: Sequence[str], tolerance: float, block: Column) -> DataFrame:
    """Reference detections matched in time order with the nearest unused detection of every other stream.

    A choice commits only if all streams match, so the scan depends on its order. It runs separately on
    every stretch of time that no gap longer than the tolerance crosses (stretches cannot influence each
    other), keeps only the detections of the current tolerance window in memory and finds each choice by bisection.
    """
    others = [s for s in streams if s != reference]
    placed = ordinal(detections, [session], [t, stream, det], block, "__pos")
    gapped = with_halo(placed, [session], "__pos", 1, 0, lambda w: {"__gap": F.col(t) - F.lag(t).over(w)})
    opened = F.when(F.col("__gap").isNull() | (F.col("__gap") > tolerance), F.col("__pos"))
    parts = carry(gapped, [session], ["__pos"], F.floor(F.col("__pos") / 4096), last={"__part": opened})
    ordered = parts.select(session, "__part", stream, t, det).repartition(session, "__part").sortWithinPartitions(session, "__part", t, stream, det)
    kinds = dict(detections.dtypes)
    schema = f"{session} {kinds[session]}, reference {kinds[det]}, " + ", ".join(f"{o} {kinds[det]}" for o in others)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, refs, pools = None, deque(), {}

        def flush(until) -> list[tuple]:
            done = []
            while refs and (until is None or refs[0][0] + tolerance < until):
                when, ident = refs.popleft()
                choice = [pools[o].nearest(when, tolerance) for o in others]
                if all(c is not None for c in choice):
                    done.append((key[0], ident, *[pools[o].take(c) for o, c in zip(others, choice)]))
            return done

        for pdf in batches:
            found: list[tuple] = []
            for who, part, name, when, ident in zip(pdf[session], pdf["__part"], pdf[stream], pdf[t], pdf[det]):
                if key != (who, part):
                    found += flush(None)
                    key, pools = (who, part), {o: Pool() for o in others}
                found += flush(when)
                if name == reference:
                    refs.append((when, ident))
                elif name in pools:
                    pools[name].add(when, ident)
            yield pd.DataFrame(found, columns=[session, "reference", *others])
        yield pd.DataFrame(flush(None), columns=[session, "reference", *others])

    return ordered.mapInPandas(scan, schema)


def stride_sample(df: DataFrame, keys: Sequence[str], idx: str, stride: int) -> DataFrame:
    """Every ``stride``-th position with the number of positions it stands for (the last may be short)."""
    total = df.groupBy(*keys).agg((F.max(idx) + 1).alias("__n"))
    rows = attach(df.where(F.pmod(F.col(idx), F.lit(stride)) == 0), total, keys)
    return rows.withColumns(
        {"sample": (F.col(idx) / stride).cast("long"), "repeat": F.greatest(F.least(F.lit(stride), F.col("__n") - F.col(idx)), F.lit(1)).cast("int")}
    ).drop("__n")


def upsample(samples: DataFrame, keys: Sequence[str], sample: str, repeat: str, linear: Sequence[str], held: Sequence[str]) -> DataFrame:
    """Back to full rate: linear columns are interpolated towards the next sample, held ones repeated."""
    ahead = with_halo(samples, keys, sample, 0, 1, lambda w: {f"__n_{c}": F.lead(c).over(w) for c in linear} | {"__more": F.lead(sample).over(w)})
    rows = ahead.withColumn("offset", F.explode(F.sequence(F.lit(0), F.greatest(F.col(repeat), F.lit(1)) - 1)))
    w = F.col("offset") / F.greatest(F.col(repeat), F.lit(1))
    moved = {c: F.when(F.col("__more").isNull(), F.col(c)).otherwise((1.0 - w) * F.col(c) + w * F.col(f"__n_{c}")) for c in linear}
    return rows.withColumns(moved).select(*keys, sample, "offset", *linear, *held)


def interpolate_between(prev: str, nxt: str, at: Column, t: str, value: str, valid: str, person: str) -> tuple[Column, Column]:
    """Value and validity at a time between two samples; across different persons the nearer sample wins."""
    a, b = F.col(prev), F.col(nxt)
    a_known, b_known = a.isNotNull(), b.isNotNull()
    span = F.col(f"{nxt}.{t}") - F.col(f"{prev}.{t}")
    w = F.when(a_known & b_known & (span > 0), F.least(F.greatest((at - F.col(f"{prev}.{t}")) / span, F.lit(0.0)), F.lit(1.0)))
    w = F.when(~a_known, 1.0).when(~b_known, 0.0).otherwise(F.coalesce(w, F.lit(0.0)))
    same = F.col(f"{prev}.{person}").eqNullSafe(F.col(f"{nxt}.{person}")) | ~a_known | ~b_known
    take_a = (w <= 1e-12) | (~same & (w < 0.5))
    take_b = (w >= 1.0 - 1e-12) | (~same & (w >= 0.5))
    va, vb = F.col(f"{prev}.{value}"), F.col(f"{nxt}.{value}")
    ok = F.when(take_a, F.col(f"{prev}.{valid}")).when(take_b, F.col(f"{nxt}.{valid}")).otherwise(F.col(f"{prev}.{valid}") & F.col(f"{nxt}.{valid}"))
    mixed = F.when(take_a, va).when(take_b, vb).when(F.col(f"{prev}.{valid}") & F.col(f"{nxt}.{valid}"), (1.0 - w) * va + w * vb)
    return mixed, ok


def label_frames(frames: DataFrame, segments: DataFrame, keys: Sequence[str], frame: str, payload: Sequence[str], block: Column) -> DataFrame:
    """Label of the interval containing each frame. Intervals (start_frame, end_frame, anchors) do not
    overlap, so the candidate is the last one that started: an as-of join plus one comparison."""
    src = segments.withColumnRenamed("start_frame", frame)
    rows = bracket(frames, src, keys, frame, ["end_frame", "anchors", *payload], block, equal_is_before=True)
    inside = F.coalesce(F.col("prev.end_frame") >= F.col(frame), F.lit(False))
    passed = F.filter("prev.anchors", lambda a: a["frame"] <= F.col(frame))
    anchors = F.col("prev.anchors")
    phase = F.when(F.size(anchors) == 0, "unlabeled_phase").when(F.size(passed) > 0, F.try_element_at(passed, F.size(passed))["phase"]).otherwise(
        F.try_element_at(anchors, F.lit(1))["phase"]
    )
    labels = {c: F.when(inside, F.col(f"prev.{c}")) for c in payload}
    return rows.withColumns({**labels, "phase": F.when(inside, phase)}).drop("prev", "next")


def expand_events(events: DataFrame, keys: Sequence[str], start: str, end: str, frame: str = "frame") -> DataFrame:
    return expand_range(events, keys, F.col(start), F.col(end), frame)


def shift_scan(df: DataFrame, keys: Sequence[str], series: Sequence[str], idx: str, observed: Sequence[str], projected: Sequence[str], max_shift: int, length: str) -> DataFrame:
    """Median and p95 distance of stream A shifted by -m..m positions against stream B.

    Neighbours come from a bounded window, so no self-join; ``length`` (positions per series) caps m at a quarter.
    """

    def build(w):
        out = {}
        for s in range(-max_shift, max_shift + 1):
            shifted = [F.col(c) if s == 0 else (F.lead(c, s) if s > 0 else F.lag(c, -s)).over(w) for c in observed]
            out[f"__s{s + max_shift}"] = F.sqrt(sum(((a - F.col(b)) ** 2 for a, b in zip(shifted, projected)), F.lit(0.0)))
        return out

    wide = with_halo(df, [*keys, *series], idx, max_shift, max_shift, build)
    pairs = ", ".join(f"{s}, __s{s + max_shift}" for s in range(-max_shift, max_shift + 1))
    tall = wide.select(*keys, length, F.expr(f"stack({2 * max_shift + 1}, {pairs}) AS (shift, v)"))
    tall = tall.where((F.abs("shift") <= F.floor(F.col(length) / 4)) & F.col("v").isNotNull())
    return exact_quantiles(tall, [*keys, "shift"], F.col("v"), {"median_error": 0.5, "p95_error": 0.95})


def robust_standardise(df: DataFrame, keys: Sequence[str], value: str, out: str = "standard") -> DataFrame:
    """(x - median) / (1.4826 MAD), falling back to the deviation, then to 1."""
    keys = list(keys)
    spread = median_mad(df, keys, F.col(value), "__med", "__mad")
    spread = spread.join(df.groupBy(*keys).agg(F.stddev_pop(value).alias("__std")), keys)
    scale = F.when(1.4826 * F.col("__mad") > 1e-8, 1.4826 * F.col("__mad")).when(F.col("__std") > 1e-8, F.col("__std")).otherwise(1.0)
    return attach(df, spread, keys).withColumn(out, (F.col(value) - F.col("__med")) / scale).drop("__med", "__mad", "__std")


def motion_signature(points: DataFrame, keys: Sequence[str], joint: str, idx: str, x: str, y: str, taps: int = 7) -> DataFrame:
    """Per frame: median displacement of the features over the body box, gaps filled, ``taps``-point mean with zero padding."""
    keys = list(keys)
    moved = with_halo(
        points, [*keys, joint], idx, 1, 0,
        lambda w: {"__v": F.sqrt((F.col(x) - F.lag(x).over(w)) ** 2 + (F.col(y) - F.lag(y).over(w)) ** 2)},
    )
    known = F.col(x).isNotNull() & F.col(y).isNotNull()
    box = lambda c: F.max(F.when(known, F.col(c))) - F.min(F.when(known, F.col(c)))
    frames = moved.groupBy(*keys, idx).agg(F.sqrt(box(x) ** 2 + box(y) ** 2).alias("__d"), F.median("__v").alias("__m"))
    good = F.when(F.col("__d") > 1e-6, F.col("__d"))
    fallback = exact_quantiles(frames, keys, good, {"__fb": 0.5})
    frames = attach(frames, fallback, keys).withColumn("__sig", F.col("__m") / F.coalesce(good, F.col("__fb"), F.lit(1.0)))
    here = F.when(F.col("__sig").isNotNull(), F.struct(F.col(idx).alias("i"), F.col("__sig").alias("v")))
    filled = carry(frames, keys, [idx], F.floor(F.col(idx) / 4096), last={"__p": here}, first={"__n": here})
    w = (F.col(idx) - F.col("__p.i")) / F.when(F.col("__n.i") > F.col("__p.i"), F.col("__n.i") - F.col("__p.i"))
    line = F.coalesce(F.col("__sig"), F.col("__p.v") + w * (F.col("__n.v") - F.col("__p.v")), F.col("__p.v"), F.col("__n.v"))
    r = taps // 2
    out = with_halo(
        filled.withColumn("__line", line), keys, idx, r, r, lambda win: {"signature": F.sum("__line").over(win.rangeBetween(-r, r)) / float(taps)}
    )
    return out.select(*keys, idx, "signature")


def correlation_scan(signals: DataFrame, session: str, stream: str, idx: str, value: str, max_shift: int, minimum: int = 12) -> DataFrame:
    """Correlation of every stream, shifted, with the median of the others."""
    packed = signals.groupBy(session, idx).agg(F.collect_list(F.struct(stream, value)).alias("__all"))  # one entry per stream of the rig

    def median(array: Column) -> Column:
        ordered = F.array_sort(array)
        n = F.size(ordered)
        return F.when(n > 0, (F.try_element_at(ordered, F.floor((n + 1) / 2).cast("int")) + F.try_element_at(ordered, F.floor((n + 2) / 2).cast("int"))) / 2.0)

    one = packed.select(session, idx, "__all", F.explode("__all").alias("__t"))
    others = F.transform(F.filter("__all", lambda c: c[stream] != F.col(f"__t.{stream}")), lambda c: c[value])
    rows = one.select(session, F.col(f"__t.{stream}").alias(stream), idx, F.col(f"__t.{value}").alias("__x"), median(others).alias("__ref"))

    def build(w):
        return {f"__s{s + max_shift}": F.col("__x") if s == 0 else (F.lead("__x", s) if s > 0 else F.lag("__x", -s)).over(w) for s in range(-max_shift, max_shift + 1)}

    wide = with_halo(rows, [session, stream], idx, max_shift, max_shift, build)
    pairs = ", ".join(f"{s}, __s{s + max_shift}" for s in range(-max_shift, max_shift + 1))
    tall = wide.select(session, stream, "__ref", F.expr(f"stack({2 * max_shift + 1}, {pairs}) AS (shift, v)"))
    both = F.col("v").isNotNull() & F.col("__ref").isNotNull()
    stats = tall.where(both).groupBy(session, stream, "shift").agg(
        F.count(F.lit(1)).alias("__n"), F.stddev_pop("v").alias("__a"), F.stddev_pop("__ref").alias("__b"), F.corr("v", "__ref").alias("correlation")
    )
    return stats.where((F.col("__n") >= minimum) & (F.col("__a") > 1e-8) & (F.col("__b") > 1e-8)).drop("__n", "__a", "__b")


def assess_shift(geo_best_shift: Column, geo_best: Column, geo_zero: Column, motion_shift: Column, motion_best: Column, motion_zero: Column) -> Column:
    known = geo_best.isNotNull() & geo_zero.isNotNull() & motion_best.isNotNull() & motion_zero.isNotNull()
    better = geo_best / F.greatest(geo_zero, F.lit(1e-9)) < 0.75
    agree = F.abs(geo_best_shift - motion_shift) <= 3
    return (
        F.when(~known, "insufficient_evidence")
        .when(better & (motion_best - motion_zero >= 0.15) & agree, "supported")
        .when(better & ~agree, "ambiguous_periodic_motion")
        .otherwise("not_supported")
    )


def compare_timelines(a: DataFrame, b: DataFrame, session: str, idx: str, fields: Sequence[str], exact: Sequence[str] = (), atol: float = 1e-9) -> DataFrame:
    """Per session: positions missing on one side or differing in a field; transferable when there are none."""
    left = a.select(session, idx, *[F.col(c).alias(f"__a_{c}") for c in [*fields, *exact]], F.lit(True).alias("__in_a"))
    right = b.select(session, idx, *[F.col(c).alias(f"__b_{c}") for c in [*fields, *exact]], F.lit(True).alias("__in_b"))
    same = F.lit(True)
    for c in fields:
        same = same & (F.abs(F.col(f"__a_{c}") - F.col(f"__b_{c}")) <= atol)
    for c in exact:
        same = same & F.col(f"__a_{c}").eqNullSafe(F.col(f"__b_{c}"))
    joined = left.join(right, [session, idx], "full_outer")
    missing = F.col("__in_a").isNull() | F.col("__in_b").isNull()
    return joined.groupBy(session).agg(
        count_where(missing).alias("missing"), count_where(~missing & ~F.coalesce(same, F.lit(False))).alias("different")
    ).withColumn("transferable", (F.col("missing") == 0) & (F.col("different") == 0))
