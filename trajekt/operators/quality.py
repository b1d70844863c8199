"""F: validity, readiness, activity and stability of pose sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import count_where, positive_mean, reasons, share
from ..session import materialise
from .blocks import BLOCK_ROWS, index_block, ordinal, runs
from .quantiles import attach, exact_quantiles

READY_RATIO = 0.70
MIN_READY_JOINTS = 12


def validity(points: DataFrame, session: str, frame: str, joint: str, valid: Column, error: str) -> DataFrame:
    """Valid ratio and mean error per frame, per joint and per session in one pass of grouping sets."""
    sets = points.withColumn("__ok", F.when(valid, 1.0).otherwise(0.0)).groupingSets(
        [[session, frame], [session, joint], [session]], session, frame, joint
    )
    return sets.agg(
        F.when(F.grouping(frame) == 0, "frame").when(F.grouping(joint) == 0, "joint").otherwise("session").alias("level"),
        F.avg("__ok").alias("valid_ratio"), F.avg(error).alias("mean_error_px"),
    )


def readiness_columns(valid: Column, score: str, error: str, cameras: str) -> list[Column]:
    return [
        share(valid).alias("valid_ratio"), positive_mean(score).alias("mean_score"),
        F.avg(error).alias("mean_error_px"), positive_mean(cameras).alias("mean_cameras"),
    ]


def ready(ratio: str, min_score: float = 0.20, max_error: float = 25.0) -> Column:
    """All four checks must hold; missing evidence fails."""
    return F.coalesce(
        (F.col(ratio) >= READY_RATIO) & (F.col("mean_score") >= min_score)
        & (F.col("mean_error_px") <= max_error) & (F.col("mean_cameras") >= 2.0),
        F.lit(False),
    )


def motion_threshold(df: DataFrame, keys: Sequence[str], energy: Column, out: str = "threshold") -> DataFrame:
    """Activity threshold per series: median + 2.5 sigma by MAD kept within the quartiles; for a flat
    series mean + half a deviation; NULL where nothing can be active."""
    keys = list(keys)
    base = df.select(*keys, F.when(energy >= 0, energy).alias("__e"))
    center = exact_quantiles(base, keys, F.col("__e"), {"__q2": 0.5, "__q1": 0.25, "__q3": 0.75})
    spread = exact_quantiles(attach(base, center, keys), keys, F.abs(F.col("__e") - F.col("__q2")), {"__mad": 0.5})
    moments = base.groupBy(*keys).agg(F.avg("__e").alias("__mean"), F.stddev_pop("__e").alias("__std"))
    q1, q2, q3 = F.col("__q1"), F.col("__q2"), F.col("__q3")
    robust = F.greatest(F.least(q2 + 2.5 * 1.4826 * F.col("__mad"), q3), q1)
    plain = F.greatest(F.least(F.col("__mean") + 0.5 * F.col("__std"), q3), q1, F.lit(0.0))
    chosen = F.when(F.col("__mad") > 1e-12, robust).when(F.col("__std") > 1e-12, plain).when(q2 > 0, q2)
    return moments.join(center, keys, "left").join(spread, keys, "left").select(*keys, chosen.alias(out))


def activity_segments(
    energy: DataFrame, session: str, idx: str, value: str, fps: float, min_frames: int = 3
) -> DataFrame:
    """Runs of at least ``min_frames`` active frames per session, numbered in time order. Sessions
    without any get one explanatory row."""
    limits = motion_threshold(energy, [session], F.col(value))
    rows = attach(energy, limits, [session])
    active = (F.col(value) >= F.col("threshold")) & (F.col(value) > 0)
    marked = runs(rows, [session], idx, active)
    found = (
        marked.where("run_start IS NOT NULL")
        .groupBy(session, "run_start", "run_end")
        .agg(F.avg(value).alias("mean_motion_energy"))
        .where(F.col("run_end") - F.col("run_start") + 1 >= min_frames)
    )
    # read three times below; orders of magnitude smaller than the frames it comes from
    found = materialise(found, "runs")
    # a run starts at most every min_frames+1 positions, so wide blocks stay small
    numbered = ordinal(found, [session], ["run_start"], index_block("run_start", 16 * BLOCK_ROWS), "segment_id")
    numbered = numbered.select(
        session, "segment_id", F.lit("motion_candidate").alias("label"), F.col("run_start").alias("start_frame"),
        F.col("run_end").alias("end_frame"), (F.col("run_start") / fps).alias("start_time_sec"),
        (F.col("run_end") / fps).alias("end_time_sec"), "mean_motion_energy", F.lit("needs_label").alias("status"),
    )
    sessions = energy.groupBy(session).agg(F.max(idx).alias("__last"), F.count(value).alias("__known"))
    none = sessions.join(numbered.select(session).distinct(), session, "left_anti").select(
        session, F.lit(0).cast("long").alias("segment_id"), F.lit("pending_motion").alias("label"),
        F.lit(0).cast("long").alias("start_frame"), F.when(F.col("__known") > 0, F.col("__last")).otherwise(0).alias("end_frame"),
        F.lit(None).cast("double").alias("start_time_sec"), F.lit(None).cast("double").alias("end_time_sec"),
        F.lit(None).cast("double").alias("mean_motion_energy"),
        F.when(F.col("__known") > 0, "no_stable_segment_found").otherwise("not_enough_motion_data").alias("status"),
    )
    return numbered.unionByName(none)


def readiness_report(frames: DataFrame, joints: DataFrame, segments: DataFrame, session: str) -> DataFrame:
    """Per session: ready share of frames, reliable joints, segment state, warnings in order, status."""
    f = frames.groupBy(session).agg(F.count(F.lit(1)).alias("frame_count"), share(F.col("ready")).alias("ready_frame_ratio"))
    j = joints.groupBy(session).agg(count_where(F.col("ready")).alias("reliable_joint_count"))
    s = segments.groupBy(session).agg(
        F.count(F.lit(1)).alias("segment_count"),
        F.max(F.col("status").isin("not_enough_motion_data", "no_stable_segment_found")).alias("__pending"),
    )
    out = f.join(j, session, "left").join(s, session, "left").withColumn(
        "warnings",
        reasons(
            (F.col("ready_frame_ratio") < READY_RATIO, "too_few_ready_frames"),
            (F.coalesce(F.col("reliable_joint_count"), F.lit(0)) < MIN_READY_JOINTS, "too_few_reliable_joints"),
            (F.coalesce(F.col("__pending"), F.lit(True)), "segments_need_review"),
        ),
    )
    return out.withColumn("status", F.when(F.size("warnings") == 0, "ready").otherwise("needs_review")).drop("__pending")


def reduction_percent(raw: Column, stable: Column) -> Column:
    return F.when(raw > 1e-12, 100.0 * (raw - stable) / raw)


def sensor_consistency(geometry: Column, depth_applied: Column, depth_passed: Column, depth_used: Column) -> Column:
    """passed/failed: geometry must hold, and depth fusion too where it was applied."""
    depth = ~F.coalesce(depth_applied, F.lit(False)) | (
        F.coalesce(depth_passed, F.lit(False)) & F.coalesce(depth_used, F.lit(False))
    )
    return F.when(F.coalesce(geometry, F.lit(False)) & depth, "passed").otherwise("failed")
