"""G: comparison of predicted with true poses, quality gates and authorisation."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.numeric import reasons
from .blocks import index_block, ordinal, with_halo
from .quantiles import exact_quantiles

# Default acceptance thresholds.
THRESHOLDS = {
    "min_evaluated_frames": 300.0,
    "min_valid_joint_ratio": 0.95,
    "max_mpjpe_mm": 50.0,
    "max_p95_error_mm": 100.0,
    "max_root_relative_mpjpe_mm": 50.0,
    "min_pck_100mm": 0.95,
    "max_angle_mae_deg": 5.0,
    "max_velocity_mae_mps": 0.20,
    "max_acceleration_mae_mps2": 2.0,
    "max_bone_length_cv_percent": 3.0,
}


def check_thresholds(limits: dict[str, float]) -> dict[str, float]:
    merged = {**THRESHOLDS, **limits}
    if merged["min_evaluated_frames"] < 1:
        raise ValueError("min_evaluated_frames must be at least 1")
    for key, value in merged.items():
        top = 1.0 if key in ("min_valid_joint_ratio", "min_pck_100mm") else float("inf")
        if not 0 <= value <= top:
            raise ValueError(f"{key} out of range")
    return merged


def point_error(pred: Sequence[str] = ("x", "y", "z"), truth: Sequence[str] = ("gx", "gy", "gz")) -> Column:
    """Distance in metres, NULL unless both points are complete."""
    return G.distance([F.col(c) for c in pred], [F.col(c) for c in truth])


def share_within(error: Column, limit: float) -> Column:
    return F.avg(F.when(error.isNotNull(), F.when(error <= limit, 1.0).otherwise(0.0)))


def root_relative(matched: DataFrame, keys: Sequence[str], joint: str, left: int, right: int) -> DataFrame:
    """Adds ``root_error``: the distance after removing the hip midpoint of both sides; NULL without both hips.

    A frame has a bounded number of joints, so its group always fits a task.
    """
    whole = point_error().isNotNull()
    hip = lambda side, c: F.max(F.when((F.col(joint) == side) & whole, F.col(c)))
    axes = [*"xyz", "gx", "gy", "gz"]
    roots = matched.groupBy(*keys).agg(*[(0.5 * (hip(left, c) + hip(right, c))).alias(f"__r_{c}") for c in axes])
    out = matched.join(roots, list(keys))
    pred = [F.col(c) - F.col(f"__r_{c}") for c in "xyz"]
    truth = [F.col(c) - F.col(f"__r_{c}") for c in ("gx", "gy", "gz")]
    return out.withColumn("root_error", F.when(whole, G.distance(pred, truth))).drop(*[f"__r_{c}" for c in axes])


def _align(cross: np.ndarray, spread: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Similarity rotation and scale for a stack of 3x3 cross-covariances (row-vector convention)."""
    usable = (count >= 3) & (spread > 1e-12) & np.isfinite(cross).all(axis=(1, 2))
    u, s, vt = np.linalg.svd(np.where(usable[:, None, None], cross, np.eye(3)))
    flip = np.linalg.det(u @ vt) < 0
    u[flip, :, 2] *= -1
    s[flip, 2] *= -1
    scale = np.where(usable, s.sum(axis=1) / np.where(usable, spread, 1.0), np.nan)
    return u @ vt, scale


def procrustes(matched: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``aligned_error``: residual after the best similarity transform of each frame.

    The nine covariance sums are a plain aggregate; only the 3x3 factorisations run in Arrow batches.
    """
    keys = list(keys)
    whole = matched.where(point_error().isNotNull())
    p, g = list("xyz"), ["gx", "gy", "gz"]
    means = whole.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{c}") for c in p + g],
    )
    centered = whole.join(means, keys).withColumns({f"d_{c}": F.col(c) - F.col(f"m_{c}") for c in p + g})
    sums = centered.groupBy(*keys).agg(
        F.max("n").cast("long").alias("n"),
        F.sum(sum((F.col(f"d_{c}") ** 2 for c in p), F.lit(0.0))).alias("spread"),
        *[F.sum(F.col(f"d_{a}") * F.col(f"d_{b}")).alias(f"c{i}{j}") for i, a in enumerate(p) for j, b in enumerate(g)],
    )
    names = [f"r{i}{j}" for i in range(3) for j in range(3)]
    fields = {f.name: f.dataType.simpleString() for f in sums.schema}
    schema = ", ".join([*[f"{k} {fields[k]}" for k in keys], "scale double", *[f"{n} double" for n in names]])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = lambda n: batch.column(n).to_numpy(zero_copy_only=False)
            cross = np.stack([col(f"c{i}{j}") for i in range(3) for j in range(3)], axis=1).reshape(-1, 3, 3)
            rotation, scale = _align(cross, col("spread"), col("n"))
            flat = rotation.reshape(-1, 9)
            arrays = [batch.column(k) for k in keys] + [pa.array(scale)] + [pa.array(flat[:, i]) for i in range(9)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keys, "scale", *names])

    solved = sums.mapInArrow(solve, schema).where("NOT isnan(scale)")
    joined = centered.join(solved, keys)
    aligned = [
        F.col("scale") * sum((F.col(f"d_{a}") * F.col(f"r{i}{j}") for i, a in enumerate(p)), F.lit(0.0)) for j in range(3)
    ]
    error = G.norm([a - F.col(f"d_{c}") for a, c in zip(aligned, g)])
    drop = ["n", "scale", *names, *[f"{k}_{c}" for k in "md" for c in p + g]]
    return joined.withColumn("aligned_error", error).drop(*drop)


def derivative_errors(matched: DataFrame, keys: Sequence[str], idx: str, fps: float) -> DataFrame:
    """Adds ``velocity_error`` and ``acceleration_error`` of consecutive valid frames per joint."""
    pairs = [("x", "gx"), ("y", "gy"), ("z", "gz")]

    def build(w):
        first = {f"__e{i}": F.col(p) - F.col(g) for i, (p, g) in enumerate(pairs)}
        lags = {f"__e{i}_{k}": F.lag(f"__e{i}", k).over(w) for i in range(3) for k in (1, 2)}
        return [first, lags]

    out = with_halo(matched, keys, idx, 2, 0, build)
    velocity = G.norm([(F.col(f"__e{i}") - F.col(f"__e{i}_1")) * fps for i in range(3)])
    acceleration = G.norm([(F.col(f"__e{i}") - 2.0 * F.col(f"__e{i}_1") + F.col(f"__e{i}_2")) * (fps * fps) for i in range(3)])
    drop = [c for i in range(3) for c in (f"__e{i}", f"__e{i}_1", f"__e{i}_2")]
    return out.withColumns({"velocity_error": velocity, "acceleration_error": acceleration}).drop(*drop)


def bone_cv(lengths: DataFrame, session: str) -> DataFrame:
    """Median over bones of 100 * std / mean of the length (at least two samples)."""
    per_bone = (
        lengths.where("length > 1e-9").groupBy(session, "bone")
        .agg(F.count(F.lit(1)).alias("n"), (100.0 * F.stddev_pop("length") / F.avg("length")).alias("cv"))
        .where("n >= 2")
    )
    # at most one row per bone of the skeleton
    return per_bone.groupBy(session).agg(F.median("cv").alias("bone_length_cv_percent"))


def _source(seed: int, session, *place: int) -> np.random.Generator:
    """Random numbers of one place: the same in every run and on every worker."""
    return np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, zlib.crc32(str(session).encode()), *place])))


def block_draws(seed: int, session, n: int, block: int, size: int, samples: int) -> np.ndarray:
    """How many of the n draws of each resample fall into a block of `size` frames, when n frames are drawn n times with replacement.

    A binary tree over the blocks: a node's draws split into its halves by a binomial with the halves' numbers of frames. A node's
    numbers depend on the node alone, so every block finds its own share on the way from the root, and all shares sum to n.
    """
    low, high, draws = 0, -(-n // size), np.full(samples, n)
    while high - low > 1:
        middle = (low + high) // 2
        left, whole = (middle - low) * size, min(high * size, n) - low * size
        taken = _source(seed, session, low, high).binomial(draws, left / whole)
        draws, low, high = (taken, low, middle) if block < middle else (draws - taken, middle, high)
    return draws


def bootstrap_ci(frame_means: DataFrame, session: str, idx: str, value: str, samples: int = 1000, seed: int = 20260715, block: int = 4096) -> DataFrame:
    """95 % interval of the mean frame value by resampling frames: n draws with replacement from n frames, `samples` times.

    Draws are split over blocks of frames by a tree of binomials and within a block by a multinomial, so each resample has exactly n draws, every block
    works alone, and what leaves it is `samples` sums, not a row for each frame and resample. Frames are numbered by `idx`, those
    without a value left out. The numbers depend on (seed, session, block) only, so reruns agree. Without resamples both ends are the mean.
    """
    known = frame_means.where(F.col(value).isNotNull()).select(session, idx, F.col(value).cast("double").alias("__v"))
    if samples < 1:
        return known.groupBy(session).agg(F.avg("__v").alias("ci_low"), F.avg("__v").alias("ci_high"))
    placed = ordinal(known, [session], [idx], index_block(idx), "__pos").withColumn("__blk", F.floor(F.col("__pos") / block).cast("long"))
    placed = placed.join(known.groupBy(session).agg(F.count(F.lit(1)).alias("__n")), session)
    kind = dict(frame_means.dtypes)[session]

    def sums(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__pos")
        who, n, own = rows[session].iloc[0], int(rows["__n"].iloc[0]), int(rows["__blk"].iloc[0])
        values, draws = rows["__v"].to_numpy(), block_draws(seed, who, n, own, block, samples)
        inside = _source(seed, who, own, 0, 1)
        even = np.full(len(values), 1.0 / len(values))
        out = np.concatenate([inside.multinomial(draws[i : i + 64], even) @ values for i in range(0, samples, 64)])
        return pd.DataFrame({session: [who] * samples, "__b": np.arange(samples), "__s": out, "__n": n})

    parts = placed.groupBy(session, "__blk").applyInPandas(sums, f"{session} {kind}, __b int, __s double, __n long")
    means = parts.groupBy(session, "__b").agg((F.sum("__s") / F.first("__n")).alias("__m"))
    # `samples` rows per session by construction
    return means.groupBy(session).agg(
        F.percentile("__m", F.lit(0.025)).alias("ci_low"), F.percentile("__m", F.lit(0.975)).alias("ci_high")
    )


# Gate, metric, its limit, and whether the limit is a minimum (1) or a maximum (-1).
GATES = (
    ("enough_frames", "evaluated_frames", "min_evaluated_frames", 1),
    ("valid_joint_ratio", "valid_joint_ratio", "min_valid_joint_ratio", 1),
    ("mpjpe", "mpjpe_mm", "max_mpjpe_mm", -1),
    ("p95_error", "p95_error_mm", "max_p95_error_mm", -1),
    ("root_relative_mpjpe", "root_relative_mpjpe_mm", "max_root_relative_mpjpe_mm", -1),
    ("pck_100mm", "pck_100mm", "min_pck_100mm", 1),
    ("angle_mae", "angle_mae_deg", "max_angle_mae_deg", -1),
    ("velocity_mae", "velocity_mae_mps", "max_velocity_mae_mps", -1),
    ("acceleration_mae", "acceleration_mae_mps2", "max_acceleration_mae_mps2", -1),
    ("bone_length_stability", "bone_length_cv_percent", "max_bone_length_cv_percent", -1),
)


def with_gates(summary: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """Adds failed_gates and status; a missing metric fails its gate."""
    limits = check_thresholds(limits or {})
    passed = lambda metric, limit, sign: F.coalesce(sign * F.col(metric) >= sign * limits[limit], F.lit(False))
    out = summary.withColumn("failed_gates", reasons(*[(~passed(*rest), name) for name, *rest in GATES]))
    return out.withColumn("status", F.when(F.size("failed_gates") == 0, "passed").otherwise("failed"))


def error_summary(matched: DataFrame, session: str, frame: str) -> DataFrame:
    """Point-error family per session."""
    rows = matched.withColumn("__e", point_error())
    err = F.col("__e")
    plain = rows.groupBy(session).agg(
        F.count(err).alias("evaluated_points"), F.avg(F.when(err.isNotNull(), 1.0).otherwise(0.0)).alias("valid_joint_ratio"),
        (1000.0 * F.avg(err)).alias("mpjpe_mm"), share_within(err, 0.05).alias("pck_50mm"), share_within(err, 0.10).alias("pck_100mm"),
    )
    q = exact_quantiles(rows, [session], err, {"__med": 0.5, "__p95": 0.95})
    return plain.join(q, session, "left").withColumns(
        {"median_error_mm": 1000.0 * F.col("__med"), "p95_error_mm": 1000.0 * F.col("__p95")}
    ).drop("__med", "__p95")
