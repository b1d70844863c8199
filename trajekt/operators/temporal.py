"""E: smoothing, gap filling, derivatives and outlier rejection along time.

Series are (keys, dense idx); everything runs block-wise, see ``blocks``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.numeric import finite
from ..functions.skeleton import J, RELIABILITY_BONES
from ..session import materialise
from .blocks import BLOCK_ROWS, runs, with_halo
from .quantiles import attach, exact_quantiles

PROVENANCE = {"unavailable": 0, "observed": 1, "recovered": 2}
REJECT_BASE, REJECT_BONE, REJECT_TEMPORAL = 1, 2, 4


def _odd(window: int) -> int:
    if window < 1 or window % 2 == 0:
        raise ValueError("window must be a positive odd number")
    return window


def smoothing_window(configured: int, stride: int, override: int | None = None) -> int:
    """Sparse sampling turns smoothing off unless a window is asked for explicitly."""
    if override is not None:
        return _odd(int(override))
    return 1 if stride > 1 else _odd(int(configured))


def centered_mean(df: DataFrame, keys: Sequence[str], idx: str, coords: Sequence[str], window: int = 5, suffix: str = "_ma") -> DataFrame:
    """Mean of the known values of each coordinate around a position; fills gaps."""
    r = _odd(window) // 2
    return with_halo(
        df, keys, idx, r, r, lambda w: {f"{c}{suffix}": F.avg(c).over(w.rangeBetween(-r, r)) for c in coords}
    )


def centered_mean_points(
    df: DataFrame, keys: Sequence[str], idx: str, coords: Sequence[str], valid: Column,
    window: int = 5, minimum: int = 1, suffix: str = "_ma",
) -> DataFrame:
    """Whole points only: a point counts when valid and complete; series shorter than the window are only masked."""
    r = _odd(window) // 2
    whole = valid & G.present([F.col(c) for c in coords])
    masked = {f"__{c}": F.when(whole, F.col(c)) for c in coords}

    def build(w):
        if window <= 1:
            return {f"{c}{suffix}": F.col(f"__{c}") for c in coords}
        near = w.rangeBetween(-r, r)
        # the series has at least `window` rows iff position window-1 exists
        long_enough = F.max(idx).over(w.rangeBetween(-window, window)) >= window - 1
        enough = F.count(f"__{coords[0]}").over(near) >= minimum
        return {
            f"{c}{suffix}": F.when(long_enough, F.when(enough, F.avg(f"__{c}").over(near))).otherwise(F.col(f"__{c}"))
            for c in coords
        }

    return with_halo(df.withColumns(masked), keys, idx, window, window, build).drop(*masked)


def polynomial_hat(window: int, order: int) -> np.ndarray:
    """Least-squares smoother matrix: row i gives the fitted value at position i of the window."""
    basis = np.vander(np.arange(window, dtype=float), min(order, window - 1) + 1, increasing=True)
    return basis @ np.linalg.pinv(basis)


def savgol_fit(
    df: DataFrame, keys: Sequence[str], idx: str, coords: Sequence[str], window: int, order: int,
    suffix: str = "_fit", min_window: int = 3,
) -> DataFrame:
    """Polynomial fit inside runs (columns run_start, run_end). Interior positions use the centre row of
    the hat matrix, positions near a run edge the matching edge row. NULL where the run is too short."""
    _odd(window)
    sizes = list(range(3, window + 1, 2))
    matrices = F.array(*[F.array(*[F.array(*map(F.lit, row)) for row in polynomial_hat(n, order).tolist()]) for n in sizes])
    length = F.col("run_end") - F.col("run_start") + 1
    eff = F.least(F.lit(window), F.when(length % 2 == 1, length).otherwise(length - 1))
    usable = (eff >= max(3, min_window)) & (eff > order)
    pos = F.col(idx) - F.col("run_start")
    start = F.least(F.greatest(pos - F.floor(eff / 2), F.lit(0)), length - eff)
    reach = window - 1

    def build(w):
        near = F.collect_list(F.struct(F.col(idx).alias("i"), *[F.col(c) for c in coords])).over(w.rangeBetween(-reach, reach))
        return [
            {"__near": near, "__eff": F.when(usable, eff), "__from": F.col("run_start") + start},
            {
                "__near": F.filter("__near", lambda v: (v["i"] >= F.col("__from")) & (v["i"] < F.col("__from") + F.col("__eff"))),
                "__row": F.element_at(
                    F.element_at(matrices, ((F.col("__eff") - 1) / 2).cast("int")), (F.col(idx) - F.col("__from") + 1).cast("int")
                ),
            },
            {
                f"{c}{suffix}": F.when(
                    F.col("__eff").isNotNull(),
                    F.aggregate(F.zip_with("__near", "__row", lambda v, k: v[c] * k), F.lit(0.0), lambda a, t: a + t),
                )
                for c in coords
            },
        ]

    return with_halo(df, keys, idx, reach, reach, build).drop("__near", "__eff", "__from", "__row")


def _run_limits(first: DataFrame, run_key: Sequence[str], length: Column, least: float) -> DataFrame:
    """Per run with residuals ``__res``: the outlier limit, and whether a point is beyond it. Median and MAD of a run of at most
    ``BLOCK_ROWS`` positions come from its sorted values, in one pass; longer runs take the exact quantiles of any size."""
    scored = first.where(F.col("__res").isNotNull())
    value, long = finite(F.col("__res")), scored.where(length > BLOCK_ROWS)
    own = scored.where(length <= BLOCK_ROWS).groupBy(*run_key).agg(F.sort_array(F.collect_list(value)).alias("__all"), F.max("__res").alias("__top"))
    own = own.withColumn("__mid", _middle("__all"))
    own = own.withColumn("__all", F.sort_array(F.transform("__all", lambda v: F.abs(v - F.col("__mid")))))
    stats = own.select(*run_key, "__top", "__mid", _middle("__all").alias("__mad"))
    if not long.isEmpty():
        middle = exact_quantiles(long, run_key, F.col("__res"), {"__mid": 0.5})
        spread = exact_quantiles(attach(long, middle, run_key), run_key, F.abs(F.col("__res") - F.col("__mid")), {"__mad": 0.5})
        tops = long.groupBy(*run_key).agg(F.max("__res").alias("__top"))
        stats = stats.unionByName(attach(attach(tops, middle, run_key), spread, run_key))
    limit = F.greatest(F.lit(least), F.col("__mid") + 4.0 * 1.4826 * F.col("__mad"))
    return stats.select(*run_key, limit.alias("__limit"), F.when(F.col("__top") > limit, True).alias("__dirty"))


def _middle(values: str) -> Column:
    """Median of a sorted array, as ``exact_quantiles`` interpolates it; NULL where it is empty."""
    position = (F.size(values) - 1) * F.lit(0.5)
    low, high = F.get(values, F.floor(position).cast("int")), F.get(values, F.ceil(position).cast("int"))
    return F.when(F.size(values) > 0, low + (high - low) * (position - F.floor(position)))


def robust_savgol(
    df: DataFrame, keys: Sequence[str], idx: str, coords: Sequence[str], valid: Column,
    window: int = 7, order: int = 2, min_outlier_distance: float = 0.04, breaks: Column | None = None, suffix: str = "_sm",
) -> DataFrame:
    """Two-pass polynomial smoothing per valid run; points far from the first fit are replaced by it
    before the second. Gaps stay gaps and runs too short for the window stay as they are."""
    keys = list(keys)
    cols = [F.col(c) for c in coords]
    marked = runs(df, keys, idx, valid & G.present(cols), breaks)
    if window <= 1:
        return marked.withColumns({f"{c}{suffix}": F.when(F.col("run_start").isNotNull(), F.col(c)) for c in coords})
    first = savgol_fit(marked, keys, idx, coords, window, order, "_p1")
    length = F.col("run_end") - F.col("run_start") + 1
    miss = G.norm(G.sub(cols, [F.col(f"{c}_p1") for c in coords]))
    # several later passes read this
    first = materialise(first.withColumn("__res", F.when((length >= 5) & (min_outlier_distance > 0), miss)), "fit")
    run_key = [*keys, "run_start"]
    first = attach(first, _run_limits(first, run_key, length, min_outlier_distance), run_key)
    first = first.withColumn("__out", F.coalesce(F.col("__res") > F.col("__limit"), F.lit(False)))
    first = first.withColumns({f"{c}_cl": F.when(F.col("__out"), F.col(f"{c}_p1")).otherwise(F.col(c)) for c in coords})
    second = savgol_fit(first, keys, idx, [f"{c}_cl" for c in coords], window, order, "_p2")
    result = {
        f"{c}{suffix}": F.when(
            F.col("run_start").isNotNull(),
            F.when(F.col(f"{c}_p1").isNull(), F.col(c)).when(F.col("__dirty"), F.col(f"{c}_cl_p2")).otherwise(F.col(f"{c}_p1")),
        )
        for c in coords
    }
    helpers = [f"{c}{s}" for c in coords for s in ("_p1", "_cl", "_cl_p2")]
    return second.withColumns(result).drop("__res", "__limit", "__out", "__dirty", *helpers)


def _moving_average(df, keys, idx, coords, valid, window, **_):
    return centered_mean_points(df, keys, idx, coords, valid, window, 1, "_sm")


SMOOTHERS = {"moving_average": _moving_average, "robust_savgol": robust_savgol}


def smooth(df: DataFrame, keys: Sequence[str], idx: str, coords: Sequence[str], valid: Column, method: str, window: int, **options) -> DataFrame:
    """Smoothing by registered method name; output columns end in ``_sm``."""
    if method not in SMOOTHERS:
        raise ValueError(f"unknown smoothing method {method}")
    return SMOOTHERS[method](df, keys, idx, coords, valid, window, **options)


def fill_short_gaps(df: DataFrame, keys: Sequence[str], idx: str, coords: Sequence[str], valid: Column, max_gap: int) -> DataFrame:
    """Linear fill of gaps of at most ``max_gap`` positions between observed points, with provenance."""
    seen = valid & G.present([F.col(c) for c in coords])
    here = F.when(seen, F.struct(F.col(idx).alias("i"), *[F.col(c) for c in coords]))

    def build(w):
        return {
            "__prev": F.last("__here", ignorenulls=True).over(w.rangeBetween(-max_gap, 0)),
            "__next": F.first("__here", ignorenulls=True).over(w.rangeBetween(0, max_gap)),
        }

    out = with_halo(df.withColumn("__here", here), keys, idx, max_gap, max_gap, build)
    gap = F.col("__next.i") - F.col("__prev.i") - 1
    inside = F.col("__here").isNull() & (gap >= 1) & (gap <= max_gap)
    alpha = (F.col(idx) - F.col("__prev.i")) / (F.col("__next.i") - F.col("__prev.i"))
    known = F.col("__here").isNotNull()
    filled = {
        c: F.when(known, F.col(c)).when(inside, (1.0 - alpha) * F.col(f"__prev.{c}") + alpha * F.col(f"__next.{c}")) for c in coords
    }
    code = F.when(known, PROVENANCE["observed"]).when(inside, PROVENANCE["recovered"]).otherwise(PROVENANCE["unavailable"])
    return out.withColumn("provenance", code).withColumns(filled).drop("__here", "__prev", "__next")


def speed(df: DataFrame, keys: Sequence[str], idx: str, coords: Sequence[str], fps: float, window: int = 5, out: str = "speed") -> DataFrame:
    """Distance between neighbouring smoothed positions times the rate; the first position has none."""
    r = _odd(window) // 2

    def build(w):
        near = w.rangeBetween(-r, r)
        long_enough = F.max(idx).over(w.rangeBetween(-window, window)) >= window - 1
        smoothed = {f"__{c}": F.when(long_enough, F.avg(c).over(near)).otherwise(F.col(c)) if window > 1 else F.col(c) for c in coords}
        step = G.norm([F.col(f"__{c}") - F.lag(f"__{c}").over(w) for c in coords])
        return [smoothed, {out: step * max(float(fps), 0.0)}]

    return with_halo(df, keys, idx, window + 1, window, build).drop(*[f"__{c}" for c in coords])


def motion_derivatives(
    df: DataFrame, keys: Sequence[str], idx: str, t: str, coords: Sequence[str], reference_speed: float = 1.5, floor: float = 0.2
) -> DataFrame:
    """Three-point acceleration on uneven time, local speed (one-sided at the ends) and motion weight."""

    def build(w):
        shifted = {}
        for name, shift in (("p", F.lag), ("n", F.lead)):
            shifted.update({f"__{name}_{c}": shift(c).over(w) for c in coords})
            shifted[f"__{name}_t"] = shift(t).over(w)
        return shifted

    out = with_halo(df, keys, idx, 1, 1, build)
    prev, here, nxt = ([F.col(f"__p_{c}") for c in coords], [F.col(c) for c in coords], [F.col(f"__n_{c}") for c in coords])
    before = F.greatest(F.col(t) - F.col("__p_t"), F.lit(1e-6))
    after = F.greatest(F.col("__n_t") - F.col(t), F.lit(1e-6))
    acc = [2.0 * ((n - h) / after - (h - p) / before) / (before + after) for p, h, n in zip(prev, here, nxt)]
    both = F.col("__p_t").isNotNull() & F.col("__n_t").isNotNull()
    first = [F.when(F.col("__p_t").isNotNull(), p).otherwise(h) for p, h in zip(prev, here)]
    last = [F.when(F.col("__n_t").isNotNull(), n).otherwise(h) for n, h in zip(nxt, here)]
    duration = F.coalesce(F.col("__n_t"), F.col(t)) - F.coalesce(F.col("__p_t"), F.col(t))
    local = F.when(duration > 0, G.distance(last, first) / duration).when(duration <= 0, 0.0)
    weight = F.least(F.greatest(reference_speed / (reference_speed + F.greatest(local, F.lit(0.0))), F.lit(floor)), F.lit(1.0))
    out = out.withColumns({"acceleration": F.when(both, G.norm(acc)), "local_speed": local})
    out = out.withColumn("motion_weight", F.when(local.isNotNull(), weight))
    return out.drop("__p_t", "__n_t", *[f"__{n}_{c}" for n in "pn" for c in coords])


def _bone_table() -> Column:
    degree = {}
    for a, b in RELIABILITY_BONES:
        degree[a] = degree.get(a, 0) + 1
        degree[b] = degree.get(b, 0) + 1
    return F.array(*[
        F.struct(
            F.lit(i).alias("bone"), F.lit(J[a]).alias("a"), F.lit(J[b]).alias("b"),
            F.lit(J[a] if degree[a] < degree[b] else J[b]).alias("weaker"),
        )
        for i, (a, b) in enumerate(RELIABILITY_BONES)
    ])


def bone_lengths(frames: DataFrame, keep: Sequence[str], array: str = "pts") -> DataFrame:
    """One row per frame and bone with both endpoints visible. Reads the point array in place."""
    pts = F.col(array)
    rows = frames.withColumn("__bone", F.explode(_bone_table()))
    rows = rows.withColumns({"__a": pts[F.col("__bone.a")], "__b": pts[F.col("__bone.b")]})
    ends = tuple(tuple(F.col(f"{side}.{c}") for c in "xyz") for side in ("__a", "__b"))
    return rows.select(*keep, F.col("__bone.bone").alias("bone"), G.distance(*ends).alias("length")).where("length IS NOT NULL")


def reference_lengths(frames: DataFrame, session: str, minimum: int = 5) -> DataFrame:
    """Median length per session and bone where at least ``minimum`` frames show it."""
    lengths = bone_lengths(frames, [session])
    counts = lengths.groupBy(session, "bone").agg(F.count(F.lit(1)).alias("__n"))
    medians = exact_quantiles(lengths, [session, "bone"], F.col("length"), {"ref": 0.5})
    return medians.join(counts, [session, "bone"]).where((F.col("__n") >= minimum) & (F.col("ref") > 1e-6)).drop("__n")


def reject_bones(
    frames: DataFrame, session: str, scores: str = "scores", array: str = "pts",
    relative: float = 0.25, absolute: float = 0.08, minimum: int = 5,
) -> DataFrame:
    """Adds ``bone_rejected``: joints blamed for an implausible bone in the frame.

    Only the reference lengths need a shuffle; the test itself is a projection over each frame's array.
    """
    refs = reference_lengths(frames.withColumn("pts", F.col(array)), session, minimum)
    per_session = refs.groupBy(session).agg(F.map_from_entries(F.collect_list(F.struct("bone", "ref"))).alias("__refs"))
    rows = attach(frames, per_session, [session])

    def blame(bone: Column) -> Column:
        a, b = F.col(array)[bone["a"]], F.col(array)[bone["b"]]
        ref = F.coalesce(F.try_element_at(F.col("__refs"), bone["bone"]), F.lit(None).cast("double"))
        length = F.sqrt((a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2 + (a["z"] - b["z"]) ** 2)
        bad = F.abs(length - ref) > F.greatest(F.lit(absolute), relative * ref)
        sa, sb = F.coalesce(F.col(scores)[bone["a"]], F.lit(0.0)), F.coalesce(F.col(scores)[bone["b"]], F.lit(0.0))
        by_score = F.when(sa < sb, bone["a"]).otherwise(bone["b"])
        return F.when(bad, F.when(F.abs(sa - sb) > 0.10, by_score).otherwise(bone["weaker"]))

    return rows.withColumn("bone_rejected", F.array_distinct(F.array_compact(F.transform(_bone_table(), blame)))).drop("__refs")


def reject_temporal(
    df: DataFrame, keys: Sequence[str], idx: str, t: str, coords: Sequence[str], valid: Column,
    min_residual: float = 0.08, max_acceleration: float = 70.0,
) -> DataFrame:
    """Adds ``temporal_rejected``: far from the time-weighted line between two valid neighbours."""

    def build(w):
        cols = {"__ok": valid}
        steps = {}
        for name, shift in (("p", F.lag), ("n", F.lead)):
            steps.update({f"__{name}_{c}": shift(c).over(w) for c in coords})
            steps[f"__{name}_t"] = shift(t).over(w)
            steps[f"__{name}_ok"] = shift("__ok").over(w)
        return [cols, steps]

    out = with_halo(df, keys, idx, 1, 1, build)
    before, after = F.col(t) - F.col("__p_t"), F.col("__n_t") - F.col(t)
    alpha = before / F.when(before + after > 0, before + after)
    line = [F.col(f"__p_{c}") + alpha * (F.col(f"__n_{c}") - F.col(f"__p_{c}")) for c in coords]
    residual = G.distance([F.col(c) for c in coords], line)
    limit = F.greatest(F.lit(min_residual), 0.5 * max_acceleration * before * after)
    bad = F.col("__p_ok") & F.col("__ok") & F.col("__n_ok") & (before > 0) & (after > 0) & (residual > limit)
    drop = ["__ok", "__p_ok", "__n_ok", "__p_t", "__n_t", *[f"__{n}_{c}" for n in "pn" for c in coords]]
    return out.withColumn("temporal_rejected", F.coalesce(bad, F.lit(False))).drop(*drop)
