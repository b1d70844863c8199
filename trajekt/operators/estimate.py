"""D: multi-view estimation as grouped jobs.

Views of a point are packed by one aggregation (a rig has a handful of cameras), the small dense
solves run over whole Arrow batches in numpy, everything around them stays in Column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.numeric import clip, count_where
from ..session import materialise
from .quantiles import attach, exact_quantiles

POINT_FIELDS = "x double, y double, z double, conditioning double, reproj_px double, used_cameras int, used_views array<string>"


def pack_views(views: DataFrame, keys: Sequence[str], min_score: float) -> DataFrame:
    """One row per point with its usable views as an array ordered by camera.

    Repeated observations of a camera collapse to the best-scored one first, so the array never
    exceeds the rig.
    """
    usable = views.where((F.col("score") >= min_score) & F.col("px").isNotNull() & F.col("py").isNotNull())
    best = usable.groupBy(*keys, "camera_id").agg(F.max(F.struct("score", "px", "py")).alias("v"))
    entry = F.struct("camera_id", F.col("v.px").alias("u"), F.col("v.py").alias("v"), clip(F.col("v.score"), 0.0, 1.0).alias("s"))
    return best.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("views"))


def _dlt(points: np.ndarray, mats: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Homogeneous least squares for a stack of points; unused views become zero rows."""
    rows = np.concatenate(
        [points[..., 0:1] * mats[..., 2, :] - mats[..., 0, :], points[..., 1:2] * mats[..., 2, :] - mats[..., 1, :]], axis=1
    )
    size = np.linalg.norm(rows, axis=-1, keepdims=True)
    keep = np.concatenate([use, use], axis=1)[..., None] & (size > 1e-12)
    rows = np.where(keep, rows / np.where(size > 1e-12, size, 1.0), 0.0)
    _, s, vt = np.linalg.svd(rows)
    h = vt[:, -1]
    ok = (np.abs(h[:, 3]) >= 1e-12) & (keep[..., 0].sum(axis=1) >= 4)
    xyz = np.where(ok[:, None], h[:, :3] / np.where(ok, h[:, 3], 1.0)[:, None], np.nan)
    quality = np.where(s[:, -2] > 1e-12, 1.0 - np.clip(s[:, -1] / np.where(s[:, -2] > 1e-12, s[:, -2], 1.0), 0.0, 1.0), 0.0)
    return xyz, quality


def _residuals(xyz: np.ndarray, pixels: np.ndarray, mats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    proj = np.einsum("bnij,bj->bni", mats, np.concatenate([xyz, np.ones((len(xyz), 1))], axis=1))
    w = proj[..., 2]
    ok = np.abs(w) > 1e-12
    uv = proj[..., :2] / np.where(ok, w, 1.0)[..., None]
    return np.where(ok, np.linalg.norm(uv - pixels, axis=-1), np.inf), w


def _refine(xyz: np.ndarray, pixels: np.ndarray, mats: np.ndarray, use: np.ndarray, scale: float, steps: int = 60) -> np.ndarray:
    """Robust Gauss-Newton on the pixel residuals (soft-L1 weights), damped by accepting only improvements.

    A point whose step brings nothing would take the same step again, so it leaves the stack; later steps are solved for the rest only.
    """

    def cost_and_system(p, pixels, mats, use):
        proj = np.einsum("bnij,bj->bni", mats, np.concatenate([p, np.ones((len(p), 1))], axis=1))
        w = np.where(np.abs(proj[..., 2]) > 1e-12, proj[..., 2], 1e-12)
        r = np.where(use[..., None], proj[..., :2] / w[..., None] - pixels, 0.0)
        z = (r / scale) ** 2
        jac = (mats[..., :2, :3] * w[..., None, None] - proj[..., :2, None] * mats[..., 2:3, :3]) / (w**2)[..., None, None]
        weight = np.where(use[..., None], 1.0 / np.sqrt(1.0 + z), 0.0)
        return (2.0 * scale**2 * (np.sqrt(1.0 + z) - 1.0)).sum(axis=(1, 2)), r, weight, jac

    out, at = xyz.copy(), np.arange(len(xyz))
    point, views = xyz.copy(), (pixels, mats, use)
    system = cost_and_system(point, *views)
    for _ in range(steps):
        cost, r, weight, jac = system
        normal = np.einsum("bnci,bnc,bncj->bij", jac, weight, jac) + 1e-12 * np.eye(3)
        grad = np.einsum("bnci,bnc,bnc->bi", jac, weight, r)
        step = -np.linalg.solve(normal, grad[..., None])[..., 0]
        trial = np.where(np.isfinite(step).all(axis=1)[:, None], point + step, point)
        tried = cost_and_system(trial, *views)
        better = tried[0] < cost
        if not better.any():
            break
        at, point, system, views = at[better], trial[better], tuple(v[better] for v in tried), tuple(v[better] for v in views)
        out[at] = point
    return out


def _max_ray_angle(xyz: np.ndarray, mats: np.ndarray, use: np.ndarray) -> np.ndarray:
    center = -np.linalg.solve(mats[..., :3], mats[..., 3:])[..., 0]
    ray = xyz[:, None, :] - center
    size = np.linalg.norm(ray, axis=-1, keepdims=True)
    ray = ray / np.where(size > 1e-12, size, 1.0)
    cosine = np.clip(np.einsum("bni,bmi->bnm", ray, ray), -1.0, 1.0)
    both = use[:, :, None] & use[:, None, :]
    return np.degrees(np.arccos(np.where(both, cosine, 1.0))).max(axis=(1, 2))


def solve_views(
    pixels: np.ndarray, mats: np.ndarray, intrinsics: np.ndarray, scores: np.ndarray,
    min_views: int, max_error: float, max_hypotheses: int | None = None, refine: bool = True,
):
    """Robust points for a stack with the same number of views: (xyz, conditioning, inlier mask, mean error); NaN = none.

    Camera pairs propose points, one pair of every point at a time and the best-scored first, views vote on them, the
    best-supported proposal is re-solved on its inliers, refined and checked again. Every pair proposes unless
    ``max_hypotheses`` asks for fewer.
    """
    b, n = scores.shape
    needed = min_views if n <= 3 else max(min_views, n // 2 + 1)
    inv = np.linalg.inv(intrinsics)
    norm_mats = inv @ mats
    ones = np.ones((b, n, 1))
    norm_points = np.einsum("bnij,bnj->bni", inv, np.concatenate([pixels, ones], axis=2))[..., :2]
    pairs = np.array(list(combinations(range(n), 2)))
    rank = np.argsort(-(scores[:, pairs[:, 0]] * scores[:, pairs[:, 1]]), axis=1, kind="stable")[:, :max_hypotheses]
    best = {"n": np.zeros(b, int), "e": np.full(b, np.inf), "c": np.full(b, -np.inf), "mask": np.zeros((b, n), bool)}
    at = np.arange(b)
    for h in range(rank.shape[1]):
        pick = pairs[rank[:, h]]
        use = np.zeros((b, n), bool)
        use[at, pick[:, 0]] = use[at, pick[:, 1]] = True
        xyz, _ = _dlt(norm_points, norm_mats, use)
        known = np.isfinite(xyz).all(axis=1)
        err, _ = _residuals(np.nan_to_num(xyz), pixels, mats)
        _, depth = _residuals(np.nan_to_num(xyz), norm_points, norm_mats)
        mask = known[:, None] & (depth > 1e-9) & (err <= max_error)
        count = mask.sum(axis=1)
        some = count >= needed
        middle = np.full(b, np.inf)
        if some.any():
            middle[some] = np.nanmedian(np.where(mask[some], err[some], np.nan), axis=1)
        conf = np.where(mask, scores, 0.0).sum(axis=1) / np.maximum(count, 1)
        better = some & (
            (count > best["n"]) | ((count == best["n"]) & ((middle < best["e"]) | ((middle == best["e"]) & (conf > best["c"]))))
        )
        for key, value in (("n", count), ("e", middle), ("c", conf)):
            best[key] = np.where(better, value, best[key])
        best["mask"] = np.where(better[:, None], mask, best["mask"])

    def settle(use):
        xyz, cond = _dlt(norm_points, norm_mats, use)
        good = np.isfinite(xyz).all(axis=1)
        start = np.nan_to_num(xyz)
        point = _refine(start, pixels, mats, use & good[:, None], max(max_error / 3.0, 1.0)) if refine else start
        err, _ = _residuals(point, pixels, mats)
        _, depth = _residuals(point, norm_points, norm_mats)
        return point, cond, err, good[:, None] & (depth > 1e-9) & np.isfinite(err) & (err <= max_error), good

    alive = best["n"] >= needed
    point, cond, err, mask, good = settle(best["mask"])
    alive &= good & (mask.sum(axis=1) >= needed)
    changed = alive & (mask != best["mask"]).any(axis=1)
    if changed.any():
        p2, c2, e2, _, g2 = settle(mask)
        point = np.where(changed[:, None], p2, point)
        cond, err = np.where(changed, c2, cond), np.where(changed[:, None], e2, err)
        alive &= ~changed | g2
    total = np.maximum(mask.sum(axis=1), 1)
    mean = np.where(mask, np.where(np.isfinite(err), err, np.inf), 0.0).sum(axis=1) / total
    alive &= np.isfinite(mean) & (mean <= max_error) & (_max_ray_angle(point, norm_mats, mask) >= 1.0)
    return np.where(alive[:, None], point, np.nan), cond, mask & alive[:, None], np.where(alive, mean, np.nan)


def triangulate(
    packed: DataFrame, rigs: DataFrame, session: str, keep: Sequence[str], min_views: int = 2,
    max_error: float = 25.0, max_hypotheses: int | None = None, refine: bool = True,
) -> DataFrame:
    """Robust 3D point of every packed row with enough agreeing views. ``rigs`` has one row per session:
    cams array<struct<camera_id, k, p>>; it joins after packing, so matrices are never shuffled per view."""
    kinds = dict(packed.dtypes)
    rows = packed.where(F.size("views") >= min_views).join(rigs, session)
    place = F.transform("views", lambda v: F.coalesce(F.array_position(F.col("cams.camera_id"), v["camera_id"]), F.lit(0)))
    rows = rows.withColumn("__place", place)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in keep], POINT_FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            views, cams = batch.column("views"), batch.column("cams")
            offs = views.offsets.to_numpy()
            flat = views.values
            u, v, s = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("u", "v", "s"))
            names = np.array(flat.field("camera_id").to_pylist(), dtype=object)
            coffs, cflat = cams.offsets.to_numpy(), cams.values
            k = cflat.field("k").flatten().to_numpy(zero_copy_only=False).reshape(-1, 3, 3)
            p = cflat.field("p").flatten().to_numpy(zero_copy_only=False).reshape(-1, 3, 4)
            count = np.diff(offs)
            place = batch.column("__place").flatten().to_numpy()
            index = np.where(place > 0, np.repeat(coffs[:-1], count) + place - 1, -1)
            order, parts = [], []
            for n in np.unique(count):
                who = np.flatnonzero(count == n)
                at = offs[who][:, None] + np.arange(n)
                who = who[(index[at] >= 0).all(axis=1)]
                if not len(who):
                    continue
                at = offs[who][:, None] + np.arange(n)
                xyz, cond, mask, err = solve_views(
                    np.stack([u[at], v[at]], axis=-1), p[index[at]], k[index[at]], s[at], min_views, max_error, max_hypotheses, refine
                )
                found = np.isfinite(err)
                order.append(who[found])
                used = [list(names[a][m]) for a, m in zip(at[found], mask[found])]
                parts.append((xyz[found], cond[found], err[found], mask[found].sum(axis=1), used))
            if not order:
                continue
            who = pa.array(np.concatenate(order))
            xyz = np.concatenate([q[0] for q in parts])
            arrays = [batch.column(c).take(who) for c in keep] + [pa.array(xyz[:, i]) for i in range(3)]
            arrays += [
                pa.array(np.concatenate([q[1] for q in parts])), pa.array(np.concatenate([q[2] for q in parts])),
                pa.array(np.concatenate([q[3] for q in parts]).astype(np.int32)), pa.array([u for q in parts for u in q[4]], pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *[f.split()[0] for f in POINT_FIELDS.split(", ")]])

    return rows.mapInArrow(run, schema)


def quality_score(mean_score: Column, error: Column, views: Column, conditioning: Column, tolerance: float = 12.0) -> Column:
    fit = F.when(error.isNotNull(), F.exp(-F.greatest(error, F.lit(0.0)) / tolerance)).otherwise(0.0)
    return clip(F.coalesce(mean_score, F.lit(0.0)) * fit * clip((views - 1) / 2.0, 0.0, 1.0) * conditioning, 0.0, 1.0)


def ray_angle(rays: Column) -> Column:
    """Largest angle between any two unit rays of an array (one per camera of the rig)."""

    def pair(a, b):
        return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"])))

    return F.degrees(F.array_max(F.transform(rays, lambda a: F.array_max(F.transform(rays, lambda b: pair(a, b))))))


def feedback_targets(packed: DataFrame, consensus: DataFrame, keys: Sequence[str], rigs: DataFrame, session: str, trigger: float) -> DataFrame:
    """(point, excluded camera) pairs worth checking: unusable there, no consensus, or far from it.

    Filtering comes first; only these pairs pay for a leave-one-out solve.
    """
    rows = packed.join(consensus.select(*keys, "x", "y", "z"), list(keys), "left")
    rows = rows.join(rigs, session).withColumn("cam", F.explode("cams")).drop("cams")
    rows = rows.withColumns({"excluded": F.col("cam.camera_id"), "p": F.col("cam.p")}).drop("cam")
    own = F.filter("views", lambda v: v["camera_id"] == F.col("excluded"))
    u, v, _ = G.project((F.col("x"), F.col("y"), F.col("z")), G.array_matrix("p", 12))
    rows = rows.withColumns({"own": F.get(own, F.lit(0)), "views": F.filter("views", lambda w: w["camera_id"] != F.col("excluded"))})
    error = F.sqrt((F.col("own.u") - u) ** 2 + (F.col("own.v") - v) ** 2)
    check = F.col("own").isNull() | F.col("x").isNull() | F.coalesce(error >= trigger, F.lit(False))
    return rows.where(check).drop("x", "y", "z")


def decide_candidate(
    initial_error: Column, candidate_error: Column, score: Column, peak_score: Column,
    min_score: float = 0.30, peak_ratio: float = 0.08, max_distance: float = 20.0, min_gain: float = 12.0, max_ratio: float = 0.50,
) -> Column:
    """First failed check in order, or ``accepted``. A missing initial error (nothing observed) skips the gain checks."""
    s, g = F.coalesce(score, F.lit(0.0)), F.coalesce(peak_score, F.lit(0.0))
    return (
        F.when(candidate_error.isNull(), "nonfinite_candidate")
        .when(s < min_score, "insufficient_image_score")
        .when((g > 0.0) & (s < g * peak_ratio), "weak_secondary_heatmap_peak")
        .when(candidate_error > max_distance, "candidate_too_far_from_crossview_prior")
        .when(initial_error.isNotNull() & (initial_error - candidate_error < min_gain), "insufficient_geometric_improvement")
        .when(initial_error.isNotNull() & (candidate_error > initial_error * max_ratio), "insufficient_relative_improvement")
        .otherwise("accepted")
    )


def upper_bound_failed(reference: Column, candidate: Column, ratio: float, increase: float) -> Column:
    return candidate > F.greatest(reference * ratio, reference + increase)


def similarity_sums(pairs: DataFrame, keys: Sequence[str], *more: Column) -> DataFrame:
    """Count n and sums of products of the pairs (qx, qy), (px, py), and ``more`` aggregates, in one pass."""
    return pairs.groupBy(*keys).agg(
        F.sum(F.lit(1.0)).alias("n"), *[F.sum(F.col(c)).alias(f"s_{c}") for c in ("qx", "qy", "px", "py")],
        F.sum(F.col("qx") ** 2 + F.col("qy") ** 2).alias("qq"),
        F.sum(F.col("qx") * F.col("px") + F.col("qy") * F.col("py")).alias("qp"),
        F.sum(F.col("qx") * F.col("py") - F.col("qy") * F.col("px")).alias("cr"), *more,
    )


def similarity_fit(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Closed-form 2D similarity (a, b, tx, ty) mapping (qx, qy) to (px, py) from ``similarity_sums`` of at least six pairs."""
    n = F.col("n")
    den = F.col("qq") - (F.col("s_qx") ** 2 + F.col("s_qy") ** 2) / n
    ok = F.when(den > 1e-9, den)
    a = (F.col("qp") - (F.col("s_qx") * F.col("s_px") + F.col("s_qy") * F.col("s_py")) / n) / ok
    b = (F.col("cr") - (F.col("s_qx") * F.col("s_py") - F.col("s_qy") * F.col("s_px")) / n) / ok
    fitted = sums.where("n >= 6").withColumns({"fa": a, "fb": b})
    return fitted.select(
        *keys, "fa", "fb",
        ((F.col("s_px") - F.col("fa") * F.col("s_qx") + F.col("fb") * F.col("s_qy")) / n).alias("ftx"),
        ((F.col("s_py") - F.col("fb") * F.col("s_qx") - F.col("fa") * F.col("s_qy")) / n).alias("fty"),
    )


def aligned_residual() -> Column:
    ax = F.col("fa") * F.col("qx") - F.col("fb") * F.col("qy") + F.col("ftx")
    ay = F.col("fb") * F.col("qx") + F.col("fa") * F.col("qy") + F.col("fty")
    return F.sqrt((F.col("px") - ax) ** 2 + (F.col("py") - ay) ** 2)


PROPOSALS, SEED = 48, 20260715
FIT = ("fa", "fb", "ftx", "fty")


def consensus_similarity(pairs: DataFrame, keys: Sequence[str], threshold: float = 15.0, proposals: int = PROPOSALS, seed: int = SEED) -> DataFrame:
    """2D similarity (fa, fb, ftx, fty) per key that most pairs agree with: proposals from pairs drawn by a hash, votes of all, refits on the inliers.

    A hash deals a key's pairs to `proposals` draws and orders them inside, and the first and last of each draw propose a transform: minima and maxima, so
    nothing is gathered. Every pair votes for the proposals that bring it within the threshold. The winner, of ties the first, is fitted again to its inliers
    until they stay the same, or come back to a set they had. Keys with fewer than six inliers have no row. Reruns agree.
    """
    keys = list(keys)
    xy = [F.col(c) for c in ("px", "py", "qx", "qy")]
    known = materialise(pairs.select(*keys, *xy).where(" AND ".join(f"{c} IS NOT NULL" for c in ("px", "py", "qx", "qy"))), "pairs")
    mark = F.xxhash64(F.lit(seed), *xy)
    entry = F.struct(F.xxhash64(F.lit(seed + 1), mark).alias("o"), *xy)
    two = known.withColumn("__d", F.pmod(mark, F.lit(proposals))).groupBy(*keys, "__d").agg(F.min(entry).alias("a"), F.max(entry).alias("b"))
    d = {c: F.col(f"b.{c}") - F.col(f"a.{c}") for c in ("px", "py", "qx", "qy")}
    size = d["qx"] ** 2 + d["qy"] ** 2
    turned = two.where(size > 1e-9).withColumns({"fa": (d["qx"] * d["px"] + d["qy"] * d["py"]) / size, "fb": (d["qx"] * d["py"] - d["qy"] * d["px"]) / size})
    moved = turned.withColumns({"ftx": F.col("a.px") - F.col("fa") * F.col("a.qx") + F.col("fb") * F.col("a.qy"), "fty": F.col("a.py") - F.col("fb") * F.col("a.qx") - F.col("fa") * F.col("a.qy")})
    # at most `proposals` for each key
    offered = materialise(moved.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__d", *FIT))).alias("__offers")), "offers")

    # plain columns of numbers, one sum for each proposal: a lambda over the array would be interpreted for every pair
    lists = attach(known, offered.select(*keys, *[F.col(f"__offers.{c}").alias(f"__{c}") for c in FIT]), keys)

    def vote(i: int) -> Column:
        a, b, tx, ty = (F.get(f"__{c}", F.lit(i)) for c in FIT)
        ax, ay = a * F.col("qx") - b * F.col("qy") + tx, b * F.col("qx") + a * F.col("qy") + ty
        return F.when(F.sqrt((F.col("px") - ax) ** 2 + (F.col("py") - ay) ** 2) <= threshold, 1).otherwise(0)

    counted = lists.groupBy(*keys).agg(F.array(*[F.sum(vote(i)) for i in range(proposals)]).alias("__n"))
    best = F.array_position("__n", F.array_max("__n")).cast("int") - 1
    fit = counted.join(offered, keys).select(*keys, F.get("__offers", best).alias("__f")).select(*keys, *[F.col(f"__f.{c}").alias(c) for c in FIT])
    fit, seen = materialise(fit, "consensus"), set()
    while True:
        # one pass gives the inliers' count and digest, which tell whether they changed, and the sums of their fit
        inside = known.join(fit, keys).where(aligned_residual() <= threshold)
        own = materialise(similarity_sums(inside, keys, F.bit_xor(mark).alias("x")), "consensus")
        state = tuple(own.agg(F.count(F.lit(1)), F.sum(F.col("n").cast("long")), F.bit_xor(F.xxhash64(*keys, F.col("n").cast("long"), "x"))).first())
        if state in seen:
            return fit
        seen.add(state)
        fit = similarity_fit(own, keys)


# Partner joint of each body joint when left and right are exchanged.
SWAP = [0, 2, 1, 4, 3, 6, 5, 8, 7, 10, 9, 12, 11, 14, 13, 16, 15]


def camera_hypotheses(views: DataFrame, session: str, frame: str) -> DataFrame:
    """Median and p95 error per (session, camera) under: as is, left/right exchanged, median shift removed, best similarity."""
    keys = [session, "camera_id"]
    swap = F.array(*map(F.lit, SWAP))
    known = views.where("px IS NOT NULL AND qx IS NOT NULL")
    other = views.select(session, "camera_id", frame, swap[F.col("joint_idx")].alias("joint_idx"), F.col("px").alias("sx"), F.col("py").alias("sy"))
    rows = known.join(other, [session, "camera_id", frame, "joint_idx"], "left")
    tall = known.select(*keys, F.expr("stack(2, 'x', px - qx, 'y', py - qy) AS (axis, d)"))
    shift = exact_quantiles(tall, [*keys, "axis"], F.col("d"), {"m": 0.5}).groupBy(*keys).agg(
        F.max(F.when(F.col("axis") == "x", F.col("m"))).alias("mx"), F.max(F.when(F.col("axis") == "y", F.col("m"))).alias("my")
    )
    fit = consensus_similarity(known, keys)
    rows = attach(attach(rows, shift, keys), fit, keys)
    gap = lambda x, y: F.sqrt((x - F.col("qx")) ** 2 + (y - F.col("qy")) ** 2)
    kinds = {
        "direct": gap(F.col("px"), F.col("py")), "swapped": gap(F.col("sx"), F.col("sy")),
        "translated": gap(F.col("px") - F.col("mx"), F.col("py") - F.col("my")), "affine": aligned_residual(),
    }
    entries = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("v")) for k, c in kinds.items()])
    flat = rows.select(*keys, F.inline(entries))
    q = exact_quantiles(flat, [*keys, "kind"], F.col("v"), {"m": 0.5, "p": 0.95})
    pick = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
    wide = q.groupBy(*keys).agg(*[pick(k, c).alias(f"{k}_{n}") for k in kinds for c, n in (("m", "median"), ("p", "p95"))])
    size = F.sqrt(F.col("fa") ** 2 + F.col("fb") ** 2)
    plausible = size.between(0.85, 1.15) & (F.abs(F.degrees(F.atan2("fb", "fa"))) <= 5.0) & (F.sqrt(F.col("ftx") ** 2 + F.col("fty") ** 2) <= 150.0)
    return wide.join(fit.withColumn("affine_plausible", plausible), keys, "left")


def classify_camera(trigger: float = 24.0) -> Column:
    """Class of a camera from target count, bad joints and hypothesis errors; the first matching rule wins."""
    direct, none = F.col("direct_median"), F.col("target_count") == 0
    return (
        F.when(none & (F.col("bad_joints") == 0), "healthy")
        .when(none, "insufficient_crossview_support")
        .when(F.col("swapped_median") < 0.70 * direct, "left_right_identity_mismatch")
        .when((F.col("best_shift") != 0) & (F.col("best_shift_error") < 0.75 * F.col("zero_shift_error")), "synchronization_offset")
        .when(
            F.col("affine_plausible") & (F.col("affine_median") < 0.60 * direct) & (F.col("affine_p95") < 0.75 * F.col("direct_p95")),
            "calibration_alignment_bias",
        )
        .when((F.col("bad_arm_joints") >= 2) & (F.col("bad_joints") - F.col("bad_arm_joints") <= 3), "self_occlusion_or_2d_joint_detection")
        .when((F.col("bad_joints") >= 8) & (F.col("translated_median") > 0.75 * direct), "broad_2d_pose_failure_or_occlusion")
        .otherwise("localized_2d_joint_detection")
    )


def patch_sample(
    pixels: DataFrame, keys: Sequence[str], depth: str, confidence: str, expected: str,
    near: float = 0.40, far: float = 10.0, max_confidence: float = 50.0, gate: float = 0.35, gate_ratio: float = 0.10, minimum: int = 4,
) -> DataFrame:
    """Robust depth of a pixel neighbourhood around an expected depth; patches have (2r+1)^2 pixels at most."""
    keys = list(keys)
    ok = (
        F.col(depth).between(near, far) & (F.col(confidence) <= max_confidence)
        & (F.abs(F.col(depth) - F.col(expected)) <= F.greatest(F.lit(gate), gate_ratio * F.col(expected)))
    )
    packed = pixels.where(ok).groupBy(*keys).agg(F.collect_list(F.struct(F.col(depth).alias("d"), F.col(confidence).alias("c"))).alias("px"))
    packed = packed.where(F.size("px") >= minimum)

    def median(array: Column, of) -> Column:
        ordered = F.array_sort(F.transform(array, of))
        n = F.size(ordered)
        return (F.try_element_at(ordered, F.floor((n + 1) / 2).cast("int")) + F.try_element_at(ordered, F.floor((n + 2) / 2).cast("int"))) / 2.0

    packed = packed.withColumn("m", median(F.col("px"), lambda p: p["d"]))
    packed = packed.withColumn("mad", median(F.col("px"), lambda p: F.abs(p["d"] - F.col("m"))))
    limit = F.greatest(3.0 * 1.4826 * F.col("mad"), F.lit(0.015))
    packed = packed.withColumn("px", F.when(F.col("mad") > 1e-9, F.filter("px", lambda p: F.abs(p["d"] - F.col("m")) <= limit)).otherwise(F.col("px")))
    packed = packed.where(F.size("px") >= minimum)
    return packed.select(
        *keys, median(F.col("px"), lambda p: p["d"]).alias("depth_m"), median(F.col("px"), lambda p: p["c"]).alias("confidence"), F.size("px").alias("pixel_count")
    )


def surface_offsets(samples: DataFrame, keys: Sequence[str], residual: str, minimum: int = 24) -> DataFrame:
    counts = samples.groupBy(*keys).agg(F.count(residual).alias("__n")).where(F.col("__n") >= minimum)
    q = exact_quantiles(samples, keys, F.col(residual), {"offset_m": 0.5})
    return q.join(counts, list(keys)).drop("__n")


def fuse_depth(observations: DataFrame, keys: Sequence[str], weight: str, axis: Sequence[str], target: str, base: Sequence[str], baseline: float = 1.0) -> DataFrame:
    """Least-squares point pulled along each camera's optical axis towards its measured depth: nine sums and a 3x3 solve."""
    w = F.col(weight)
    sums = observations.groupBy(*keys).agg(
        *[F.sum(w * F.col(axis[i]) * F.col(axis[j])).alias(f"m{i}{j}") for i in range(3) for j in range(i, 3)],
        *[F.sum(w * F.col(axis[i]) * F.col(target)).alias(f"t{i}") for i in range(3)],
        *[F.first(c).alias(f"b{i}") for i, c in enumerate(base)],
    )
    m = [F.col(f"m{min(i, j)}{max(i, j)}") + (baseline if i == j else 0.0) for i in range(3) for j in range(3)]
    b = [baseline * F.col(f"b{i}") + F.col(f"t{i}") for i in range(3)]
    solved = G.solve3(m, b)
    return sums.select(*keys, *[F.col(f"b{i}").alias(f"base_{a}") for i, a in enumerate("xyz")], *[c.alias(f"fused_{a}") for a, c in zip("xyz", solved)])


def fusion_decision(correction: Column, depth_before: Column, depth_after: Column, median_increase: Column, max_increase: Column) -> Column:
    return (
        F.when(correction.isNull() | (correction > 0.06), "rejected_correction_limit")
        .when(depth_before - depth_after < 0.001, "rejected_no_depth_improvement")
        .when(median_increase > 0.75, "rejected_median_reprojection_degradation")
        .when(max_increase > 2.0, "rejected_camera_reprojection_degradation")
        .otherwise("accepted_depth_fusion")
    )


def average_rotations(rotations: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Sum of rotation matrices per key projected back onto the rotations; the sums are a plain aggregate."""
    keys = list(keys)
    kinds = dict(rotations.dtypes)
    sums = rotations.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names], axis=1).reshape(-1, 3, 3)
            u, _, vt = np.linalg.svd(m)
            flip = np.linalg.det(u @ vt) < 0
            u[flip, :, 2] *= -1
            flat = (u @ vt).reshape(-1, 9)
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keys] + [pa.array(flat[:, i]) for i in range(9)], names=[*keys, *names])

    return sums.mapInArrow(run, ", ".join([*[f"{k} {kinds[k]}" for k in keys], *[f"{c} double" for c in names]]))


def representative_view(views: DataFrame, keys: Sequence[str], view: str, error: str, center: Sequence[str]) -> DataFrame:
    """View with the lowest error/median(error) + distance/median(distance) to the median camera centre."""
    keys = list(keys)
    axes = ", ".join(f"'{c}', {c}" for c in center)
    tall = views.select(*keys, F.expr(f"stack({len(center)}, {axes}) AS (axis, v)"))
    mids = exact_quantiles(tall, [*keys, "axis"], F.col("v"), {"m": 0.5}).groupBy(*keys).agg(
        *[F.max(F.when(F.col("axis") == c, F.col("m"))).alias(f"__m_{c}") for c in center]
    )
    rows = attach(views, mids, keys).withColumn("__d", G.distance([F.col(c) for c in center], [F.col(f"__m_{c}") for c in center]))
    both = rows.select(*keys, F.expr(f"stack(2, 'e', {error}, 'd', __d) AS (kind, v)"))
    scale = exact_quantiles(both, [*keys, "kind"], F.col("v"), {"m": 0.5}).groupBy(*keys).agg(
        *[F.max(F.when(F.col("kind") == k, F.when(F.col("m") == 0, 1.0).otherwise(F.col("m")))).alias(f"__s_{k}") for k in "ed"]
    )
    rank = F.col(error) / F.greatest("__s_e", F.lit(1e-9)) + F.col("__d") / F.greatest("__s_d", F.lit(1e-9))
    best = attach(rows, scale, keys).where(F.col(error).isNotNull()).withColumn("__k", rank)
    return best.groupBy(*keys).agg(F.min(F.struct("__k", view)).alias("__b")).select(*keys, F.col(f"__b.{view}").alias(view), F.col("__b.__k").alias("combined"))


def camera_weights(errors: DataFrame, session: str, error: str, previous: Column | None = None, floor: float = 0.20, scale: float = 12.0, alpha: float = 0.5) -> DataFrame:
    """exp(-median error / scale) relative to the session's best camera, floored, optionally blended."""
    med = exact_quantiles(errors, [session, "camera_id"], F.col(error), {"median_error": 0.5})
    raw = med.withColumn("__w", F.exp(-F.col("median_error") / scale))
    top = raw.groupBy(session).agg(F.max("__w").alias("__top"))
    weight = clip(F.col("__w") / F.when(F.col("__top") > 1e-12, F.col("__top")).otherwise(1.0), floor, 1.0)
    if previous is not None:
        weight = clip((1.0 - alpha) * previous + alpha * weight, floor, 1.0)
    return raw.join(top, session).select(session, "camera_id", "median_error", weight.alias("weight"))


def triangulation_gate(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two versions of a point table (columns valid, error) compared per key."""
    keys = list(keys)

    def stats(df, tag):
        plain = df.groupBy(*keys).agg(F.avg(F.when(F.col("valid"), 1.0).otherwise(0.0)).alias(f"{tag}_ratio"))
        q = exact_quantiles(df, keys, F.col("error"), {f"{tag}_median": 0.5, f"{tag}_p95": 0.95})
        return plain.join(q, keys, "left")

    both = stats(before, "before").join(stats(after, "after"), keys)
    ok = lambda c: F.coalesce(~c, F.lit(True))
    return both.withColumn(
        "passed",
        (F.col("after_ratio") + 0.01 >= F.col("before_ratio"))
        & ok(upper_bound_failed(F.col("before_median"), F.col("after_median"), 1.05, 1.0))
        & ok(upper_bound_failed(F.col("before_p95"), F.col("after_p95"), 1.10, 2.0)),
    )


def feedback_report(decisions: DataFrame, session: str) -> DataFrame:
    accepted = F.col("reason") == "accepted"
    return decisions.groupBy(session, "camera_id").agg(
        count_where(accepted).alias("accepted_count"), count_where(~accepted).alias("rejected_count"),
        count_where(F.col("provenance") == 2).alias("projected_count"),
        *[count_where(F.col("reason") == r).alias(f"n_{r}") for r in DECISIONS[1:]],
    )


# Decision reasons in checking order.
DECISIONS = (
    "accepted",
    "nonfinite_candidate",
    "insufficient_image_score",
    "weak_secondary_heatmap_peak",
    "candidate_too_far_from_crossview_prior",
    "insufficient_geometric_improvement",
    "insufficient_relative_improvement",
)
