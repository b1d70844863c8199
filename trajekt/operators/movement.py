"""H: metrics of labelled movements.

Anchor windows hold 2r+1 frames, so their frames travel as one short array per movement and every
window metric is an expression over that array. Trajectory metrics aggregate per-frame steps.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.numeric import clip
from ..functions.skeleton import GROUP_RANGES, J
from .blocks import expand_range, with_halo
from .quantiles import attach, exact_quantiles

# The hand points in the order of their 21-point block.
HAND_POINTS = (
    "wrist",
    "thumb_cmc", "thumb_mcp", "thumb_ip", "thumb_tip",
    "index_mcp", "index_pip", "index_dip", "index_tip",
    "middle_mcp", "middle_pip", "middle_dip", "middle_tip",
    "ring_mcp", "ring_pip", "ring_dip", "ring_tip",
    "pinky_mcp", "pinky_pip", "pinky_dip", "pinky_tip",
)
HAND = {name: i for i, name in enumerate(HAND_POINTS)}
# Foot points.
FOOT = {"left": (17, 18, 19), "right": (20, 21, 22)}  # big toe, small toe, heel
# Eye contours and brows inside the face block that starts at 23.
LEFT_EYE, RIGHT_EYE, BROWS = range(23 + 36, 23 + 42), range(23 + 42, 23 + 48), range(23 + 17, 23 + 27)
PALM = ("wrist", "thumb_cmc", "thumb_mcp", "index_mcp", "middle_mcp", "ring_mcp", "pinky_mcp")
KNUCKLES = ("index_mcp", "middle_mcp", "ring_mcp", "pinky_mcp")
ANCHORS = ("preparation", "execution", "fixation", "kick_apex", "rechamber")

Point = tuple[Column, Column, Column]


def hand(side: str, name: str) -> int:
    return GROUP_RANGES[f"{side}_hand"][0] + HAND[name]


def by_side(side: Column, left: int, right: int) -> Column:
    return F.when(side == "left", left).otherwise(right)


def body(side: Column, name: str) -> Column:
    return by_side(side, J[f"left_{name}"], J[f"right_{name}"])


def finger(side: Column, name: str) -> Column:
    return by_side(side, hand("left", name), hand("right", name))


def other_side(side: Column) -> Column:
    return F.when(side == "left", "right").otherwise("left")


def at(frame: Column, index) -> Point:
    p = F.get(frame["pts"], index if isinstance(index, Column) else F.lit(index))
    return p["x"], p["y"], p["z"]


def mean_point(points: Sequence[Point]) -> Point:
    return tuple(sum((p[a] for p in points[1:]), points[0][a]) / float(len(points)) for a in range(3))


def flat_angle(u: Point, v: Point, undirected: bool) -> Column:
    angle = G.vector_angle(u[:2], v[:2], 1e-9)
    return F.least(angle, 180.0 - angle) if undirected else angle


# ---------------------------------------------------------------- short arrays


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Bind an expression to a lambda variable, so it is evaluated once however often ``use`` reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def with_points(f: Column, indices: Sequence, use: Callable[..., Column]) -> Column:
    """``use`` over the named points of a frame, each looked up once."""
    cells = [F.get(f["pts"], i if isinstance(i, Column) else F.lit(i)).alias(f"p{k}") for k, i in enumerate(indices)]
    return let(F.struct(*cells), lambda s: use(*[tuple(s[f"p{k}"][a] for a in "xyz") for k in range(len(cells))]))


def array_percentile(values: Column, p: float) -> Column:
    def pick(ordered):
        pos = (F.size(ordered) - 1) * F.lit(float(p))
        low = F.get(ordered, F.floor(pos).cast("int"))
        return F.when(F.size(ordered) > 0, low + (F.get(ordered, F.ceil(pos).cast("int")) - low) * (pos - F.floor(pos)))

    return let(F.array_sort(values), pick)


def known(values: Column) -> Column:
    return F.filter(values, lambda v: v.isNotNull())


def window_values(window: str | Column, metric: Callable[[Column], Column]) -> Column:
    return known(F.transform(window, metric))


def estimate(values: Column, minimum: int, p: float = 0.5) -> Column:
    return let(values, lambda v: F.when(F.size(v) >= minimum, array_percentile(v, p)))


def uncertainty_95(values: Column, minimum: int) -> Column:
    def spread(v):
        return let(
            array_percentile(v, 0.5),
            lambda mid: F.when(F.size(v) >= minimum, 1.96 * 1.4826 * array_percentile(F.transform(v, lambda x: F.abs(x - mid)), 0.5)),
        )

    return let(values, spread)


def window_point(window: str, index, minimum: int) -> Column:
    """Coordinate-wise median of a joint over the window as struct<x, y, z>, NULL with too few samples."""
    i = index if isinstance(index, Column) else F.lit(index)
    seen = known(F.transform(window, lambda f: F.get(f["pts"], i)))
    mid = lambda v: F.struct(*[array_percentile(F.transform(v, lambda p: p[a]), 0.5).alias(a) for a in "xyz"])
    return let(seen, lambda v: F.when(F.size(v) >= minimum, mid(v)))


def window_points(window_and_index: Sequence[tuple[str, object]], minimum: int, use: Callable[..., Column]) -> Column:
    cells = [window_point(w, i, minimum).alias(f"p{k}") for k, (w, i) in enumerate(window_and_index)]
    return let(F.struct(*cells), lambda s: use(*[tuple(s[f"p{k}"][a] for a in "xyz") for k in range(len(cells))]))


# ---------------------------------------------------------------- windows


def anchor_windows(frames: DataFrame, movements: DataFrame, session: str, frame: str, radius: int) -> DataFrame:
    """Movements with one array of frames per anchor (columns w_<anchor>), clipped to the segment."""
    anchors = F.array(*[F.struct(F.lit(a).alias("a"), F.col(a).cast("long").alias("f")) for a in ANCHORS])
    wanted = movements.select(session, "movement", "start_frame", "end_frame", F.inline(anchors)).where("f IS NOT NULL")
    low, high = F.greatest("start_frame", F.col("f") - radius), F.least("end_frame", F.col("f") + radius)
    wanted = wanted.select(session, "movement", "a", F.explode(F.sequence(low, high)).alias(frame))
    rows = wanted.join(frames.select(session, frame, "pts"), [session, frame])
    entry = F.struct(F.col(frame).alias("i"), "pts")
    packed = rows.groupBy(session, "movement").agg(
        *[F.array_sort(F.collect_list(F.when(F.col("a") == a, entry)), lambda p, q: (p["i"] - q["i"]).cast("int")).alias(f"w_{a}") for a in ANCHORS]
    )
    return movements.join(packed, [session, "movement"], "left")


def completed(window: str, radius: int, minimum: int) -> Column:
    """Window frames with isolated missing joints replaced by the median of the joint in the neighbouring frames."""

    def fill(f):
        def one(p, j):
            near = known(F.transform(F.filter(window, lambda g: F.abs(g["i"] - f["i"]) <= radius), lambda g: F.get(g["pts"], j)))
            mid = lambda v: F.struct(*[array_percentile(F.transform(v, lambda q: q[a]), 0.5).alias(a) for a in "xyz"])
            return F.coalesce(p, let(near, lambda v: F.when(F.size(v) >= minimum, mid(v))))

        return F.struct(f["i"].alias("i"), F.transform(f["pts"], one).alias("pts"))

    return F.transform(window, fill)


# ---------------------------------------------------------------- frame metrics (f = struct<i, pts>)


TORSO = [J[n] for n in ("left_shoulder", "right_shoulder", "left_hip", "right_hip")]
EYES = [*LEFT_EYE, *RIGHT_EYE]


def torso_lean(f) -> Column:
    def tilt(ls, rs, lh, rh):
        v = G.sub(G.mid(ls, rs), G.mid(lh, rh))
        size = G.norm(v)
        return F.when(size > 1e-9, F.degrees(F.acos(clip(v[2] / size, -1.0, 1.0))))

    return with_points(f, TORSO, tilt)


def twist(f) -> Column:
    return with_points(f, TORSO, lambda ls, rs, lh, rh: flat_angle(G.sub(rs, ls), G.sub(rh, lh), True))


def eye_line(f) -> Column:
    """Vector between the eye centres as a struct; NULL unless all contour points are known."""

    def line(*points):
        v = G.sub(mean_point(points[6:]), mean_point(points[:6]))
        return F.when(G.present(v), F.struct(*[c.alias(a) for c, a in zip(v, "xyz")]))

    return with_points(f, EYES, line)


def head_mismatch(f, scale: Column, gate: tuple[float, float]) -> Column:
    def angle(eyes):
        v = tuple(eyes[a] for a in "xyz")
        ok = (scale > 0) & (G.norm(v) / scale).between(*gate)
        return F.when(ok, with_points(f, TORSO[:2], lambda ls, rs: flat_angle(v, G.sub(rs, ls), True)))

    return let(eye_line(f), angle)


def hikite(f, side: Column, scale: Column) -> Column:
    return with_points(f, [finger(side, "wrist"), body(side, "hip")], lambda w, h: F.when(scale > 0, G.distance(w, h) / scale))


def palm_ok(wrist: Point, middle: Point, scale: Column, gate) -> Column:
    return (scale > 0) & (G.distance(wrist, middle) / scale).between(*gate)


def wrist_alignment(f, side: Column, scale: Column, gate) -> Column:
    def bend(elbow, wrist, middle):
        return F.when(palm_ok(wrist, middle, scale, gate), F.abs(180.0 - G.joint_angle(elbow, wrist, middle, 1e-9)))

    return with_points(f, [body(side, "elbow"), body(side, "wrist"), finger(side, "middle_mcp")], bend)


def fist_closure(f, side: Column, scale: Column, gate) -> Column:
    far = [n for n in HAND if n not in PALM]

    def closure(*points):
        palm, tips = points[: len(PALM)], points[len(PALM):]
        wrist, middle = palm[PALM.index("wrist")], palm[PALM.index("middle_mcp")]
        size = G.distance(wrist, middle)
        center = F.struct(*[c.alias(a) for c, a in zip(mean_point(palm), "xyz")])
        spread = let(center, lambda c: sum((G.distance(t, (c["x"], c["y"], c["z"])) for t in tips[1:]), G.distance(tips[0], (c["x"], c["y"], c["z"]))))
        return F.when(palm_ok(wrist, middle, scale, gate) & (size > 1e-9), spread / float(len(tips)) / size)

    return with_points(f, [finger(side, n) for n in (*PALM, *far)], closure)


def stance_span(f, scale: Column) -> Column:
    return with_points(f, [J["left_ankle"], J["right_ankle"]], lambda a, b: F.when(scale > 0, G.norm(G.sub(a, b)[:2]) / scale))


def wrist_height(f, side: Column) -> Column:
    """Height over the hips relative to the torso's length (not its height)."""

    def ratio(w, ls, rs, lh, rh):
        hips = G.mid(lh, rh)
        size = G.distance(G.mid(ls, rs), hips)
        return F.when(size > 1e-6, (w[2] - hips[2]) / size)

    return with_points(f, [finger(side, "wrist"), *TORSO], ratio)


def wrist_height_single(f, side: Column) -> Column:
    def ratio(w, ls, rs, lh, rh):
        hips = G.mid(lh, rh)
        height = G.mid(ls, rs)[2] - hips[2]
        return F.when(height > 1e-6, (w[2] - hips[2]) / height)

    return with_points(f, [finger(side, "wrist"), *TORSO], ratio)


def front_knee(f, side: Column) -> Column:
    return with_points(f, [body(side, n) for n in ("hip", "knee", "ankle")], lambda a, c, b: G.joint_angle(a, c, b, 1e-9))


def executing_elbow(f, side: Column) -> Column:
    return with_points(f, [body(side, n) for n in ("shoulder", "elbow", "wrist")], lambda a, c, b: G.joint_angle(a, c, b, 1e-9))


def foot_heading(f, side: Column, scale: Column, gate) -> Column:
    """Heel-to-toes vector as a struct; NULL when the foot's length is implausible."""

    def heading(big, small, heel):
        v = G.sub(G.mid(big, small), heel)
        return F.when((scale > 0) & (G.norm(v) / scale).between(*gate), F.struct(*[c.alias(a) for c, a in zip(v, "xyz")]))

    return with_points(f, [by_side(side, FOOT["left"][k], FOOT["right"][k]) for k in range(3)], heading)


def back_foot_yaw(f, front: Column, scale: Column, gate) -> Column:
    back = other_side(front)

    def yaw(h):
        def against(a, b):
            line = G.sub(a, b)
            return F.when(h.isNotNull() & (G.norm(line[:2]) / scale >= 0.10), flat_angle((h["x"], h["y"], h["z"]), line, False))

        return with_points(f, [body(front, "ankle"), body(back, "ankle")], against)

    return let(foot_heading(f, back, scale, gate), yaw)


def fist_to_thigh(f, side: Column, scale: Column, gate) -> Column:
    def ratio(i, m, r, p, hip, knee):
        width, thigh, center = G.distance(i, p), G.sub(knee, hip), mean_point([i, m, r, p])
        den = G.dot(thigh, thigh)
        k = F.least(F.greatest(G.dot(G.sub(center, hip), thigh) / F.when(den > 1e-9, den), F.lit(0.0)), F.lit(1.0))
        away = let(k, lambda t: G.distance(center, G.add(hip, G.scale(thigh, t))))
        return F.when((scale > 0) & (width / scale).between(*gate) & (den > 1e-9), away / width)

    return with_points(f, [*[finger(side, n) for n in KNUCKLES], body(side, "hip"), body(side, "knee")], ratio)


def fist_to_forehead(f, side: Column, scale: Column, hand_gate, eye_gate) -> Column:
    brows = known(F.slice(f["pts"], BROWS[0] + 1, len(BROWS)))

    def ratio(i, m, r, p):
        width = G.distance(i, p)

        def away(b):
            forehead = tuple(F.aggregate(b, F.lit(0.0), lambda s, q: s + q[a]) / F.when(F.size(b) > 0, F.size(b)) for a in "xyz")
            return F.when(F.size(b) >= 4, G.distance(mean_point([i, m, r, p]), forehead) / width)

        eyes_ok = let(eye_line(f), lambda e: (G.norm((e["x"], e["y"], e["z"])) / scale).between(*eye_gate))
        return F.when((scale > 0) & (width > 1e-9) & (width / scale).between(*hand_gate) & eyes_ok, let(brows, away))

    return with_points(f, [finger(side, n) for n in KNUCKLES], ratio)


def ankle_height(f, side: Column, scale: Column) -> Column:
    return with_points(f, [body(side, "ankle"), *TORSO[2:]], lambda a, lh, rh: F.when(scale > 0, (a[2] - G.mid(lh, rh)[2]) / scale))


# ---------------------------------------------------------------- two-window metrics


def side_dominance(prep: str, execution: str, side: Column, minimum: int) -> Column:
    def ratio(a0, a1, b0, b1):
        other = G.distance(b0, b1)
        return F.when(other.isNotNull(), G.distance(a0, a1) / F.greatest(other, F.lit(1e-6)))

    mine, theirs = body(side, "wrist"), body(other_side(side), "wrist")
    return window_points([(prep, mine), (execution, mine), (prep, theirs), (execution, theirs)], minimum, ratio)


def weight_transfer(prep: str, fixation: str, front: Column, scale: Column, minimum: int) -> Column:
    """Pelvis displacement along the rear-to-front axis; moving backwards stays negative."""

    def ratio(fa, ra, pl, pr, fl, fr):
        axis = G.sub(fa, ra)[:2]
        size = G.norm(axis)
        move = G.sub(G.mid(fl, fr)[:2], G.mid(pl, pr)[:2])
        return F.when((scale > 0) & (size > 1e-9), G.dot(move, axis) / size / scale)

    lh, rh = J["left_hip"], J["right_hip"]
    wanted = [(fixation, body(front, "ankle")), (fixation, body(other_side(front), "ankle")), (prep, lh), (prep, rh), (fixation, lh), (fixation, rh)]
    return window_points(wanted, minimum, ratio)


def support_pivot(prep: str, apex: str, side: Column, scale: Column, gate, minimum: int) -> Column:
    """Median heading change over all frame pairs of two short windows ((2r+1)^2 at most)."""
    heading = lambda f: foot_heading(f, side, scale, gate)
    angle = lambda p, q: G.vector_angle((p["x"], p["y"]), (q["x"], q["y"]), 1e-9)
    pairs = let(
        window_values(apex, heading),
        lambda b: F.flatten(F.transform(window_values(prep, heading), lambda p: known(F.transform(b, lambda q: angle(p, q))))),
    )
    return estimate(pairs, minimum)


# ---------------------------------------------------------------- segments and trajectories


def segment_frames(frames: DataFrame, movements: DataFrame, session: str, frame: str, start: str, end: str, keep: Sequence[str] = ()) -> DataFrame:
    """Frames of every movement's [start, end], as an equi-join on expanded positions."""
    wanted = list(dict.fromkeys([session, "movement", *keep, start, end]))
    span = expand_range(movements.select(*wanted), [session, "movement"], F.col(start), F.col(end), frame)
    return span.join(frames, [session, frame])


def segment_scale(labelled: DataFrame, session: str, scale: Column) -> DataFrame:
    return exact_quantiles(labelled, [session, "movement"], scale, {"scale": 0.5})


def group_coverage(labelled: DataFrame, session: str) -> DataFrame:
    """Share of visible points per joint group and movement."""

    def ratio(lo, hi):
        part = F.slice("pts", lo + 1, hi - lo + 1)
        return F.avg(F.size(F.filter(part, lambda p: p.isNotNull())) / float(hi - lo + 1))

    return labelled.groupBy(session, "movement").agg(*[ratio(*r).alias(f"coverage_{g}") for g, r in GROUP_RANGES.items()])


def trajectory_metrics(frames: DataFrame, movements: DataFrame, session: str, frame: str, fps: float, min_valid: float = 0.6) -> DataFrame:
    """Settle-time difference, fixation jitter, path efficiency and peak speed per movement.

    ``movements`` carries preparation, execution, fixation, end_frame, side, stance_side, scale.
    """
    limbs = F.array(*[F.struct(F.lit(s).alias("limb_side"), F.lit(p).alias("part"), F.get("pts", F.lit(J[f"{s}_{p}"])).alias("p")) for s in ("left", "right") for p in ("wrist", "ankle")])
    tall = frames.select(session, frame, F.inline(limbs)).select(session, frame, "limb_side", "part", *[F.col(f"p.{a}").alias(a) for a in "xyz"])
    stepped = with_halo(
        tall, [session, "limb_side", "part"], frame, 1, 0, lambda w: {"step": G.norm([F.col(a) - F.lag(a).over(w) for a in "xyz"])}
    )
    keep = ["execution", "fixation", "side", "stance_side", "scale"]
    rows = segment_frames(stepped, movements, session, frame, "preparation", "end_frame", keep)
    mine = ((F.col("part") == "wrist") & (F.col("limb_side") == F.col("side"))) | ((F.col("part") == "ankle") & (F.col("limb_side") == F.col("stance_side")))
    rows = rows.where(mine)
    i = F.col(frame)
    wrist, seen = F.col("part") == "wrist", F.col("x").isNotNull()
    to_exec, to_fix, held = i <= F.col("execution"), i <= F.col("fixation"), i >= F.col("fixation")
    inner = i > F.col("preparation")
    rows = rows.withColumn("step", F.when(inner, F.col("step")))
    key = [session, "movement"]
    ratio = lambda w: F.avg(F.when(w, F.when(seen, 1.0).otherwise(0.0)))
    xyz = F.struct("x", "y", "z")
    basic = rows.groupBy(*key).agg(
        ratio(wrist & to_exec).alias("v_exec"), ratio(wrist & held).alias("v_held"), ratio(wrist & to_fix).alias("v_wrist"), ratio(~wrist & to_fix).alias("v_ankle"),
        F.sum(F.when(wrist & to_exec, F.col("step"))).alias("path"), F.count(F.when(wrist & to_exec, F.col("step"))).alias("steps"),
        F.min_by(xyz, F.when(wrist & to_exec & seen, i)).alias("a"), F.max_by(xyz, F.when(wrist & to_exec & seen, i)).alias("z"),
        F.max(F.when(wrist & to_fix, F.col("step"))).alias("top_wrist"), F.max(F.when(~wrist & to_fix, F.col("step"))).alias("top_ankle"),
        F.count(F.when(wrist & to_fix, F.col("step"))).alias("n_wrist"), F.count(F.when(~wrist & to_fix, F.col("step"))).alias("n_ankle"),
        F.count(F.when(wrist & held & seen, 1)).alias("n_held"), F.first("scale").alias("scale"), F.max("end_frame").alias("end_frame"), F.max("fixation").alias("fixation"),
    )
    rows = attach(rows, basic.select(*key, "top_wrist", "top_ankle"), key)
    top = F.greatest(F.when(wrist, F.col("top_wrist")).otherwise(F.col("top_ankle")) * 0.20, F.lit(1e-5))
    active = to_fix & (F.col("step") >= top)
    settle = rows.groupBy(*key).agg(F.max(F.when(wrist & active, i)).alias("s_wrist"), F.max(F.when(~wrist & active, i)).alias("s_ankle"))
    entries = F.array(
        *[F.struct(F.lit(a).alias("k"), F.when(wrist & held & seen, F.col(a)).alias("v")) for a in "xyz"],
        F.struct(F.lit("speed").alias("k"), F.when(wrist & to_exec, F.col("step") * fps).alias("v")),
    )
    q = exact_quantiles(rows.select(*key, F.inline(entries)), [*key, "k"], F.col("v"), {"m": 0.5, "p": 0.95})
    pick = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    mids = q.groupBy(*key).agg(*[pick(a, "m").alias(f"m{a}") for a in "xyz"], pick("speed", "p").alias("speed95"))
    away = attach(rows.where(wrist & held & seen), mids.select(*key, "mx", "my", "mz"), key)
    jitter = exact_quantiles(away, key, G.distance([F.col(a) for a in "xyz"], [F.col(f"m{a}") for a in "xyz"]), {"jit": 0.95})
    out = basic.join(settle, key, "left").join(mids.select(*key, "speed95"), key, "left").join(jitter, key, "left")
    scale = F.when(F.col("scale") > 0, F.col("scale"))
    direct = G.distance([F.col(f"z.{a}") for a in "xyz"], [F.col(f"a.{a}") for a in "xyz"])
    good = (F.col("v_wrist") >= min_valid) & (F.col("v_ankle") >= min_valid) & (F.col("n_wrist") >= 2) & (F.col("n_ankle") >= 2)
    return out.select(
        *key,
        F.when(good, F.abs(F.col("s_wrist") - F.col("s_ankle")) / fps).alias("hand_foot_settle_difference_sec"),
        F.when((F.col("v_held") >= min_valid) & (F.col("n_held") >= 3) & (F.col("end_frame") > F.col("fixation")), F.col("jit") / scale).alias("fixation_wrist_jitter_ratio"),
        F.when((F.col("v_exec") >= min_valid) & (F.col("steps") >= 2) & (direct > 1e-6), F.col("path") / direct).alias("executing_wrist_path_efficiency"),
        F.when(F.col("v_exec") >= min_valid, F.col("speed95") / scale).alias("executing_wrist_peak_speed"),
    )


# ---------------------------------------------------------------- screening


def screen(value: Column, operator: Column, lo: Column, hi: Column) -> tuple[Column, Column, Column]:
    """Status, margin and normalised margin against a max, min or range rule; no rule = diagnostic only."""
    width = lambda c: F.greatest(F.abs(c), F.lit(1e-9))
    margin = (
        F.when(operator == "max", value - hi).when(operator == "min", lo - value)
        .when(operator == "range", F.when(value < lo, lo - value).when(value > hi, value - hi).otherwise(-F.least(value - lo, hi - value)))
    )
    base = F.when(operator == "max", width(hi)).when(operator == "min", width(lo)).when(
        operator == "range", F.when(value < lo, width(lo)).when(value > hi, width(hi)).otherwise(width(hi - lo))
    )
    status = (
        F.when(operator.isNull(), "measured_diagnostic_only").when(value.isNull(), "not_measurable").when(margin > 0, "review_candidate").otherwise("within_screening_range")
    )
    return status, margin, margin / base


def evidence_status(ratio: Column, cameras: Column) -> Column:
    return F.when((ratio >= 0.90) & (cameras >= 2), "observed").when(ratio >= 0.70, "partial").otherwise("not_measurable")
