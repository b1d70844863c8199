"""C: projections, predicates and scalar math."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.numeric import clip, fixed, mean_of, ratio
from ..functions.skeleton import ANGLES, J, LENGTHS, MASS_SEGMENTS
from ..operators import boxes as B
from ..operators.quantiles import exact_quantiles
from . import oracle as O
from . import tables as T
from .registry import query

r6 = T.r6


@query(
    "c1_normalise_keypoints",
    f"""WITH {T.SQL_VIEWS},
raw AS (SELECT session_id, sample_idx, joint_idx, camera_id, px, py,
  CASE WHEN (vec_id + joint_idx) % 37 = 0 THEN NULL ELSE score * 1.2 - 0.1 END AS s FROM p2)
SELECT session_id, sample_idx, joint_idx, camera_id, {r6('px')} AS px, {r6('py')} AS py,
  {r6('CASE WHEN s IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, s)) END')} AS score,
  (px IS NOT NULL AND py IS NOT NULL AND s IS NOT NULL AND greatest(0.0, least(1.0, s)) >= 0.45) AS valid
FROM raw""",
)
def c1(spark, sf):
    raw = T.pose2d(spark, sf).withColumn(
        "s", F.expr("CASE WHEN (vec_id + joint_idx) % 37 = 0 THEN double('NaN') ELSE score * 1.2 - 0.1 END")
    )
    return normalise_keypoints(raw, "px", "py", "s", 0.45).select(
        "session_id", "sample_idx", "joint_idx", "camera_id", fixed("px").alias("px"), fixed("py").alias("py"),
        fixed("score").alias("score"), "valid",
    )


def normalise_keypoints(df, x: str, y: str, score: str, threshold: float):
    """Finite coordinates or NULL, score in [0, 1] (non-finite = 0), validity flag."""
    from ..functions.numeric import finite

    s, px, py = finite(score), finite(x), finite(y)
    known = px.isNotNull() & py.isNotNull()
    good = clip(s, 0.0, 1.0)
    return df.withColumns(
        {
            x: F.when(known, px),
            y: F.when(known, py),
            "score": F.coalesce(good, F.lit(0.0)),
            "valid": known & F.coalesce(good >= threshold, F.lit(False)),
        }
    )


@query(
    "c2_best_candidate",
    f"""WITH {T.SQL_VIEWS},
m AS (SELECT session_id, sample_idx, camera_id, coalesce(avg(score) FILTER (WHERE (vec_id + joint_idx) % 9 <> 0), 0.0) AS s
  FROM p2 GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY session_id, sample_idx ORDER BY floor(s * 1e9 + 0.5) DESC, camera_id) AS rn FROM m)
SELECT session_id, sample_idx, camera_id AS candidate, {r6('s')} AS candidate_score FROM rk WHERE rn = 1""",
)
def c2(spark, sf):
    # each view's detection is one candidate of the frame; the first in candidate order wins a tie
    seen = T.pose2d(spark, sf)
    scored = seen.groupBy("session_id", "sample_idx", "camera_id").agg(
        F.coalesce(F.avg(F.when((F.col("vec_id") + F.col("joint_idx")) % 9 != 0, F.col("score"))), F.lit(0.0)).alias("s")
    )
    # first in candidate order wins a tie: min over (-score, candidate) is a plain aggregate
    return (
        scored.groupBy("session_id", "sample_idx")
        .agg(F.min(F.struct((-F.floor(F.col("s") * 1e9 + 0.5)).alias("k"), "camera_id", "s")).alias("b"))
        .select("session_id", "sample_idx", F.col("b.camera_id").alias("candidate"), fixed("b.s").alias("candidate_score"))
    )


def accepted(error="reproj_px", score="tri_score", cameras="used_cameras", max_error=25.0, min_score=0.2, min_views=2):
    """Acceptance predicate; an optional column that a table does not have is passed as None."""
    out = F.lit(True)
    if error is not None:
        out = out & F.coalesce(F.col(error) <= max_error, F.lit(False))
    if score is not None:
        out = out & F.coalesce(F.col(score) >= min_score, F.lit(False))
    if cameras is not None:
        out = out & F.coalesce(F.col(cameras) >= min_views, F.lit(False))
    return out


@query(
    "c3_acceptance_predicate",
    f"""WITH {T.SQL_LONG} SELECT session_id, sample_idx, joint_idx FROM p3
WHERE reproj_px <= 15 AND tri_score >= 0.2 AND used_cameras >= 2""",
)
def c3(spark, sf):
    return T.pose3d(spark, sf).where(accepted(max_error=15.0)).select("session_id", "sample_idx", "joint_idx")


@query(
    "c4_quality_mask",
    f"""WITH {T.SQL_LONG}, q AS (SELECT *, (x IS NOT NULL AND reproj_px <= 15 AND used_cameras >= 2) AS ok FROM p3)
SELECT session_id, sample_idx, joint_idx, {r6('CASE WHEN ok THEN x END')} AS x, {r6('CASE WHEN ok THEN y END')} AS y,
 {r6('CASE WHEN ok THEN z END')} AS z FROM q""",
)
def c4(spark, sf):
    ok = accepted(score=None, max_error=15.0) & F.col("x").isNotNull()
    return T.pose3d(spark, sf).select(
        "session_id", "sample_idx", "joint_idx", *[fixed(F.when(ok, F.col(c))).alias(c) for c in "xyz"]
    )


# Row-major bases of the three supported input conventions.
PRESET_BASES = {
    "camera_reference": [1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0],
    "centimetre_y_up": [0.01, 0.0, 0.0, 0.0, 0.0, 0.0, 0.01, 0.0, 0.0, 0.01, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0],
    "millimetre_y_up_back": [0.001, 0.0, 0.0, 0.0, 0.0, 0.0, -0.001, 0.0, 0.0, 0.001, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0],
}


@query(
    "c5_coordinate_transform",
    f"""WITH {T.SQL_LONG} SELECT session_id, sample_idx, joint_idx,
{r6('x')} AS x_camera, {r6('z')} AS y_camera, {r6('-1.0 * y')} AS z_camera,
{r6('x * 0.01', 8)} AS x_cm, {r6('z * 0.01', 8)} AS y_cm, {r6('y * 0.01', 8)} AS z_cm,
{r6('x * 0.001', 9)} AS x_mm, {r6('z * -0.001', 9)} AS y_mm, {r6('y * 0.001', 9)} AS z_mm FROM p3""",
)
def c5(spark, sf):
    df = T.pose3d(spark, sf)
    here = tuple(F.col(c) for c in "xyz")
    out = ["session_id", "sample_idx", "joint_idx"]
    for suffix, preset, digits in (("camera", "camera_reference", 6), ("cm", "centimetre_y_up", 8), ("mm", "millimetre_y_up_back", 9)):
        moved = G.transform(here, [F.lit(v) for v in PRESET_BASES[preset]])
        out += [fixed(c, digits).alias(f"{a}_{suffix}") for a, c in zip("xyz", moved)]
    return df.select(*out)


def _sql_projected(dist: tuple[float, ...] | None = None) -> str:
    return (
        "(p[1] * x + p[2] * y + p[3] * z + p[4])", "(p[5] * x + p[6] * y + p[7] * z + p[8])",
        "(p[9] * x + p[10] * y + p[11] * z + p[12])",
    )


_U, _V, _W = _sql_projected()


@query(
    "c6_reprojection_error",
    f"""WITH {T.SQL_VIEWS}, {T.SQL_CAMERAS},
e AS (SELECT session_id, sample_idx, joint_idx, camera_id,
  sqrt(pow({_U} / {_W} - px, 2) + pow({_V} / {_W} - py, 2)) AS err FROM p2 JOIN cam USING (camera_id))
SELECT session_id, sample_idx, joint_idx, count(err) AS view_count, {r6('avg(err)')} AS mean_error_px, {r6('max(err)')} AS max_error_px
FROM e GROUP BY ALL""",
)
def c6(spark, sf):
    # the camera dimension has one row per camera of the rig (four here)
    seen = T.pose2d(spark, sf).join(F.broadcast(T.cameras(spark)), "camera_id")
    u, v, _ = G.project((F.col("x"), F.col("y"), F.col("z")), G.array_matrix("p", 12))
    error = F.sqrt((u - F.col("px")) ** 2 + (v - F.col("py")) ** 2)
    return (
        seen.withColumn("err", error)
        .groupBy("session_id", "sample_idx", "joint_idx")
        .agg(
            F.count("err").alias("view_count"), fixed(F.avg("err")).alias("mean_error_px"),
            fixed(F.max("err")).alias("max_error_px"),
        )
    )


LENS = (-0.12, 0.03, 0.001, -0.0005, 0.002)
_XC = "(rot[1] * x + rot[2] * y + rot[3] * z + tvec[1])"
_YC = "(rot[4] * x + rot[5] * y + rot[6] * z + tvec[2])"
_ZC = "(rot[7] * x + rot[8] * y + rot[9] * z + tvec[3])"


def _sql_distort() -> tuple[str, str]:
    k1, k2, p1, p2, k3 = LENS
    r2 = "(xn * xn + yn * yn)"
    rad = f"(1.0 + {r2} * ({k1} + {r2} * ({k2} + {r2} * {k3})))"
    xd = f"(xn * {rad} + 2.0 * {p1} * xn * yn + {p2} * ({r2} + 2.0 * xn * xn))"
    yd = f"(yn * {rad} + {p1} * ({r2} + 2.0 * yn * yn) + 2.0 * {p2} * xn * yn)"
    return xd, yd


@query(
    "c7_distorted_projection",
    f"""WITH {T.SQL_LONG}, {T.SQL_CAMERAS},
n AS (SELECT session_id, sample_idx, joint_idx, camera_id, k, {_XC} / {_ZC} AS xn, {_YC} / {_ZC} AS yn, {_ZC} AS zc FROM p3, cam)
SELECT session_id, sample_idx, joint_idx, camera_id,
 {r6(f'CASE WHEN zc > 1e-9 THEN k[1] * {_sql_distort()[0]} + k[3] END')} AS u,
 {r6(f'CASE WHEN zc > 1e-9 THEN k[5] * {_sql_distort()[1]} + k[6] END')} AS v FROM n""",
)
def c7(spark, sf):
    rig = F.array(*[
        F.struct(F.lit(name).alias("camera_id"), F.array(*map(F.lit, T.rotation(name))).alias("rot"))
        for name in T.CAMERAS
    ])
    seen = T.pose3d(spark, sf).withColumn("c", F.explode(rig))
    u, v = G.project_distorted(
        (F.col("x"), F.col("y"), F.col("z")), G.array_matrix("c.rot", 9),
        [F.lit(0.0), F.lit(0.0), F.lit(T.DEPTH)], T.intrinsics(), LENS,
    )
    return seen.select("session_id", "sample_idx", "joint_idx", "c.camera_id", fixed(u).alias("u"), fixed(v).alias("v"))


def _sql_rodrigues() -> list[str]:
    x, y, z, c, s = "(rx / th)", "(ry / th)", "(rz / th)", "cos(th)", "sin(th)"
    v = f"(1.0 - {c})"
    return [
        f"{c} + {x} * {x} * {v}", f"{x} * {y} * {v} - {z} * {s}", f"{x} * {z} * {v} + {y} * {s}",
        f"{y} * {x} * {v} + {z} * {s}", f"{c} + {y} * {y} * {v}", f"{y} * {z} * {v} - {x} * {s}",
        f"{z} * {x} * {v} - {y} * {s}", f"{z} * {y} * {v} + {x} * {s}", f"{c} + {z} * {z} * {v}",
    ]


_R = [f"({t})" for t in _sql_rodrigues()]


@query(
    "c8_camera_matrices",
    f"""WITH {T.SQL_FRAMES}, rv AS (SELECT vec_id, x0 * 3 AS rx, y0 * 3 AS ry, z0 * 3 AS rz, x1 AS tx, y1 AS ty, z1 + 4 AS tz,
  sqrt(x0 * 3 * x0 * 3 + y0 * 3 * y0 * 3 + z0 * 3 * z0 * 3) AS th FROM fr WHERE x0 IS NOT NULL AND x1 IS NOT NULL)
SELECT vec_id, {', '.join(f'{r6(t)} AS r{i}' for i, t in enumerate(_R))},
 {r6(f'-({_R[0]} * tx + {_R[3]} * ty + {_R[6]} * tz)')} AS center_x, {r6(f'-({_R[1]} * tx + {_R[4]} * ty + {_R[7]} * tz)')} AS center_y,
 {r6(f'-({_R[2]} * tx + {_R[5]} * ty + {_R[8]} * tz)')} AS center_z,
 {r6(f'1000.0 * {_R[0]} + 640.0 * {_R[6]}', 4)} AS p0, {r6('1000.0 * tx + 640.0 * tz', 4)} AS p3, {r6('1000.0 * ty + 360.0 * tz', 4)} AS p7
FROM rv""",
)
def c8(spark, sf):
    f = T.frames(spark, sf).where(G.present(G.point(0)) & G.present(G.point(1)))
    r = G.rotation_from_vector(G.scale(G.point(0), 3.0))
    tx, ty, tz = G.point(1)
    t = (tx, ty, tz + 4.0)
    center = G.camera_center(r, t)
    pose = [r[0], r[1], r[2], t[0], r[3], r[4], r[5], t[1], r[6], r[7], r[8], t[2]]
    p = G.matmul3([F.lit(v) for v in T.intrinsics()], pose, 4)
    return f.select(
        "vec_id", *[fixed(c).alias(f"r{i}") for i, c in enumerate(r)],
        *[fixed(c).alias(f"center_{a}") for a, c in zip("xyz", center)],
        fixed(p[0], 4).alias("p0"), fixed(p[3], 4).alias("p3"), fixed(p[7], 4).alias("p7"),
    )


def _sql_undistort(steps: int) -> str:
    k1, k2, p1, p2, k3 = LENS
    text = "u0 AS (SELECT session_id, sample_idx, joint_idx, camera_id, (px - 640.0) / 1000.0 AS x_0, (py - 360.0) / 1000.0 AS y_0, (px - 640.0) / 1000.0 AS xa, (py - 360.0) / 1000.0 AS ya FROM p2)"
    for i in range(steps):
        r2 = "(xa * xa + ya * ya)"
        inv = f"(1.0 / (1.0 + {r2} * ({k1} + {r2} * ({k2} + {r2} * {k3}))))"
        dx = f"(2.0 * {p1} * xa * ya + {p2} * ({r2} + 2.0 * xa * xa))"
        dy = f"({p1} * ({r2} + 2.0 * ya * ya) + 2.0 * {p2} * xa * ya)"
        text += f", u{i + 1} AS (SELECT session_id, sample_idx, joint_idx, camera_id, x_0, y_0, (x_0 - {dx}) * {inv} AS xa, (y_0 - {dy}) * {inv} AS ya FROM u{i})"
    return text


@query(
    "c9_undistort_points",
    f"""WITH {T.SQL_VIEWS}, {_sql_undistort(5)}
SELECT session_id, sample_idx, joint_idx, camera_id, {r6('x_0')} AS pinhole_x, {r6('y_0')} AS pinhole_y, {r6('xa')} AS x_norm, {r6('ya')} AS y_norm FROM u5""",
)
def c9(spark, sf):
    seen = T.pose2d(spark, sf)
    k = T.intrinsics()
    stepped = seen.withColumns({"xa": (F.col("px") - k[2]) / k[0], "ya": (F.col("py") - k[5]) / k[4]})
    stepped = undistort_by_columns(stepped, "xa", "ya", LENS)
    return stepped.select(
        "session_id", "sample_idx", "joint_idx", "camera_id",
        fixed((F.col("px") - k[2]) / k[0]).alias("pinhole_x"), fixed((F.col("py") - k[5]) / k[4]).alias("pinhole_y"),
        fixed("xa").alias("x_norm"), fixed("ya").alias("y_norm"),
    )


def undistort_by_columns(df, x: str, y: str, lens, steps: int = 5):
    """Fixed-point inverse of the lens model as a fold over a struct, so the expression stays small."""
    k1, k2, p1, p2, k3 = (float(v) for v in lens)

    def step(state, _):
        sx, sy = state["x"], state["y"]
        r2 = sx * sx + sy * sy
        inverse = 1.0 / (1.0 + r2 * (k1 + r2 * (k2 + r2 * k3)))
        dx = 2.0 * p1 * sx * sy + p2 * (r2 + 2.0 * sx * sx)
        dy = p1 * (r2 + 2.0 * sy * sy) + 2.0 * p2 * sx * sy
        return F.struct(((F.col(x) - dx) * inverse).alias("x"), ((F.col(y) - dy) * inverse).alias("y"))

    start = F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    solved = df.withColumn("__n", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step))
    return solved.withColumns({x: F.col("__n.x"), y: F.col("__n.y")}).drop("__n")


@query(
    "c10_camera_pose_to_calibration",
    f"""WITH {T.SQL_FRAMES}, rv AS (SELECT vec_id, x0 * 3 AS rx, y0 * 3 AS ry, z0 * 3 AS rz, x1 AS tx, y1 AS ty, z1 + 4 AS tz,
  sqrt(x0 * 3 * x0 * 3 + y0 * 3 * y0 * 3 + z0 * 3 * z0 * 3) AS th FROM fr WHERE x0 IS NOT NULL AND x1 IS NOT NULL)
SELECT vec_id, {r6(_R[0])} AS w0, {r6(_R[3])} AS w1, {r6(_R[6])} AS w2, {r6(_R[1])} AS w3, {r6(_R[4])} AS w4, {r6(_R[7])} AS w5,
 {r6(f'-({_R[0]} * tx + {_R[3]} * ty + {_R[6]} * tz)')} AS t0, {r6(f'-({_R[1]} * tx + {_R[4]} * ty + {_R[7]} * tz)')} AS t1,
 {r6(f'-({_R[2]} * tx + {_R[5]} * ty + {_R[8]} * tz)')} AS t2,
 {r6(f'1000.0 * {_R[0]} + 640.0 * {_R[2]}', 4)} AS p0
FROM rv""",
)
def c10(spark, sf):
    """Camera-to-world poses inverted in closed form (R' and -R't), then K[R|t]."""
    f = T.frames(spark, sf).where(G.present(G.point(0)) & G.present(G.point(1)))
    r = G.rotation_from_vector(G.scale(G.point(0), 3.0))
    tx, ty, tz = G.point(1)
    inverse = G.transpose3(r)
    shift = G.camera_center(r, (tx, ty, tz + 4.0))
    pose = [inverse[0], inverse[1], inverse[2], shift[0], inverse[3], inverse[4], inverse[5], shift[1], inverse[6], inverse[7], inverse[8], shift[2]]
    p = G.matmul3([F.lit(v) for v in T.intrinsics()], pose, 4)
    return f.select(
        "vec_id", *[fixed(inverse[i]).alias(f"w{i}") for i in range(6)],
        *[fixed(c).alias(f"t{i}") for i, c in enumerate(shift)], fixed(p[0], 4).alias("p0"),
    )


@query(
    "c11_joint_angles",
    f"WITH {T.SQL_FRAMES} SELECT vec_id, "
    + ", ".join(f"{r6(O.angle(a, c, b))} AS {n}" for n, (a, c, b) in ANGLES.items())
    + " FROM fr",
)
def c11(spark, sf):
    return T.frames(spark, sf).select(
        "vec_id", *[fixed(G.joint_angle(G.joint(a), G.joint(c), G.joint(b))).alias(n) for n, (a, c, b) in ANGLES.items()]
    )


@query(
    "c12_segment_lengths",
    f"WITH {T.SQL_FRAMES} SELECT vec_id, " + ", ".join(f"{r6(O.dist(a, b))} AS {n}_len" for n, (a, b) in LENGTHS.items()) + " FROM fr",
)
def c12(spark, sf):
    return T.frames(spark, sf).select("vec_id", *[fixed(c).alias(f"{n}_len") for n, c in G.segment_lengths().items()])


_TORSO = O.v_sub(O.v_mid(O.pt("left_shoulder"), O.pt("right_shoulder")), O.v_mid(O.pt("left_hip"), O.pt("right_hip")))
_PART = tuple(
    f"({O.mean2(O.pt('left_shoulder')[a], O.pt('right_shoulder')[a])}) - ({O.mean2(O.pt('left_hip')[a], O.pt('right_hip')[a])})"
    for a in range(3)
)
_PARTV = tuple(f"({t})" for t in _PART)


@query(
    "c13_torso_lean",
    f"""WITH {T.SQL_FRAMES} SELECT vec_id,
 {r6(f'CASE WHEN {O.v_norm(_PARTV)} > 0 THEN degrees(atan2({_PARTV[1]}, {_PARTV[2]})) END')} AS lean_signed_deg,
 {r6(f'degrees(atan2(abs({_TORSO[1]}), abs({_TORSO[2]})))')} AS lean_vertical_deg,
 {r6(f'CASE WHEN {O.v_norm(_TORSO)} > 1e-9 THEN degrees(acos(greatest(-1.0, least(1.0, {_TORSO[2]} / {O.v_norm(_TORSO)})))) END')} AS tilt_deg
FROM fr""",
)
def c13(spark, sf):
    return T.frames(spark, sf).select(
        "vec_id", fixed(G.torso_lean_signed()).alias("lean_signed_deg"),
        fixed(G.torso_lean_from_vertical()).alias("lean_vertical_deg"), fixed(G.torso_tilt()).alias("tilt_deg"),
    )


@query(
    "c14_stance_measures",
    f"""WITH {T.SQL_FRAMES} SELECT vec_id, {r6(f'abs(x15 - x16)')} AS stance_width, {r6('abs(y15 - y16)')} AS stance_length,
 {r6('abs(x13 - x15)')} AS left_alignment, {r6('abs(x14 - x16)')} AS right_alignment, {r6('0.5 * (z11 + z12)')} AS pelvis_height FROM fr""",
)
def c14(spark, sf):
    la, ra, lk, rk = (G.joint(n) for n in ("left_ankle", "right_ankle", "left_knee", "right_knee"))
    return T.frames(spark, sf).select(
        "vec_id", fixed(F.abs(la[0] - ra[0])).alias("stance_width"), fixed(F.abs(la[1] - ra[1])).alias("stance_length"),
        fixed(F.abs(lk[0] - la[0])).alias("left_alignment"), fixed(F.abs(rk[0] - ra[0])).alias("right_alignment"),
        fixed(G.mid(G.joint("left_hip"), G.joint("right_hip"))[2]).alias("pelvis_height"),
    )


@query(
    "c15_body_scale",
    f"""WITH {T.SQL_FRAMES}, s AS (SELECT *, {O.SCALE} AS scale, (z5 + z6) / 2 - (z11 + z12) / 2 AS th FROM fr)
SELECT vec_id, {r6('scale')} AS body_scale, {r6(f'CASE WHEN scale > 0 THEN {O.dist(15, 16)} / scale END')} AS stance_span_ratio,
 {r6('CASE WHEN th > 1e-6 THEN (z9 - (z11 + z12) / 2) / th END')} AS left_wrist_height,
 {r6('CASE WHEN th > 1e-6 THEN (z10 - (z11 + z12) / 2) / th END')} AS right_wrist_height FROM s""",
)
def c15(spark, sf):
    f = T.frames(spark, sf)
    size = G.body_scale()
    torso = G.torso_vector()
    # the height ratio needs both ends of the torso complete, which torso_vector's NULLs already say
    hip_z = G.mid(G.joint("left_hip"), G.joint("right_hip"))[2]
    return f.select(
        "vec_id", fixed(size).alias("body_scale"),
        fixed(ratio(G.distance(G.joint("left_ankle"), G.joint("right_ankle")), size)).alias("stance_span_ratio"),
        *[fixed(ratio(G.joint(f"{s}_wrist")[2] - hip_z, torso[2], 1e-6)).alias(f"{s}_wrist_height") for s in ("left", "right")],
    )


@query(
    "c16_body_box_scale",
    f"""WITH {T.SQL_LONG}, d AS (SELECT session_id, sample_idx, CASE WHEN count(x) >= 2 THEN
  sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2) + pow(max(z) - min(z), 2)) END AS diag FROM p3 GROUP BY ALL),
m AS (SELECT session_id, coalesce(quantile_cont(diag, 0.5) FILTER (WHERE diag > 1e-9), 1.0) AS fb FROM d GROUP BY ALL)
SELECT session_id, sample_idx, {r6('CASE WHEN diag > 1e-9 THEN diag ELSE fb END')} AS box_scale FROM d JOIN m USING (session_id)""",
)
def c16(spark, sf):
    return box_diagonal_scale(T.pose3d(spark, sf), "session_id", "sample_idx", "xyz").select(
        "session_id", "sample_idx", fixed("box_scale").alias("box_scale")
    )


def box_diagonal_scale(points, session: str, frame: str, axes):
    """Diagonal of each frame's body box; frames without one take the session's median."""
    span = sum(((F.max(a) - F.min(a)) ** 2 for a in axes), F.lit(0.0))
    diag = points.groupBy(session, frame).agg(F.when(F.count(axes[0]) >= 2, F.sqrt(span)).alias("__d"))
    good = F.when(F.col("__d") > 1e-9, F.col("__d"))
    middle = exact_quantiles(diag, [session], good, {"__m": 0.5})
    return diag.join(middle, session, "left").select(
        session, frame, F.coalesce(good, F.col("__m"), F.lit(1.0)).alias("box_scale")
    )


def _sql_com() -> str:
    sums = {a: [] for a in range(3)}
    weights = []
    for mass, members in MASS_SEGMENTS.values():
        n = " + ".join(f"(x{J[m]} IS NOT NULL)::INT" for m in members)
        weights.append(f"CASE WHEN {n} > 0 THEN {mass} ELSE 0.0 END")
        for a, axis in enumerate("xyz"):
            tot = " + ".join(f"coalesce({axis}{J[m]}, 0.0)" for m in members)
            sums[a].append(f"CASE WHEN {n} > 0 THEN {mass} * (({tot}) / ({n})) ELSE 0.0 END")
    w = " + ".join(weights)
    return ", ".join(f"{r6(f'CASE WHEN {w} > 0 THEN ({chr(32)}{chr(43).join(sums[a])}) / ({w}) END')} AS com_{axis}" for a, axis in enumerate("xyz"))


@query("c17_center_of_mass", f"WITH {T.SQL_FRAMES} SELECT vec_id, {_sql_com()} FROM fr")
def c17(spark, sf):
    return T.frames(spark, sf).select("vec_id", *[fixed(c).alias(f"com_{a}") for a, c in zip("xyz", G.center_of_mass())])


def _sql_bbox(count: int, floor: float, cond: str = "TRUE") -> str:
    return f"""ext AS (SELECT session_id, sample_idx, camera_id, count(px) FILTER (WHERE {cond}) AS n, min(px) FILTER (WHERE {cond}) AS a0,
 min(py) FILTER (WHERE {cond}) AS b0, max(px) FILTER (WHERE {cond}) AS a1, max(py) FILTER (WHERE {cond}) AS b1 FROM p2 GROUP BY ALL),
bx AS (SELECT *, (a0 + a1) / 2 AS cx, (b0 + b1) / 2 AS cy, greatest(a1 - a0, {floor}) * 1.35 AS w, greatest(b1 - b0, {floor}) * 1.35 AS h FROM ext)"""


def _clip_sql(expr: str, hi: int) -> str:
    return f"greatest(0.0, least({hi}.0, {expr}))"


@query(
    "c18_box_from_points",
    f"""WITH {T.SQL_VIEWS}, {_sql_bbox(5, 32.0, 'score >= 0.5')}
SELECT session_id, sample_idx, camera_id, n AS point_count,
 {r6('CASE WHEN n >= 5 THEN ' + _clip_sql('cx - w / 2', 1279) + ' END')} AS x0, {r6('CASE WHEN n >= 5 THEN ' + _clip_sql('cy - h / 2', 719) + ' END')} AS y0,
 {r6('CASE WHEN n >= 5 THEN ' + _clip_sql('cx + w / 2', 1279) + ' END')} AS x1, {r6('CASE WHEN n >= 5 THEN ' + _clip_sql('cy + h / 2', 719) + ' END')} AS y1 FROM bx""",
)
def c18(spark, sf):
    seen = T.pose2d(spark, sf)
    good = F.col("score") >= 0.5
    out = B.boxes_from_points(
        seen, ["session_id", "sample_idx", "camera_id"], F.when(good, F.col("px")), F.when(good, F.col("py")), image=(1280, 720)
    )
    return out.select("session_id", "sample_idx", "camera_id", "point_count", *[fixed(c).alias(n) for n, c in zip(("x0", "y0", "x1", "y1"), B.box("bbox"))])


@query(
    "c18_box_algebra",
    f"""WITH {T.SQL_VIEWS}, {_sql_bbox(10, 24.0)},
q AS (SELECT * FROM bx WHERE n >= 10),
pr AS (SELECT a.session_id, a.sample_idx, a.cx, a.cy, a.w, a.h, b.cx AS vx, b.cy AS vy, b.w AS vw, b.h AS vh
  FROM q a JOIN q b ON a.session_id = b.session_id AND a.sample_idx = b.sample_idx AND a.camera_id = 'c0' AND b.camera_id = 'c1'),
t AS (SELECT *, greatest(w, 2.0) * 1.3 AS pw, greatest(h, 2.0) * 1.3 AS ph,
  (w * 1.25) / greatest(h * 1.25, 1e-6) > 0.75 AS wide,
  sqrt(pow(cx - vx, 2) + pow(cy - vy, 2)) > 0.55 * sqrt(pow(greatest(w, 32.0), 2) + pow(greatest(h, 32.0), 2)) AS far FROM pr)
SELECT session_id, sample_idx, {r6(_clip_sql('cx - pw / 2', 1279))} AS pad_x0, {r6(_clip_sql('cy + ph / 2', 719))} AS pad_y1,
 {r6('cx - greatest(CASE WHEN wide THEN w * 1.25 ELSE h * 1.25 * 0.75 END, 32.0) / 2')} AS aspect_x0,
 {r6('cy + greatest(CASE WHEN wide THEN w * 1.25 / 0.75 ELSE h * 1.25 END, 32.0) / 2')} AS aspect_y1,
 {r6('CASE WHEN far THEN cx - w / 2 ELSE 0.7 * cx + 0.3 * vx - greatest(w, 0.8 * vw) / 2 END')} AS merged_x0,
 {r6('CASE WHEN far THEN cy + h / 2 ELSE 0.7 * cy + 0.3 * vy + greatest(h, 0.8 * vh) / 2 END')} AS merged_y1,
 sqrt(pow((vx - cx) / greatest(w, 32.0), 2) + pow((vy - cy) / greatest(h, 32.0), 2)) > 0.72 AS reacquire FROM t""",
)
def c18b(spark, sf):
    boxes = B.boxes_from_points(T.pose2d(spark, sf), ["session_id", "sample_idx", "camera_id"], F.col("px"), F.col("py"), 10, 24.0).where(
        F.col("bbox").isNotNull()
    )
    # the two views of a frame meet in one group: conditional aggregation, no self-join
    pair = boxes.groupBy("session_id", "sample_idx").agg(
        F.first(F.when(F.col("camera_id") == "c0", F.col("bbox")), ignorenulls=True).alias("a"),
        F.first(F.when(F.col("camera_id") == "c1", F.col("bbox")), ignorenulls=True).alias("b"),
    ).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    a, b = B.box("a"), B.box("b")
    padded, shaped, merged = B.pad(a, 1280, 720, 0.15), B.to_aspect(a, 0.75), B.merge(a, b)
    return pair.select(
        "session_id", "sample_idx", fixed(padded[0]).alias("pad_x0"), fixed(padded[3]).alias("pad_y1"),
        fixed(shaped[0]).alias("aspect_x0"), fixed(shaped[3]).alias("aspect_y1"),
        fixed(merged[0]).alias("merged_x0"), fixed(merged[3]).alias("merged_y1"), B.needs_reacquisition(a, b).alias("reacquire"),
    )


_ANCH = ["5", "6", "11", "12"]


@query(
    "c19_centered_points",
    f"""WITH {T.SQL_LONG}, a AS (SELECT session_id, sample_idx,
 avg(x) FILTER (WHERE joint_idx IN (5, 6, 11, 12)) AS ax, avg(y) FILTER (WHERE joint_idx IN (5, 6, 11, 12)) AS ay, avg(z) FILTER (WHERE joint_idx IN (5, 6, 11, 12)) AS az,
 median(x) AS mx, median(y) AS my, median(z) AS mz FROM p3 GROUP BY ALL)
SELECT session_id, sample_idx, joint_idx, {r6('x - coalesce(ax, mx)')} AS x, {r6('y - coalesce(ay, my)')} AS y, {r6('z - coalesce(az, mz)')} AS z
FROM p3 JOIN a USING (session_id, sample_idx)""",
)
def c19(spark, sf):
    """Body-centred copy of each frame: the array stays in its row, so there is no shuffle."""
    f = T.sequence_frames(spark, sf)
    anchors = [G.point(i) for i in (5, 6, 11, 12)]
    known = F.filter("pts", lambda p: p.isNotNull())

    def middle(axis: str):
        ordered = F.array_sort(F.transform(known, lambda p: p[axis]))
        n = F.size(ordered)
        return F.when(n > 0, (ordered[F.floor((n - 1) / 2).cast("int")] + ordered[F.floor(n / 2).cast("int")]) / 2.0)

    f = f.withColumns({f"c{a}": F.coalesce(mean_of(*[p[i] for p in anchors]), middle(a)) for i, a in enumerate("xyz")})
    return f.select("session_id", "sample_idx", F.posexplode("pts").alias("joint_idx", "p"), "cx", "cy", "cz").select(
        "session_id", "sample_idx", "joint_idx", *[fixed(F.col(f"p.{a}") - F.col(f"c{a}")).alias(a) for a in "xyz"]
    )


@query(
    "c19_axis_limits",
    f"""WITH {T.SQL_LONG}, l AS (SELECT session_id, {', '.join(f"quantile_cont({a}, 0.05) AS {a}l, quantile_cont({a}, 0.95) AS {a}h" for a in 'xyz')} FROM p3 WHERE x IS NOT NULL GROUP BY ALL),
s AS (SELECT *, greatest(xh - xl, yh - yl, zh - zl, 0.5) * 1.25 AS span FROM l)
SELECT session_id, {', '.join(f"{r6(f'({a}l + {a}h) / 2 - span / 2')} AS {a}_min, {r6(f'({a}l + {a}h) / 2 + span / 2')} AS {a}_max" for a in 'xyz')} FROM s""",
)
def c19b(spark, sf):
    points = T.pose3d(spark, sf).where(F.col("x").isNotNull())
    # one pass for the three axes: the axis is part of the quantile key
    tall = points.select("session_id", F.expr("stack(3, 'x', x, 'y', y, 'z', z) AS (axis, v)"))
    q = exact_quantiles(tall, ["session_id", "axis"], F.col("v"), {"lo": 0.05, "hi": 0.95})
    span = F.greatest(F.max(F.col("hi") - F.col("lo")), F.lit(0.5)) * 1.25
    mid = lambda a: F.max(F.when(F.col("axis") == a, (F.col("lo") + F.col("hi")) / 2.0))
    wide = q.groupBy("session_id").agg(span.alias("span"), *[mid(a).alias(f"m{a}") for a in "xyz"])
    return wide.select(
        "session_id", *[c for a in "xyz" for c in (
            fixed(F.col(f"m{a}") - F.col("span") / 2).alias(f"{a}_min"), fixed(F.col(f"m{a}") + F.col("span") / 2).alias(f"{a}_max"))]
    )


@query(
    "c19_viewer_points",
    f"""WITH {T.SQL_LONG}, l AS (SELECT session_id, greatest({', '.join(f"quantile_cont({a}, 0.99) - quantile_cont({a}, 0.01)" for a in 'xyz')}, 1e-6) AS sc,
 quantile_cont(x, 0.5) AS mx, quantile_cont(y, 0.5) AS my, min(z) AS mz FROM p3 WHERE x IS NOT NULL GROUP BY ALL)
SELECT session_id, sample_idx, joint_idx, {r6('x / sc - mx / sc')} AS vx, {r6('z / sc - mz / sc')} AS vy, {r6('(y / sc - my / sc) * -1.0')} AS vz
FROM p3 JOIN l USING (session_id)""",
)
def c19c(spark, sf):
    points = T.pose3d(spark, sf)
    tall = points.where(F.col("x").isNotNull()).select("session_id", F.expr("stack(3, 'x', x, 'y', y, 'z', z) AS (axis, v)"))
    q = exact_quantiles(tall, ["session_id", "axis"], F.col("v"), {"lo": 0.01, "mid": 0.5, "hi": 0.99, "low": 0.0})
    at = lambda a, c: F.max(F.when(F.col("axis") == a, F.col(c)))
    stats = q.groupBy("session_id").agg(
        F.greatest(F.max(F.col("hi") - F.col("lo")), F.lit(1e-6)).alias("sc"),
        at("x", "mid").alias("mx"), at("y", "mid").alias("my"), at("z", "low").alias("mz"),
    )
    sc = F.col("sc")
    return points.join(stats, "session_id").select(
        "session_id", "sample_idx", "joint_idx",
        fixed(F.col("x") / sc - F.col("mx") / sc).alias("vx"), fixed(F.col("z") / sc - F.col("mz") / sc).alias("vy"),
        fixed((F.col("y") / sc - F.col("my") / sc) * -1.0).alias("vz"),
    )


@query(
    "c19_image_points",
    f"""WITH {T.SQL_LONG}, l AS (SELECT session_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p3 GROUP BY ALL)
SELECT session_id, sample_idx, joint_idx, {r6('80 + (x - x0) / greatest(x1 - x0, 1e-6) * 1120', 4)} AS ix, {r6('720 - (80 + (y - y0) / greatest(y1 - y0, 1e-6) * 560)', 4)} AS iy
FROM p3 JOIN l USING (session_id)""",
)
def c19d(spark, sf):
    points = T.pose3d(spark, sf)
    lim = points.groupBy("session_id").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    span = lambda a: F.greatest(F.col(f"{a}1") - F.col(f"{a}0"), F.lit(1e-6))
    return points.join(lim, "session_id").select(
        "session_id", "sample_idx", "joint_idx",
        fixed(80 + (F.col("x") - F.col("x0")) / span("x") * (1280 - 160), 4).alias("ix"),
        fixed(720 - (80 + (F.col("y") - F.col("y0")) / span("y") * (720 - 160)), 4).alias("iy"),
    )


@query(
    "c20_report_text",
    """SELECT p_partkey,
 CASE p_size % 3 WHEN 0 THEN printf('at most %.3f', p_retailprice / 100) WHEN 1 THEN printf('at least %.3f', p_retailprice / 100)
  ELSE printf('%.3f to %.3f', p_retailprice / 100, p_retailprice / 50) END AS limit_text,
 CASE WHEN p_size % 3 = 0 THEN printf('%.3f - %.3f = %+.3f', p_size * 1.0, p_retailprice / 100, p_size - p_retailprice / 100)
  WHEN p_size % 3 = 1 THEN printf('%.3f - %.3f = %+.3f', p_size * 1.0, p_retailprice / 100, p_size - p_retailprice / 100)
  ELSE NULL END AS comparison_text,
 CASE p_type WHEN 'SMALL' THEN 'degrees' WHEN 'ECONOMY' THEN 'ratio' ELSE 'seconds' END AS unit_label FROM part""",
)
def c20(spark, sf):
    low, high, v = F.col("p_retailprice") / 100, F.col("p_retailprice") / 50, F.col("p_size") * F.lit(1.0)
    kind = F.col("p_size") % 3
    compare = F.format_string("%.3f - %.3f = %+.3f", v, low, v - low)
    return T.read(spark, sf, "part").select(
        "p_partkey",
        F.when(kind == 0, F.format_string("at most %.3f", low)).when(kind == 1, F.format_string("at least %.3f", low))
        .otherwise(F.format_string("%.3f to %.3f", low, high)).alias("limit_text"),
        F.when(kind < 2, compare).alias("comparison_text"),
        F.when(F.col("p_type") == "SMALL", "degrees").when(F.col("p_type") == "ECONOMY", "ratio").otherwise("seconds").alias("unit_label"),
    )


@query(
    "c21_string_predicates",
    """SELECT page_id, regexp_full_match(regexp_extract(url, '([^/]+)$', 1), '[A-Za-z0-9][A-Za-z0-9._-]*') AS safe_id,
 regexp_full_match(sha256(html), '[0-9a-f]{64}') AS is_sha256, lower(url) || ':' || CAST(page_id AS VARCHAR) AS label_key FROM pages""",
)
def c21(spark, sf):
    tail = F.regexp_extract("url", "([^/]+)$", 1)
    return T.read(spark, sf, "pages").select(
        "page_id", tail.rlike("^[A-Za-z0-9][A-Za-z0-9._-]*$").alias("safe_id"),
        F.sha2("html", 256).rlike("^[0-9a-f]{64}$").alias("is_sha256"),
        F.concat_ws(":", F.lower("url"), F.col("page_id").cast("string")).alias("label_key"),
    )
