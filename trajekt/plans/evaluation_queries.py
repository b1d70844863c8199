"""G: ground-truth evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.numeric import count_where, fixed, reasons
from ..functions.skeleton import ANGLES, J, LENGTHS
from ..operators import evaluate as V
from ..operators.quantiles import exact_quantiles
from . import oracle as O
from . import tables as T
from .registry import query

r6 = T.r6
FRAME = ["session_id", "sample_idx"]
SQL_ERR = f"""{T.SQL_MATCHED},
er AS (SELECT *, sqrt(pow(x - gx, 2) + pow(y - gy, 2) + pow(z - gz, 2)) AS e FROM mt)"""
_RATIO = "avg(CASE WHEN e IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"


def _pck(limit: float) -> str:
    return f"avg(CASE WHEN e IS NOT NULL THEN CASE WHEN e <= {limit} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END)"


@query(
    "g1_point_error_summary",
    f"""WITH {SQL_ERR} SELECT session_id, count(e) AS evaluated_points, {r6(_RATIO)} AS valid_joint_ratio, {r6('1000 * avg(e)', 4)} AS mpjpe_mm,
 {r6(_pck(0.05))} AS pck_50mm, {r6(_pck(0.10))} AS pck_100mm, {r6('1000 * median(e)', 4)} AS median_error_mm, {r6('1000 * quantile_cont(e, 0.95)', 4)} AS p95_error_mm FROM er GROUP BY ALL""",
)
def g1(spark, sf):
    out = V.error_summary(T.matched_poses(spark, sf), "session_id", "sample_idx")
    return out.withColumns(
        {**{c: fixed(c) for c in ("valid_joint_ratio", "pck_50mm", "pck_100mm")}, **{c: fixed(c, 4) for c in ("mpjpe_mm", "median_error_mm", "p95_error_mm")}}
    )


SQL_ROOT = f"""{SQL_ERR},
rt AS (SELECT session_id, sample_idx, {', '.join(f'0.5 * (max({c}) FILTER (WHERE joint_idx = 11 AND e IS NOT NULL) + max({c}) FILTER (WHERE joint_idx = 12 AND e IS NOT NULL)) AS r{c}' for c in ('x', 'y', 'z', 'gx', 'gy', 'gz'))} FROM er GROUP BY ALL),
rr AS (SELECT er.*, CASE WHEN e IS NOT NULL THEN sqrt(pow((x - rx) - (gx - rgx), 2) + pow((y - ry) - (gy - rgy), 2) + pow((z - rz) - (gz - rgz), 2)) END AS re FROM er JOIN rt USING (session_id, sample_idx))"""


@query("g2_root_relative_error", f"WITH {SQL_ROOT} SELECT session_id, sample_idx, joint_idx, {r6('re')} AS root_error FROM rr")
def g2(spark, sf):
    out = V.root_relative(T.matched_poses(spark, sf), FRAME, "joint_idx", J["left_hip"], J["right_hip"])
    return out.select(*FRAME, "joint_idx", fixed("root_error").alias("root_error"))


@query("g3_similarity_aligned_error")
def g3(spark, sf):
    out = V.procrustes(T.matched_poses(spark, sf), FRAME)
    return out.select(*FRAME, "joint_idx", fixed("aligned_error").alias("aligned_error"))


@query(
    "g4_frame_and_joint_errors",
    f"""WITH {SQL_ROOT} SELECT session_id, sample_idx, joint_idx, CASE WHEN grouping(sample_idx) = 0 THEN 'frame' ELSE 'joint' END AS level,
 {r6(_RATIO)} AS valid_ratio, {r6('1000 * avg(e)', 4)} AS mpjpe_mm, {r6('1000 * avg(re)', 4)} AS root_relative_mpjpe_mm, {r6(_pck(0.05))} AS pck_50mm, {r6(_pck(0.10))} AS pck_100mm
FROM rr GROUP BY GROUPING SETS ((session_id, sample_idx), (session_id, joint_idx))""",
)
def g4(spark, sf):
    rows = V.root_relative(T.matched_poses(spark, sf), FRAME, "joint_idx", 11, 12).withColumn("e", V.point_error())
    e = F.col("e")
    sets = rows.groupingSets([["session_id", "sample_idx"], ["session_id", "joint_idx"]], "session_id", "sample_idx", "joint_idx")
    return sets.agg(
        F.when(F.grouping("sample_idx") == 0, "frame").otherwise("joint").alias("level"),
        fixed(F.avg(F.when(e.isNotNull(), 1.0).otherwise(0.0))).alias("valid_ratio"), fixed(1000.0 * F.avg(e), 4).alias("mpjpe_mm"),
        fixed(1000.0 * F.avg("root_error"), 4).alias("root_relative_mpjpe_mm"),
        fixed(V.share_within(e, 0.05)).alias("pck_50mm"), fixed(V.share_within(e, 0.10)).alias("pck_100mm"),
    )


@query(
    "g4_error_quantiles",
    f"""WITH {SQL_ERR} SELECT session_id, joint_idx, {r6('1000 * median(e)', 4)} AS median_error_mm, {r6('1000 * quantile_cont(e, 0.95)', 4)} AS p95_error_mm FROM er GROUP BY ALL""",
)
def g4q(spark, sf):
    q = exact_quantiles(T.matched_poses(spark, sf), ["session_id", "joint_idx"], V.point_error(), {"m": 0.5, "p": 0.95})
    return q.select("session_id", "joint_idx", fixed(1000.0 * F.col("m"), 4).alias("median_error_mm"), fixed(1000.0 * F.col("p"), 4).alias("p95_error_mm"))


def _truth_frames_sql() -> str:
    cols = []
    for j in range(T.JOINTS):
        for c, d in zip("xyz", T.truth_offset("vec_id", str(j))):
            cols.append(f"CASE WHEN (vec_id + {j}) % 31 = 0 THEN NULL ELSE {c}{j} + {d} END AS t{c}{j}")
    return "tf AS (SELECT *, " + ", ".join(cols) + " FROM fr)"


def _tp(name: str):
    n = J[name]
    return f"tx{n}", f"ty{n}", f"tz{n}"


def _truth_angle(a, c, b) -> str:
    return O.between_vectors(O.v_sub(_tp(a), _tp(c)), O.v_sub(_tp(b), _tp(c)), 1e-12)


@query(
    "g4_angle_errors",
    f"""WITH {T.SQL_FRAMES}, {_truth_frames_sql()},
an AS ({' UNION ALL '.join(f"SELECT session_id, '{n}' AS angle, abs(({O.angle(a, c, b, 1e-12)}) - ({_truth_angle(a, c, b)})) AS d FROM tf" for n, (a, c, b) in ANGLES.items())})
SELECT session_id, angle, count(d) AS valid_frame_count, {r6('avg(d)')} AS mae_deg, {r6('quantile_cont(d, 0.95)')} AS p95_error_deg FROM an GROUP BY ALL""",
)
def g4a(spark, sf):
    rows = angle_differences(spark, sf)
    plain = rows.groupBy("session_id", "angle").agg(F.count("d").alias("valid_frame_count"), fixed(F.avg("d")).alias("mae_deg"))
    q = exact_quantiles(rows, ["session_id", "angle"], F.col("d"), {"p": 0.95})
    return plain.join(q, ["session_id", "angle"], "left").select(
        "session_id", "angle", "valid_frame_count", "mae_deg", fixed("p").alias("p95_error_deg")
    )


def angle_differences(spark, sf):
    """Absolute angle differences per frame and angle; both arrays sit in the frame's row."""
    dx, dy, dz = T.truth_offset("vec_id", "j")
    truth = (
        f"transform(pts, (p, j) -> CASE WHEN p IS NULL OR (vec_id + j) % 31 = 0 THEN NULL ELSE "
        f"named_struct('x', p.x + {dx}, 'y', p.y + {dy}, 'z', p.z + {dz}) END)"
    )
    framed = T.frames(spark, sf).withColumn("gts", F.expr(truth))
    ang = lambda arr, s: G.joint_angle(*[G.joint(n, arr) for n in s], floor=1e-12)
    entries = [F.struct(F.lit(n).alias("angle"), F.abs(ang("pts", s) - ang("gts", s)).alias("d")) for n, s in ANGLES.items()]
    return framed.select("session_id", F.inline(F.array(*entries)))


_LG = "OVER (PARTITION BY session_id, joint_idx ORDER BY sample_idx)"
SQL_DERIV = f"""{SQL_ERR},
d1 AS (SELECT *, {', '.join(f'({c} - g{c}) AS q{c}' for c in 'xyz')} FROM er),
d2 AS (SELECT *, {', '.join(f'lag(q{c}, 1) {_LG} AS a{c}, lag(q{c}, 2) {_LG} AS s{c}' for c in 'xyz')} FROM d1),
dv AS (SELECT *, sqrt({' + '.join(f'pow((q{c} - a{c}) * 30, 2)' for c in 'xyz')}) AS ve, sqrt({' + '.join(f'pow((q{c} - 2 * a{c} + s{c}) * 900, 2)' for c in 'xyz')}) AS ae FROM d2)"""


@query("g5_derivative_errors", f"WITH {SQL_DERIV} SELECT session_id, {r6('avg(ve)', 5)} AS velocity_mae_mps, {r6('avg(ae)', 4)} AS acceleration_mae_mps2 FROM dv GROUP BY ALL")
def g5(spark, sf):
    rows = V.derivative_errors(T.matched_poses(spark, sf), ["session_id", "joint_idx"], "sample_idx", T.FPS)
    return rows.groupBy("session_id").agg(
        fixed(F.avg("velocity_error"), 5).alias("velocity_mae_mps"), fixed(F.avg("acceleration_error"), 4).alias("acceleration_mae_mps2")
    )


SQL_BONECV = f"""bl AS ({' UNION ALL '.join(f"SELECT session_id, '{n}' AS bone, {O.dist(a, b)} AS ln FROM fr" for n, (a, b) in LENGTHS.items())}),
bc AS (SELECT session_id, bone, 100 * stddev_pop(ln) / avg(ln) AS cv FROM bl WHERE ln > 1e-9 GROUP BY ALL HAVING count(*) >= 2),
bv AS (SELECT session_id, median(cv) AS cv FROM bc GROUP BY ALL)"""


@query("g6_bone_length_cv", f"WITH {T.SQL_FRAMES}, {SQL_BONECV} SELECT session_id, {r6('cv', 5)} AS bone_length_cv_percent FROM bv")
def g6(spark, sf):
    return V.bone_cv(lengths_long(T.frames(spark, sf)), "session_id").select("session_id", fixed("bone_length_cv_percent", 5).alias("bone_length_cv_percent"))


def lengths_long(framed):
    entries = [F.struct(F.lit(n).alias("bone"), c.alias("length")) for n, c in G.segment_lengths().items()]
    return framed.select("session_id", F.inline(F.array(*entries)))


@query("g7_bootstrap_interval")
def g7(spark, sf):
    means = T.matched_poses(spark, sf).groupBy(*FRAME).agg((1000.0 * F.avg(V.point_error())).alias("m"))
    return V.bootstrap_ci(means, "session_id", "sample_idx", "m").select("session_id", fixed("ci_low").alias("ci_low"), fixed("ci_high").alias("ci_high"))


def evaluation_summary(spark, sf):
    """All G metrics side by side per session."""
    matched = T.matched_poses(spark, sf)
    points = V.error_summary(matched, "session_id", "sample_idx")
    frames = matched.groupBy(*FRAME).agg(F.lit(1).alias("one")).groupBy("session_id").agg(F.count(F.lit(1)).alias("evaluated_frames"))
    rooted = V.root_relative(matched, FRAME, "joint_idx", 11, 12).groupBy("session_id").agg((1000.0 * F.avg("root_error")).alias("root_relative_mpjpe_mm"))
    deriv = V.derivative_errors(matched, ["session_id", "joint_idx"], "sample_idx", T.FPS).groupBy("session_id").agg(
        F.avg("velocity_error").alias("velocity_mae_mps"), F.avg("acceleration_error").alias("acceleration_mae_mps2")
    )
    angles = angle_differences(spark, sf).groupBy("session_id", "angle").agg(F.avg("d").alias("m")).groupBy("session_id").agg(F.avg("m").alias("angle_mae_deg"))
    bones = V.bone_cv(lengths_long(T.frames(spark, sf)), "session_id")
    out = points
    for other in (frames, rooted, deriv, angles, bones):
        out = out.join(other, "session_id", "left")
    return out


_LIMITS = {"min_evaluated_frames": 46, "min_valid_joint_ratio": 0.92, "max_mpjpe_mm": 75.0, "max_p95_error_mm": 102.0}


@query(
    "g8_quality_gates",
    f"""WITH {SQL_DERIV}, {_truth_frames_sql()}, {SQL_BONECV},
rt AS (SELECT session_id, sample_idx, {', '.join(f'0.5 * (max({c}) FILTER (WHERE joint_idx = 11 AND e IS NOT NULL) + max({c}) FILTER (WHERE joint_idx = 12 AND e IS NOT NULL)) AS r{c}' for c in ('x', 'y', 'z', 'gx', 'gy', 'gz'))} FROM er GROUP BY ALL),
rr AS (SELECT er.session_id, CASE WHEN e IS NOT NULL THEN sqrt(pow((x - rx) - (gx - rgx), 2) + pow((y - ry) - (gy - rgy), 2) + pow((z - rz) - (gz - rgz), 2)) END AS re FROM er JOIN rt USING (session_id, sample_idx)),
an AS ({' UNION ALL '.join(f"SELECT session_id, '{n}' AS angle, abs(({O.angle(a, c, b, 1e-12)}) - ({_truth_angle(a, c, b)})) AS d FROM tf" for n, (a, c, b) in ANGLES.items())}),
am AS (SELECT session_id, avg(m) AS am FROM (SELECT session_id, angle, avg(d) AS m FROM an GROUP BY ALL) GROUP BY ALL),
p AS (SELECT session_id, count(DISTINCT sample_idx) AS fc, {_RATIO} AS vr, 1000 * avg(e) AS mp, 1000 * quantile_cont(e, 0.95) AS p95, {_pck(0.10)} AS pk, avg(ve) AS ve, avg(ae) AS ae FROM dv GROUP BY ALL),
r AS (SELECT session_id, 1000 * avg(re) AS rr FROM rr GROUP BY ALL),
g AS (SELECT session_id, list_filter([CASE WHEN NOT fc >= 46 THEN 'enough_frames' END, CASE WHEN NOT vr >= 0.92 THEN 'valid_joint_ratio' END, CASE WHEN NOT coalesce(mp <= 75, FALSE) THEN 'mpjpe' END,
 CASE WHEN NOT coalesce(p95 <= 102, FALSE) THEN 'p95_error' END, CASE WHEN NOT coalesce(rr <= 50, FALSE) THEN 'root_relative_mpjpe' END, CASE WHEN NOT coalesce(pk >= 0.95, FALSE) THEN 'pck_100mm' END,
 CASE WHEN NOT coalesce(am <= 5, FALSE) THEN 'angle_mae' END, CASE WHEN NOT coalesce(ve <= 0.2, FALSE) THEN 'velocity_mae' END, CASE WHEN NOT coalesce(ae <= 2, FALSE) THEN 'acceleration_mae' END,
 CASE WHEN NOT coalesce(cv <= 3, FALSE) THEN 'bone_length_stability' END], lambda w: w IS NOT NULL) AS failed_gates FROM p JOIN r USING (session_id) JOIN am USING (session_id) JOIN bv USING (session_id))
SELECT session_id, failed_gates, CASE WHEN len(failed_gates) = 0 THEN 'passed' ELSE 'failed' END AS status FROM g""",
)
def g8(spark, sf):
    return V.with_gates(evaluation_summary(spark, sf), _LIMITS).select("session_id", "failed_gates", "status")


@query(
    "g9_authorisation_decision",
    """WITH run AS (SELECT o_orderkey AS run_id, o_orderpriority AS profile, o_totalprice AS score, o_custkey AS ds FROM orders),
cnt AS (SELECT l_orderkey AS run_id, count(*) AS frames, count(DISTINCT l_suppkey) AS joints, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS failed FROM lineitem GROUP BY ALL),
a AS (SELECT run.run_id, list_filter([CASE WHEN profile NOT IN ('1-URGENT', '2-HIGH') THEN 'profile_not_allowed' END, CASE WHEN coalesce(failed, 1) > 0 THEN 'quality_gate_failed' END,
 CASE WHEN coalesce(joints, 0) < 3 THEN 'too_few_joints' END, CASE WHEN coalesce(frames, 0) <> coalesce(joints, 0) THEN 'frame_count_mismatch' END,
 CASE WHEN c.c_mktsegment IS NULL OR c.c_mktsegment = 'BUILDING' THEN 'dataset_not_allowed' END], lambda w: w IS NOT NULL) AS reasons
 FROM run LEFT JOIN cnt USING (run_id) LEFT JOIN customer c ON c.c_custkey = run.ds)
SELECT run_id, reasons, len(reasons) = 0 AS authorised FROM a""",
)
def g9(spark, sf):
    """Runs (orders) with their evidence rows (lineitem) and dataset (customer); refusal reasons in order."""
    runs = T.read(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("profile"), F.col("o_custkey").alias("ds"))
    evidence = T.read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(
        F.count(F.lit(1)).alias("frames"), F.countDistinct("l_suppkey").alias("joints"), count_where(F.col("l_returnflag") == "R").alias("failed")
    )
    sets = T.read(spark, sf, "customer").select(F.col("c_custkey").alias("ds"), F.col("c_mktsegment").alias("dataset"))
    rows = runs.join(evidence, "run_id", "left").join(sets, "ds", "left")
    zero = F.lit(0)
    why = reasons(
        (~F.col("profile").isin("1-URGENT", "2-HIGH"), "profile_not_allowed"),
        (F.coalesce("failed", F.lit(1)) > 0, "quality_gate_failed"),
        (F.coalesce("joints", zero) < 3, "too_few_joints"),
        (F.coalesce("frames", zero) != F.coalesce("joints", zero), "frame_count_mismatch"),
        (F.col("dataset").isNull() | (F.col("dataset") == "BUILDING"), "dataset_not_allowed"),
    )
    return rows.select("run_id", why.alias("reasons")).withColumn("authorised", F.size("reasons") == 0)


@query("g10_mean_error_of_two_tables", f"WITH {SQL_ERR} SELECT {r6('avg(e)')} AS mean_error_m FROM er")
def g10(spark, sf):
    return T.matched_poses(spark, sf).agg(fixed(F.avg(V.point_error())).alias("mean_error_m"))
