"""D: multi-view estimation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.numeric import count_where, fixed, reasons
from ..functions.skeleton import J, RELIABILITY_BONES
from ..operators import estimate as D
from ..operators import temporal as E
from ..operators.quantiles import attach, exact_quantiles, weighted_median
from ..session import materialise
from . import tables as T
from .alignment_queries import shift_table
from .geometry_queries import _R
from .registry import query
from .temporal_queries import LAGW

r6 = T.r6
POINT = ["session_id", "sample_idx", "joint_idx"]


def rigs(spark, sf):
    """One row per session with its camera matrices (the same four-camera rig for every session here)."""
    cams = F.array(*[
        F.struct(F.lit(c).alias("camera_id"), F.array(*map(F.lit, T.intrinsics())).alias("k"), F.array(*map(F.lit, m)).alias("p"))
        for c, m in T.CAMERAS.items()
    ])
    return T.read(spark, sf, "embeddings").select(F.col("label").alias("session_id")).distinct().withColumn("cams", cams)


def solved_points(spark, sf):
    packed = D.pack_views(T.pose2d(spark, sf), POINT, 0.30)
    return D.triangulate(packed, rigs(spark, sf), "session_id", [*POINT, "views"], 2, 25.0)


@query("d1_robust_triangulation")
def d1(spark, sf):
    out = solved_points(spark, sf)
    used = F.filter("views", lambda v: F.array_contains(F.col("used_views"), v["camera_id"]))
    mean = F.aggregate(used, F.lit(0.0), lambda a, v: a + v["s"]) / F.size(used)
    out = out.withColumn("tri_score", D.quality_score(mean, F.col("reproj_px"), F.col("used_cameras"), F.col("conditioning")))
    return out.select(*POINT, *[fixed(c).alias(c) for c in ("x", "y", "z", "conditioning", "reproj_px", "tri_score")], "used_cameras")


@query(
    "d4_quality_score",
    f"""WITH {T.SQL_PROJECTED}, v AS (SELECT session_id, sample_idx, joint_idx, least(score, 1.0) AS s, sqrt(pow(px - qx, 2) + pow(py - qy, 2)) AS e FROM pj WHERE score >= 0.5 AND px IS NOT NULL),
a AS (SELECT session_id, sample_idx, joint_idx, avg(s) AS s, avg(e) AS e, count(*) AS n FROM v GROUP BY ALL)
SELECT session_id, sample_idx, joint_idx, {r6('greatest(0.0, least(1.0, s * exp(-greatest(e, 0) / 12.0) * greatest(0.0, least(1.0, (n - 1) / 2.0)) * 0.9))')} AS tri_score FROM a""",
)
def d4(spark, sf):
    v = T.projected_views(spark, sf).where("score >= 0.5 AND px IS NOT NULL")
    a = v.groupBy(*POINT).agg(
        F.avg(F.least("score", F.lit(1.0))).alias("s"), F.avg(F.sqrt((F.col("px") - F.col("qx")) ** 2 + (F.col("py") - F.col("qy")) ** 2)).alias("e"),
        F.count(F.lit(1)).alias("n"),
    )
    return a.select(*POINT, fixed(D.quality_score(F.col("s"), F.col("e"), F.col("n"), F.lit(0.9))).alias("tri_score"))


def _centers() -> dict[str, tuple[float, float, float]]:
    out = {}
    for name in T.CAMERAS:
        r = T.rotation(name)
        out[name] = tuple(-r[6 + a] * T.DEPTH for a in range(3))
    return out


_CENT = " UNION ALL ".join(f"SELECT '{n}' AS camera_id, {x!r}::DOUBLE AS cx, {y!r}::DOUBLE AS cy, {z!r}::DOUBLE AS cz" for n, (x, y, z) in _centers().items())


@query(
    "d5_depth_and_ray_angle",
    f"""WITH {T.SQL_PROJECTED}, cn AS ({_CENT}),
r AS (SELECT session_id, sample_idx, joint_idx, camera_id, depth, x - cx AS a, y - cy AS b, z - cz AS c, sqrt(pow(x - cx, 2) + pow(y - cy, 2) + pow(z - cz, 2)) AS n FROM pj JOIN cn USING (camera_id) WHERE score >= 0.5 AND px IS NOT NULL),
m AS (SELECT p.session_id, p.sample_idx, p.joint_idx, max(degrees(acos(greatest(-1.0, least(1.0, p.a / p.n * (q.a / q.n) + p.b / p.n * (q.b / q.n) + p.c / p.n * (q.c / q.n)))))) AS ang
 FROM r p JOIN r q USING (session_id, sample_idx, joint_idx) WHERE p.camera_id < q.camera_id GROUP BY ALL),
d AS (SELECT session_id, sample_idx, joint_idx, bool_and(depth > 1e-9) AS in_front, count(*) AS n FROM r GROUP BY ALL)
SELECT session_id, sample_idx, joint_idx, in_front, {r6('ang', 4)} AS max_ray_angle_deg FROM d JOIN m USING (session_id, sample_idx, joint_idx)""",
)
def d5(spark, sf):
    centers = F.create_map(*[c for n, p in _centers().items() for c in (F.lit(n), F.array(*map(F.lit, p)))])
    v = T.projected_views(spark, sf).where("score >= 0.5 AND px IS NOT NULL").withColumn("c", centers[F.col("camera_id")])
    ray = [F.col(a) - F.col("c")[i] for i, a in enumerate("xyz")]
    size = G.norm(ray)
    unit = F.struct(*[(r / size).alias(a) for r, a in zip(ray, "xyz")])
    packed = v.groupBy(*POINT).agg(F.min(F.col("depth") > 1e-9).alias("in_front"), F.collect_list(unit).alias("rays"))  # one ray per camera
    return packed.where(F.size("rays") >= 2).select(*POINT, "in_front", fixed(D.ray_angle(F.col("rays")), 4).alias("max_ray_angle_deg"))


def feedback_plan(spark, sf):
    """Targets with a prior from the other cameras, projected into the camera under test."""
    packed = D.pack_views(T.pose2d(spark, sf), POINT, 0.30)
    consensus = T.pose3d(spark, sf).where("x IS NOT NULL")
    targets = D.feedback_targets(packed, consensus, POINT, rigs(spark, sf), "session_id", 24.0)
    prior = D.triangulate(targets, rigs(spark, sf), "session_id", [*POINT, "excluded", "own", "p"], 2, 25.0)
    u, v, _ = G.project((F.col("x"), F.col("y"), F.col("z")), G.array_matrix("p", 12))
    out = prior.withColumns({"prior_x": u, "prior_y": v})
    error = F.sqrt((F.col("own.u") - F.col("prior_x")) ** 2 + (F.col("own.v") - F.col("prior_y")) ** 2)
    return out.withColumn("initial_error", error).where("initial_error IS NULL OR initial_error >= 24.0")


@query("d6_feedback_plan")
def d6(spark, sf):
    return feedback_plan(spark, sf).select(
        *POINT, F.col("excluded").alias("camera_id"), fixed("prior_x", 3).alias("prior_x"), fixed("prior_y", 3).alias("prior_y"),
        fixed("initial_error", 3).alias("initial_error"), F.col("used_cameras").alias("supporting_views"),
    )


_GX = "qx + ((vec_id * 3 + joint_idx) % 9 - 2) * 3.0"
_GS = "((vec_id + joint_idx * 2) % 10) * 0.11"
_PK = "((vec_id * 7 + joint_idx) % 12) * 0.4"
_INIT, _CAND = "sqrt(pow(px - qx, 2) + pow(py - qy, 2))", f"CASE WHEN (vec_id + joint_idx) % 43 = 0 THEN NULL ELSE abs(({_GX}) - qx) END"
SQL_DECIDED = f"""{T.SQL_PROJECTED},
cd AS (SELECT *, CASE WHEN score < 0.4 THEN NULL ELSE {_INIT} END AS ie, {_CAND} AS ce, {_GS} AS gs, {_PK} AS pk FROM pj WHERE px IS NOT NULL AND {_INIT} >= 24),
dc AS (SELECT *, CASE WHEN ce IS NULL THEN 'nonfinite_candidate' WHEN gs < 0.30 THEN 'insufficient_image_score' WHEN pk > 0 AND gs < pk * 0.08 THEN 'weak_secondary_heatmap_peak'
 WHEN ce > 20 THEN 'candidate_too_far_from_crossview_prior' WHEN ie IS NOT NULL AND ie - ce < 12 THEN 'insufficient_geometric_improvement'
 WHEN ie IS NOT NULL AND ce > ie * 0.5 THEN 'insufficient_relative_improvement' ELSE 'accepted' END AS reason FROM cd)"""


def decided(spark, sf):
    v = T.projected_views(spark, sf).where("px IS NOT NULL").withColumns(
        {"gx": F.expr(_GX).cast("double"), "gs": F.expr(_GS).cast("double"), "pk": F.expr(_PK).cast("double"), "e0": F.expr(_INIT)}
    ).where("e0 >= 24")
    v = v.withColumns(
        {"ie": F.when(F.col("score") >= 0.4, F.col("e0")), "ce": F.when((F.col("vec_id") + F.col("joint_idx")) % 43 != 0, F.abs(F.col("gx") - F.col("qx")))}
    )
    return v.withColumn("reason", D.decide_candidate(F.col("ie"), F.col("ce"), F.col("gs"), F.col("pk")))


@query("d7_guided_decision", f"WITH {SQL_DECIDED} SELECT session_id, sample_idx, joint_idx, camera_id, {r6('ie', 3)} AS initial_error, {r6('ce', 3)} AS candidate_error, reason FROM dc")
def d7(spark, sf):
    return decided(spark, sf).select(*POINT, "camera_id", fixed("ie", 3).alias("initial_error"), fixed("ce", 3).alias("candidate_error"), "reason")


@query(
    "d8_apply_decisions",
    f"""WITH {SQL_DECIDED} SELECT p.session_id, p.sample_idx, p.joint_idx, p.camera_id, {r6("CASE WHEN d.reason = 'accepted' THEN " + _GX.replace('qx', 'p.qx').replace('vec_id', 'p.vec_id').replace('joint_idx', 'p.joint_idx') + " ELSE p.px END", 3)} AS geometry_x,
 coalesce(d.reason = 'accepted', TRUE) AND p.px IS NOT NULL AS geometry_valid, {r6("CASE WHEN d.reason IS NULL THEN p.px WHEN d.reason = 'accepted' THEN " + _GX.replace('qx', 'p.qx').replace('vec_id', 'p.vec_id').replace('joint_idx', 'p.joint_idx') + " ELSE p.qx END", 3)} AS display_x,
 CAST(CASE WHEN d.reason IS NULL THEN 0 WHEN d.reason = 'accepted' THEN 1 ELSE 2 END AS INTEGER) AS provenance
FROM pj p LEFT JOIN dc d USING (session_id, sample_idx, joint_idx, camera_id)""",
)
def d8(spark, sf):
    """Accepted candidates replace the point; rejected targets leave geometry and show the prior in the display copy only."""
    views = T.projected_views(spark, sf).select(*POINT, "camera_id", "px", "qx")
    choice = decided(spark, sf).select(*POINT, "camera_id", "gx", "reason")
    rows = views.join(choice, [*POINT, "camera_id"], "left")
    accepted = F.col("reason") == "accepted"
    return rows.select(
        *POINT, "camera_id", fixed(F.when(accepted, F.col("gx")).otherwise(F.col("px")), 3).alias("geometry_x"),
        (F.coalesce(accepted, F.lit(True)) & F.col("px").isNotNull()).alias("geometry_valid"),
        fixed(F.when(F.col("reason").isNull(), F.col("px")).when(accepted, F.col("gx")).otherwise(F.col("qx")), 3).alias("display_x"),
        F.when(F.col("reason").isNull(), 0).when(accepted, 1).otherwise(2).alias("provenance"),
    )


@query(
    "d9_feedback_report",
    f"""WITH {SQL_DECIDED} SELECT session_id, camera_id, count(*) FILTER (WHERE reason = 'accepted') AS accepted_count, count(*) FILTER (WHERE reason <> 'accepted') AS rejected_count,
 count(*) FILTER (WHERE reason <> 'accepted') AS projected_count, {', '.join(f"count(*) FILTER (WHERE reason = '{r}') AS n_{r}" for r in D.DECISIONS[1:])} FROM dc GROUP BY ALL""",
)
def d9(spark, sf):
    rows = decided(spark, sf).withColumn("provenance", F.when(F.col("reason") == "accepted", 1).otherwise(2))
    return D.feedback_report(rows, "session_id")


SQL_SWAP = f"sw(j, o) AS (VALUES {', '.join(f'({i}, {o})' for i, o in enumerate(D.SWAP))})"


@query(
    "d10_camera_hypotheses",
    f"""WITH {T.SQL_PROJECTED}, {SQL_SWAP},
k AS (SELECT *, median(px - qx) OVER (PARTITION BY session_id, camera_id) AS mx, median(py - qy) OVER (PARTITION BY session_id, camera_id) AS my FROM pj WHERE px IS NOT NULL),
s AS (SELECT k.*, b.px AS sx, b.py AS sy FROM k JOIN sw ON j = joint_idx LEFT JOIN pj b ON b.session_id = k.session_id AND b.camera_id = k.camera_id AND b.sample_idx = k.sample_idx AND b.joint_idx = o)
SELECT session_id, camera_id, {', '.join(f"{r6(f'median({e})', 4)} AS {n}_median, {r6(f'quantile_cont({e}, 0.95)', 4)} AS {n}_p95" for n, e in (('direct', 'sqrt(pow(px - qx, 2) + pow(py - qy, 2))'), ('swapped', 'sqrt(pow(sx - qx, 2) + pow(sy - qy, 2))'), ('translated', 'sqrt(pow(px - mx - qx, 2) + pow(py - my - qy, 2))')))}
FROM s GROUP BY ALL""",
)
def d10(spark, sf):
    views = materialise(T.projected_views(spark, sf).select(*POINT, "camera_id", "px", "py", "qx", "qy"), "views")
    out = D.camera_hypotheses(views, "session_id", "sample_idx")
    return out.select("session_id", "camera_id", *[fixed(f"{k}_{s}", 4).alias(f"{k}_{s}") for k in ("direct", "swapped", "translated") for s in ("median", "p95")])


@query("d10_camera_health")
def d10h(spark, sf):
    views = materialise(T.projected_views(spark, sf).select(*POINT, "camera_id", "px", "py", "qx", "qy"), "views")
    keys = ["session_id", "camera_id"]
    error = F.sqrt((F.col("px") - F.col("qx")) ** 2 + (F.col("py") - F.col("qy")) ** 2)
    per_joint = exact_quantiles(views, [*keys, "joint_idx"], error, {"m": 0.5})
    bad = F.col("m") >= 24.0
    joints = per_joint.groupBy(*keys).agg(
        count_where(bad).alias("bad_joints"), count_where(bad & F.col("joint_idx").between(5, 10)).alias("bad_arm_joints")
    )
    targets = views.groupBy(*keys).agg(count_where(error >= 24.0).alias("target_count"))
    shifts = shift_table(spark, sf).groupBy(*keys).agg(
        F.min_by("shift", F.struct("median_error", "shift")).alias("best_shift"), F.min("median_error").alias("best_shift_error"),
        F.min(F.when(F.col("shift") == 0, F.col("median_error"))).alias("zero_shift_error"),
    )
    rows = D.camera_hypotheses(views, "session_id", "sample_idx").join(joints, keys).join(targets, keys).join(shifts, keys, "left")
    return rows.select(*keys, "target_count", "bad_joints", D.classify_camera().alias("classification"), fixed("affine_median", 4).alias("affine_median"))


@query(
    "d10_region_residuals",
    f"""WITH {T.SQL_PROJECTED}, r AS (SELECT session_id, camera_id, CASE WHEN joint_idx < 5 THEN 'head' WHEN joint_idx < 11 THEN 'arms' ELSE 'legs' END AS region, sqrt(pow(px - qx, 2) + pow(py - qy, 2)) AS e FROM pj WHERE px IS NOT NULL)
SELECT session_id, camera_id, region, count(*) AS n, {r6('median(e)', 4)} AS median_error, {r6('quantile_cont(e, 0.95)', 4)} AS p95_error FROM r GROUP BY ALL""",
)
def d10r(spark, sf):
    from .quality_queries import distribution_summary

    region = F.when(F.col("joint_idx") < 5, "head").when(F.col("joint_idx") < 11, "arms").otherwise("legs")
    v = T.projected_views(spark, sf).where("px IS NOT NULL").withColumn("region", region)
    e = F.sqrt((F.col("px") - F.col("qx")) ** 2 + (F.col("py") - F.col("qy")) ** 2)
    out = distribution_summary(v, ["session_id", "camera_id", "region"], e)
    return out.select("session_id", "camera_id", "region", F.col("count").alias("n"), fixed("median", 4).alias("median_error"), fixed("p95", 4).alias("p95_error"))


@query(
    "d11_triangulation_gate",
    f"""WITH {T.SQL_LONG}, b AS (SELECT session_id, avg(CASE WHEN x IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS r, median(reproj_px) AS m, quantile_cont(reproj_px, 0.95) AS p FROM p3 GROUP BY ALL),
a AS (SELECT session_id, avg(CASE WHEN x IS NOT NULL AND vec_id % 40 <> 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS r, median(reproj_px * 1.04) AS m, quantile_cont(reproj_px * 1.04 + session_id * 0.5, 0.95) AS p FROM p3 GROUP BY ALL),
c AS (SELECT session_id, median(reproj_px * 1.04 + session_id * 0.5) AS m FROM p3 GROUP BY ALL)
SELECT session_id, {r6('b.r')} AS before_ratio, {r6('a.r')} AS after_ratio, {r6('b.m')} AS before_median, {r6('c.m')} AS after_median, {r6('b.p')} AS before_p95, {r6('a.p')} AS after_p95,
 a.r + 0.01 >= b.r AND NOT c.m > greatest(b.m * 1.05, b.m + 1) AND NOT a.p > greatest(b.p * 1.1, b.p + 2) AS passed FROM b JOIN a USING (session_id) JOIN c USING (session_id)""",
)
def d11(spark, sf):
    points = T.pose3d(spark, sf)
    before = points.select("session_id", F.col("x").isNotNull().alias("valid"), F.col("reproj_px").alias("error"))
    after = points.select(
        "session_id", (F.col("x").isNotNull() & (F.col("vec_id") % 40 != 0)).alias("valid"), (F.col("reproj_px") * 1.04 + F.col("session_id") * 0.5).alias("error")
    )
    out = D.triangulation_gate(before, after, ["session_id"])
    return out.withColumns({c: fixed(c) for c in out.columns if c not in ("session_id", "passed")})


SQL_PIXELS = """pxs AS (SELECT l_orderkey AS point_id, l_extendedprice / 20000 AS d, l_discount * 800 AS c, 1.0::DOUBLE + (l_orderkey % 7) * 0.4::DOUBLE AS ex FROM lineitem WHERE abs(l_linenumber - 3) <= 4)"""


@query(
    "d12_depth_patch_sample",
    f"""WITH {SQL_PIXELS}, v AS (SELECT * FROM pxs WHERE d BETWEEN 0.4 AND 10 AND c <= 50 AND abs(d - ex) <= greatest(1.35, 0.1 * ex)),
a AS (SELECT *, count(*) OVER w AS n, median(d) OVER w AS m FROM v WINDOW w AS (PARTITION BY point_id)),
b AS (SELECT *, median(abs(d - m)) OVER (PARTITION BY point_id) AS mad FROM a WHERE n >= 2),
k AS (SELECT * FROM b WHERE mad <= 1e-9 OR abs(d - m) <= greatest(3 * 1.4826 * mad, 0.015))
SELECT point_id, {r6('median(d)')} AS depth_m, {r6('median(c)')} AS confidence, CAST(count(*) AS INTEGER) AS pixel_count FROM k GROUP BY ALL HAVING count(*) >= 2""",
)
def d12(spark, sf):
    pixels = T.read(spark, sf, "lineitem").where(F.abs(F.col("l_linenumber") - 3) <= 4).select(
        F.col("l_orderkey").alias("point_id"), (F.col("l_extendedprice") / 20000).alias("d"), (F.col("l_discount") * 800).alias("c"),
        (F.lit(1.0) + (F.col("l_orderkey") % 7) * F.lit(0.4)).alias("ex"),
    )
    out = D.patch_sample(pixels, ["point_id"], "d", "c", "ex", gate=1.35, minimum=2)
    return out.select("point_id", fixed("depth_m").alias("depth_m"), fixed("confidence").alias("confidence"), "pixel_count")


_SURF = "(joint_idx * 0.01 + ((vec_id * 3 + joint_idx) % 9 - 4) * 0.02)"
SQL_DEPTH = f"""{T.SQL_PROJECTED},
ds AS (SELECT *, depth + {_SURF} AS sd, ((vec_id + joint_idx) % 60)::DOUBLE AS cf, {_SURF} AS rs FROM pj WHERE px IS NOT NULL AND camera_id IN ('c0', 'c3') AND score >= 0.3),
so AS (SELECT session_id, camera_id, joint_idx, median(rs) AS o FROM ds GROUP BY ALL HAVING count(*) >= 24)"""


def depth_samples(spark, sf):
    v = T.projected_views(spark, sf).where("px IS NOT NULL AND camera_id IN ('c0', 'c3') AND score >= 0.3")
    residual = F.expr(_SURF).cast("double")
    return v.withColumns({"sd": F.col("depth") + residual, "cf": ((F.col("vec_id") + F.col("joint_idx")) % 60).cast("double"), "rs": residual})


@query("d13_surface_offsets", f"WITH {SQL_DEPTH} SELECT session_id, camera_id, joint_idx, {r6('o')} AS offset_m FROM so")
def d13(spark, sf):
    out = D.surface_offsets(depth_samples(spark, sf), ["session_id", "camera_id", "joint_idx"], "rs")
    return out.withColumn("offset_m", fixed("offset_m"))


def _sql_solve() -> str:
    def det(m):
        return f"({m[0]} * ({m[4]} * {m[8]} - {m[5]} * {m[7]}) - {m[1]} * ({m[3]} * {m[8]} - {m[5]} * {m[6]}) + {m[2]} * ({m[3]} * {m[7]} - {m[4]} * {m[6]}))"

    m = [f"(m{min(i, j)}{max(i, j)} + {1 if i == j else 0})" for i in range(3) for j in range(3)]
    b = [f"({a} + t{i})" for i, a in enumerate("xyz")]
    out = []
    for c in range(3):
        s = [b[i // 3] if i % 3 == c else m[i] for i in range(9)]
        out.append(f"{det(s)} / {det(m)} AS f{'xyz'[c]}")
    return ", ".join(out)


SQL_FUSED = f"""{SQL_DEPTH},
us AS (SELECT ds.*, sd - o AS cd, sd - o - depth AS cr, 0.35 * greatest(0.05, least(1.0, 1.0 - cf / 100)) * greatest(0.3, least(1.0, score)) AS w, rot[7] AS ax, rot[8] AS ay, rot[9] AS az
 FROM ds JOIN so USING (session_id, camera_id, joint_idx) JOIN cam USING (camera_id) WHERE abs(sd - o - depth) <= 0.2),
sm AS (SELECT session_id, sample_idx, joint_idx, any_value(x) AS x, any_value(y) AS y, any_value(z) AS z, {', '.join(f'sum(w * a{"xyz"[i]} * a{"xyz"[j]}) AS m{i}{j}' for i in range(3) for j in range(i, 3))}, {', '.join(f'sum(w * a{"xyz"[i]} * (cd - 4.0)) AS t{i}' for i in range(3))} FROM us GROUP BY ALL),
fz AS (SELECT session_id, sample_idx, joint_idx, x, y, z, {_sql_solve()} FROM sm)"""


def usable_depth(spark, sf):
    samples = depth_samples(spark, sf)
    offsets = D.surface_offsets(samples, ["session_id", "camera_id", "joint_idx"], "rs")
    rot = F.create_map(*[c for n in T.CAMERAS for c in (F.lit(n), F.array(*map(F.lit, T.rotation(n)[6:9])))])
    rows = samples.join(offsets, ["session_id", "camera_id", "joint_idx"]).withColumn("cd", F.col("sd") - F.col("offset_m"))
    rows = rows.where(F.abs(F.col("cd") - F.col("depth")) <= 0.2).withColumn("axis", rot[F.col("camera_id")])
    weight = 0.35 * F.greatest(F.lit(0.05), F.least(F.lit(1.0), 1.0 - F.col("cf") / 100)) * F.greatest(F.lit(0.3), F.least(F.lit(1.0), F.col("score")))
    return rows.withColumns({"w": weight, "target": F.col("cd") - T.DEPTH, **{f"a{i}": F.col("axis")[i] for i in range(3)}})


@query("d14_depth_constraint_fusion", f"WITH {SQL_FUSED} SELECT session_id, sample_idx, joint_idx, {', '.join(f'{r6(f'f{a}')} AS fused_{a}' for a in 'xyz')} FROM fz")
def d14(spark, sf):
    out = D.fuse_depth(usable_depth(spark, sf), POINT, "w", ["a0", "a1", "a2"], "target", ["x", "y", "z"])
    return out.select(*POINT, *[fixed(f"fused_{a}").alias(f"fused_{a}") for a in "xyz"])


_FQ = "(p[1] * fx + p[2] * fy + p[3] * fz + p[4])", "(p[5] * fx + p[6] * fy + p[7] * fz + p[8])", "(p[9] * fx + p[10] * fy + p[11] * fz + p[12])"


@query(
    "d15_depth_fusion_decision",
    f"""WITH {SQL_FUSED}, vw AS (SELECT pj.session_id, pj.sample_idx, pj.joint_idx, sqrt(pow({_FQ[0]} / {_FQ[2]} - px, 2) + pow({_FQ[1]} / {_FQ[2]} - py, 2)) - sqrt(pow(qx - px, 2) + pow(qy - py, 2)) AS inc
 FROM pj JOIN fz USING (session_id, sample_idx, joint_idx) JOIN cam USING (camera_id) WHERE px IS NOT NULL),
iv AS (SELECT session_id, sample_idx, joint_idx, median(inc) AS mi, max(inc) AS xi FROM vw GROUP BY ALL),
dp AS (SELECT u.session_id, u.sample_idx, u.joint_idx, median(abs(u.depth - cd)) AS b, median(abs(ax * fx + ay * fy + az * fz + 4.0 - cd)) AS a FROM us u JOIN fz USING (session_id, sample_idx, joint_idx) GROUP BY ALL),
dd AS (SELECT session_id, CASE WHEN sqrt(pow(fx - x, 2) + pow(fy - y, 2) + pow(fz - z, 2)) > 0.06 THEN 'rejected_correction_limit' WHEN b - a < 0.001 THEN 'rejected_no_depth_improvement' WHEN mi > 0.75 THEN 'rejected_median_reprojection_degradation'
 WHEN xi > 2.0 THEN 'rejected_camera_reprojection_degradation' ELSE 'accepted_depth_fusion' END AS decision FROM (SELECT session_id, sample_idx, joint_idx, x, y, z, fx, fy, fz.fz AS fz FROM fz) JOIN iv USING (session_id, sample_idx, joint_idx) JOIN dp USING (session_id, sample_idx, joint_idx))
SELECT session_id, decision, count(*) AS n FROM dd GROUP BY ALL""".replace("* fz + p", "* fz.fz + p").replace("az * fz + 4", "az * fz.fz + 4"),
)
def d15(spark, sf):
    usable = materialise(usable_depth(spark, sf), "depth")
    fused = D.fuse_depth(usable, POINT, "w", ["a0", "a1", "a2"], "target", ["x", "y", "z"])
    f = tuple(F.col(f"fused_{a}") for a in "xyz")
    depth = usable.join(fused, POINT)
    after = sum((F.col(f"a{i}") * f[i] for i in range(3)), F.lit(T.DEPTH)) - F.col("cd")
    # at most one row per camera of the rig in each of these groups
    depth = depth.groupBy(*POINT).agg(F.median(F.abs(F.col("depth") - F.col("cd"))).alias("b"), F.median(F.abs(after)).alias("a"))
    views = T.projected_views(spark, sf).where("px IS NOT NULL").join(F.broadcast(T.cameras(spark).select("camera_id", "p")), "camera_id").join(fused, POINT)
    u, v, _ = G.project(f, G.array_matrix("p", 12))
    gap = lambda x, y: F.sqrt((x - F.col("px")) ** 2 + (y - F.col("py")) ** 2)
    inc = gap(u, v) - gap(F.col("qx"), F.col("qy"))
    views = views.groupBy(*POINT).agg(F.median(inc).alias("mi"), F.max(inc).alias("xi"))
    rows = fused.join(depth, POINT).join(views, POINT)
    move = G.distance(f, tuple(F.col(f"base_{a}") for a in "xyz"))
    rows = rows.withColumn("decision", D.fusion_decision(move, F.col("b"), F.col("a"), F.col("mi"), F.col("xi")))
    return rows.groupBy("session_id", "decision").agg(F.count(F.lit(1)).alias("n"))


def _bounds(ref: str, cand: str, ratio: float, inc: float, name: str) -> str:
    return f"CASE WHEN {ref} IS NULL OR {cand} IS NULL THEN '{name}_metric_missing' WHEN {cand} > greatest({ref} * {ratio}, {ref} + {inc}) THEN '{name}' END"


@query(
    "d16_final_acceptance_gate",
    f"""WITH {T.SQL_LONG}, s AS (SELECT session_id, median(reproj_px) AS m, quantile_cont(reproj_px, 0.95) AS p, quantile_cont(abs(x) * 50, 0.95) AS a0, stddev_pop(z) / avg(abs(z)) * 100 AS b FROM p3 GROUP BY session_id),
s2 AS (SELECT *, CASE WHEN session_id % 4 <> 3 THEN a0 END AS a FROM s),
c AS (SELECT *, m * (1 + session_id * 0.005) AS m2, p + session_id * 0.2 AS p2, a * (1 + (session_id % 3) * 0.1) AS a2, b + session_id * 0.021 AS b2 FROM s2),
f AS (SELECT session_id, list_filter([{_bounds('m', 'm2', 1.02, 0.25, 'median_reprojection_degraded')}, {_bounds('p', 'p2', 1.03, 0.5, 'p95_reprojection_degraded')}, {_bounds('a', 'a2', 1.05, 1.0, 'p95_acceleration_degraded')},
 CASE WHEN b2 > b + 0.1 THEN 'bone_stability_degraded' END], lambda w: w IS NOT NULL) AS failures FROM c)
SELECT session_id, failures, len(failures) = 0 AS passed FROM f""",
)
def d16(spark, sf):
    points = T.pose3d(spark, sf)
    tall = points.select("session_id", F.expr("stack(2, 'r', reproj_px, 'a', abs(x) * 50) AS (k, v)"))
    q = exact_quantiles(tall, ["session_id", "k"], F.col("v"), {"m": 0.5, "p": 0.95})
    pick = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    s = q.groupBy("session_id").agg(pick("r", "m").alias("m"), pick("r", "p").alias("p"), pick("a", "p").alias("a"))
    bones = points.groupBy("session_id").agg((F.stddev_pop("z") / F.avg(F.abs("z")) * 100).alias("b"))
    n = F.col("session_id")
    s = s.join(bones, "session_id").withColumn("a", F.when(n % 4 != 3, F.col("a")))
    cand = {"m": F.col("m") * (1 + n * 0.005), "p": F.col("p") + n * 0.2, "a": F.col("a") * (1 + (n % 3) * 0.1)}
    names = {"m": ("median_reprojection_degraded", 1.02, 0.25), "p": ("p95_reprojection_degraded", 1.03, 0.5), "a": ("p95_acceleration_degraded", 1.05, 1.0)}
    checks = []
    for c, (name, ratio, inc) in names.items():
        missing = F.col(c).isNull() | cand[c].isNull()
        checks += [(missing, f"{name}_metric_missing"), (D.upper_bound_failed(F.col(c), cand[c], ratio, inc), name)]
    checks.append((F.col("b") + n * 0.021 > F.col("b") + 0.1, "bone_stability_degraded"))
    return s.select("session_id", reasons(*checks).alias("failures")).withColumn("passed", F.size("failures") == 0)


@query("d17_rotation_average")
def d17(spark, sf):
    f = T.frames(spark, sf).where(G.present(G.point(0)))
    r = G.rotation_from_vector(G.scale(G.point(0), 3.0))
    names = [f"r{i}" for i in range(9)]
    out = D.average_rotations(f.select("session_id", *[c.alias(n) for c, n in zip(r, names)]), ["session_id"], names)
    return out.select("session_id", *[fixed(n).alias(n) for n in names])


@query(
    "d18_representative_view",
    f"""WITH {T.SQL_FRAMES}, rv AS (SELECT session_id, vec_id, x0 * 3 AS rx, y0 * 3 AS ry, z0 * 3 AS rz, x1 AS tx, y1 AS ty, z1 + 4 AS tz, abs(e[60]) * 10 AS err,
  sqrt(x0 * 3 * x0 * 3 + y0 * 3 * y0 * 3 + z0 * 3 * z0 * 3) AS th FROM fr WHERE x0 IS NOT NULL AND x1 IS NOT NULL),
c AS (SELECT session_id, vec_id, err::DOUBLE AS err, -({_R[0]} * tx + {_R[3]} * ty + {_R[6]} * tz) AS cx, -({_R[1]} * tx + {_R[4]} * ty + {_R[7]} * tz) AS cy, -({_R[2]} * tx + {_R[5]} * ty + {_R[8]} * tz) AS cz FROM rv),
m AS (SELECT session_id, median(cx) AS mx, median(cy) AS my, median(cz) AS mz FROM c GROUP BY ALL),
d AS (SELECT c.*, sqrt(pow(cx - mx, 2) + pow(cy - my, 2) + pow(cz - mz, 2)) AS d FROM c JOIN m USING (session_id)),
s AS (SELECT session_id, median(err) AS se, median(d) AS sd FROM d GROUP BY ALL)
SELECT session_id, arg_min(vec_id, err / se + d / sd) AS vec_id, {r6('min(err / se + d / sd)')} AS combined FROM d JOIN s USING (session_id) GROUP BY ALL""",
)
def d18(spark, sf):
    f = T.frames(spark, sf).where(G.present(G.point(0)) & G.present(G.point(1)))
    r = G.rotation_from_vector(G.scale(G.point(0), 3.0))
    tx, ty, tz = G.point(1)
    center = G.camera_center(r, (tx, ty, tz + 4.0))
    views = f.select("session_id", "vec_id", (F.abs(F.col("e")[59]) * 10).cast("double").alias("err"), *[c.alias(n) for c, n in zip(center, ("cx", "cy", "cz"))])
    return D.representative_view(materialise(views, "views"), ["session_id"], "vec_id", "err", ["cx", "cy", "cz"]).withColumn("combined", fixed("combined"))


@query(
    "d19_joint_offset_calibration",
    f"""WITH {T.SQL_PROJECTED}, o AS (SELECT camera_id, joint_idx, median(qx - px) AS ox, median(qy - py) AS oy FROM pj WHERE px IS NOT NULL GROUP BY ALL),
s AS (SELECT camera_id, joint_idx, ox * least(1.0, 0.8 / greatest(sqrt(ox * ox + oy * oy), 1e-12)) AS ox, oy * least(1.0, 0.8 / greatest(sqrt(ox * ox + oy * oy), 1e-12)) AS oy FROM o),
e AS (SELECT camera_id, sqrt(pow(px - qx, 2) + pow(py - qy, 2)) AS b, sqrt(pow(px + ox - qx, 2) + pow(py + oy - qy, 2)) AS c FROM pj JOIN s USING (camera_id, joint_idx) WHERE px IS NOT NULL)
SELECT camera_id, {r6('avg(b)', 4)} AS base_mean_px, {r6('median(b)', 4)} AS base_median_px, {r6('avg(c)', 4)} AS calibrated_mean_px, {r6('median(c)', 4)} AS calibrated_median_px, {r6('(avg(b) - avg(c)) / avg(b)')} AS improvement_ratio FROM e GROUP BY ALL""",
)
def d19(spark, sf):
    v = materialise(T.projected_views(spark, sf).where("px IS NOT NULL").select("camera_id", "joint_idx", "px", "py", "qx", "qy"), "views")
    offsets = joint_offsets(v, ["camera_id", "joint_idx"], 0.8)
    rows = attach(v, offsets, ["camera_id", "joint_idx"])
    b = F.sqrt((F.col("px") - F.col("qx")) ** 2 + (F.col("py") - F.col("qy")) ** 2)
    c = F.sqrt((F.col("px") + F.col("ox") - F.col("qx")) ** 2 + (F.col("py") + F.col("oy") - F.col("qy")) ** 2)
    rows = rows.withColumns({"b": b, "c": c})
    means = rows.groupBy("camera_id").agg(F.avg("b").alias("bm"), F.avg("c").alias("cm"))
    q = exact_quantiles(rows.select("camera_id", F.expr("stack(2, 'b', b, 'c', c) AS (k, v)")), ["camera_id", "k"], F.col("v"), {"m": 0.5})
    mids = q.groupBy("camera_id").agg(*[F.max(F.when(F.col("k") == k, F.col("m"))).alias(f"{k}q") for k in "bc"])
    return means.join(mids, "camera_id").select(
        "camera_id", fixed("bm", 4).alias("base_mean_px"), fixed("bq", 4).alias("base_median_px"), fixed("cm", 4).alias("calibrated_mean_px"),
        fixed("cq", 4).alias("calibrated_median_px"), fixed(F.when(F.col("bm") > 0, (F.col("bm") - F.col("cm")) / F.col("bm")).otherwise(0.0)).alias("improvement_ratio"),
    )


def joint_offsets(views, keys, limit):
    """Median truth-minus-prediction per key, shortened to at most ``limit``."""
    tall = views.select(*keys, F.expr("stack(2, 'x', qx - px, 'y', qy - py) AS (axis, v)"))
    q = exact_quantiles(tall, [*keys, "axis"], F.col("v"), {"m": 0.5}).groupBy(*keys).agg(*[F.max(F.when(F.col("axis") == a, F.col("m"))).alias(f"o{a}") for a in "xy"])
    k = F.least(F.lit(1.0), limit / F.greatest(F.sqrt(F.col("ox") ** 2 + F.col("oy") ** 2), F.lit(1e-12)))
    return q.select(*keys, (F.col("ox") * k).alias("ox"), (F.col("oy") * k).alias("oy"))


@query(
    "d19_mass_centroid",
    f"""WITH m AS (SELECT l_suppkey AS grid, l_linenumber AS gx, l_partkey % 16 AS gy, l_quantity AS w FROM lineitem)
SELECT grid, {r6('sum(w * gx) / sum(w)')} AS center_x, {r6('sum(w * gy) / sum(w)')} AS center_y FROM m GROUP BY ALL HAVING sum(w) > 0""",
)
def d19m(spark, sf):
    w = F.col("l_quantity")
    grid = T.read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("grid")).agg(
        F.sum(w).alias("n"), F.sum(w * F.col("l_linenumber")).alias("sx"), F.sum(w * (F.col("l_partkey") % 16)).alias("sy")
    )
    return grid.where("n > 0").select("grid", fixed(F.col("sx") / F.col("n")).alias("center_x"), fixed(F.col("sy") / F.col("n")).alias("center_y"))


_BONEV = ", ".join(f"({i}, {J[a]}, {J[b]})" for i, (a, b) in enumerate(RELIABILITY_BONES))
SQL_BONELEN = f"""bn(bone, ja, jb) AS (VALUES {_BONEV}),
bl AS (SELECT a.session_id, a.sample_idx, bone, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS ln, least(a.used_cameras, b.used_cameras) AS wt
 FROM bn JOIN p3 a ON a.joint_idx = ja JOIN p3 b ON b.joint_idx = jb AND b.session_id = a.session_id AND b.sample_idx = a.sample_idx WHERE a.x IS NOT NULL AND b.x IS NOT NULL)"""


@query(
    "d20_weighted_median_bones",
    f"""WITH {T.SQL_LONG}, {SQL_BONELEN}, c AS (SELECT *, sum(wt) OVER (PARTITION BY session_id, bone ORDER BY ln, sample_idx) AS cw, sum(wt) OVER (PARTITION BY session_id, bone) AS tw, count(*) OVER (PARTITION BY session_id, bone) AS n FROM bl)
SELECT session_id, CAST(bone AS INTEGER) AS bone, {r6('min(ln)')} AS reference_m FROM c WHERE n >= 12 AND cw >= 0.5 * tw GROUP BY ALL""",
)
def d20(spark, sf):
    wide = T.sequence_frames(spark, sf)
    rows = wide.withColumn("b", F.explode(E._bone_table()))
    rows = rows.withColumns({"p": F.col("pts")[F.col("b.a")], "q": F.col("pts")[F.col("b.b")]})
    cams = lambda c: 1 + (F.col("vec_id") + F.col(f"b.{c}")) % 4
    rows = rows.select(
        "session_id", F.col("b.bone").alias("bone"), G.distance(tuple(F.col(f"p.{c}") for c in "xyz"), tuple(F.col(f"q.{c}") for c in "xyz")).alias("ln"),
        F.least(cams("a"), cams("b")).cast("double").alias("wt"),
    ).where("ln IS NOT NULL")
    enough = rows.groupBy("session_id", "bone").agg(F.count(F.lit(1)).alias("n")).where("n >= 12")
    out = weighted_median(rows, ["session_id", "bone"], F.col("ln"), F.col("wt"), "reference_m").join(enough, ["session_id", "bone"])
    return out.select("session_id", "bone", fixed("reference_m").alias("reference_m"))


@query(
    "d21_source_reliability_weights",
    f"""WITH {T.SQL_PROJECTED}, e AS (SELECT session_id, camera_id, median(sqrt(pow(px - qx, 2) + pow(py - qy, 2)) * (1 + ascii(right(camera_id, 1)) - 48)) AS m FROM pj WHERE px IS NOT NULL GROUP BY ALL),
w AS (SELECT *, exp(-m / 12.0) AS w FROM e), t AS (SELECT session_id, max(w) AS t FROM w GROUP BY ALL)
SELECT session_id, camera_id, {r6('m', 4)} AS median_error, {r6('greatest(0.2, least(1.0, 0.5 * 1.0 + 0.5 * greatest(0.2, least(1.0, w / t))))')} AS weight FROM w JOIN t USING (session_id)""",
)
def d21(spark, sf):
    v = T.projected_views(spark, sf).where("px IS NOT NULL")
    n = 1 + F.ascii(F.substring("camera_id", -1, 1)) - 48
    v = v.withColumn("err", F.sqrt((F.col("px") - F.col("qx")) ** 2 + (F.col("py") - F.col("qy")) ** 2) * n)
    out = D.camera_weights(v, "session_id", "err", previous=F.lit(1.0))
    return out.withColumns({"median_error": fixed("median_error", 4), "weight": fixed("weight")})


@query(
    "d22_observation_errors",
    f"""WITH {T.SQL_PROJECTED} SELECT session_id, sample_idx, joint_idx, count(*) AS observations, {r6('avg(sqrt(pow(px - qx, 2) + pow(py - qy, 2)))', 4)} AS mean_error_px,
 {r6('sum(pow(least(score, 1.0), 2))')} AS weight FROM pj WHERE px IS NOT NULL AND score >= 0.3 GROUP BY ALL""",
)
def d22(spark, sf):
    v = T.projected_views(spark, sf).where("px IS NOT NULL AND score >= 0.3")
    return v.groupBy(*POINT).agg(
        F.count(F.lit(1)).alias("observations"), fixed(F.avg(F.sqrt((F.col("px") - F.col("qx")) ** 2 + (F.col("py") - F.col("qy")) ** 2)), 4).alias("mean_error_px"),
        fixed(F.sum(F.least("score", F.lit(1.0)) ** 2)).alias("weight"),
    )


_LIM = [("left_shoulder", "left_elbow", "left_wrist"), ("right_shoulder", "right_elbow", "right_wrist"), ("left_hip", "left_knee", "left_ankle"), ("right_hip", "right_knee", "right_ankle")]


def _sql_limits() -> str:
    from . import oracle as O

    parts = []
    for a, c, b in _LIM:
        parts.append(f"SELECT session_id, {O.angle(a, c, b, 1e-12)} AS v FROM fr WHERE x{J[a]} IS NOT NULL AND x{J[b]} IS NOT NULL AND x{J[c]} IS NOT NULL")
    return " UNION ALL ".join(parts)


@query(
    "d23_sequence_quality_metrics",
    f"""WITH {T.SQL_LONG}, {SQL_BONELEN},
rf AS (SELECT session_id, bone, median(ln) AS ref FROM bl GROUP BY ALL HAVING count(*) >= 5 AND median(ln) > 1e-6),
bd AS (SELECT session_id, median(abs(ln - ref)) AS bm, quantile_cont(abs(ln - ref), 0.95) AS bp FROM bl JOIN rf USING (session_id, bone) GROUP BY ALL),
bc AS (SELECT session_id, avg(cv) AS cv FROM (SELECT session_id, bone, stddev_pop(ln) / avg(ln) * 100 AS cv FROM bl JOIN rf USING (session_id, bone) GROUP BY ALL HAVING count(*) >= 2 AND avg(ln) > 1e-9) GROUP BY ALL),
l AS (SELECT *, t_sec - lag(t_sec) {LAGW} AS b, lead(t_sec) {LAGW} - t_sec AS f, {', '.join(f'lag({c}) {LAGW} AS p{c}, lead({c}) {LAGW} AS n{c}' for c in 'xyz')} FROM p3),
ac AS (SELECT session_id, sqrt({' + '.join(f'pow(2.0 * ((n{c} - {c}) / f - ({c} - p{c}) / b) / (b + f), 2)' for c in 'xyz')}) AS a FROM l),
aq AS (SELECT session_id, median(a) AS am, quantile_cont(a, 0.95) AS ap FROM ac WHERE a IS NOT NULL GROUP BY ALL),
jl AS ({_sql_limits()}), jx AS (SELECT session_id, count(*) FILTER (WHERE greatest(5 - v, 0) + greatest(v - 179, 0) > 1e-6) AS lv FROM jl GROUP BY ALL),
rp AS (SELECT session_id, median(reproj_px) AS rm, quantile_cont(reproj_px, 0.95) AS rq, avg(CASE WHEN x IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS vr FROM p3 GROUP BY ALL)
SELECT session_id, {r6('rm')} AS reprojection_median, {r6('rq')} AS reprojection_p95, {r6('bm')} AS bone_median, {r6('bp')} AS bone_p95, {r6('cv', 4)} AS mean_bone_cv, {r6('am', 3)} AS acceleration_median, {r6('ap', 3)} AS acceleration_p95, lv AS joint_limit_violations, {r6('vr')} AS valid_body_ratio
FROM rp JOIN bd USING (session_id) JOIN bc USING (session_id) JOIN aq USING (session_id) JOIN jx USING (session_id)""",
)
def d23(spark, sf):
    return sequence_quality(spark, sf).select(
        "session_id", *[fixed(c).alias(c) for c in ("reprojection_median", "reprojection_p95", "bone_median", "bone_p95")], fixed("mean_bone_cv", 4).alias("mean_bone_cv"),
        fixed("acceleration_median", 3).alias("acceleration_median"), fixed("acceleration_p95", 3).alias("acceleration_p95"), "joint_limit_violations",
        fixed("valid_body_ratio").alias("valid_body_ratio"),
    )


def sequence_quality(spark, sf):
    """Reprojection, bone, acceleration and joint-limit summary of one version of a sequence; one quantile pass for all."""
    wide = materialise(T.sequence_frames(spark, sf).select("session_id", "vec_id", "sample_idx", "t_sec", "e", "pts"), "frames")
    points = T.long_points(wide)
    lengths = E.bone_lengths(wide, ["session_id"])
    refs = E.reference_lengths(wide, "session_id")
    bones = attach(lengths, refs, ["session_id", "bone"]).where("ref IS NOT NULL")
    acc = E.motion_derivatives(points, ["session_id", "joint_idx"], "sample_idx", "t_sec", "xyz")
    tall = (
        points.select("session_id", F.lit("r").alias("k"), F.col("reproj_px").alias("v"))
        .unionByName(bones.select("session_id", F.lit("b").alias("k"), F.abs(F.col("length") - F.col("ref")).alias("v")))
        .unionByName(acc.select("session_id", F.lit("a").alias("k"), F.col("acceleration").alias("v")))
    )
    q = exact_quantiles(tall, ["session_id", "k"], F.col("v"), {"m": 0.5, "p": 0.95})
    pick = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    names = {"r": "reprojection", "b": "bone", "a": "acceleration"}
    out = q.groupBy("session_id").agg(*[pick(k, c).alias(f"{n}_{s}") for k, n in names.items() for c, s in (("m", "median"), ("p", "p95"))])
    per_bone = bones.groupBy("session_id", "bone").agg((F.stddev_pop("length") / F.avg("length") * 100).alias("cv"), F.count(F.lit(1)).alias("n"), F.avg("length").alias("m"))
    cv = per_bone.where("n >= 2 AND m > 1e-9").groupBy("session_id").agg(F.avg("cv").alias("mean_bone_cv"))
    excess = sum(
        (F.when(F.greatest(5.0 - a, F.lit(0.0)) + F.greatest(a - 179.0, F.lit(0.0)) > 1e-6, 1).otherwise(0) for a in (G.joint_angle(G.joint(p), G.joint(c), G.joint(n), 1e-12) for p, c, n in _LIM)),
        F.lit(0),
    )
    limits = wide.groupBy("session_id").agg(F.sum(excess).cast("long").alias("joint_limit_violations"))
    valid = points.groupBy("session_id").agg(F.avg(F.when(F.col("x").isNotNull(), 1.0).otherwise(0.0)).alias("valid_body_ratio"))
    for other in (cv, limits, valid):
        out = out.join(other, "session_id", "left")
    return out


@query(
    "d24_sequence_acceptance_gate",
    f"""WITH {T.SQL_LONG}, s AS (SELECT session_id, median(reproj_px) AS m, quantile_cont(reproj_px, 0.95) AS p, quantile_cont(abs(x) * 50, 0.95) AS a, stddev_pop(z) / avg(abs(z)) * 100 AS b FROM p3 GROUP BY ALL),
c AS (SELECT *, m + session_id * 0.3 AS m2, p * (1 + session_id * 0.03) AS p2, a * (1 + (session_id % 3) * 0.3) AS a2, b + session_id * 0.04 AS b2, 0.06 * session_id AS cor, session_id % 5 <> 4 AS ok FROM s),
f AS (SELECT session_id, list_filter([CASE WHEN NOT ok THEN 'solver_failed' END, CASE WHEN m2 > greatest(m * 1.05, m + 1) THEN 'median_reprojection_degraded' END, CASE WHEN p2 > greatest(p * 1.1, p + 2) THEN 'p95_reprojection_degraded' END,
 CASE WHEN cor > 0.3 THEN 'body_correction_too_large' END, CASE WHEN a2 > greatest(a * 1.1, a + 5) THEN 'p95_acceleration_degraded' END, CASE WHEN b2 > b + 0.25 THEN 'bone_stability_degraded' END], lambda w: w IS NOT NULL) AS failures FROM c)
SELECT session_id, failures, CASE WHEN len(failures) = 0 THEN 'candidate' ELSE 'input' END AS kept_version FROM f""",
)
def d24(spark, sf):
    points = T.pose3d(spark, sf)
    tall = points.select("session_id", F.expr("stack(2, 'r', reproj_px, 'a', abs(x) * 50) AS (k, v)"))
    q = exact_quantiles(tall, ["session_id", "k"], F.col("v"), {"m": 0.5, "p": 0.95})
    pick = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    s = q.groupBy("session_id").agg(pick("r", "m").alias("m"), pick("r", "p").alias("p"), pick("a", "p").alias("a"))
    s = s.join(points.groupBy("session_id").agg((F.stddev_pop("z") / F.avg(F.abs("z")) * 100).alias("b")), "session_id")
    n = F.col("session_id")
    why = reasons(
        (n % 5 == 4, "solver_failed"),
        (D.upper_bound_failed(F.col("m"), F.col("m") + n * 0.3, 1.05, 1.0), "median_reprojection_degraded"),
        (D.upper_bound_failed(F.col("p"), F.col("p") * (1 + n * 0.03), 1.10, 2.0), "p95_reprojection_degraded"),
        (0.06 * n > 0.30, "body_correction_too_large"),
        (D.upper_bound_failed(F.col("a"), F.col("a") * (1 + (n % 3) * 0.3), 1.10, 5.0), "p95_acceleration_degraded"),
        (F.col("b") + n * 0.04 > F.col("b") + 0.25, "bone_stability_degraded"),
    )
    return s.select("session_id", why.alias("failures")).withColumn("kept_version", F.when(F.size("failures") == 0, "candidate").otherwise("input"))
