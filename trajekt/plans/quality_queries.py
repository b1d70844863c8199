"""F: quality, readiness and stability queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.numeric import count_where, fixed, reasons
from ..functions.skeleton import ANGLES, BODY_JOINTS, LENGTHS
from ..operators import quality as Q
from ..operators import temporal as E
from ..operators.blocks import runs
from ..operators.quantiles import attach, exact_quantiles
from ..session import materialise
from . import oracle as O
from . import tables as T
from .geometry_queries import box_diagonal_scale
from .registry import query
from .temporal_queries import KEYS, SQL_SPEED, sql_fit, sql_robust, sql_runs

r6 = T.r6
SHARE = "avg(CASE WHEN {} THEN 1.0 ELSE 0.0 END)"


@query(
    "f1_validity_by_grouping_sets",
    f"""WITH {T.SQL_LONG}, q AS (SELECT *, CASE WHEN x IS NOT NULL AND reproj_px <= 25 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ok FROM p3)
SELECT session_id, sample_idx, joint_idx, CASE WHEN grouping(sample_idx) = 0 THEN 'frame' WHEN grouping(joint_idx) = 0 THEN 'joint' ELSE 'session' END AS level,
 {r6('avg(ok)')} AS valid_ratio, {r6('avg(reproj_px)')} AS mean_error_px
FROM q GROUP BY GROUPING SETS ((session_id, sample_idx), (session_id, joint_idx), (session_id))""",
)
def f1(spark, sf):
    valid = F.col("x").isNotNull() & F.coalesce(F.col("reproj_px") <= 25, F.lit(False))
    out = Q.validity(T.pose3d(spark, sf), "session_id", "sample_idx", "joint_idx", valid, "reproj_px")
    return out.withColumns({c: fixed(c) for c in ("valid_ratio", "mean_error_px")})


@query(
    "f2_quality_summary",
    f"""WITH {T.SQL_LONG}, fr2 AS (SELECT session_id, sample_idx, bool_or(x IS NOT NULL) AS anyv, avg(CASE WHEN x IS NOT NULL AND reproj_px <= 25 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS vr, avg(reproj_px) AS me FROM p3 GROUP BY ALL),
jt AS (SELECT session_id, joint_idx, bool_or(x IS NOT NULL) AS anyv, avg(CASE WHEN x IS NOT NULL AND reproj_px <= 25 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS vr FROM p3 GROUP BY ALL),
a AS (SELECT session_id, count(*) AS frame_count, count(*) FILTER (WHERE anyv) AS valid_frame_count, avg(vr) AS fv, avg(me) AS fe FROM fr2 GROUP BY ALL),
b AS (SELECT session_id, count(*) AS keypoint_count, count(*) FILTER (WHERE anyv) AS valid_joint_count, avg(vr) AS jv FROM jt GROUP BY ALL),
c AS (SELECT session_id, avg(tri_score) FILTER (WHERE tri_score > 0) AS ms, avg(reproj_px) AS mr, max(reproj_px) AS xr, avg(used_cameras) FILTER (WHERE used_cameras > 0) AS uc FROM p3 GROUP BY ALL)
SELECT session_id, frame_count, keypoint_count, valid_frame_count, valid_joint_count, {r6('fv')} AS mean_frame_valid_ratio, {r6('jv')} AS mean_joint_valid_ratio,
 {r6('ms')} AS mean_score, {r6('mr')} AS mean_error_px, {r6('xr')} AS max_error_px, {r6('uc')} AS mean_cameras,
 list_filter([CASE WHEN fv < 0.5 THEN 'mean_frame_valid_ratio_below_0_50' END, CASE WHEN fe > 25 THEN 'mean_reprojection_error_above_threshold' END], lambda w: w IS NOT NULL) AS warnings
FROM a JOIN b USING (session_id) JOIN c USING (session_id)""",
)
def f2(spark, sf):
    valid = F.col("x").isNotNull() & F.coalesce(F.col("reproj_px") <= 25, F.lit(False))
    points = T.pose3d(spark, sf).withColumns({"ok": F.when(valid, 1.0).otherwise(0.0), "seen": F.col("x").isNotNull()})
    # one grouping-sets pass, then one roll-up of its small result
    levels = points.groupingSets(
        [["session_id", "sample_idx"], ["session_id", "joint_idx"], ["session_id"]], "session_id", "sample_idx", "joint_idx"
    ).agg(
        (F.grouping("sample_idx") * 2 + F.grouping("joint_idx")).alias("g"), F.max("seen").alias("seen"), F.avg("ok").alias("vr"),
        F.avg("reproj_px").alias("me"), F.max("reproj_px").alias("xe"),
        F.avg(F.when(F.col("tri_score") > 0, F.col("tri_score"))).alias("ms"),
        F.avg(F.when(F.col("used_cameras") > 0, F.col("used_cameras"))).alias("uc"),
    )
    frame, joint, whole = F.col("g") == 1, F.col("g") == 2, F.col("g") == 3
    pick = lambda c: F.max(F.when(whole, F.col(c)))
    out = levels.groupBy("session_id").agg(
        count_where(frame).alias("frame_count"), count_where(joint).alias("keypoint_count"),
        count_where(frame & F.col("seen")).alias("valid_frame_count"), count_where(joint & F.col("seen")).alias("valid_joint_count"),
        F.avg(F.when(frame, F.col("vr"))).alias("fv"), F.avg(F.when(joint, F.col("vr"))).alias("jv"),
        F.avg(F.when(frame, F.col("me"))).alias("fe"), pick("ms").alias("ms"), pick("me").alias("mr"), pick("xe").alias("xr"), pick("uc").alias("uc"),
    )
    return out.select(
        "session_id", "frame_count", "keypoint_count", "valid_frame_count", "valid_joint_count",
        fixed("fv").alias("mean_frame_valid_ratio"), fixed("jv").alias("mean_joint_valid_ratio"), fixed("ms").alias("mean_score"),
        fixed("mr").alias("mean_error_px"), fixed("xr").alias("max_error_px"), fixed("uc").alias("mean_cameras"),
        reasons((F.col("fv") < 0.5, "mean_frame_valid_ratio_below_0_50"), (F.col("fe") > 25, "mean_reprojection_error_above_threshold")).alias("warnings"),
    )


def _sql_ready(key: str, where: str = "TRUE") -> str:
    return f"""SELECT session_id, {key}, avg(CASE WHEN x IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS valid_ratio,
 avg(tri_score) FILTER (WHERE tri_score > 0) AS mean_score, avg(reproj_px) AS mean_error_px, avg(used_cameras) FILTER (WHERE used_cameras > 0) AS mean_cameras
 FROM p3 WHERE {where} GROUP BY ALL"""


_READY = "coalesce(valid_ratio >= 0.7 AND mean_score >= 0.45 AND mean_error_px <= 25 AND mean_cameras >= 2, FALSE)"
_READY_OUT = f"{r6('valid_ratio')} AS valid_ratio, {r6('mean_score')} AS mean_score, {r6('mean_error_px')} AS mean_error_px, {r6('mean_cameras')} AS mean_cameras, {_READY} AS ready"


def _readiness(points, *keys):
    out = points.groupBy(*keys).agg(*Q.readiness_columns(F.col("x").isNotNull(), "tri_score", "reproj_px", "used_cameras"))
    return out.withColumn("ready", Q.ready("valid_ratio", 0.45, 25.0))


def _rounded(df):
    return df.withColumns({c: fixed(c) for c in ("valid_ratio", "mean_score", "mean_error_px", "mean_cameras")})


@query("f3_frame_readiness", f"WITH {T.SQL_LONG}, a AS ({_sql_ready('sample_idx')}) SELECT session_id, sample_idx, {_READY_OUT} FROM a")
def f3(spark, sf):
    return _rounded(_readiness(T.pose3d(spark, sf), "session_id", "sample_idx"))


@query("f4_joint_readiness", f"WITH {T.SQL_LONG}, a AS ({_sql_ready('joint_idx')}) SELECT session_id, joint_idx, {_READY_OUT} FROM a")
def f4(spark, sf):
    return _rounded(_readiness(T.pose3d(spark, sf), "session_id", "joint_idx"))


_SPEEDS = {"left_wrist_speed": 9, "right_wrist_speed": 10, "left_ankle_speed": 15, "right_ankle_speed": 16}


@query(
    "f5_biomechanics_series",
    f"""WITH {T.SQL_LONG}, {SQL_SPEED},
w AS (SELECT session_id, sample_idx, {', '.join(f'max(speed) FILTER (WHERE joint_idx = {j}) AS {n}' for n, j in _SPEEDS.items())}, avg(speed) AS body_motion_energy FROM sp GROUP BY ALL)
SELECT session_id, sample_idx, {r6('t_sec')} AS t_sec, {', '.join(f'{r6(O.angle(a, c, b))} AS {n}' for n, (a, c, b) in ANGLES.items())},
 {', '.join(f'{r6(O.dist(a, b))} AS {n}_len' for n, (a, b) in LENGTHS.items())},
 {', '.join(f'{r6(n)} AS {n}' for n in _SPEEDS)}, {r6('body_motion_energy')} AS body_motion_energy
FROM fr JOIN w USING (session_id, sample_idx)""",
)
def f5(spark, sf):
    framed = T.sequence_frames(spark, sf)
    wide = framed.select(
        "session_id", "sample_idx", fixed("t_sec").alias("t_sec"),
        *[fixed(G.joint_angle(G.joint(a), G.joint(c), G.joint(b))).alias(n) for n, (a, c, b) in ANGLES.items()],
        *[fixed(c).alias(f"{n}_len") for n, c in G.segment_lengths().items()],
    )
    fast = E.speed(T.long_points(framed), KEYS, "sample_idx", "xyz", T.FPS)
    speeds = fast.groupBy("session_id", "sample_idx").agg(
        *[fixed(F.max(F.when(F.col("joint_idx") == j, F.col("speed")))).alias(n) for n, j in _SPEEDS.items()],
        fixed(F.avg("speed")).alias("body_motion_energy"),
    )
    return wide.join(speeds, ["session_id", "sample_idx"])


SQL_ENERGY = f"{SQL_SPEED}, en AS (SELECT session_id, sample_idx, avg(speed) AS e FROM sp GROUP BY ALL)"
SQL_THRESHOLD = """q1 AS (SELECT session_id, median(e) AS md, quantile_cont(e, 0.25) AS lo, quantile_cont(e, 0.75) AS hi, avg(e) AS mu, stddev_pop(e) AS sd FROM en WHERE e >= 0 GROUP BY ALL),
q2 AS (SELECT session_id, median(abs(e - md)) AS mad FROM en JOIN q1 USING (session_id) GROUP BY ALL),
th AS (SELECT session_id, CASE WHEN mad > 1e-12 THEN greatest(least(md + 2.5 * 1.4826 * mad, hi), lo) WHEN sd > 1e-12 THEN greatest(least(mu + 0.5 * sd, hi), lo, 0.0) WHEN md > 0 THEN md END AS threshold FROM q1 JOIN q2 USING (session_id))"""


def frame_energy(spark, sf):
    fast = E.speed(T.pose3d(spark, sf), KEYS, "sample_idx", "xyz", T.FPS)
    return fast.groupBy("session_id", "sample_idx").agg(F.avg("speed").alias("energy"))


@query("f6_adaptive_threshold", f"WITH {T.SQL_LONG}, {SQL_ENERGY}, {SQL_THRESHOLD} SELECT session_id, {r6('threshold')} AS threshold FROM th")
def f6(spark, sf):
    out = Q.motion_threshold(materialise(frame_energy(spark, sf), "energy"), ["session_id"], F.col("energy"))
    return out.select("session_id", fixed("threshold").alias("threshold"))


SQL_SEGMENTS = f"""act AS (SELECT session_id, sample_idx, e, e >= threshold AND e > 0 AS on_ FROM en JOIN th USING (session_id)),
{sql_runs('act', 'session_id', 'on_', name='sr')},
sg0 AS (SELECT session_id, run_start, run_end, avg(e) AS me FROM sr WHERE run_start IS NOT NULL GROUP BY ALL HAVING run_end - run_start + 1 >= 3),
sg AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY run_start) - 1 AS segment_id, run_start AS start_frame, run_end AS end_frame, me FROM sg0)"""


@query(
    "f7_activity_segments",
    f"""WITH {T.SQL_LONG}, {SQL_ENERGY}, {SQL_THRESHOLD}, {SQL_SEGMENTS},
nn AS (SELECT session_id, max(sample_idx) AS mx, count(e) AS k FROM en WHERE session_id NOT IN (SELECT session_id FROM sg) GROUP BY ALL)
SELECT session_id, segment_id, 'motion_candidate' AS label, start_frame, end_frame, {r6(f'start_frame / {T.FPS}::DOUBLE')} AS start_time_sec,
 {r6(f'end_frame / {T.FPS}::DOUBLE')} AS end_time_sec, {r6('me')} AS mean_motion_energy, 'needs_label' AS status FROM sg
UNION ALL SELECT session_id, 0, 'pending_motion', 0, CASE WHEN k > 0 THEN mx ELSE 0 END, NULL, NULL, NULL, CASE WHEN k > 0 THEN 'no_stable_segment_found' ELSE 'not_enough_motion_data' END FROM nn""",
)
def f7(spark, sf):
    energy = materialise(frame_energy(spark, sf), "energy")
    out = Q.activity_segments(energy, "session_id", "sample_idx", "energy", T.FPS)
    return out.withColumns({c: fixed(c) for c in ("start_time_sec", "end_time_sec", "mean_motion_energy")})


@query(
    "f8_readiness_report",
    f"""WITH {T.SQL_LONG}, {SQL_ENERGY}, {SQL_THRESHOLD}, {SQL_SEGMENTS},
fa AS ({_sql_ready('sample_idx')}), fb AS (SELECT session_id, count(*) AS frame_count, avg(CASE WHEN {_READY} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS rr FROM fa GROUP BY ALL),
ja AS ({_sql_ready('joint_idx')}), jb AS (SELECT session_id, count(*) FILTER (WHERE {_READY}) AS reliable_joint_count FROM ja GROUP BY ALL),
sb AS (SELECT session_id, count(*) AS k FROM sg GROUP BY ALL),
al AS (SELECT fb.*, reliable_joint_count, greatest(coalesce(k, 0), 1) AS segment_count, list_filter([CASE WHEN rr < 0.7 THEN 'too_few_ready_frames' END,
 CASE WHEN reliable_joint_count < 12 THEN 'too_few_reliable_joints' END, CASE WHEN k IS NULL THEN 'segments_need_review' END], lambda w: w IS NOT NULL) AS warnings
 FROM fb JOIN jb USING (session_id) LEFT JOIN sb USING (session_id))
SELECT session_id, frame_count, {r6('rr')} AS ready_frame_ratio, reliable_joint_count, segment_count, warnings, CASE WHEN len(warnings) = 0 THEN 'ready' ELSE 'needs_review' END AS status FROM al""",
)
def f8(spark, sf):
    points = T.pose3d(spark, sf)
    segments = Q.activity_segments(materialise(frame_energy(spark, sf), "energy"), "session_id", "sample_idx", "energy", T.FPS)
    out = Q.readiness_report(
        _readiness(points, "session_id", "sample_idx"), _readiness(points, "session_id", "joint_idx"), segments, "session_id"
    )
    return out.withColumn("ready_frame_ratio", fixed("ready_frame_ratio"))


@query(
    "f9_source_timeline_attach",
    f"""WITH {T.SQL_LONG}, {SQL_ENERGY}, {SQL_THRESHOLD}, {SQL_SEGMENTS}, src AS (SELECT DISTINCT session_id, sample_idx, vec_id, t_sec FROM p3),
mm AS (SELECT session_id, max(sample_idx) AS mx FROM src GROUP BY ALL)
SELECT sg.session_id, segment_id, a.vec_id AS source_start_frame, b.vec_id AS source_end_frame, {r6('a.t_sec')} AS start_time_sec, {r6('b.t_sec')} AS end_time_sec
FROM sg JOIN mm USING (session_id) JOIN src a ON a.session_id = sg.session_id AND a.sample_idx = least(greatest(sg.start_frame, 0), mx)
JOIN src b ON b.session_id = sg.session_id AND b.sample_idx = least(greatest(sg.end_frame, 0), mx)""",
)
def f9(spark, sf):
    frames = T.sequence_frames(spark, sf).select("session_id", "sample_idx", "vec_id", "t_sec")
    segments = Q.activity_segments(materialise(frame_energy(spark, sf), "energy"), "session_id", "sample_idx", "energy", T.FPS)
    return attach_source_timeline(segments.where("label = 'motion_candidate'"), frames).withColumns(
        {c: fixed(c) for c in ("start_time_sec", "end_time_sec")}
    )


def attach_source_timeline(segments, frames):
    """Source frame and time of both segment ends, clipped to the known frames."""
    ends = frames.groupBy("session_id").agg(F.max("sample_idx").alias("__mx"))
    clipped = segments.join(ends, "session_id").select(
        "session_id", "segment_id",
        F.least(F.greatest("start_frame", F.lit(0)), "__mx").alias("__a"), F.least(F.greatest("end_frame", F.lit(0)), "__mx").alias("__b"),
    )
    first = frames.select("session_id", F.col("sample_idx").alias("__a"), F.col("vec_id").alias("source_start_frame"), F.col("t_sec").alias("start_time_sec"))
    last = frames.select("session_id", F.col("sample_idx").alias("__b"), F.col("vec_id").alias("source_end_frame"), F.col("t_sec").alias("end_time_sec"))
    return clipped.join(first, ["session_id", "__a"]).join(last, ["session_id", "__b"]).drop("__a", "__b")


# ---------------------------------------------------------------- stability


def high_frequency(df, keys, idx, groups, valid, window=11):
    """Distance of each group of coordinates, ``{name: coords}``, to the order-2 trend of the run (at least five samples), NULL
    elsewhere. All groups share the runs and one pass over the windows."""
    coords = [c for group in groups.values() for c in group]
    fitted = E.savgol_fit(runs(df, keys, idx, valid), keys, idx, coords, window, 2, "_tr", min_window=5)
    gaps = {out: G.norm(G.sub([F.col(c) for c in group], [F.col(f"{c}_tr") for c in group])) for out, group in groups.items()}
    return fitted.withColumns(gaps).drop("run_start", "run_end", *[f"{c}_tr" for c in coords])


def stability(points, keys, session, idx, raw, stable):
    """Raw and smoothed high-frequency ratios and adjustment per session, as one row each."""
    valid = G.present([F.col(c) for c in raw + stable])
    both = materialise(points.withColumn("__ok", valid), "stable")
    scale = box_diagonal_scale(
        both.select(session, idx, *[F.when(F.col("__ok"), F.col(c)).alias(c) for c in raw]), session, idx, raw
    )
    jitter = high_frequency(both, keys, idx, {"__raw": raw, "__stable": stable}, F.col("__ok"))
    jitter = jitter.join(scale, [session, idx], "left").withColumns(
        {
            "__raw": F.col("__raw") / F.col("box_scale"), "__stable": F.col("__stable") / F.col("box_scale"),
            "__adj": F.when(F.col("__ok"), G.distance([F.col(c) for c in stable], [F.col(c) for c in raw])),
        }
    )
    tall = jitter.select(session, F.expr("stack(3, 'raw', __raw, 'stable', __stable, 'adj', __adj) AS (kind, v)"))
    q = exact_quantiles(tall, [session, "kind"], F.col("v"), {"med": 0.5, "p95": 0.95})
    pick = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    stats = q.groupBy(session).agg(
        pick("raw", "med").alias("raw_ratio"), pick("stable", "med").alias("stable_ratio"),
        pick("adj", "med").alias("median_adjustment"), pick("adj", "p95").alias("p95_adjustment"),
    )
    counts = both.groupBy(session).agg(count_where(F.col("__ok")).alias("comparable_samples"))
    return counts.join(stats, session, "left").withColumn(
        "reduction_percent", Q.reduction_percent(F.col("raw_ratio"), F.col("stable_ratio"))
    )


def _sql_stability(source: str, keys: list[str], raw: list[str], sm: list[str]) -> str:
    known = " AND ".join(f"{c} IS NOT NULL" for c in raw + sm)
    diag = " + ".join(f"pow(max({c}) - min({c}), 2)" for c in raw)
    return f"""sb0 AS (SELECT * EXCLUDE (run_start, run_end, fl, idn, g), {known} AS okk FROM {source}),
{sql_runs('sb0', ', '.join(keys), 'okk', name='st')},
{sql_fit('st', keys, raw, 11, 2, 'tr', 5)},
{sql_fit('tr', keys, sm, 11, 2, 'ts', 5)},
dg AS (SELECT session_id, sample_idx, CASE WHEN count(*) >= 2 THEN sqrt({diag}) END AS d FROM sb0 WHERE okk GROUP BY ALL),
dm AS (SELECT session_id, coalesce(median(d) FILTER (WHERE d > 1e-9), 1.0) AS fb FROM dg GROUP BY ALL),
sr AS (SELECT ts.*, CASE WHEN d > 1e-9 THEN d ELSE fb END AS bs FROM ts LEFT JOIN dg USING (session_id, sample_idx) LEFT JOIN dm USING (session_id)),
sv AS (SELECT session_id, okk, sqrt({' + '.join(f'pow({c} - {c}_f, 2)' for c in raw)}) / bs AS rr, sqrt({' + '.join(f'pow({c} - {c}_f, 2)' for c in sm)}) / bs AS ss,
 CASE WHEN okk THEN sqrt({' + '.join(f'pow({a} - {b}, 2)' for a, b in zip(sm, raw))}) END AS ad FROM sr),
so AS (SELECT session_id, count(*) FILTER (WHERE okk) AS comparable_samples, median(rr) AS rr, median(ss) AS ss, median(ad) AS am, quantile_cont(ad, 0.95) AS ap FROM sv GROUP BY ALL)"""


_STAB_OUT = f"""session_id, comparable_samples, {r6('rr')} AS raw_ratio, {r6('ss')} AS stable_ratio, {r6('am')} AS median_adjustment, {r6('ap')} AS p95_adjustment,
 {r6('CASE WHEN rr > 1e-12 THEN 100.0 * (rr - ss) / rr END', 4)} AS reduction_percent"""


def _stab_rounded(df):
    cols = {c: fixed(c) for c in ("raw_ratio", "stable_ratio", "median_adjustment", "p95_adjustment")}
    return df.withColumns({**cols, "reduction_percent": fixed("reduction_percent", 4)})


@query(
    "f10_pose_stability",
    f"""WITH {T.SQL_LONG}, {sql_runs('p3', 'session_id, joint_idx', 'x IS NOT NULL')}, {sql_robust('rn', KEYS, ['x', 'y', 'z'], 7, 2, 0.04, 'sg')},
{_sql_stability('sg', KEYS, ['x', 'y', 'z'], ['x_sm', 'y_sm', 'z_sm'])} SELECT {_STAB_OUT} FROM so""",
)
def f10(spark, sf):
    smoothed = E.robust_savgol(T.pose3d(spark, sf), KEYS, "sample_idx", "xyz", F.lit(True)).drop("run_start", "run_end")
    return _stab_rounded(stability(smoothed, KEYS, "session_id", "sample_idx", list("xyz"), ["x_sm", "y_sm", "z_sm"]))


@query(
    "f10_angle_stability",
    f"""WITH {T.SQL_FRAMES}, an AS ({' UNION ALL '.join(f"SELECT session_id, sample_idx, '{n}' AS angle, {O.angle(a, c, b, 1e-12)} AS v FROM fr" for n, (a, c, b) in ANGLES.items())}),
{sql_runs('an', 'session_id, angle', 'v IS NOT NULL')}, {sql_fit('rn', ['session_id', 'angle'], ['v'], 11, 2, 'tr', 5)}
SELECT session_id, angle, count(v) AS valid_frame_count, {r6('median(abs(v - v_f))')} AS high_frequency_median_deg FROM tr GROUP BY ALL""",
)
def f10b(spark, sf):
    names = F.array(*[
        F.struct(F.lit(n).alias("angle"), G.joint_angle(G.joint(a), G.joint(c), G.joint(b), 1e-12).alias("v"))
        for n, (a, c, b) in ANGLES.items()
    ])
    tall = T.sequence_frames(spark, sf).select("session_id", "sample_idx", F.inline(names))
    residual = high_frequency(tall, ["session_id", "angle"], "sample_idx", {"residual": ["v"]}, F.col("v").isNotNull())
    q = exact_quantiles(residual, ["session_id", "angle"], F.col("residual"), {"m": 0.5})
    n = tall.groupBy("session_id", "angle").agg(F.count("v").alias("valid_frame_count"))
    return n.join(q, ["session_id", "angle"], "left").select(
        "session_id", "angle", "valid_frame_count", fixed("m").alias("high_frequency_median_deg")
    )


@query(
    "f11_view_stability",
    f"""WITH {T.SQL_VIEWS}, v0 AS (SELECT session_id || '/' || camera_id AS session_id, joint_idx, sample_idx, px, py FROM p2),
sm AS (SELECT *, avg(px) {'OVER (PARTITION BY session_id, joint_idx ORDER BY sample_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)'} AS px_ma,
 avg(py) OVER (PARTITION BY session_id, joint_idx ORDER BY sample_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS py_ma,
 NULL AS run_start, NULL AS run_end, NULL AS fl, NULL AS idn, NULL AS g FROM v0),
{_sql_stability('sm', KEYS, ['px', 'py'], ['px_ma', 'py_ma'])} SELECT {_STAB_OUT} FROM so""",
)
def f11(spark, sf):
    views = T.pose2d(spark, sf).withColumn("session_id", F.concat_ws("/", "session_id", "camera_id"))
    views = views.select("session_id", "joint_idx", "sample_idx", "px", "py")
    views = E.centered_mean(views, KEYS, "sample_idx", ["px", "py"], 5)
    return _stab_rounded(stability(views, KEYS, "session_id", "sample_idx", ["px", "py"], ["px_ma", "py_ma"]))


_CANDIDATES = (3, 5, 7, 9)


@query(
    "f12_window_sweep",
    f"""WITH {T.SQL_LONG}, sw AS ({' UNION ALL '.join(f"SELECT {w} AS win, session_id, joint_idx, sample_idx, x, {', '.join(f'avg({c}) OVER (PARTITION BY session_id, joint_idx ORDER BY sample_idx ROWS BETWEEN {w // 2} PRECEDING AND {w // 2} FOLLOWING) - {c} AS d{c}' for c in 'xyz')} FROM p3" for w in _CANDIDATES)})
SELECT CAST(win AS INTEGER) AS window_size, session_id, {r6('median(sqrt(dx * dx + dy * dy + dz * dz))')} AS median_adjustment FROM sw WHERE x IS NOT NULL GROUP BY ALL""",
)
def f12(spark, sf):
    """All candidate windows in one job: one halo pass carries every width."""
    from ..operators.blocks import with_halo

    def build(w):
        near = {n: w.rangeBetween(-(n // 2), n // 2) for n in _CANDIDATES}
        return {
            f"m{n}": G.norm([F.avg(c).over(near[n]) - F.col(c) for c in "xyz"]) for n in _CANDIDATES
        }

    r = max(_CANDIDATES) // 2
    swept = with_halo(T.pose3d(spark, sf), KEYS, "sample_idx", r, r, build)
    tall = swept.select("session_id", F.expr(f"stack({len(_CANDIDATES)}, {', '.join(f'{n}, m{n}' for n in _CANDIDATES)}) AS (window_size, v)"))
    q = exact_quantiles(tall, ["window_size", "session_id"], F.col("v"), {"m": 0.5})
    return q.select("window_size", "session_id", fixed("m").alias("median_adjustment"))


@query(
    "f13_worst_joints",
    f"""WITH {T.SQL_LONG}, m AS (SELECT *, {', '.join(f'avg({c}) OVER (PARTITION BY session_id, joint_idx ORDER BY sample_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) - {c} AS d{c}' for c in 'xyz')} FROM p3),
j AS (SELECT session_id, joint_idx, median(sqrt(dx * dx + dy * dy + dz * dz)) AS adj FROM m WHERE x IS NOT NULL GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY floor(adj * 1e9 + 0.5) DESC, joint_idx) AS rk FROM j)
SELECT session_id, joint_idx, CAST(rk AS INTEGER) AS rank, {r6('adj')} AS median_adjustment FROM k""",
)
def f13(spark, sf):
    from pyspark.sql import Window

    moved = E.centered_mean(T.pose3d(spark, sf), KEYS, "sample_idx", "xyz", 5)
    moved = moved.withColumn("adj", G.distance([F.col(f"{c}_ma") for c in "xyz"], [F.col(c) for c in "xyz"]))
    q = exact_quantiles(moved, KEYS, F.col("adj"), {"adj": 0.5})
    # at most one row per joint reaches this window; every joint gets its rank, the reader takes the first k
    w = Window.partitionBy("session_id").orderBy(F.floor(F.col("adj") * 1e9 + 0.5).desc(), "joint_idx")
    return q.withColumn("rank", F.row_number().over(w)).select(
        "session_id", "joint_idx", "rank", fixed("adj").alias("median_adjustment")
    )


@query(
    "f14_run_quality_gate",
    f"""WITH {T.SQL_LONG}, a AS (SELECT session_id, avg(CASE WHEN x IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS br, avg(reproj_px) AS me,
 avg(CASE WHEN x IS NOT NULL AND used_cameras >= 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS ob, avg(CASE WHEN x IS NOT NULL AND used_cameras < 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS rc,
 CASE WHEN session_id % 3 = 0 THEN 'synthetic' ELSE 'measured' END AS mode FROM p3 GROUP BY ALL)
SELECT session_id, mode AS calibration_mode, {r6('br')} AS mean_body_valid_ratio, {r6('me')} AS mean_error_px, {r6('ob')} AS observed_ratio, {r6('rc')} AS recovered_ratio,
 coalesce(mode = 'measured' AND br >= 0.90 AND me <= 12.0, FALSE) AS passed FROM a""",
)
def f14(spark, sf):
    seen = F.col("x").isNotNull()
    one = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    out = T.pose3d(spark, sf).groupBy("session_id").agg(
        one(seen).alias("mean_body_valid_ratio"), F.avg("reproj_px").alias("mean_error_px"),
        one(seen & (F.col("used_cameras") >= 2)).alias("observed_ratio"), one(seen & (F.col("used_cameras") < 2)).alias("recovered_ratio"),
    )
    out = out.withColumn("calibration_mode", F.when(F.col("session_id") % 3 == 0, "synthetic").otherwise("measured"))
    passed = run_quality_gate(F.col("calibration_mode"), F.col("mean_body_valid_ratio"), F.col("mean_error_px"), 12.0)
    out = out.withColumn("passed", passed)
    return out.withColumns({c: fixed(c) for c in ("mean_body_valid_ratio", "mean_error_px", "observed_ratio", "recovered_ratio")})


def run_quality_gate(mode, ratio, error, max_error: float, min_ratio: float = 0.90, accepted=("measured",)):
    return F.coalesce(mode.isin(*accepted) & (ratio >= min_ratio) & (error <= max_error), F.lit(False))


@query(
    "f15_sensor_consistency",
    f"""WITH {T.SQL_LONG}, a AS (SELECT session_id, sample_idx, avg(reproj_px) <= 15 AS geo, sample_idx % 2 = 0 AS applied,
 CASE WHEN sample_idx % 5 = 0 THEN NULL ELSE max(used_cameras) >= 3 END AS passed, sample_idx % 7 <> 0 AS used FROM p3 GROUP BY session_id, sample_idx)
SELECT session_id, sample_idx, CASE WHEN coalesce(geo, FALSE) AND (NOT applied OR (coalesce(passed, FALSE) AND used)) THEN 'passed' ELSE 'failed' END AS status FROM a""",
)
def f15(spark, sf):
    a = T.pose3d(spark, sf).groupBy("session_id", "sample_idx").agg(
        (F.avg("reproj_px") <= 15).alias("geo"), (F.max("used_cameras") >= 3).alias("cam")
    )
    status = Q.sensor_consistency(
        F.col("geo"), F.col("sample_idx") % 2 == 0, F.when(F.col("sample_idx") % 5 != 0, F.col("cam")), F.col("sample_idx") % 7 != 0
    )
    return a.select("session_id", "sample_idx", status.alias("status"))


@query(
    "f16_distribution_summary",
    f"""SELECT event_type, count(value) AS value_count, {r6('avg(value)')} AS value_mean, {r6('median(value)')} AS value_median,
 {r6('quantile_cont(value, 0.95)')} AS value_p95, {r6('max(value)')} AS value_max FROM events GROUP BY ALL""",
)
def f16(spark, sf):
    return distribution_summary(T.read(spark, sf, "events"), ["event_type"], F.col("value"), "value_").withColumns(
        {c: fixed(c) for c in ("value_mean", "value_median", "value_p95", "value_max")}
    )


def distribution_summary(df, keys, value, prefix=""):
    """count / mean / median / p95 / max per key, for groups of any size."""
    plain = df.groupBy(*keys).agg(
        F.count(value).alias(f"{prefix}count"), F.avg(value).alias(f"{prefix}mean"), F.max(value).alias(f"{prefix}max")
    )
    q = exact_quantiles(df, keys, value, {f"{prefix}median": 0.5, f"{prefix}p95": 0.95})
    return plain.join(q, list(keys), "left")
