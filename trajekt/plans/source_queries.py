"""A: scans, sinks, registry and contract checks on data derived from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.numeric import count_where, finite, fixed, reasons
from ..functions.skeleton import BODY_JOINTS
from ..operators.rules import violations
from ..session import ensure_checkpoint_dir
from ..sources import scans, sinks, store
from . import tables as T
from .alignment_queries import SQL_NEAR, click_to_view
from .geometry_queries import _R
from .registry import query

r6 = T.r6


def scratch(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/trajekt-{name}-{uuid.uuid4().hex}"


def pose_document_files(spark, sf) -> str:
    """Frames as JSON documents of at most 64 frames, some of them without a declared coordinate system."""
    f = T.sequence_frames(spark, sf)
    frame = F.transform("pts", lambda p: F.array(p["x"], p["y"], p["z"]))
    entry = F.struct(F.col("sample_idx").alias("i"), F.col("t_sec").alias("t"), frame.alias("p"))
    docs = f.groupBy("session_id", F.floor(F.col("sample_idx") / 64).alias("part")).agg(
        F.array_sort(F.collect_list(entry), lambda a, b: (a["i"] - b["i"]).cast("int")).alias("f")
    )
    docs = docs.select(
        F.col("session_id").cast("string").alias("session_id"), F.when(F.col("session_id") % 5 != 3, scans.ANALYSIS).alias("coordinate_system"),
        F.array(*map(F.lit, BODY_JOINTS)).alias("joint_names"), F.transform("f", lambda e: e["i"]).alias("frame_indices"), F.transform("f", lambda e: e["t"]).alias("timestamps_sec"),
        F.lit(T.FPS).alias("sample_fps"), F.transform("f", lambda e: e["p"]).alias("points"),
    )
    path = scratch(spark, "poses")
    docs.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    return path


_NAMES = "[" + ", ".join(f"'{n}'" for n in BODY_JOINTS) + "]"


@query(
    "a1_pose_document_scan",
    f"""WITH {T.SQL_LONG} SELECT CAST(session_id AS VARCHAR) AS session_id, sample_idx AS frame_idx, {r6('t_sec')} AS t_sec, joint_idx, {_NAMES}[joint_idx + 1] AS joint_name, {r6('x')} AS x, {r6('y')} AS y, {r6('z')} AS z FROM p3 WHERE session_id % 5 <> 3""",
)
def a1(spark, sf):
    rows, _ = scans.pose_documents(spark, pose_document_files(spark, sf))
    return rows.select("session_id", "frame_idx", fixed("t_sec").alias("t_sec"), "joint_idx", "joint_name", *[fixed(c).alias(c) for c in "xyz"])


@query("a1_quarantined_documents", f"WITH {T.SQL_FRAMES} SELECT DISTINCT CAST(session_id AS VARCHAR) AS session_id, ['coordinate_system_not_declared'] AS reasons FROM fr WHERE session_id % 5 = 3")
def a1q(spark, sf):
    return scans.pose_documents(spark, pose_document_files(spark, sf))[1].distinct()


@query(
    "a2_flat_keypoint_scan",
    f"""WITH {T.SQL_VIEWS} SELECT CAST(session_id AS VARCHAR) AS session_id, sample_idx AS frame_idx, camera_id, CAST(CASE WHEN joint_idx % 3 = 0 THEN 0 ELSE 1 END AS INTEGER) AS person_id, joint_idx, {r6('px')} AS x, {r6('py')} AS y, {r6('score')} AS score, px IS NOT NULL AS valid FROM p2""",
)
def a2(spark, sf):
    v = T.pose2d(spark, sf).select(
        F.col("session_id").cast("string").alias("session_id"), F.col("sample_idx").alias("frame_idx"), "camera_id", F.when(F.col("joint_idx") % 3 != 0, 1).alias("person_id"), "joint_idx",
        F.col("px").alias("x"), F.col("py").alias("y"), "score", F.col("px").isNotNull().alias("valid"),
    )
    path = scratch(spark, "flat2d")
    v.write.option("header", True).csv(path)
    return scans.flat_keypoints_2d(spark, path).withColumns({c: fixed(c) for c in ("x", "y", "score")})


@query(
    "a3_selective_observation_scan",
    f"""WITH {T.SQL_VIEWS}, ac AS (SELECT DISTINCT session_id, sample_idx, joint_idx FROM p3 WHERE reproj_px > 18) SELECT session_id, sample_idx, joint_idx, camera_id, {r6('px')} AS px FROM p2 WHERE px IS NOT NULL AND score >= 0.4 AND (session_id, sample_idx, joint_idx) IN (SELECT (session_id, sample_idx, joint_idx) FROM ac)""",
)
def a3(spark, sf):
    active = T.pose3d(spark, sf).where("reproj_px > 18")
    views = T.pose2d(spark, sf).withColumn("valid", F.col("score") >= 0.4)
    return scans.selected_observations(views, active, ["session_id", "sample_idx", "joint_idx"]).select("session_id", "sample_idx", "joint_idx", "camera_id", fixed("px").alias("px"))


@query(
    "a4_flat_3d_scan_dense",
    f"""WITH {T.SQL_LONG} SELECT CAST(session_id AS VARCHAR) AS session_id, sample_idx AS frame_idx, joint_idx, {r6('x')} AS x, {r6('y')} AS y, {r6('z')} AS z FROM p3""",
)
def a4(spark, sf):
    rows = T.pose3d(spark, sf).where("x IS NOT NULL").select(
        F.col("session_id").cast("string").alias("session_id"), F.col("sample_idx").alias("frame_idx"), "joint_idx", *[F.col(c).alias(f"{c}_m") for c in "xyz"], F.col("t_sec").alias("timestamp_sec")
    )
    path = scratch(spark, "flat3d")
    sinks.write_long(rows, path)
    return scans.flat_keypoints_3d(spark, path, T.JOINTS, "parquet").select("session_id", "frame_idx", "joint_idx", *[fixed(c).alias(c) for c in "xyz"])


SQL_BUNDLE = """cb AS (SELECT s_suppkey AS camera_id, s_nationkey AS session_id, CASE WHEN s_suppkey % 11 = 0 THEN 0 ELSE 1280 END AS width, CASE WHEN s_suppkey % 13 = 0 THEN 8 ELSE 9 END AS kn, CASE WHEN s_suppkey % 7 = 0 THEN 0.0::DOUBLE ELSE s_acctbal END AS f, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE abs(s_acctbal) / 10000 END AS rms FROM supplier)"""


def bundle(spark, sf):
    key = F.col("s_suppkey")
    f = F.when(key % 7 == 0, 0.0).otherwise(F.col("s_acctbal"))
    k = F.array(f, F.lit(0.0), F.lit(640.0), F.lit(0.0), f, F.lit(360.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    zeros = lambda n: F.array(*[F.lit(0.0)] * n)
    return T.read(spark, sf, "supplier").select(
        key.alias("camera_id"), F.col("s_nationkey").alias("session_id"), F.when(key % 11 == 0, 0).otherwise(1280).alias("width"), F.lit(720).alias("height"),
        F.when(key % 13 == 0, F.slice(k, 1, 8)).otherwise(k).alias("k"), zeros(3).alias("rvec"), zeros(3).alias("tvec"), zeros(12).alias("p"), F.when(key % 5 != 0, F.abs("s_acctbal") / 10000).alias("rms"),
    )


@query(
    "a5_calibration_checks",
    f"""WITH {SQL_BUNDLE} SELECT camera_id, 'intrinsics_shape' AS violation FROM cb WHERE kn <> 9 UNION ALL SELECT camera_id, 'image_size' FROM cb WHERE width <= 0 UNION ALL SELECT camera_id, 'singular_intrinsics' FROM cb WHERE kn = 9 AND abs(f * f) < 1e-12""",
)
def a5(spark, sf):
    b = bundle(spark, sf)
    return violations(b, ["camera_id"], scans.calibration_problems(b))


@query("a6_calibration_report", f"WITH {SQL_BUNDLE} SELECT session_id, count(*) AS camera_count, {r6('avg(rms)')} AS mean_rms FROM cb GROUP BY ALL")
def a6(spark, sf):
    return bundle(spark, sf).groupBy("session_id").agg(F.count(F.lit(1)).alias("camera_count"), fixed(F.avg("rms")).alias("mean_rms"))


@query(
    "a7_camera_setting_lookup",
    """WITH m AS (SELECT 'seq' || o_orderkey AS sequence, 'setting' || o_custkey % 30 AS setting FROM orders WHERE o_orderkey % 4 <> 0), s AS (SELECT DISTINCT 'setting' || s_nationkey AS setting, s_nationkey FROM supplier)
SELECT 'seq' || o_orderkey AS sequence, m.setting, s.s_nationkey AS camera_group, CASE WHEN m.setting IS NULL THEN 'sequence_not_mapped' WHEN s.setting IS NULL THEN 'setting_missing' ELSE 'found' END AS verdict FROM orders LEFT JOIN m ON m.sequence = 'seq' || o_orderkey LEFT JOIN s ON s.setting = m.setting""",
)
def a7(spark, sf):
    orders = T.read(spark, sf, "orders").select(F.concat(F.lit("seq"), F.col("o_orderkey").cast("string")).alias("sequence"), "o_orderkey", "o_custkey")
    lines = orders.where("o_orderkey % 4 <> 0").select(F.concat_ws(" ", "sequence", F.concat(F.lit("setting"), (F.col("o_custkey") % 30).cast("string"))).alias("value"))
    path = scratch(spark, "mapping")
    lines.write.text(path)
    known = T.read(spark, sf, "supplier").select(F.concat(F.lit("setting"), F.col("s_nationkey").cast("string")).alias("setting"), F.col("s_nationkey").alias("camera_group")).distinct()
    rows = orders.select("sequence").join(scans.mapping_lines(spark, path), "sequence", "left").join(known, "setting", "left")
    verdict = F.when(F.col("setting").isNull(), "sequence_not_mapped").when(F.col("camera_group").isNull(), "setting_missing").otherwise("found")
    return rows.select("sequence", "setting", "camera_group", verdict.alias("verdict"))


# a setting's cameras: rotation vector, translation and a camera that lacks a number, as text valid in both engines
_RX, _RY, _RZ = "(n * CAST(0.02 AS DOUBLE))", "(c * CAST(0.3 AS DOUBLE) - CAST(0.4 AS DOUBLE))", "((n + c) % 5 * CAST(0.1 AS DOUBLE) + CAST(0.01 AS DOUBLE))"
_TX, _TY, _TZ = "(c * CAST(0.25 AS DOUBLE))", "(n * CAST(0.125 AS DOUBLE))", "CAST(4 AS DOUBLE)"
_POSE = [_R[0], _R[1], _R[2], "tx", _R[3], _R[4], _R[5], "ty", _R[6], _R[7], _R[8], "tz"]
_P = [f"1000.0 * ({_POSE[j]}) + 640.0 * ({_POSE[8 + j]})" for j in range(4)] + [f"1000.0 * ({_POSE[4 + j]}) + 360.0 * ({_POSE[8 + j]})" for j in range(4)] + [_POSE[8 + j] for j in range(4)]


@query(
    "a7_setting_import",
    f"""WITH s AS (SELECT DISTINCT s_nationkey AS n, 'setting' || s_nationkey AS setting FROM supplier), cm AS (SELECT setting, n, c, 'c' || c AS camera_id, {_RX} AS rx, {_RY} AS ry, {_RZ} AS rz, {_TX} AS tx, {_TY} AS ty, {_TZ} AS tz FROM s, unnest(range(0, 3 + n % 2)) u(c)),
pr AS (SELECT *, sqrt(rx * rx + ry * ry + rz * rz) AS th FROM cm), pm AS (SELECT setting, camera_id, {', '.join(f'{r6(t, 4)} AS p{i}' for i, t in enumerate(_P))} FROM pr WHERE (n + c) % 7 <> 6),
w AS (SELECT DISTINCT 'setting' || n_nationkey % 30 AS setting, 'c' || j AS camera_id FROM (SELECT n_nationkey FROM nation UNION SELECT n_nationkey + 25 FROM nation WHERE n_nationkey < 5), unnest([0, 2, 3]) u(j))
SELECT w.setting, w.camera_id, CASE WHEN w.setting NOT IN (SELECT setting FROM s) THEN 'setting_missing' WHEN p0 IS NULL THEN 'camera_missing' ELSE 'found' END AS verdict, {', '.join(f'p{i}' for i in range(12))} FROM w LEFT JOIN pm USING (setting, camera_id)""",
)
def a7s(spark, sf):
    """Setting files, a JSON array of cameras each, read into calibrations; asked for three cameras of thirty settings, some of which are not there."""
    base = T.read(spark, sf, "supplier").select(F.col("s_nationkey").alias("n")).distinct().withColumn("c", F.explode(F.expr("sequence(0, CAST(2 + n % 2 AS INT))")))
    number = lambda *texts: F.array(*[F.expr(t) for t in texts])
    matrix = F.array(*[F.array(*map(F.lit, T.intrinsics()[3 * i : 3 * i + 3])) for i in range(3)])
    camera = F.struct(
        F.concat(F.lit("c"), F.col("c").cast("string")).alias("name"), F.array(F.lit(1280), F.lit(720)).alias("size"), matrix.alias("matrix"), F.array(*[F.lit(0.0)] * 5).alias("distortions"),
        number(_RX, _RY, _RZ).alias("rotation"), F.when((F.col("n") + F.col("c")) % 7 == 6, number(_TX, _TY)).otherwise(number(_TX, _TY, _TZ)).alias("translation"),
    )
    files = base.groupBy(F.concat(F.lit("setting"), F.col("n").cast("string")).alias("setting")).agg(F.to_json(F.collect_list(camera)).alias("value"))
    path = scratch(spark, "settings")
    files.repartition("setting").write.partitionBy("setting").text(path)
    nation = T.read(spark, sf, "nation").select(F.col("n_nationkey").alias("n"))
    asked = nation.union(nation.where("n < 5").select(F.col("n") + 25)).select(F.concat(F.lit("setting"), (F.col("n") % 30).cast("string")).alias("setting"), F.explode(F.array(*[F.lit(f"c{j}") for j in (0, 2, 3)])).alias("camera_id")).distinct()
    rows = scans.selected_cameras(scans.setting_cameras(spark, path), asked)
    return rows.select("setting", "camera_id", "verdict", *[fixed(F.get("p", F.lit(i)), 4).alias(f"p{i}") for i in range(12)])


_FILE = r"^([A-Z]+)_(\d+)_C(\d)\.avi$"
SQL_FILES = """fl AS (SELECT p_type || '_' || p_partkey // 4 || CASE WHEN p_partkey % 17 = 0 THEN '_X' ELSE '_C' || p_partkey % 4 END || '.avi' AS name, p_size * 1000 AS length FROM part),
ps AS (SELECT name, length, regexp_extract(name, '^([A-Z]+)_(\\d+)_C(\\d)\\.avi$', 1) AS action, regexp_extract(name, '^([A-Z]+)_(\\d+)_C(\\d)\\.avi$', 2) AS seq, regexp_extract(name, '^([A-Z]+)_(\\d+)_C(\\d)\\.avi$', 3) AS cam FROM fl WHERE regexp_matches(name, '^([A-Z]+)_(\\d+)_C(\\d)\\.avi$'))"""


def named_files(spark, sf):
    tail = F.when(F.col("p_partkey") % 17 == 0, F.lit("_X")).otherwise(F.concat(F.lit("_C"), (F.col("p_partkey") % 4).cast("string")))
    name = F.concat(F.col("p_type"), F.lit("_"), F.floor(F.col("p_partkey") / 4).cast("string"), tail, F.lit(".avi"))
    return T.read(spark, sf, "part").select(name.alias("name"), (F.col("p_size") * 1000).alias("length"))


@query("a8_dataset_discovery", f"WITH {SQL_FILES} SELECT action, seq AS sequence, count(*) AS camera_count, list_sort(list(cam || '=' || name)) AS cameras, seq::INT % 10 = 0 AS ground_truth_missing FROM ps GROUP BY ALL")
def a8(spark, sf):
    parsed = scans.parse_names(named_files(spark, sf), "name", _FILE, ["action", "sequence", "cam"])
    truth = parsed.where(F.col("sequence").cast("int") % 10 != 0).select("action", "sequence").distinct().withColumn("gt", F.lit(True))
    found = parsed.groupBy("action", "sequence").agg(F.count(F.lit(1)).alias("camera_count"), F.array_sort(F.collect_list(F.concat_ws("=", "cam", "name"))).alias("cameras"))  # a rig's cameras
    return found.join(truth, ["action", "sequence"], "left").select("action", "sequence", "camera_count", "cameras", F.col("gt").isNull().alias("ground_truth_missing"))


@query(
    "a9_dataset_index_report",
    f"""WITH {T.SQL_LONG}, f AS (SELECT session_id, sample_idx, count(x) = 17 AS whole FROM p3 GROUP BY ALL), h AS (SELECT session_id, min(sha256(CAST(vec_id AS VARCHAR))) AS first_hash, count(DISTINCT vec_id) AS n FROM p3 GROUP BY ALL)
SELECT session_id, count(*) AS frame_count, 17 AS joint_count, count(*) FILTER (WHERE whole) AS fully_valid_frames, count(*) FILTER (WHERE NOT whole) AS invalid_frames, any_value(first_hash) AS first_hash FROM f JOIN h USING (session_id) GROUP BY ALL""",
)
def a9(spark, sf):
    f = T.frames(spark, sf)
    whole = F.forall("pts", lambda p: p.isNotNull())
    return f.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("frame_count"), F.max(F.size("pts")).alias("joint_count"), count_where(whole).alias("fully_valid_frames"), count_where(~whole).alias("invalid_frames"),
        F.min(F.sha2(F.col("vec_id").cast("string"), 256)).alias("first_hash"),
    )


@query(
    "a10_session_document_checks",
    """WITH s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 9 = 0 THEN '-bad id' ELSE 's' || s_suppkey END AS session_id, CASE WHEN s_suppkey % 6 = 0 THEN 1.5 ELSE 3.0 END AS off, CASE WHEN s_suppkey % 8 = 0 THEN 0.0 ELSE 30.0 END AS fps FROM supplier)
SELECT session_id, 'a' AS camera_id, 'unsafe_session_id' AS violation FROM s WHERE s_suppkey % 9 = 0 UNION ALL SELECT session_id, 'b', 'unsafe_session_id' FROM s WHERE s_suppkey % 9 = 0 UNION ALL SELECT session_id, 'b', 'fractional_frame_offset' FROM s WHERE s_suppkey % 6 = 0
UNION ALL SELECT session_id, 'a', 'nonpositive_fps' FROM s WHERE s_suppkey % 8 = 0 UNION ALL SELECT session_id, 'b', 'nonpositive_fps' FROM s WHERE s_suppkey % 8 = 0
UNION ALL SELECT session_id, 'z', 'unsafe_session_id' FROM s WHERE s_suppkey % 10 = 0 AND s_suppkey % 9 = 0 UNION ALL SELECT session_id, 'z', 'nonpositive_fps' FROM s WHERE s_suppkey % 10 = 0 AND s_suppkey % 8 = 0 UNION ALL SELECT session_id, 'z', 'document_error' FROM s WHERE s_suppkey % 10 = 0""",
)
def a10(spark, sf):
    key = F.col("s_suppkey")
    text = F.format_string(
        "session_id: '%s'\nfps: %s\ncameras:\n  - camera_id: a\n  - camera_id: b\nsync:\n  frame_offsets:\n    b: %s\n%s",
        F.when(key % 9 == 0, F.lit("-bad id")).otherwise(F.concat(F.lit("s"), key.cast("string"))), F.when(key % 8 == 0, "0.0").otherwise("30.0"),
        F.when(key % 6 == 0, "1.5").otherwise("3"), F.when(key % 10 == 0, "    z: 1\n").otherwise(""),
    )
    docs = T.read(spark, sf, "supplier").select(text.alias("value"), key.cast("string").alias("doc"))
    path = scratch(spark, "sessions")
    store.store_documents(docs, path, "doc", "value")
    rows = scans.parsed_sessions(store.stored(spark, path).select(F.col("name").alias("path"), F.col("content").alias("value")))
    return violations(rows, ["session_id", "camera_id"], scans.session_problems())


@query(
    "a11_video_probe_summary",
    """SELECT s_nationkey AS session_id, count(*) FILTER (WHERE s_suppkey % 5 <> 0) AS opened, bool_and(s_suppkey % 5 <> 0) AS all_opened, min(CASE WHEN s_suppkey % 5 <> 0 THEN CAST(25 + s_suppkey % 3 AS DOUBLE) END) AS min_fps,
 max(CASE WHEN s_suppkey % 5 <> 0 THEN CAST(25 + s_suppkey % 3 AS DOUBLE) END) AS max_fps, min(CASE WHEN s_suppkey % 5 <> 0 THEN 100 + s_suppkey END) AS min_frames, max(CASE WHEN s_suppkey % 5 <> 0 THEN 100 + s_suppkey END) AS max_frames FROM supplier GROUP BY ALL""",
)
def a11(spark, sf):
    key = F.col("s_suppkey")
    ok = key % 5 != 0
    fps, frames = F.when(ok, (25 + key % 3).cast("double")), F.when(ok, 100 + key)
    return T.read(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("session_id")).agg(
        count_where(ok).alias("opened"), F.min(ok).alias("all_opened"), F.min(fps).alias("min_fps"), F.max(fps).alias("max_fps"), F.min(frames).alias("min_frames"), F.max(frames).alias("max_frames")
    )


SQL_ISSUES = """c AS (SELECT s_nationkey AS session_id, 'cam' || s_suppkey % 6 AS camera_id, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE '/v/' || s_suppkey END AS path FROM supplier),
i AS (SELECT session_id, NULL::VARCHAR AS camera_id, 'too_few_cameras' AS code, 'error' AS severity FROM c GROUP BY session_id HAVING count(*) < 3
UNION ALL SELECT session_id, camera_id, 'duplicate_camera', 'error' FROM c GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT session_id, camera_id, 'missing_path', CASE WHEN session_id % 2 = 0 THEN 'error' ELSE 'warning' END FROM c WHERE path IS NULL)"""


def issues(spark, sf):
    key = F.col("s_suppkey")
    c = T.read(spark, sf, "supplier").select(F.col("s_nationkey").alias("session_id"), F.concat(F.lit("cam"), (key % 6).cast("string")).alias("camera_id"), (key % 7 == 0).alias("gone"))
    few = c.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).where("n < 3").select("session_id", F.lit(None).cast("string").alias("camera_id"), F.lit("too_few_cameras").alias("code"), F.lit("error").alias("severity"))
    twice = c.groupBy("session_id", "camera_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("session_id", "camera_id", F.lit("duplicate_camera").alias("code"), F.lit("error").alias("severity"))
    gone = c.where("gone").select("session_id", "camera_id", F.lit("missing_path").alias("code"), F.when(F.col("session_id") % 2 == 0, "error").otherwise("warning").alias("severity"))
    return few.unionByName(twice).unionByName(gone)


@query("a12_preflight_issues", f"WITH {SQL_ISSUES} SELECT * FROM i")
def a12(spark, sf):
    return issues(spark, sf)


@query("a12_preflight_summary", f"WITH {SQL_ISSUES} SELECT session_id, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings, count(*) FILTER (WHERE severity = 'error') > 0 AS has_errors FROM i GROUP BY ALL")
def a12s(spark, sf):
    n = count_where(F.col("severity") == "error")
    return issues(spark, sf).groupBy("session_id").agg(n.alias("errors"), count_where(F.col("severity") == "warning").alias("warnings"), (n > 0).alias("has_errors"))


@query("a13_long_table_round_trip", f"WITH {T.SQL_LONG} SELECT session_id, sample_idx, joint_idx, {r6('x')} AS x, {r6('reproj_px')} AS reproj_px FROM p3")
def a13(spark, sf):
    rows = T.pose3d(spark, sf).withColumn("reproj_px", F.coalesce("reproj_px", F.lit(float("nan"))))
    path = scratch(spark, "export")
    sinks.write_long(rows, path)
    back = spark.read.schema(rows.schema).parquet(path)
    return back.select("session_id", "sample_idx", "joint_idx", fixed("x").alias("x"), fixed("reproj_px").alias("reproj_px"))


@query(
    "a14_report_document",
    """SELECT c_custkey, '{"c_custkey":' || c_custkey || ',"c_nationkey":' || c_nationkey || ',"mean":' || CASE WHEN c_custkey % 3 = 0 THEN 'null' ELSE CAST(c_nationkey * 2 AS VARCHAR) END || '}' AS document FROM customer""",
)
def a14(spark, sf):
    rows = T.read(spark, sf, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey") * 2).alias("mean"))
    return sinks.report_document(rows, ["c_custkey"])


@query(
    "a15_run_registry_latest",
    """WITH r AS (SELECT o_custkey AS session_id, 'run-' || o_orderkey AS run_id, CASE WHEN o_orderstatus = 'F' THEN 'passed' ELSE 'failed' END AS status, o_orderdate AS completed_at, o_orderkey FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY completed_at DESC, run_id DESC) AS rk FROM r WHERE status = 'passed') SELECT session_id, run_id, completed_at FROM k WHERE rk = 1""",
)
def a15(spark, sf):
    registry = T.read(spark, sf, "orders").select(
        F.col("o_custkey").alias("session_id"), F.concat(F.lit("run-"), F.col("o_orderkey").cast("string")).alias("run_id"), F.when(F.col("o_orderstatus") == "F", "passed").otherwise("failed").alias("status"), F.col("o_orderdate").alias("completed_at")
    )
    path = scratch(spark, "registry")
    sinks.register_run(spark, path, registry)
    return sinks.latest_runs(spark.read.schema(registry.schema).parquet(path), "session_id")


@query(
    "a16_artifact_manifest",
    """WITH n AS (SELECT label AS session_id, count(*) AS frames FROM embeddings GROUP BY ALL), f AS (SELECT CAST(session_id AS VARCHAR) AS name, '{"session_id":' || session_id || ',"frames":' || frames || '}' AS c FROM n)
SELECT CAST(session_id + 2 AS VARCHAR) AS name, length(c) AS size, sha256(c) AS sha256, c IS NOT NULL AS present FROM n LEFT JOIN f ON f.name = CAST(session_id + 2 AS VARCHAR)""",
)
def a16(spark, sf):
    """Session reports kept in a document store; the manifest lists expected names with size and hash from the store's index."""
    n = T.frames(spark, sf).groupBy("session_id").agg(F.count(F.lit(1)).alias("frames"))
    path = scratch(spark, "artifacts")
    store.store_documents(n.select(F.to_json(F.struct("session_id", "frames")).alias("content"), F.col("session_id").cast("string").alias("name")), path)
    expected = n.select((F.col("session_id") + 2).cast("string").alias("name"))
    return sinks.manifest(expected, store.index(spark, path).drop("container"))


@query(
    "a17_fingerprint_binding",
    """WITH d AS (SELECT doc_id, sha256(text) AS h, n_chars AS size FROM documents), c AS (SELECT doc_id, sha256(CASE WHEN doc_id % 12 = 0 THEN text || '!' ELSE text END) AS h, CASE WHEN doc_id % 20 = 0 THEN NULL ELSE n_chars END AS size FROM documents WHERE doc_id % 15 <> 0)
SELECT d.doc_id, CASE WHEN c.doc_id IS NULL THEN 'missing' WHEN d.h IS DISTINCT FROM c.h OR d.size IS DISTINCT FROM c.size THEN 'changed' ELSE 'bound' END AS binding FROM d LEFT JOIN c USING (doc_id)""",
)
def a17(spark, sf):
    docs = T.read(spark, sf, "documents").select("doc_id", "text", "n_chars")
    declared = docs.select("doc_id", F.sha2("text", 256).alias("h"), F.col("n_chars").alias("size"))
    n = F.col("doc_id")
    current = docs.where(n % 15 != 0).select("doc_id", F.sha2(F.when(n % 12 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("h"), F.when(n % 20 != 0, F.col("n_chars")).alias("size"))
    return sinks.bindings_changed(declared, current, "doc_id", ["h", "size"])


@query(
    "a18_recording_ingest_report",
    f"""WITH {T.SQL_SERIES}, {SQL_NEAR}, s AS (SELECT user_id, event_type, count(*) AS n, min(t_us) AS a, max(t_us) AS z FROM ev GROUP BY ALL), q AS (SELECT user_id, count(*) AS stream_count, CAST(sum(n) AS BIGINT) AS sample_count, max(a) AS common_start_us, min(z) AS common_end_us, min(n * 1e6 / nullif(z - a, 0)) AS slow FROM s GROUP BY ALL),
m AS (SELECT user_id, max(abs(src_t - t_us)) AS worst_us FROM nm GROUP BY ALL) SELECT user_id, stream_count, sample_count, common_start_us, common_end_us, {r6('slow', 9)} AS slowest_rate, worst_us, slow >= 1e-6 AS output_rate_ok FROM q LEFT JOIN m USING (user_id)""",
)
def a18(spark, sf):
    e = T.read(spark, sf, "events").select("user_id", "event_type", T.micros("ts").alias("t_us"))
    s = e.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("t_us").alias("a"), F.max("t_us").alias("z"))
    rate = F.col("n") * 1e6 / F.when(F.col("z") > F.col("a"), F.col("z") - F.col("a"))
    q = s.groupBy("user_id").agg(F.count(F.lit(1)).alias("stream_count"), F.sum("n").alias("sample_count"), F.max("a").alias("common_start_us"), F.min("z").alias("common_end_us"), F.min(rate).alias("slow"))
    near, _ = click_to_view(spark, sf)
    worst = near.where("near IS NOT NULL").groupBy("user_id").agg(F.max(F.abs(F.col("near.t_us") - F.col("t_us"))).alias("worst_us"))
    return q.join(worst, "user_id", "left").select("user_id", "stream_count", "sample_count", "common_start_us", "common_end_us", fixed("slow", 9).alias("slowest_rate"), "worst_us", (F.col("slow") >= 1e-6).alias("output_rate_ok"))


@query(
    "a19_session_generation",
    f"""WITH {SQL_FILES}, g AS (SELECT action, seq, count(*) AS cams, count(DISTINCT length % 3) AS rates, min(name) AS nm FROM ps GROUP BY ALL) SELECT action || '_' || seq AS session_id, cams AS camera_count, regexp_replace(nm, '_C\\d', '_cAll') AS pattern FROM g WHERE rates = 1 AND cams >= 2""",
)
def a19(spark, sf):
    parsed = scans.parse_names(named_files(spark, sf), "name", _FILE, ["action", "sequence", "cam"])
    g = parsed.groupBy("action", "sequence").agg(F.count(F.lit(1)).alias("camera_count"), F.countDistinct(F.col("length") % 3).alias("rates"), F.min("name").alias("nm"))
    return g.where("rates = 1 AND camera_count >= 2").select(F.concat_ws("_", "action", "sequence").alias("session_id"), "camera_count", F.regexp_replace("nm", r"_C\d", "_cAll").alias("pattern"))


@query(
    "a20_ground_truth_export",
    f"""WITH {T.SQL_LONG} SELECT session_id, sample_idx, {_NAMES}[joint_idx + 1] AS joint_name, {r6('sample_idx / 60.0::DOUBLE')} AS t_sec, {r6('x * 1000 * 0.001')} AS x_m, {r6('z * 1000 * -0.001')} AS y_m, {r6('y * 1000 * 0.001')} AS z_m FROM p3 WHERE x IS NOT NULL""",
)
def a20(spark, sf):
    from ..functions import geometry as G
    from .geometry_queries import PRESET_BASES

    mm = T.pose3d(spark, sf).where("x IS NOT NULL")
    moved = G.transform(tuple(F.col(c) * 1000 for c in "xyz"), [F.lit(v) for v in PRESET_BASES["millimetre_y_up_back"]])
    return mm.select("session_id", "sample_idx", F.get(F.array(*map(F.lit, BODY_JOINTS)), F.col("joint_idx")).alias("joint_name"), fixed(F.col("sample_idx") / 60.0).alias("t_sec"), *[fixed(c).alias(f"{a}_m") for a, c in zip("xyz", moved)])


@query(
    "a21_flattened_report",
    """SELECT c_custkey, c_nationkey AS quality_nation, c_mktsegment AS quality_segment, array_to_string(list_filter([CASE WHEN c_acctbal < 0 THEN 'negative_balance' END, CASE WHEN c_nationkey > 12 THEN 'far' END], lambda w: w IS NOT NULL), ';') AS warnings FROM customer""",
)
def a21(spark, sf):
    nested = T.read(spark, sf, "customer").select(
        "c_custkey", F.struct(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")).alias("quality"), reasons((F.col("c_acctbal") < 0, "negative_balance"), (F.col("c_nationkey") > 12, "far")).alias("warnings")
    )
    return flatten(nested)


def flatten(df):
    """Nested report to one wide row: struct fields get their parent's name, arrays of text are joined."""
    out = []
    for f in df.schema.fields:
        if f.dataType.typeName() == "struct":
            out += [F.col(f"{f.name}.{c}").alias(f"{f.name}_{c}") for c in f.dataType.fieldNames()]
        elif f.dataType.typeName() == "array":
            out.append(F.array_join(f.name, ";").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


@query(
    "a22_workflow_profile_checks",
    """WITH p AS (SELECT o_orderkey, o_custkey % 4 AS stride, o_custkey % 9 AS win FROM orders), v AS (SELECT l_orderkey, count(*) AS videos, count(DISTINCT l_suppkey % 3) AS labels FROM lineitem GROUP BY ALL), j AS (SELECT * FROM p LEFT JOIN v ON l_orderkey = o_orderkey)
SELECT o_orderkey AS profile_id, 'stride_not_one' AS violation FROM j WHERE stride <> 1 UNION ALL SELECT o_orderkey, 'window_not_odd' FROM j WHERE win % 2 = 0 UNION ALL SELECT o_orderkey, 'too_few_videos' FROM j WHERE coalesce(videos, 0) < 2 UNION ALL SELECT o_orderkey, 'labels_not_unique' FROM j WHERE videos <> labels""",
)
def a22(spark, sf):
    v = T.read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("profile_id")).agg(F.count(F.lit(1)).alias("videos"), F.countDistinct(F.col("l_suppkey") % 3).alias("labels"))
    p = T.read(spark, sf, "orders").select(F.col("o_orderkey").alias("profile_id"), (F.col("o_custkey") % 4).alias("stride"), (F.col("o_custkey") % 9).alias("win")).join(v, "profile_id", "left")
    return violations(
        p, ["profile_id"],
        {"stride_not_one": F.col("stride") != 1, "window_not_odd": F.col("win") % 2 == 0, "too_few_videos": F.coalesce("videos", F.lit(0)) < 2, "labels_not_unique": F.col("videos") != F.col("labels")},
    )
