"""E: temporal operators over pose and view series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import count_where, fixed
from ..functions.skeleton import J, RELIABILITY_BONES
from ..operators import temporal as E
from ..operators.blocks import runs
from . import tables as T
from .registry import query

r6 = T.r6
KEYS = ["session_id", "joint_idx"]
W = "OVER (PARTITION BY session_id, joint_idx ORDER BY sample_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"
LAGW = "OVER (PARTITION BY session_id, joint_idx ORDER BY sample_idx)"
ID = ["session_id", "joint_idx", "sample_idx"]


@query(
    "e1_centered_mean",
    f"WITH {T.SQL_LONG} SELECT session_id, joint_idx, sample_idx, {', '.join(f'{r6(f'avg({c}) {W}')} AS {c}_ma' for c in 'xyz')} FROM p3",
)
def e1(spark, sf):
    out = E.centered_mean(T.pose3d(spark, sf), KEYS, "sample_idx", "xyz", 5)
    return out.select(*ID, *[fixed(f"{c}_ma").alias(f"{c}_ma") for c in "xyz"])


def _mask(c: str) -> str:
    return f"CASE WHEN x IS NOT NULL AND reproj_px <= 20 THEN {c} END"


@query(
    "e2_centered_mean_points",
    f"""WITH {T.SQL_LONG}, n AS (SELECT session_id, count(DISTINCT sample_idx) AS f FROM p3 GROUP BY ALL)
SELECT session_id, joint_idx, sample_idx, {', '.join(f"{r6(f'CASE WHEN f < 5 THEN {_mask(c)} WHEN count({_mask(c)}) {W} >= 2 THEN avg({_mask(c)}) {W} END')} AS {c}_ma" for c in 'xyz')}
FROM p3 JOIN n USING (session_id)""",
)
def e2(spark, sf):
    valid = F.coalesce(F.col("reproj_px") <= 20, F.lit(False))
    out = E.centered_mean_points(T.pose3d(spark, sf), KEYS, "sample_idx", "xyz", valid, 5, 2)
    return out.select(*ID, *[fixed(f"{c}_ma").alias(f"{c}_ma") for c in "xyz"])


def sql_runs(source: str, keys: str, flag: str, ident: str = "0", name: str = "rn") -> str:
    """Gap-and-island text: run_start / run_end of consecutive true rows with one identity."""
    return f"""{name}0 AS (SELECT *, coalesce({flag}, FALSE) AS fl, {ident} AS idn FROM {source}),
{name}1 AS (SELECT *, sample_idx - row_number() OVER (PARTITION BY {keys}, fl, idn ORDER BY sample_idx) AS g FROM {name}0),
{name} AS (SELECT *, CASE WHEN fl THEN min(sample_idx) OVER (PARTITION BY {keys}, fl, idn, g) END AS run_start,
  CASE WHEN fl THEN max(sample_idx) OVER (PARTITION BY {keys}, fl, idn, g) END AS run_end FROM {name}1)"""


@query(
    "e3_valid_runs",
    f"""WITH {T.SQL_LONG}, {sql_runs('p3', 'session_id, joint_idx', 'x IS NOT NULL', '(sample_idx // 20) % 2')}
SELECT session_id, joint_idx, run_start, run_end, count(*) AS run_length FROM rn WHERE run_start IS NOT NULL GROUP BY ALL""",
)
def e3(spark, sf):
    marked = runs(T.pose3d(spark, sf), KEYS, "sample_idx", F.col("x").isNotNull(), F.floor(F.col("sample_idx") / 20) % 2)
    return marked.where("run_start IS NOT NULL").groupBy(*KEYS, "run_start", "run_end").agg(F.count(F.lit(1)).alias("run_length"))


def sql_hat(window: int, order: int) -> str:
    rows = []
    for n in range(3, window + 1, 2):
        for i, row in enumerate(E.polynomial_hat(n, order).tolist()):
            rows += [f"({n}, {i}, {k}, CAST({c!r} AS DOUBLE))" for k, c in enumerate(row)]
    return f"(VALUES {', '.join(rows)})"


def sql_fit(source: str, keys: list[str], coords: list[str], window: int, order: int, name: str, least: int = 3) -> str:
    """Run-wise polynomial fit of ``source`` (columns run_start, run_end): adds <coord>_f, NULL in short runs."""
    k = ", ".join(keys)
    on = " AND ".join(f"a.{c} = b.{c}" for c in keys)
    return f"""{name}e AS (SELECT *, run_end - run_start + 1 AS ln, least({window}, CASE WHEN (run_end - run_start) % 2 = 0 THEN run_end - run_start + 1 ELSE run_end - run_start END) AS eff
  FROM {source} WHERE run_start IS NOT NULL),
{name}s AS (SELECT *, least(greatest(sample_idx - run_start - eff // 2, 0), ln - eff) AS st FROM {name}e WHERE eff >= {max(3, least)} AND eff > {order}),
{name}h(he, hr, hk, hc) AS {sql_hat(window, order)},
{name}t AS (SELECT {', '.join(f'a.{c}' for c in keys)}, a.sample_idx, {', '.join(f'sum(b.{c} * hc) AS {c}_f' for c in coords)}
  FROM {name}s a JOIN {name}s b ON {on} AND b.sample_idx BETWEEN a.run_start + a.st AND a.run_start + a.st + a.eff - 1
  JOIN {name}h ON he = a.eff AND hr = a.sample_idx - a.run_start - a.st AND hk = b.sample_idx - a.run_start - a.st GROUP BY ALL),
{name} AS (SELECT s.*, {', '.join(f'{c}_f' for c in coords)} FROM {source} s LEFT JOIN {name}t USING ({k}, sample_idx))"""


def sql_robust(source: str, keys: list[str], coords: list[str], window: int, order: int, least: float, name: str) -> str:
    k = ", ".join(keys)
    res = " + ".join(f"pow({c} - {c}_f, 2)" for c in coords)
    clean = ", ".join(f"CASE WHEN o THEN {c}_f ELSE {c} END AS {c}c" for c in coords)
    return f"""{sql_fit(source, keys, coords, window, order, name + 'a')},
{name}b AS (SELECT *, CASE WHEN run_end - run_start + 1 >= 5 THEN sqrt({res}) END AS rs FROM {name}a),
{name}c AS (SELECT *, median(rs) OVER (PARTITION BY {k}, run_start) AS md FROM {name}b),
{name}d AS (SELECT *, median(abs(rs - md)) OVER (PARTITION BY {k}, run_start) AS ad FROM {name}c),
{name}o AS (SELECT *, coalesce(rs > greatest({least}, md + 4.0 * 1.4826 * ad), FALSE) AS o FROM {name}d),
{name}g AS (SELECT * EXCLUDE ({', '.join(f'{c}_f' for c in coords)}), {', '.join(f'{c}_f AS {c}p' for c in coords)}, {clean}, bool_or(o) OVER (PARTITION BY {k}, run_start) AS dirty FROM {name}o),
{sql_fit(name + 'g', keys, [c + 'c' for c in coords], window, order, name + 'z')},
{name} AS (SELECT *, {', '.join(f'CASE WHEN run_start IS NULL THEN NULL WHEN {c}p IS NULL THEN {c} WHEN dirty THEN {c}c_f ELSE {c}p END AS {c}_sm' for c in coords)} FROM {name}z)"""


@query(
    "e4_robust_savgol",
    f"""WITH {T.SQL_LONG}, {sql_runs('p3', 'session_id, joint_idx', 'x IS NOT NULL')},
{sql_robust('rn', KEYS, ['x', 'y', 'z'], 7, 2, 0.04, 'sg')}
SELECT session_id, joint_idx, sample_idx, {', '.join(f'{r6(c + "_sm")} AS {c}_sm' for c in 'xyz')} FROM sg""",
)
def e4(spark, sf):
    out = E.robust_savgol(T.pose3d(spark, sf), KEYS, "sample_idx", "xyz", F.lit(True))
    return out.select(*ID, *[fixed(f"{c}_sm").alias(f"{c}_sm") for c in "xyz"])


@query(
    "e5_smoothing_by_name",
    f"""WITH {T.SQL_LONG} SELECT session_id, joint_idx, sample_idx, {', '.join(f"{r6(f'avg({c}) OVER (PARTITION BY session_id, joint_idx ORDER BY sample_idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)')} AS {c}_sm" for c in 'xyz')} FROM p3""",
)
def e5(spark, sf):
    out = E.smooth(T.pose3d(spark, sf), KEYS, "sample_idx", "xyz", F.lit(True), method="moving_average", window=7)
    return out.select(*ID, *[fixed(f"{c}_sm").alias(f"{c}_sm") for c in "xyz"])


VIEW_KEYS = ["session_id", "camera_id", "joint_idx"]


@query(
    "e6_stabilise_views",
    f"""WITH {T.SQL_VIEWS}, {sql_runs('p2', 'session_id, camera_id, joint_idx', 'px IS NOT NULL AND score >= 0.35', '(sample_idx // 25) % 2')},
{sql_robust('rn', VIEW_KEYS, ['px', 'py'], 7, 2, 6.0, 'sg')}
SELECT session_id, camera_id, joint_idx, sample_idx, {r6('px_sm', 4)} AS px_sm, {r6('py_sm', 4)} AS py_sm FROM sg""",
)
def e6(spark, sf):
    person = F.floor(F.col("sample_idx") / 25) % 2
    out = E.robust_savgol(
        T.pose2d(spark, sf), VIEW_KEYS, "sample_idx", ["px", "py"], F.col("score") >= 0.35, 7, 2, 6.0, breaks=person
    )
    return out.select(*VIEW_KEYS, "sample_idx", fixed("px_sm", 4).alias("px_sm"), fixed("py_sm", 4).alias("py_sm"))


@query(
    "e8_fill_short_gaps",
    f"""WITH {T.SQL_LONG}, v AS (SELECT *, CASE WHEN x IS NOT NULL AND (reproj_px <= 20) THEN sample_idx END AS si FROM p3),
b AS (SELECT *, last_value(si IGNORE NULLS) {LAGW} AS pi, first_value(si IGNORE NULLS) OVER (PARTITION BY session_id, joint_idx ORDER BY sample_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ni FROM v),
k AS (SELECT b.*, p.x AS px, p.y AS py, p.z AS pz, n.x AS nx, n.y AS ny, n.z AS nz, (b.sample_idx - pi)::DOUBLE / (ni - pi) AS al, ni - pi - 1 AS gap
 FROM b LEFT JOIN p3 p ON p.session_id = b.session_id AND p.joint_idx = b.joint_idx AND p.sample_idx = b.pi
 LEFT JOIN p3 n ON n.session_id = b.session_id AND n.joint_idx = b.joint_idx AND n.sample_idx = b.ni)
SELECT session_id, joint_idx, sample_idx, CAST(CASE WHEN si IS NOT NULL THEN 1 WHEN gap BETWEEN 1 AND 3 THEN 2 ELSE 0 END AS INTEGER) AS provenance,
 {', '.join(f"{r6(f'CASE WHEN si IS NOT NULL THEN {c} WHEN gap BETWEEN 1 AND 3 THEN (1.0 - al) * p{c} + al * n{c} END')} AS {c}" for c in 'xyz')} FROM k""",
)
def e8(spark, sf):
    valid = F.coalesce(F.col("reproj_px") <= 20, F.lit(False))
    out = E.fill_short_gaps(T.pose3d(spark, sf), KEYS, "sample_idx", "xyz", valid, 3)
    return out.select(*ID, "provenance", *[fixed(c).alias(c) for c in "xyz"])


SQL_SPEED = f"""sm AS (SELECT session_id, joint_idx, sample_idx, {', '.join(f'avg({c}) {W} AS {c}' for c in 'xyz')} FROM p3),
sp AS (SELECT *, sqrt({' + '.join(f'pow({c} - lag({c}) {LAGW}, 2)' for c in 'xyz')}) * {T.FPS} AS speed FROM sm)"""


@query("e9_joint_speed", f"WITH {T.SQL_LONG}, {SQL_SPEED} SELECT session_id, joint_idx, sample_idx, {r6('speed')} AS speed FROM sp")
def e9(spark, sf):
    return E.speed(T.pose3d(spark, sf), KEYS, "sample_idx", "xyz", T.FPS).select(*ID, fixed("speed").alias("speed"))


_T = "(t_sec + (vec_id % 5) * 0.002)"


@query(
    "e10_motion_derivatives",
    f"""WITH {T.SQL_LONG}, a AS (SELECT *, {_T} AS t FROM p3),
l AS (SELECT *, lag(t) {LAGW} AS pt, lead(t) {LAGW} AS nt, {', '.join(f'lag({c}) {LAGW} AS p{c}, lead({c}) {LAGW} AS n{c}' for c in 'xyz')} FROM a),
d AS (SELECT *, greatest(t - pt, 1e-6) AS b, greatest(nt - t, 1e-6) AS f FROM l),
e AS (SELECT *, CASE WHEN pt IS NOT NULL AND nt IS NOT NULL THEN sqrt({' + '.join(f'pow(2.0 * ((n{c} - {c}) / f - ({c} - p{c}) / b) / (b + f), 2)' for c in 'xyz')}) END AS acc,
 sqrt({' + '.join(f'pow(CASE WHEN nt IS NULL THEN {c} ELSE n{c} END - CASE WHEN pt IS NULL THEN {c} ELSE p{c} END, 2)' for c in 'xyz')}) / (coalesce(nt, t) - coalesce(pt, t)) AS ls FROM d)
SELECT session_id, joint_idx, sample_idx, {r6('acc', 4)} AS acceleration, {r6('ls')} AS local_speed,
 {r6('CASE WHEN ls IS NOT NULL THEN least(greatest(1.5 / (1.5 + greatest(ls, 0.0)), 0.2), 1.0) END')} AS motion_weight FROM e""",
)
def e10(spark, sf):
    df = T.pose3d(spark, sf).withColumn("t", F.expr(_T).cast("double"))
    out = E.motion_derivatives(df, KEYS, "sample_idx", "t", "xyz")
    return out.select(
        *ID, fixed("acceleration", 4).alias("acceleration"), fixed("local_speed").alias("local_speed"), fixed("motion_weight").alias("motion_weight")
    )


def _degree(joint: str) -> int:
    return sum(joint in bone for bone in RELIABILITY_BONES)


def _sql_bones() -> str:
    rows = []
    for i, (a, b) in enumerate(RELIABILITY_BONES):
        weaker = J[a] if _degree(a) < _degree(b) else J[b]
        rows.append(f"({i}, {J[a]}, {J[b]}, {weaker})")
    return ", ".join(rows)


SQL_RELIABILITY = f"""bn(bone, ja, jb, wk) AS (VALUES {_sql_bones()}),
bl AS (SELECT a.session_id, a.sample_idx, bone, ja, jb, wk, a.tri_score AS sa, b.tri_score AS sb,
  sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS ln
  FROM bn JOIN p3 a ON a.joint_idx = ja JOIN p3 b ON b.joint_idx = jb AND b.session_id = a.session_id AND b.sample_idx = a.sample_idx
  WHERE a.x IS NOT NULL AND b.x IS NOT NULL),
rf AS (SELECT session_id, bone, median(ln) AS ref FROM bl GROUP BY ALL HAVING count(*) >= 5 AND median(ln) > 1e-6),
br AS (SELECT DISTINCT session_id, sample_idx, CASE WHEN abs(sa - sb) > 0.10 THEN CASE WHEN sa < sb THEN ja ELSE jb END ELSE wk END AS joint_idx
  FROM bl JOIN rf USING (session_id, bone) WHERE abs(ln - ref) > greatest(0.08, 0.25 * ref)),
v1 AS (SELECT p3.*, p3.x IS NULL AS base_bad, br.joint_idx IS NOT NULL AS bone_bad, p3.x IS NOT NULL AND br.joint_idx IS NULL AS ok
  FROM p3 LEFT JOIN br USING (session_id, sample_idx, joint_idx)),
v2 AS (SELECT *, lag(ok) {LAGW} AS pok, lead(ok) {LAGW} AS nok, t_sec - lag(t_sec) {LAGW} AS b, lead(t_sec) {LAGW} - t_sec AS f,
  {', '.join(f'lag({c}) {LAGW} AS p{c}, lead({c}) {LAGW} AS n{c}' for c in 'xyz')} FROM v1),
v3 AS (SELECT *, coalesce(ok AND pok AND nok AND sqrt({' + '.join(f'pow({c} - (p{c} + b / (b + f) * (n{c} - p{c})), 2)' for c in 'xyz')}) > greatest(0.08, 0.5 * 70.0 * b * f), FALSE) AS temp_bad FROM v2),
rl AS (SELECT *, CAST((CASE WHEN base_bad THEN 1 ELSE 0 END) + (CASE WHEN bone_bad THEN 2 ELSE 0 END) + (CASE WHEN temp_bad THEN 4 ELSE 0 END) AS INTEGER) AS flags FROM v3)"""


def reliability(spark, sf):
    """E12 then E13: flags per point; the bone test runs on frame arrays, the temporal one per joint."""
    wide = T.sequence_frames(spark, sf)
    scores = F.expr(
        f"transform(sequence(0, {T.JOINTS - 1}), j -> {T._quality(T._spark_at)['tri_score']})"
    )
    wide = E.reject_bones(wide.withColumn("scores", scores), "session_id")
    long = T.long_points(wide)
    bone = F.array_contains("bone_rejected", F.col("joint_idx"))
    long = long.withColumns({"base_bad": F.col("x").isNull(), "bone_bad": bone}).drop("bone_rejected", "scores")
    long = E.reject_temporal(long, KEYS, "sample_idx", "t_sec", "xyz", ~F.col("base_bad") & ~F.col("bone_bad"))
    bit = lambda c, v: F.when(F.col(c), v).otherwise(0)
    return long.withColumn(
        "flags", bit("base_bad", E.REJECT_BASE).bitwiseOR(bit("bone_bad", E.REJECT_BONE)).bitwiseOR(bit("temporal_rejected", E.REJECT_TEMPORAL))
    )


@query(
    "e12_bone_length_rejection",
    f"WITH {T.SQL_LONG}, {SQL_RELIABILITY} SELECT session_id, sample_idx, CAST(joint_idx AS INTEGER) AS joint_idx FROM br",
)
def e12(spark, sf):
    wide = T.sequence_frames(spark, sf)
    scores = F.expr(f"transform(sequence(0, {T.JOINTS - 1}), j -> {T._quality(T._spark_at)['tri_score']})")
    out = E.reject_bones(wide.withColumn("scores", scores), "session_id")
    return out.select("session_id", "sample_idx", F.explode("bone_rejected").alias("joint_idx"))


@query(
    "e13_temporal_rejection",
    f"WITH {T.SQL_LONG}, {SQL_RELIABILITY} SELECT session_id, sample_idx, joint_idx, flags FROM rl",
)
def e13(spark, sf):
    return reliability(spark, sf).select("session_id", "sample_idx", "joint_idx", "flags")


@query(
    "e14_reliability_summary",
    f"""WITH {T.SQL_LONG}, {SQL_RELIABILITY} SELECT session_id, count(*) AS point_count, count(*) FILTER (WHERE flags & 1 = 0) AS input_valid,
 count(*) FILTER (WHERE flags = 0) AS output_valid, count(*) FILTER (WHERE flags & 1 <> 0) AS base_rejected,
 count(*) FILTER (WHERE flags & 2 <> 0) AS bone_rejected, count(*) FILTER (WHERE flags & 4 <> 0) AS temporal_rejected,
 {r6('avg(CASE WHEN flags = 0 THEN 1.0 ELSE 0.0 END)')} AS output_valid_ratio FROM rl GROUP BY ALL""",
)
def e14(spark, sf):
    flag = lambda v: F.col("flags").bitwiseAND(v) != 0
    return reliability(spark, sf).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("point_count"), count_where(~flag(1)).alias("input_valid"),
        count_where(F.col("flags") == 0).alias("output_valid"), count_where(flag(1)).alias("base_rejected"),
        count_where(flag(2)).alias("bone_rejected"), count_where(flag(4)).alias("temporal_rejected"),
        fixed(F.avg(F.when(F.col("flags") == 0, 1.0).otherwise(0.0))).alias("output_valid_ratio"),
    )
