"""H: movement diagnostics. Stand-in movements are eight frames long; joints beyond the body reuse embedding values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.numeric import fixed
from ..functions.skeleton import GROUP_RANGES, J
from ..operators.blocks import expand_range
from ..operators import movement as H
from ..operators import screening as S
from ..operators.quantiles import exact_quantiles
from ..session import materialise
from . import oracle as O
from . import tables as T
from .registry import ORACLES, query

r6 = T.r6
R, MIN, FPS = 1, 2, 30.0
EYE, PALM, FOOTG = (0.01, 3.0), (0.05, 3.0), (0.05, 3.0)
KEY = ["session_id", "movement"]
ALL = 133


def whole_frames(spark, sf):
    """Frames in the 133-point layout."""
    f = T.sequence_frames(spark, sf)
    pts = (
        f"transform(sequence(0, {ALL - 1}), j -> CASE WHEN {T._hidden('vec_id', 'j')} THEN NULL ELSE named_struct("
        "'x', CAST(e[(3 * j + int(j / 17)) % 64] AS DOUBLE), 'y', CAST(e[(3 * j + 1 + int(j / 17)) % 64] AS DOUBLE), 'z', CAST(e[(3 * j + 2 + int(j / 17)) % 64] AS DOUBLE)) END)"
    )
    # the scale is computed once here, where the stored frames keep it for every later use
    return f.withColumn("pts", F.expr(pts)).select("session_id", "vec_id", "sample_idx", "pts", G.body_scale("pts").alias("body_scale"))


def movements(spark, sf):
    """Eight-frame movements, the last one as long as the frames that are left, with anchors (inside the movement),
    executing side, technique and stance from their ordinal."""
    n = T.frames(spark, sf).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    m = expand_range(n, ["session_id"], F.lit(0), F.floor((F.col("n") - 1) / 8), "movement")
    s, k = F.col("movement") * 8, F.col("movement") % 4
    at = lambda frame: F.least(s + frame, F.col("n") - 1)
    return m.select(
        "session_id", "movement", s.alias("start_frame"), at(7).alias("end_frame"), at(1).alias("preparation"), at(4).alias("execution"), at(5).alias("fixation"),
        F.when(k == 3, at(3)).alias("kick_apex"), F.when(k == 3, at(4)).alias("rechamber"), F.when(F.col("movement") % 2 == 0, "left").otherwise("right").alias("side"),
        F.when(F.floor(F.col("movement") / 2) % 2 == 0, "left").otherwise("right").alias("stance_side"),
        F.when(k == 0, "punch").when(k == 1, "low_block").when(k == 2, "high_block").otherwise("kick_punch").alias("technique"),
        F.when(F.col("movement") % 3 == 0, "walking").otherwise("long").alias("stance_family"),
    )


def scaled(spark, sf, frames):
    moves = movements(spark, sf)
    labelled = H.segment_frames(frames, moves, "session_id", "sample_idx", "start_frame", "end_frame")
    return moves.join(H.segment_scale(labelled, "session_id", F.col("body_scale")), KEY, "left"), labelled


def windows(spark, sf):
    frames = materialise(whole_frames(spark, sf), "frames")
    moves, _ = scaled(spark, sf, frames)
    rows = H.anchor_windows(frames, moves, "session_id", "sample_idx", R)
    # every metric below reads these few frames per movement
    return materialise(rows.withColumn("c_fixation", H.completed("w_fixation", R, MIN)), "windows")


# ---------------------------------------------------------------- oracle side


def _pt(j: int, a: int, vec: str = "vec_id") -> str:
    return f"CASE WHEN {T._hidden(vec, j)} THEN NULL ELSE CAST(e[(3 * {j} + {a} + {j} // 17) % 64 + 1] AS DOUBLE) END"


SQL_MOVES = f"""f0 AS (SELECT vec_id, label AS session_id, embedding AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS sample_idx FROM embeddings),
nn AS (SELECT session_id, count(*) AS n FROM f0 GROUP BY ALL),
mv AS (SELECT session_id, m AS movement, m * 8 AS start_frame, least(m * 8 + 7, n - 1) AS end_frame, least(m * 8 + 1, n - 1) AS preparation, least(m * 8 + 4, n - 1) AS execution, least(m * 8 + 5, n - 1) AS fixation, CASE WHEN m % 4 = 3 THEN least(m * 8 + 3, n - 1) END AS kick_apex, CASE WHEN m % 4 = 3 THEN least(m * 8 + 4, n - 1) END AS rechamber,
 CASE WHEN m % 2 = 0 THEN 'left' ELSE 'right' END AS side, CASE WHEN m // 2 % 2 = 0 THEN 'left' ELSE 'right' END AS stance_side, CASE m % 4 WHEN 0 THEN 'punch' WHEN 1 THEN 'low_block' WHEN 2 THEN 'high_block' ELSE 'kick_punch' END AS technique,
 CASE WHEN m % 3 = 0 THEN 'walking' ELSE 'long' END AS stance_family FROM nn, unnest(range(0, (n + 7) // 8)) u(m)),
lf AS (SELECT mv.*, vec_id, e, sample_idx FROM mv JOIN f0 ON f0.session_id = mv.session_id AND sample_idx BETWEEN start_frame AND end_frame),
js AS (SELECT CAST(unnest(range({ALL})) AS INTEGER) AS j),
lp AS (SELECT session_id, movement, sample_idx, j, {', '.join(f"CASE WHEN {T._hidden('vec_id', 'j')} THEN NULL ELSE CAST(e[(3 * j + {a} + j // 17) % 64 + 1] AS DOUBLE) END AS {c}" for a, c in enumerate('xyz'))} FROM lf, js)"""


def _wide(joints, source: str, name: str) -> str:
    cols = ", ".join(f"max({c}) FILTER (WHERE j = {j}) AS {c}{j}" for j in joints for c in "xyz")
    return f"{name} AS (SELECT session_id, movement, sample_idx, {cols} FROM {source} GROUP BY ALL)"


_LEGS = [J[f"{s}_{p}"] for s in ("left", "right") for p in ("hip", "knee", "ankle")]
SQL_SCALE = f"{SQL_MOVES}, {_wide(_LEGS, 'lp', 'lg')}, scl AS (SELECT session_id, movement, median({O.SCALE}) AS scale FROM lg GROUP BY ALL)"
# completed fixation window: missing joints take the median of neighbouring window frames
SQL_FIX = f"""{SQL_SCALE}, fw AS (SELECT lp.* FROM lp JOIN mv USING (session_id, movement) WHERE sample_idx BETWEEN fixation - {R} AND least(end_frame, fixation + {R})),
cw AS (SELECT a.session_id, a.movement, a.sample_idx, a.j, {', '.join(f'CASE WHEN a.x IS NOT NULL THEN a.{c} WHEN count(b.x) >= {MIN} THEN median(b.{c}) END AS {c}' for c in 'xyz')}
 FROM fw a JOIN fw b ON a.session_id = b.session_id AND a.movement = b.movement AND a.j = b.j AND abs(a.sample_idx - b.sample_idx) <= {R} GROUP BY a.session_id, a.movement, a.sample_idx, a.j, a.x, a.y, a.z)"""
_BODY = list(range(5, 17))
_HANDS = list(range(91, 133))
_FACE = [*H.LEFT_EYE, *H.RIGHT_EYE]


def _mean(js) -> O.P:
    return tuple("(" + " + ".join(f"{c}{j}" for j in js) + f") / {float(len(js))}" for c in "xyz")


def _par(p):
    return tuple(f"({t})" for t in p)


def _flat(u, v, undirected: bool) -> str:
    ang = O.between_vectors(tuple(u[:2]), tuple(v[:2]), 1e-9)
    return f"least({ang}, 180.0 - ({ang}))" if undirected else ang


def _side(col: str, fn) -> str:
    return f"CASE WHEN {col} = 'left' THEN {fn('left')} ELSE {fn('right')} END"


def _opp(s: str) -> str:
    return "right" if s == "left" else "left"


def _med(text: str, p: float | None = None) -> str:
    agg = f"median({text})" if p is None else f"quantile_cont({text}, {p})"
    return r6(f"CASE WHEN count({text}) >= {MIN} THEN {agg} END", 5)


_T = O.v_sub(O.v_mid(O.pt("left_shoulder"), O.pt("right_shoulder")), O.v_mid(O.pt("left_hip"), O.pt("right_hip")))
_LEAN = f"CASE WHEN {O.v_norm(_T)} > 1e-9 THEN degrees(acos(greatest(-1.0, least(1.0, {_T[2]} / {O.v_norm(_T)})))) END"
_SH, _HP = O.v_sub(O.pt("right_shoulder"), O.pt("left_shoulder")), O.v_sub(O.pt("right_hip"), O.pt("left_hip"))
_EYES = _par(tuple(f"({b}) - ({a})" for a, b in zip(_mean(list(H.LEFT_EYE)), _mean(list(H.RIGHT_EYE)))))
_HEAD = f"CASE WHEN {O.v_norm(_EYES)} / scale BETWEEN {EYE[0]} AND {EYE[1]} THEN {_flat(_EYES, _SH, True)} END"


@query("h1_anchor_window_median", f"""WITH {SQL_MOVES} SELECT session_id, movement, CAST(j AS INTEGER) AS joint_idx, {', '.join(f"{r6(f'CASE WHEN count({c}) >= {MIN} THEN median({c}) END')} AS {c}" for c in 'xyz')}
FROM lp JOIN mv USING (session_id, movement) WHERE sample_idx BETWEEN preparation - {R} AND preparation + {R} AND j IN (9, 10, 11, 12) GROUP BY ALL""")
def h1(spark, sf):
    rows = windows(spark, sf)
    entries = []
    for j in (9, 10, 11, 12):
        p = H.window_point("w_preparation", j, MIN)
        entries.append(F.struct(F.lit(j).alias("joint_idx"), p.alias("p")))
    out = rows.select(*KEY, F.inline(F.array(*entries)))
    return out.select(*KEY, "joint_idx", *[fixed(f"p.{a}").alias(a) for a in "xyz"])


def _est(text: str) -> str:
    return text


@query(
    "h2_window_estimate",
    f"""WITH {SQL_SCALE}, {_wide([*_BODY, *range(17, 23)], 'lp', 'w')},
v AS (SELECT w.session_id, movement, {_side('stance_side', lambda s: O.angle(f'{s}_hip', f'{s}_knee', f'{s}_ankle', 1e-9))} AS knee, {_side('side', lambda s: O.angle(f'{s}_shoulder', f'{s}_elbow', f'{s}_wrist', 1e-9))} AS elbow
 FROM w JOIN mv USING (session_id, movement) WHERE sample_idx BETWEEN fixation - {R} AND fixation + {R}),
m AS (SELECT *, median(knee) OVER p AS km, median(elbow) OVER p AS em FROM v WINDOW p AS (PARTITION BY session_id, movement))
SELECT session_id, movement, {_med('knee')} AS front_knee_deg, CAST(count(knee) AS INTEGER) AS knee_samples, {_med('elbow')} AS executing_elbow_deg,
 {r6(f'CASE WHEN count(elbow) >= {MIN} THEN 1.96 * 1.4826 * median(abs(elbow - em)) END', 5)} AS elbow_uncertainty_95, CAST(count(elbow) AS INTEGER) AS elbow_samples FROM m GROUP BY ALL""",
)
def h2(spark, sf):
    rows = windows(spark, sf)
    knee = H.window_values("w_fixation", lambda f: H.front_knee(f, F.col("stance_side")))
    elbow = H.window_values("w_fixation", lambda f: H.executing_elbow(f, F.col("side")))
    return rows.select(
        *KEY, fixed(H.estimate(knee, MIN), 5).alias("front_knee_deg"), F.size(knee).alias("knee_samples"), fixed(H.estimate(elbow, MIN), 5).alias("executing_elbow_deg"),
        fixed(H.uncertainty_95(elbow, MIN), 5).alias("elbow_uncertainty_95"), F.size(elbow).alias("elbow_samples"),
    )


@query("h3_completed_point_sets", f"WITH {SQL_FIX} SELECT session_id, movement, sample_idx, CAST(j AS INTEGER) AS joint_idx, {', '.join(f'{r6(c)} AS {c}' for c in 'xyz')} FROM cw WHERE x IS NOT NULL")
def h3(spark, sf):
    f = windows(spark, sf).select(*KEY, F.explode("c_fixation").alias("f"))
    points = f.select(*KEY, F.col("f.i").alias("sample_idx"), F.posexplode("f.pts").alias("joint_idx", "p")).where("p IS NOT NULL")
    return points.select(*KEY, "sample_idx", "joint_idx", *[fixed(f"p.{c}").alias(c) for c in "xyz"])


@query(
    "h4_group_coverage",
    f"""WITH {SQL_SCALE} SELECT session_id, movement, {', '.join(f"{r6(f'avg(CASE WHEN x IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (WHERE j BETWEEN {lo} AND {hi})')} AS coverage_{g}" for g, (lo, hi) in GROUP_RANGES.items())}, {r6('max(scale)')} AS scale
FROM lp JOIN scl USING (session_id, movement) GROUP BY ALL""",
)
def h4(spark, sf):
    frames = materialise(whole_frames(spark, sf), "frames")
    moves, labelled = scaled(spark, sf, frames)
    out = H.group_coverage(labelled, "session_id").join(moves.select(*KEY, "scale"), KEY)
    return out.withColumns({c: fixed(c) for c in out.columns if c not in KEY})


@query(
    "h5_h7_posture_metrics",
    f"""WITH {SQL_FIX}, {_wide([*_BODY, *_FACE], 'cw', 'w')}, v AS (SELECT session_id, movement, {_LEAN} AS lean, {_flat(_SH, _HP, True)} AS twist, {_HEAD} AS head FROM w JOIN scl USING (session_id, movement))
SELECT session_id, movement, {_med('lean', 0.95)} AS torso_lean_p95_deg, {_med('twist')} AS shoulder_hip_twist_deg, {_med('head')} AS head_torso_yaw_mismatch_deg FROM v GROUP BY ALL""",
)
def h5(spark, sf):
    v = lambda m: H.window_values("c_fixation", m)
    return windows(spark, sf).select(
        *KEY, fixed(H.estimate(v(H.torso_lean), MIN, 0.95), 5).alias("torso_lean_p95_deg"), fixed(H.estimate(v(H.twist), MIN), 5).alias("shoulder_hip_twist_deg"),
        fixed(H.estimate(v(lambda f: H.head_mismatch(f, F.col("scale"), EYE)), MIN), 5).alias("head_torso_yaw_mismatch_deg"),
    )


def _win_pts(anchor: str, name: str, joints) -> str:
    cols = ", ".join(f"CASE WHEN count({c}) FILTER (WHERE j = {j}) >= {MIN} THEN median({c}) FILTER (WHERE j = {j}) END AS {c}{j}" for j in joints for c in "xyz")
    return f"{name} AS (SELECT session_id, movement, {cols} FROM lp JOIN mv USING (session_id, movement) WHERE sample_idx BETWEEN {anchor} - {R} AND {anchor} + {R} GROUP BY ALL)"


def _pref(p: str, j: int) -> O.P:
    return tuple(f"{p}.{c}{j}" for c in "xyz")


def _travel(s: str) -> str:
    return O.v_norm(O.v_sub(_pref("wp", J[f"{s}_wrist"]), _pref("we", J[f"{s}_wrist"])))


@query(
    "h8_side_dominance",
    f"""WITH {SQL_MOVES}, {_win_pts('preparation', 'wp', (9, 10))}, {_win_pts('execution', 'we', (9, 10))}
SELECT session_id, movement, {r6(_side('side', lambda s: f"{_travel(s)} / CASE WHEN {_travel(_opp(s))} IS NOT NULL THEN greatest({_travel(_opp(s))}, 1e-6) END"), 5)} AS expected_side_dominance_ratio FROM mv JOIN wp USING (session_id, movement) JOIN we USING (session_id, movement)""",
)
def h8(spark, sf):
    rows = windows(spark, sf)
    value = H.side_dominance("w_preparation", "w_execution", F.col("side"), MIN)
    return rows.select(*KEY, fixed(value, 5).alias("expected_side_dominance_ratio"))


def _hj(s: str, n: str) -> O.P:
    return O.pt(H.hand(s, n))


def _palm(w, m) -> str:
    return f"{O.v_norm(O.v_sub(w, m))} / scale BETWEEN {PALM[0]} AND {PALM[1]}"


def _align(s):
    w, m = O.pt(J[f"{s}_wrist"]), _hj(s, "middle_mcp")
    return f"CASE WHEN {_palm(w, m)} THEN abs(180.0 - ({O.between_vectors(O.v_sub(O.pt(J[f'{s}_elbow']), w), O.v_sub(m, w), 1e-9)})) END"


def _closure(s):
    w, m = _hj(s, "wrist"), _hj(s, "middle_mcp")
    c = _par(_mean([H.hand(s, n) for n in H.PALM]))
    far = [O.v_norm(O.v_sub(_hj(s, n), c)) for n in H.HAND if n not in H.PALM]
    return f"CASE WHEN {_palm(w, m)} AND {O.v_norm(O.v_sub(w, m))} > 1e-9 THEN ({' + '.join(far)}) / {float(len(far))} / {O.v_norm(O.v_sub(w, m))} END"


def _hik(s):
    return f"{O.v_norm(O.v_sub(_hj(_opp(s), 'wrist'), O.pt(J[_opp(s) + '_hip'])))} / scale"


@query(
    "h9_h11_hand_metrics",
    f"""WITH {SQL_FIX}, {_wide([*_BODY, *_HANDS], 'cw', 'w')}, v AS (SELECT session_id, movement, {_side('side', _hik)} AS hik, {_side('side', _align)} AS al, {_side('side', _closure)} AS cl FROM w JOIN scl USING (session_id, movement) JOIN mv USING (session_id, movement))
SELECT session_id, movement, {_med('hik')} AS reaction_hand_hip_distance_ratio, {_med('al')} AS wrist_forearm_alignment_deg, {_med('cl')} AS fist_closure_ratio FROM v GROUP BY ALL""",
)
def h9(spark, sf):
    side, scale = F.col("side"), F.col("scale")
    v = lambda m: H.estimate(H.window_values("c_fixation", m), MIN)
    return windows(spark, sf).select(
        *KEY, fixed(v(lambda f: H.hikite(f, H.other_side(side), scale)), 5).alias("reaction_hand_hip_distance_ratio"),
        fixed(v(lambda f: H.wrist_alignment(f, side, scale, PALM)), 5).alias("wrist_forearm_alignment_deg"), fixed(v(lambda f: H.fist_closure(f, side, scale, PALM)), 5).alias("fist_closure_ratio"),
    )


_STEP = "sqrt(" + " + ".join(f"pow({c} - lag({c}) OVER (PARTITION BY session_id, movement, j ORDER BY sample_idx), 2)" for c in "xyz") + ")"


@query(
    "h12_h16_trajectory_metrics",
    f"""WITH {SQL_SCALE}, tr AS (SELECT lp.*, side, stance_side, preparation, execution, fixation, end_frame, scale FROM lp JOIN mv USING (session_id, movement) JOIN scl USING (session_id, movement) WHERE sample_idx >= preparation),
ws AS (SELECT *, {_STEP} AS step, j IN (9, 10) AS wrist FROM tr WHERE j = CASE side WHEN 'left' THEN 9 ELSE 10 END OR j = CASE stance_side WHEN 'left' THEN 15 ELSE 16 END),
mx AS (SELECT *, median(x) FILTER (WHERE wrist AND sample_idx >= fixation) OVER q AS mx, median(y) FILTER (WHERE wrist AND sample_idx >= fixation) OVER q AS my, median(z) FILTER (WHERE wrist AND sample_idx >= fixation) OVER q AS mz,
 greatest(0.2 * max(step) FILTER (WHERE wrist AND sample_idx <= fixation) OVER q, 1e-5) AS tw, greatest(0.2 * max(step) FILTER (WHERE NOT wrist AND sample_idx <= fixation) OVER q, 1e-5) AS ta FROM ws WINDOW q AS (PARTITION BY session_id, movement)),
ag AS (SELECT session_id, movement, max(scale) AS scale, max(end_frame) > max(fixation) AS late, avg((x IS NOT NULL)::INT) FILTER (WHERE wrist AND sample_idx <= execution) AS ve, avg((x IS NOT NULL)::INT) FILTER (WHERE wrist AND sample_idx >= fixation) AS vh,
 avg((x IS NOT NULL)::INT) FILTER (WHERE wrist AND sample_idx <= fixation) AS vw, avg((x IS NOT NULL)::INT) FILTER (WHERE NOT wrist AND sample_idx <= fixation) AS va, sum(step) FILTER (WHERE wrist AND sample_idx <= execution) AS path, count(step) FILTER (WHERE wrist AND sample_idx <= execution) AS steps,
 {', '.join(f'arg_min({c}, sample_idx) FILTER (WHERE wrist AND sample_idx <= execution AND x IS NOT NULL) AS a{c}, arg_max({c}, sample_idx) FILTER (WHERE wrist AND sample_idx <= execution AND x IS NOT NULL) AS z{c}' for c in 'xyz')},
 max(sample_idx) FILTER (WHERE wrist AND sample_idx <= fixation AND step >= tw) AS sw, max(sample_idx) FILTER (WHERE NOT wrist AND sample_idx <= fixation AND step >= ta) AS sa, count(step) FILTER (WHERE wrist AND sample_idx <= fixation) AS nw, count(step) FILTER (WHERE NOT wrist AND sample_idx <= fixation) AS na,
 count(x) FILTER (WHERE wrist AND sample_idx >= fixation) AS nh, quantile_cont(step * 30, 0.95) FILTER (WHERE wrist AND sample_idx <= execution) AS sp, quantile_cont(sqrt(pow(x - mx, 2) + pow(y - my, 2) + pow(z - mz, 2)), 0.95) FILTER (WHERE wrist AND sample_idx >= fixation AND x IS NOT NULL) AS ji FROM mx GROUP BY ALL)
SELECT session_id, movement, {r6('CASE WHEN vw >= 0.6 AND va >= 0.6 AND nw >= 2 AND na >= 2 THEN abs(sw - sa) / 30.0::DOUBLE END', 5)} AS hand_foot_settle_difference_sec, {r6('CASE WHEN vh >= 0.6 AND nh >= 3 AND late THEN ji / scale END', 5)} AS fixation_wrist_jitter_ratio,
 {r6('CASE WHEN ve >= 0.6 AND steps >= 2 AND sqrt(pow(zx - ax, 2) + pow(zy - ay, 2) + pow(zz - az, 2)) > 1e-6 THEN path / sqrt(pow(zx - ax, 2) + pow(zy - ay, 2) + pow(zz - az, 2)) END', 5)} AS executing_wrist_path_efficiency, {r6('CASE WHEN ve >= 0.6 THEN sp / scale END', 5)} AS executing_wrist_peak_speed FROM ag""",
)
def h12(spark, sf):
    frames = materialise(whole_frames(spark, sf), "frames")
    moves, _ = scaled(spark, sf, frames)
    out = H.trajectory_metrics(frames, materialise(moves, "movements"), "session_id", "sample_idx", FPS)
    return out.select(*KEY, *[fixed(c, 5).alias(c) for c in out.columns if c not in KEY])


def _transfer(s):
    ax = O.v_sub(_pref("wf", J[f"{s}_ankle"]), _pref("wf", J[f"{_opp(s)}_ankle"]))[:2]
    hip = lambda p: O.v_mid(_pref(p, 11), _pref(p, 12))[:2]
    mv = O.v_sub(hip("wf"), hip("wp"))
    return f"CASE WHEN scale > 0 AND {O.v_norm(ax)} > 1e-9 THEN {O.v_dot(mv, ax)} / {O.v_norm(ax)} / scale END"


@query(
    "h14_weight_transfer",
    f"""WITH {SQL_SCALE}, {_win_pts('preparation', 'wp', (11, 12))}, {_win_pts('fixation', 'wf', (11, 12, 15, 16))}
SELECT session_id, movement, {r6(_side('stance_side', _transfer), 5)} AS pelvis_weight_transfer_ratio FROM mv JOIN scl USING (session_id, movement) JOIN wp USING (session_id, movement) JOIN wf USING (session_id, movement)""",
)
def h14(spark, sf):
    return windows(spark, sf).select(*KEY, fixed(H.weight_transfer("w_preparation", "w_fixation", F.col("stance_side"), F.col("scale"), MIN), 5).alias("pelvis_weight_transfer_ratio"))


_SPAN = f"sqrt(pow(x15 - x16, 2) + pow(y15 - y16, 2)) / scale"


def _height(s):
    return f"CASE WHEN {O.v_norm(_T)} > 1e-6 THEN (z{H.hand(s, 'wrist')} - 0.5 * (z11 + z12)) / {O.v_norm(_T)} END"


@query(
    "h17_stance_and_technique",
    f"""WITH {SQL_FIX}, {_wide([*_BODY, 91, 112], 'cw', 'w')}, v AS (SELECT session_id, movement, {_SPAN} AS sp, {_side('side', _height)} AS ht FROM w JOIN scl USING (session_id, movement) JOIN mv USING (session_id, movement))
SELECT session_id, movement, {_med('sp')} AS stance_span_ratio, {_med('ht')} AS executing_wrist_height_torso_ratio FROM v GROUP BY ALL""",
)
def h17(spark, sf):
    v = lambda m: fixed(H.estimate(H.window_values("c_fixation", m), MIN), 5)
    return windows(spark, sf).select(
        *KEY, v(lambda f: H.stance_span(f, F.col("scale"))).alias("stance_span_ratio"), v(lambda f: H.wrist_height(f, F.col("side"))).alias("executing_wrist_height_torso_ratio")
    )


def _heading(s, p=""):
    big, small, heel = ((f"{p}x{j}", f"{p}y{j}", f"{p}z{j}") for j in H.FOOT[s])
    return O.v_sub(O.v_mid(big, small), heel)


def _yaw(front):
    b = _opp(front)
    hd, ln = _heading(b), O.v_sub(O.pt(f"{front}_ankle"), O.pt(f"{b}_ankle"))
    return f"CASE WHEN {O.v_norm(hd)} / scale BETWEEN {FOOTG[0]} AND {FOOTG[1]} AND {O.v_norm(ln[:2])} / scale >= 0.10 THEN {_flat(hd, ln, False)} END"


@query(
    "h18_back_foot_yaw",
    f"""WITH {SQL_SCALE}, {_wide([*_BODY, *range(17, 23)], 'lp', 'w')}, v AS (SELECT session_id, movement, {_side('stance_side', _yaw)} AS yaw FROM w JOIN mv USING (session_id, movement) JOIN scl USING (session_id, movement) WHERE sample_idx BETWEEN fixation - {R} AND fixation + {R})
SELECT session_id, movement, {_med('yaw')} AS back_foot_yaw_deg, CAST(count(yaw) AS INTEGER) AS samples FROM v GROUP BY ALL""",
)
def h18(spark, sf):
    v = H.window_values("w_fixation", lambda f: H.back_foot_yaw(f, F.col("stance_side"), F.col("scale"), FOOTG))
    return windows(spark, sf).select(*KEY, fixed(H.estimate(v, MIN), 5).alias("back_foot_yaw_deg"), F.size(v).alias("samples"))


def _thigh(s):
    k = [_hj(s, n) for n in H.KNUCKLES]
    wd = O.v_norm(O.v_sub(k[0], k[3]))
    c = _par(_mean([H.hand(s, n) for n in H.KNUCKLES]))
    hip, knee = O.pt(f"{s}_hip"), O.pt(f"{s}_knee")
    th = O.v_sub(knee, hip)
    t = f"greatest(0.0, least(1.0, {O.v_dot(O.v_sub(c, hip), th)} / {O.v_dot(th, th)}))"
    near = tuple(f"({h} + {d} * {t})" for h, d in zip(hip, th))
    return f"CASE WHEN {wd} / scale BETWEEN {PALM[0]} AND {PALM[1]} AND {O.v_dot(th, th)} > 1e-9 THEN {O.v_norm(O.v_sub(c, near))} / {wd} END"


def _brow(s):
    k = [_hj(s, n) for n in H.KNUCKLES]
    wd = O.v_norm(O.v_sub(k[0], k[3]))
    c = _par(_mean([H.hand(s, n) for n in H.KNUCKLES]))
    n = " + ".join(f"(x{j} IS NOT NULL)::INT" for j in H.BROWS)
    fh = tuple(f"(({' + '.join(f'coalesce({a}{j}, 0.0)' for j in H.BROWS)}) / nullif({n}, 0))" for a in "xyz")
    return f"CASE WHEN {wd} > 1e-9 AND {wd} / scale BETWEEN {PALM[0]} AND {PALM[1]} AND {O.v_norm(_EYES)} / scale BETWEEN {EYE[0]} AND {EYE[1]} AND ({n}) >= 4 THEN {O.v_norm(O.v_sub(c, fh))} / {wd} END"


@query(
    "h19_h20_fist_distances",
    f"""WITH {SQL_SCALE}, {_wide([*_BODY, *_FACE, *H.BROWS, *_HANDS], 'lp', 'w')}, v AS (SELECT session_id, movement, {_side('side', _thigh)} AS th, {_side('side', _brow)} AS br FROM w JOIN mv USING (session_id, movement) JOIN scl USING (session_id, movement) WHERE sample_idx BETWEEN fixation - {R} AND fixation + {R})
SELECT session_id, movement, {_med('th')} AS fist_to_thigh_fist_ratio, {_med('br')} AS fist_to_forehead_fist_ratio FROM v GROUP BY ALL""",
)
def h19(spark, sf):
    side, scale = F.col("side"), F.col("scale")
    v = lambda m: fixed(H.estimate(H.window_values("w_fixation", m), MIN), 5)
    return windows(spark, sf).select(
        *KEY, v(lambda f: H.fist_to_thigh(f, side, scale, PALM)).alias("fist_to_thigh_fist_ratio"), v(lambda f: H.fist_to_forehead(f, side, scale, PALM, EYE)).alias("fist_to_forehead_fist_ratio")
    )


def _hl(s):
    return f"(z{J[f'{s}_ankle']} - 0.5 * (z11 + z12)) / scale"


def _pv(s):
    a, b = _heading(_opp(s), "a."), _heading(_opp(s), "b.")
    return f"CASE WHEN {O.v_norm(a)} / scale BETWEEN {FOOTG[0]} AND {FOOTG[1]} AND {O.v_norm(b)} / scale BETWEEN {FOOTG[0]} AND {FOOTG[1]} THEN {_flat(a, b, False)} END"


@query(
    "h21_kick_metrics",
    f"""WITH {SQL_SCALE}, {_wide([*_BODY, *range(17, 23)], 'lp', 'w')}, kk AS (SELECT w.*, side, scale, kick_apex, rechamber, preparation, fixation FROM w JOIN mv USING (session_id, movement) JOIN scl USING (session_id, movement) WHERE kick_apex IS NOT NULL),
ap AS (SELECT session_id, movement, max(fixation - rechamber) AS g, {_med(_side('side', lambda s: O.angle(f'{s}_hip', f'{s}_knee', f'{s}_ankle', 1e-9)))} AS ext, {_med(_side('side', _hl))} AS hgt FROM kk WHERE sample_idx BETWEEN kick_apex - {R} AND kick_apex + {R} GROUP BY ALL),
rc AS (SELECT session_id, movement, {_med(_side('side', lambda s: O.angle(f'{s}_hip', f'{s}_knee', f'{s}_ankle', 1e-9)))} AS re FROM kk WHERE sample_idx BETWEEN rechamber - {R} AND rechamber + {R} GROUP BY ALL),
pv AS (SELECT a.session_id, a.movement, {_med(_side('a.side', _pv).replace('scale', 'a.scale'))} AS pv FROM kk a JOIN kk b ON a.session_id = b.session_id AND a.movement = b.movement AND a.sample_idx BETWEEN a.preparation - {R} AND a.preparation + {R} AND b.sample_idx BETWEEN b.kick_apex - {R} AND b.kick_apex + {R} GROUP BY ALL)
SELECT session_id, movement, ext AS kick_knee_extension_deg, hgt AS kick_ankle_height_ratio, re AS kick_rechamber_knee_deg, pv AS support_foot_pivot_deg, {r6('g / 30.0::DOUBLE')} AS landing_to_punch_sec FROM ap JOIN rc USING (session_id, movement) LEFT JOIN pv USING (session_id, movement)""",
)
def h21(spark, sf):
    side, scale = F.col("side"), F.col("scale")
    v = lambda w, m: fixed(H.estimate(H.window_values(w, m), MIN), 5)
    rows = windows(spark, sf).where("kick_apex IS NOT NULL")
    return rows.select(
        *KEY, v("w_kick_apex", lambda f: H.front_knee(f, side)).alias("kick_knee_extension_deg"), v("w_kick_apex", lambda f: H.ankle_height(f, side, scale)).alias("kick_ankle_height_ratio"),
        v("w_rechamber", lambda f: H.front_knee(f, side)).alias("kick_rechamber_knee_deg"),
        fixed(H.support_pivot("w_preparation", "w_kick_apex", H.other_side(side), scale, FOOTG, MIN), 5).alias("support_foot_pivot_deg"),
        fixed((F.col("fixation") - F.col("rechamber")) / FPS).alias("landing_to_punch_sec"),
    )


def _h1f(s):
    return f"CASE WHEN 0.5 * (z5 + z6) - 0.5 * (z11 + z12) > 1e-6 THEN (z{H.hand(s, 'wrist')} - 0.5 * (z11 + z12)) / (0.5 * (z5 + z6) - 0.5 * (z11 + z12)) END"


@query(
    "h21b_single_frame_metrics",
    f"""WITH {SQL_SCALE}, fx AS (SELECT lp.* FROM lp JOIN mv USING (session_id, movement) WHERE sample_idx = fixation), {_wide([*_BODY, *_FACE, *_HANDS], 'fx', 'w')} SELECT session_id, movement, {r6(_LEAN, 5)} AS torso_lean_deg, {r6(_flat(_SH, _HP, True), 5)} AS shoulder_hip_twist_deg, {r6(_HEAD, 5)} AS head_torso_yaw_mismatch_deg,
 {r6(_side('side', _hik), 5)} AS reaction_hand_hip_distance_ratio, {r6(_side('side', _align), 5)} AS wrist_forearm_alignment_deg, {r6(_side('side', _closure), 5)} AS fist_closure_ratio, {r6(_SPAN, 5)} AS stance_span_ratio, {r6(_side('side', _h1f), 5)} AS wrist_height_ratio
FROM w JOIN scl USING (session_id, movement) JOIN mv USING (session_id, movement) WHERE sample_idx = fixation""",
)
def h21b(spark, sf):
    side, scale = F.col("side"), F.col("scale")
    rows = windows(spark, sf).withColumn("w_one", F.filter("w_fixation", lambda f: f["i"] == F.col("fixation")))
    metrics = {
        "torso_lean_deg": H.torso_lean, "shoulder_hip_twist_deg": H.twist, "head_torso_yaw_mismatch_deg": lambda f: H.head_mismatch(f, scale, EYE),
        "reaction_hand_hip_distance_ratio": lambda f: H.hikite(f, H.other_side(side), scale), "wrist_forearm_alignment_deg": lambda f: H.wrist_alignment(f, side, scale, PALM),
        "fist_closure_ratio": lambda f: H.fist_closure(f, side, scale, PALM), "stance_span_ratio": lambda f: H.stance_span(f, scale), "wrist_height_ratio": lambda f: H.wrist_height_single(f, side),
    }
    single = {n: F.get(F.transform("w_one", m), F.lit(0)) for n, m in metrics.items()}
    return rows.select(*KEY, *[fixed(c, 5).alias(n) for n, c in single.items()])


@query(
    "h22_role_resolution",
    """WITH t AS (SELECT l_orderkey AS movement_id, l_linenumber AS ord, CASE l_returnflag WHEN 'A' THEN 'left' WHEN 'R' THEN 'right' ELSE 'both' END AS side, CASE WHEN l_partkey % 4 = 0 THEN 'kick' ELSE 'T' || l_partkey % 9 END AS technique, l_partkey, l_suppkey FROM lineitem),
f AS (SELECT *, row_number() OVER (PARTITION BY movement_id ORDER BY ord, l_partkey, l_suppkey, technique) AS rk FROM t WHERE side <> 'both' AND technique <> 'kick')
SELECT o_orderkey AS movement_id, side AS executing_side, technique, CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 'left' ELSE 'right' END AS stance_side,
 coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END, CASE WHEN o_orderkey % 3 = 1 THEN o_custkey + 1 END, o_custkey + 9) AS execution_anchor FROM orders LEFT JOIN f ON f.movement_id = o_orderkey AND rk = 1""",
)
def h22(spark, sf):
    """First sided technique that is not a kick; anchors by precedence."""
    side = F.when(F.col("l_returnflag") == "A", "left").when(F.col("l_returnflag") == "R", "right").otherwise("both")
    tech = F.when(F.col("l_partkey") % 4 == 0, "kick").otherwise(F.concat(F.lit("T"), (F.col("l_partkey") % 9).cast("string")))
    t = T.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("movement_id"), F.struct(F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), tech.alias("technique"), side.alias("side")).alias("t"))
    first = t.where("t.side <> 'both' AND t.technique <> 'kick'").groupBy("movement_id").agg(F.min("t").alias("t"))
    o, n = T.read(spark, sf, "orders"), F.col("o_orderkey") % 3
    rows = o.select(
        F.col("o_orderkey").alias("movement_id"), F.when(F.col("o_orderpriority").rlike("^[12]"), "left").otherwise("right").alias("stance_side"),
        F.coalesce(F.when(n == 0, F.col("o_custkey")), F.when(n == 1, F.col("o_custkey") + 1), F.col("o_custkey") + 9).alias("execution_anchor"),
    )
    return rows.join(first, "movement_id", "left").select("movement_id", F.col("t.side").alias("executing_side"), F.col("t.technique").alias("technique"), "stance_side", "execution_anchor")


# column of a metric in the queries above, where it differs
_NAMES = {
    "back_foot_yaw_to_stance_direction_deg": "back_foot_yaw_deg", "executing_wrist_peak_speed_body_scale_per_sec": "executing_wrist_peak_speed", "arae_fist_to_thigh_fist_ratio": "fist_to_thigh_fist_ratio",
    "eolgul_fist_to_forehead_fist_ratio": "fist_to_forehead_fist_ratio", "kick_ankle_height_body_scale_ratio": "kick_ankle_height_ratio", "kick_landing_to_punch_sec": "landing_to_punch_sec",
}


def all_metrics(spark, sf):
    """Every metric of every movement as rows (movement, metric, value), with what annotation needs, from one build of the windows."""
    frames = materialise(whole_frames(spark, sf), "frames")
    moves, labelled = scaled(spark, sf, frames)
    moves = materialise(moves, "movements")
    rows = H.anchor_windows(frames, moves, "session_id", "sample_idx", R).withColumn("c_fixation", H.completed("w_fixation", R, MIN))
    side, front, scale = F.col("side"), F.col("stance_side"), F.col("scale")
    fixed_at = lambda m, p=0.5: H.estimate(H.window_values("c_fixation", m), MIN, p)
    plain_at = lambda w, m: H.estimate(H.window_values(w, m), MIN)
    values = {
        "torso_lean_p95_deg": fixed_at(H.torso_lean, 0.95), "back_foot_yaw_to_stance_direction_deg": plain_at("w_fixation", lambda f: H.back_foot_yaw(f, front, scale, FOOTG)), "shoulder_hip_twist_deg": fixed_at(H.twist),
        "head_torso_yaw_mismatch_deg": fixed_at(lambda f: H.head_mismatch(f, scale, EYE)), "expected_side_dominance_ratio": H.side_dominance("w_preparation", "w_execution", side, MIN),
        "reaction_hand_hip_distance_ratio": fixed_at(lambda f: H.hikite(f, H.other_side(side), scale)), "wrist_forearm_alignment_deg": fixed_at(lambda f: H.wrist_alignment(f, side, scale, PALM)), "fist_closure_ratio": fixed_at(lambda f: H.fist_closure(f, side, scale, PALM)),
        "pelvis_weight_transfer_ratio": H.weight_transfer("w_preparation", "w_fixation", front, scale, MIN), "stance_span_ratio": fixed_at(lambda f: H.stance_span(f, scale)), "front_knee_deg": plain_at("w_fixation", lambda f: H.front_knee(f, front)),
        "executing_wrist_height_torso_ratio": fixed_at(lambda f: H.wrist_height(f, side)), "executing_elbow_deg": plain_at("w_fixation", lambda f: H.executing_elbow(f, side)),
        "arae_fist_to_thigh_fist_ratio": plain_at("w_fixation", lambda f: H.fist_to_thigh(f, side, scale, PALM)), "eolgul_fist_to_forehead_fist_ratio": plain_at("w_fixation", lambda f: H.fist_to_forehead(f, side, scale, PALM, EYE)),
        "kick_knee_extension_deg": plain_at("w_kick_apex", lambda f: H.front_knee(f, side)), "kick_ankle_height_body_scale_ratio": plain_at("w_kick_apex", lambda f: H.ankle_height(f, side, scale)),
        "kick_rechamber_knee_deg": plain_at("w_rechamber", lambda f: H.front_knee(f, side)), "support_foot_pivot_deg": H.support_pivot("w_preparation", "w_kick_apex", H.other_side(side), scale, FOOTG, MIN),
        "kick_landing_to_punch_sec": (F.col("fixation") - F.col("rechamber")) / FPS,
    }
    # stored once: the expressions are long, and every row below reads them
    own = materialise(rows.select(*moves.columns, *[fixed(v, 5).alias(m) for m, v in values.items()]), "metrics")
    paths = H.trajectory_metrics(frames, moves, "session_id", "sample_idx", FPS)
    paths = paths.select(*KEY, *[fixed(c, 5).alias({"executing_wrist_peak_speed": "executing_wrist_peak_speed_body_scale_per_sec"}.get(c, c)) for c in paths.columns if c not in KEY])
    covered = H.group_coverage(labelled, "session_id")
    covered = covered.select(*KEY, F.create_map(*[c for g in GROUP_RANGES for c in (F.lit(g), F.col(f"coverage_{g}"))]).alias("coverage"))
    seen = labelled.groupBy(*KEY).agg(F.collect_list(F.struct(F.col("sample_idx").alias("i"), S.visibility("pts").alias("s"))).alias("seen"))
    wide = own.join(paths, KEY, "left").join(covered, KEY, "left").join(seen, KEY, "left")
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m, *_ in S.METRICS])
    return wide.select(*moves.columns, "coverage", "seen", F.inline(entries))


def screened(spark, sf):
    return S.screened(all_metrics(spark, sf), S.rules(spark))


def annotated(spark, sf):
    return S.annotated(screened(spark, sf), R)


def _values_of(name: str, metrics: str) -> str:
    own = {v: k for k, v in _NAMES.items()}
    return " UNION ALL ".join(f"SELECT session_id, movement, '{own.get(m, m)}' AS metric, CAST({m} AS DOUBLE) AS value FROM ({ORACLES[name]})" for m in metrics.split())


def _text(value) -> str:
    return "NULL" if value is None else f"{value}::DOUBLE" if isinstance(value, float) else f"{value!r}" if isinstance(value, str) else f"{value!r}::{'INTEGER' if not value or isinstance(value[0], int) else 'VARCHAR'}[]"


def _spans(first: bool) -> str:
    edge = (lambda a: f"greatest(start_frame, {a} - {R})") if first else (lambda a: f"least(end_frame, {a} + {R})")
    ends = {"preparation_to_execution": ("preparation", "execution"), "preparation_to_kick_apex": ("preparation", "kick_apex"), "landing_to_punch_execution": ("rechamber", "fixation")}
    cases = [("fixation_window", edge("fixation")), ("kick_apex_window", edge("kick_apex")), ("kick_rechamber_window", edge("rechamber")), *[(k, v[0 if first else 1]) for k, v in ends.items()]]
    return "CASE scope " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in cases) + " END"


SQL_SCREENED = f"""{SQL_MOVES}, me AS ({' UNION ALL '.join([
    _values_of('h2_window_estimate', 'front_knee_deg executing_elbow_deg'), _values_of('h5_h7_posture_metrics', 'torso_lean_p95_deg shoulder_hip_twist_deg head_torso_yaw_mismatch_deg'), _values_of('h8_side_dominance', 'expected_side_dominance_ratio'),
    _values_of('h9_h11_hand_metrics', 'reaction_hand_hip_distance_ratio wrist_forearm_alignment_deg fist_closure_ratio'),
    _values_of('h12_h16_trajectory_metrics', 'hand_foot_settle_difference_sec fixation_wrist_jitter_ratio executing_wrist_path_efficiency executing_wrist_peak_speed'), _values_of('h14_weight_transfer', 'pelvis_weight_transfer_ratio'),
    _values_of('h17_stance_and_technique', 'stance_span_ratio executing_wrist_height_torso_ratio'), _values_of('h18_back_foot_yaw', 'back_foot_yaw_deg'), _values_of('h19_h20_fist_distances', 'fist_to_thigh_fist_ratio fist_to_forehead_fist_ratio'),
    _values_of('h21_kick_metrics', 'kick_knee_extension_deg kick_ankle_height_ratio kick_rechamber_knee_deg support_foot_pivot_deg landing_to_punch_sec')])}),
ru(metric, technique, stance_family, side, stance_side, family, unit, criterion, scope, groups, joints, op, lo, hi) AS (VALUES {', '.join('(' + ', '.join(map(_text, r)) + ')' for r in S.rule_rows())}),
sc AS (SELECT mv.*, ru.metric, value, family, unit, criterion, scope, groups, joints, op, lo, hi, CASE op WHEN 'max' THEN value - hi WHEN 'min' THEN lo - value WHEN 'range' THEN CASE WHEN value < lo THEN lo - value WHEN value > hi THEN value - hi ELSE -least(value - lo, hi - value) END END AS margin
 FROM mv JOIN ru ON ru.technique = mv.technique AND ru.stance_family = mv.stance_family AND ru.side = mv.side AND ru.stance_side = mv.stance_side LEFT JOIN me ON me.session_id = mv.session_id AND me.movement = mv.movement AND me.metric = ru.metric),
ss AS (SELECT *, margin / greatest(CASE op WHEN 'max' THEN abs(hi) WHEN 'min' THEN abs(lo) ELSE CASE WHEN value < lo THEN abs(lo) WHEN value > hi THEN abs(hi) ELSE abs(hi - lo) END END, 1e-9) AS norm, {_spans(True)} AS window_start, {_spans(False)} AS window_end,
 CASE WHEN op IS NULL THEN 'measured_diagnostic_only' WHEN value IS NULL THEN 'not_measurable' WHEN margin > 0 THEN 'review_candidate' ELSE 'within_screening_range' END AS status FROM sc)"""
_WHY = f"""gc AS (SELECT session_id, movement, {', '.join(f"avg((x IS NOT NULL)::INT) FILTER (WHERE j BETWEEN {lo} AND {hi}) AS {g}" for g, (lo, hi) in GROUP_RANGES.items())} FROM lp GROUP BY ALL),
gf AS (SELECT session_id, movement, [g FOR g IN [{', '.join(f"CASE WHEN {g} < 0.75 THEN '{g}' END" for g in GROUP_RANGES)}] IF g IS NOT NULL] AS failing FROM gc),
jn AS (SELECT q.session_id, q.movement, metric, place, j, sum(v) AS n, any_value(window_end - window_start + 1) AS f FROM (SELECT s.session_id, s.movement, metric, window_start, window_end, unnest(joints) AS jj, unnest(range(len(joints))) AS place FROM ss s) q
 JOIN (SELECT session_id, movement, sample_idx, j, (x IS NOT NULL)::INT AS v FROM lp) l ON l.session_id = q.session_id AND l.movement = q.movement AND l.j = jj AND sample_idx BETWEEN window_start AND window_end GROUP BY ALL),
jm AS (SELECT session_id, movement, metric, list(CAST(n AS INTEGER) ORDER BY place) AS joint_samples, coalesce(list(j ORDER BY place) FILTER (WHERE n < 0.75 * f), []) AS missing_joints FROM jn GROUP BY ALL),
an AS (SELECT ss.*, coalesce(joint_samples, []) AS joint_samples, coalesce(missing_joints, []) AS missing_joints, list_filter(groups, lambda g: list_contains(failing, g)) AS failed_groups, CASE WHEN status = 'not_measurable' THEN CASE WHEN len(list_filter(groups, lambda g: list_contains(failing, g))) > 0 THEN 'segment_group_coverage_below_minimum'
  WHEN len(coalesce(missing_joints, [])) > 0 THEN 'required_joint_window_coverage_below_minimum' ELSE 'metric_geometry_implausible_or_trajectory_evidence_insufficient' END END AS why
 FROM ss JOIN gf USING (session_id, movement) LEFT JOIN jm USING (session_id, movement, metric))"""


@query("h23_screening", f"WITH {SQL_SCREENED} SELECT session_id, movement, metric, family, unit, criterion, op AS operator, {r6('value', 5)} AS value, status, {r6('margin', 5)} AS threshold_margin, {r6('norm')} AS normalized_margin FROM ss")
def h23(spark, sf):
    """All 24 metrics of every movement against the rule table: 19 limits by technique and stance, the rest diagnostic only."""
    return screened(spark, sf).select(*KEY, "metric", "family", "unit", "criterion", "operator", fixed("value", 5).alias("value"), "status", fixed("margin", 5).alias("threshold_margin"), fixed("norm").alias("normalized_margin"))


@query("h24_evidence_annotation", f"WITH {SQL_SCREENED}, {_WHY} SELECT session_id, movement, metric, scope, window_start, window_end, failed_groups, joint_samples, missing_joints, why AS not_measurable_reason FROM an")
def h24(spark, sf):
    return annotated(spark, sf).select(*KEY, "metric", "scope", "window_start", "window_end", "failed_groups", "joint_samples", "missing_joints", "not_measurable_reason")


@query(
    "h25_coverage_summary",
    f"""WITH {SQL_SCREENED}, c AS (SELECT session_id, count(*) AS metric_count, count(*) FILTER (WHERE op IS NOT NULL) AS thresholded, count(*) FILTER (WHERE op IS NOT NULL AND value IS NOT NULL) AS measurable, count(*) FILTER (WHERE status = 'review_candidate') AS candidates,
 count(*) FILTER (WHERE status = 'within_screening_range') AS within FROM ss GROUP BY ALL) SELECT *, {r6('measurable / thresholded')} AS coverage_ratio, measurable >= 0.9 * thresholded AS coverage_passed FROM c""",
)
def h25(spark, sf):
    return S.coverage_summary(screened(spark, sf), ["session_id"]).withColumn("coverage_ratio", fixed("coverage_ratio"))


@query(
    "h25_family_and_reason_counts",
    f"WITH {SQL_SCREENED}, {_WHY} SELECT session_id, 'candidate_family' AS kind, family AS name, count(*) AS n FROM an WHERE status = 'review_candidate' GROUP BY ALL UNION ALL SELECT session_id, 'not_measurable_reason', why, count(*) FROM an WHERE status = 'not_measurable' GROUP BY ALL",
)
def h25b(spark, sf):
    return S.status_counts(annotated(spark, sf), ["session_id"])


@query(
    "h25_candidate_events",
    f"""WITH {SQL_SCREENED} SELECT 'WB-' || session_id || '-' || movement || '-' || metric AS event_id, session_id, movement, family, metric, criterion, {r6('value', 5)} AS value, unit, {r6('margin', 5)} AS threshold_margin, 'review_candidate_not_deduction' AS decision_status, 'pending' AS human_review_status,
 'blocked_unvalidated_screening_threshold' AS rule_eligibility FROM ss WHERE status = 'review_candidate'""",
)
def h25c(spark, sf):
    events = S.candidate_events(screened(spark, sf), KEY)
    return events.select("event_id", *KEY, "family", "metric", "criterion", fixed("value", 5).alias("value"), "unit", fixed("margin", 5).alias("threshold_margin"), "decision_status", "human_review_status", "rule_eligibility")


@query(
    "h26_movement_evidence",
    f"""WITH {T.SQL_LONG}, mv AS (SELECT session_id, m AS movement, m * 8 AS lo, least(m * 8 + 7, n - 1) AS hi, least(m * 8 + 5, n - 1) AS fx FROM (SELECT session_id, count(*) AS n FROM f0 GROUP BY ALL), unnest(range(0, (n + 7) // 8)) u(m)),
l AS (SELECT mv.*, sample_idx, x, used_cameras, reproj_px FROM mv JOIN p3 ON p3.session_id = mv.session_id AND sample_idx BETWEEN lo AND hi),
s AS (SELECT session_id, movement, avg(CASE WHEN x IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS r, median(used_cameras) AS c, median(reproj_px) AS e, avg(CASE WHEN x IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (WHERE sample_idx = fx) AS ar, median(used_cameras) FILTER (WHERE sample_idx = fx) AS ac FROM l GROUP BY ALL)
SELECT session_id, movement, {r6('r')} AS valid_ratio, {r6('c')} AS median_cameras, {r6('e')} AS median_error_px, CASE WHEN r >= 0.9 AND c >= 2 THEN 'observed' WHEN r >= 0.7 THEN 'partial' ELSE 'not_measurable' END AS segment_status,
 CASE WHEN ar >= 0.9 AND ac >= 2 THEN 'observed' WHEN ar >= 0.7 THEN 'partial' ELSE 'not_measurable' END AS anchor_status FROM s""",
)
def h26(spark, sf):
    points = T.pose3d(spark, sf).select("session_id", "sample_idx", "x", "used_cameras", "reproj_px")
    moves = materialise(movements(spark, sf), "movements")
    rows = materialise(H.segment_frames(points, moves, "session_id", "sample_idx", "start_frame", "end_frame", ["fixation"]), "labelled")
    seen = F.when(F.col("x").isNotNull(), 1.0).otherwise(0.0)
    here = F.col("sample_idx") == F.col("fixation")
    plain = rows.groupBy(*KEY).agg(F.avg(seen).alias("r"), F.avg(F.when(here, seen)).alias("ar"))
    tall = rows.select(*KEY, F.inline(F.array(
        F.struct(F.lit("c").alias("k"), F.col("used_cameras").cast("double").alias("v")), F.struct(F.lit("e").alias("k"), F.col("reproj_px").alias("v")), F.struct(F.lit("a").alias("k"), F.when(here, F.col("used_cameras")).cast("double").alias("v")))))
    q = exact_quantiles(tall, [*KEY, "k"], F.col("v"), {"m": 0.5}).groupBy(*KEY).agg(*[F.max(F.when(F.col("k") == k, F.col("m"))).alias(k) for k in "cea"])
    out = plain.join(q, KEY)
    return out.select(
        *KEY, fixed("r").alias("valid_ratio"), fixed("c").alias("median_cameras"), fixed("e").alias("median_error_px"), H.evidence_status(F.col("r"), F.col("c")).alias("segment_status"), H.evidence_status(F.col("ar"), F.col("a")).alias("anchor_status")
    )
