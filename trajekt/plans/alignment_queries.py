"""B: alignment queries over event series and views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.numeric import count_where, fixed
from ..operators import align as A
from ..operators.blocks import DAY_US, index_block, ordinal, running_total, time_block
from ..operators.quantiles import exact_quantiles
from ..session import materialise
from . import tables as T
from .registry import query

r6 = T.r6
HOUR = 3_600_000_000
PERIOD_NS = 6.0 * 3600 * 1e9
TOL_US = 2 * HOUR


def _block():
    return time_block("t_us", DAY_US)

SQL_TIMELINE = f"""en AS (SELECT user_id, event_type, min(t_us * 1000) AS a, max(t_us * 1000) AS z, count(*) AS n FROM ev GROUP BY ALL),
sp AS (SELECT user_id, max(a) AS s, min(z) AS e FROM en GROUP BY user_id HAVING count(*) >= 2 AND min(n) >= 2 AND min(z) > max(a)),
tl AS (SELECT user_id, i AS output_idx, CAST(s + round_even(i * {PERIOD_NS}::DOUBLE, 0) AS BIGINT) AS target_t FROM sp, unnest(range(0, CAST(floor((e - s) / {PERIOD_NS}::DOUBLE + 1e-9) AS BIGINT) + 1)) u(i)
  WHERE s + round_even(i * {PERIOD_NS}::DOUBLE, 0) <= e)"""


def stream(spark, sf, kind):
    return T.read(spark, sf, "events").where(F.col("event_type") == kind).select("user_id", "event_id", T.micros("ts").alias("t_us"), "value")


@query("b1_common_timeline", f"WITH {T.SQL_SERIES}, {SQL_TIMELINE} SELECT user_id, output_idx, target_t FROM tl")
def b1(spark, sf):
    ns = T.read(spark, sf, "events").select("user_id", "event_type", (T.micros("ts") * 1000).alias("t_ns"))
    return A.common_timeline(ns, "user_id", "event_type", "t_ns", PERIOD_NS)


SQL_NEAR = """src AS (SELECT user_id, event_id AS src_id, t_us AS src_t FROM ev WHERE event_type = 'view'), tgt AS (SELECT user_id, event_id, t_us FROM ev WHERE event_type = 'click'),
nr AS (SELECT t.user_id, t.event_id, t.t_us, s.src_id, s.src_t, row_number() OVER (PARTITION BY t.event_id ORDER BY abs(s.src_t - t.t_us), s.src_t) AS rk FROM tgt t JOIN src s USING (user_id)),
nm AS (SELECT * FROM nr WHERE rk = 1)"""


def click_to_view(spark, sf):
    views = stream(spark, sf, "view").select("user_id", "t_us", F.col("event_id").alias("src_id"))
    clicks = stream(spark, sf, "click").select("user_id", "t_us", "event_id")
    return A.nearest(clicks, views, ["user_id"], "t_us", ["src_id"], _block()), views


@query("b2_nearest_timestamp_join", f"WITH {T.SQL_SERIES}, {SQL_NEAR} SELECT user_id, event_id, src_id, src_t - t_us AS residual_us FROM nm")
def b2(spark, sf):
    near, _ = click_to_view(spark, sf)
    return near.where("near IS NOT NULL").select("user_id", "event_id", F.col("near.src_id").alias("src_id"), (F.col("near.t_us") - F.col("t_us")).alias("residual_us"))


@query(
    "b3_mapping_report",
    f"""WITH {T.SQL_SERIES}, {SQL_NEAR}, c AS (SELECT user_id, src_id, count(*) AS c FROM nm GROUP BY ALL), n AS (SELECT user_id, count(*) AS source_count FROM src GROUP BY ALL),
u AS (SELECT user_id, count(*) FILTER (WHERE c > 1) AS source_reused, CAST(sum(c - 1) AS BIGINT) AS repeated_outputs, count(*) AS used, CAST(sum(c) AS BIGINT) AS output_count FROM c GROUP BY ALL),
r AS (SELECT user_id, max(abs(src_t - t_us) / 1000.0::DOUBLE) AS mx, median(abs(src_t - t_us) / 1000.0::DOUBLE) AS md, quantile_cont(abs(src_t - t_us) / 1000.0::DOUBLE, 0.95) AS p, count(*) FILTER (WHERE abs(src_t - t_us) > 0.75 * {HOUR}) AS lg FROM nm GROUP BY ALL)
SELECT user_id, source_count, output_count, source_count - used AS source_unused, source_reused, repeated_outputs, {r6('mx', 3)} AS max_residual, {r6('md', 3)} AS median_residual, {r6('p', 3)} AS p95_residual, lg AS large_residuals
FROM n JOIN u USING (user_id) JOIN r USING (user_id)""",
)
def b3(spark, sf):
    near, views = click_to_view(spark, sf)
    near = materialise(near, "nearest")
    out = A.mapping_report(near, views, ["user_id"], "t_us", "src_id", float(HOUR), 1000.0)
    return out.withColumns({c: fixed(c, 3) for c in ("max_residual", "median_residual", "p95_residual")})


SQL_RIG = """rig AS (SELECT s_nationkey AS session_id, s_suppkey AS camera_id, 100 + s_suppkey % 50 AS frame_count, CAST(25 + (s_suppkey % 3) * 2.5 AS DOUBLE) AS fps,
 s_suppkey % 7 - 3 AS frame_offset, CAST((s_suppkey % 5) * 0.01 AS DOUBLE) AS time_offset_sec FROM supplier)"""


def rig(spark, sf):
    key = F.col("s_suppkey")
    return T.read(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("session_id"), key.alias("camera_id"), (100 + key % 50).alias("frame_count"),
        (F.lit(25.0) + (key % 3) * F.lit(2.5)).alias("fps"), (key % 7 - 3).alias("frame_offset"), ((key % 5) * F.lit(0.01)).alias("time_offset_sec"),
    )


@query(
    "b4_multi_rate_frame_map",
    f"""WITH {SQL_RIG}, o AS (SELECT *, time_offset_sec + frame_offset / fps AS off FROM rig),
b AS (SELECT session_id, max(off) AS s, min(off + (frame_count - 1) / fps) AS e, min(fps) AS f FROM o GROUP BY ALL),
g AS (SELECT session_id, f, i FROM b, unnest(range(CAST(ceil(s * f - 1e-9) AS BIGINT), CAST(floor(e * f + 1e-9) AS BIGINT) + 1)) u(i)),
l AS (SELECT g.session_id, i, i / f AS t, camera_id, frame_count, CAST(round_even((i / f - off) * fps, 0) AS BIGINT) AS li FROM g JOIN o USING (session_id)),
k AS (SELECT session_id, i FROM l GROUP BY ALL HAVING bool_and(li >= 0 AND li < frame_count))
SELECT session_id, i AS global_frame_idx, {r6('t')} AS t_sec, camera_id, li AS local_frame_idx FROM l JOIN k USING (session_id, i)""",
)
def b4(spark, sf):
    out = A.synchronised_frames(rig(spark, sf), "session_id", "camera_id")
    return out.withColumn("t_sec", fixed("t_sec"))


@query("b5_effective_rate", f"WITH {SQL_RIG} SELECT session_id, least(26.0::DOUBLE, min(fps)) AS fps FROM rig GROUP BY ALL")
def b5(spark, sf):
    return rig(spark, sf).groupBy("session_id").agg(F.least(F.lit(26.0), F.min("fps")).alias("fps"))


@query(
    "b6_offset_overlap",
    f"""WITH {SQL_RIG} SELECT session_id, max(frame_offset) AS first_global, min(frame_offset + frame_count) AS end_global,
 greatest(0, min(frame_offset + frame_count) - max(frame_offset)) AS common_frames FROM rig GROUP BY ALL""",
)
def b6(spark, sf):
    start, stop = F.max("frame_offset"), F.min(F.col("frame_offset") + F.col("frame_count"))
    return rig(spark, sf).groupBy("session_id").agg(
        start.alias("first_global"), stop.alias("end_global"), F.greatest(F.lit(0).cast("long"), stop - start).alias("common_frames")
    )


@query(
    "b7_tolerance_match",
    f"""WITH {T.SQL_SERIES}, {SQL_NEAR}, k AS (SELECT *, row_number() OVER (PARTITION BY src_id ORDER BY t_us, event_id) AS r2 FROM nm WHERE abs(src_t - t_us) <= {TOL_US})
SELECT user_id, event_id AS pred_id, src_id AS truth_id, {r6('(src_t - t_us) / 1000.0::DOUBLE', 3)} AS time_delta_ms FROM k WHERE r2 = 1""",
)
def b7(spark, sf):
    truth = stream(spark, sf, "view").select("user_id", "t_us", F.col("event_id").alias("truth_id"))
    pred = stream(spark, sf, "click").select("user_id", "t_us", F.struct("t_us", "event_id").alias("pred_order"))
    out = A.match_one_to_one(pred, truth, ["user_id"], "t_us", "pred_order", "truth_id", TOL_US, _block())
    return out.select("user_id", F.col("pred_order.event_id").alias("pred_id"), "truth_id", fixed(F.col("delta") / 1000.0, 3).alias("time_delta_ms"))


@query(
    "b8_frame_index_join",
    f"""WITH {T.SQL_SERIES}, t AS (SELECT user_id, t_us // {HOUR} AS frame, max_by(event_id, t_us) AS truth_id FROM ev WHERE event_type = 'view' GROUP BY ALL)
SELECT e.user_id, e.event_id AS pred_id, truth_id, frame FROM ev e JOIN t ON e.user_id = t.user_id AND e.t_us // {HOUR} = frame WHERE event_type = 'click'""",
)
def b8(spark, sf):
    frame = F.floor(F.col("t_us") / HOUR)
    truth = stream(spark, sf, "view").groupBy("user_id", frame.alias("frame")).agg(F.max_by("event_id", "t_us").alias("truth_id"))
    pred = stream(spark, sf, "click").select("user_id", F.col("event_id").alias("pred_id"), frame.alias("frame"))
    return pred.join(truth, ["user_id", "frame"]).select("user_id", "pred_id", "truth_id", "frame")


@query(
    "b8_positional_join",
    f"""WITH {T.SQL_SERIES}, a AS (SELECT user_id, event_id AS pred_id, row_number() OVER (PARTITION BY user_id ORDER BY t_us, event_id) - 1 AS position FROM ev WHERE event_type = 'click'),
b AS (SELECT user_id, event_id AS truth_id, row_number() OVER (PARTITION BY user_id ORDER BY t_us, event_id) - 1 AS position FROM ev WHERE event_type = 'view')
SELECT user_id, position, pred_id, truth_id FROM a JOIN b USING (user_id, position)""",
)
def b8p(spark, sf):
    place = lambda k, n: ordinal(stream(spark, sf, k), ["user_id"], ["t_us", "event_id"], _block(), "position").select("user_id", "position", F.col("event_id").alias(n))
    return place("click", "pred_id").join(place("view", "truth_id"), ["user_id", "position"])


@query(
    "b9_inferred_rate",
    f"""WITH {T.SQL_SERIES}, d AS (SELECT user_id, (t_us - lag(t_us) OVER (PARTITION BY user_id ORDER BY idx)) / 1e6::DOUBLE AS d FROM ev)
SELECT user_id, {r6('1.0 / median(d)', 9)} AS fps FROM d WHERE d > 0 GROUP BY ALL""",
)
def b9(spark, sf):
    s = T.series(spark, sf).withColumn("t_sec", F.col("t_us") / 1e6)
    return A.inferred_rate(s, ["user_id"], "idx", "t_sec").select("user_id", fixed("fps", 9).alias("fps"))


@query(
    "b10_joint_name_mapping",
    """WITH p AS (SELECT DISTINCT 'NATION_' || c_nationkey AS name FROM customer), t AS (SELECT n_name AS name FROM nation),
x AS (SELECT DISTINCT 'NATION_' || s_nationkey AS name FROM supplier UNION SELECT r_name FROM region)
SELECT name, 'mapped' AS verdict FROM p JOIN t USING (name) UNION ALL SELECT name, 'unknown' FROM x WHERE name NOT IN (SELECT name FROM t)""",
)
def b10(spark, sf):
    label = lambda c: F.concat(F.lit("NATION_"), F.col(c).cast("string")).alias("name")
    pred = T.read(spark, sf, "customer").select(label("c_nationkey")).distinct()
    truth = T.read(spark, sf, "nation").select(F.col("n_name").alias("name"))
    asked = T.read(spark, sf, "supplier").select(label("s_nationkey")).unionByName(T.read(spark, sf, "region").select(F.col("r_name").alias("name"))).distinct()
    mapped = pred.join(truth, "name").select("name", F.lit("mapped").alias("verdict"))
    return mapped.unionByName(asked.join(truth, "name", "left_anti").select("name", F.lit("unknown").alias("verdict")))


_NEAR = lambda pool: f"list_sort(list_transform(list_filter({pool}, lambda c: abs(c.t - r.t) <= {12 * HOUR}), lambda c: {{'d': abs(c.t - r.t), 't': c.t, 'id': c.id}}))[1]"
_LEFT = lambda pool, pick: f"CASE WHEN v IS NOT NULL AND w IS NOT NULL THEN list_filter({pool}, lambda c: c.id <> {pick}.id) ELSE {pool} END"


@query(
    "b11_greedy_stream_match",
    f"""WITH RECURSIVE e AS (SELECT user_id, event_type, event_id, epoch_us(ts) AS t FROM events WHERE event_type IN ('click', 'view', 'error')),
rf AS (SELECT user_id, event_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS rn FROM e WHERE event_type = 'click'),
pl AS (SELECT user_id, coalesce(list({{'t': t, 'id': event_id}}) FILTER (WHERE event_type = 'view'), []) AS vs, coalesce(list({{'t': t, 'id': event_id}}) FILTER (WHERE event_type = 'error'), []) AS es FROM e GROUP BY user_id),
gr AS (SELECT user_id, CAST(0 AS BIGINT) AS rn, vs, es, CAST(NULL AS BIGINT) AS reference, CAST(NULL AS BIGINT) AS "view", CAST(NULL AS BIGINT) AS error FROM pl UNION ALL
 SELECT user_id, rn, {_LEFT('vs', 'v')}, {_LEFT('es', 'w')}, CASE WHEN v IS NOT NULL AND w IS NOT NULL THEN event_id END, CASE WHEN w IS NOT NULL THEN v.id END, CASE WHEN v IS NOT NULL THEN w.id END FROM (
 SELECT g.user_id, r.rn, g.vs, g.es, r.event_id, {_NEAR('g.vs')} AS v, {_NEAR('g.es')} AS w FROM gr g JOIN rf r ON r.user_id = g.user_id AND r.rn = g.rn + 1))
SELECT user_id, reference, "view", error FROM gr WHERE reference IS NOT NULL""",
)
def b11(spark, sf):
    e = T.read(spark, sf, "events").where(F.col("event_type").isin("click", "view", "error")).select("user_id", "event_type", T.micros("ts").alias("t_us"), "event_id")
    return A.greedy_match(e, "user_id", "event_type", "t_us", "event_id", "click", ["click", "view", "error"], 12 * HOUR, _block())


_K = 4


@query(
    "b12_stride_sample",
    f"""WITH {T.SQL_SERIES}, n AS (SELECT user_id, count(*) AS n FROM ev GROUP BY ALL)
SELECT user_id, event_id, idx // {_K} AS sample, CAST(least({_K}, n - idx) AS INTEGER) AS repeat FROM ev JOIN n USING (user_id) WHERE idx % {_K} = 0""",
)
def b12(spark, sf):
    return A.stride_sample(T.series(spark, sf), ["user_id"], "idx", _K).select("user_id", "event_id", "sample", "repeat")


@query(
    "b13_upsample",
    f"""WITH {T.SQL_SERIES}, n AS (SELECT user_id, count(*) AS n FROM ev GROUP BY ALL),
s AS (SELECT user_id, value, event_type, idx // {_K} AS sample, CAST(least({_K}, n - idx) AS INTEGER) AS repeat FROM ev JOIN n USING (user_id) WHERE idx % {_K} = 0),
l AS (SELECT *, lead(value) OVER (PARTITION BY user_id ORDER BY sample) AS nv FROM s)
SELECT user_id, sample, CAST(o AS INTEGER) AS "offset", {r6('CASE WHEN nv IS NULL THEN value ELSE (1.0 - o::DOUBLE / repeat) * value + o::DOUBLE / repeat * nv END')} AS value, event_type
FROM l, unnest(range(0, repeat)) u(o)""",
)
def b13(spark, sf):
    s = A.stride_sample(T.series(spark, sf), ["user_id"], "idx", _K)
    return A.upsample(s, ["user_id"], "sample", "repeat", ["value"], ["event_type"]).withColumn("value", fixed("value"))


SQL_BRACKET = """sm AS (SELECT user_id, idx, value, event_type AS person, value > 5 AS ok FROM ev WHERE idx % 3 = 0),
bk AS (SELECT e.user_id, e.idx, (SELECT max(idx) FROM sm WHERE sm.user_id = e.user_id AND sm.idx <= e.idx) AS pi, (SELECT min(idx) FROM sm WHERE sm.user_id = e.user_id AND sm.idx > e.idx) AS ni FROM ev e),
bj AS (SELECT bk.*, a.value AS av, a.person AS ap, a.ok AS ao, b.value AS bv, b.person AS bp, b.ok AS bo, CASE WHEN pi IS NULL THEN 1.0::DOUBLE WHEN ni IS NULL THEN 0.0::DOUBLE ELSE (bk.idx - pi)::DOUBLE / (ni - pi) END AS w
 FROM bk LEFT JOIN sm a ON a.user_id = bk.user_id AND a.idx = pi LEFT JOIN sm b ON b.user_id = bk.user_id AND b.idx = ni)"""


@query(
    "b14_interpolating_lookup",
    f"""WITH {T.SQL_SERIES}, {SQL_BRACKET}, c AS (SELECT *, w <= 1e-12 OR (ap <> bp AND w < 0.5) AS ta, w >= 1 - 1e-12 OR (ap <> bp AND w >= 0.5) AS tb FROM bj)
SELECT user_id, idx, {r6('CASE WHEN ta THEN av WHEN tb THEN bv WHEN ao AND bo THEN (1.0 - w) * av + w * bv END')} AS value, CASE WHEN ta THEN ao WHEN tb THEN bo ELSE ao AND bo END AS valid FROM c""",
)
def b14(spark, sf):
    s = T.series(spark, sf)
    sampled = s.where("idx % 3 = 0").select("user_id", "idx", "value", F.col("event_type").alias("person"), (F.col("value") > 5).alias("ok"))
    rows = A.bracket(s.select("user_id", "idx"), sampled, ["user_id"], "idx", ["value", "person", "ok"], index_block("idx"), equal_is_before=True)
    value, valid = A.interpolate_between("prev", "next", F.col("idx"), "idx", "value", "ok", "person")
    return rows.select("user_id", "idx", fixed(value).alias("value"), valid.alias("valid"))


@query(
    "b15_nearest_category",
    f"""WITH {T.SQL_SERIES}, sm AS (SELECT user_id, idx AS si, event_type AS category FROM ev WHERE idx % 5 = 2),
r AS (SELECT e.user_id, e.idx, category, row_number() OVER (PARTITION BY e.user_id, e.idx ORDER BY abs(si - e.idx), si) AS rk FROM ev e JOIN sm USING (user_id))
SELECT user_id, idx, category FROM r WHERE rk = 1""",
)
def b15(spark, sf):
    s = T.series(spark, sf)
    known = s.where("idx % 5 = 2").select("user_id", "idx", F.col("event_type").alias("category"))
    near = A.nearest(s.select("user_id", "idx"), known, ["user_id"], "idx", ["category"], index_block("idx"))
    return near.where("near IS NOT NULL").select("user_id", "idx", F.col("near.category").alias("category"))


SQL_SEGMENTS = """sg AS (SELECT user_id, idx AS start_frame, idx + 3 AS end_frame, event_id AS movement_id, event_type,
 CASE event_type WHEN 'error' THEN [] WHEN 'click' THEN [{'phase': 'apex', 'frame': idx + 1}, {'phase': 'hold', 'frame': idx + 2}] ELSE [{'phase': 'prep', 'frame': idx}, {'phase': 'apex', 'frame': idx + 2}] END AS anchors FROM ev WHERE idx % 5 = 0)"""


def segments(spark, sf):
    """Labelled intervals of the stand-in: every fifth event opens one of four frames with phase anchors."""
    i = F.col("idx")
    anchor = lambda p, f: F.struct(F.lit(p).alias("phase"), f.cast("long").alias("frame"))
    none = F.array().cast("array<struct<phase:string,frame:bigint>>")
    anchors = F.when(F.col("event_type") == "error", none).when(
        F.col("event_type") == "click", F.array(anchor("apex", i + 1), anchor("hold", i + 2))
    ).otherwise(F.array(anchor("prep", i), anchor("apex", i + 2)))
    return T.series(spark, sf).where("idx % 5 = 0").select(
        "user_id", i.alias("start_frame"), (i + 3).alias("end_frame"), F.col("event_id").alias("movement_id"), "event_type", anchors.alias("anchors")
    )


@query(
    "b16_label_lookup",
    f"""WITH {T.SQL_SERIES}, {SQL_SEGMENTS}, j AS (SELECT e.user_id, e.idx, movement_id, anchors FROM ev e LEFT JOIN sg s ON s.user_id = e.user_id AND e.idx BETWEEN start_frame AND end_frame),
a AS (SELECT user_id, idx, movement_id, anchors, list_filter(anchors, lambda q: q.frame <= idx) AS p FROM j)
SELECT user_id, idx, movement_id, CASE WHEN movement_id IS NULL THEN NULL WHEN len(anchors) = 0 THEN 'unlabeled_phase' WHEN len(p) > 0 THEN p[len(p)].phase ELSE anchors[1].phase END AS phase FROM a""",
)
def b16(spark, sf):
    frames = T.series(spark, sf).select("user_id", "idx")
    return A.label_frames(frames, segments(spark, sf), ["user_id"], "idx", ["movement_id"], index_block("idx"))


_PRIO = "CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 ELSE 99 END"


@query(
    "b17_event_frames",
    f"""WITH {T.SQL_SERIES}, x AS (SELECT user_id, event_id, event_type, f AS frame FROM ev, unnest(range(idx, idx + event_id % 4 + 1)) u(f))
SELECT user_id, frame, event_id, CAST(row_number() OVER (PARTITION BY user_id, frame ORDER BY {_PRIO}, event_id) AS INTEGER) AS display_order FROM x""",
)
def b17(spark, sf):
    from pyspark.sql import Window

    spans = T.series(spark, sf).select("user_id", "event_id", "event_type", F.col("idx").alias("a"), (F.col("idx") + F.col("event_id") % 4).alias("z"))
    rows = A.expand_events(spans, ["user_id", "event_id"], "a", "z")
    w = Window.partitionBy("user_id", "frame").orderBy(F.expr(_PRIO), "event_id")  # the events shown in one frame
    return rows.select("user_id", "frame", "event_id", F.row_number().over(w).alias("display_order"))


@query(
    "b18_timeline_with_pauses",
    f"""WITH {T.SQL_SERIES}, a AS (SELECT DISTINCT user_id, idx - idx % 7 AS frame FROM ev WHERE event_type = 'purchase' AND value > 0),
t AS (SELECT e.user_id, e.idx, a.frame IS NOT NULL AS pause, coalesce(sum(CASE WHEN a.frame IS NOT NULL THEN 5 ELSE 0 END) OVER (PARTITION BY e.user_id ORDER BY e.idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
 FROM ev e LEFT JOIN a ON a.user_id = e.user_id AND a.frame = e.idx)
SELECT user_id, CAST(idx + before + k AS BIGINT) AS output_frame, idx AS source_frame, k > 0 AS repeated FROM t, unnest(range(0, CASE WHEN pause THEN 6 ELSE 1 END)) u(k)""",
)
def b18(spark, sf):
    s = T.series(spark, sf)
    anchors = s.where("event_type = 'purchase' AND value > 0").select("user_id", (F.col("idx") - F.col("idx") % 7).alias("idx")).distinct().withColumn("pause", F.lit(1))
    rows = s.select("user_id", "idx").join(anchors, ["user_id", "idx"], "left").withColumn("pause", F.coalesce("pause", F.lit(0)))
    return with_pauses(rows, ["user_id"], "idx", "pause", 5)


def with_pauses(rows, keys, idx, pause, freeze):
    """Frames flagged by ``pause`` are followed by ``freeze`` repeats; output positions stay gapless."""
    placed = running_total(rows, keys, [idx], index_block(idx), F.col(pause), "__upto")
    before = (F.col("__upto") - F.col(pause)) * freeze
    out = placed.withColumn("__k", F.explode(F.sequence(F.lit(0), F.col(pause) * freeze)))
    return out.select(*keys, (F.col(idx) + before + F.col("__k")).cast("long").alias("output_frame"), F.col(idx).alias("source_frame"), (F.col("__k") > 0).alias("repeated"))


SQL_PROJECTED = f"""{T.SQL_VIEWS}, {T.SQL_CAMERAS},
pv AS (SELECT session_id, camera_id, sample_idx, joint_idx, px, py, (p[1] * x + p[2] * y + p[3] * z + p[4]) / (p[9] * x + p[10] * y + p[11] * z + p[12]) AS qx,
 (p[5] * x + p[6] * y + p[7] * z + p[8]) / (p[9] * x + p[10] * y + p[11] * z + p[12]) AS qy FROM p2 JOIN cam USING (camera_id) WHERE joint_idx IN (5, 6, 11, 12, 13, 14, 15, 16))"""


def projected_views(spark, sf):
    seen = T.pose2d(spark, sf).where(F.col("joint_idx").isin(5, 6, 11, 12, 13, 14, 15, 16)).join(F.broadcast(T.cameras(spark)), "camera_id")
    u, v, _ = G.project((F.col("x"), F.col("y"), F.col("z")), G.array_matrix("p", 12))
    return seen.select("session_id", "camera_id", "sample_idx", "joint_idx", "px", "py", u.alias("qx"), v.alias("qy"))


def shift_table(spark, sf):
    views = projected_views(spark, sf)
    length = T.frames(spark, sf).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    return A.shift_scan(views.join(length, "session_id"), ["session_id", "camera_id"], ["joint_idx"], "sample_idx", ["px", "py"], ["qx", "qy"], 6, "n")


@query(
    "b19_lag_scan",
    f"""WITH {SQL_PROJECTED}, n AS (SELECT session_id, count(*) AS n FROM f0 GROUP BY ALL), s AS (SELECT unnest(range(-6, 7)) AS sh),
d AS (SELECT b.session_id, b.camera_id, sh, sqrt(pow(a.px - b.qx, 2) + pow(a.py - b.qy, 2)) AS v FROM pv b JOIN n USING (session_id) JOIN s ON abs(sh) <= n // 4
 JOIN pv a ON a.session_id = b.session_id AND a.camera_id = b.camera_id AND a.joint_idx = b.joint_idx AND a.sample_idx = b.sample_idx + sh)
SELECT session_id, camera_id, CAST(sh AS INTEGER) AS shift, {r6('median(v)', 4)} AS median_error, {r6('quantile_cont(v, 0.95)', 4)} AS p95_error FROM d WHERE v IS NOT NULL GROUP BY ALL""",
)
def b19(spark, sf):
    return shift_table(spark, sf).withColumns({c: fixed(c, 4) for c in ("median_error", "p95_error")})


@query(
    "b20_windowed_shift_error",
    f"""WITH {SQL_PROJECTED}, d AS (SELECT b.session_id, b.camera_id, b.sample_idx // 10 AS w, sqrt(pow(a.px - b.qx, 2) + pow(a.py - b.qy, 2)) AS v FROM pv b
 JOIN pv a ON a.session_id = b.session_id AND a.camera_id = b.camera_id AND a.joint_idx = b.joint_idx AND a.sample_idx = b.sample_idx + 2)
SELECT session_id, camera_id, w * 10 AS start_frame, {r6('median(v)', 4)} AS median_error, {r6('quantile_cont(v, 0.95)', 4)} AS p95_error FROM d GROUP BY ALL""",
)
def b20(spark, sf):
    from ..operators.blocks import with_halo

    def build(w):
        return {"ax": F.lead("px", 2).over(w), "ay": F.lead("py", 2).over(w), "more": F.lead("sample_idx", 2).over(w)}

    rows = with_halo(projected_views(spark, sf), ["session_id", "camera_id", "joint_idx"], "sample_idx", 0, 2, build).where("more IS NOT NULL")
    err = F.sqrt((F.col("ax") - F.col("qx")) ** 2 + (F.col("ay") - F.col("qy")) ** 2)
    # a window holds at most 10 frames x 8 joints
    return rows.groupBy("session_id", "camera_id", (F.floor(F.col("sample_idx") / 10) * 10).alias("start_frame")).agg(
        fixed(F.median(err), 4).alias("median_error"), fixed(F.percentile(err, F.lit(0.95)), 4).alias("p95_error")
    )


_SIGJ = "(0, 5, 6, 11, 12, 13, 14, 15, 16)"
SQL_SIGNATURE = f"""{T.SQL_VIEWS},
fe AS (SELECT session_id, camera_id, joint_idx, sample_idx, px, py FROM p2 WHERE joint_idx IN {_SIGJ}),
ve AS (SELECT *, sqrt(pow(px - lag(px) OVER (PARTITION BY session_id, camera_id, joint_idx ORDER BY sample_idx), 2) + pow(py - lag(py) OVER (PARTITION BY session_id, camera_id, joint_idx ORDER BY sample_idx), 2)) AS v FROM fe),
fm AS (SELECT session_id, camera_id, sample_idx, sqrt(pow(max(px) - min(px), 2) + pow(max(py) - min(py), 2)) AS d, median(v) AS m FROM ve GROUP BY ALL),
fb AS (SELECT session_id, camera_id, median(d) FILTER (WHERE d > 1e-6) AS fb FROM fm GROUP BY ALL),
s0 AS (SELECT session_id, camera_id, sample_idx, m / CASE WHEN d > 1e-6 THEN d ELSE coalesce(fb, 1.0) END AS s FROM fm JOIN fb USING (session_id, camera_id)),
s1 AS (SELECT *, last_value(CASE WHEN s IS NOT NULL THEN sample_idx END IGNORE NULLS) OVER (PARTITION BY session_id, camera_id ORDER BY sample_idx) AS pi,
 first_value(CASE WHEN s IS NOT NULL THEN sample_idx END IGNORE NULLS) OVER (PARTITION BY session_id, camera_id ORDER BY sample_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ni FROM s0),
s2 AS (SELECT a.*, p.s AS pv, n.s AS nv FROM s1 a LEFT JOIN s0 p ON p.session_id = a.session_id AND p.camera_id = a.camera_id AND p.sample_idx = a.pi LEFT JOIN s0 n ON n.session_id = a.session_id AND n.camera_id = a.camera_id AND n.sample_idx = a.ni),
s3 AS (SELECT session_id, camera_id, sample_idx, CASE WHEN s IS NOT NULL THEN s WHEN pv IS NULL THEN nv WHEN nv IS NULL THEN pv ELSE pv + (sample_idx - pi)::DOUBLE / (ni - pi) * (nv - pv) END AS f FROM s2),
sig AS (SELECT session_id, camera_id, sample_idx, sum(f) OVER (PARTITION BY session_id, camera_id ORDER BY sample_idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7.0 AS signature FROM s3)"""


def signatures(spark, sf):
    features = T.pose2d(spark, sf).where(F.col("joint_idx").isin(0, 5, 6, 11, 12, 13, 14, 15, 16)).select("session_id", "camera_id", "joint_idx", "sample_idx", "px", "py")
    return A.motion_signature(features, ["session_id", "camera_id"], "joint_idx", "sample_idx", "px", "py")


@query("b21_motion_signature", f"WITH {SQL_SIGNATURE} SELECT session_id, camera_id, sample_idx, {r6('signature')} AS signature FROM sig")
def b21(spark, sf):
    return signatures(spark, sf).withColumn("signature", fixed("signature"))


SQL_CORR = f"""{SQL_SIGNATURE},
m1 AS (SELECT *, median(signature) OVER (PARTITION BY session_id, camera_id) AS md, stddev_pop(signature) OVER (PARTITION BY session_id, camera_id) AS sd FROM sig),
m2 AS (SELECT *, 1.4826 * median(abs(signature - md)) OVER (PARTITION BY session_id, camera_id) AS mad FROM m1),
z AS (SELECT session_id, camera_id, sample_idx, (signature - md) / CASE WHEN mad > 1e-8 THEN mad WHEN sd > 1e-8 THEN sd ELSE 1.0 END AS z FROM m2),
rf AS (SELECT a.session_id, a.camera_id, a.sample_idx, a.z AS x, median(b.z) AS r FROM z a JOIN z b ON a.session_id = b.session_id AND a.sample_idx = b.sample_idx AND a.camera_id <> b.camera_id GROUP BY ALL),
cs AS (SELECT b.session_id, b.camera_id, sh, corr(a.x, b.r) AS c FROM rf b JOIN (SELECT unnest(range(-4, 5)) AS sh) ON TRUE JOIN rf a ON a.session_id = b.session_id AND a.camera_id = b.camera_id AND a.sample_idx = b.sample_idx + sh
 GROUP BY ALL HAVING count(*) >= 12 AND stddev_pop(a.x) > 1e-8 AND stddev_pop(b.r) > 1e-8)"""


def correlations(spark, sf):
    sig = materialise(signatures(spark, sf), "signature")
    z = A.robust_standardise(sig, ["session_id", "camera_id"], "signature", "z")
    return A.correlation_scan(z.select("session_id", "camera_id", "sample_idx", "z"), "session_id", "camera_id", "sample_idx", "z", 4)


@query("b22_correlation_scan", f"WITH {SQL_CORR} SELECT session_id, camera_id, CAST(sh AS INTEGER) AS shift, {r6('c', 5)} AS correlation FROM cs")
def b22(spark, sf):
    return correlations(spark, sf).withColumn("correlation", fixed("correlation", 5))


@query(
    "b23_shift_assessment",
    f"""WITH {SQL_CORR}, {T.SQL_CAMERAS}, pv AS (SELECT session_id, camera_id, sample_idx, joint_idx, px, py, (p[1] * x + p[2] * y + p[3] * z + p[4]) / (p[9] * x + p[10] * y + p[11] * z + p[12]) AS qx,
 (p[5] * x + p[6] * y + p[7] * z + p[8]) / (p[9] * x + p[10] * y + p[11] * z + p[12]) AS qy FROM p2 JOIN cam USING (camera_id) WHERE joint_idx IN (5, 6, 11, 12, 13, 14, 15, 16)),
n AS (SELECT session_id, count(*) AS n FROM f0 GROUP BY ALL),
d AS (SELECT b.session_id, b.camera_id, sh, sqrt(pow(a.px - b.qx, 2) + pow(a.py - b.qy, 2)) AS v FROM pv b JOIN n USING (session_id) JOIN (SELECT unnest(range(-6, 7)) AS sh) ON abs(sh) <= n // 4
 JOIN pv a ON a.session_id = b.session_id AND a.camera_id = b.camera_id AND a.joint_idx = b.joint_idx AND a.sample_idx = b.sample_idx + sh),
ge AS (SELECT session_id, camera_id, sh, median(v) AS m FROM d WHERE v IS NOT NULL GROUP BY ALL),
gb AS (SELECT session_id, camera_id, arg_min(sh, floor(m * 1e6) * 100 + sh) AS gs, min(m) AS gm, min(m) FILTER (WHERE sh = 0) AS gz FROM ge GROUP BY ALL),
cb AS (SELECT session_id, camera_id, arg_max(sh, floor(c * 1e9) * 100 - sh) AS ms, max(c) AS mb, max(c) FILTER (WHERE sh = 0) AS mz FROM cs GROUP BY ALL)
SELECT session_id, camera_id, CASE WHEN gm IS NULL OR gz IS NULL OR mb IS NULL OR mz IS NULL THEN 'insufficient_evidence' WHEN gm / greatest(gz, 1e-9) < 0.75 AND mb - mz >= 0.15 AND abs(gs - ms) <= 3 THEN 'supported'
 WHEN gm / greatest(gz, 1e-9) < 0.75 AND abs(gs - ms) > 3 THEN 'ambiguous_periodic_motion' ELSE 'not_supported' END AS status FROM gb LEFT JOIN cb USING (session_id, camera_id)""",
)
def b23(spark, sf):
    geo = shift_table(spark, sf).groupBy("session_id", "camera_id").agg(
        F.min_by("shift", F.struct(F.floor(F.col("median_error") * 1e6), "shift")).alias("gs"), F.min("median_error").alias("gm"),
        F.min(F.when(F.col("shift") == 0, F.col("median_error"))).alias("gz"),
    )
    mot = correlations(spark, sf).groupBy("session_id", "camera_id").agg(
        F.max_by("shift", F.struct(F.floor(F.col("correlation") * 1e9), -F.col("shift"))).alias("ms"), F.max("correlation").alias("mb"),
        F.max(F.when(F.col("shift") == 0, F.col("correlation"))).alias("mz"),
    )
    both = geo.join(mot, ["session_id", "camera_id"], "left")
    return both.select("session_id", "camera_id", A.assess_shift(*[F.col(c) for c in ("gs", "gm", "gz", "ms", "mb", "mz")]).alias("status"))


@query(
    "b24_timeline_transfer_check",
    f"""WITH {T.SQL_SERIES}, a AS (SELECT user_id, idx, t_us / 1e6::DOUBLE AS t FROM ev), b AS (SELECT user_id, idx, t_us / 1e6::DOUBLE + CASE WHEN user_id % 4 = 0 AND idx % 9 = 0 THEN 0.001 ELSE 0.0 END AS t FROM ev WHERE NOT (user_id % 7 = 0 AND idx = 3)),
j AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, a.idx IS NULL OR b.idx IS NULL AS miss, abs(a.t - b.t) <= 1e-9 AS same FROM a FULL OUTER JOIN b ON a.user_id = b.user_id AND a.idx = b.idx)
SELECT user_id, count(*) FILTER (WHERE miss) AS missing, count(*) FILTER (WHERE NOT miss AND NOT same) AS different, count(*) FILTER (WHERE miss) = 0 AND count(*) FILTER (WHERE NOT miss AND NOT same) = 0 AS transferable FROM j GROUP BY ALL""",
)
def b24(spark, sf):
    a = T.series(spark, sf).select("user_id", "idx", (F.col("t_us") / 1e6).alias("t"))
    b = a.where("NOT (user_id % 7 = 0 AND idx = 3)").withColumn("t", F.col("t") + F.when((F.col("user_id") % 4 == 0) & (F.col("idx") % 9 == 0), 0.001).otherwise(0.0))
    return A.compare_timelines(a, b, "user_id", "idx", ["t"])


@query(
    "b25_leakage_guarded_split",
    """WITH d AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), s AS (SELECT DISTINCT source || ':' || lang AS key FROM d),
a AS (SELECT key, CASE WHEN hash_bucket < 7 THEN 'train' WHEN hash_bucket < 9 THEN 'validation' ELSE 'test' END AS part FROM (SELECT key, ascii(md5(key)) % 10 AS hash_bucket FROM s))
SELECT doc_id, part FROM documents JOIN a ON a.key = source || ':' || lang
 WHERE NOT (part = 'train' AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))""",
)
def b25(spark, sf):
    docs = T.read(spark, sf, "documents").select("doc_id", F.concat_ws(":", "source", "lang").alias("key"))
    bucket = F.ascii(F.md5("key")) % 10
    parts = docs.withColumn("part", F.when(bucket < 7, "train").when(bucket < 9, "validation").otherwise("test"))
    held = T.read(spark, sf, "labels").where("toxic = 1").select("doc_id").withColumn("part", F.lit("train"))
    return parts.join(held, ["doc_id", "part"], "left_anti").select("doc_id", "part")


@query(
    "b26_robust_standardisation",
    f"""WITH {T.SQL_SERIES}, a AS (SELECT *, median(value) OVER (PARTITION BY user_id) AS md, stddev_pop(value) OVER (PARTITION BY user_id) AS sd FROM ev),
b AS (SELECT *, 1.4826 * median(abs(value - md)) OVER (PARTITION BY user_id) AS mad FROM a)
SELECT user_id, event_id, {r6('(value - md) / CASE WHEN mad > 1e-8 THEN mad WHEN sd > 1e-8 THEN sd ELSE 1.0 END')} AS standard FROM b""",
)
def b26(spark, sf):
    e = T.read(spark, sf, "events").select("user_id", "event_id", "value")
    return A.robust_standardise(e, ["user_id"], "value").select("user_id", "event_id", fixed("standard").alias("standard"))


@query(
    "b27_source_frame_lookup",
    f"""WITH {T.SQL_SERIES}, {SQL_NEAR}, m AS (SELECT user_id, event_id + 1 AS prepared, src_id FROM nm), q AS (SELECT user_id, event_id AS wanted FROM ev WHERE event_type IN ('signup', 'click'))
SELECT q.user_id, count(*) AS requested, count(src_id) AS found, count(DISTINCT src_id) AS unique_sources, count(src_id) - count(DISTINCT src_id) AS reused
FROM q LEFT JOIN m ON m.user_id = q.user_id AND m.prepared = q.wanted + 1 GROUP BY ALL""",
)
def b27(spark, sf):
    near, _ = click_to_view(spark, sf)
    mapping = near.where("near IS NOT NULL").select("user_id", (F.col("event_id") + 1).alias("prepared"), F.col("near.src_id").alias("src_id"))
    wanted = T.read(spark, sf, "events").where(F.col("event_type").isin("signup", "click")).select("user_id", (F.col("event_id") + 1).alias("prepared"))
    return wanted.join(mapping, ["user_id", "prepared"], "left").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("requested"), F.count("src_id").alias("found"), F.countDistinct("src_id").alias("unique_sources"),
        (F.count("src_id") - F.countDistinct("src_id")).alias("reused"),
    )
