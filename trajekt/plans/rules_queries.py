"""I: alignment, rules and decision queries.

Stand-ins: an order is a timeline and its line items the segments (line number = movement), parts
carry stance (p_type) and techniques (words of p_name), events are evidence events of a user.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numeric import count_where, fixed, reasons
from ..operators import rules as R
from ..operators.blocks import index_block, ordinal, runs, time_block
from ..operators.quantiles import attach
from ..operators.sequences import align_segments
from ..session import materialise
from . import tables as T
from .registry import query
from .temporal_queries import sql_runs  # noqa: F401

r6 = T.r6
M = 18
MOVES = [f"M{i + 1:02d}" for i in range(M)]

SQL_SEG = """sg AS (SELECT l_orderkey AS timeline_id, l_linenumber AS seq, 'M0' || l_linenumber AS movement_id, min(l_linenumber * 100 + l_partkey % 60) AS start_frame,
 max(l_linenumber * 100 + l_partkey % 60 + CAST(l_quantity AS BIGINT)) AS end_frame, max(l_discount) * 10 AS confidence FROM lineitem GROUP BY ALL)"""


def timeline_segments(spark, sf):
    start = F.col("l_linenumber") * 100 + F.col("l_partkey") % 60
    return T.read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("timeline_id"), F.col("l_linenumber").alias("seq")).agg(
        F.concat(F.lit("M0"), F.first("l_linenumber").cast("string")).alias("movement_id"), F.min(start).alias("start_frame"),
        F.max(start + F.col("l_quantity").cast("long")).alias("end_frame"), (F.max("l_discount") * 10).alias("confidence"),
    )


@query(
    "i1_positional_alignment",
    f"""WITH s AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS position FROM events),
m AS (SELECT DISTINCT user_id, j AS position, {MOVES!r}[j + 1] AS movement_id FROM s, unnest(range(0, {M})) u(j))
SELECT coalesce(s.user_id, m.user_id) AS user_id, coalesce(s.position, m.position) AS position, event_id, movement_id,
 CASE WHEN event_id IS NULL THEN 'unmatched_movement' WHEN movement_id IS NULL THEN 'unmatched_segment' ELSE 'aligned' END AS issue FROM s FULL OUTER JOIN m ON s.user_id = m.user_id AND s.position = m.position""",
)
def i1(spark, sf):
    events = T.read(spark, sf, "events").select("user_id", "event_id", T.micros("ts").alias("t_us"))
    placed = ordinal(events, ["user_id"], ["t_us", "event_id"], time_block("t_us"), "ord")
    return R.positional_alignment(placed, "user_id", "ord", "event_id", MOVES)


@query(
    "i2_position_costs",
    f"""WITH {SQL_SEG}, f AS (SELECT timeline_id, max(end_frame) + 1 AS fc FROM sg GROUP BY ALL)
SELECT timeline_id, seq, CAST(j AS INTEGER) AS movement, {r6(f'abs((start_frame + end_frame) / 2 / fc - (j + 0.5::DOUBLE) / {M})')} AS cost FROM sg JOIN f USING (timeline_id), unnest(range(0, {M})) u(j)""",
)
def i2(spark, sf):
    segs = timeline_segments(spark, sf)
    total = segs.groupBy("timeline_id").agg((F.max("end_frame") + 1).alias("fc"))
    out = R.position_costs(segs.join(total, "timeline_id"), "start_frame", "end_frame", "fc", M)
    return out.select("timeline_id", "seq", F.posexplode("costs").alias("movement", "cost")).withColumn("cost", fixed("cost"))


#: Joints that a frame must show to belong to a segment; recordings are dealt to so many specifications.
SHOWN, SPECS, LIMBS = 9, 3, 10
SHOWS = "NOT (" + " OR ".join(T._hidden("vec_id", j) for j in range(SHOWN)) + ")"
_GAP = "avg(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)))"
SQL_SEGMENTS = f"""{T.SQL_LONG}, fl AS (SELECT session_id, sample_idx, {SHOWS} AS ok FROM f0), {sql_runs('fl', 'session_id', 'ok')},
sgm AS (SELECT session_id, run_start, run_end, row_number() OVER (PARTITION BY session_id ORDER BY run_start) - 1 AS segment FROM (SELECT DISTINCT session_id, run_start, run_end FROM rn WHERE run_start IS NOT NULL)),
mp AS (SELECT s.session_id, segment, joint_idx, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM sgm s JOIN p3 ON p3.session_id = s.session_id AND sample_idx BETWEEN run_start AND run_end GROUP BY ALL),
spc AS (SELECT CAST(sample_idx AS INTEGER) AS spec_id, CAST(row_number() OVER (PARTITION BY sample_idx ORDER BY session_id) - 1 AS INTEGER) AS movement, vec_id AS ev FROM f0 WHERE sample_idx < {SPECS}),
pc AS (SELECT a.session_id, segment, spec_id, movement, {_GAP} AS cost FROM mp a JOIN spc ON spec_id = a.session_id % {SPECS} JOIN p3 b ON b.vec_id = ev AND b.joint_idx = a.joint_idx GROUP BY ALL),
pn AS (SELECT spec_id, coalesce(0.7 * min(m), 0.1) AS pen FROM (SELECT DISTINCT spec_id FROM spc) LEFT JOIN (
  SELECT p.spec_id, p.movement AS m1, q.movement AS m2, {_GAP} AS m FROM spc p JOIN spc q ON q.spec_id = p.spec_id AND q.movement > p.movement JOIN p3 a ON a.vec_id = p.ev JOIN p3 b ON b.vec_id = q.ev AND b.joint_idx = a.joint_idx GROUP BY ALL HAVING m > 0) USING (spec_id) GROUP BY spec_id)"""


def expected_poses(spark, sf):
    """Specification table: spec_id and the reference poses of its movements, a frame of each label; a specification's own short list."""
    first = T.sequence_frames(spark, sf).where(F.col("sample_idx") < SPECS)
    poses = F.transform(F.array_sort(F.collect_list(F.struct("session_id", "pts"))), lambda s: s["pts"])
    return first.groupBy(F.col("sample_idx").cast("int").alias("spec_id")).agg(poses.alias("expected"))


def segment_poses(spark, sf):
    """Segments of every recording, runs of frames that show the first joints, with the mean of what their frames show of each joint."""
    framed = T.sequence_frames(spark, sf).select("session_id", "vec_id", "sample_idx", "pts")
    marked = runs(framed, ["session_id"], "sample_idx", F.expr(SHOWS)).where("run_start is not null")
    key = ["session_id", "run_start", "run_end"]
    means = marked.select(*key, F.posexplode("pts").alias("j", "p")).groupBy(*key, "j").agg(F.struct(*[F.avg(f"p.{c}").alias(c) for c in "xyz"]).alias("p"))
    whole = means.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "p"))), lambda s: s["p"]).alias("pts"))
    return ordinal(whole, ["session_id"], ["run_start"], index_block("run_start"), "segment").withColumn("spec_id", (F.col("session_id") % SPECS).cast("int"))


def segment_costs(spark, sf):
    """Segments with the costs of all movements of their recording's specification and its skip penalty."""
    expected = expected_poses(spark, sf)
    specs = materialise(expected.join(R.pairwise_min_gap(expected, "spec_id"), "spec_id"), "specs")
    return R.pose_costs(segment_poses(spark, sf), specs, "spec_id").drop("pts")


@query("i2_pose_costs", f"WITH {SQL_SEGMENTS} SELECT session_id, segment, movement, {r6('cost')} AS cost FROM pc")
def i2p(spark, sf):
    return segment_costs(spark, sf).select("session_id", "segment", F.posexplode("costs").alias("movement", "cost")).withColumn("cost", fixed("cost"))


def sql_alignment(skips: bool) -> str:
    """The table cell by cell, one recursion over its rows and one back over its cells; costs in whole billionths as in the operator."""
    far = str(1 << 60)
    unit = ", ".join(f"coalesce(CAST(round(max(cost) FILTER (movement = {j}) * 1e9) AS BIGINT), {far}) AS c{j + 1}" for j in range(LIMBS))
    cheap = lambda j: f"least(c{j}, pu)" if skips else f"c{j}"
    row = [f"CAST({far} AS BIGINT) AS n0"] + [f"least(least(a.a{j - 1}, a.a{j}) + c{j}, n{j - 1} + {cheap(j)}, {far}) AS n{j}" for j in range(1, LIMBS + 1)]
    start = ", ".join(f"CAST({f'pu * {j}' if skips else 0 if j == 0 else far} AS BIGINT) AS a{j}" for j in range(LIMBS + 1))
    skip = f"least(r.al[j] + pu, {far}) < least(least(p.al[j + 1], p.al[j], r.al[j]) + cl[j], {far})" if skips else "FALSE"
    best = "least(p.al[j], p.al[j + 1], r.al[j])"
    return f"""{SQL_SEGMENTS}, cu AS (SELECT session_id, segment, spec_id, CAST(round(any_value(pen) * 1e9) AS BIGINT) AS pu, {unit} FROM pc JOIN pn USING (spec_id) GROUP BY ALL),
acc AS (SELECT DISTINCT session_id, CAST(0 AS BIGINT) AS i, {start} FROM cu UNION ALL SELECT a.session_id, a.i + 1, {', '.join(f'n{j}' for j in range(LIMBS + 1))} FROM (
  SELECT a.session_id, a.i, {', '.join(row)} FROM acc a JOIN cu c ON c.session_id = a.session_id AND c.segment = a.i) a),
al AS (SELECT session_id, i, [{', '.join(f'a{j}' for j in range(LIMBS + 1))}] AS al FROM acc),
cl AS (SELECT session_id, segment, pu, [{', '.join(f'c{j}' for j in range(1, LIMBS + 1))}] AS cl FROM cu),
bt AS (SELECT session_id, max(i) AS i, {LIMBS} AS j, CAST(NULL AS BOOLEAN) AS sk, CAST(NULL AS BIGINT) AS ci, CAST(NULL AS INTEGER) AS cj FROM al GROUP BY ALL
 UNION ALL SELECT session_id, CASE WHEN s OR (d <> b AND u <> b) THEN i ELSE i - 1 END, CASE WHEN s OR d = b OR u <> b THEN j - 1 ELSE j END, s, i, j FROM (
  SELECT t.session_id, t.i, t.j, t.i = 0 OR {skip} AS s, p.al[j] AS d, p.al[j + 1] AS u, {best} AS b
  FROM bt t LEFT JOIN al r ON r.session_id = t.session_id AND r.i = t.i LEFT JOIN al p ON p.session_id = t.session_id AND p.i = t.i - 1 LEFT JOIN cl ON cl.session_id = t.session_id AND cl.segment = t.i - 1
  WHERE t.j > 0 AND (t.i > 0 OR {skips}))),
tot AS (SELECT session_id, arg_max(al[{LIMBS + 1}], i) / 1e9 AS total_cost FROM al GROUP BY ALL),
way AS (SELECT bt.session_id, CASE WHEN NOT sk THEN ci - 1 END AS segment, CAST(cj - 1 AS INTEGER) AS movement, CASE WHEN NOT sk THEN cost END AS cost, total_cost
 FROM bt JOIN tot USING (session_id) LEFT JOIN pc ON pc.session_id = bt.session_id AND pc.segment = ci - 1 AND pc.movement = cj - 1 WHERE sk IS NOT NULL)"""


_WAY = f"SELECT session_id, segment, movement, {r6('cost')} AS cost, {r6('total_cost')} AS total_cost FROM way"


@query("i3_monotone_alignment", f"WITH RECURSIVE {sql_alignment(False)} {_WAY}")
def i3(spark, sf):
    return align_segments(segment_costs(spark, sf), "session_id", "segment").select(
        "session_id", "segment", "movement", fixed("cost").alias("cost"), fixed("total_cost").alias("total_cost")
    )


@query("i4_alignment_with_skips", f"WITH RECURSIVE {sql_alignment(True)} {_WAY}")
def i4(spark, sf):
    path = align_segments(segment_costs(spark, sf), "session_id", "segment", "skip_penalty")
    return path.select("session_id", "segment", "movement", fixed("cost").alias("cost"), fixed("total_cost").alias("total_cost"))


SQL_PAIRS = """pr AS (SELECT DISTINCT l_orderkey AS timeline_id, CAST(l_partkey % 7 AS INTEGER) AS segment, l_linenumber - 1 AS movement FROM lineitem)"""


def alignment_pairs(spark, sf):
    return T.read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("timeline_id"), (F.col("l_partkey") % 7).cast("int").alias("segment"), (F.col("l_linenumber") - 1).alias("movement")
    ).distinct()


@query(
    "i5_alignment_anomalies",
    f"""WITH {SQL_PAIRS} SELECT timeline_id, 'skipped_movement' AS issue, CAST(j AS INTEGER) AS index, [CAST(j AS INTEGER)] AS movements FROM (SELECT DISTINCT timeline_id FROM pr), unnest(range(0, 7)) u(j)
 WHERE NOT EXISTS (SELECT 1 FROM pr WHERE pr.timeline_id = timeline_id AND movement = j AND pr.timeline_id = (SELECT timeline_id)) AND FALSE
UNION ALL SELECT t.timeline_id, 'skipped_movement', CAST(j AS INTEGER), [CAST(j AS INTEGER)] FROM (SELECT DISTINCT timeline_id FROM pr) t CROSS JOIN unnest(range(0, 7)) u(j) ANTI JOIN pr ON pr.timeline_id = t.timeline_id AND pr.movement = j
UNION ALL SELECT timeline_id, 'segment_spans_multiple_movements', segment, list_sort(list(movement)) FROM pr GROUP BY timeline_id, segment HAVING count(*) > 1""",
)
def i5(spark, sf):
    pairs = alignment_pairs(spark, sf)
    all_moves = F.sequence(F.lit(0), F.lit(6))
    # a timeline's movement set is at most the specification's seven
    seen = pairs.groupBy("timeline_id").agg(F.collect_set("movement").alias("seen"))
    skipped = seen.select("timeline_id", F.explode(F.array_except(all_moves, "seen")).alias("index"))
    skipped = skipped.select("timeline_id", F.lit("skipped_movement").alias("issue"), "index", F.array("index").alias("movements"))
    spans = pairs.groupBy("timeline_id", "segment").agg(F.array_sort(F.collect_set("movement")).alias("movements")).where(F.size("movements") > 1)
    return skipped.unionByName(
        spans.select("timeline_id", F.lit("segment_spans_multiple_movements").alias("issue"), F.col("segment").alias("index"), "movements")
    )


@query("i6_auto_skip_penalty", f"WITH {SQL_SEGMENTS} SELECT spec_id, {r6('pen')} AS skip_penalty FROM pn")
def i6(spark, sf):
    return R.pairwise_min_gap(expected_poses(spark, sf), "spec_id").withColumn("skip_penalty", fixed("skip_penalty"))


@query(
    "i7_uncertain_matches",
    f"""WITH RECURSIVE {sql_alignment(True)} SELECT session_id, segment, movement, {r6('cost', 4)} AS cost, {r6('pen', 4)} AS skip_threshold FROM way JOIN pn ON spec_id = session_id % {SPECS} WHERE cost BETWEEN pen - 0.03 AND pen + 0.03""",
)
def i7(spark, sf):
    costs = materialise(segment_costs(spark, sf), "segment-costs")
    path = align_segments(costs, "session_id", "segment", "skip_penalty").where("segment is not null")
    rows = path.join(costs.select("session_id", "segment", "skip_penalty"), ["session_id", "segment"])
    near = F.col("cost").between(F.col("skip_penalty") - 0.03, F.col("skip_penalty") + 0.03)
    return rows.where(near).select("session_id", "segment", "movement", fixed("cost", 4).alias("cost"), fixed("skip_penalty", 4).alias("skip_threshold"))


_ANCHOR = lambda k, last: f"least(CASE WHEN start_frame + CAST(round_even((end_frame - start_frame) * {k}::DOUBLE / 2, 0) AS BIGINT) <= {last} THEN {last} + 1 ELSE start_frame + CAST(round_even((end_frame - start_frame) * {k}::DOUBLE / 2, 0) AS BIGINT) END, end_frame)"


@query(
    "i8_automatic_timeline",
    f"""WITH RECURSIVE {sql_alignment(True)}, pr AS (SELECT * FROM way WHERE segment IS NOT NULL),
un AS (SELECT DISTINCT pr.session_id, movement FROM pr JOIN pn ON spec_id = session_id % {SPECS} WHERE abs(cost - pen) <= 0.03),
bs AS (SELECT session_id, segment, arg_min(movement, (cost, movement)) AS movement, min(cost) AS cost FROM pr GROUP BY ALL),
o AS (SELECT bs.session_id, bs.segment, bs.movement, run_start AS start_frame, run_end AS end_frame, un.movement IS NOT NULL AS unsure, CASE WHEN pen > 0 THEN greatest(0, 1 - cost / (2 * pen)) ELSE 1 END AS base
 FROM bs JOIN sgm USING (session_id, segment) JOIN pn ON spec_id = bs.session_id % {SPECS} LEFT JOIN un ON un.session_id = bs.session_id AND un.movement = bs.movement),
f AS (SELECT *, {_ANCHOR(0, '(start_frame - 1)')} AS f0, {_ANCHOR(1, 'f0')} AS f1, {_ANCHOR(2, 'f1')} AS f2 FROM o)
SELECT session_id, segment, movement, start_frame, end_frame, round_even(least(greatest(base, CASE WHEN unsure THEN 0.6::DOUBLE ELSE 0.5 END), 0.99) * 10000, 0) / 10000 AS confidence, CASE WHEN unsure THEN 'ambiguous' ELSE 'confirmed' END AS label_status,
 '[{{"phase":"prep","frame":' || f0 || '}},{{"phase":"apex","frame":' || f1 || '}},{{"phase":"hold","frame":' || f2 || '}}]' AS anchors FROM f""",
)
def i8(spark, sf):
    costs = materialise(segment_costs(spark, sf), "segment-costs")
    path = align_segments(costs, "session_id", "segment", "skip_penalty")
    segs = costs.select("session_id", "segment", F.col("run_start").alias("start_frame"), F.col("run_end").alias("end_frame"), F.array(*[F.lit(p) for p in ("prep", "apex", "hold")]).alias("phases"), "skip_penalty")
    out = R.automatic_timeline(materialise(path, "path"), segs, "session_id")
    return out.select("session_id", "segment", "movement", "start_frame", "end_frame", "confidence", "label_status", F.to_json("anchors").alias("anchors"))


@query(
    "i8_anchor_spread",
    f"""WITH {SQL_SEG}, p AS (SELECT timeline_id, seq, start_frame, end_frame, 1 + seq % 4 AS k FROM sg WHERE end_frame - start_frame >= 4)
SELECT timeline_id, seq, list_transform(range(0, k), lambda i: CAST(CASE WHEN k = 1 THEN start_frame ELSE start_frame + round_even((end_frame - start_frame) * i::DOUBLE / (k - 1), 0) END AS BIGINT)) AS anchors FROM p""",
)
def i8b(spark, sf):
    segs = timeline_segments(spark, sf).where("end_frame - start_frame >= 4")
    phases = F.slice(F.array(*[F.lit(p) for p in ("a", "b", "c", "d")]), F.lit(1), (1 + F.col("seq") % 4).cast("int"))
    spread = R.spread_anchors(phases, F.col("start_frame"), F.col("end_frame"))
    return segs.select("timeline_id", "seq", F.transform(spread, lambda a: a["frame"]).alias("anchors"))


# rule_ord, rule_id, error_unit, stances, techniques, operator, lo, hi, floor, guard
RULES = [
    (0, "N1", "stance", ["ECONOMY"], [], "max", 0.0, 30.0, 1.0, 0.5),
    (1, "N2", "stance", [], ["small", "red"], "range", 10.0, 35.0, 0.5, 0.5),
    (2, "N3", "arm", ["SMALL", "PROMO"], ["widget"], "max", 0.0, 25.0, 2.0, 0.0),
    (3, "N4", "arm", [], [], "range", 5.0, 45.0, 1.5, 1.0),
    (4, "N5", "head", ["STANDARD", "LARGE"], ["bolt", "blue", "ring"], "max", 0.0, 20.0, 0.0, 2.0),
]
_RULE_SCHEMA = "rule_ord int, rule_id string, error_unit string, stances array<string>, technique_ids array<string>, op string, lo double, hi double, flr double, guard double"
SQL_RULES = "ru AS (" + " UNION ALL ".join(
    f"SELECT {o} AS rule_ord, '{i}' AS rule_id, '{u}' AS error_unit, {s!r}::VARCHAR[] AS stances, {t!r}::VARCHAR[] AS technique_ids, '{p}' AS op, {lo}::DOUBLE AS lo, {hi}::DOUBLE AS hi, {f}::DOUBLE AS flr, {g}::DOUBLE AS guard"
    for o, i, u, s, t, p, lo, hi, f, g in RULES
) + ")"
SQL_NUMERIC = f"""{SQL_RULES},
mm AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_type AS stance, string_split(p_name, ' ') AS tech, CASE WHEN l_returnflag = 'N' AND l_suppkey % 5 = 0 THEN NULL ELSE l_quantity END AS v, l_tax * 50 AS u FROM lineitem JOIN part ON p_partkey = l_partkey),
nd AS (SELECT mm.*, rule_ord, rule_id, error_unit, op, lo, hi, guard, greatest(u, flr) AS eu FROM mm JOIN ru ON (len(stances) = 0 OR list_contains(stances, stance)) AND (len(technique_ids) = 0 OR list_has_any(technique_ids, tech))),
ns AS (SELECT *, CASE WHEN v IS NULL THEN 'not_measurable' WHEN v - eu > hi + guard OR (op = 'range' AND v + eu < lo - guard) THEN 'confirmed_minor'
 WHEN (op = 'max' AND v + eu <= hi - guard) OR (op = 'range' AND v - eu >= lo + guard AND v + eu <= hi - guard) THEN 'within_range' ELSE 'boundary_uncertain' END AS status FROM nd)"""


def numeric_decisions(spark, sf):
    """Metrics of every movement against the rules that apply to it. The rule table is a document of five rows."""
    lines = T.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity", "l_tax")
    parts = T.read(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("stance"), F.split("p_name", " ").alias("tech"))
    rules = F.array(*[
        F.struct(
            F.lit(o).alias("rule_ord"), F.lit(i).alias("rule_id"), F.lit(u).alias("error_unit"), F.array(*map(F.lit, s)).cast("array<string>").alias("stances"),
            F.array(*map(F.lit, t)).cast("array<string>").alias("technique_ids"), F.lit(p).alias("op"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(f).alias("flr"), F.lit(g).alias("guard"),
        )
        for o, i, u, s, t, p, lo, hi, f, g in RULES
    ])
    # applicability depends on the movement only, so it is settled before the metrics multiply the rows
    applicable = F.filter(rules, lambda r: R.rule_applies(r["stances"], r["technique_ids"], F.col("stance"), F.col("tech")))
    chosen = parts.select("l_partkey", applicable.alias("rules")).where(F.size("rules") > 0)
    rows = lines.join(chosen, "l_partkey").withColumn("r", F.explode("rules"))
    value = F.when(~((F.col("l_returnflag") == "N") & (F.col("l_suppkey") % 5 == 0)), F.col("l_quantity"))
    rows = rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", value.alias("v"), (F.col("l_tax") * 50).alias("u"), "r.*")
    status = R.interval_status(F.col("op"), F.col("lo"), F.col("hi"), F.col("guard"), F.col("v"), F.col("u"), F.col("flr"))
    return rows.withColumn("status", status)


@query("i13_rule_applicability", f"WITH {SQL_NUMERIC} SELECT l_partkey, rule_id, count(*) AS n FROM nd GROUP BY ALL")
def i13(spark, sf):
    return numeric_decisions(spark, sf).groupBy("l_partkey", "rule_id").agg(F.count(F.lit(1)).alias("n"))


@query("i14_interval_decisions", f"WITH {SQL_NUMERIC} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, rule_id, v AS measured_value, {r6('u')} AS uncertainty_95, status FROM ns")
def i14(spark, sf):
    return numeric_decisions(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "rule_id", F.col("v").alias("measured_value"), fixed("u").alias("uncertainty_95"), "status"
    )


@query(
    "i15_deduplicated_deductions",
    f"""WITH {SQL_NUMERIC}, k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, error_unit ORDER BY rule_ord, l_partkey, l_suppkey, v) AS rk FROM ns WHERE status = 'confirmed_minor')
SELECT l_orderkey, l_linenumber, error_unit, rule_id, v AS measured_value, 0.1::DOUBLE AS deduction_points FROM k WHERE rk = 1""",
)
def i15(spark, sf):
    confirmed = numeric_decisions(spark, sf).where("status = 'confirmed_minor'")
    # the first in order is a minimum: combined map-side, no ranking of the whole unit
    first = confirmed.groupBy("l_orderkey", "l_linenumber", "error_unit").agg(F.min(F.struct("rule_ord", "l_partkey", "l_suppkey", "v", "rule_id")).alias("f"))
    return first.select("l_orderkey", "l_linenumber", "error_unit", F.col("f.rule_id").alias("rule_id"), F.col("f.v").alias("measured_value"), F.lit(0.1).alias("deduction_points"))


SQL_OBS = f"""{T.SQL_SERIES}, iv AS (SELECT user_id, idx // 10 AS movement, min(idx) AS s, max(idx) - 2 AS e FROM ev GROUP BY ALL), fc AS (SELECT user_id, count(*) - 3 AS frame_count FROM ev GROUP BY ALL),
ob AS (SELECT user_id, idx, event_id, CASE event_type WHEN 'error' THEN 'restart' WHEN 'purchase' THEN 'pause' ELSE 'wrong_action' END AS kind, CASE event_type WHEN 'error' THEN 'restart' WHEN 'view' THEN 'view' ELSE 'major' END AS unit,
 CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN NULL WHEN event_id % 11 = 0 THEN idx // 10 + 1000 ELSE idx // 10 END AS movement,
 CASE WHEN event_id % 7 = 0 THEN 'inferred' ELSE 'observed' END AS ev_status, (event_id % 10) / 10.0::DOUBLE AS conf, value / 20 AS duration FROM ev),
orr AS (SELECT ob.*, CASE WHEN ev_status <> 'observed' THEN 'not_directly_observed' WHEN conf < 0.3 THEN 'confidence_below_threshold' WHEN idx >= frame_count THEN 'outside_timeline'
 WHEN kind = 'restart' THEN CASE WHEN ob.movement IS NULL THEN NULL ELSE 'restart_must_be_performance_scoped' END WHEN s IS NULL THEN 'unknown_or_unobserved_movement' WHEN idx < s OR idx > e THEN 'outside_movement_interval'
 WHEN kind = 'pause' AND duration < 3 THEN 'pause_duration_below_3_sec' END AS why FROM ob JOIN fc USING (user_id) LEFT JOIN iv ON iv.user_id = ob.user_id AND iv.movement = ob.movement),
oc AS (SELECT *, CASE WHEN why IS NULL AND idx > min(CASE WHEN why IS NULL THEN idx END) OVER (PARTITION BY user_id, movement, unit) THEN 'duplicate_error_unit' ELSE why END AS reason FROM orr)"""


def categorical_rows(spark, sf):
    s = T.series(spark, sf)
    block = F.floor(F.col("idx") / 10)
    intervals = s.groupBy("user_id", block.alias("m")).agg(F.min("idx").alias("s"), (F.max("idx") - 2).alias("e"))
    counts = s.groupBy("user_id").agg((F.count(F.lit(1)) - 3).alias("frame_count"))
    kind = F.when(F.col("event_type") == "error", "restart").when(F.col("event_type") == "purchase", "pause").otherwise("wrong_action")
    unit = F.when(F.col("event_type") == "error", "restart").when(F.col("event_type") == "view", "view").otherwise("major")
    move = F.when((F.col("event_type") == "error") & (F.col("event_id") % 2 == 0), None).when(F.col("event_id") % 11 == 0, block + 1000).otherwise(block)
    ob = s.select(
        "user_id", "idx", "event_id", kind.alias("kind"), unit.alias("unit"), move.alias("movement"), F.when(F.col("event_id") % 7 == 0, "inferred").otherwise("observed").alias("ev_status"),
        ((F.col("event_id") % 10) / 10.0).alias("conf"), (F.col("value") / 20).alias("duration"),
    )
    rows = attach(ob, counts, ["user_id"]).join(intervals.withColumnRenamed("m", "movement"), ["user_id", "movement"], "left")
    why = (
        F.when(F.col("ev_status") != "observed", "not_directly_observed").when(F.col("conf") < 0.3, "confidence_below_threshold").when(F.col("idx") >= F.col("frame_count"), "outside_timeline")
        .when(F.col("kind") == "restart", F.when(F.col("movement").isNotNull(), "restart_must_be_performance_scoped")).when(F.col("s").isNull(), "unknown_or_unobserved_movement")
        .when((F.col("idx") < F.col("s")) | (F.col("idx") > F.col("e")), "outside_movement_interval").when((F.col("kind") == "pause") & (F.col("duration") < 3), "pause_duration_below_3_sec")
    )
    rows = materialise(rows.withColumn("why", why).select("user_id", "idx", "event_id", "kind", "unit", "movement", "why"), "observations")
    first = R.first_eligible(rows, ["user_id", "movement", "unit"], F.col("idx"), F.col("why").isNull())
    reason = F.when(F.col("why").isNull() & ~F.col("is_first"), "duplicate_error_unit").otherwise(F.col("why"))
    points = F.when(reason.isNull(), F.when(F.col("kind") == "restart", 0.6).otherwise(0.3))
    return first.withColumns({"reason": reason, "points": points})


@query("i16_categorical_decisions", f"WITH {SQL_OBS} SELECT user_id, event_id, kind, movement, reason, CASE WHEN reason IS NULL THEN CASE WHEN kind = 'restart' THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END END AS points FROM oc")
def i16(spark, sf):
    return categorical_rows(spark, sf).select("user_id", "event_id", "kind", "movement", "reason", "points")


@query(
    "i17_derived_pauses",
    f"""WITH {SQL_SEG}, g AS (SELECT *, lead(start_frame, 1, 800) OVER (PARTITION BY timeline_id ORDER BY seq) - end_frame - 1 AS gap FROM sg)
SELECT timeline_id, movement_id, end_frame AS anchor_frame, {r6('gap / 30.0::DOUBLE')} AS duration_sec, {r6('greatest(0.8, confidence)')} AS confidence FROM g WHERE gap >= ceil(2.0 * 30)""",
)
def i17(spark, sf):
    return derived_pauses(timeline_segments(spark, sf), 800, 30.0, 2.0)


def derived_pauses(segments, frame_count: int, fps: float, seconds: float, least_confidence: float = 0.8):
    """Gaps after a segment, up to the next one or the end of the recording, of at least ``seconds``."""
    import math

    w = Window.partitionBy("timeline_id").orderBy("seq")  # a timeline's few segments
    gap = F.coalesce(F.lead("start_frame").over(w), F.lit(frame_count)) - F.col("end_frame") - 1
    rows = segments.withColumn("gap", gap).where(F.col("gap") >= math.ceil(seconds * fps))
    return rows.select(
        "timeline_id", "movement_id", F.col("end_frame").alias("anchor_frame"), fixed(F.col("gap") / fps).alias("duration_sec"),
        fixed(F.greatest(F.lit(least_confidence), "confidence")).alias("confidence"),
    )


@query(
    "i18_decision_report",
    f"""WITH {SQL_NUMERIC}, k AS (SELECT l_orderkey, count(DISTINCT l_linenumber || error_unit) FILTER (WHERE status = 'confirmed_minor') AS applied, count(*) AS n, count(*) FILTER (WHERE status = 'boundary_uncertain') AS bu, count(*) FILTER (WHERE status = 'not_measurable') AS nm FROM ns GROUP BY ALL)
SELECT l_orderkey, n AS decision_count, applied AS confirmed_minor_count, bu AS boundary_uncertain_count, nm AS not_measurable_count, {r6('applied * 0.1')} AS deduction_total,
 CASE WHEN o_orderstatus = 'F' THEN 'eligible_for_full_evaluation' ELSE 'observed_scope_only' END AS scoring_status FROM k JOIN orders ON o_orderkey = l_orderkey""",
)
def i18(spark, sf):
    rows = numeric_decisions(spark, sf)
    confirmed = F.when(F.col("status") == "confirmed_minor", F.struct("l_linenumber", "error_unit"))
    k = rows.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("decision_count"), F.countDistinct(confirmed).alias("confirmed_minor_count"),
        count_where(F.col("status") == "boundary_uncertain").alias("boundary_uncertain_count"), count_where(F.col("status") == "not_measurable").alias("not_measurable_count"),
    )
    state = T.read(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderstatus") == "F", "eligible_for_full_evaluation").otherwise("observed_scope_only").alias("scoring_status"))
    return k.join(state, "l_orderkey").withColumn("deduction_total", fixed(F.col("confirmed_minor_count") * 0.1))


SQL_SCORE = f"""{T.SQL_SERIES}, fc AS (SELECT user_id, count(*) - 5 AS frame_count FROM ev GROUP BY ALL),
e0 AS (SELECT ev.*, event_type || ':' || (idx // 4) AS dkey, CASE WHEN event_id % 5 = 0 THEN 'restart' WHEN event_id % 5 = 1 THEN 'major' ELSE 'minor' END AS kind, CASE WHEN event_id % 10 = 5 THEN NULL ELSE idx // 8 END AS movement,
 CASE WHEN event_id % 13 = 0 THEN 'candidate' ELSE 'confirmed_by_rule' END AS dec, CASE WHEN event_id % 17 = 0 THEN 'inferred' ELSE 'observed' END AS evi, (event_id % 20) / 20.0::DOUBLE AS conf, frame_count FROM ev JOIN fc USING (user_id)),
e1 AS (SELECT *, CASE WHEN dec <> 'confirmed_by_rule' THEN 'decision_not_confirmed' WHEN evi <> 'observed' THEN 'insufficient_independent_evidence' WHEN conf < 0.2 THEN 'confidence_below_threshold' END AS early,
 CASE WHEN idx >= frame_count THEN 'event_outside_timeline' WHEN kind = 'restart' THEN CASE WHEN movement IS NOT NULL THEN 'restart_must_be_performance_scoped' END WHEN movement IS NULL THEN 'unknown_movement' WHEN idx % 8 = 7 THEN 'event_outside_movement_interval' END AS late FROM e0),
e2 AS (SELECT *, min(CASE WHEN early IS NULL AND late IS NULL THEN idx END) OVER (PARTITION BY user_id, dkey) AS fa FROM e1),
e3 AS (SELECT *, CASE WHEN early IS NOT NULL THEN early WHEN fa < idx THEN 'duplicate_error_event' ELSE late END AS reason FROM e2)"""


def scored_events(spark, sf):
    """Evidence events with their non-application reason. A key counts as used only after an applied event, so
    the first otherwise eligible row of each key decides; later rows become duplicates at that point of the order."""
    s = T.series(spark, sf)
    counts = s.groupBy("user_id").agg((F.count(F.lit(1)) - 5).alias("frame_count"))
    n = F.col("event_id")
    rows = attach(s, counts, ["user_id"]).withColumns(
        {
            "dkey": F.concat_ws(":", "event_type", F.floor(F.col("idx") / 4).cast("string")), "kind": F.when(n % 5 == 0, "restart").when(n % 5 == 1, "major").otherwise("minor"),
            "movement": F.when(n % 10 != 5, F.floor(F.col("idx") / 8)), "conf": (n % 20) / 20.0,
        }
    )
    early = F.when(n % 13 == 0, "decision_not_confirmed").when(n % 17 == 0, "insufficient_independent_evidence").when(F.col("conf") < 0.2, "confidence_below_threshold")
    late = (
        F.when(F.col("idx") >= F.col("frame_count"), "event_outside_timeline").when(F.col("kind") == "restart", F.when(F.col("movement").isNotNull(), "restart_must_be_performance_scoped"))
        .when(F.col("movement").isNull(), "unknown_movement").when(F.col("idx") % 8 == 7, "event_outside_movement_interval")
    )
    rows = materialise(rows.withColumns({"early": early, "late": late}).select("user_id", "event_id", "idx", "dkey", "kind", "early", "late"), "evidence")
    marked = R.first_eligible(rows, ["user_id", "dkey"], F.col("idx"), F.col("early").isNull() & F.col("late").isNull())
    reason = F.when(F.col("early").isNotNull(), F.col("early")).when(F.col("first_order") < F.col("idx"), "duplicate_error_event").otherwise(F.col("late"))
    amount = F.when(F.col("kind") == "restart", 0.6).when(F.col("kind") == "major", 0.3).otherwise(0.1)
    return marked.withColumns({"reason": reason, "points": F.when(reason.isNull(), amount)})


@query("i19_event_application", f"WITH {SQL_SCORE} SELECT user_id, event_id, kind, reason FROM e3")
def i19(spark, sf):
    return scored_events(spark, sf).select("user_id", "event_id", "kind", "reason")


@query(
    "i19_accuracy_score",
    f"""WITH {SQL_SCORE}, p AS (SELECT user_id, coalesce(sum(CASE WHEN reason IS NULL THEN CASE kind WHEN 'restart' THEN 0.6::DOUBLE WHEN 'major' THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END END), 0) AS d, count(*) AS n, count(*) FILTER (WHERE reason IS NULL) AS a FROM e3 GROUP BY ALL)
SELECT user_id, n AS event_count, a AS applied_count, {r6('d')} AS total_deduction, {r6('greatest(0.0, 4.0 - d)')} AS accuracy_score FROM p""",
)
def i19s(spark, sf):
    total = F.coalesce(F.sum("points"), F.lit(0.0))
    out = scored_events(spark, sf).groupBy("user_id").agg(F.count(F.lit(1)).alias("event_count"), count_where(F.col("reason").isNull()).alias("applied_count"), total.alias("d"))
    return out.select("user_id", "event_count", "applied_count", fixed("d").alias("total_deduction"), fixed(F.greatest(F.lit(0.0), 4.0 - F.col("d"))).alias("accuracy_score"))


SQL_SCREEN = """sc AS (SELECT l_orderkey AS timeline_id, l_linenumber AS movement, l_suppkey % 2 AS family, l_partkey % 3 AS phase, l_partkey * 1000 + l_suppkey AS criterion, l_quantity AS v, l_discount AS q, l_returnflag AS f, 10.0 + l_suppkey % 10 AS lo, 30.0 + l_suppkey % 10 AS hi FROM lineitem),
se AS (SELECT *, list_sort(list_filter([CASE WHEN f = 'R' THEN 'anchor_not_fully_observed' END, CASE WHEN q < 0.02 THEN 'body_valid_ratio_below_gate' END, CASE WHEN v > 49 THEN 'reprojection_error_above_gate' END], lambda w: w IS NOT NULL)) AS why,
 greatest(lo - v, 0.0, v - hi) / greatest(hi - lo, 1e-9) AS dev FROM sc),
ss AS (SELECT *, CASE WHEN len(why) > 0 THEN 'not_measurable' WHEN dev = 0 THEN 'pass' ELSE 'candidate' END AS status FROM se)"""


def screening_rows(spark, sf):
    line = T.read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("timeline_id"), F.col("l_linenumber").alias("movement"), (F.col("l_suppkey") % 2).alias("family"), (F.col("l_partkey") % 3).alias("phase"),
        (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("criterion"), F.col("l_quantity").alias("v"), F.col("l_discount").alias("q"), F.col("l_returnflag").alias("f"),
        (10.0 + F.col("l_suppkey") % 10).alias("lo"), (30.0 + F.col("l_suppkey") % 10).alias("hi"),
    )
    why = F.array_sort(reasons((F.col("f") == "R", "anchor_not_fully_observed"), (F.col("q") < 0.02, "body_valid_ratio_below_gate"), (F.col("v") > 49, "reprojection_error_above_gate")))
    dev = F.greatest(F.col("lo") - F.col("v"), F.lit(0.0), F.col("v") - F.col("hi")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-9))
    rows = line.withColumns({"why": why, "dev": dev})
    return rows.withColumn("status", F.when(F.size("why") > 0, "not_measurable").when(F.col("dev") == 0, "pass").otherwise("candidate"))


@query(
    "i20_engineering_screening",
    f"""WITH {SQL_SCREEN}, k AS (SELECT *, row_number() OVER (PARTITION BY timeline_id, movement, family, phase ORDER BY dev DESC, criterion, v) AS rk FROM ss WHERE status = 'candidate')
SELECT timeline_id, movement, family, phase, criterion, v AS measured_value, {r6('dev')} AS normalized_deviation FROM k WHERE rk = 1""",
)
def i20(spark, sf):
    best = screening_rows(spark, sf).where("status = 'candidate'").groupBy("timeline_id", "movement", "family", "phase").agg(
        F.min(F.struct((-F.col("dev")).alias("k"), "criterion", "v")).alias("b")
    )
    return best.select("timeline_id", "movement", "family", "phase", F.col("b.criterion").alias("criterion"), F.col("b.v").alias("measured_value"), fixed(-F.col("b.k")).alias("normalized_deviation"))


@query(
    "i20_screening_summary",
    f"""WITH {SQL_SCREEN} SELECT timeline_id, count(*) AS measurement_count, count(*) FILTER (WHERE status = 'pass') AS n_pass, count(*) FILTER (WHERE status = 'candidate') AS n_candidate, count(*) FILTER (WHERE status = 'not_measurable') AS n_not_measurable,
 {r6("avg(CASE WHEN status = 'not_measurable' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END)")} AS coverage_ratio FROM ss GROUP BY ALL""",
)
def i20s(spark, sf):
    return screening_rows(spark, sf).groupBy("timeline_id").agg(
        F.count(F.lit(1)).alias("measurement_count"), *R.status_counts(None, [], "status", ["pass", "candidate", "not_measurable"]),
        fixed(F.avg(F.when(F.col("status") == "not_measurable", 0.0).otherwise(1.0))).alias("coverage_ratio"),
    )


@query(
    "i21_metric_rollup",
    f"""SELECT l_suppkey AS metric, l_returnflag AS component, count(l_quantity) AS sample_count, {r6('min(l_quantity)')} AS min_value, {r6('max(l_quantity)')} AS max_value, {r6('median(l_quantity)')} AS median,
 {r6('CASE WHEN count(*) >= 4 THEN quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25) END')} AS iqr FROM lineitem GROUP BY ALL""",
)
def i21(spark, sf):
    rows = T.read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("metric"), F.col("l_returnflag").alias("component"), F.col("l_quantity").alias("v"))
    return R.summarise(rows, ["metric", "component"], "v").withColumns({c: fixed(c) for c in ("min_value", "max_value", "median", "iqr")})


@query(
    "i21_rhythm_rollup",
    f"""WITH {SQL_SEG}, g AS (SELECT movement_id, (end_frame - start_frame + 1) / 30.0::DOUBLE AS dur, greatest(start_frame - lag(end_frame) OVER (PARTITION BY timeline_id ORDER BY seq) - 1, 0) / 30.0::DOUBLE AS gap, lag(end_frame) OVER (PARTITION BY timeline_id ORDER BY seq) AS pe FROM sg),
t AS (SELECT movement_id, 'movement_duration_sec' AS metric, dur AS v FROM g UNION ALL SELECT movement_id, 'transition_gap_sec', gap FROM g WHERE pe IS NOT NULL)
SELECT movement_id, metric, count(v) AS sample_count, {r6('min(v)')} AS min_value, {r6('max(v)')} AS max_value, {r6('median(v)')} AS median, {r6('CASE WHEN count(*) >= 4 THEN quantile_cont(v, 0.75) - quantile_cont(v, 0.25) END')} AS iqr FROM t GROUP BY ALL""",
)
def i21r(spark, sf):
    w = Window.partitionBy("timeline_id").orderBy("seq")  # a timeline's few segments
    s = timeline_segments(spark, sf).withColumn("pe", F.lag("end_frame").over(w))
    dur, gap = (F.col("end_frame") - F.col("start_frame") + 1) / 30.0, F.when(F.col("pe").isNotNull(), F.greatest(F.col("start_frame") - F.col("pe") - 1, F.lit(0)) / 30.0)
    tall = s.select("movement_id", F.inline(F.array(
        F.struct(F.lit("movement_duration_sec").alias("metric"), dur.alias("v")), F.struct(F.lit("transition_gap_sec").alias("metric"), gap.alias("v"))))).where("v IS NOT NULL")
    return R.summarise(tall, ["movement_id", "metric"], "v").withColumns({c: fixed(c) for c in ("min_value", "max_value", "median", "iqr")})


@query(
    "i22_evidence_events",
    f"""WITH {SQL_SEG}, {SQL_NUMERIC}, {SQL_SCREEN},
nu AS (SELECT l_orderkey AS timeline_id, l_linenumber AS seq, 'numeric' AS kind, rule_id AS source_id, max(v) AS value, min(status) AS status FROM ns WHERE status IN ('confirmed_minor', 'boundary_uncertain') GROUP BY ALL),
di AS (SELECT timeline_id, movement AS seq, 'diagnostic' AS kind, 'F' || family AS source_id, max(v) AS value, 'diagnostic_candidate' AS status FROM ss WHERE status = 'candidate' GROUP BY ALL),
un AS (SELECT * FROM nu UNION ALL SELECT * FROM di)
SELECT timeline_id, seq, kind, source_id, value, status, greatest(start_frame, (start_frame + end_frame) // 2 - 6) AS window_start, least(end_frame, (start_frame + end_frame) // 2 + 6) AS window_end,
 CASE status WHEN 'confirmed_minor' THEN 'red' WHEN 'boundary_uncertain' THEN 'amber' ELSE 'blue' END AS presentation,
 CAST(row_number() OVER (PARTITION BY timeline_id, seq ORDER BY kind DESC, source_id) AS INTEGER) AS event_ordinal FROM un JOIN sg USING (timeline_id, seq)""",
)
def i22(spark, sf):
    nu = numeric_decisions(spark, sf).where("status IN ('confirmed_minor', 'boundary_uncertain')").groupBy(
        F.col("l_orderkey").alias("timeline_id"), F.col("l_linenumber").alias("seq"), F.lit("numeric").alias("kind"), F.col("rule_id").alias("source_id")
    ).agg(F.max("v").alias("value"), F.min("status").alias("status"))
    di = screening_rows(spark, sf).where("status = 'candidate'").groupBy(
        "timeline_id", F.col("movement").alias("seq"), F.lit("diagnostic").alias("kind"), F.concat(F.lit("F"), F.col("family").cast("string")).alias("source_id")
    ).agg(F.max("v").alias("value"), F.lit("diagnostic_candidate").alias("status"))
    rows = nu.unionByName(di, allowMissingColumns=True).join(timeline_segments(spark, sf).select("timeline_id", "seq", "start_frame", "end_frame"), ["timeline_id", "seq"])
    middle = F.floor((F.col("start_frame") + F.col("end_frame")) / 2)
    w = Window.partitionBy("timeline_id", "seq").orderBy(F.col("kind").desc(), "source_id")  # at most one event per rule and family
    return rows.select(
        "timeline_id", "seq", "kind", "source_id", "value", "status", F.greatest("start_frame", middle - 6).alias("window_start"), F.least("end_frame", middle + 6).alias("window_end"),
        F.when(F.col("status") == "confirmed_minor", "red").when(F.col("status") == "boundary_uncertain", "amber").otherwise("blue").alias("presentation"),
        F.row_number().over(w).alias("event_ordinal"),
    )


@query(
    "i23_readiness_blockers",
    f"""WITH {SQL_SEG}, s AS (SELECT timeline_id, count(*) AS n, min(confidence) AS c, sum(end_frame - start_frame) AS f FROM sg GROUP BY ALL),
b AS (SELECT o_orderkey AS timeline_id, list_filter([CASE WHEN o_orderstatus <> 'F' THEN 'rule_pack_not_final' END, CASE WHEN n IS NULL THEN 'timeline_missing' WHEN n < 3 THEN 'timeline_incomplete' END, CASE WHEN c < 0.2 THEN 'label_confidence_low' END,
 CASE WHEN coalesce(f, 0) < 60 THEN 'diagnostic_coverage_low' END], lambda w: w IS NOT NULL) AS blockers FROM orders LEFT JOIN s ON s.timeline_id = o_orderkey)
SELECT timeline_id, blockers, len(blockers) = 0 AS ready FROM b""",
)
def i23(spark, sf):
    s = timeline_segments(spark, sf).groupBy("timeline_id").agg(F.count(F.lit(1)).alias("n"), F.min("confidence").alias("c"), F.sum(F.col("end_frame") - F.col("start_frame")).alias("f"))
    o = T.read(spark, sf, "orders").select(F.col("o_orderkey").alias("timeline_id"), "o_orderstatus").join(s, "timeline_id", "left")
    why = reasons(
        (F.col("o_orderstatus") != "F", "rule_pack_not_final"), (F.col("n").isNull(), "timeline_missing"), (F.col("n") < 3, "timeline_incomplete"),
        (F.col("c") < 0.2, "label_confidence_low"), (F.coalesce("f", F.lit(0)) < 60, "diagnostic_coverage_low"),
    )
    return o.select("timeline_id", why.alias("blockers")).withColumn("ready", F.size("blockers") == 0)


@query(
    "i24_source_intake",
    """WITH d AS (SELECT doc_id, sha256(text) AS h, substr(text, 1, 5) AS sig, n_chars, CASE WHEN source IN ('web', 'crawl') THEN 'tier_2' ELSE 'tier_1' END AS tier, lang FROM documents),
c AS (SELECT h, count(*) AS copies FROM d GROUP BY ALL)
SELECT doc_id, tier, sig AS signature, h AS sha256, copies > 1 AS repeated, list_filter([CASE WHEN copies > 1 THEN 'duplicate_content' END, CASE WHEN n_chars < 20 THEN 'too_short' END, CASE WHEN lang IS NULL OR lang <> 'en' THEN 'language_not_supported' END], lambda w: w IS NOT NULL) AS blockers FROM d JOIN c USING (h)""",
)
def i24(spark, sf):
    """Whole texts are hashed; copies are counted by hash with map-side combining and joined back."""
    d = T.read(spark, sf, "documents").select(
        "doc_id", F.sha2("text", 256).alias("sha256"), F.substring("text", 1, 5).alias("signature"), "n_chars",
        F.when(F.col("source").isin("web", "crawl"), "tier_2").otherwise("tier_1").alias("tier"), "lang",
    )
    rows = d.join(d.groupBy("sha256").agg(F.count(F.lit(1)).alias("copies")), "sha256")
    why = reasons((F.col("copies") > 1, "duplicate_content"), (F.col("n_chars") < 20, "too_short"), (F.col("lang").isNull() | (F.col("lang") != "en"), "language_not_supported"))
    return rows.select("doc_id", "tier", "signature", "sha256", (F.col("copies") > 1).alias("repeated"), why.alias("blockers"))


@query(
    "i25_review_cards",
    f"""WITH {SQL_SEG}, {SQL_NUMERIC}, n AS (SELECT l_orderkey AS timeline_id, l_linenumber AS seq, count(*) AS decisions, count(*) FILTER (WHERE status = 'confirmed_minor') AS confirmed, count(*) FILTER (WHERE status = 'not_measurable') AS missing, {r6('avg(v)')} AS mean_value FROM ns GROUP BY ALL)
SELECT timeline_id, seq, movement_id, end_frame - start_frame + 1 AS frames, coalesce(decisions, 0) AS decisions, coalesce(confirmed, 0) AS confirmed, coalesce(missing, 0) AS missing, mean_value,
 CASE WHEN coalesce(confirmed, 0) > 0 THEN 'review' WHEN coalesce(decisions, 0) = 0 THEN 'no_rule' ELSE 'clear' END AS card_state FROM sg LEFT JOIN n USING (timeline_id, seq)""",
)
def i25(spark, sf):
    n = numeric_decisions(spark, sf).groupBy(F.col("l_orderkey").alias("timeline_id"), F.col("l_linenumber").alias("seq")).agg(
        F.count(F.lit(1)).alias("decisions"), count_where(F.col("status") == "confirmed_minor").alias("confirmed"), count_where(F.col("status") == "not_measurable").alias("missing"), fixed(F.avg("v")).alias("mean_value")
    )
    rows = timeline_segments(spark, sf).join(n, ["timeline_id", "seq"], "left").fillna(0, ["decisions", "confirmed", "missing"])
    state = F.when(F.col("confirmed") > 0, "review").when(F.col("decisions") == 0, "no_rule").otherwise("clear")
    return rows.select("timeline_id", "seq", "movement_id", (F.col("end_frame") - F.col("start_frame") + 1).alias("frames"), "decisions", "confirmed", "missing", "mean_value", state.alias("card_state"))


@query(
    "i26_workflow_summary",
    f"""WITH {SQL_SEG}, c AS (SELECT timeline_id, count(*) AS observed FROM sg GROUP BY ALL), {SQL_SCREEN}, m AS (SELECT timeline_id, count(*) FILTER (WHERE status = 'not_measurable') AS nm, count(*) FILTER (WHERE status = 'candidate') AS cand FROM ss GROUP BY ALL)
SELECT o_orderkey AS timeline_id, coalesce(observed, 0) AS observed_movements, 7 - coalesce(observed, 0) AS missing_movements, coalesce(cand, 0) AS candidates, coalesce(nm, 0) AS not_measurable,
 CASE WHEN observed IS NULL THEN 'failed' WHEN observed < 7 THEN 'partial' WHEN coalesce(nm, 0) > 0 THEN 'needs_review' ELSE 'complete' END AS status FROM orders LEFT JOIN c ON c.timeline_id = o_orderkey LEFT JOIN m ON m.timeline_id = o_orderkey""",
)
def i26(spark, sf):
    c = timeline_segments(spark, sf).groupBy("timeline_id").agg(F.count(F.lit(1)).alias("observed"))
    m = screening_rows(spark, sf).groupBy("timeline_id").agg(count_where(F.col("status") == "not_measurable").alias("nm"), count_where(F.col("status") == "candidate").alias("cand"))
    rows = T.read(spark, sf, "orders").select(F.col("o_orderkey").alias("timeline_id")).join(c, "timeline_id", "left").join(m, "timeline_id", "left")
    zero = F.lit(0).cast("long")
    status = F.when(F.col("observed").isNull(), "failed").when(F.col("observed") < 7, "partial").when(F.coalesce("nm", zero) > 0, "needs_review").otherwise("complete")
    return rows.select(
        "timeline_id", F.coalesce("observed", zero).alias("observed_movements"), (7 - F.coalesce("observed", zero)).alias("missing_movements"),
        F.coalesce("cand", zero).alias("candidates"), F.coalesce("nm", zero).alias("not_measurable"), status.alias("status"),
    )
