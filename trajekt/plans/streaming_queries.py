"""E15-E19: causal filter and identity tracking, as batch scans and as a streaming job."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import fixed
from ..operators import boxes as B
from ..session import ensure_checkpoint_dir
from ..streaming import causal as C
from . import tables as T
from .geometry_queries import _sql_bbox
from .registry import query
from .source_queries import scratch

r6 = T.r6
FRAME = ["session_id", "camera_id", "sample_idx"]


def view_frames(spark, sf):
    """One row per camera frame with the joints as arrays (a frame's joint count bounds them)."""
    v = T.pose2d(spark, sf)
    entry = F.struct("joint_idx", "px", "py", "score")
    packed = v.groupBy(*FRAME).agg(F.array_sort(F.collect_list(entry), lambda a, b: a["joint_idx"] - b["joint_idx"]).alias("j"))
    return packed.select(
        *FRAME, (F.floor(F.col("sample_idx") / 25) % 2).cast("int").alias("person_id"), F.transform("j", lambda e: e["px"]).alias("xs"), F.transform("j", lambda e: e["py"]).alias("ys"),
        F.transform("j", lambda e: e["score"]).alias("scores"), F.transform("j", lambda e: e["px"].isNotNull() & (e["score"] >= 0.3)).alias("valid"),
    )


def exploded(df):
    rows = df.select(*FRAME, F.posexplode(F.arrays_zip("xs", "ys", "scores", "valid")).alias("joint_idx", "p"))
    return rows.select(*FRAME, "joint_idx", fixed("p.xs", 3).alias("px"), fixed("p.ys", 3).alias("py"), fixed("p.scores", 3).alias("score"), F.col("p.valid").alias("valid"))


@query("e15_causal_filter")
def e15(spark, sf):
    return exploded(C.causal_filter(view_frames(spark, sf)))


DELAY = 30
#: Steps in which a recording arrives, as long as a step has at most MOST_TURNS turns of DELAY frames; longer recordings take more steps, not longer ones.
STEPS, MOST_TURNS = 24, 128
#: Files of a step; a camera is in one of them, so a trigger may end between any two.
STEP_FILES = 8


def turns_in_step(frames: int, delay: int = DELAY) -> int:
    """Turns of `delay` frames that arrive together in a recording of so many frames, whose last turn may come late."""
    turns = frames // delay + 2
    return min(-(-turns // STEPS), MOST_TURNS)


def arriving(spark, sf, source: str, delay: int = DELAY):
    """Frames as files in the order of time, as a recorder leaves them; every seventh frame comes a turn later than it should, and an empty frame
    ends each camera's recording. The frames are stored once by step, and each step is written from its own part."""
    frames = view_frames(spark, sf)
    longest = T.sequence_frames(spark, sf).agg(F.coalesce(F.max("sample_idx") + 1, F.lit(0))).first()[0]
    turn = F.floor(F.col("sample_idx") / delay) + F.when(F.col("sample_idx") % 7 == 3, 1).otherwise(0)
    dealt, camera = scratch(spark, "arriving"), ["session_id", "camera_id"]
    frames.withColumn("__step", F.floor(turn / turns_in_step(longest, delay)).cast("int")).repartition("__step", *camera).write.partitionBy("__step").parquet(dealt)
    stored = spark.read.schema(f"{C.FRAME}, __step int").parquet(dealt)
    for k in sorted(r[0] for r in stored.select("__step").distinct().collect()):
        stored.where(F.col("__step") == k).drop("__step").repartition(STEP_FILES, *camera).write.mode("append").parquet(source)
    ends = stored.groupBy(*camera).agg((F.max("sample_idx") + 2 * delay + 1).alias("sample_idx")).withColumn("person_id", F.lit(0))
    ends = ends.withColumns({c: F.array().cast(dict(frames.dtypes)[c]) for c in ("xs", "ys", "scores", "valid")}).select(*frames.columns)
    ends.coalesce(1).write.mode("append").parquet(source)
    return frames.schema


@query("e15_causal_filter_stream")
def e15s(spark, sf):
    """The same recurrence as a streaming job over files in the order of time, with frames up to twice DELAY behind; its state holds those only."""
    return exploded(filtered_stream(spark, sf).where("not late"))


def filtered_stream(spark, sf, delay: int = DELAY):
    source, sink = scratch(spark, "frames"), scratch(spark, "filtered")
    schema = arriving(spark, sf, source, delay)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", STEP_FILES).parquet(source)
    offsets = f"{ensure_checkpoint_dir(spark)}/{sink.rsplit('/', 1)[1]}-offsets"
    job = C.causal_filter_reordered(stream, delay_frames=2 * delay).writeStream.format("parquet").option("checkpointLocation", offsets)
    job.outputMode("append").trigger(availableNow=True).start(sink).awaitTermination()
    return spark.read.schema(C.REORDERED).parquet(sink)


@query("e16_left_right_repair")
def e16(spark, sf):
    return exploded(C.causal_filter(view_frames(spark, sf), C.FilterSettings(repair_sides=True)))


def candidate_boxes(spark, sf):
    out = B.boxes_from_points(T.pose2d(spark, sf), FRAME, F.col("px"), F.col("py"), image=(1280, 720)).where("bbox IS NOT NULL")
    return out.select(*FRAME, *[c.alias(n) for n, c in zip(("x0", "y0", "x1", "y1"), B.box("bbox"))])


def _inside(text: str, last: int) -> str:
    return f"greatest(least({text}, {last}), 0.0)"


SQL_CANDIDATES = f"""{T.SQL_VIEWS}, {_sql_bbox(5, 32.0)},
cb AS (SELECT session_id, camera_id, sample_idx, row_number() OVER (PARTITION BY session_id, camera_id ORDER BY sample_idx) AS rn, {', '.join(f"{_inside(f'c{a} {sign} {side} / 2', last)} AS {a}{k}" for k, sign in ((0, '-'), (1, '+')) for a, side, last in (('x', 'w', 1279), ('y', 'h', 719)))} FROM bx WHERE n >= 5)"""
# the recurrence one frame at a time, from centre (c) and size (s) of the held box (o) and the seen one (n)
SQL_FOLLOWED = f"""{SQL_CANDIDATES}, tr AS (SELECT session_id, camera_id, sample_idx, rn, x0, y0, x1, y1 FROM cb WHERE rn = 1 UNION ALL
SELECT session_id, camera_id, sample_idx, rn, {_inside('cx - sx / 2', 1279)}, {_inside('cy - sy / 2', 719)}, {_inside('cx + sx / 2', 1279)}, {_inside('cy + sy / 2', 719)} FROM (
 SELECT *, {', '.join(f'oc{a} + (1 - pow(0.65, g)) * k * (nc{a} - oc{a}) AS c{a}, os{a} + (1 - pow(CASE WHEN ch{a} >= 0 THEN 0.75 ELSE 0.92 END, g)) * ch{a} AS s{a}' for a in 'xy')} FROM (
 SELECT *, least(1.0, 0.30 * sqrt(osx * osx + osy * osy) * g / greatest(sqrt(pow(ncx - ocx, 2) + pow(ncy - ocy, 2)), 1e-300)) AS k, {', '.join(f'least(greatest(ns{a}, os{a} * pow(0.75, least(g, 3))), os{a} * pow(1.35, least(g, 3))) - os{a} AS ch{a}' for a in 'xy')} FROM (
 SELECT b.session_id, b.camera_id, b.sample_idx, b.rn, greatest(b.sample_idx - t.sample_idx, 1)::DOUBLE AS g, {', '.join(f'(t.{a}0 + t.{a}1) / 2 AS oc{a}, (b.{a}0 + b.{a}1) / 2 AS nc{a}, greatest(t.{a}1 - t.{a}0, 32.0) AS os{a}, greatest(b.{a}1 - b.{a}0, 32.0) AS ns{a}' for a in 'xy')}
 FROM tr t JOIN cb b ON b.session_id = t.session_id AND b.camera_id = t.camera_id AND b.rn = t.rn + 1))))"""


def _padded(name: str) -> str:
    size = {a: f"greatest({name}{a}1 - {name}{a}0, 2.0) * 1.36" for a in "xy"}
    return ", ".join(f"{_inside(f'({name}{a}0 + {name}{a}1) / 2 {sign} {size[a]} / 2', last)} AS p{name}{a}{k}" for k, sign in ((0, "-"), (1, "+")) for a, last in (("x", 1279), ("y", 719)))


def sql_identity(mine: str, my_conf: str, decoy: str, decoy_conf: str) -> str:
    """Identity and steadied box one frame at a time; every frame has the athlete's box (1) and a decoy (2), where their conditions hold."""
    box = lambda a: f"CASE WHEN choice = id THEN oc{a} + wt * (nc{a} - oc{a}) {{0}} (os{a} + wt * (ns{a} - os{a})) / 2 ELSE n{a}{{1}} END"
    return f"""{SQL_CANDIDATES}, dt AS (SELECT *, sample_idx + session_id AS n FROM cb),
d1 AS (SELECT *, x0 AS mx0, y0 AS my0, x1 AS mx1, y1 AS my1, x0 + 60.0 AS dx0, y0 AS dy0, x0 + 60.0 + (x1 - x0) * 0.5 AS dx1, y1 AS dy1, CAST({my_conf} AS DOUBLE) AS mc, CAST({decoy_conf} AS DOUBLE) AS dc, ({mine}) AND x1 > x0 AND y1 > y0 AS mu, ({decoy}) AND x1 > x0 AND y1 > y0 AS du FROM dt),
d2 AS (SELECT *, mu AND mc >= 0.65 AS ms, du AND dc >= 0.65 AS ds, (mx1 - mx0) * (my1 - my0) AS ma, (dx1 - dx0) * (dy1 - dy0) AS da FROM d1),
d3 AS (SELECT *, greatest(CASE WHEN ms THEN ma ELSE 0 END, CASE WHEN ds THEN da ELSE 0 END, 1.0) AS top FROM d2),
fd AS (SELECT session_id, camera_id, sample_idx, rn, mu, du, mc, dc, {_padded('m')}, {_padded('d')}, CASE WHEN ms AND (NOT ds OR mc + 0.08 * sqrt(ma / top) >= dc + 0.08 * sqrt(da / top)) THEN 1 WHEN ds THEN 2 END AS best FROM d3),
tr AS (SELECT session_id, camera_id, CAST(0 AS BIGINT) AS sample_idx, CAST(0 AS BIGINT) AS rn, -1 AS id, 0 AS missed, 0.0::DOUBLE AS conf, 0.0::DOUBLE AS x0, 0.0::DOUBLE AS y0, 0.0::DOUBLE AS x1, 0.0::DOUBLE AS y1, FALSE AS shown, FALSE AS found FROM fd WHERE rn = 1 UNION ALL
SELECT session_id, camera_id, sample_idx, rn, CASE WHEN choice IS NULL THEN id ELSE choice END, CASE WHEN choice IS NULL THEN mi ELSE 0 END, CASE WHEN choice IS NULL THEN conf ELSE nconf END,
 {', '.join(f"CASE WHEN choice IS NULL THEN {a}{k} ELSE {box(a).format('-' if k == 0 else '+', k)} END" for k in (0, 1) for a in 'xy')}, choice IS NOT NULL OR (id >= 0 AND mi <= 30), choice IS NOT NULL FROM (
 SELECT *, 0.35 + 0.65 * least(1.0, (sqrt(pow(ncx - ocx, 2) + pow(ncy - ocy, 2)) / greatest(sqrt(osx * osx + osy * osy), 2.0) + greatest(abs(ln(nsx / osx)), abs(ln(nsy / osy)))) / 0.12) AS wt FROM (
 SELECT *, {', '.join(f'({a}0 + {a}1) / 2 AS oc{a}, greatest({a}1 - {a}0, 2.0) AS os{a}, (n{a}0 + n{a}1) / 2 AS nc{a}, greatest(n{a}1 - n{a}0, 2.0) AS ns{a}' for a in 'xy')} FROM (
 SELECT *, CASE choice WHEN 1 THEN mc ELSE dc END AS nconf, {', '.join(f'CASE choice WHEN 1 THEN pm{a}{k} ELSE pd{a}{k} END AS n{a}{k}' for a in 'xy' for k in (0, 1))} FROM (
 SELECT *, CASE WHEN seen THEN id WHEN id < 0 OR mi >= 12 THEN best END AS choice FROM (
 SELECT *, missed + (id >= 0 AND NOT seen)::INT AS mi FROM (
 SELECT f.*, t.id, t.missed, t.conf, t.x0, t.y0, t.x1, t.y1, (t.id = 1 AND mu) OR (t.id = 2 AND du) AS seen FROM tr t JOIN fd f ON f.session_id = t.session_id AND f.camera_id = t.camera_id AND f.rn = t.rn + 1)))))))"""


_BOX3 = ", ".join(f"{r6(c, 3)} AS {c}" for c in ("x0", "y0", "x1", "y1"))


@query("e17_tracked_boxes", f"WITH RECURSIVE {SQL_FOLLOWED} SELECT session_id, camera_id, sample_idx, {_BOX3} FROM tr")
def e17(spark, sf):
    return C.track_boxes(candidate_boxes(spark, sf)).withColumns({c: fixed(c, 3) for c in ("x0", "y0", "x1", "y1")})


def detections(spark, sf):
    """Per frame the athlete's box, a displaced decoy and sometimes nothing."""
    b = candidate_boxes(spark, sf)
    n = F.col("sample_idx") + F.col("session_id")
    det = lambda dx, k, conf, track: F.struct(
        (F.col("x0") + dx).alias("x0"), F.col("y0").alias("y0"), (F.col("x0") + dx + (F.col("x1") - F.col("x0")) * k).alias("x1"), F.col("y1").alias("y1"), conf.cast("double").alias("conf"), F.lit(track).alias("track_id")
    )
    me, decoy = det(0.0, 1.0, F.lit(0.60) + (n % 8) * 0.05, 1), det(60.0, 0.5, F.lit(0.55) + (n % 5) * 0.09, 2)
    return b.select(*FRAME, F.array_compact(F.array(F.when(n % 9 != 0, me), F.when(n % 4 != 3, decoy))).alias("dets"))


@query(
    "e18_identity_selection",
    f"""WITH RECURSIVE {sql_identity('n % 9 <> 0', '0.60 + (n % 8) * 0.05::DOUBLE', 'n % 4 <> 3', '0.55 + (n % 5) * 0.09::DOUBLE')}
SELECT session_id, camera_id, sample_idx, id AS track_id, {r6('conf', 3)} AS confidence, found AS detected, {_BOX3} FROM tr WHERE shown""",
)
def e18(spark, sf):
    return C.select_identity(detections(spark, sf)).withColumns({c: fixed(c, 3) for c in ("x0", "y0", "x1", "y1", "confidence")})


@query("e19_box_stabiliser", f"WITH RECURSIVE {sql_identity('TRUE', '0.9', 'FALSE', '0.0')} SELECT session_id, camera_id, sample_idx, {_BOX3} FROM tr WHERE shown")
def e19(spark, sf):
    """Every frame's own box padded and steadied, always the same identity."""
    b = candidate_boxes(spark, sf)
    one = F.array(F.struct("x0", "y0", "x1", "y1", F.lit(0.9).alias("conf"), F.lit(1).alias("track_id")))
    return C.select_identity(b.select(*FRAME, one.alias("dets"))).select(*FRAME, *[fixed(c, 3).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query(
    "e18_initial_pick",
    f"""WITH d AS (SELECT l_orderkey AS frame, l_linenumber, l_partkey, l_suppkey, l_discount * 10 AS conf, l_quantity * (1 + l_partkey % 7) AS area FROM lineitem WHERE l_discount * 10 >= 0.65),
m AS (SELECT *, greatest(max(area) OVER (PARTITION BY frame), 1.0) AS mx FROM d), s AS (SELECT *, floor((conf + 0.08 * sqrt(area / mx)) * 1e9 + 0.5) AS k FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY k DESC, l_linenumber, l_partkey, l_suppkey, area) AS rk FROM s) SELECT frame, l_linenumber, l_partkey, l_suppkey, {r6('k / 1e9', 5)} AS score FROM r WHERE rk = 1""",
)
def e18i(spark, sf):
    d = T.read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("frame"), "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_discount") * 10).alias("conf"), (F.col("l_quantity") * (1 + F.col("l_partkey") % 7)).alias("area")
    ).where("conf >= 0.65")
    # a maximum per frame and a minimum over (-score, order): both combine map-side
    top = d.groupBy("frame").agg(F.greatest(F.max("area"), F.lit(1.0)).alias("mx"))
    k = F.floor((F.col("conf") + 0.08 * F.sqrt(F.col("area") / F.col("mx"))) * 1e9 + 0.5)
    best = d.join(top, "frame").groupBy("frame").agg(F.min(F.struct((-k).alias("k"), "l_linenumber", "l_partkey", "l_suppkey", "area")).alias("b"))
    return best.select("frame", "b.l_linenumber", "b.l_partkey", "b.l_suppkey", fixed(-F.col("b.k") / 1e9, 5).alias("score"))
