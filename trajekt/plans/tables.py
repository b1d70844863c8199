"""Motion-shaped views of the given tables, and the same views as oracle SQL.

``embeddings`` serves as pose frames (label = session, 17 joints from the first 51 values, quality
columns from the rest), ``events`` as irregular sensor series, ``orders``/``lineitem`` as intervals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.blocks import DAY_US, index_block, ordinal, time_block

FPS = 30.0
JOINTS = 17

# Four cameras, row-major 3x4 projections built from one 1000 px / 640 x 360 lens.
YAW = {"c0": (1.0, 0.0), "c1": (0.92106, -0.38942), "c2": (0.92106, 0.38942), "c3": (0.69671, 0.71736)}
FOCAL, CX, CY, DEPTH = 1000.0, 640.0, 360.0, 4.0


def rotation(camera: str) -> list[float]:
    c, s = YAW[camera]
    return [c, 0.0, s, 0.0, 1.0, 0.0, -s, 0.0, c]


def intrinsics() -> list[float]:
    return [FOCAL, 0.0, CX, 0.0, FOCAL, CY, 0.0, 0.0, 1.0]


def projection(camera: str) -> list[float]:
    r = rotation(camera)
    t = [0.0, 0.0, DEPTH]
    k = intrinsics()
    rt = [r[0], r[1], r[2], t[0], r[3], r[4], r[5], t[1], r[6], r[7], r[8], t[2]]
    return [sum(k[3 * i + m] * rt[4 * m + j] for m in range(3)) for i in range(3) for j in range(4)]


CAMERAS = {name: projection(name) for name in YAW}


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def micros(name: str) -> Column:
    """Wall-clock timestamp to integer microseconds, independent of the session time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {name})")


# ---------------------------------------------------------------- pose frames


def _hidden(vec: str, j) -> str:
    return f"(({vec} * 7 + {j} * 13) % 23 = 0)"


def _quality(at) -> dict[str, str]:
    """Quality columns of joint ``j``; ``at`` renders the engine's access to value i of the embedding."""
    a, b = at("51 + (j % 13)"), at("51 + ((j + 5) % 13)")
    return {
        "tri_score": f"CASE WHEN (vec_id + j) % 19 = 0 THEN 0.0 WHEN abs({a}) * 6 > 1 THEN 1.0 ELSE abs({a}) * 6 END",
        "reproj_px": f"CASE WHEN (vec_id + j * 5) % 29 = 0 THEN NULL ELSE abs({b}) * 100 END",
        "used_cameras": "CAST(1 + (vec_id + j) % 4 AS INT)",
    }


def _spark_at(i: str) -> str:
    return f"CAST(e[{i}] AS DOUBLE)"


def _sql_at(i: str) -> str:
    return f"CAST(e[({i}) + 1] AS DOUBLE)"


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """One row per frame with the points as an array; no shuffle."""
    base = read(spark, sf, "embeddings").select(
        "vec_id", F.col("label").alias("session_id"), F.col("embedding").alias("e")
    )
    points = (
        f"transform(sequence(0, {JOINTS - 1}), j -> CASE WHEN {_hidden('vec_id', 'j')} THEN NULL ELSE named_struct("
        "'x', CAST(e[3 * j] AS DOUBLE), 'y', CAST(e[3 * j + 1] AS DOUBLE), 'z', CAST(e[3 * j + 2] AS DOUBLE)) END)"
    )
    return base.withColumn("pts", F.expr(points))


def sequence_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Frames with their position in the session and time in seconds."""
    placed = ordinal(frames(spark, sf), ["session_id"], ["vec_id"], index_block("vec_id"))
    return placed.withColumn("t_sec", F.col("sample_idx") / FPS)


def long_points(framed: DataFrame) -> DataFrame:
    """One row per frame and joint, hidden joints as NULL coordinates, with quality columns."""
    keep = [c for c in framed.columns if c not in ("pts", "e")]
    out = framed.select(*keep, "e", F.explode(F.sequence(F.lit(0), F.lit(JOINTS - 1))).alias("j"))
    point = {
        axis: f"CASE WHEN {_hidden('vec_id', 'j')} THEN NULL ELSE CAST(e[3 * j + {i}] AS DOUBLE) END"
        for i, axis in enumerate("xyz")
    }
    columns = [F.expr(text).alias(name) for name, text in {**point, **_quality(_spark_at)}.items()]
    return out.select(*keep, F.col("j").alias("joint_idx"), *columns)


def pose3d(spark: SparkSession, sf: str) -> DataFrame:
    return long_points(sequence_frames(spark, sf))


def _point_columns() -> str:
    out = []
    for j in range(JOINTS):
        for axis, name in enumerate("xyz"):
            out.append(f"CASE WHEN {_hidden('vec_id', j)} THEN NULL ELSE CAST(e[{3 * j + axis + 1}] AS DOUBLE) END AS {name}{j}")
    return ", ".join(out)


_SQL_QUALITY = ", ".join(f"{text} AS {name}" for name, text in _quality(_sql_at).items())

SQL_FRAMES = f"""
f0 AS (SELECT vec_id, label AS session_id, embedding AS e,
  row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS sample_idx FROM embeddings),
fr AS (SELECT *, sample_idx / {FPS}::DOUBLE AS t_sec, {_point_columns()} FROM f0)"""

SQL_LONG = f"""{SQL_FRAMES},
js AS (SELECT CAST(unnest(range({JOINTS})) AS INTEGER) AS j),
p3 AS (SELECT session_id, vec_id, sample_idx, sample_idx / {FPS}::DOUBLE AS t_sec, j AS joint_idx,
  CASE WHEN {_hidden('vec_id', 'j')} THEN NULL ELSE CAST(e[3 * j + 1] AS DOUBLE) END AS x,
  CASE WHEN {_hidden('vec_id', 'j')} THEN NULL ELSE CAST(e[3 * j + 2] AS DOUBLE) END AS y,
  CASE WHEN {_hidden('vec_id', 'j')} THEN NULL ELSE CAST(e[3 * j + 3] AS DOUBLE) END AS z,
  {_SQL_QUALITY}
  FROM f0 CROSS JOIN js)"""


# ---------------------------------------------------------------- truth poses


def truth_offset(vec: str = "vec_id", j: str = "joint_idx") -> tuple[str, str, str]:
    """Deterministic displacement between prediction and truth, as text valid in both engines."""
    return (
        f"(0.02 + (({vec} + {j}) % 7) * 0.01)",
        f"((({vec} * 3 + {j}) % 5) * 0.02 - 0.03)",
        f"((({vec} + {j} * 2) % 11) * 0.005)",
    )


def matched_poses(spark: SparkSession, sf: str) -> DataFrame:
    """Prediction and truth of the same frame and joint side by side (gx, gy, gz = truth)."""
    dx, dy, dz = truth_offset()
    return pose3d(spark, sf).withColumns(
        {
            "gx": F.expr(f"CASE WHEN (vec_id + joint_idx) % 31 = 0 THEN NULL ELSE x + {dx} END"),
            "gy": F.expr(f"CASE WHEN (vec_id + joint_idx) % 31 = 0 THEN NULL ELSE y + {dy} END"),
            "gz": F.expr(f"CASE WHEN (vec_id + joint_idx) % 31 = 0 THEN NULL ELSE z + {dz} END"),
        }
    )


_DX, _DY, _DZ = truth_offset()
SQL_MATCHED = f"""{SQL_LONG},
mt AS (SELECT *, CASE WHEN (vec_id + joint_idx) % 31 = 0 THEN NULL ELSE x + {_DX} END AS gx,
  CASE WHEN (vec_id + joint_idx) % 31 = 0 THEN NULL ELSE y + {_DY} END AS gy,
  CASE WHEN (vec_id + joint_idx) % 31 = 0 THEN NULL ELSE z + {_DZ} END AS gz FROM p3)"""


# ---------------------------------------------------------------- 2D views


def _pixel(camera: str) -> tuple[str, str, str]:
    m = CAMERAS[camera]
    u, v, w = (f"({m[4 * r]!r} * x + {m[4 * r + 1]!r} * y + {m[4 * r + 2]!r} * z + {m[4 * r + 3]!r})" for r in range(3))
    return u, v, w


def _disturbance(number: str) -> tuple[str, str, str]:
    """Gross error, small noise and score of a view, as text valid in both engines."""
    off = f"CASE WHEN (vec_id + joint_idx * 3 + {number} * 5) % 17 = 0 THEN 80.0 ELSE 0.0 END"
    noise = f"((vec_id * 11 + joint_idx * 7 + {number} * 3) % 13 - 6) * CAST(0.2 AS DOUBLE)"
    score = f"CAST(0.25 AS DOUBLE) + ((vec_id * 5 + joint_idx * 3 + {number} * 7) % 16) * CAST(0.05 AS DOUBLE)"
    return off, noise, score


def _view_columns(camera: str, number: int) -> tuple[str, str, str]:
    u, v, w = _pixel(camera)
    off, noise, score = _disturbance(str(number))
    return f"({u} / {w} + {noise} + {off})", f"({v} / {w} - {noise})", score


def pose2d(spark: SparkSession, sf: str) -> DataFrame:
    """Every joint seen by four cameras: projected, with small deterministic noise and some gross errors."""
    rig = F.array(*[
        F.struct(F.lit(name).alias("camera_id"), F.lit(i).alias("n"), F.array(*map(F.lit, m)).alias("p"))
        for i, (name, m) in enumerate(CAMERAS.items())
    ])
    seen = pose3d(spark, sf).withColumn("c", F.explode(rig))
    u, v, w = (f"(c.p[{4 * r}] * x + c.p[{4 * r + 1}] * y + c.p[{4 * r + 2}] * z + c.p[{4 * r + 3}])" for r in range(3))
    off, noise, score = _disturbance("c.n")
    return seen.select(
        "session_id", "vec_id", "sample_idx", "t_sec", "joint_idx", "x", "y", "z", "c.camera_id",
        F.expr(f"({u} / {w} + {noise} + {off})").alias("px"),
        F.expr(f"({v} / {w} - {noise})").alias("py"),
        F.expr(score).cast("double").alias("score"),
    )


def _sql_views() -> str:
    parts = []
    for number, camera in enumerate(CAMERAS):
        u, v, score = _view_columns(camera, number)
        parts.append(
            f"SELECT session_id, vec_id, sample_idx, t_sec, joint_idx, x, y, z, '{camera}' AS camera_id, "
            f"{u} AS px, {v} AS py, CAST({score} AS DOUBLE) AS score FROM p3"
        )
    return " UNION ALL ".join(parts)


SQL_VIEWS = f"""{SQL_LONG},
p2 AS ({_sql_views()})"""


def cameras(spark: SparkSession) -> DataFrame:
    """The fixed four-row camera dimension."""
    rows = [
        (name, 1280, 720, intrinsics(), [0.0] * 5, rotation(name), [0.0, 0.0, DEPTH], CAMERAS[name]) for name in CAMERAS
    ]
    schema = (
        "camera_id string, width int, height int, k array<double>, dist array<double>, "
        "rot array<double>, tvec array<double>, p array<double>"
    )
    return spark.createDataFrame(rows, schema)


def _sql_cameras() -> str:
    rows = []
    for name in CAMERAS:
        rows.append(
            f"SELECT '{name}' AS camera_id, 1280 AS width, 720 AS height, {intrinsics()!r}::DOUBLE[] AS k, "
            f"{rotation(name)!r}::DOUBLE[] AS rot, {[0.0, 0.0, DEPTH]!r}::DOUBLE[] AS tvec, {CAMERAS[name]!r}::DOUBLE[] AS p"
        )
    return " UNION ALL ".join(rows)


SQL_CAMERAS = f"cam AS ({_sql_cameras()})"


# ---------------------------------------------------------------- event series


def series(spark: SparkSession, sf: str) -> DataFrame:
    """Irregular series: entity = user, order = (t_us, event_id), dense position ``idx``."""
    base = read(spark, sf, "events").select(
        "user_id", "event_id", "event_type", "value", micros("ts").alias("t_us")
    )
    return ordinal(base, ["user_id"], ["t_us", "event_id"], time_block("t_us", DAY_US), "idx")


SQL_SERIES = """
ev AS (SELECT user_id, event_id, event_type, value, epoch_us(ts) AS t_us,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events)"""


def r6(text: str, digits: int = 6) -> str:
    """Oracle side of ``functions.numeric.fixed``."""
    scale = f"1e{digits}::DOUBLE"
    return f"(floor(({text}) * {scale} + 0.5) / {scale})"


def projected_views(spark: SparkSession, sf: str) -> DataFrame:
    """Views with the projection (qx, qy) and camera depth of the 3D point beside the observation."""
    rig = pose2d(spark, sf).join(F.broadcast(cameras(spark).select("camera_id", "p")), "camera_id")
    u, v, w = (
        F.col("p")[4 * r] * F.col("x") + F.col("p")[4 * r + 1] * F.col("y") + F.col("p")[4 * r + 2] * F.col("z") + F.col("p")[4 * r + 3]
        for r in range(3)
    )
    return rig.withColumns({"qx": u / w, "qy": v / w, "depth": w}).drop("p")


SQL_PROJECTED = f"""{SQL_VIEWS}, {SQL_CAMERAS},
pj AS (SELECT p2.*, (p[1] * x + p[2] * y + p[3] * z + p[4]) / (p[9] * x + p[10] * y + p[11] * z + p[12]) AS qx,
 (p[5] * x + p[6] * y + p[7] * z + p[8]) / (p[9] * x + p[10] * y + p[11] * z + p[12]) AS qy, (p[9] * x + p[10] * y + p[11] * z + p[12]) AS depth FROM p2 JOIN cam USING (camera_id))"""
