"""A: scans of pose documents, flat tables, calibrations, session files and file listings.

Schemas are explicit, never inferred; documents that break their contract go to a quarantine table
with the reason instead of failing the job.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.numeric import finite, reasons

POSE_DOCUMENT = (
    "session_id string, coordinate_system string, joint_names array<string>, frame_indices array<bigint>, "
    "timestamps_sec array<double>, fps double, sample_fps double, points array<array<array<double>>>"
)
FLAT_2D = "session_id string, frame_idx bigint, camera_id string, person_id int, joint_idx int, x double, y double, score double, valid boolean"
FLAT_3D = "session_id string, frame_idx bigint, joint_idx int, x_m double, y_m double, z_m double, timestamp_sec double"
ANALYSIS = "analysis_m_x_right_y_forward_z_up"


def pose_documents(spark: SparkSession, path: str, multiline: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine) of nested [frame][joint][xyz] documents."""
    docs = spark.read.schema(POSE_DOCUMENT).option("multiLine", multiline).json(path)
    joints = F.size("joint_names")
    frames = F.size("points")
    length_ok = lambda c: F.col(c).isNull() | (F.size(c) == frames)
    checked = docs.withColumn(
        "reasons",
        reasons(
            (F.col("coordinate_system").isNull() | (F.col("coordinate_system") != ANALYSIS), "coordinate_system_not_declared"),
            (F.col("points").isNull() | (frames <= 0), "points_missing"),
            (joints != F.size(F.array_distinct("joint_names")), "joint_names_not_unique"),
            (F.col("joint_names").isNotNull() & F.exists("points", lambda f: F.size(f) != joints), "joint_axis_mismatch"),
            (~length_ok("frame_indices"), "frame_indices_length"),
            (~length_ok("timestamps_sec"), "timestamps_length"),
        ),
    )
    good = checked.where(F.size("reasons") == 0).withColumn("fps", F.coalesce("fps", "sample_fps"))
    rows = good.select("session_id", "fps", "frame_indices", "timestamps_sec", "joint_names", F.posexplode("points").alias("pos", "frame"))
    rows = rows.select(
        "session_id", "fps", F.coalesce(F.get("frame_indices", F.col("pos")), F.col("pos").cast("long")).alias("frame_idx"),
        F.get("timestamps_sec", F.col("pos")).alias("t_sec"), "joint_names", F.posexplode("frame").alias("joint_idx", "xyz"),
    )
    # a coordinate that is not finite makes the point unknown
    xyz = [finite(F.get("xyz", F.lit(i))) for i in range(3)]
    whole = G.present(xyz)
    out = rows.select(
        "session_id", "fps", "frame_idx", "t_sec", "joint_idx", F.coalesce(F.get("joint_names", F.col("joint_idx")), F.concat(F.lit("joint_"), F.col("joint_idx").cast("string"))).alias("joint_name"),
        *[F.when(whole, c).alias(a) for a, c in zip("xyz", xyz)],
    )
    return out, checked.where(F.size("reasons") > 0).select("session_id", "reasons")


def flat_keypoints_2d(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    reader = spark.read.schema(FLAT_2D)
    df = reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)
    return df.withColumns({"person_id": F.coalesce("person_id", F.lit(0)), "x": finite("x"), "y": finite("y"), "score": finite("score")})


def flat_keypoints_3d(spark: SparkSession, path: str, joints: int, fmt: str = "csv") -> DataFrame:
    """Flat rows made dense: every listed frame gets every joint, unlisted ones NULL."""
    reader = spark.read.schema(FLAT_3D)
    df = reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)
    grid = df.select("session_id", "frame_idx").distinct().withColumn("joint_idx", F.explode(F.sequence(F.lit(0), F.lit(joints - 1))))
    points = df.select("session_id", "frame_idx", "joint_idx", *[finite(f"{a}_m").alias(a) for a in "xyz"])
    return grid.join(points, ["session_id", "frame_idx", "joint_idx"], "left")


def selected_observations(views: DataFrame, active: DataFrame, on: Sequence[str]) -> DataFrame:
    """Only observations that an active event asks for; a semi join, so Spark can prune the scan by it."""
    good = views.where("px IS NOT NULL AND py IS NOT NULL AND valid")
    return good.join(active.select(*on).distinct(), list(on), "left_semi")


def calibration_problems(cameras: DataFrame) -> dict[str, Column]:
    """Checks of a calibration bundle (columns k, dist, rvec, tvec, p, width, height)."""

    def bad(column: str, size: int) -> Column:
        return F.col(column).isNull() | (F.size(column) != size) | F.exists(column, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))

    nine = [F.get("k", F.lit(i)) for i in range(9)]
    return {
        "intrinsics_shape": bad("k", 9), "rotation_shape": bad("rvec", 3), "translation_shape": bad("tvec", 3), "projection_shape": bad("p", 12),
        "image_size": ~F.coalesce((F.col("width") > 0) & (F.col("height") > 0), F.lit(False)),
        "singular_intrinsics": F.abs(G.determinant3(nine)) < 1e-12,
    }


def mapping_lines(spark: SparkSession, path: str) -> DataFrame:
    """Two-column text file: sequence, camera setting."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).select(F.get(parts, F.lit(0)).alias("sequence"), F.get(parts, F.lit(1)).alias("setting")).where("setting IS NOT NULL")


SETTING_CAMERA = "name string, size array<int>, matrix array<array<double>>, distortions array<double>, rotation array<double>, translation array<double>"


def setting_cameras(spark: SparkSession, path: str) -> DataFrame:
    """Cameras of setting files, each a JSON array of cameras in a folder setting=<name>: image size, intrinsics, distortion, pose and projection.

    The rotation is a vector; the projection is the intrinsic matrix times (rotation | translation). A camera without three numbers each for
    rotation and translation has a null projection.
    """
    raw = spark.read.schema(SETTING_CAMERA + ", setting string").option("basePath", path).json(path)
    k = [F.get(F.get("matrix", F.lit(i)), F.lit(j)) for i in range(3) for j in range(3)]
    r = G.rotation_from_vector([F.get("rotation", F.lit(i)) for i in range(3)])
    t = [F.get("translation", F.lit(i)) for i in range(3)]
    pose = [r[0], r[1], r[2], t[0], r[3], r[4], r[5], t[1], r[6], r[7], r[8], t[2]]
    whole = (F.size("rotation") == 3) & (F.size("translation") == 3)
    return raw.select(
        "setting", F.col("name").alias("camera_id"), F.get("size", F.lit(0)).alias("width"), F.get("size", F.lit(1)).alias("height"), F.array(*k).alias("k"), F.col("distortions").alias("dist"),
        F.col("rotation").alias("rvec"), F.col("translation").alias("tvec"), F.when(whole, F.array(*G.matmul3(k, pose, 4))).alias("p"),
    )


def selected_cameras(settings: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted cameras (setting, camera_id) with their calibration and a verdict: found, camera_missing or setting_missing."""
    known = settings.select("setting").distinct().withColumn("__known", F.lit(True))
    rows = wanted.join(known, "setting", "left").join(settings, ["setting", "camera_id"], "left")
    verdict = F.when(F.col("__known").isNull(), "setting_missing").when(F.col("p").isNull(), "camera_missing").otherwise("found")
    return rows.withColumn("verdict", verdict).drop("__known")


def file_listing(spark: SparkSession, path: str, pattern: str, groups: Sequence[str], glob: str = "*") -> DataFrame:
    """File names parsed by a regular expression; only path and length are read, never the content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path", "length")
    return parse_names(files.withColumn("name", F.element_at(F.split("path", "/"), -1)), "name", pattern, groups)


def parse_names(df: DataFrame, name: str, pattern: str, groups: Sequence[str]) -> DataFrame:
    return df.where(F.col(name).rlike(pattern)).withColumns({g: F.regexp_extract(name, pattern, i + 1) for i, g in enumerate(groups)})


def artifact_files(spark: SparkSession, path: str) -> DataFrame:
    """Name, size and hash of small artefact files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


SESSION_ROW = "path string, session_id string, camera_id string, frame_offset double, time_offset_sec double, fps double, error string"


def session_documents(spark: SparkSession, path: str) -> DataFrame:
    """Session YAML files, one row per camera; unreadable ones carry an error. Parsing runs in the tasks."""
    return parsed_sessions(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value"))


def parsed_sessions(texts: DataFrame) -> DataFrame:
    """Session documents (path, value) from files or from a document store, one row per camera."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for batch in batches:
            rows = []
            for where, text in zip(batch["path"], batch["value"]):
                try:
                    doc = yaml.safe_load(text) or {}
                    sync = doc.get("sync") or {}
                    frames, seconds = sync.get("frame_offsets") or {}, sync.get("time_offsets_sec") or {}
                    cameras = [str(c["camera_id"]) for c in doc.get("cameras") or []]
                    extra = [c for c in {**frames, **seconds} if c not in cameras]
                    for c in [*cameras, *extra]:
                        error = "offset_for_unknown_camera" if c in extra else None
                        rows.append((where, str(doc.get("session_id")), c, frames.get(c, 0), seconds.get(c, 0.0), doc.get("fps"), error))
                    if not cameras:
                        rows.append((where, str(doc.get("session_id")), None, None, None, doc.get("fps"), "no_cameras"))
                except (yaml.YAMLError, TypeError, KeyError, AttributeError):
                    rows.append((where, None, None, None, None, None, "unreadable"))
            frame = pd.DataFrame(rows, columns=["path", "session_id", "camera_id", "frame_offset", "time_offset_sec", "fps", "error"])
            for c in ("frame_offset", "time_offset_sec", "fps"):
                frame[c] = pd.to_numeric(frame[c], errors="coerce").astype(float)
            yield frame

    return texts.mapInPandas(parse, SESSION_ROW)


def session_problems() -> dict[str, Column]:
    return {
        "unsafe_session_id": ~F.coalesce(F.col("session_id").rlike("^[A-Za-z0-9][A-Za-z0-9._-]*$"), F.lit(False)),
        "fractional_frame_offset": F.col("frame_offset") != F.floor("frame_offset"),
        "nonpositive_fps": F.col("fps") <= 0,
        "document_error": F.col("error").isNotNull(),
    }
