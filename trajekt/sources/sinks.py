"""A: sinks, report documents, run registry and artefact manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import finite


def null_safe(df: DataFrame) -> DataFrame:
    """NaN and infinities become NULL before anything leaves the engine."""
    return df.withColumns({n: finite(n) for n, t in df.dtypes if t in ("double", "float")})


def write_long(df: DataFrame, path: str, partition: Sequence[str] = ("session_id",), mode: str = "errorifexists", salt: int = 8) -> None:
    """Parquet partitioned by session and sorted for time access.

    Rows are spread over (session, salt) so that one long session is written by several tasks.
    """
    spread = null_safe(df).withColumn("__salt", F.pmod(F.xxhash64(*[c for c in df.columns]), F.lit(salt)))
    order = [c for c in ("joint_idx", "sample_idx", "frame_idx") if c in df.columns]
    spread.repartition(*partition, "__salt").sortWithinPartitions(*partition, *order).drop("__salt").write.mode(mode).partitionBy(*partition).parquet(path)


def report_document(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One JSON text per row; missing values stay as explicit nulls."""
    body = F.to_json(F.struct(*[c for c in df.columns]), {"ignoreNullFields": "false"})
    return null_safe(df).select(*keys, body.alias("document"))


def latest_runs(registry: DataFrame, session: str) -> DataFrame:
    """Latest promoted run per session: a map-side combined maximum."""
    done = registry.where("status = 'passed' AND completed_at IS NOT NULL")
    return done.groupBy(session).agg(F.max(F.struct("completed_at", "run_id")).alias("r")).select(session, "r.run_id", "r.completed_at")


def register_run(spark: SparkSession, path: str, row: DataFrame) -> None:
    """Append-only; written last, so a run without a row never counts as complete."""
    row.write.mode("append").parquet(path)


def manifest(expected: DataFrame, present: DataFrame, name: str = "name") -> DataFrame:
    rows = expected.select(name).join(present, name, "left")
    return rows.withColumn("present", F.col("size").isNotNull())


def bindings_changed(declared: DataFrame, current: DataFrame, path: str, fields: Sequence[str]) -> DataFrame:
    """Declared artefacts whose size or hash no longer agrees; NULL equals NULL only."""
    now = current.select(path, *[F.col(f).alias(f"__now_{f}") for f in fields], F.lit(True).alias("__seen"))
    same: Column = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"__now_{f}"))
    joined = declared.join(now, path, "left")
    verdict = F.when(F.col("__seen").isNull(), "missing").when(~same, "changed").otherwise("bound")
    return joined.select(path, verdict.alias("binding"))
