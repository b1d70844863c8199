"""Session settings shared by tests, bench and jobs."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(cores: str | int = "*", shuffle_partitions: int | None = None) -> SparkSession:
    """Local session for tests and benches; on a cluster use the session that spark-submit provides."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("trajekt")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TRAJEKT_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.extraJavaOptions", "-Xss16m")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="trajekt-"))
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


_private: dict[str, str] = {}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; where none is set, a private one, in local mode only."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder before running on a cluster")
    own = spark.conf.get("spark.app.id")
    if own not in _private:
        _private[own] = tempfile.mkdtemp(prefix="trajekt-")
    return _private[own]


def materialise(df, label: str = "stage"):
    """Cut lineage: write once as Parquet under the shared checkpoint folder and read it back.

    Used where a result feeds several later passes; unlike ``checkpoint()`` it computes the input once
    and later reads prune columns. Survives lost executors because nothing is kept on a worker.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/trajekt-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
