"""Registry contract, and a cross-section of the families against the oracle on the smallest data."""

import os
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
import check  # noqa: E402

import __spark_entry__ as entry_module  # noqa: E402

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "a5_calibration_checks", "b2_nearest_timestamp_join", "b4_multi_rate_frame_map", "b16_label_lookup", "c11_joint_angles", "c17_center_of_mass", "d14_depth_constraint_fusion",
    "e4_robust_savgol", "e8_fill_short_gaps", "f1_validity_by_grouping_sets", "f7_activity_segments", "g1_point_error_summary", "h5_h7_posture_metrics", "i14_interval_decisions", "i19_accuracy_score",
]


def test_every_oracle_has_a_query():
    queries, oracles = entry_module.queries(), entry_module.oracle_sql()
    assert len(queries) > 150 and set(oracles) <= set(queries)


def test_entry_runs(spark):
    frame = entry_module.entry(spark)
    assert frame.count() > 0 and "segment_id" in frame.columns


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_oracle(spark, name):
    result = check.compare(entry_module.queries()[name](spark, SF), check.connect(SF), entry_module.oracle_sql()[name])
    assert result.startswith("ok"), result


def test_shift_assessment_shuffles_points_not_distances(spark, tmp_path):
    """One long session has 13 distances for each point of 8 joints; no stage may pass them on, so that a task's memory doesn't follow them."""
    n, sc = 2000, spark.sparkContext
    values = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda j: (F.pmod(F.xxhash64("id", j), F.lit(2000)) / 10000.0 - 0.1).cast("float"))
    frames = spark.range(n).select(F.col("id").alias("vec_id"), values.alias("embedding"), F.lit(0).alias("label"))
    frames.write.parquet(f"{tmp_path}/embeddings.parquet")

    def written():
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = set(written())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    name = "b23_shift_assessment"
    result = check.compare(entry_module.queries()[name](spark, str(tmp_path)), con, entry_module.oracle_sql()[name])
    assert result == "ok 4", result
    points = n * 9 * 4  # the signature reads nine joints in four cameras
    assert max(records for stage, records in written().items() if stage not in before) < 2 * points
