"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

from __future__ import annotations

import json
import os
import time

from trajekt.plans import load_all
from trajekt.session import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "b2_nearest_timestamp_join", "b16_label_lookup", "c6_reprojection_error", "c11_joint_angles", "d1_robust_triangulation", "d5_depth_and_ray_angle", "e1_centered_mean",
    "e9_joint_speed", "e13_temporal_rejection", "e17_tracked_boxes", "f1_validity_by_grouping_sets", "f7_activity_segments", "g1_point_error_summary", "g7_bootstrap_interval", "h12_h16_trajectory_metrics", "i3_monotone_alignment", "i14_interval_decisions", "i15_deduplicated_deductions", "i19_accuracy_score",
)


def main() -> None:
    queries, _ = load_all()
    spark = build_session(CPUS, int(CPUS))
    # untimed pass on the smallest data, so the timed one measures the queries and not JVM start-up
    warm_dir = os.path.join(os.path.dirname(SF_DIR.rstrip("/")), "sf0.001")
    for name in HEADLINE if os.path.isdir(warm_dir) else ():
        queries[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": SF_DIR.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
