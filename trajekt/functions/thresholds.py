"""Screening limits of the whole-body diagnostics."""

# The limits that results are compared with.
THRESHOLDS = {
    "torso_lean_p95_deg_max": 15.0,
    "shoulder_hip_twist_deg_max": 20.0,
    "head_torso_yaw_mismatch_deg_max": 25.0,
    "expected_side_dominance_ratio_min": 1.10,
    "hikite_hip_distance_body_scale_max": 0.45,
    "wrist_forearm_alignment_deg_max": 30.0,
    "fist_closure_ratio_max": 0.90,
    "simultaneity_sec_max": 0.20,
    "fixation_wrist_jitter_body_scale_max": 0.05,
    "weight_transfer_body_scale_min": 0.03,
    "path_efficiency_punch_max": 1.80,
    "path_efficiency_block_max": 2.60,
    "ap_seogi_span_ratio_min": 0.20,
    "ap_seogi_span_ratio_max": 0.60,
    "ap_seogi_front_knee_deg_min": 155.0,
    "ap_seogi_front_knee_deg_max": 180.0,
    "ap_gubi_span_ratio_min": 0.45,
    "ap_gubi_span_ratio_max": 0.95,
    "ap_gubi_front_knee_deg_min": 120.0,
    "ap_gubi_front_knee_deg_max": 170.0,
    "punch_wrist_height_torso_ratio_min": 0.20,
    "punch_wrist_height_torso_ratio_max": 1.00,
    "block_wrist_height_torso_ratio_min": 0.00,
    "block_wrist_height_torso_ratio_max": 0.40,
    "punch_elbow_deg_min": 150.0,
    "punch_elbow_deg_max": 180.0,
    "block_elbow_deg_min": 80.0,
    "block_elbow_deg_max": 165.0,
}
# Limits that come in pairs, by their common name.
RANGES = tuple(name[:-4] for name in THRESHOLDS if name.endswith("_min") and name[:-4] + "_max" in THRESHOLDS)
COVERAGE_MIN = 0.90
GROUP_COVERAGE_MIN = 0.75
