"""H23-H25: screening of movement metrics by a table of rules: which limit, window, groups and joints belong to a metric.

All metrics of a movement become one tall (movement, metric, value) table, one join with the rules decides which apply and with what, and the
rest is column arithmetic. The rules are data: a new limit or metric is a row, not code.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.skeleton import J
from ..functions.thresholds import COVERAGE_MIN, GROUP_COVERAGE_MIN, THRESHOLDS
from .movement import BROWS, FOOT, HAND_POINTS, KNUCKLES, LEFT_EYE, RIGHT_EYE, hand, screen

TECHNIQUES, STANCES, SIDES = ("punch", "low_block", "high_block", "kick_punch"), ("walking", "long"), ("left", "right")
PUNCHES, BLOCKS, KICKS = ("punch", "kick_punch"), ("low_block", "high_block"), ("kick_punch",)
TORSO = ("left_shoulder", "right_shoulder", "left_hip", "right_hip")
EXECUTING_HAND = tuple(f"executing_hand_{n}" for n in KNUCKLES)

# Metric, family, unit, criterion, window, groups, joints; front and back are the stance's sides, executing and other the technique's.
METRICS = (
    ("torso_lean_p95_deg", "balance", "deg", "balance.torso_vertical", "fixation_window", ("body",), TORSO),
    ("back_foot_yaw_to_stance_direction_deg", "stance", "deg", "stance.foot_direction", "fixation_window", ("body", "feet"), ("front_ankle", "back_ankle", "back_heel", "back_big_toe", "back_small_toe")),
    ("shoulder_hip_twist_deg", "rotation", "deg", "rotation.shoulder_hip", "fixation_window", ("body",), TORSO),
    ("head_torso_yaw_mismatch_deg", "gaze", "deg", "gaze.direction", "fixation_window", ("body", "face"), ("eyes", "left_shoulder", "right_shoulder")),
    ("expected_side_dominance_ratio", "wrong_side", "ratio", "technique.side", "preparation_to_execution", ("body",), ("executing_wrist", "other_wrist")),
    ("reaction_hand_hip_distance_ratio", "hikite", "body_scale", "technique.hikite.position", "fixation_window", ("body", "other_hand"), ("other_hand_wrist", "other_hip")),
    ("wrist_forearm_alignment_deg", "hand", "deg", "technique.hand.wrist_alignment", "fixation_window", ("body", "executing_hand"), ("executing_elbow", "executing_wrist", "executing_hand_middle_mcp")),
    ("fist_closure_ratio", "hand", "ratio", "technique.hand.fist", "fixation_window", ("body", "executing_hand"), tuple(f"executing_hand_{n}" for n in HAND_POINTS)),
    ("hand_foot_settle_difference_sec", "timing", "sec", "timing.hand_foot.simultaneity", "preparation_to_execution", ("body",), ("executing_wrist", "front_ankle")),
    ("fixation_wrist_jitter_ratio", "fixation", "body_scale", "technique.fixation.stability", "fixation_window", ("body",), ("executing_wrist",)),
    ("pelvis_weight_transfer_ratio", "weight_transfer", "body_scale", "stance.weight_transfer", "fixation_window", ("body",), ("left_hip", "right_hip", "front_ankle", "back_ankle")),
    ("executing_wrist_path_efficiency", "trajectory", "ratio", "technique.trajectory", "preparation_to_execution", ("body",), ("executing_wrist",)),
    ("executing_wrist_peak_speed_body_scale_per_sec", "kinematics", "body_scale/sec", "presentation.kinematics", "preparation_to_execution", ("body",), ("executing_wrist",)),
    ("stance_span_ratio", "stance", "body_scale", "stance.{stance}.span", "fixation_window", ("body",), ("left_ankle", "right_ankle")),
    ("front_knee_deg", "stance", "deg", "stance.{stance}.front_knee", "fixation_window", ("body",), ("front_hip", "front_knee", "front_ankle")),
    ("executing_wrist_height_torso_ratio", "technique", "torso_height", "technique.{technique}.height", "fixation_window", ("body", "executing_hand"), ("executing_hand_wrist", *TORSO)),
    ("executing_elbow_deg", "technique", "deg", "technique.{technique}.elbow", "fixation_window", ("body",), ("executing_shoulder", "executing_elbow", "executing_wrist")),
    ("arae_fist_to_thigh_fist_ratio", "technique", "fist_width", "technique.arae_makki.height", "fixation_window", ("body", "executing_hand"), (*EXECUTING_HAND, "executing_hip", "executing_knee")),
    ("eolgul_fist_to_forehead_fist_ratio", "technique", "fist_width", "technique.eolgul_makki.forehead_distance", "fixation_window", ("body", "executing_hand", "face"), (*EXECUTING_HAND, "brows", "eyes")),
    ("kick_knee_extension_deg", "kick", "deg", "technique.ap_chagi.knee_extension", "kick_apex_window", ("body",), ()),
    ("kick_ankle_height_body_scale_ratio", "kick", "body_scale", "technique.ap_chagi.height", "kick_apex_window", ("body",), ()),
    ("kick_rechamber_knee_deg", "kick", "deg", "technique.ap_chagi.rechamber", "kick_rechamber_window", ("body",), ()),
    ("support_foot_pivot_deg", "kick", "deg", "technique.ap_chagi.support_foot_pivot", "preparation_to_kick_apex", ("feet",), ()),
    ("kick_landing_to_punch_sec", "kick", "sec", "timing.kick_landing_punch.sequence", "landing_to_punch_execution", ("body",), ()),
)
# Metrics that only some techniques have.
ONLY = {
    "arae_fist_to_thigh_fist_ratio": ("low_block",), "eolgul_fist_to_forehead_fist_ratio": ("high_block",),
    "kick_knee_extension_deg": KICKS, "kick_ankle_height_body_scale_ratio": KICKS, "kick_rechamber_knee_deg": KICKS, "support_foot_pivot_deg": KICKS, "kick_landing_to_punch_sec": KICKS,
}
# Metric, operator, threshold (its common name for a range), techniques and stances it holds for; all others are diagnostic only.
LIMITS = (
    ("torso_lean_p95_deg", "max", "torso_lean_p95_deg", TECHNIQUES, STANCES),
    ("shoulder_hip_twist_deg", "max", "shoulder_hip_twist_deg", TECHNIQUES, STANCES),
    ("head_torso_yaw_mismatch_deg", "max", "head_torso_yaw_mismatch_deg", TECHNIQUES, STANCES),
    ("expected_side_dominance_ratio", "min", "expected_side_dominance_ratio", TECHNIQUES, STANCES),
    ("reaction_hand_hip_distance_ratio", "max", "hikite_hip_distance_body_scale", TECHNIQUES, STANCES),
    ("wrist_forearm_alignment_deg", "max", "wrist_forearm_alignment_deg", TECHNIQUES, STANCES),
    ("fist_closure_ratio", "max", "fist_closure_ratio", TECHNIQUES, STANCES),
    ("hand_foot_settle_difference_sec", "max", "simultaneity_sec", TECHNIQUES, STANCES),
    ("fixation_wrist_jitter_ratio", "max", "fixation_wrist_jitter_body_scale", TECHNIQUES, STANCES),
    ("pelvis_weight_transfer_ratio", "min", "weight_transfer_body_scale", TECHNIQUES, STANCES),
    ("executing_wrist_path_efficiency", "max", "path_efficiency_punch", PUNCHES, STANCES),
    ("executing_wrist_path_efficiency", "max", "path_efficiency_block", BLOCKS, STANCES),
    ("stance_span_ratio", "range", "ap_seogi_span_ratio", TECHNIQUES, ("walking",)),
    ("stance_span_ratio", "range", "ap_gubi_span_ratio", TECHNIQUES, ("long",)),
    ("front_knee_deg", "range", "ap_seogi_front_knee_deg", TECHNIQUES, ("walking",)),
    ("front_knee_deg", "range", "ap_gubi_front_knee_deg", TECHNIQUES, ("long",)),
    ("executing_wrist_height_torso_ratio", "range", "punch_wrist_height_torso_ratio", PUNCHES, STANCES),
    ("executing_wrist_height_torso_ratio", "range", "block_wrist_height_torso_ratio", ("low_block",), STANCES),
    ("executing_elbow_deg", "range", "punch_elbow_deg", PUNCHES, STANCES),
)
STANCE_NAMES = {"walking": "ap_seogi", "long": "ap_gubi"}
TECHNIQUE_NAMES = {"punch": "momtong_jireugi", "kick_punch": "momtong_jireugi", "low_block": "arae_makki", "high_block": "eolgul_makki"}


def joints_of(name: str, side: str, front: str) -> list[int]:
    """Indices of a joint named by its role."""
    if name in ("eyes", "brows"):
        return [*LEFT_EYE, *RIGHT_EYE] if name == "eyes" else list(BROWS)
    other = {"left": "right", "right": "left"}
    role, _, part = name.partition("_")
    own = {"executing": side, "other": other[side], "front": front, "back": other[front]}.get(role, role)
    if part.startswith("hand_"):
        return [hand(own, part.removeprefix("hand_"))]
    if part in ("big_toe", "small_toe", "heel"):
        return [FOOT[own][("big_toe", "small_toe", "heel").index(part)]]
    return [J[f"{own}_{part}"]]


def rule_rows() -> list[tuple]:
    """(metric, technique, stance, side, front, family, unit, criterion, scope, groups, joints, operator, lo, hi), one for each case a metric has."""
    limits = {(m, t, s): (op, THRESHOLDS.get(f"{name}_min"), THRESHOLDS.get(f"{name}_max")) for m, op, name, techniques, stances in LIMITS for t in techniques for s in stances}
    rows = []
    for (metric, family, unit, criterion, scope, groups, joints), technique, stance, side, front in product(METRICS, TECHNIQUES, STANCES, SIDES, SIDES):
        if technique in ONLY.get(metric, TECHNIQUES):
            other = "right" if side == "left" else "left"
            own = [{"executing_hand": f"{side}_hand", "other_hand": f"{other}_hand"}.get(g, g) for g in groups]
            named = criterion.format(stance=STANCE_NAMES[stance], technique=TECHNIQUE_NAMES[technique])
            rows.append((metric, technique, stance, side, front, family, unit, named, scope, own, [i for n in joints for i in joints_of(n, side, front)], *limits.get((metric, technique, stance), (None, None, None))))
    return rows


RULE_SCHEMA = "metric string, technique string, stance_family string, side string, stance_side string, family string, unit string, criterion string, scope string, groups array<string>, joints array<int>, operator string, lo double, hi double"


def rules(spark: SparkSession) -> DataFrame:
    """The rules as a table: a metric, technique, stance and sides have one row at most."""
    return spark.createDataFrame(rule_rows(), RULE_SCHEMA)


def screened(tall: DataFrame, rule_table: DataFrame) -> DataFrame:
    """Metric rows that a rule covers, with its columns, status, margin and norm. The rules are a bounded table of cases, broadcast."""
    rows = tall.join(F.broadcast(rule_table), ["metric", "technique", "stance_family", "side", "stance_side"])
    status, margin, norm = screen(F.col("value"), F.col("operator"), F.col("lo"), F.col("hi"))
    return rows.withColumns({"status": status, "margin": margin, "norm": norm})


def scope_limits(radius: int) -> tuple[Column, Column]:
    """First and last frame of a row's window by its scope, from the movement's anchors."""
    around = {"fixation_window": "fixation", "kick_apex_window": "kick_apex", "kick_rechamber_window": "rechamber"}
    spans = {"preparation_to_execution": ("preparation", "execution"), "preparation_to_kick_apex": ("preparation", "kick_apex"), "landing_to_punch_execution": ("rechamber", "fixation")}
    low, high = F.lit(None).cast("long"), F.lit(None).cast("long")
    for scope, anchor in around.items():
        here = F.col("scope") == scope
        low, high = F.when(here, F.greatest("start_frame", F.col(anchor) - radius)).otherwise(low), F.when(here, F.least("end_frame", F.col(anchor) + radius)).otherwise(high)
    for scope, (first, last) in spans.items():
        low, high = F.when(F.col("scope") == scope, F.col(first)).otherwise(low), F.when(F.col("scope") == scope, F.col(last)).otherwise(high)
    return low, high


def visibility(pts: str) -> Column:
    """One character for each point, 1 if it is there."""
    return F.array_join(F.transform(pts, lambda p: F.when(p.isNotNull(), "1").otherwise("0")), "")


def annotated(rows: DataFrame, radius: int, least: float = GROUP_COVERAGE_MIN) -> DataFrame:
    """Screened rows with their evidence: window, failed groups, counts of the required joints in the window, missing ones and why there is no value.

    `rows` carry the movement's frames as `seen`, an array of (i, s) with s from visibility(), and `coverage`, a map of group coverages. Reasons by
    precedence: a failed group, a missing joint, else the geometry.
    """
    low, high = scope_limits(radius)
    rows = rows.withColumns({"window_start": low, "window_end": high})
    rows = rows.withColumn("__w", F.filter("seen", lambda f: f["i"].between(F.col("window_start"), F.col("window_end"))))
    count = lambda j: F.size(F.filter("__w", lambda f: F.substring(f["s"], j + 1, F.lit(1)) == "1"))
    rows = rows.withColumn("joint_samples", F.transform("joints", count))
    wanted = F.lit(least) * (F.col("window_end") - F.col("window_start") + 1)
    missing = F.filter(F.transform("joints", lambda j, k: F.when(F.get("joint_samples", k) < wanted, j)), lambda j: j.isNotNull())
    rows = rows.withColumns({"failed_groups": F.filter("groups", lambda g: F.element_at("coverage", g) < least), "missing_joints": missing})
    why = F.when(F.size("failed_groups") > 0, "segment_group_coverage_below_minimum").when(F.size("missing_joints") > 0, "required_joint_window_coverage_below_minimum")
    why = why.otherwise("metric_geometry_implausible_or_trajectory_evidence_insufficient")
    return rows.withColumn("not_measurable_reason", F.when(F.col("status") == "not_measurable", why)).drop("__w")


def coverage_summary(rows: DataFrame, keys: list[str], least: float = COVERAGE_MIN) -> DataFrame:
    """Per keys: metrics, those with a limit, measurable ones, candidates, and whether enough of the limited ones could be measured."""
    limited = F.col("status") != "measured_diagnostic_only"
    number = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("metric_count"), number(limited).alias("thresholded"), number(limited & (F.col("status") != "not_measurable")).alias("measurable"),
        number(F.col("status") == "review_candidate").alias("candidates"), number(F.col("status") == "within_screening_range").alias("within"),
    )
    ratio = F.when(F.col("thresholded") > 0, F.col("measurable") / F.col("thresholded")).otherwise(0.0)
    return out.withColumn("coverage_ratio", ratio).withColumn("coverage_passed", ratio >= least)


def status_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per keys: number of candidates of each family and of missing values by reason, as rows (kind, name, n)."""
    kind = F.when(F.col("status") == "review_candidate", F.struct(F.lit("candidate_family").alias("kind"), F.col("family").alias("name")))
    kind = kind.when(F.col("status") == "not_measurable", F.struct(F.lit("not_measurable_reason").alias("kind"), F.col("not_measurable_reason").alias("name")))
    return rows.select(*keys, kind.alias("c")).where("c is not null").groupBy(*keys, F.col("c.kind").alias("kind"), F.col("c.name").alias("name")).agg(F.count(F.lit(1)).alias("n"))


def candidate_events(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A review event for each candidate; it decides nothing and has no effect on a score."""
    event = F.concat(F.lit("WB-"), *[c for k in keys for c in (F.col(k).cast("string"), F.lit("-"))], F.col("metric"))
    return rows.where("status = 'review_candidate'").withColumns(
        {"event_id": event, "decision_status": F.lit("review_candidate_not_deduction"), "human_review_status": F.lit("pending"), "rule_eligibility": F.lit("blocked_unvalidated_screening_threshold")}
    )

