"""Fixed skeleton dimension values: joint order, bones, angles, segments."""

from __future__ import annotations

# Joint order of the 17 body points.
BODY_JOINTS = (
    "nose", "left_eye", "right_eye", "left_ear", "right_ear",
    "left_shoulder", "right_shoulder", "left_elbow", "right_elbow",
    "left_wrist", "right_wrist", "left_hip", "right_hip",
    "left_knee", "right_knee", "left_ankle", "right_ankle",
)
J = {name: index for index, name in enumerate(BODY_JOINTS)}

# First and last index of each point group in the 133-point layout.
GROUP_RANGES = {
    "body": (0, 16), "feet": (17, 22), "face": (23, 90), "left_hand": (91, 111), "right_hand": (112, 132),
}

# Angle name -> (first, centre, last).
ANGLES = {
    "left_elbow_deg": ("left_shoulder", "left_elbow", "left_wrist"),
    "right_elbow_deg": ("right_shoulder", "right_elbow", "right_wrist"),
    "left_shoulder_deg": ("left_elbow", "left_shoulder", "left_hip"),
    "right_shoulder_deg": ("right_elbow", "right_shoulder", "right_hip"),
    "left_hip_deg": ("left_shoulder", "left_hip", "left_knee"),
    "right_hip_deg": ("right_shoulder", "right_hip", "right_knee"),
    "left_knee_deg": ("left_hip", "left_knee", "left_ankle"),
    "right_knee_deg": ("right_hip", "right_knee", "right_ankle"),
}

# Length name -> endpoints.
LENGTHS = {
    "shoulder_width": ("left_shoulder", "right_shoulder"),
    "hip_width": ("left_hip", "right_hip"),
    "left_upper_arm": ("left_shoulder", "left_elbow"),
    "right_upper_arm": ("right_shoulder", "right_elbow"),
    "left_forearm": ("left_elbow", "left_wrist"),
    "right_forearm": ("right_elbow", "right_wrist"),
    "left_thigh": ("left_hip", "left_knee"),
    "right_thigh": ("right_hip", "right_knee"),
    "left_shin": ("left_knee", "left_ankle"),
    "right_shin": ("right_knee", "right_ankle"),
}

# Bones checked for length outliers, in checking order.
RELIABILITY_BONES = (
    ("left_shoulder", "right_shoulder"),
    ("left_shoulder", "left_elbow"),
    ("left_elbow", "left_wrist"),
    ("right_shoulder", "right_elbow"),
    ("right_elbow", "right_wrist"),
    ("left_shoulder", "left_hip"),
    ("right_shoulder", "right_hip"),
    ("left_hip", "right_hip"),
    ("left_hip", "left_knee"),
    ("left_knee", "left_ankle"),
    ("right_hip", "right_knee"),
    ("right_knee", "right_ankle"),
)

# Body segment -> (mass fraction, member joints).
MASS_SEGMENTS = {
    "head": (0.081, ("nose", "left_eye", "right_eye", "left_ear", "right_ear")),
    "torso": (0.497, ("left_shoulder", "right_shoulder", "left_hip", "right_hip")),
    "left_upper_arm": (0.028, ("left_shoulder", "left_elbow")),
    "right_upper_arm": (0.028, ("right_shoulder", "right_elbow")),
    "left_forearm_hand": (0.022, ("left_elbow", "left_wrist")),
    "right_forearm_hand": (0.022, ("right_elbow", "right_wrist")),
    "left_thigh": (0.100, ("left_hip", "left_knee")),
    "right_thigh": (0.100, ("right_hip", "right_knee")),
    "left_shank_foot": (0.061, ("left_knee", "left_ankle")),
    "right_shank_foot": (0.061, ("right_knee", "right_ankle")),
}

# The left/right pairs that side repair may exchange; eyes and ears are not among them.
SIDE_PAIRS = ((5, 6), (7, 8), (9, 10), (11, 12), (13, 14), (15, 16))


def group_of(joint_idx: int) -> str:
    return next(name for name, (lo, hi) in GROUP_RANGES.items() if lo <= joint_idx <= hi)
