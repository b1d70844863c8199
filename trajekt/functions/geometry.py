"""Vector, angle, camera and box expressions over Columns. Nothing here leaves the JVM.

A point is a tuple of three Columns; missing points carry NULLs and every result of a missing
input is NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import as_col, clip, mean_of
from .skeleton import J, LENGTHS, MASS_SEGMENTS

Vec = tuple[Column, Column, Column]


def point(index: int, array: str = "pts") -> Vec:
    item = F.col(array)[index]
    return item["x"], item["y"], item["z"]


def joint(name: str, array: str = "pts") -> Vec:
    return point(J[name], array)


def sub(a: Sequence[Column], b: Sequence[Column]):
    return tuple(p - q for p, q in zip(a, b))


def add(a, b):
    return tuple(p + q for p, q in zip(a, b))


def scale(a, k):
    return tuple(p * k for p in a)


def mid(a, b):
    return tuple(0.5 * (p + q) for p, q in zip(a, b))


def dot(a, b) -> Column:
    return sum((p * q for p, q in zip(a[1:], b[1:])), a[0] * b[0])


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def distance(a, b) -> Column:
    return norm(sub(a, b))


def present(a) -> Column:
    out = a[0].isNotNull()
    for part in a[1:]:
        out = out & part.isNotNull()
    return out


def vector_angle(u, v, floor: float = 0.0) -> Column:
    """Degrees between two vectors; NULL when the product of norms does not exceed ``floor``."""
    den = norm(u) * norm(v)
    return F.when(den > floor, F.degrees(F.acos(clip(dot(u, v) / den, -1.0, 1.0))))


def joint_angle(a, center, c, floor: float = 0.0) -> Column:
    return vector_angle(sub(a, center), sub(c, center), floor)


def partial_mid(a, b):
    """Coordinate-wise mean of whichever of the two points is known."""
    return tuple(mean_of(p, q) for p, q in zip(a, b))


def torso_lean_signed(array: str = "pts") -> Column:
    up = partial_mid(joint("left_shoulder", array), joint("right_shoulder", array))
    low = partial_mid(joint("left_hip", array), joint("right_hip", array))
    torso = sub(up, low)
    return F.when(norm(torso) > 0, F.degrees(F.atan2(torso[1], torso[2])))


def torso_vector(array: str = "pts"):
    up = mid(joint("left_shoulder", array), joint("right_shoulder", array))
    return sub(up, mid(joint("left_hip", array), joint("right_hip", array)))


def torso_lean_from_vertical(array: str = "pts") -> Column:
    torso = torso_vector(array)
    return F.when(present(torso), F.degrees(F.atan2(F.abs(torso[1]), F.abs(torso[2]))))


def torso_tilt(array: str = "pts") -> Column:
    """Angle of the torso vector to the up axis."""
    torso = torso_vector(array)
    size = norm(torso)
    return F.when(size > 1e-9, F.degrees(F.acos(clip(torso[2] / size, -1.0, 1.0))))


def leg_length(side: str, array: str = "pts") -> Column:
    hip, knee, ankle = (joint(f"{side}_{n}", array) for n in ("hip", "knee", "ankle"))
    return distance(hip, knee) + distance(knee, ankle)


def body_scale(array: str = "pts") -> Column:
    """Mean leg length over the complete legs."""
    return mean_of(leg_length("left", array), leg_length("right", array))


def segment_lengths(array: str = "pts") -> dict[str, Column]:
    return {name: distance(joint(a, array), joint(b, array)) for name, (a, b) in LENGTHS.items()}


def center_of_mass(array: str = "pts"):
    """Mass-weighted mean of segment centres; segments without a visible joint drop out."""
    segments = F.array(*[
        F.struct(F.lit(mass).alias("mass"), F.array(*[F.lit(J[m]) for m in members]).alias("joints"))
        for mass, members in MASS_SEGMENTS.values()
    ])
    visible = F.filter(
        F.transform(
            segments,
            lambda s: F.struct(
                s["mass"].alias("mass"),
                F.filter(F.transform(s["joints"], lambda j: F.col(array)[j]), lambda p: p.isNotNull()).alias("points"),
            ),
        ),
        lambda s: F.size(s["points"]) > 0,
    )
    total = F.aggregate(visible, F.lit(0.0), lambda acc, s: acc + s["mass"])

    def along(axis: str) -> Column:
        def center(s):
            return F.aggregate(s["points"], F.lit(0.0), lambda acc, p: acc + p[axis]) / F.size(s["points"])

        return F.aggregate(visible, F.lit(0.0), lambda acc, s: acc + s["mass"] * center(s))

    return tuple(F.when(total > 0, along(a) / total) for a in "xyz")


def transform(p, m: Sequence):
    """Affine part of a row-major 4x4 matrix applied to a point."""
    rows = [m[0:4], m[4:8], m[8:12]]
    return tuple(r[0] * p[0] + r[1] * p[1] + r[2] * p[2] + r[3] for r in rows)


def project(p, m: Sequence, eps: float = 1e-12):
    """Pinhole projection by a row-major 3x4 matrix: pixel x, pixel y, homogeneous depth."""
    u, v, w = (m[4 * r] * p[0] + m[4 * r + 1] * p[1] + m[4 * r + 2] * p[2] + m[4 * r + 3] for r in range(3))
    ok = F.abs(w) > eps
    return F.when(ok, u / w), F.when(ok, v / w), w


def array_matrix(name, size: int) -> list[Column]:
    column = as_col(name)
    return [column[i] for i in range(size)]


def distort(xn: Column, yn: Column, d: Sequence):
    """Radial-tangential lens model on normalised coordinates (k1, k2, p1, p2, k3)."""
    k1, k2, p1, p2, k3 = d
    r2 = xn * xn + yn * yn
    radial = 1.0 + r2 * (k1 + r2 * (k2 + r2 * k3))
    xd = xn * radial + 2.0 * p1 * xn * yn + p2 * (r2 + 2.0 * xn * xn)
    yd = yn * radial + p1 * (r2 + 2.0 * yn * yn) + 2.0 * p2 * xn * yn
    return xd, yd


def project_distorted(p, rotation: Sequence, translation: Sequence, k: Sequence, d: Sequence):
    """World point through pose, lens model and intrinsics; NULL at or behind the camera."""
    cam = [rotation[3 * r] * p[0] + rotation[3 * r + 1] * p[1] + rotation[3 * r + 2] * p[2] + translation[r] for r in range(3)]
    ahead = cam[2] > 1e-9
    xd, yd = distort(cam[0] / cam[2], cam[1] / cam[2], d)
    return F.when(ahead, k[0] * xd + k[1] * yd + k[2]), F.when(ahead, k[4] * yd + k[5])


def undistort(u: Column, v: Column, k: Sequence, d: Sequence, steps: int = 5):
    """Normalised coordinates of a pixel by fixed-point iteration of the inverse lens model."""
    x0, y0 = (u - k[2]) / k[0], (v - k[5]) / k[4]
    k1, k2, p1, p2, k3 = d
    x, y = x0, y0
    for _ in range(steps):
        r2 = x * x + y * y
        inverse = 1.0 / (1.0 + r2 * (k1 + r2 * (k2 + r2 * k3)))
        dx = 2.0 * p1 * x * y + p2 * (r2 + 2.0 * x * x)
        dy = p1 * (r2 + 2.0 * y * y) + 2.0 * p2 * x * y
        x, y = (x0 - dx) * inverse, (y0 - dy) * inverse
    return x, y


def rotation_from_vector(r: Sequence) -> list[Column]:
    """Row-major 3x3 rotation of a rotation vector; identity for a zero vector."""
    theta = norm(r)
    unit = F.when(theta > 1e-12, theta).otherwise(1.0)
    x, y, z = (part / unit for part in r)
    c, s = F.cos(theta), F.sin(theta)
    v = 1.0 - c
    return [
        c + x * x * v, x * y * v - z * s, x * z * v + y * s,
        y * x * v + z * s, c + y * y * v, y * z * v - x * s,
        z * x * v - y * s, z * y * v + x * s, c + z * z * v,
    ]


def matmul3(a: Sequence, b: Sequence, width: int = 3) -> list[Column]:
    """Row-major (3x3)·(3xwidth)."""
    return [
        a[3 * r] * b[c] + a[3 * r + 1] * b[width + c] + a[3 * r + 2] * b[2 * width + c]
        for r in range(3)
        for c in range(width)
    ]


def transpose3(m: Sequence) -> list[Column]:
    return [m[3 * c + r] for r in range(3) for c in range(3)]


def camera_center(rotation: Sequence, translation: Sequence):
    """-R'T."""
    return tuple(-sum((rotation[3 * r + c] * translation[r] for r in (1, 2)), rotation[c] * translation[0]) for c in range(3))


def determinant3(m: Sequence) -> Column:
    return (
        m[0] * (m[4] * m[8] - m[5] * m[7])
        - m[1] * (m[3] * m[8] - m[5] * m[6])
        + m[2] * (m[3] * m[7] - m[4] * m[6])
    )


def solve3(m: Sequence, b: Sequence, eps: float = 1e-12):
    """3x3 linear system by Cramer's rule; NULL for a singular matrix."""
    det = determinant3(m)
    ok = F.abs(det) > eps

    def swapped(col):
        return [b[i // 3] if i % 3 == col else m[i] for i in range(9)]

    return tuple(F.when(ok, determinant3(swapped(c)) / det) for c in range(3))
