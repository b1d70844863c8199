"""Person boxes as structs (x0, y0, x1, y1) of Columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clip

Box = tuple[Column, Column, Column, Column]


def box(name: str) -> Box:
    return tuple(F.col(name)[c] for c in ("x0", "y0", "x1", "y1"))


def pack(b: Sequence[Column]) -> Column:
    return F.struct(*[c.alias(n) for c, n in zip(b, ("x0", "y0", "x1", "y1"))])


def around(cx: Column, cy: Column, w: Column, h: Column) -> Box:
    return cx - w / 2.0, cy - h / 2.0, cx + w / 2.0, cy + h / 2.0


def center(b: Box) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2.0, (b[1] + b[3]) / 2.0


def size(b: Box, at_least: float | None = None) -> tuple[Column, Column]:
    w, h = b[2] - b[0], b[3] - b[1]
    return (w, h) if at_least is None else (F.greatest(w, F.lit(at_least)), F.greatest(h, F.lit(at_least)))


def clip_to_image(b: Box, width: int, height: int) -> Box:
    right, bottom = float(max(width - 1, 0)), float(max(height - 1, 0))
    return clip(b[0], 0.0, right), clip(b[1], 0.0, bottom), clip(b[2], 0.0, right), clip(b[3], 0.0, bottom)


def pad(b: Box, width: int, height: int, padding: float) -> Box:
    w, h = size(b, 2.0)
    k = 1.0 + 2.0 * padding
    return clip_to_image(around(*center(b), w * k, h * k), width, height)


def to_aspect(b: Box, aspect: float, padding: float = 1.25) -> Box:
    w, h = (part * padding for part in size(b))
    wide = w / F.greatest(h, F.lit(1e-6)) > aspect
    out_w = F.when(wide, w).otherwise(h * aspect)
    out_h = F.when(wide, w / aspect).otherwise(h)
    return around(*center(b), F.greatest(out_w, F.lit(32.0)), F.greatest(out_h, F.lit(32.0)))


def merge(pose: Box, visual: Box, previous: Box | None = None) -> Box:
    """70/30 centre blend unless the two centres are too far apart for the reference size."""
    (px, py), (vx, vy) = center(pose), center(visual)
    rw, rh = size(previous or pose, 32.0)
    far = F.sqrt((px - vx) ** 2 + (py - vy) ** 2) > 0.55 * F.sqrt(rw * rw + rh * rh)
    (pw, ph), (vw, vh) = size(pose), size(visual)
    blended = around(
        0.70 * px + 0.30 * vx, 0.70 * py + 0.30 * vy, F.greatest(pw, 0.80 * vw), F.greatest(ph, 0.80 * vh)
    )
    known_pose, known_visual = pose[0].isNotNull(), visual[0].isNotNull()
    return tuple(
        F.when(~known_pose, v).when(~known_visual | far, p).otherwise(m) for p, v, m in zip(pose, visual, blended)
    )


def needs_reacquisition(tracked: Box, motion: Box) -> Column:
    (tx, ty), (mx, my) = center(tracked), center(motion)
    w, h = size(tracked, 32.0)
    away = F.sqrt(((mx - tx) / w) ** 2 + ((my - ty) / h) ** 2) > 0.72
    return F.when(motion[0].isNull(), False).when(tracked[0].isNull(), True).otherwise(away)


def boxes_from_points(
    points: DataFrame, keys: Sequence[str], x: Column, y: Column, minimum: int = 5,
    span_floor: float = 32.0, margin: float = 1.35, image: tuple[int, int] | None = None, out: str = "bbox",
) -> DataFrame:
    """One box per key around its known points; NULL when fewer than ``minimum`` points are known."""
    known = x.isNotNull() & y.isNotNull()
    extent = points.groupBy(*keys).agg(
        F.count(F.when(known, 1)).alias("point_count"),
        F.min(F.when(known, x)).alias("__x0"), F.min(F.when(known, y)).alias("__y0"),
        F.max(F.when(known, x)).alias("__x1"), F.max(F.when(known, y)).alias("__y1"),
    )
    raw = tuple(F.col(c) for c in ("__x0", "__y0", "__x1", "__y1"))
    w, h = size(raw, span_floor)
    grown = around(*center(raw), w * margin, h * margin)
    if image:
        grown = clip_to_image(grown, *image)
    usable = (F.col("point_count") >= minimum) & (grown[2] > grown[0]) & (grown[3] > grown[1])
    return extent.select(*keys, "point_count", F.when(usable, pack(grown)).alias(out))
