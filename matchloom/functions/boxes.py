"""Boxes x, y, w, h and landmarks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, y: Column, w: Column, h: Column, width: int, height: int) -> Column:
    """A box moved and cut so that it lies in an image and has at least one pixel."""
    left, top = F.greatest(F.lit(0), F.least(F.lit(width - 1), x)), F.greatest(F.lit(0), F.least(F.lit(height - 1), y))
    return F.struct(left.alias("x"), top.alias("y"), F.greatest(F.lit(1), F.least(width - left, w)).alias("w"), F.greatest(F.lit(1), F.least(height - top, h)).alias("h"))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where there is no overlap or no area."""
    over = lambda p, n: F.greatest(F.lit(0), F.least(a[p] + a[n], b[p] + b[n]) - F.greatest(a[p], b[p]))
    both = over("x", "w") * over("y", "h")
    either = a["w"] * a["h"] + b["w"] * b["h"] - both
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def around(xs: Column, ys: Column) -> Column:
    """The box around points."""
    return F.struct(F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(xs) - F.array_min(xs)).alias("w"), (F.array_max(ys) - F.array_min(ys)).alias("h"))


def pose_angle(eye1: Column, eye2: Column, nose: Column) -> Column:
    """The larger of roll (folded to at most 90 degrees) and a yaw proxy: how far the nose is from the middle of the eyes,
    by their distance, 90 at most. Eyes less than 0.001 apart tell the roll only."""
    dx, dy = eye2["x"] - eye1["x"], eye2["y"] - eye1["y"]
    roll = F.abs(F.degrees(F.atan2(dy, dx)))
    roll = F.when(roll > 90, 180 - roll).otherwise(roll)
    gap = F.hypot(dx, dy)
    yaw = F.least(F.lit(90.0), 90 * F.abs(nose["x"] - (eye1["x"] + eye2["x"]) / 2) / gap)
    return F.when(gap < 1e-3, roll).otherwise(F.greatest(roll, yaw))
