"""Affine transforms, angles and sizes as columns. An affine is (a, b, c, d, e, f)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def pixel_to_world(x: Column, y: Column, affine) -> tuple[Column, Column]:
    """World place of a pixel's centre."""
    a, b, c, d, e, f = affine
    return a * (x + 0.5) + b * (y + 0.5) + c, d * (x + 0.5) + e * (y + 0.5) + f


def world_to_pixel(wx: Column, wy: Column, affine) -> tuple[Column, Column]:
    """Continuous pixel place; half a pixel is not taken off."""
    a, b, c, d, e, f = affine
    det = a * e - b * d
    return (e * (wx - c) - b * (wy - f)) / det, (a * (wy - f) - d * (wx - c)) / det


def pixel_size(affine) -> float:
    a, b, _, d, e, _ = affine
    return (math.hypot(a, d) + math.hypot(b, e)) / 2


def bounds(affine, width: int, height: int) -> tuple[float, float, float, float]:
    """left, bottom, right, top of the raster's corners."""
    a, b, c, d, e, f = affine
    xs = [a * x + b * y + c for x in (0, width) for y in (0, height)]
    ys = [d * x + e * y + f for x in (0, width) for y in (0, height)]
    return min(xs), min(ys), max(xs), max(ys)


def orientation(dx: Column, dy: Column) -> Column:
    return F.pmod(F.atan2(dy, dx), F.lit(math.pi))


def angle_difference(a: Column, b: Column) -> Column:
    """Distance of two orientations, 0 to half of pi."""
    return F.abs(F.atan2(F.sin(2 * (a - b)), F.cos(2 * (a - b)))) / 2


def crown_radius(area: Column, factor: float, low: float, high: float, least: float = 0.0) -> Column:
    return F.least(F.greatest(F.sqrt(F.greatest(area, F.lit(least)) / math.pi) * factor, F.lit(low)), F.lit(high))
