"""Geometry of rings and boxes as Spark column expressions; everything here stays inside the JVM.

A ring is array<struct<x: double, y: double>>, open or closed. A box is four
columns x0, y0, x1, y1; ``box("l")`` names the columns l_x0 .. l_y1.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

RING = "array<struct<x:double,y:double>>"


class Box(NamedTuple):
    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @property
    def area(self) -> Column:
        return (self.x1 - self.x0) * (self.y1 - self.y0)


def box(prefix: str = "") -> Box:
    """The box in columns x0, y0, x1, y1, each after ``prefix`` and an underscore."""
    return Box(*[F.col(f"{prefix}_{c}" if prefix else c) for c in Box._fields])


def ring_of(b: Box) -> Column:
    """A box as an open ring, clockwise on a screen."""
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in ((b.x0, b.y0), (b.x1, b.y0), (b.x1, b.y1), (b.x0, b.y1))])


def _next(ring: Column) -> Column:
    return F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def _cross(ring: Column) -> Column:
    return F.zip_with(ring, _next(ring), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])


def ring_area(ring: Column) -> Column:
    """Shoelace area; 0 for fewer than three points."""
    return F.abs(_sum(_cross(ring))) / 2


def ring_bounds(ring: Column) -> Box:
    """The bounding box of a ring."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return Box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def ring_centroid(ring: Column) -> tuple[Column, Column]:
    """Area-weighted centroid; null where the area is 0."""
    twice = _sum(_cross(ring))
    moment = lambda c: _sum(F.zip_with(ring, _next(ring), lambda a, b: (a[c] + b[c]) * (a["x"] * b["y"] - b["x"] * a["y"])))
    return F.try_divide(moment("x"), 3 * twice), F.try_divide(moment("y"), 3 * twice)


def ring_map(ring: Column, x, y) -> Column:
    """A ring with ``x`` and ``y`` applied to its points."""
    return F.transform(ring, lambda p: F.struct(x(p).alias("x"), y(p).alias("y")))


def ring_scale(ring: Column, factor: Column | float) -> Column:
    """A ring scaled about the origin; reading at downsampling ds scales by 1 / ds."""
    return ring_map(ring, lambda p: p["x"] * factor, lambda p: p["y"] * factor)


def ring_translate(ring: Column, dx: Column | float, dy: Column | float) -> Column:
    """A ring moved by (dx, dy)."""
    return ring_map(ring, lambda p: p["x"] + dx, lambda p: p["y"] + dy)


def ring_close(ring: Column) -> Column:
    """A ring with its first point repeated at the end."""
    return F.concat(ring, F.slice(ring, 1, 1))


def ring_to_slide(ring: Column, min_x: Column, min_y: Column) -> Column:
    """A tile's ring in slide coordinates, closed."""
    return ring_close(ring_translate(ring, min_x, min_y))


def ring_to_uint32(ring: Column) -> Column:
    """Points cut to whole non-negative numbers: negatives become 0."""
    return ring_map(ring, lambda p: F.greatest(p["x"], F.lit(0)).cast("bigint"), lambda p: F.greatest(p["y"], F.lit(0)).cast("bigint"))


def xyxy_to_xywh(b: Box) -> Column:
    return F.array(b.x0, b.y0, b.x1 - b.x0, b.y1 - b.y0)


def xywh_to_xyxy(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Box:
    """Corners clamped to an image of ``width`` by ``height``."""
    inside = lambda v, top: F.least(F.greatest(v, F.lit(0)), top)
    return Box(inside(x, width), inside(y, height), inside(x + w, width), inside(y + h, height))


def box_intersection(a: Box, b: Box) -> Column:
    """Shared area. Each axis is clamped at 0, or two negative extents would multiply to a false area."""
    wide = F.greatest(F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0), F.lit(0))
    high = F.greatest(F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0), F.lit(0))
    return wide * high


def box_meets(a: Box, b: Box) -> Column:
    """Closed intersection: touching counts."""
    return (a.x0 <= b.x1) & (b.x0 <= a.x1) & (a.y0 <= b.y1) & (b.y0 <= a.y1)


def iou(shared: Column, area_a: Column, area_b: Column) -> Column:
    """Intersection over union; null where both are empty."""
    return F.try_divide(shared, area_a + area_b - shared)


def overlaps(shared: Column, area_a: Column, area_b: Column) -> Column:
    """Interiors meet and neither contains the other; equal boxes do not overlap."""
    return (shared > 0) & (shared < F.least(area_a, area_b))


def contains_either(shared: Column, area_a: Column, area_b: Column) -> Column:
    return (shared > 0) & (shared == F.least(area_a, area_b))


def iou_above(shared: Column, area_a: Column, area_b: Column, threshold: float) -> Column:
    """Overlapping, with an IoU strictly above the threshold."""
    return overlaps(shared, area_a, area_b) & (shared > threshold * (area_a + area_b - shared))


def overlap_at_least(shared: Column, area_a: Column, area_b: Column, threshold: float) -> Column:
    """At least that part of either area is shared."""
    return (shared > 0) & ((shared >= threshold * area_a) | (shared >= threshold * area_b))


def merges(shared: Column, area_a: Column, area_b: Column, iou_threshold: float = 0.2, overlap_threshold: float = 0.2) -> Column:
    """The rule by which detections of neighbouring tiles are merged."""
    return iou_above(shared, area_a, area_b, iou_threshold) | overlap_at_least(shared, area_a, area_b, overlap_threshold)
