"""Plane geometry and angles as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap_angle(a: Column) -> Column:
    """a brought into (-pi, pi]."""
    full = 2 * math.pi
    r = a % F.lit(full)
    return F.when(r > math.pi, r - full).when(r <= -math.pi, r + full).otherwise(r)


def angle_difference(a: Column, b: Column) -> Column:
    return wrap_angle(a - b)


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a segment; a segment without length is a point."""
    dx, dy = bx - ax, by - ay
    t = F.coalesce(F.try_divide((px - ax) * dx + (py - ay) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return distance(px, py, ax + t * dx, ay + t * dy)


def box_overlap(x1, y1, h1, l1, w1, x2, y2, h2, l2, w2) -> Column:  # noqa: PLR0913
    """Whether two oriented boxes (centre, heading, length, width) touch: no axis of either separates them."""
    dx, dy = x2 - x1, y2 - y1

    def apart(ux: Column, uy: Column) -> Column:
        reach = sum((F.abs(F.cos(h) * ux + F.sin(h) * uy) * n / 2 + F.abs(F.cos(h) * uy - F.sin(h) * ux) * w / 2 for h, n, w in ((h1, l1, w1), (h2, l2, w2))), F.lit(0.0))
        return F.abs(dx * ux + dy * uy) > reach

    axes = [(F.cos(h1), F.sin(h1)), (-F.sin(h1), F.cos(h1)), (F.cos(h2), F.sin(h2)), (-F.sin(h2), F.cos(h2))]
    near = dx * dx + dy * dy <= F.pow(F.sqrt(l1 * l1 + w1 * w1) / 2 + F.sqrt(l2 * l2 + w2 * w2) / 2, F.lit(2.0))
    separated = F.lit(False)
    for ux, uy in axes:
        separated = separated | apart(ux, uy)
    return F.when(near, ~separated).otherwise(F.lit(False))


def lerp_angle(a: Column, b: Column, t: Column) -> Column:
    """The angle a share t of the shorter way from a to b, in (-pi, pi]."""
    return wrap_angle(a + t * angle_difference(b, a))


def box_corners(x: Column, y: Column, heading: Column, length: Column, width: Column) -> list[tuple[Column, Column]]:
    """Front left, rear left, rear right, front right."""
    cos, sin = F.cos(heading), F.sin(heading)
    return [(x + cos * a * length / 2 - sin * b * width / 2, y + sin * a * length / 2 + cos * b * width / 2) for a, b in ((1, 1), (-1, 1), (-1, -1), (1, -1))]


def segments_meet(ax, ay, bx, by, cx, cy, dx, dy) -> Column:  # noqa: PLR0913
    """Whether the segments a-b and c-d have a point in common, ends included."""

    def side(px: Column, py: Column, qx: Column, qy: Column, rx: Column, ry: Column) -> Column:
        return F.signum((qx - px) * (ry - py) - (qy - py) * (rx - px))

    def within(px: Column, py: Column, qx: Column, qy: Column, rx: Column, ry: Column) -> Column:
        return rx.between(F.least(px, qx), F.greatest(px, qx)) & ry.between(F.least(py, qy), F.greatest(py, qy))

    c, d, a, b = side(ax, ay, bx, by, cx, cy), side(ax, ay, bx, by, dx, dy), side(cx, cy, dx, dy, ax, ay), side(cx, cy, dx, dy, bx, by)
    touches = ((c == 0) & within(ax, ay, bx, by, cx, cy)) | ((d == 0) & within(ax, ay, bx, by, dx, dy)) | ((a == 0) & within(cx, cy, dx, dy, ax, ay)) | ((b == 0) & within(cx, cy, dx, dy, bx, by))
    return ((c * d < 0) & (a * b < 0)) | touches


def curvature(ax, ay, bx, by, cx, cy) -> Column:  # noqa: PLR0913
    """Signed curvature of the circle through three points; 0 where two of them coincide."""
    area = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
    return F.coalesce(F.try_divide(2 * area, distance(ax, ay, bx, by) * distance(bx, by, cx, cy) * distance(ax, ay, cx, cy)), F.lit(0.0))


def segment_segment_distance(ax, ay, bx, by, cx, cy, dx, dy) -> Column:  # noqa: PLR0913
    """Distance of the segments a-b and c-d, 0 where they meet."""
    ends = (segment_distance(ax, ay, cx, cy, dx, dy), segment_distance(bx, by, cx, cy, dx, dy), segment_distance(cx, cy, ax, ay, bx, by), segment_distance(dx, dy, ax, ay, bx, by))
    return F.when(segments_meet(ax, ay, bx, by, cx, cy, dx, dy), 0.0).otherwise(F.least(*ends))


def box_distance(box: tuple[Column, ...], other: tuple[Column, ...]) -> Column:
    """Distance of two oriented boxes (x, y, heading, length, width), 0 where they touch."""
    sides = lambda b: list(zip(box_corners(*b), [*box_corners(*b)[1:], box_corners(*b)[0]], strict=True))
    gaps = [segment_segment_distance(*p, *q, *r, *t) for p, q in sides(box) for r, t in sides(other)]
    return F.when(box_overlap(*box, *other), 0.0).otherwise(F.least(*gaps))
