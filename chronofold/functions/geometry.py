"""Plane geometry on the X/Z plane as column expressions. Angles are radians, 0 points to +Z."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column]


def vec(x: Column, z: Column) -> Vec:
    return x, z


def add(a: Vec, b: Vec) -> Vec:
    return a[0] + b[0], a[1] + b[1]


def sub(a: Vec, b: Vec) -> Vec:
    return a[0] - b[0], a[1] - b[1]


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1]


def cross(a: Vec, b: Vec) -> Column:
    return a[0] * b[1] - a[1] * b[0]


def length(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a: Vec) -> Vec:
    """Unit vector; NULL for the zero vector."""
    n = length(a)
    return F.try_divide(a[0], n), F.try_divide(a[1], n)


def rotate(a: Vec, angle: Column) -> Vec:
    """Turned by `angle`, from +Z towards +X."""
    s, c = F.sin(angle), F.cos(angle)
    return a[0] * c + a[1] * s, a[1] * c - a[0] * s


def direction(angle: Column) -> Vec:
    return F.sin(angle), F.cos(angle)


def to_angle(a: Vec) -> Column:
    return F.atan2(a[0], a[1])


def wrap(angle: Column) -> Column:
    """The same angle in (-pi, pi]."""
    turn = 2 * math.pi
    return math.pi - F.pmod(math.pi - angle, F.lit(turn))


def angle_between(a: Column, b: Column) -> Column:
    return F.abs(wrap(a - b))


# -- signed distances: negative inside, 0 on the border -----------------------------------------


def sd_half_plane(p: Vec, origin: Vec, normal: Vec) -> Column:
    return dot(sub(p, origin), normal)


def sd_circle(p: Vec, centre: Vec, radius: Column) -> Column:
    return length(sub(p, centre)) - radius


def sd_donut(p: Vec, centre: Vec, inner: Column, outer: Column) -> Column:
    d = length(sub(p, centre))
    return F.greatest(inner - d, d - outer)


def local(p: Vec, origin: Vec, facing: Column) -> Vec:
    """(sideways, ahead) of p as seen from origin."""
    d, f = sub(p, origin), direction(facing)
    return d[0] * f[1] - d[1] * f[0], dot(d, f)


def sd_rect(p: Vec, origin: Vec, facing: Column, front: Column, back: Column, half_width: Column) -> Column:
    side, ahead = local(p, origin, facing)
    return F.greatest(ahead - front, -ahead - back, F.abs(side) - half_width)


def sd_cross(p: Vec, origin: Vec, facing: Column, reach: Column, half_width: Column) -> Column:
    side, ahead = (F.abs(c) for c in local(p, origin, facing))
    return F.least(F.greatest(ahead - reach, side - half_width), F.greatest(side - reach, ahead - half_width))


def sd_cone(p: Vec, origin: Vec, facing: Column, half_angle: float, radius: Column) -> Column:
    """Circle cut by the planes of both sides; wider than half a turn, joined with them instead."""
    side, ahead = local(p, origin, facing)
    s, c = math.sin(half_angle), math.cos(half_angle)
    right, left = side * c - ahead * s, -side * c - ahead * s
    edge = F.greatest(right, left) if half_angle <= math.pi / 2 else F.least(right, left)
    return F.greatest(length((side, ahead)) - radius, edge)


def sd_donut_sector(p: Vec, origin: Vec, facing: Column, half_angle: float, inner: Column, outer: Column) -> Column:
    return F.greatest(sd_cone(p, origin, facing, half_angle, outer), inner - length(sub(p, origin)))


def sd_capsule(p: Vec, origin: Vec, facing: Column, reach: Column, radius: Column) -> Column:
    side, ahead = local(p, origin, facing)
    t = F.greatest(F.lit(0.0), F.least(reach, ahead))
    return length((side, ahead - t)) - radius


def sd_convex(p: Vec, corners: Sequence[tuple[float, float]]) -> Column:
    """Largest distance beyond a side; corners run clockwise as seen with X to the right and Z up."""
    sides = []
    for (x0, z0), (x1, z1) in zip(corners, [*corners[1:], corners[0]], strict=True):
        n = math.hypot(x1 - x0, z1 - z0)
        sides.append(((p[0] - x0) * -(z1 - z0) + (p[1] - z0) * (x1 - x0)) / n)
    return F.greatest(*sides)


def sd_union(*d: Column) -> Column:
    return F.least(*d) if len(d) > 1 else d[0]


def sd_intersection(*d: Column) -> Column:
    return F.greatest(*d) if len(d) > 1 else d[0]


def inverted(d: Column) -> Column:
    return -d


def inside(d: Column) -> Column:
    return d <= 0


def in_polygon(p: Vec, corners: Sequence[tuple[float, float]]) -> Column:
    """Even-odd rule along a ray to +X."""
    hits: Column = F.lit(0)
    for (x0, z0), (x1, z1) in zip(corners, [*corners[1:], corners[0]], strict=True):
        if z0 == z1:
            continue
        across = (F.lit(z0) > p[1]) != (F.lit(z1) > p[1])
        hits = hits + F.when(across & (p[0] < (x1 - x0) * (p[1] - z0) / (z1 - z0) + x0), 1).otherwise(0)
    return hits % 2 == 1


def ray_circle(origin: Vec, unit: Vec, centre: Vec, radius: Column) -> Column:
    """Distance along the ray to the circle, 0 from inside, NULL if it is missed."""
    d = sub(centre, origin)
    along = dot(d, unit)
    off = dot(d, d) - along * along
    half = F.sqrt(F.greatest(radius * radius - off, F.lit(0.0)))
    near = F.when(length(d) <= radius, F.lit(0.0)).when((off <= radius * radius) & (along > 0), along - half)
    return near


def ray_segment(origin: Vec, unit: Vec, a: Vec, b: Vec) -> Column:
    """Distance along the ray to the segment, NULL if it is missed."""
    s, d = sub(b, a), sub(a, origin)
    turn = cross(unit, s)
    t, u = F.try_divide(cross(d, s), turn), F.try_divide(cross(d, unit), turn)
    return F.when((t >= 0) & u.between(0.0, 1.0), t)


def arc_points(centre: Vec, radius: Column, start: float, end: float, steps: int) -> Column:
    """Points (x, z) along an arc, both ends included."""
    return F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: F.struct((centre[0] + radius * F.sin(start + (end - start) * i / steps)).alias("x"), (centre[1] + radius * F.cos(start + (end - start) * i / steps)).alias("z")))
