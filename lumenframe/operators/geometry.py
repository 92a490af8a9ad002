"""Poses, volumes of interest and regions, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rigid(x: Column, y: Column, z: Column, angles: tuple, shift: tuple) -> tuple[Column, Column, Column]:
    """ry . rx . rz . p + shift; angles are those about z, y and x."""
    az, ay, ax = (F.lit(a) if not isinstance(a, Column) else a for a in angles)
    x1, y1 = F.cos(az) * x - F.sin(az) * y, F.sin(az) * x + F.cos(az) * y
    y2, z2 = F.cos(ax) * y1 - F.sin(ax) * z, F.sin(ax) * y1 + F.cos(ax) * z
    x3, z3 = F.cos(ay) * x1 + F.sin(ay) * z2, -F.sin(ay) * x1 + F.cos(ay) * z2
    return x3 + shift[0], y2 + shift[1], z3 + shift[2]


def in_sphere(x: Column, y: Column, z: Column, centre: tuple, radius) -> Column:
    """Strictly inside, in all three dimensions."""
    return (x - centre[0]) ** 2 + (y - centre[1]) ** 2 + (z - centre[2]) ** 2 < radius * radius


def in_cylinder(x: Column, y: Column, z: Column, centre: tuple, radius, half_height) -> Column:
    return ((x - centre[0]) ** 2 + (y - centre[1]) ** 2 < radius * radius) & (F.abs(z - centre[2]) < half_height)


def in_hull(x: Column, y: Column, z: Column, facets: list[tuple[float, float, float, float]]) -> Column:
    """Inside all half-spaces a x + b y + c z <= d."""
    inside = F.lit(True)
    for a, b, c, d in facets:
        inside = inside & (a * x + b * y + c * z <= d)
    return inside


def sphere_thickness(x: Column, y: Column, centre: tuple, radius) -> Column:
    """Length of the sphere along z over (x, y)."""
    return 2 * F.sqrt(F.greatest(F.lit(0.0), radius * radius - (x - centre[0]) ** 2 - (y - centre[1]) ** 2))


def along_vector(x: Column, y: Column, start: tuple, end: tuple, half_width: float) -> tuple[Column, Column]:
    """Distance along a segment, and whether the point lies beside it within half_width."""
    dx, dy = end[0] - start[0], end[1] - start[1]
    length = math.hypot(dx, dy)
    par = ((x - start[0]) * dx + (y - start[1]) * dy) / length
    per = ((y - start[1]) * dx - (x - start[0]) * dy) / length
    return par, par.between(0, length) & (F.abs(per) <= half_width)


def labelled_mask(masks: DataFrame, voxel: list[str], label: str = "voi") -> DataFrame:
    """One label a voxel: the largest."""
    return masks.groupBy(*voxel).agg(F.max(label).alias(label))


def procrustes(points: DataFrame, x: str, y: str, u: str, v: str):
    """The orthogonal 2x2 map (reflection allowed) and shift that take (x, y) nearest (u, v), from seven sums."""
    import numpy as np

    r = points.agg(*(F.avg(c).alias(c) for c in (x, y, u, v)), *(F.covar_pop(a, b).alias(f"{a}_{b}") for a in (x, y) for b in (u, v))).first()
    m = np.array([[r[f"{a}_{b}"] for b in (u, v)] for a in (x, y)])
    left, _, right = np.linalg.svd(m)
    q = (left @ right).T
    return q, np.array([r[u], r[v]]) - q @ np.array([r[x], r[y]])
