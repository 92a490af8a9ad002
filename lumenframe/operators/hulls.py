"""Convex hulls that merge: the hull of each partition's points, then hulls of hulls, so that no task sees all points.

Only vertices travel.  From a hull come its outline, its half-spaces (`geometry.in_hull`), its heights over a place, and the least
rectangle around it by rotating callipers.  Points with a null or non-finite coordinate are left out; a point within 1e-9 of the set's
size of a face counts as on it; keys whose points lie in a plane, on a line or in one place have the half-spaces of that.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEAR = 1e-9

# ---------------------------------------------------------------- hulls of arrays


def hull2d(p: np.ndarray) -> np.ndarray:
    """Vertices of the hull of points in the plane, counter-clockwise from the least x (then y); none in between two others."""
    p = np.unique(p, axis=0)
    if len(p) > 64:  # what lies strictly inside the octagon of the extremes is no vertex
        a = np.arange(8) * math.pi / 4
        way = np.stack([np.cos(a), np.sin(a)], 1)
        corner = p[np.unique((p @ way.T).argmax(0))]
        corner = corner[np.argsort(np.arctan2(*(corner - corner.mean(0)).T[::-1]))]
        if len(corner) > 2:
            edge = np.roll(corner, -1, 0) - corner
            d = p[:, None] - corner[None]
            inside = edge[None, :, 0] * d[..., 1] - edge[None, :, 1] * d[..., 0] > NEAR * max(1e-300, np.ptp(p, axis=0).max()) ** 2
            p = p[~inside.all(1)]
    if len(p) < 3:
        return p
    least = NEAR * np.ptp(p, axis=0).max() ** 2

    def chain(points):
        out: list = []
        for x, y in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (y - out[-2][1]) - (out[-1][1] - out[-2][1]) * (x - out[-2][0]) <= least:
                out.pop()
            out.append((x, y))
        return out[:-1]

    rows = p.tolist()
    return np.array(chain(rows) + chain(rows[::-1]))


def _frame(p: np.ndarray) -> tuple[int, np.ndarray]:
    """Dimension of the points' affine hull, and three orthonormal directions, those of the hull first."""
    _, s, v = np.linalg.svd(p - p.mean(0), full_matrices=True)
    s = np.concatenate([s, np.zeros(3 - len(s))]) if len(s) < 3 else s
    return int((s > NEAR * max(1.0, np.abs(p).max()) * math.sqrt(len(p))).sum()), v


def hull3d(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of the hull of points in space, and its half-spaces a x + b y + c z <= d with unit normals, one for each face.

    Grows a tetrahedron by the point furthest over a face: the faces it sees go, and new ones close the horizon.
    """
    p = np.unique(p, axis=0)
    if not len(p):
        return p, np.zeros((0, 4))
    dimension, axes = _frame(p)
    if dimension < 3:
        return _flat(p, dimension, axes)
    near = NEAR * max(1e-300, np.ptp(p, axis=0).max())
    first = [int(p[:, 0].argmin()), int(p[:, 0].argmax())]
    if first[0] == first[1] or p[first[0], 0] == p[first[1], 0]:
        u = p @ axes[0]
        first = [int(u.argmin()), int(u.argmax())]
    line = p[first[1]] - p[first[0]]
    first.append(int(np.linalg.norm(np.cross(p - p[first[0]], line), axis=1).argmax()))
    normal = np.cross(line, p[first[2]] - p[first[0]])
    first.append(int(np.abs((p - p[first[0]]) @ normal).argmax()))
    middle = p[first].mean(0)
    faces: dict[int, tuple] = {}
    edges: dict[tuple[int, int], int] = {}
    made = 0

    def add(a: int, b: int, c: int, among: np.ndarray) -> np.ndarray:
        nonlocal made
        n = np.cross(p[b] - p[a], p[c] - p[a])
        n = n / np.linalg.norm(n)
        if n @ (middle - p[a]) > 0:
            b, c, n = c, b, -n
        over = p[among] @ n - n @ p[a]
        mine = among[over > near]
        faces[made] = (a, b, c, n, n @ p[a], mine[np.argsort(-over[over > near], kind="stable")] if len(mine) else mine)
        edges.update({(a, b): made, (b, c): made, (c, a): made})
        made += 1
        return among[over <= near]

    left = np.setdiff1d(np.arange(len(p)), first)
    for skip in range(4):
        left = add(*(first[i] for i in range(4) if i != skip), left)
    work = list(faces)
    while work:
        f = work.pop()
        if f not in faces or not len(faces[f][5]):
            continue
        eye = int(faces[f][5][0])
        seen, stack, horizon = {f}, [f], []
        while stack:
            a, b, c, *_ = faces[stack.pop()]
            for x, y in ((a, b), (b, c), (c, a)):
                other = edges[y, x]
                if other in seen:
                    continue
                if faces[other][3] @ p[eye] - faces[other][4] > near:
                    seen.add(other)
                    stack.append(other)
                else:
                    horizon.append((x, y))
        loose = np.setdiff1d(np.concatenate([faces[s][5] for s in seen]), [eye])
        for s in seen:
            a, b, c, *_ = faces.pop(s)
            for x, y in ((a, b), (b, c), (c, a)):
                edges.pop((x, y), None)
        for x, y in horizon:
            loose = add(x, y, eye, loose)
            work.append(made - 1)
    planes = _merged(np.array([[*n, d] for *_, n, d, _ in faces.values()]), near)
    at = p[np.unique([i for face in faces.values() for i in face[:3]])]
    # a vertex lies on three planes that no line is common to; what lies within a face or an edge is none
    on = np.abs(at @ planes[:, :3].T - planes[:, 3]) <= 8 * near
    return at[[np.linalg.matrix_rank(planes[o, :3], tol=1e-7) == 3 for o in on]], planes


def _merged(planes: np.ndarray, near: float) -> np.ndarray:
    """One of each group of planes that are the same, by their normals to seven digits."""
    _, first = np.unique(np.round(planes[:, :3], 7) + 0.0, axis=0, return_index=True)
    out = planes[np.sort(first)]
    return out[np.lexsort(np.round(out, 9).T[::-1])]


def _flat(p: np.ndarray, dimension: int, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hull and half-spaces of points in a plane, on a line or in one place."""
    planes = []
    for n in axes[dimension:]:
        planes += [(n, (p @ n).max()), (-n, -(p @ n).min())]
    if dimension == 2:
        flat = hull2d(p @ axes[:2].T)
        edge = np.roll(flat, -1, 0) - flat
        n = np.stack([edge[:, 1], -edge[:, 0]], 1) @ axes[:2]
        n /= np.linalg.norm(n, axis=1)[:, None]
        planes += [(m, (p @ m).max()) for m in n]
        corner = np.array([int(np.square(p @ axes[:2].T - v).sum(1).argmin()) for v in flat])
    elif dimension == 1:
        u = p @ axes[0]
        planes += [(axes[0], u.max()), (-axes[0], -u.min())]
        corner = np.array([u.argmin(), u.argmax()])
    else:
        corner = np.array([0])
    out = np.array([[*n, d] for n, d in planes]) + 0.0
    return p[np.unique(corner)], out[np.lexsort(np.round(out, 9).T[::-1])]


# ---------------------------------------------------------------- hulls of tables


def _vertices(v: np.ndarray) -> np.ndarray:
    return hull2d(v) if v.shape[1] == 2 else hull3d(v)[0]


def _of_partition(keys: list[str], axes: list[str], batches):
    """Of each key of a partition the hull of its points so far; a batch adds its own."""
    held: dict = {}
    for d in batches:
        parts = d.groupby(keys, dropna=False, sort=False) if keys else [((), d)]
        for k, part in parts:
            k = tuple(None if pd.isna(x) else x for x in (k if isinstance(k, tuple) else (k,)))
            v = part[axes].to_numpy(float)
            held[k] = _vertices(np.concatenate([held[k], v]) if k in held else v)
        if sum(map(len, held.values())) > 1 << 18:
            yield from _frames(held, keys, axes)
            held = {}
    yield from _frames(held, keys, axes)


def _frames(held: dict, keys: list[str], axes: list[str]):
    if held:
        size = [len(v) for v in held.values()]
        table = {k: pd.Series([key[i] for key, n in zip(held, size, strict=True) for _ in range(n)], dtype=object) for i, k in enumerate(keys)}
        v = np.concatenate(list(held.values()))
        yield pd.DataFrame({**table, **{a: v[:, i] for i, a in enumerate(axes)}})


def vertices(points: DataFrame, keys: list[str], axes: list[str]) -> DataFrame:
    """keys and axes of the hull's vertices of each key's points, in the plane or in space, by hulls of hulls."""
    good = points
    for a in axes:
        good = good.where(F.col(a).isNotNull() & ~F.isnan(F.col(a).cast("double")) & (F.abs(F.col(a).cast("double")) != float("inf")))
    rows = good.select(*keys, *(F.col(a).cast("double").alias(a) for a in axes))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    out = rows.mapInPandas(partial(_of_partition, keys, axes), ddl)
    if not keys:
        return out.withColumn("_s", F.lit(0)).groupBy("_s").applyInPandas(_whole([], axes), ddl)
    some = math.ceil(math.sqrt(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    out = out.withColumn("_s", F.spark_partition_id() % some)
    for by in (["_s"], []):
        out = out.groupBy(*keys, *by).applyInPandas(_whole(keys, axes, by), ", ".join([ddl, *(["_s int"] if by else [])]))
    return out


def _whole(keys: list[str], axes: list[str], more: list[str] = ()):
    def one(d: pd.DataFrame) -> pd.DataFrame:
        v = _vertices(d[axes].to_numpy(float))
        return pd.DataFrame({**{k: d[k].iloc[:1].repeat(len(v)).to_numpy() for k in keys}, **{a: v[:, i] for i, a in enumerate(axes)}, **{k: d[k].iloc[:1].repeat(len(v)).to_numpy() for k in more}})

    return one


def _each(points: DataFrame, keys: list[str], axes: list[str], make, columns: str) -> DataFrame:
    """What `make` says of each key's vertices; a group has the vertices of one hull."""
    found = vertices(points, keys, axes)
    names = [c.split()[0] for c in columns.split(", ")]

    def one(d: pd.DataFrame) -> pd.DataFrame:
        rows = make(d[axes].to_numpy(float))
        return pd.DataFrame({**{k: d[k].iloc[:1].repeat(len(rows)).to_numpy() for k in keys}, **{n: [r[i] for r in rows] for i, n in enumerate(names)}})

    ddl = ", ".join([*(f"`{k}` {dict(found.dtypes)[k]}" for k in keys), columns])
    return (found.groupBy(*keys) if keys else found.withColumn("_s", F.lit(0)).groupBy("_s")).applyInPandas(one, ddl)


def outline(points: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Vertices of each key's hull in the plane: place (0, 1, ... counter-clockwise from the least x, then y), x and y."""
    return _each(points, keys, [x, y], lambda v: [(i, float(a), float(b)) for i, (a, b) in enumerate(hull2d(v))], "place int, x double, y double")


def facets(points: DataFrame, keys: list[str], x: str, y: str, z: str) -> DataFrame:
    """Half-spaces a x + b y + c z <= d of each key's hull in space, unit normals, each face once: for `geometry.in_hull`."""
    return _each(points, keys, [x, y, z], lambda v: [tuple(map(float, r)) for r in hull3d(v)[1]], "a double, b double, c double, d double")


def callipers(v: np.ndarray, by: str = "area") -> tuple[float, float, float, float]:
    """Angle, width, height and area of the least rectangle around a hull's outline: one side lies along an edge.

    The outermost vertices of all edges' directions are found by their place among the edges' angles, in order.
    """
    if len(v) < 2:
        return 0.0, 0.0, 0.0, 0.0
    edge = np.roll(v, -1, 0) - v
    angle = np.unwrap(np.arctan2(edge[:, 1], edge[:, 0]))  # rises around the outline
    if len(v) == 2:
        return float(angle[0] % (math.pi / 2)), *((float(np.hypot(*edge[0])), 0.0) if angle[0] % math.pi < math.pi / 2 else (0.0, float(np.hypot(*edge[0])))), 0.0
    way = np.stack([np.cos(angle), np.sin(angle)], 1)
    across = np.stack([-way[:, 1], way[:, 0]], 1)

    def furthest(turn):  # the vertex where the edges' angles pass turn from the direction
        want = (angle + turn - angle[0]) % (2 * math.pi) + angle[0]
        return v[np.searchsorted(angle, want - 1e-12) % len(v)]

    width = ((furthest(math.pi / 2) - furthest(-math.pi / 2)) * way).sum(1)
    height = ((furthest(math.pi) - v) * across).sum(1)
    cost = np.round((width * height if by == "area" else width + height), 12)
    i = np.lexsort((np.round(angle % (math.pi / 2), 9), cost))[0]
    a = angle[i] % math.pi
    w, h = (width[i], height[i]) if a < math.pi / 2 else (height[i], width[i])  # as seen from the first quarter turn
    return float(a % (math.pi / 2)), float(w), float(h), float(width[i] * height[i])


def least_rectangle(points: DataFrame, keys: list[str], x: str, y: str, by: str = "area") -> DataFrame:
    """Of each key the exact rectangle of least area or perimeter around its points: angle (0 to a quarter turn), width, height, area."""
    if by not in ("area", "perimeter"):
        raise ValueError("by is area or perimeter")
    return _each(points, keys, [x, y], lambda v: [callipers(hull2d(v), by)], "angle double, width double, height double, area double")


# ---------------------------------------------------------------- what a hull says of points


def heights(x: Column, y: Column, planes: list[tuple[float, float, float, float]]) -> tuple[Column, Column]:
    """Least and greatest z of a hull over (x, y), from its half-spaces; both null beside it."""
    low, high, inside = F.lit(float("-inf")), F.lit(float("inf")), F.lit(True)
    for a, b, c, d in planes:
        rest = F.lit(d) - a * x - b * y
        if abs(c) < 1e-9:
            inside = inside & (rest >= -NEAR)
        elif c > 0:
            high = F.least(high, rest / c)
        else:
            low = F.greatest(low, rest / c)
    inside = inside & (low <= high + NEAR)
    return F.when(inside, low), F.when(inside, high)


def over_outline(x: Column, y: Column, outline_: list[tuple[float, float]]) -> Column:
    """Whether (x, y) lies in a counter-clockwise outline, its edges included."""
    inside = F.lit(len(outline_) > 2)
    for (ax, ay), (bx, by) in zip(outline_, [*outline_[1:], *outline_[:1]], strict=True):
        inside = inside & ((bx - ax) * (y - ay) - (by - ay) * (x - ax) >= -NEAR)
    return inside
