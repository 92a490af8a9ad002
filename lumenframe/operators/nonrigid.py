"""Free-form fits: a B-spline lattice of shifts, of one or several levels, that brings points to where a template is bright.

The objective is the Poisson log likelihood of points, less what the template expects where the scan dwelt, per point, with springs between
control points and an anchor at rest:
    -(sum w log F(p + d(p)) - sum v F(q + d(q))) / sum w + weight * sum over levels (springs + anchors)
Its slope is analytic.  A frame of points that fits one task is fitted there (`bent_frames`); for larger volumes the
sums of a step are one aggregation over the whole table, and the driver holds values the size of the lattice only (`bent_volume`).
Both points and dwell are shifted; no control point moves over LIMIT of its lattice's step.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import kept
from . import descent, estimators, fits

LIMIT = 0.4


@dataclass(frozen=True)
class Lattice:
    """Control points of one level: how many, where the first is, and how far apart they are, by axis."""

    count: tuple[int, int, int]
    start: tuple[float, float, float]
    step: tuple[float, float, float]

    @property
    def size(self) -> int:
        return 3 * math.prod(self.count)


def lattices(low, high, counts: list[tuple[int, int, int]]) -> list[Lattice]:
    """Of each level the lattice that spans low to high; an axis of one control point has a step of its extent."""
    extent = np.maximum(np.subtract(high, low), 1e-9)
    return [Lattice(tuple(n), tuple(map(float, low)), tuple(float(e / max(1, m - 1)) for e, m in zip(extent, n, strict=True))) for n in counts]


def weights(lattice: Lattice, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each point the 64 control points around it and their cubic B-spline weights; those beyond the ends are the last ones."""
    index, weight = [], []
    for a in range(3):
        s = (p[:, a] - lattice.start[a]) / lattice.step[a]
        i = np.floor(s)
        u = s - i
        weight.append(np.stack([(1 - u) ** 3, 3 * u**3 - 6 * u**2 + 4, -3 * u**3 + 3 * u**2 + 3 * u + 1, u**3], 1) / 6)
        index.append(np.clip(i[:, None] + np.arange(-1, 3), 0, lattice.count[a] - 1).astype(np.int64))
    at = (index[0][:, :, None, None] * lattice.count[1] + index[1][:, None, :, None]) * lattice.count[2] + index[2][:, None, None, :]
    w = weight[0][:, :, None, None] * weight[1][:, None, :, None] * weight[2][:, None, None, :]
    return at.reshape(len(p), 64), w.reshape(len(p), 64)


def trilinear_slopes(volume: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values at points in voxel units, held at the edges, and their slopes along the three axes, which are 0 beyond the edges."""
    low, part, inside = [], [], []
    for a in range(3):
        x = np.clip(at[:, a], 0, volume.shape[a] - 1)
        i = np.minimum(np.floor(x).astype(int), max(volume.shape[a] - 2, 0))
        low.append(i)
        part.append(x - i)
        inside.append((at[:, a] >= 0) & (at[:, a] <= volume.shape[a] - 1))
    value, slope = np.zeros(len(at)), np.zeros((len(at), 3))
    for k in range(8):
        d = [(k >> a) & 1 for a in range(3)]
        v = volume[tuple(np.minimum(low[a] + d[a], volume.shape[a] - 1) for a in range(3))]
        w = [part[a] if d[a] else 1 - part[a] for a in range(3)]
        value += w[0] * w[1] * w[2] * v
        for a in range(3):
            slope[:, a] += (1 if d[a] else -1) * w[(a + 1) % 3] * w[(a + 2) % 3] * v
    return value, slope * np.stack(inside, 1)


# ---------------------------------------------------------------- energies of a lattice

#: Neighbours of a control point: along an axis, a plane's diagonal, the box's diagonal.
PAIRS = [(1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0), (1, 0, 1), (0, 1, 1), (1, 1, 1)]


def springs(shift: np.ndarray, step) -> tuple[float, np.ndarray]:
    """Energy of the springs between neighbouring control points, and its slope; shift: (nx, ny, nz, 3).

    Half the squared strain along each pair: how much further apart the two are along the line between their rests, over its length.
    """
    energy, slope, step = 0.0, np.zeros_like(shift), np.asarray(step, float)
    for pair in PAIRS:
        axes = np.flatnonzero(pair)
        way = step[axes] / (step[axes] ** 2).sum()
        upper, lower = tuple(slice(1, None) if k else slice(None) for k in pair), tuple(slice(None, -1) if k else slice(None) for k in pair)
        strain = (shift[upper][..., axes] - shift[lower][..., axes]) @ way
        energy += 0.5 * float((strain**2).sum())
        for k, a in enumerate(axes):
            slope[(*upper, a)] += strain * way[k]
            slope[(*lower, a)] -= strain * way[k]
    return energy, slope


def anchors(shift: np.ndarray, length: float) -> tuple[float, np.ndarray]:
    """Energy of shifts from rest, half their squares over that of a length, and its slope."""
    return 0.5 * float((shift**2).sum()) / length**2, shift / length**2


def lattice_energies(nodes: DataFrame, keys: list[str], index: tuple[str, str, str], shift: tuple[str, str, str], step: tuple[float, float, float], length: float) -> DataFrame:
    """Of each key's lattice, a row for each control point: its `spring` and `anchor` energy, by one join of neighbours."""
    away = F.inline(F.array(*(F.struct(*(F.lit(d).alias(f"_{a}") for a, d in zip("xyz", p, strict=True))) for p in PAIRS)))
    own = nodes.select(*keys, *index, *shift, away)
    next_ = nodes.select(*keys, *(F.col(i).alias(f"n_{i}") for i in index), *(F.col(s).alias(f"n_{s}") for s in shift))
    on = [own[k] == next_[k] for k in keys] + [own[i] + own[f"_{a}"] == next_[f"n_{i}"] for i, a in zip(index, "xyz", strict=True)]
    both = own.join(next_, on).select(*(own[k] for k in keys), *(F.col(f"_{a}") for a in "xyz"), *((F.col(f"n_{s}") - F.col(s)).alias(f"d_{s}") for s in shift))
    length2 = sum(F.col(f"_{a}") * (h * h) for a, h in zip("xyz", step, strict=True))
    strain = sum(F.col(f"_{a}") * h * F.col(f"d_{s}") for a, h, s in zip("xyz", step, shift, strict=True)) / length2
    rest = nodes.groupBy(*keys).agg((F.sum(sum(F.col(s) * F.col(s) for s in shift)) / (2 * length * length)).alias("anchor"))
    pulled = both.groupBy(*keys).agg((F.sum(strain * strain) / 2).alias("spring"))
    out = rest.join(pulled, keys, "left") if keys else rest.join(F.broadcast(pulled), how="cross")  # one row each
    return out.select(*keys, F.coalesce("spring", F.lit(0.0)).alias("spring"), "anchor")


# ---------------------------------------------------------------- the objective


def shifted(p: np.ndarray, levels: list[Lattice], x: np.ndarray) -> np.ndarray:
    """Points under the shifts of all levels, whose control points' shifts are one after another in x."""
    out, at = p.copy(), 0
    for lattice in levels:
        i, w = weights(lattice, p)
        out += (x[at : at + lattice.size].reshape(-1, 3)[i] * w[..., None]).sum(1)
        at += lattice.size
    return out


def image_sums(p: np.ndarray, w: np.ndarray, dwell: np.ndarray, levels: list[Lattice], x: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """[log likelihood, its slope by x] summed over points (w, and dwell nan) and places of dwell (dwell not nan)."""
    value, slope = trilinear_slopes(rate, shifted(p, levels, x))
    scanned = ~np.isnan(dwell)
    each = np.where(scanned, -np.nan_to_num(dwell) * value, w * np.log(value))
    pull = np.where(scanned, -np.nan_to_num(dwell), w / value)[:, None] * slope
    out = [np.array([each.sum()])]
    for lattice in levels:
        i, b = weights(lattice, p)
        out.append(np.stack([np.bincount(i.ravel(), (b * pull[:, a, None]).ravel(), math.prod(lattice.count)) for a in range(3)], 1).ravel())
    return np.concatenate(out)


def with_geometry(sums: np.ndarray, total: float, levels: list[Lattice], x: np.ndarray, weight: float, length: float) -> tuple[float, np.ndarray]:
    """The objective and its slope, from the image's sums."""
    value, slope, at = -sums[0] / total, -sums[1:] / total, 0
    for lattice in levels:
        m = x[at : at + lattice.size].reshape(*lattice.count, 3)
        (u, g), (v, h) = springs(m, lattice.step), anchors(m, length)
        value += weight * (u + v)
        slope[at : at + lattice.size] += weight * (g + h).ravel()
        at += lattice.size
    return float(value), slope


def floored(template: np.ndarray, least: float = 1e-3) -> np.ndarray:
    """A template's rates, no less than a part of the largest."""
    return np.maximum(np.nan_to_num(template), max(float(np.nanmax(template)), 1e-300) * least)


def rescaled(points_weight: float, expected: float) -> float:
    """What dwell is to be multiplied by so that the template expects as many points as there are."""
    return points_weight / expected if expected > 0 else 1.0


def bounds(levels: list[Lattice]) -> np.ndarray:
    return np.concatenate([np.tile(LIMIT * np.array(x.step), math.prod(x.count)) for x in levels])


def bend(points: np.ndarray, weight: np.ndarray, dwell_at: np.ndarray, dwell: np.ndarray, template: np.ndarray, counts: list[tuple[int, int, int]], geometry: float = 0.05, length: float = 10.0, steps: int = 60) -> tuple[list[Lattice], np.ndarray, float]:
    """Lattices, shifts and objective of one frame's fit."""
    rate, p = floored(template), np.concatenate([points, dwell_at])
    levels = lattices(p.min(0), p.max(0), counts)
    v = np.concatenate([np.full(len(points), np.nan), dwell])
    if len(dwell):
        v = v * rescaled(weight.sum(), float((dwell * trilinear_slopes(rate, dwell_at)[0]).sum()))
    w, limit = np.concatenate([weight, np.zeros(len(dwell))]), bounds(levels)

    def f(x):
        return with_geometry(image_sums(p, w, v, levels, x, rate), weight.sum(), levels, x, geometry, length)

    return levels, *descent.minimised(f, np.zeros(len(limit)), -limit, limit, steps)


def _nodes(levels: list[Lattice], x: np.ndarray) -> pd.DataFrame:
    out, at = [], 0
    for n, lattice in enumerate(levels):
        i, j, k = (a.ravel() for a in np.indices(lattice.count))
        d = x[at : at + lattice.size].reshape(-1, 3)
        out.append(pd.DataFrame({"level": n, "i": i, "j": j, "k": k, "dx": d[:, 0], "dy": d[:, 1], "dz": d[:, 2]}))
        at += lattice.size
    return pd.concat(out, ignore_index=True)


_NODE = "level long, i long, j long, k long, dx double, dy double, dz double"


def _rows(points: DataFrame, axes, weight: str | None, dwell: DataFrame | None, dwelt: str, keys: list[str]) -> DataFrame:
    """keys, axes, _w and _v (null for points) of points and dwell; null and negative weights are left out."""
    rows = points.select(*keys, *(F.col(a).cast("double").alias(a) for a in axes), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"), F.lit(None).cast("double").alias("_v")).where("_w > 0")
    if dwell is not None:
        rows = rows.unionByName(dwell.select(*keys, *(F.col(a).cast("double").alias(a) for a in axes), F.lit(0.0).alias("_w"), F.col(dwelt).cast("double").alias("_v")).where("_v > 0"))
    return rows.dropna(subset=[*keys, *axes])


def bent_frames(points: DataFrame, frame: str, axes: tuple[str, str, str], template: np.ndarray, counts: list[tuple[int, int, int]], weight: str | None = None, dwell: DataFrame | None = None, dwelt: str = "dwell", bound: int = 5_000_000, **how) -> DataFrame:
    """frame, the lattices' control points with their shifts, and `value`, the frame's objective; frames run side by side."""
    if template.size > fits.MOST:
        raise ValueError(f"a template of {template.size} values; {fits.MOST} at most")
    shared = points.sparkSession.sparkContext.broadcast(template)  # at most MOST values

    def one(d: pd.DataFrame) -> pd.DataFrame:
        own = d["_v"].isna()
        at = d[list(axes)].to_numpy(float)
        if not own.any():
            return pd.DataFrame(columns=[frame, *(c.split()[0] for c in _NODE.split(", ")), "value"])
        levels, x, value = bend(at[own], d["_w"].to_numpy()[own], at[~own], d["_v"].to_numpy()[~own], shared.value, counts, **how)
        out = _nodes(levels, x)
        out.insert(0, frame, d[frame].iloc[0])
        return out.assign(value=value)

    rows = _rows(points, axes, weight, dwell, dwelt, [frame])
    return estimators.by_key(rows, [frame], list(axes), one, f"`{frame}` {dict(points.dtypes)[frame]}, {_NODE}, value double", bound)


# ---------------------------------------------------------------- a volume of any size


def _summed(axes, sent, levels, x, batches):
    rate, total = sent.value, None
    for b in batches:
        if b.num_rows:
            p = np.stack([b.column(a).to_numpy() for a in axes], 1)
            one = image_sums(p, b.column("_w").to_numpy(), b.column("_v").to_numpy(zero_copy_only=False), levels, x, rate)
            total = one if total is None else total + one
    if total is not None:
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["sums"])


def _added(t: pa.Table) -> pa.Table:
    return pa.table({"sums": pa.array([np.sum([np.frombuffer(v, float) for v in t["sums"].to_pylist()], axis=0).tobytes()], pa.binary())})


def bent_volume(points: DataFrame, axes: tuple[str, str, str], template: np.ndarray, counts: list[tuple[int, int, int]], weight: str | None = None, dwell: DataFrame | None = None, dwelt: str = "dwell", geometry: float = 0.05, length: float = 10.0, steps: int = 60) -> tuple[DataFrame, float]:
    """Control points with their shifts, and the objective, of one fit of a whole table.

    A step is one job: each task adds up its rows' likelihood and slopes, and tasks' sums, of the lattice's size, are added in two rounds.
    Raises if there are no points.
    """
    if template.size > fits.MOST:
        raise ValueError(f"a template of {template.size} values; {fits.MOST} at most")
    spark, rate = points.sparkSession, floored(template)
    rows = kept(_rows(points, axes, weight, dwell, dwelt, []))
    span = rows.agg(*(f(a) for f in (F.min, F.max) for a in axes), F.sum("_w")).first()
    total = span[6] or 0.0
    if not total:
        raise ValueError("no points to fit")
    levels = lattices(span[:3], span[3:6], counts)
    sent, some = spark.sparkContext.broadcast(rate), math.ceil(math.sqrt(rows.rdd.getNumPartitions()))

    def sums(x, levels=levels):
        each = rows.mapInArrow(partial(_summed, axes, sent, levels, x), "sums binary")
        each = each.groupBy(F.spark_partition_id() % some).applyInArrow(_added, "sums binary")
        return np.sum([np.frombuffer(r.sums, float) for r in each.collect()], axis=0)

    if dwell is not None:
        # without lattices the sum is over the image alone; points' share of it is taken off by their own sum
        plain = rows.where("_v is not null").mapInArrow(partial(_summed, axes, sent, [], np.zeros(0)), "sums binary").collect()
        scale = rescaled(total, -float(np.sum([np.frombuffer(r.sums, float)[0] for r in plain])))
        rows = kept(rows.withColumn("_v", F.col("_v") * scale))
    limit = bounds(levels)
    x, value = descent.minimised(lambda x: with_geometry(sums(x), total, levels, x, geometry, length), np.zeros(len(limit)), -limit, limit, steps, 1e-5)
    return spark.createDataFrame(_nodes(levels, x), _NODE), value
