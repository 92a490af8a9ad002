"""Strides inside labelled behaviour, splines and hulls by key, and fits of frames that know of dwell, neighbours and bending.

Whatever needs a series, a frame or a segment of frames as a whole goes through `estimators.by_key`, which states how long one may be.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import estimators, fits, segments, series, temporal

FORWARD, BACKWARD = 1, 2


# ---------------------------------------------------------------- strides


def crawls(rows: DataFrame, keys: list[str], t: str, label: str, least: int = 4) -> DataFrame:
    """rows inside runs of one label, 1 or 2, of `least` rows or more, with `crawl`, the run's first time."""
    w = Window.partitionBy(*keys).orderBy(t)
    new = F.when(F.col(label).eqNullSafe(F.lag(label).over(w)) & (F.row_number().over(w) > 1), F.lit(None)).otherwise(F.col(t))
    runs = rows.withColumn("crawl", F.last(new, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    n = F.count("*").over(Window.partitionBy(*keys, "crawl"))
    return runs.where(F.col(label).isin(FORWARD, BACKWARD)).withColumn("_n", n).where(F.col("_n") >= least).drop("_n")


def labelled_strides(rows: DataFrame, keys: list[str], t: str, velocity: str, label: str, share: float = 0.5, bound: int = 1_000_000) -> DataFrame:
    """keys, t, label, crawl, `stride` (from 1 in each crawl) and `phase` (0 to 2 pi, rising with time inside a stride).

    A stride starts where the analytic phase of the velocity (its negative where the label is forwards) falls from pi to -pi.
    Strides of under `share` of the others' mean time join a neighbour.  Rows outside crawls, or without a velocity, are left out.
    """
    some = crawls(rows.where(F.col(velocity).isNotNull() & F.col(t).isNotNull()), keys, t, label).select(*keys, "crawl", t, label, F.col(velocity).cast("double").alias("_v"))
    kinds = dict(some.dtypes)

    def one(p):
        v, at = p["_v"].to_numpy(float), p[t].to_numpy(float)
        x = -v if p[label].iloc[0] == FORWARD else v
        cut = np.concatenate([[0], np.cumsum(np.diff(fits.analytic_phase(x)) < -np.pi)])
        ends = np.flatnonzero(np.diff(cut, append=cut[-1] + 1))
        stride = fits.merge_short(np.diff(at[ends], prepend=at[0]), share)[cut]
        first = np.array([at[stride == s][0] for s in range(stride.max() + 1)] + [at[-1]])
        span = np.maximum(first[stride + 1] - first[stride], 1e-12)
        return p.drop(columns="_v").assign(stride=stride + 1, phase=2 * math.pi * (at - first[stride]) / span)

    return estimators.by_key(some, [*keys, "crawl"], [t], one, ", ".join([*(f"`{c}` {kinds[c]}" for c in [*keys, "crawl", t, label]), "stride long, phase double"]), bound)


def monotone_repaired(rows: DataFrame, keys: list[str], t: str, value: str) -> DataFrame:
    """rows whose value never falls along t: what is passed by another is replaced by the line between what is not."""
    flagged = segments.monotone(rows, keys, [t], value, "_ok").withColumn(value, F.when(F.col("_ok"), F.col(value))).drop("_ok")
    return series.filled(flagged, keys, t, value, "linear")


def splined(rows: DataFrame, keys: list[str], t: str, value: str, p: float, bound: int = 1_000_000) -> DataFrame:
    """rows with `smooth`: the cubic smoothing spline of each key; rows with null time or value are left out."""
    some = rows.where(F.col(t).isNotNull() & F.col(value).isNotNull())
    return estimators.by_key(some, keys, [t], lambda d: d.assign(smooth=fits.smoothing_spline(d[t].to_numpy(float), d[value].to_numpy(float), p)), f"{estimators._ddl(some)}, smooth double", bound)


# ---------------------------------------------------------------- fits of frames


def likelihood(pose: np.ndarray, points: np.ndarray, rate: np.ndarray, dwell: np.ndarray | None, weights: np.ndarray | None) -> float:
    """Poisson log likelihood of points under a pose, less the expected counts where the scan dwelt (columns x, y, z and weights)."""
    log = np.log(np.maximum(rate, max(rate.max(), 1e-300) * 1e-3))
    out = float(fits.trilinear(log, fits.turned(points, pose)).sum()) if len(points) else 0.0
    if dwell is not None and len(dwell):
        out -= float((weights * fits.trilinear(rate, fits.turned(dwell, pose))).sum())
    return out


def _climb(score, start: np.ndarray, reach: np.ndarray, least: float = 1e-3) -> np.ndarray:
    """A pattern search from start: steps either way, halved until all are under `least` of reach."""
    pose, step = np.array(start, float), np.array(reach, float)
    best = score(pose)
    while (step > least * reach).any():
        moved = False
        for i in np.flatnonzero(step > 0):
            for sign in (1, -1):
                other = pose.copy()
                other[i] += sign * step[i]
                if (s := score(other)) > best:
                    best, pose, moved = s, other, True
                    break
        if not moved:
            step = step / 2
    return pose


def moment_start(points: np.ndarray, template: np.ndarray) -> np.ndarray:
    """A pose that brings the points' mean and long axis in the plane to the template's."""
    at = np.stack(np.meshgrid(*map(np.arange, template.shape), indexing="ij"), -1).reshape(-1, 3).astype(float)
    w = np.maximum(template.ravel(), 0)
    w = w / max(w.sum(), 1e-300)

    def axis(p, w):
        m = w @ p
        d = (p - m)[:, :2]
        c = (d * w[:, None]).T @ d
        return m, 0.5 * math.atan2(2 * c[0, 1], c[0, 0] - c[1, 1])

    m0, a0 = axis(points, np.full(len(points), 1 / len(points)))
    m1, a1 = axis(at, w)
    pose = np.array([a1 - a0, 0, 0, 0, 0, 0.0])
    pose[3:] = m1 - fits.turned(m0[None], pose)[0]
    return pose


def linked_poses(points: DataFrame, segment: str, frame: str, axes: tuple[str, str, str], template: np.ndarray, dwell: DataFrame | None = None, weight: str = "dwell", stiffness: tuple = (1.0,) * 6, reach: tuple = (0.2, 0.2, 0.2, 2.0, 2.0, 2.0), sweeps: int = 3, bound: int = 5_000_000) -> DataFrame:
    """segment, frame, pvec and n: the poses of a segment's frames that together fit the template best.

    Each frame's likelihood (with the dwell's expected counts, if given) less stiffness times the squared distance of its pose from
    the mean of its neighbours'.  Frames start from their moments or the pose before, whichever fits better, and are then improved
    in turn, `sweeps` times.  Segments are independent and run side by side; `bound` rows of one.
    """
    if template.size > fits.MOST:
        raise ValueError(f"a template of {template.size} values; {fits.MOST} at most")
    shared = points.sparkSession.sparkContext.broadcast(template)  # at most MOST values
    kinds = dict(points.dtypes)
    rows = points.select(segment, frame, *axes, F.lit(None).cast("double").alias("_w")).dropna(subset=list(axes))
    if dwell is not None:
        rows = rows.unionByName(dwell.select(segment, frame, *axes, F.col(weight).cast("double").alias("_w")).dropna())

    def one(p):
        rate, reach_, k = shared.value, np.array(reach), np.array(stiffness)
        each = []
        for f, d in p.groupby(frame, sort=True):
            own = d["_w"].isna()
            each.append((f, d.loc[own, list(axes)].to_numpy(float), d.loc[~own, list(axes)].to_numpy(float), d.loc[~own, "_w"].to_numpy(float)))
        poses = []
        for _, x, q, w in each:
            starts = [np.zeros(6), *([moment_start(x, rate)] if len(x) else []), *poses[-1:]]
            poses.append(_climb(lambda v, x=x, q=q, w=w: likelihood(v, x, rate, q, w), max(starts, key=lambda v: likelihood(v, x, rate, q, w)), reach_))  # noqa: B023
        for _ in range(sweeps if len(each) > 1 else 0):
            for i, (_, x, q, w) in enumerate(each):
                near = np.mean([poses[j] for j in (i - 1, i + 1) if 0 <= j < len(each)], axis=0)
                poses[i] = _climb(lambda v, x=x, q=q, w=w, near=near: likelihood(v, x, rate, q, w) - float((k * (v - near) ** 2).sum()), poses[i], reach_ / 4)
        return pd.DataFrame({segment: [p[segment].iloc[0]] * len(each), frame: [f for f, *_ in each], "pvec": [v.tolist() for v in poses], "n": [len(x) for _, x, *_ in each]})

    return estimators.by_key(rows, [segment], [frame], one, f"`{segment}` {kinds[segment]}, `{frame}` {kinds[frame]}, pvec array<double>, n long", bound)


def bend(points: np.ndarray, template: np.ndarray, lattice: tuple[int, int, int], spring: float = 0.1, anchor: float = 0.01, steps: int = 200, rate: float = 0.5) -> np.ndarray:
    """Shifts of a lattice of control points (nx, ny, nz, 3) that bring points to where the template is bright.

    Ascends the mean log rate; springs pull a control point to the mean of its neighbours and an anchor to rest, and none moves over 0.4 of
    the lattice's step.  Between control points shifts are trilinear.
    """
    log = np.log(np.maximum(template, max(template.max(), 1e-300) * 1e-3))
    slopes = np.gradient(log)
    size = np.array(template.shape) - 1
    u = np.clip(points / np.maximum(size, 1), 0, 1) * (np.array(lattice) - 1)
    low = np.minimum(u.astype(int), np.maximum(np.array(lattice) - 2, 0))
    part = u - low
    corner, weight = [], []
    for c in np.ndindex(2, 2, 2):
        i = np.minimum(low + c, np.array(lattice) - 1)
        corner.append(np.ravel_multi_index(i.T, lattice))
        weight.append(np.prod(np.where(c, part, 1 - part), 1))
    corner, weight = np.array(corner), np.array(weight)
    ctrl = np.zeros((math.prod(lattice), 3))
    limit = 0.4 * size / np.maximum(np.array(lattice) - 1, 1)
    mass = np.maximum(np.bincount(corner.ravel(), weight.ravel(), len(ctrl)), 1e-9)[:, None]
    for _ in range(steps):
        moved = points + (ctrl[corner] * weight[..., None]).sum(0)
        g = np.stack([fits.trilinear(s, moved) for s in slopes], 1)
        pull = np.stack([np.bincount(corner.ravel(), (weight * g[:, k]).ravel(), len(ctrl)) for k in range(3)], 1) / mass
        grid = ctrl.reshape(*lattice, 3)
        mean, n = np.zeros_like(grid), np.zeros((*lattice, 1))
        for axis in range(3):
            for a, b in ((slice(1, None), slice(None, -1)), (slice(None, -1), slice(1, None))):
                to, of = [slice(None)] * 3, [slice(None)] * 3
                to[axis], of[axis] = a, b
                mean[tuple(to)] += grid[tuple(of)]
                n[tuple(to)] += 1
        rest = (mean / np.maximum(n, 1) - grid).reshape(-1, 3)
        ctrl = np.clip(ctrl + rate * (pull + spring * rest - anchor * ctrl), -limit, limit)
    return ctrl.reshape(*lattice, 3)


def bent_frames(points: DataFrame, frame: str, axes: tuple[str, str, str], template: np.ndarray, lattice: tuple[int, int, int] = (4, 4, 3), bound: int = 5_000_000, **how) -> DataFrame:
    """A row for each frame and control point: frame, i, j, k and its shift dx, dy, dz; frames run side by side."""
    if template.size > fits.MOST:
        raise ValueError(f"a template of {template.size} values; {fits.MOST} at most")
    shared = points.sparkSession.sparkContext.broadcast(template)  # at most MOST values
    some = points.select(frame, *axes).dropna()

    def one(p):
        c = bend(p[list(axes)].to_numpy(float), shared.value, lattice, **how)
        i, j, k = (x.ravel() for x in np.indices(lattice))
        return pd.DataFrame({frame: [p[frame].iloc[0]] * len(i), "i": i, "j": j, "k": k, "dx": c[..., 0].ravel(), "dy": c[..., 1].ravel(), "dz": c[..., 2].ravel()})

    return estimators.by_key(some, [frame], list(axes), one, f"`{frame}` {dict(points.dtypes)[frame]}, i long, j long, k long, dx double, dy double, dz double", bound)


def groups_of_equal_count(points: DataFrame, keys: list[str], order: list[str], n: int, out: str = "part") -> DataFrame:
    """points in n parts of each key, of equal numbers in order, the first ones longer by one where they cannot be."""
    return points.withColumn(out, F.ntile(n).over(Window.partitionBy(*keys).orderBy(*order)))


def scan_boxes(points: DataFrame, frame: str, axis: str, out: tuple[str, str, str] = ("low", "middle", "high")) -> DataFrame:
    """Of each frame the 1st, 50th and 99th percentile on an axis, and the box of all frames (`all_low`, `all_high`)."""
    from . import stats

    boxes = None
    for p, name in zip((0.01, 0.5, 0.99), out, strict=True):
        one = stats.hazen(points, [frame], axis, p, name)
        boxes = one if boxes is None else boxes.join(one, frame)
    whole = boxes.agg(F.min(out[0]).alias("all_low"), F.max(out[2]).alias("all_high"))
    return boxes.crossJoin(F.broadcast(whole))  # one row


def smoothed_offset(track: DataFrame, keys: list[str], t: str, axes: list[str], sigma: float = 3.0, amplitude: float | None = None) -> DataFrame:
    """A tracked spot's low-passed places, z over the lens's amplitude if one is given: knots for `acquisition.offset_removed`."""
    out = track
    for a in axes:
        out = series.filtered(out, keys, [t], a, temporal.gauss_kernel(sigma), f"_{a}").withColumn(a, F.col(f"_{a}") / (amplitude if a == "z" and amplitude else 1.0)).drop(f"_{a}")
    return out
