"""Fits: intensity correction by aggregates, and per-key estimators of series and frames in numpy.

The per-key functions take one group into a task (a spot's bins, a frame's points, a stride), as the method needs its
order or all of its points; a group must fit a task.  What is common to all keys (a template) goes to every task, so it
is checked against MOST.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 1 << 22  # values of a template


def intensity_correction(voxels: DataFrame, counts: str, exposure: Column, basis: list[Column], ridge: float = 1e-6, steps: int = 100, tolerance: float = 1e-8) -> np.ndarray:
    """Coefficients of log intensity on a basis: counts are Poisson with mean exposure * exp(sum of basis * coefficient).

    Newton's method; every step is one aggregation to p + p(p+1)/2 sums.  Rows with null or without exposure are left
    out; with none left all coefficients are 0.
    """
    p = len(basis)
    rows = voxels.select(F.col(counts).cast("double").alias("y"), exposure.cast("double").alias("e"), *[b.cast("double").alias(f"b{i}") for i, b in enumerate(basis)]).dropna().where("e > 0")
    b = [F.col(f"b{i}") for i in range(p)]
    beta = np.zeros(p)
    for _ in range(steps):
        eta = sum((b[i] * float(beta[i]) for i in range(p)), F.lit(0.0))
        mean = F.col("e") * F.exp(eta)
        sums = [F.sum((F.col("y") - mean) * b[i]) for i in range(p)] + [F.sum(mean * b[i] * b[j]) for i in range(p) for j in range(i, p)]
        got = rows.agg(*[s.alias(f"s{k}") for k, s in enumerate(sums)]).first()
        if got[0] is None:
            return beta
        slope, curve = np.array(got[:p]) - ridge * beta, np.zeros((p, p))
        curve[np.triu_indices(p)] = got[p:]
        curve = curve + np.triu(curve, 1).T + ridge * np.eye(p)
        step = np.linalg.solve(curve, slope)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-300))
        beta = beta + step
        if np.abs(step).max() < tolerance:
            break
    return beta


def analytic_phase(x: np.ndarray) -> np.ndarray:
    """Phase of the analytic signal of a series about its mean."""
    n = len(x)
    if n == 0:
        return np.zeros(0)
    keep = np.zeros(n)
    keep[0] = 1
    keep[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        keep[n // 2] = 1
    return np.angle(np.fft.ifft(np.fft.fft(x - x.mean()) * keep))


def strides(series: DataFrame, keys: list[str], t: str, value: str) -> DataFrame:
    """keys, t, value, `phase` and `stride`: a stride starts where the analytic phase falls from pi to -pi; 0 before the first.

    Rows with null are left out; a series of under 4 rows is one stride of phase 0.
    """

    def told(d: pd.DataFrame) -> pd.DataFrame:
        d = d.dropna(subset=[t, value]).sort_values(t, kind="stable")
        phase = analytic_phase(d[value].to_numpy(float)) if len(d) >= 4 else np.zeros(len(d))
        falls = np.concatenate([[0], np.diff(phase) < -np.pi]) if len(d) else np.zeros(0)
        return d.assign(phase=phase, stride=np.cumsum(falls).astype(np.int64))

    some = series.select(*keys, t, F.col(value).cast("double").alias(value))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in some.schema.fields)
    return some.groupBy(*keys).applyInPandas(told, f"{ddl}, phase double, stride long")


def merge_short(lengths: np.ndarray, share: float = 0.5) -> np.ndarray:
    """New stride numbers: one under `share` of the others' mean length joins its shorter neighbour."""
    label, lengths = np.arange(len(lengths)), np.array(lengths, float)
    alive = list(range(len(lengths)))
    while len(alive) > 1:
        size = lengths[alive]
        others = (size.sum() - size) / (len(size) - 1)
        short = np.flatnonzero(size < share * others)
        if not len(short):
            break
        k = int(short[np.argmin(size[short])])
        beside = [j for j in (k - 1, k + 1) if 0 <= j < len(alive)]
        into = min(beside, key=lambda j: size[j])
        lengths[alive[into]] += lengths[alive[k]]
        label[label == label[alive[k]]] = label[alive[into]]
        del alive[k]
    return np.unique(label, return_inverse=True)[1] if len(label) else label


def smoothing_spline(t: np.ndarray, x: np.ndarray, p: float) -> np.ndarray:
    """Values at t of the natural cubic spline that minimises p * squared errors + (1 - p) * integral of squared curvature."""
    n = len(t)
    if n < 3 or p >= 1:
        return np.array(x, float)
    h = np.diff(t).astype(float)
    band = np.zeros((n - 2, 5))  # of R * p + (1 - p) * Q'Q, by diagonal -2 .. 2
    q = np.stack([1 / h[:-1], -1 / h[:-1] - 1 / h[1:], 1 / h[1:]], 1)
    for k in range(-2, 3):
        for a in range(3):
            b = a - k
            if 0 <= b < 3:
                i = np.arange(max(0, -k), n - 2 - max(0, k))
                band[i, k + 2] += 6 * (1 - p) * q[i, a] * q[i + k, b]
    band[:, 2] += 2 * p * (h[:-1] + h[1:])
    band[:-1, 3] += p * h[1:-1]
    band[1:, 1] += p * h[1:-1]
    u = _banded(band, q[:, 0] * x[:-2] + q[:, 1] * x[1:-1] + q[:, 2] * x[2:])
    out = np.array(x, float)
    for a in range(3):
        out[a : n - 2 + a] -= 6 * (1 - p) * q[:, a] * u
    return out


def _banded(band: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solves a positive definite system of five diagonals without pivoting, in one pass down and one up."""
    band, b, n = band.copy(), b.copy(), len(b)
    for i in range(n):
        for d in (1, 2):
            if i + d < n:
                f = band[i + d, 2 - d] / band[i, 2]
                band[i + d, 2 - d : 5 - d] -= f * band[i, 2:5]
                b[i + d] -= f * b[i]
    for i in range(n - 1, -1, -1):
        for d in (1, 2):
            if i + d < n:
                b[i] -= band[i, 2 + d] * b[i + d]
        b[i] /= band[i, 2]
    return b


def rate_smoother(counts: np.ndarray, dwell: np.ndarray, drift: float, start: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Log rate of Poisson counts with a random walk of variance `drift` a bin, and its deviation: filter, then backwards.

    Each bin's update is Newton's, from the prediction; bins without dwell or with null counts only predict.
    """
    n = len(counts)
    good = np.isfinite(counts) & (dwell > 0)
    total = dwell[good].sum() if good.any() else 1.0
    m = np.log(max(counts[good].sum(), 0.5) / total) if start is None else start
    v, ms, vs, pv = 1.0, np.zeros(n), np.zeros(n), np.zeros(n)
    for k in range(n):
        v += drift if k else 0.0
        pv[k], prior = v, m
        if good[k]:
            for _ in range(20):
                mean = dwell[k] * np.exp(m)
                step = (counts[k] - mean - (m - prior) / v) / (mean + 1 / v)
                m += np.clip(step, -2, 2)
                if abs(step) < 1e-10:
                    break
            v = 1 / (dwell[k] * np.exp(m) + 1 / v)
        ms[k], vs[k] = m, v
    for k in range(n - 2, -1, -1):
        gain = vs[k] / pv[k + 1]
        ms[k] += gain * (ms[k + 1] - ms[k])
        vs[k] += gain**2 * (vs[k + 1] - pv[k + 1])
    return ms, np.sqrt(vs)


def two_rates(bins: DataFrame, keys: list[str], t: str, red: str, green: str, dwell: str, drift: float = 1e-3) -> DataFrame:
    """By key in order of t: log rates of two colours, the log ratio green over red, and its deviation."""

    def told(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values(t, kind="stable")
        time = d[dwell].fillna(0).to_numpy(float)
        (r, dr), (g, dg) = (rate_smoother(d[c].to_numpy(float), time, drift) for c in (red, green))
        return d[[*keys, t]].assign(log_red=r, log_green=g, log_ratio=g - r, deviation=np.hypot(dr, dg))

    some = bins.select(*keys, t, *[F.col(c).cast("double").alias(c) for c in (red, green, dwell)])
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in some.select(*keys, t).schema.fields)
    return some.groupBy(*keys).applyInPandas(told, f"{ddl}, log_red double, log_green double, log_ratio double, deviation double")


def trilinear(volume: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Values at points in voxel units, held at the edges."""
    low, f = [], []
    for a in range(3):
        x = np.clip(at[:, a], 0, volume.shape[a] - 1)
        i = np.minimum(np.floor(x).astype(int), max(volume.shape[a] - 2, 0))
        low.append(i)
        f.append(x - i)
    out = np.zeros(len(at))
    for k in range(8):
        d = [(k >> a) & 1 for a in range(3)]
        w = np.prod([f[a] if d[a] else 1 - f[a] for a in range(3)], axis=0)
        out += w * volume[tuple(np.minimum(low[a] + d[a], volume.shape[a] - 1) for a in range(3))]
    return out


def turned(points: np.ndarray, pose: np.ndarray) -> np.ndarray:
    """Points turned about z, then x, then y by the pose's first, third and second angle, then shifted."""
    (cz, sz), (cy, sy), (cx, sx) = ((np.cos(a), np.sin(a)) for a in pose[:3])
    rz, rx = np.array([[cz, -sz, 0], [sz, cz, 0], [0, 0, 1]]), np.array([[1, 0, 0], [0, cx, -sx], [0, sx, cx]])
    ry = np.array([[cy, 0, sy], [0, 1, 0], [-sy, 0, cy]])
    return points @ (ry @ rx @ rz).T + pose[3:]


def rigid_pose(points: np.ndarray, template: np.ndarray, start: np.ndarray, reach: np.ndarray, least: float = 1e-3) -> np.ndarray:
    """The pose near `start` under which the points' mean log rate in the template is largest.

    A pattern search: each parameter is tried a step either way, and steps are halved from `reach` until all are under
    `least` of it.  Rates are floored at a thousandth of the largest.
    """
    log = np.log(np.maximum(template, max(template.max(), 1e-300) * 1e-3))
    score = lambda p: trilinear(log, turned(points, p)).mean()
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


def frame_poses(points: DataFrame, frame: str, axes: tuple[str, str, str], template: np.ndarray, reach: tuple = (0.2, 0.2, 0.2, 2.0, 2.0, 2.0)) -> DataFrame:
    """Pose (three angles, three shifts in voxels) and number of points of each frame, against a template.

    Rows with a null coordinate are left out; a frame without points has no row.
    """
    if template.size > MOST:
        raise ValueError(f"a template of {template.size} values; {MOST} at most")
    spark = points.sparkSession
    shared = spark.sparkContext.broadcast(template)  # at most MOST values

    def told(d: pd.DataFrame) -> pd.DataFrame:
        pose = rigid_pose(d[list(axes)].to_numpy(float), shared.value, np.zeros(6), np.array(reach))
        return pd.DataFrame({frame: [d[frame].iloc[0]], "pvec": [pose.tolist()], "n": [len(d)]})

    some = points.select(frame, *axes).dropna()
    return some.groupBy(frame).applyInPandas(told, f"`{frame}` {some.schema[frame].dataType.simpleString()}, pvec array<double>, n long")
