"""Registration of a recording's frames to a template, from nothing: segments, their overlaps, one chain.

1. Frames are cut into segments that overlap.  Each is one task: the first frames' turn is looked for all around, every frame starts from the
   pose before it, and all frames' poses are then fitted together, tied to their neighbours (`linked`).
2. Neighbouring segments hold the frames around their border twice.  Their turns there differ by whole turns, which a running
   sum over segments (one row each) takes off, so that angles run on; where they differ by more than `apart` the overlap says so.
3. The frames around each border, one task each, are fitted again from what both segments say, better ones first, tied to the
   poses of the frames just outside, which stay.
Then frames may be refined in chunks tied to the pose before (`in_chunks`), or one by one from their own pose (`frames_near`).

A pose is three angles about z, y and x, as `fits.turned` applies them, then three shifts in voxels.  The objective is the Poisson log likelihood per point,
less what the template expects where the scan dwelt; its slope is analytic.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import kept
from . import descent, estimators, fits, nonrigid

TURNS = 24  # starts of the first frame's turn
FREE = (math.pi, 0.35, 0.35, 15.0, 15.0, 15.0)  # how far poses may be from their start


def turning(pose: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The matrix of a pose's angles and its derivatives by each: about z first, then x, then y."""
    (cz, sz), (cy, sy), (cx, sx) = ((math.cos(a), math.sin(a)) for a in pose[:3])
    rz, dz = np.array([[cz, -sz, 0], [sz, cz, 0], [0, 0, 1]]), np.array([[-sz, -cz, 0], [cz, -sz, 0], [0, 0, 0]])
    ry, dy = np.array([[cy, 0, sy], [0, 1, 0], [-sy, 0, cy]]), np.array([[-sy, 0, cy], [0, 0, 0], [-cy, 0, -sy]])
    rx, dx = np.array([[1, 0, 0], [0, cx, -sx], [0, sx, cx]]), np.array([[0, 0, 0], [0, -sx, -cx], [0, cx, -sx]])
    return ry @ rx @ rz, [ry @ rx @ dz, dy @ rx @ rz, ry @ dx @ rz]


def likelihood(pose: np.ndarray, points: np.ndarray, dwell_at: np.ndarray, dwell: np.ndarray, rate: np.ndarray, count: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """Log likelihood per point of points under a pose, and its slope; 0 without points.  count: how many points each row stands for, or None for one."""
    if not len(points):
        return 0.0, np.zeros(6)
    m, parts = turning(pose)
    count = np.ones(len(points)) if count is None else count
    value, slope = nonrigid.trilinear_slopes(rate, points @ m.T + pose[3:])
    total, pull = float((count * np.log(value)).sum()), slope * (count / value)[:, None]
    g = np.array([*(((points @ d.T) * pull).sum() for d in parts), *pull.sum(0)])
    if len(dwell):
        value, slope = nonrigid.trilinear_slopes(rate, dwell_at @ m.T + pose[3:])
        total -= float((dwell * value).sum())
        pull = slope * dwell[:, None]
        g -= np.array([*(((dwell_at @ d.T) * pull).sum() for d in parts), *pull.sum(0)])
    return total / count.sum(), g / count.sum()


def _under(pose: np.ndarray, frame: tuple, rate: np.ndarray) -> tuple[float, np.ndarray]:
    return likelihood(pose, *frame[:3], rate, *frame[3:])


def single(start: np.ndarray, frame: tuple, rate: np.ndarray, free=FREE, steps: int = 40) -> tuple[np.ndarray, float]:
    """The best pose within `free` of a start, and its log likelihood per point; frame: points, places of dwell, dwell and, if points are counted, their counts."""

    def f(x):
        v, g = _under(x, frame, rate)
        return -v, -g

    pose, value = descent.minimised(f, start, start - np.array(free), start + np.array(free), steps)
    return pose, -value


def all_around(frame: tuple, rate: np.ndarray, turns: int = TURNS) -> np.ndarray:
    """The best pose of a frame whose turn about z is not known: from starts all around, each with the shift that brings its middle to the template's."""
    at = np.stack(np.meshgrid(*map(np.arange, rate.shape), indexing="ij"), -1).reshape(-1, 3)
    w = rate.ravel() - rate.min()
    middle, own = (w @ at) / max(w.sum(), 1e-300), np.average(frame[0], 0, *frame[3:])
    tried = []
    for k in range(turns):
        pose = np.array([2 * math.pi * k / turns, 0, 0, 0, 0, 0.0])
        pose[3:] = middle - fits.turned(own[None], pose)[0]
        tried.append(single(pose, frame, rate, (math.pi / turns, 0.0, 0.0, 6.0, 6.0, 4.0), 12))
    return max(tried, key=lambda x: x[1])[0]


def linked(frames: list[tuple], starts: np.ndarray, rate: np.ndarray, stiffness: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None, free=FREE, steps: int = 40) -> np.ndarray:
    """Poses of frames in order that together have the greatest sum of log likelihoods per point, less stiffness times the squared
    differences of neighbours; before and after: poses that stay, of the frames beside the first and the last.
    """
    n = len(frames)

    def f(x):
        p = x.reshape(n, 6)
        each = [_under(a, frame, rate) for a, frame in zip(p, frames, strict=True)]
        value, slope = -sum(v for v, _ in each), -np.stack([g for _, g in each])
        d = np.diff(p, axis=0)
        value += float((stiffness * d * d).sum())
        slope[1:] += 2 * stiffness * d
        slope[:-1] -= 2 * stiffness * d
        for end, pose in ((0, before), (-1, after)):
            if pose is not None:
                e = p[end] - pose
                value += float((stiffness * e * e).sum())
                slope[end] += 2 * stiffness * e
        return value, slope.ravel()

    wide = np.tile(free, n)
    return descent.minimised(f, starts.ravel(), starts.ravel() - wide, starts.ravel() + wide, steps)[0].reshape(n, 6)


def near_turn(angle, other):
    """The angle, whole turns added, nearest another."""
    return angle + 2 * np.pi * np.round((other - angle) / (2 * np.pi))


def in_order(frames: list[tuple], rate: np.ndarray, stiffness: np.ndarray) -> np.ndarray:
    """Poses of a segment about which nothing is known; frames without points have the pose before."""
    poses: list[np.ndarray] = []
    for frame in frames:
        if not len(frame[0]):
            poses.append(poses[-1] if poses else np.zeros(6))
        elif not poses:
            poses.append(all_around(frame, rate))
        else:
            poses.append(single(poses[-1], frame, rate, (0.6, 0.2, 0.2, 5.0, 5.0, 3.0))[0])
    return linked(frames, np.array(poses), rate, stiffness)


# ---------------------------------------------------------------- tables


def _rows(points: DataFrame, frame: str, axes, dwell: DataFrame | None, dwelt: str) -> DataFrame:
    """Places of each frame with `_n`, their points, or `_v`, their dwell: equal places of a frame are one row, since the objective is a sum over them."""
    at = [F.col(frame).cast("long").alias("frame"), *(F.col(a).cast("double").alias(a) for a in axes)]
    places = lambda rows: rows.dropna(subset=["frame", *axes]).groupBy("frame", *axes)
    rows = places(points.select(*at)).agg(F.count("*").alias("_n"), F.lit(None).cast("double").alias("_v"))
    if dwell is not None:
        dwells = places(dwell.select(*at, F.col(dwelt).cast("double").alias("_v")).where("_v > 0"))
        rows = rows.unionByName(dwells.agg(F.lit(None).cast("long").alias("_n"), F.sum("_v").alias("_v")))
    return rows


def _frames(d: pd.DataFrame, axes, numbers) -> list[tuple]:
    by = dict(tuple(d.groupby("frame")))
    out = []
    for n in numbers:
        if n not in by:
            out.append((np.zeros((0, 3)), np.zeros((0, 3)), np.zeros(0), np.zeros(0)))
            continue
        own = by[n]["_v"].isna().to_numpy()
        at = by[n][list(axes)].to_numpy(float)
        out.append((at[own], at[~own], by[n]["_v"].to_numpy(float)[~own], by[n]["_n"].to_numpy(float)[own]))
    return out


def _shared(points: DataFrame, template: np.ndarray):
    if template.size > fits.MOST:
        raise ValueError(f"a template of {template.size} values; {fits.MOST} at most")
    return points.sparkSession.sparkContext.broadcast(nonrigid.floored(template))  # at most MOST values


def _told(numbers, poses, frames, rate, **more) -> pd.DataFrame:
    fit = [_under(p, f, rate)[0] if len(f[0]) else None for p, f in zip(poses, frames, strict=True)]
    return pd.DataFrame({**more, "frame": list(numbers), "pvec": [p.tolist() for p in poses], "fit": fit, "n": [int(f[3].sum()) for f in frames]})


_POSE = "frame long, pvec array<double>, fit double, n long"


def segments(points: DataFrame, frame: str, axes: tuple[str, str, str], template: np.ndarray, dwell: DataFrame | None = None, dwelt: str = "dwell", width: int = 300, half: int = 30, stiffness=(1.0,) * 6, bound: int = 5_000_000) -> DataFrame:
    """segment, frame, pvec, fit and n: poses of each segment's frames, `half` more on either side, fitted side by side."""
    shared, s = _shared(points, template), F.col("frame")
    rows = _rows(points, frame, axes, dwell, dwelt)
    rows = rows.withColumn("segment", F.explode(F.sequence(F.floor((s - half) / width), F.floor((s + half) / width))))

    def one(d: pd.DataFrame) -> pd.DataFrame:
        numbers = sorted(set(d["frame"]))
        if not any(n // width == d["segment"].iloc[0] for n in numbers):
            return pd.DataFrame(columns=["segment", "frame", "pvec", "fit", "n"])  # frames of the segment beside alone
        frames = _frames(d, axes, numbers)
        return _told(numbers, in_order(frames, shared.value, np.array(stiffness)), frames, shared.value, segment=int(d["segment"].iloc[0]))

    return estimators.by_key(rows, ["segment"], ["frame"], one, f"segment long, {_POSE}", bound)


def chained(each: DataFrame, width: int, half: int) -> tuple[DataFrame, DataFrame]:
    """frame, pvec and `other` (what the segment beside says, or null) with angles that run on over segments; and of each border its
    overlap: left, right, frames, `turns` between them and the mean differences `turn` and `shift`.

    Turns are added up over segments, of which there is one row each; segments without a neighbour begin anew.
    """
    a, b = (each.select(F.col("segment").alias(f"_{x}"), "frame", F.col("pvec").alias(f"p{x}")) for x in "ab")
    both = a.join(b, (a["frame"] == b["frame"]) & (F.col("_b") == F.col("_a") + 1)).select("_a", "_b", a["frame"], "pa", "pb")
    d = F.col("pa")[0] - F.col("pb")[0]
    whole = F.round(d / (2 * math.pi))
    apart = F.sqrt(sum(((F.col("pa")[i] - F.col("pb")[i]) ** 2 for i in (4, 5)), (F.col("pa")[3] - F.col("pb")[3]) ** 2))
    border = both.groupBy(F.col("_a").alias("left"), F.col("_b").alias("right")).agg(F.count("*").alias("frames"), F.expr("mode(round((pa[0] - pb[0]) / (2 * pi())))").alias("turns"), F.avg(F.abs(d - whole * 2 * math.pi)).alias("turn"), F.avg(apart).alias("shift"))
    some = each.select("segment").distinct().join(border.select(F.col("right").alias("segment"), "turns"), "segment", "left")
    w = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, 0)
    some = some.select("segment", F.sum(F.coalesce("turns", F.lit(0.0))).over(w).alias("_t"))  # one row a segment
    turned = each.join(F.broadcast(some), "segment").withColumn("pvec", F.concat(F.array(F.col("pvec")[0] + 2 * math.pi * F.col("_t")), F.slice("pvec", 2, 5)))
    home = F.floor(F.col("frame") / width) == F.col("segment")
    out = turned.groupBy("frame").agg(F.max(F.when(home, F.col("pvec"))).alias("pvec"), F.max(F.when(~home, F.col("pvec"))).alias("other"), F.max("n").alias("n"))
    return out.where("pvec is not null"), border


def stitched(points: DataFrame, frame: str, axes: tuple[str, str, str], template: np.ndarray, dwell: DataFrame | None = None, dwelt: str = "dwell", width: int = 300, half: int = 30, stiffness=(1.0,) * 6, bound: int = 5_000_000) -> tuple[DataFrame, DataFrame]:
    """frame, pvec, fit and n of all frames, and the overlaps of `chained`: segments, joined where they overlap.

    Frames are whole numbers; those without points have no row.  A segment, or the frames around a border, is one task of `bound` rows at most,
    where points of a frame at one place are one row.
    """
    shared = _shared(points, template)
    first, border = chained(kept(segments(points, frame, axes, template, dwell, dwelt, width, half, stiffness, bound)), width, half)
    first = kept(first)
    # frames within half of a border between two segments, and one more on either side that stays
    f = F.col("frame")
    edge = F.floor((f + half + 1) / width)
    at = first.select("*", edge.alias("border")).where((F.abs(f - edge * width) <= half + 1))
    rows = _rows(points, frame, axes, dwell, dwelt).withColumn("border", edge).where(F.abs(f - edge * width) <= half)
    both = rows.withColumns({"pvec": F.lit(None).cast("array<double>"), "other": F.lit(None).cast("array<double>")}).unionByName(at.select("border", "frame", "pvec", "other"), allowMissingColumns=True)

    def one(d: pd.DataFrame) -> pd.DataFrame:
        rate, k = shared.value, np.array(stiffness)
        known = d[d["pvec"].notna()].sort_values("frame")
        border = int(d["border"].iloc[0]) * width
        poses = {int(r.frame): np.array(r.pvec) for r in known.itertuples()}
        numbers = [n for n in poses if abs(n - border) <= half]
        if not numbers or not min(numbers) < border <= max(numbers):
            return pd.DataFrame(columns=["frame", "pvec", "fit", "n"])  # no border: one side has no frames
        frames = _frames(d[d["pvec"].isna()], axes, numbers)
        starts = []
        others = {int(r.frame): np.array(r.other) for r in known.itertuples() if r.other is not None}
        for n, frame_ in zip(numbers, frames, strict=True):
            tried = [x for x in (poses[n], others.get(n)) if x is not None]
            best = max(tried, key=lambda x: _under(x, frame_, rate)[0])  # noqa: B023
            starts.append(best)
        outside = [poses.get(min(numbers) - 1), poses.get(max(numbers) + 1)]
        for i in range(1, len(starts)):
            starts[i] = np.append(near_turn(starts[i][0], starts[i - 1][0]), starts[i][1:])
        if outside[0] is not None:
            gap = near_turn(starts[0][0], outside[0][0]) - starts[0][0]
            starts = [s + np.array([gap, 0, 0, 0, 0, 0]) for s in starts]
        return _told(numbers, linked(frames, np.array(starts), rate, k, *outside), frames, rate)

    again = estimators.by_key(both, ["border"], ["frame"], one, _POSE, bound)
    out = first.join(again.select("frame", F.col("pvec").alias("_p")), "frame", "left").select("frame", F.coalesce("_p", "pvec").alias("pvec"), "n")
    return out, border


def in_chunks(points: DataFrame, frame: str, axes: tuple[str, str, str], template: np.ndarray, poses: DataFrame, dwell: DataFrame | None = None, dwelt: str = "dwell", size: int = 20, stiffness=(1.0,) * 6, free=(0.26, 0.35, 0.35, 3.0, 3.0, 8.0), bound: int = 5_000_000) -> DataFrame:
    """frame, pvec, fit and n of frames refined in chunks near their poses, each tied to the pose of the frame before it, as given."""
    shared, s = _shared(points, template), F.col("frame")
    own = poses.select("frame", "pvec", F.floor(s / size).alias("chunk"))
    last = poses.where((s + 1) % size == 0).select("frame", "pvec", F.floor((s + 1) / size).alias("chunk"))
    rows = _rows(points, frame, axes, dwell, dwelt).withColumn("chunk", F.floor(s / size))
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [rows, own, last])

    def one(d: pd.DataFrame) -> pd.DataFrame:
        chunk = int(d["chunk"].iloc[0])
        known = {int(r.frame): np.array(r.pvec) for r in d[d["pvec"].notna()].itertuples()}
        numbers = sorted(n for n in known if n // size == chunk)
        if not numbers:
            return pd.DataFrame(columns=["frame", "pvec", "fit", "n"])
        frames = _frames(d[d["pvec"].isna()], axes, numbers)
        return _told(numbers, linked(frames, np.array([known[n] for n in numbers]), shared.value, np.array(stiffness), known.get(chunk * size - 1), None, free), frames, shared.value)

    return estimators.by_key(both, ["chunk"], ["frame"], one, _POSE, bound)


def frames_near(points: DataFrame, frame: str, axes: tuple[str, str, str], template: np.ndarray, poses: DataFrame, dwell: DataFrame | None = None, dwelt: str = "dwell", free=(0.26, 0.35, 0.35, 3.0, 3.0, 8.0), bound: int = 5_000_000) -> DataFrame:
    """frame, pvec, fit and n of each frame fitted alone near its pose."""
    return in_chunks(points, frame, axes, template, poses, dwell, dwelt, 1, (0.0,) * 6, free, bound)
