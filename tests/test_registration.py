"""Registration: slopes against differences, and a drifting recording tracked over its segments' borders."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import fits, nonrigid, registration

AXES = ("x", "y", "z")


def bright(shape=(24, 20, 7)):
    x, y, z = np.indices(shape).astype(float)
    spots = [(7, 7, 3, 3), (17, 6, 4, 1), (8, 14, 2, 2), (18, 13, 3, 0.5)]
    return sum(h * np.exp(-((x - a) ** 2 + (y - b) ** 2) / 4 - (z - c) ** 2 / 3) for a, b, c, h in spots) + 2e-3


def seen(rng, rate, pose, n):
    """Points that the pose brings to the template."""
    at = np.stack(np.unravel_index(rng.choice(rate.size, n, p=rate.ravel() / rate.sum()), rate.shape), 1) + rng.uniform(-0.5, 0.5, (n, 3))
    m, _ = registration.turning(pose)
    return (at - pose[3:]) @ m


def test_slopes_and_turnings():
    rng = np.random.default_rng(0)
    pose = np.array([0.4, 0.05, -0.1, 1.0, -0.5, 0.3])
    p = rng.uniform([2, 2, 1], [20, 16, 5], (60, 3))
    assert np.allclose(p @ registration.turning(pose)[0].T + pose[3:], fits.turned(p, pose))
    q, v, rate = rng.uniform([2, 2, 1], [20, 16, 5], (9, 3)), rng.uniform(0, 2, 9), nonrigid.floored(bright())
    f = lambda x: registration.likelihood(x, p, q, v, rate)
    want = [(f(pose + 1e-6 * e)[0] - f(pose - 1e-6 * e)[0]) / 2e-6 for e in np.eye(6)]
    assert np.allclose(f(pose)[1], want, atol=1e-4)


def recording(spark, rng, frames, skip=()):
    rate = bright()
    poses = {k: np.array([2.9 + 0.12 * k, 0, 0, 10 + 2 * math.sin(k / 5), 9 + 2 * math.cos(k / 7), 0.0]) for k in range(frames)}
    for k in poses:  # turned about the template's middle
        m, _ = registration.turning(poses[k])
        poses[k][3:] = np.array([12 + 2 * math.sin(k / 5), 10 + 2 * math.cos(k / 7), 3.0]) - m @ np.array([12, 10, 3.0])
    rows = [(k, *map(float, r)) for k, pose in poses.items() if k not in skip for r in seen(rng, rate, pose, 220)]
    return rate, poses, spark.createDataFrame([*rows, (3, None, 1.0, 1.0)], "frame long, x double, y double, z double").repartition(4)


def off(got: pd.DataFrame, poses) -> np.ndarray:
    """How far each frame's pose puts the template's corners from where the true one does."""
    corner = np.array([[6, 6, 3], [18, 6, 3], [6, 14, 3], [18, 14, 3.0]])
    out = []
    for r in got.itertuples():
        m, _ = registration.turning(poses[r.frame])
        there = (corner - poses[r.frame][3:]) @ m
        out.append(np.abs(fits.turned(there, np.array(r.pvec)) - corner)[:, :2].max())
    return np.array(out)


def test_a_drifting_recording_is_tracked_over_borders(spark):
    rng = np.random.default_rng(1)
    rate, poses, points = recording(spark, rng, 40, skip=(17,))
    got, border = registration.stitched(points, "frame", AXES, rate, width=14, half=4, stiffness=(0.5, 5, 5, 0.05, 0.05, 0.05))
    got = got.toPandas().sort_values("frame")
    assert got.frame.tolist() == [k for k in range(40) if k != 17]
    assert off(got, poses).max() < 1.5
    angle = np.array([p[0] for p in got.pvec])
    true = np.array([poses[k][0] for k in got.frame])
    assert np.abs(np.diff(angle)).max() < 0.6  # no whole turn between neighbours, over two borders and past pi
    assert np.abs((angle - angle[0]) - (true - true[0])).max() < 0.3
    b = border.toPandas()
    assert len(b) == 2 and (b.frames >= 7).all() and (b.turn < 0.2).all() and (b["shift"] < 2).all()
    again = registration.in_chunks(points, "frame", AXES, rate, spark.createDataFrame(got[["frame", "pvec"]]), size=8, stiffness=(0.5, 5, 5, 0.05, 0.05, 0.05)).toPandas().sort_values("frame")
    assert again.frame.tolist() == got.frame.tolist() and off(again, poses).max() < 1.5


def test_single_frames_are_found_near_their_pose_with_dwell(spark):
    rng = np.random.default_rng(2)
    rate, poses, points = recording(spark, rng, 3)
    start = spark.createDataFrame([(k, [float(v) for v in p + np.array([0.1, 0, 0, 0.8, -0.8, 0])]) for k, p in poses.items()], "frame long, pvec array<double>")
    grid = np.stack(np.meshgrid(*(np.arange(0, n, 3) for n in rate.shape), indexing="ij"), -1).reshape(-1, 3)
    dwell = [(k, *map(float, (g - p[3:]) @ registration.turning(p)[0]), 3.0) for k, p in poses.items() for g in grid]
    got = registration.frames_near(points, "frame", AXES, rate, start, spark.createDataFrame(dwell, "frame long, x double, y double, z double, dwell double")).toPandas()
    assert sorted(got.frame) == [0, 1, 2] and off(got, poses).max() < 0.8 and got.n.tolist() == [220] * 3
    assert registration.frames_near(points.limit(0), "frame", AXES, rate, start.limit(0)).count() == 0


def test_turns():
    assert registration.near_turn(0.1, 6.4) == pytest.approx(0.1 + 2 * math.pi) and registration.near_turn(0.1, 0.2) == pytest.approx(0.1)


def test_equal_points_of_a_frame_are_one_row_of_the_bound(spark):
    rng = np.random.default_rng(3)
    rate = nonrigid.floored(bright())
    pose, p, many = np.array([0.2, 0.02, -0.03, 0.5, -0.5, 0.2]), rng.uniform([2, 2, 1], [20, 16, 5], (40, 3)), rng.integers(1, 9, 40)
    q, v = rng.uniform([2, 2, 1], [20, 16, 5], (9, 3)), rng.uniform(0, 2, 9)
    each, counted = registration.likelihood(pose, np.repeat(p, many, 0), q, v, rate), registration.likelihood(pose, p, q, v, rate, many.astype(float))
    assert each[0] == pytest.approx(counted[0]) and np.allclose(each[1], counted[1])
    # voxels, so that places repeat: four times the points are as many places, poses and fits, and four times n
    at = pd.DataFrame(np.stack(np.unravel_index(rng.choice(rate.size, 1200, p=rate.ravel() / rate.sum()), rate.shape), 1), columns=AXES)
    at["frame"] = np.arange(1200) // 200
    points = spark.createDataFrame(at)
    dwell = spark.createDataFrame([(k, 5.0, 5.0, 2.0, 0.5) for k in range(6) for _ in range(2)], "frame long, x double, y double, z double, dwell double")
    four = points.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(4))))
    bound = len(at.drop_duplicates()) + 6 + 8  # 8: rows of poses around the border
    told = lambda rows, **more: registration.segments(rows, "frame", AXES, bright(), dwell, width=3, half=1, **more).orderBy("segment", "frame").toPandas()
    once = told(points)
    assert once.n.tolist() == [200] * 8
    again, _ = registration.stitched(four, "frame", AXES, bright(), width=3, half=1, bound=bound)
    assert again.agg(F.sum("n")).first()[0] == 4800 and again.count() == 6
    # without dwell the objective is a mean over points
    free = lambda rows: registration.segments(rows, "frame", AXES, bright(), width=3, half=1, bound=bound).orderBy("segment", "frame").toPandas()
    one, more = free(points), free(four)
    assert np.allclose(np.stack(one.pvec), np.stack(more.pvec), atol=1e-3) and np.allclose(one.fit, more.fit, atol=1e-5) and (more.n == 4 * one.n).all()
