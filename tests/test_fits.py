import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lumenframe.operators import fits, volumes


def test_intensity_correction_finds_the_planted_surface(spark):
    rng = np.random.default_rng(1)
    x, y, e = rng.uniform(-1, 1, 4000), rng.uniform(-1, 1, 4000), rng.uniform(5, 20, 4000)
    n = rng.poisson(e * np.exp(0.4 + 0.8 * x - 0.5 * y))
    d = spark.createDataFrame(pd.DataFrame({"n": n, "e": e, "x": x, "y": y}))
    got = fits.intensity_correction(d, "n", F.col("e"), [F.lit(1.0), F.col("x"), F.col("y")])
    assert np.abs(got - [0.4, 0.8, -0.5]).max() < 0.03
    assert (fits.intensity_correction(d.where("e < 0"), "n", F.col("e"), [F.lit(1.0)]) == 0).all()


def test_strides_of_a_sine_are_its_periods(spark):
    k = np.arange(1000)
    d = spark.createDataFrame(pd.DataFrame({"s": 1, "k": k, "v": np.cos(2 * np.pi * (k + 0.3) / 50)}))
    got = fits.strides(d, ["s"], "k", "v").toPandas().sort_values("k")
    assert got["stride"].max() == 20
    assert set(np.diff(np.flatnonzero(np.diff(got["stride"])))) == {50}
    few = spark.createDataFrame([(1, 1, 2.0), (1, 2, None), (2, 1, None)], "s int, k int, v double")
    assert [tuple(r) for r in fits.strides(few, ["s"], "k", "v").collect()] == [(1, 1, 2.0, 0.0, 0)]


def test_short_strides_join_a_neighbour():
    assert fits.merge_short(np.array([10, 2, 9, 10])).tolist() == [0, 1, 1, 2]
    assert fits.merge_short(np.array([5.0])).tolist() == [0] and len(fits.merge_short(np.array([]))) == 0


def test_smoothing_spline_solves_its_normal_equations():
    rng = np.random.default_rng(2)
    t, p, n = np.cumsum(rng.uniform(0.5, 2, 30)), 0.7, 30
    x, h = np.sin(t) + rng.normal(0, 0.3, n), np.diff(t)
    q, r = np.zeros((n, n - 2)), np.zeros((n - 2, n - 2))
    for i in range(n - 2):
        q[i : i + 3, i] = [1 / h[i], -1 / h[i] - 1 / h[i + 1], 1 / h[i + 1]]
        r[i, i] = (h[i] + h[i + 1]) / 3
        if i < n - 3:
            r[i, i + 1] = r[i + 1, i] = h[i + 1] / 6
    want = np.linalg.solve(p * np.eye(n) + (1 - p) * q @ np.linalg.inv(r) @ q.T, p * x)
    assert np.abs(fits.smoothing_spline(t, x, p) - want).max() < 1e-9
    assert np.abs(fits.smoothing_spline(t, 3 * t + 1, 0.5) - (3 * t + 1)).max() < 1e-9


def test_two_rates_follow_the_planted_ratio(spark):
    rng = np.random.default_rng(3)
    k = np.arange(600)
    ratio = 0.5 * np.sin(k / 60)
    d = pd.DataFrame({"s": 1, "k": k, "r": rng.poisson(40, 600), "g": rng.poisson(40 * np.exp(ratio)), "w": 1.0})
    got = fits.two_rates(spark.createDataFrame(d), ["s"], "k", "r", "g", "w", 3e-4).toPandas().sort_values("k")
    off = got["log_ratio"].to_numpy() - ratio
    assert np.sqrt((off**2).mean()) < 0.08 and np.abs(off / got["deviation"]).mean() < 1.5


def test_frame_pose_takes_points_back(spark):
    rng = np.random.default_rng(4)
    spots = np.array([[6, 6, 5], [13, 8, 7], [9, 14, 4]], float)
    g = np.stack(np.meshgrid(*[np.arange(s) for s in (20, 20, 12)], indexing="ij"), -1)
    template = sum(np.exp(-((g - s) ** 2).sum(-1) / 4) for s in spots)
    pose = np.array([0.05, 0, 0, 1.0, -0.7, 0.4])
    seen = np.concatenate([rng.normal(s, 1.0, (400, 3)) for s in spots])
    moved = (seen - pose[3:]) @ np.linalg.inv(fits.turned(np.eye(3), np.r_[pose[:3], 0, 0, 0]).T)
    d = spark.createDataFrame(pd.DataFrame({"f": 7, "x": moved[:, 0], "y": moved[:, 1], "z": moved[:, 2]}))
    [row] = fits.frame_poses(d, "f", ("x", "y", "z"), template).collect()
    back = fits.turned(moved, np.array(row["pvec"]))
    assert row["n"] == 1200 and np.abs(back - seen).mean() < 0.25
    assert fits.frame_poses(d.where("f = 8"), "f", ("x", "y", "z"), template).count() == 0


def test_spline_field_keeps_equal_points_and_constants(spark):
    lattice = spark.createDataFrame([(i, j, 2.0, float(i)) for i in range(5) for j in range(4)], "i_x long, i_y long, u double, v double")
    points = spark.createDataFrame([(2.0, 1.0), (2.0, 1.0), (1.5, 2.2), (None, 1.0)], "x double, y double")
    got = sorted((tuple(r) for r in volumes.spline_field(points, lattice, {"x": (0, 1, 5), "y": (0, 1, 4)}, ["u", "v"]).collect()), key=str)
    assert len(got) == 4 and sum(r[2] is None for r in got) == 1
    assert all(abs(r[2] - 2) < 1e-12 and abs(r[3] - r[0]) < 1e-12 for r in got if r[0] is not None and r[0] == 2.0)


def test_erode_and_open_of_an_empty_mask(spark):
    none = spark.createDataFrame([], "ix long, iy long")
    one = spark.createDataFrame([(3, 3)], "ix long, iy long")
    assert volumes.closed(none, ["ix", "iy"]).count() == 0 and volumes.opened(one, ["ix", "iy"]).count() == 0
    assert [tuple(r) for r in volumes.closed(one, ["ix", "iy"]).collect()] == [(3, 3)]
