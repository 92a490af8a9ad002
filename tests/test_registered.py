import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import registered, volumes

POSES = "f string, az double, ay double, ax double, tx double, ty double, tz double"


def test_points_move_with_the_pose_of_their_frame(spark):
    points = spark.createDataFrame([("a", 1.0, 0.0, 0.0, 7), ("b", 1.0, 2.0, 3.0, 8), (None, 1.0, 2.0, 3.0, 9)], "f string, x double, y double, z double, tx int")
    poses = spark.createDataFrame([("a", np.pi / 2, 0.0, 0.0, 1.0, 2.0, 3.0)], POSES)
    got = {r.tx: r for r in registered.posed(points, poses, ["f"]).collect()}
    assert (got[7].x, got[7].y, got[7].z) == pytest.approx((1.0, 3.0, 3.0))
    assert got[8].x is None and got[9].z is None
    assert registered.posed(points.limit(0), poses, ["f"]).count() == 0


def test_voi_rates_sum_a_voxel_before_its_rate(spark):
    v = spark.createDataFrame([(1, 0, 2, 1.0), (1, 0, 4, 2.0), (1, 1, 5, 0.0), (2, 5, 1, 1.0), (2, None, 1, 1.0), (2, 0, None, 2.0)], "f int, i int, counts int, dwell double")
    m = spark.createDataFrame([("p", 0), ("p", 1), ("p", 0), ("q", 9), ("q", None)], "voi string, i int")
    got = sorted(tuple(r) for r in registered.voi_rates(v, m, ["f"], ["voi"], ["i"]).collect())
    assert got == [(1, "p", 1.0, 2), (2, "p", 0.0, 2)]
    sums = sorted(tuple(r) for r in registered.voi_sums(v, m, ["f"], ["voi"], ["i"]).collect())
    assert sums == [(1, "p", 11, 3.0), (2, "p", None, 2.0)]
    assert registered.voi_rates(v.limit(0), m, ["f"], ["voi"], ["i"]).count() == 0


def brute_infill(x):
    x = x.copy()
    while np.isnan(x).any() and not np.isnan(x).all():
        new = x.copy()
        for i, j in zip(*np.nonzero(np.isnan(x))):
            near = [x[a, b] for a, b in ((i - 1, j), (i + 1, j), (i, j - 1), (i, j + 1)) if 0 <= a < x.shape[0] and 0 <= b < x.shape[1] and not np.isnan(x[a, b])]
            if near:
                new[i, j] = np.mean(near)
        x = new
    return x


def test_infill_takes_the_mean_of_neighbours(spark):
    x = np.where(np.random.default_rng(3).random((6, 5)) < 0.2, np.arange(30.0).reshape(6, 5), np.nan)
    rows = [("v", i, j, None if np.isnan(x[i, j]) else float(x[i, j])) for i in range(6) for j in range(5)]
    d = spark.createDataFrame([*rows, ("v", 99, 0, 1.0), ("v", None, 0, 1.0), ("e", 0, 0, float("nan"))], "s string, i int, j int, v double")
    got = volumes.infill(d, {"i": 6, "j": 5}, "v", ["s"]).toPandas()
    full = got[got.s == "v"].sort_values(["i", "j"])["v"].to_numpy().reshape(6, 5)
    assert np.allclose(full, brute_infill(x))
    assert len(got[got.s == "e"]) == 30 and got[got.s == "e"]["v"].isna().all()
    assert volumes.infill(d.limit(0), {"i": 6, "j": 5}, "v", ["s"]).count() == 0


def test_plane_sums_its_depths(spark):
    v = spark.createDataFrame([(1, 0, 0, 1, 2, 1.0), (1, 0, 0, 2, 3, 1.0), (1, 0, 0, 3, 9, 1.0), (1, 0, 0, None, 9, 1.0)], "f int, i int, j int, k int, counts int, dwell double")
    got = registered.plane_in_time(v.withColumn("g", F.lit(2.0)), ["f"], ["i", "j"], "k", 1, 2, "g").collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 10.0, 2.0)]


def cost(z, y, s):
    """Absolute misfit of known pixels and the squared Laplacian, ends mirrored."""
    p = np.pad(z, 1, mode="edge")
    bent = 4 * z - p[:-2, 1:-1] - p[2:, 1:-1] - p[1:-1, :-2] - p[1:-1, 2:]
    return np.nansum(np.abs(z - y)) + s * (bent**2).sum()


def test_l1_spline_is_the_least_cost(spark):
    rng = np.random.default_rng(4)
    i, j = np.indices((9, 8))
    y = np.sin(i / 3) + j / 5 + rng.normal(0, 0.05, i.shape)
    y[2, 3], y[5, 5], y[7, 1] = 9, np.nan, -6
    z = volumes.l1_smoothed(y, 0.7, most=20000, least=1e-12)
    best = cost(z, y, 0.7)
    for _ in range(300):
        assert best <= cost(z + rng.normal(0, 10 ** rng.uniform(-4, -1), z.shape) * (rng.random(z.shape) < 0.2), y, 0.7) + 1e-6
    assert abs(z[2, 3] - np.sin(2 / 3) - 0.6) < 0.3
    d = spark.createDataFrame([("v", int(a), int(b), None if np.isnan(y[a, b]) else float(y[a, b])) for a in range(9) for b in range(8)] + [("e", 0, 0, None)], "s string, i int, j int, v double")
    got = volumes.l1_spline(d, {"i": 9, "j": 8}, "v", ["s"], 0.7).toPandas()
    assert np.allclose(got[got.s == "v"].sort_values(["i", "j"])["v"].to_numpy().reshape(9, 8), volumes.l1_smoothed(y, 0.7))
    assert got[got.s == "e"]["v"].isna().all() and (got.s == "e").sum() == 72


def test_translate_by_whole_and_part_pixels(spark):
    x = np.zeros((7, 6))
    x[2:5, 2:4] = [[1, 2], [3, 4], [5, 6]]
    d = spark.createDataFrame([("v", a, b, float(x[a, b])) for a in range(7) for b in range(6) if x[a, b]], "s string, i int, j int, v double")
    got = volumes.translate(d, {"i": 7, "j": 6}, "v", ["s"], 1, -2).toPandas().sort_values(["i", "j"])["v"].to_numpy().reshape(7, 6)
    assert np.allclose(got, np.roll(x, (1, -2), (0, 1)), atol=1e-9)
    i = np.arange(40)
    bell = lambda c: np.exp(-((i - c) ** 2)[:, None] / 18 - (i - 20) ** 2 / 18)
    assert np.allclose(volumes.shifted(bell(20), 0.37, 0), bell(20.37), atol=1e-6)
