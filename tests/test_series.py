"""Filters, spectra and similarity against numpy, warps against planted ones."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import acquisition, binning, series, temporal


@pytest.fixture(scope="module")
def wave(spark):
    rng = np.random.default_rng(5)
    rows = [(k, i, float(np.sin(i / 3) + rng.normal(0, 0.1))) for k, n in (("a", 40), ("b", 3), ("c", 1)) for i in range(n)]
    return spark.createDataFrame(rows, "k string, i int, v double")


@pytest.mark.parametrize("pad", series.PADS)
def test_filters_by_numpy(wave, pad):
    kernel = temporal.gauss_kernel(1.2)
    got = {(r.k, r.i): r.s for r in series.filtered(wave, ["k"], ["i"], "v", kernel, "s", pad).collect()}
    rows = wave.collect()
    m = max(abs(x) for x, _ in kernel)
    v = np.array([r.v for r in sorted(rows, key=lambda r: r.i) if r.k == "a"])
    mode = {"ends": {"mode": "edge"}, "zeros": {"mode": "constant"}, "linear": {"mode": "reflect", "reflect_type": "odd"}, "circular": {"mode": "wrap"}, "mirror": {"mode": "symmetric"}}[pad]
    full = np.pad(v, m, **mode)
    for i in range(len(v)):
        assert got["a", i] == pytest.approx(sum(w * full[i + m - x] for x, w in kernel))
    assert len(got) == len(rows) and all(x is not None for x in got.values())


def test_spectrum_finds_a_tone(spark):
    n = 64
    x = [("s", i, math.sin(2 * math.pi * i * 8 / n)) for i in range(640)]
    rows = series.spectrum(spark.createDataFrame(x, "k string, i long, v double"), ["k"], "i", "v", n, 0.1).collect()
    assert max(rows, key=lambda r: r.power).frequency == pytest.approx(8 / n / 0.1) and len(rows) == n // 2 + 1
    assert sum(r.power for r in rows) / (n * 0.1) == pytest.approx(0.5, rel=0.05)  # the tone's variance


def test_similarity_of_equal_and_of_other_volumes(spark):
    rng = np.random.default_rng(6)
    a = rng.integers(0, 200, (8, 6))
    rows = [(i, j, int(a[i, j]), int(a[i, j])) for i in range(8) for j in range(6)]
    same = series.similarity(spark.createDataFrame(rows, "ix long, iy long, a int, b int"), {"ix": 8, "iy": 6}, "a", "b", 1.0, 255.0, 2)
    assert [round(r.ssim, 6) for r in same.orderBy("scale").collect()] == [1.0, 1.0]
    other = spark.createDataFrame([(i, j, x, 200 - x) for i, j, x, _ in rows], "ix long, iy long, a int, b int")
    assert series.similarity(other, {"ix": 8, "iy": 6}, "a", "b", 1.0, 255.0, 1).collect()[0].ssim < 0.5


def test_a_planted_warp_is_found(spark):
    t = np.linspace(0, 1, 200)
    target = spark.createDataFrame([(float(a), float(np.sin(2 * np.pi * a))) for a in np.linspace(-0.3, 1.3, 400)], "t double, v double")
    rows = spark.createDataFrame([("a", float(a), float(3 * np.sin(2 * np.pi * (a + 0.05)) + 1)) for a in t], "k string, t double, v double")
    got = series.time_warp(rows, ["k"], "t", "v", target).orderBy("t").collect()
    assert np.abs(np.array([r.warped for r in got]) - t - 0.05).max() < 0.02 and got[0].scale == pytest.approx(3, abs=0.1) and got[0].offset == pytest.approx(1, abs=0.1)


def test_masks_frames_and_angles(spark):
    v = spark.createDataFrame([(i, j, 10 if 3 <= i <= 5 and 3 <= j <= 5 else 1) for i in range(10) for j in range(10)], "ix long, iy long, n int")
    mask = {(r.ix, r.iy) for r in series.analysis_mask(v, {"ix": 10, "iy": 10}, "n", 0.5, 0.92).collect()}
    assert {(i, j) for i in range(3, 6) for j in range(3, 6)} <= mask and (9, 9) not in mask
    m = spark.createDataFrame([(i, float(i)) for i in range(1, 11)], "frame int, m double")
    assert sorted(r.frame for r in binning.best_frames(m, "m", 0.8).collect()) == [8, 9, 10]
    a = spark.createDataFrame([("k", float(i), 0.1 if i != 5 else 3.0) for i in range(11)], "k string, t double, a double")
    assert [r.t for r in series.steady_angles(a, ["k"], "t", "a", 2.0).where("a is null").collect()] == [5.0]


def test_along_heading_and_scan_lag(spark):
    track = spark.createDataFrame([("k", float(i), 3.0, 4.0) for i in range(3)], "k string, t double, v_x double, v_y double")
    heading = spark.createDataFrame([("k", 0.0, 2.0, 0.0), ("k", 2.0, 2.0, 0.0)], "k string, t double, hx double, hy double")
    r = series.along_heading(track, heading, ["k"], "t", "hx", "hy").where(F.col("t") == 1).collect()[0]
    assert (r.along, r.cosine) == pytest.approx((3.0, 0.6))
    assert acquisition.scan_lag(lambda x: -((x - 0.37) ** 2), [i / 10 for i in range(11)]) == pytest.approx(0.37, abs=1e-3)
    assert acquisition.regular_axis([3.0, 1.0, 2.0, 2.0], centres=True) == (0.5, 1.0, 3)
    assert binning.moved_sphere((1, 0, 0), 2.0, [[2, 0, 0, 1], [0, 2, 0, 0], [0, 0, 2, 0]]) == ((3, 0, 0), pytest.approx(4.0))


def test_values_at_places_by_sorting(spark):
    rng = np.random.default_rng(9)
    from lumenframe.operators import stats

    values = {"a": np.exp(rng.normal(0, 4, 3000)), "b": np.repeat([1.5, 2.0, 2.0, 7.0], 50), "c": np.array([3.0]), "d": rng.normal(size=501) * 1e-9 + 5}
    rows = [(k, float(v)) for k, x in values.items() for v in x] + [("a", None), ("e", None), ("a", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    for p in (0.0, 0.31, 0.5, 0.99, 1.0):
        near, line = stats.nearest_rank_by(df, ["k"], "v", p, "q").collect(), {r.k: r.q for r in stats.hazen(df, ["k"], "v", p, "q").collect()}
        assert {r.k for r in near} == set(values)
        for r in near:
            x = np.sort(values[r.k])
            assert r.q == x[max(1, min(len(x), int(np.floor(p * len(x) + 0.5)))) - 1]
            assert line[r.k] == pytest.approx(np.interp(p, (np.arange(len(x)) + 0.5) / len(x), x), rel=1e-12)
    assert stats.nearest_rank_by(df.where("k = 'b'"), [], "v", 0.5, "q").first().q == 2.0
