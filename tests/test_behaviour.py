"""Strides, hulls and fits of frames against planted truths."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import behaviour, fits, geometry, hulls


def test_strides_of_labelled_crawls(spark):
    rows = [("a", i / 10, 1.5 + np.sin(2 * np.pi * i / 20), 1 if i < 200 else 0 if i < 230 else 2) for i in range(430)]
    out = behaviour.labelled_strides(spark.createDataFrame([(k, float(t), float(v), s) for k, t, v, s in rows], "k string, t double, v double, label int"), ["k"], "t", "v", "label")
    got = out.groupBy("crawl", "label").agg(F.countDistinct("stride").alias("n"), F.min("phase").alias("a"), F.max("phase").alias("b")).orderBy("crawl").collect()
    assert [r.label for r in got] == [1, 2] and all(9 <= r.n <= 11 and r.a >= 0 and r.b <= 2 * np.pi + 1e-9 for r in got)
    length = out.groupBy("crawl", "stride").agg((F.max("t") - F.min("t")).alias("d"))
    assert length.agg(F.percentile("d", 0.5)).first()[0] == pytest.approx(1.9, abs=0.15)


def test_monotone_repair_and_splines(spark):
    df = spark.createDataFrame([("a", float(i), v) for i, v in enumerate([0.0, 1.0, 5.0, 2.0, 3.0, 6.0])], "k string, t double, v double")
    assert [r.v for r in behaviour.monotone_repaired(df, ["k"], "t", "v").orderBy("t").collect()] == pytest.approx([0, 1, 1 + 5 / 4, 1 + 10 / 4, 1 + 15 / 4, 6])
    x = [r.smooth for r in behaviour.splined(df, ["k"], "t", "v", 0.0001).orderBy("t").collect()]
    assert np.abs(np.diff(x, 2)).max() < 0.05


def test_hull_facets_of_a_cube(spark):
    cube = [("c", float(i), float(j), float(k)) for i in (0, 2) for j in (0, 2) for k in (0, 2)] + [("c", 1.0, 1.0, 1.0)]
    facets = hulls.facets(spark.createDataFrame(cube, "h string, x double, y double, z double"), ["h"], "x", "y", "z").collect()
    assert len(facets) == 6
    at = spark.createDataFrame([(1.0, 1.0, 0.5), (2.0, 2.0, 2.0), (2.1, 1.0, 1.0)], "x double, y double, z double")
    inside = geometry.in_hull(F.col("x"), F.col("y"), F.col("z"), [(r.a, r.b, r.c, r.d) for r in facets])
    assert [r.i for r in at.select(inside.alias("i")).collect()] == [True, True, False]


def blob(shape=(24, 20, 8)):
    x, y, z = np.indices(shape)
    return np.exp(-((x - 12) ** 2 / 30 + (y - 9) ** 2 / 8 + (z - 4) ** 2 / 4)) + 0.8 * np.exp(-((x - 6) ** 2 / 6 + (y - 13) ** 2 / 4 + (z - 3) ** 2 / 3)) + 1e-3


def drawn(rng, template, n):
    i = rng.choice(template.size, n, p=(template / template.sum()).ravel())
    return np.stack(np.unravel_index(i, template.shape), 1) + rng.uniform(-0.5, 0.5, (n, 3))


def test_linked_poses_follow_a_drift(spark):
    rng, template, rows = np.random.default_rng(0), blob(), []
    for f in range(4):
        for p in drawn(rng, template, 900) - np.array([0.6 * f, -0.3 * f, 0.0]):
            rows.append((0, f, *map(float, p)))
    df = spark.createDataFrame(rows, "seg int, frame int, x double, y double, z double")
    got = behaviour.linked_poses(df, "seg", "frame", ("x", "y", "z"), template, sweeps=1).orderBy("frame").collect()
    centre = np.array([[11.0, 10.0, 4.0]])
    for f, r in enumerate(got):
        moved = fits.turned(centre - np.array([0.6 * f, -0.3 * f, 0.0]), np.array(r.pvec))[0]
        assert np.abs(moved - centre[0]).max() < 0.5 and r.n == 900


def test_dwell_keeps_the_likelihood_honest():
    rng, template = np.random.default_rng(1), blob() * 5
    x = drawn(rng, template, 400)
    grid = np.stack(np.meshgrid(*map(np.arange, template.shape), indexing="ij"), -1).reshape(-1, 3).astype(float)
    w = np.full(len(grid), 400 / template.sum())
    at = behaviour.likelihood(np.zeros(6), x, template, grid, w)
    assert at > behaviour.likelihood(np.array([0, 0, 0, 3.0, 0, 0]), x, template, grid, w) and at < behaviour.likelihood(np.zeros(6), x, template, None, None)


def test_bending_finds_a_local_shift(spark):
    rng, template = np.random.default_rng(2), blob()
    p = drawn(rng, template, 3000)
    shift = 1.2 * np.exp(-((p[:, 0] - 6) ** 2) / 40)
    df = spark.createDataFrame([(1, float(a), float(b - s), float(c)) for (a, b, c), s in zip(p, shift, strict=True)], "frame int, x double, y double, z double")
    rows = behaviour.bent_frames(df, "frame", ("x", "y", "z"), template, (4, 3, 2)).collect()
    assert len(rows) == 24
    left = np.mean([r.dy for r in rows if r.i in (0, 1) and r.j == 1])
    right = np.mean([r.dy for r in rows if r.i == 3 and r.j == 1])
    assert left > 0.4 and left > right + 0.2


def test_groups_boxes_and_offsets(spark):
    df = spark.createDataFrame([(f, float(i)) for f in (1, 2) for i in range(101)], "frame int, x double")
    assert sorted(r["count"] for r in behaviour.groups_of_equal_count(df, ["frame"], ["x"], 4).where("frame = 1").groupBy("part").count().collect()) == [25, 25, 25, 26]
    r = behaviour.scan_boxes(df, "frame", "x").orderBy("frame").first()
    assert (r.low, r.middle, r.high) == pytest.approx((0.51, 50.0, 99.49)) and (r.all_low, r.all_high) == pytest.approx((0.51, 99.49))
    t = spark.createDataFrame([("a", float(i), 2.0, 8.0) for i in range(9)], "k string, t double, x double, z double")
    assert behaviour.smoothed_offset(t, ["k"], "t", ["x", "z"], 1.0, 4.0).agg(F.avg("x"), F.avg("z")).first()[:] == pytest.approx((2.0, 2.0))
