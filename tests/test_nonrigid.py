"""Free-form fits: slopes against differences, the table's sums against dense ones, planted bends."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import descent, nonrigid


def bright(shape=(26, 22, 9)):
    x, y, z = np.indices(shape).astype(float)
    spots = [(7, 7, 3), (18, 6, 5), (8, 15, 5), (19, 15, 3), (13, 11, 4)]
    return sum(np.exp(-((x - a) ** 2 + (y - b) ** 2) / 5 - (z - c) ** 2 / 3) for a, b, c in spots) + 2e-3


def drawn(rng, rate, n):
    at = np.stack(np.unravel_index(rng.choice(rate.size, n, p=rate.ravel() / rate.sum()), rate.shape), 1)
    return at + rng.uniform(-0.5, 0.5, at.shape)


def slope_by_differences(f, x, h=1e-5):
    return np.array([(f(x + h * e)[0] - f(x - h * e)[0]) / (2 * h) for e in np.eye(len(x))])


def test_minimum_within_bounds():
    a = np.diag([1.0, 10.0, 100.0]) + 0.3
    f = lambda x: (0.5 * (x - 2) @ a @ (x - 2), a @ (x - 2))
    assert np.allclose(descent.minimised(f, np.zeros(3), least=0)[0], 2, atol=1e-4)
    x, _ = descent.minimised(f, np.zeros(3), np.full(3, -1.0), np.array([1.0, 9, 9]), least=0)
    assert x[0] == 1 and np.allclose((a @ (x - 2))[1:], 0, atol=1e-3)


def test_slopes_by_differences():
    rng = np.random.default_rng(0)
    levels = nonrigid.lattices([0, 0, 0], [20, 16, 6], [(3, 3, 2), (4, 3, 3)])
    x = rng.normal(0, 0.3, sum(a.size for a in levels))
    p, w = rng.uniform([0, 0, 0], [20, 16, 6], (40, 3)), rng.uniform(0.5, 2, 40)
    v = np.where(rng.random(40) < 0.4, rng.uniform(1, 3, 40), np.nan)
    rate = nonrigid.floored(bright())
    f = lambda x: nonrigid.with_geometry(nonrigid.image_sums(p, w, v, levels, x, rate), w.sum(), levels, x, 0.3, 4.0)
    assert np.allclose(f(x)[1], slope_by_differences(f, x), atol=1e-5)


def test_weights_are_those_of_the_spline_field(spark):
    from lumenframe.operators import volumes

    rng = np.random.default_rng(1)
    (level,) = nonrigid.lattices([0, 0, 0], [6, 4, 2], [(4, 3, 2)])
    x = rng.normal(size=level.size)
    p = rng.uniform([0, 0, 0], [6, 4, 2], (20, 3))
    nodes = nonrigid._nodes([level], x)
    lattice = spark.createDataFrame([(int(r.i), int(r.j), int(r.k), float(r.dx)) for r in nodes.itertuples()], "i_x long, i_y long, i_z long, dx double")
    got = volumes.spline_field(spark.createDataFrame(p.tolist(), "x double, y double, z double"), lattice, {a: (0.0, level.step[n], level.count[n]) for n, a in enumerate("xyz")}, ["dx"]).collect()
    have = {round(r.x, 9): r.dx for r in got}
    for a, b in zip(p, nonrigid.shifted(p, [level], x), strict=True):
        assert have[round(a[0], 9)] == pytest.approx(b[0] - a[0])


def test_energies_of_lattices(spark):
    rng = np.random.default_rng(2)
    m = {k: rng.normal(size=(4, 3, 2, 3)) for k in "ab"}
    rows = [(k, *map(int, i), *map(float, d[i])) for k, d in m.items() for i in np.ndindex(4, 3, 2)]
    df = spark.createDataFrame([*rows, ("one", 0, 0, 0, 1.0, 2.0, 2.0)], "k string, i long, j long, l long, dx double, dy double, dz double")
    got = {r.k: r for r in nonrigid.lattice_energies(df, ["k"], ("i", "j", "l"), ("dx", "dy", "dz"), (2.0, 1.5, 3.0), 5.0).collect()}
    for k, d in m.items():
        assert got[k].spring == pytest.approx(nonrigid.springs(d, (2.0, 1.5, 3.0))[0]) and got[k].anchor == pytest.approx(nonrigid.anchors(d, 5.0)[0])
    assert got["one"].spring == 0 and got["one"].anchor == pytest.approx(9 / 50)


def planted(rng, n):
    """Points drawn from the template and moved off by a smooth bend, which a fit has to undo."""
    p = drawn(rng, bright(), n)
    return p, p - np.stack([0.9 * np.sin(p[:, 1] / 7), 0.8 * np.cos(p[:, 0] / 8), 0 * p[:, 2]], 1)


def test_planted_bends_are_undone_by_frame_and_by_table(spark):
    rng = np.random.default_rng(3)
    rate, counts = bright(), [(4, 4, 2), (6, 6, 2)]
    truth, moved = planted(rng, 6000)
    grid = np.stack(np.meshgrid(*(np.arange(0, n, 2) for n in rate.shape), indexing="ij"), -1).reshape(-1, 3).astype(float)
    points = spark.createDataFrame([(1, *map(float, r)) for r in moved] + [(1, None, 0.0, 0.0)], "f int, x double, y double, z double").repartition(5)
    dwell = spark.createDataFrame([(1, *map(float, r), 8.0) for r in grid], "f int, x double, y double, z double, dwell double")
    how = {"geometry": 0.01, "length": 8.0}
    frames = nonrigid.bent_frames(points, "f", ("x", "y", "z"), rate, counts, dwell=dwell, steps=40, **how).toPandas()
    nodes, value = nonrigid.bent_volume(points, ("x", "y", "z"), rate, counts, dwell=dwell, steps=12, **how)
    levels, x, dense = nonrigid.bend(moved, np.ones(len(moved)), grid, np.full(len(grid), 8.0), rate, counts, steps=12, **how)
    table = nodes.orderBy("level", "i", "j", "k").toPandas()
    assert value == pytest.approx(dense, rel=1e-4) and np.allclose(table[["dx", "dy", "dz"]].to_numpy().ravel(), x, atol=0.05)
    frames = frames.sort_values(["level", "i", "j", "k"])
    after = nonrigid.shifted(moved, levels, frames[["dx", "dy", "dz"]].to_numpy().ravel())
    off = lambda p: np.sqrt(np.mean((p - truth)[:, :2] ** 2))
    assert off(after) < 0.6 * off(moved) and frames["value"].iloc[0] <= dense + 1e-6
    step = np.concatenate([np.tile(a.step, a.size // 3) for a in levels])
    assert (np.abs(x) <= nonrigid.LIMIT * step + 1e-12).all()


def test_tables_without_points(spark):
    none = spark.createDataFrame([], "f int, x double, y double, z double")
    assert nonrigid.bent_frames(none, "f", ("x", "y", "z"), bright(), [(3, 3, 2)]).count() == 0
    with pytest.raises(ValueError):
        nonrigid.bent_volume(none.withColumn("w", F.lit(1.0)), ("x", "y", "z"), bright(), [(3, 3, 2)], "w")
