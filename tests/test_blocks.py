"""Volumes in blocks against the same as a whole."""

import numpy as np
import pytest

from lumenframe.operators import blocks, volumes

SIZES = {"i": 40, "j": 23, "k": 6}


def frame(spark, volume, missing=0.0, rng=None, label="a"):
    rows = [(label, *map(int, p), float(v)) for p, v in np.ndenumerate(volume) if not missing or rng.random() > missing for p in [p]]
    return spark.createDataFrame([(a, i, j, k, v) for a, i, j, k, v in rows], "f string, i long, j long, k long, v double").repartition(4)


def dense(df):
    out = np.full(tuple(SIZES.values()), np.nan)
    for r in df.collect():
        out[r.i, r.j, r.k] = np.nan if r.v is None else r.v
    return out


def wave():
    i, j, k = np.indices(tuple(SIZES.values()))
    return np.sin(i / 5) + np.cos(j / 4) + 0.2 * k


def mean_of_three():
    """A mean of three along the first axis, held at the ends: it looks one voxel around.  Made here, so that workers need not import this file."""

    def local(x):
        p = np.pad(x, ((1, 1), (0, 0), (0, 0)), mode="edge")
        return (p[:-2] + p[1:-1] + p[2:]) / 3

    return local


def test_local_changes_are_those_of_the_whole(spark):
    x, local = wave(), mean_of_three()
    df = frame(spark, x)
    got = dense(blocks.in_blocks(df, SIZES, "v", ["f"], local, {"i": 12, "j": 9, "k": 6}, 1).where("f = 'a'"))
    want = local(x)
    inner = np.ones(40, bool)
    for b in (12, 24, 36):  # the last voxel of a halo sees an end where there is none
        inner[b - 1 : b + 1] = False
    assert np.allclose(got[inner], want[inner]) and not np.isnan(got).any()
    assert np.allclose(dense(blocks.in_blocks(df, SIZES, "v", [], local, SIZES, 0)), want)


def test_smoothing_in_blocks_is_near_that_of_the_whole(spark):
    rng = np.random.default_rng(0)
    x = wave()
    noisy = x + rng.normal(0, 0.05, x.shape)
    noisy[rng.random(x.shape) < 0.02] += 8
    df = frame(spark, noisy, 0.1, rng)
    got = dense(blocks.l1_spline(df, SIZES, "v", ["f"], 0.5, 16, 6))
    whole = dense(volumes.l1_spline(df, SIZES, "v", ["f"], 0.5))
    assert np.abs(got - whole).max() < 0.05 and np.abs(got - x).mean() < 0.06
    with pytest.raises(ValueError):
        blocks.l1_spline(df, SIZES, "v", ["f"], 0.5, 8, 6)


def test_movies_and_templates(spark):
    rng = np.random.default_rng(1)
    rows = [(f, i, j, 0, float(rng.poisson(20 * (1 + f))), 2.0) for f in (0, 1) for i in range(12) for j in range(10)] + [(0, 3, 3, 1, 5.0, 0.0)]
    df = spark.createDataFrame(rows, "f long, i long, j long, k long, counts double, dwell double")
    sizes = {"i": 12, "j": 10, "k": 2}
    rate = blocks.smoothed_movie(df, sizes, "f", s=1.0, block=8, halo=2).groupBy("f").avg("v").orderBy("f").collect()
    count = blocks.smoothed_movie(df, sizes, "f", "counts", 1.0, block=8, halo=2).where("k = 0").groupBy("f").avg("v").orderBy("f").collect()
    assert [r[1] for r in rate] == pytest.approx([10, 20], rel=0.1) and [r[1] for r in count] == pytest.approx([20, 40], rel=0.1)
    mask = spark.createDataFrame([(i, j, 0) for i in range(6) for j in range(10)], "i long, j long, k long")
    image = blocks.template_image(df, sizes, spark.createDataFrame([(1,)], "f long"), "f", 0.5, mask, 1.0, block=8, halo=2).toPandas()
    assert len(image) == 240 and (image[(image.i > 5) | (image.k > 0)].v == 0.5).all() and image[(image.i < 6) & (image.k == 0)].v.mean() == pytest.approx(20, rel=0.1)
    with pytest.raises(ValueError):
        blocks.smoothed_movie(df, sizes, "f", "other")
