"""Shifts, spots and intensities of frames against planted ones and brute force."""

import numpy as np
import pytest

from lumenframe.operators import images


def blobs(x, y):
    return sum(h * np.exp(-((x - a) ** 2 + (y - b) ** 2) / 8) for a, b, h in ((12, 10, 3), (22, 17, 2), (16, 24, 1)))


@pytest.mark.parametrize("move", [(0.0, 0.0), (2.0, -3.0), (1.3, 0.6), (-2.45, 1.75)])
def test_shifts_to_a_tenth_of_a_bin(move):
    x, y = np.indices((36, 34)).astype(float)
    rng = np.random.default_rng(0)
    a, b = blobs(x, y) + rng.normal(0, 0.02, x.shape), blobs(x - move[0], y - move[1]) + rng.normal(0, 0.02, x.shape)
    assert images.correlation_peak(a, b, 0.0)[0] == pytest.approx(move, abs=0.1)
    z = np.zeros((8, 9, 10))
    z[3, 4, 5] = 1
    assert images.correlation_peak(z, np.roll(z, (1, -2, 3), (0, 1, 2)), 1.0)[0] == pytest.approx((1, -2, 3), abs=0.1)


def test_shifts_of_tables(spark):
    x, y = np.indices((36, 34)).astype(float)
    at = {0: (0, 0), 1: (1.3, 0.6), 2: (0.8, -1.4), 5: (0, 0)}
    rows = [("k", f, int(i), int(j), float(v)) for f, (p, q) in at.items() for (i, j), v in np.ndenumerate(blobs(x - p, y - q))] + [("k", 1, 99, 0, 5.0), ("k", None, 0, 0, 1.0), ("k", 2, 0, 0, None)]
    got = images.frame_shifts(spark.createDataFrame(rows, "k string, f long, x int, y int, v double").repartition(4), ["k"], "f", {"x": 36, "y": 34}, "v", 0.0).orderBy("f").collect()
    assert [r.f for r in got] == [0, 1] and (got[0].d_x, got[0].d_y) == pytest.approx((1.3, 0.6), abs=0.1) and (got[1].d_x, got[1].d_y) == pytest.approx((-0.5, -2.0), abs=0.1)
    with pytest.raises(ValueError):
        images.frame_shifts(spark.createDataFrame(rows[:9], "k string, f long, x int, y int, v double"), ["k"], "f", {"x": 36, "y": 34}, "v", bound=100)


def component_by_brute_force(mask):
    left, best = {tuple(map(int, p)) for p in np.argwhere(mask)}, set()
    while left:
        stack, one = [min(left)], set()
        while stack:
            p = stack.pop()
            if p in left:
                left.discard(p)
                one.add(p)
                stack += [tuple(v + d * (i == k) for i, v in enumerate(p)) for k in range(mask.ndim) for d in (-1, 1)]
        if len(one) > len(best) or len(one) == len(best) and best and min(one) < min(best):
            best = one
    return best


def test_largest_components_by_brute_force():
    rng = np.random.default_rng(1)
    for shape in ((9, 9), (30, 2), (5, 6, 4), (7,)):
        for density in (0.0, 0.3, 0.55, 1.0):
            mask = rng.random(shape) < density
            assert {tuple(map(int, p)) for p in np.argwhere(images.largest_component(mask))} == component_by_brute_force(mask)


def test_bright_spots_and_intensities(spark):
    rows = []
    for f in (0, 1, 4):
        v = np.zeros((12, 12))
        v[3 + f : 6 + f, 4:7] = 5
        v[0, 11] = 9  # brighter, but a cell alone
        rows += [("k", f, int(i), int(j), float(x)) for (i, j), x in np.ndenumerate(v)]
    rows += [("k", 3, 0, 0, None), ("k", 0, 50, 0, 100.0)]
    df = spark.createDataFrame(rows, "k string, f long, x int, y int, v double").repartition(3)
    got = {r.f: r for r in images.bright_spots(df, ["k"], "f", {"x": 12, "y": 12}, "v", 0.95).collect()}
    for f in (0, 1, 4):
        assert (got[f].x, got[f].y) == pytest.approx((4 + f, 5)) and got[f].cells == 9 and got[f].found
    assert not got[3].found and (got[3].x, got[3].y) == pytest.approx((8, 5)) and set(got) == {0, 1, 3, 4}
    total = {r.f: (r.total, r.change) for r in images.intensity(df, ["k"], "f", "v").collect()}
    assert total[0] == (154.0, None) and total[1] == (54.0, -100.0) and total[3] == (None, None)
