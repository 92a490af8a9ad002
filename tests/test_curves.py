"""Fits under other costs than the square: against dense answers and planted truths."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import curves


def test_least_deviation_ignores_outliers_and_solves_each_key(spark):
    rng = np.random.default_rng(0)
    rows = []
    for k, c in (("a", (1.0, -2.0, 0.5)), ("b", (-3.0, 0.25, 0.0))):
        x = rng.uniform(-3, 3, 201)
        y = c[0] + c[1] * x + c[2] * x * x
        y[::5] += rng.uniform(20, 60, len(y[::5]))
        rows += [(k, float(p), float(q), 1.0) for p, q in zip(x, y, strict=True)]
    rows += [("a", None, 1.0, 1.0), ("a", 1.0, None, 1.0), ("a", 0.0, 1e9, 0.0), ("c", 1.0, 4.0, 1.0), ("d", None, None, 1.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double, w double").repartition(4)
    got = {r.k: r for r in curves.least_deviation(df, ["k"], "x", "y", 2, 10, weight="w").collect()}
    assert set(got) == {"a", "b", "c"} and got["a"].n == 201
    assert [got["a"][f"c{i}"] for i in range(3)] == pytest.approx([1, -2, 0.5], abs=1e-3) and [got["b"][f"c{i}"] for i in range(3)] == pytest.approx([-3, 0.25, 0], abs=1e-3)
    assert got["c"].deviation == pytest.approx(0, abs=1e-6)
    line = curves.least_deviation(df.where("k = 'b'"), [], "x", "y").first()
    assert line.c1 == pytest.approx(0.25, abs=1e-3)


def test_a_curve_under_any_cost(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 4, 400)
    y = 3 * np.exp(-0.7 * x) + 1 + rng.normal(0, 0.01, 400)
    y[:30] += 40
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)] + [(1.0, None)], "x double, y double").repartition(3)
    model = lambda p: p[0] * F.exp(-p[1] * F.col("x")) + p[2]
    at, cost = curves.fitted(df, "y", model, lambda e: F.log1p(e * e * 25), [1.0, 1.0, 0.0], [0, 0.1, -5], [10, 5, 5])
    assert at == pytest.approx([3, 0.7, 1], abs=0.05) and 0 < cost < 1
    square, _ = curves.fitted(df.where("y < 20"), "y", lambda p: p[0] + p[1] * F.col("x"), lambda e: e * e, [0.0, 0.0])
    keep = y < 20
    assert square == pytest.approx(np.polyfit(x[keep], y[keep], 1)[::-1], abs=1e-3)


def test_delays_of_a_periodic_signal(spark):
    rng = np.random.default_rng(2)
    signal = np.exp(-((np.arange(64) - 20) ** 2) / 60) + 0.4 * np.exp(-((np.arange(64) - 45) ** 2) / 20)
    x, t = rng.uniform(100, 140, 3000), rng.uniform(5, 7, 3000)
    delay = 0.3 + 0.01 * (x - 120) + 0.0004 * (x - 120) ** 2
    a = rng.uniform(0.5, 2, 3000)
    y = a * curves.projected(signal, (t - 5 - delay) / 2)
    y[::40] += 3
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(x, t, y, a, strict=True)] + [(None, 1.0, 1.0, 1.0)], "x double, t double, y double, a double").repartition(4)
    p, cost = curves.delay_polynomial(df, "x", "t", "y", signal, 2.0, 2, 5.0, "a")
    at = np.linspace(100, 140, 9)
    truth = 0.3 + 0.01 * (at - 120) + 0.0004 * (at - 120) ** 2
    assert np.abs(np.polyval(p, at) - truth).max() < 0.02 and cost < 0.1
    with pytest.raises(ValueError):
        curves.delay_polynomial(df.limit(0), "x", "t", "y", signal, 2.0)
