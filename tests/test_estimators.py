"""Estimators against other ways to the same numbers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import binning, estimators

SF = "/root/testdata/sf0.001"


def test_pca_by_singular_values(spark):
    rows = estimators.pca2(spark.read.parquet(f"{SF}/embeddings.parquet"), "embedding", 64).select("embedding", "pc1", "pc2").collect()
    x = np.array([r.embedding for r in rows], float)
    _, _, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    for k, c in enumerate(("pc1", "pc2")):
        want, got = (x - x.mean(0)) @ v[k], np.array([r[c] for r in rows])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-6


def test_two_rates_by_plain_newton_on_dense_matrices():
    rng = np.random.default_rng(0)
    n, dt = 40, np.full(40, 0.5)
    nr, ng = rng.poisson(6 * dt).astype(float), rng.poisson(3 * np.exp(np.sin(np.arange(40) / 8)) * dt).astype(float)
    u, v, su, sv = estimators.two_rate_map(nr, ng, dt, 0.4, 0.6)
    d = np.diff(np.eye(n), axis=0)
    pu, pv = d.T @ d / (0.4 * 0.5), d.T @ d / (0.6 * 0.5)
    x = np.zeros(2 * n)
    for _ in range(200):
        a, b = x[:n], x[n:]
        r, g = np.exp(a) * dt, np.exp(a + b) * dt
        grad = np.concatenate([nr - r + ng - g - pu @ a, ng - g - pv @ b])
        h = np.block([[np.diag(r + g) + pu, np.diag(g)], [np.diag(g), np.diag(g) + pv]])
        x = x + np.clip(np.linalg.solve(h, grad), -1, 1)
    assert np.abs(x - np.concatenate([u, v])).max() < 1e-4
    assert np.abs(np.sqrt(np.diag(np.linalg.inv(h))) - np.concatenate([su, sv])).max() < 1e-4


def test_viterbi_by_all_paths(spark):
    from itertools import product

    rng = np.random.default_rng(1)
    cost = rng.random((5, 4))
    paths = [p for p in product(range(4), repeat=5) if all(0 <= b - a <= 2 for a, b in zip(p, p[1:], strict=False))]
    want = min(paths, key=lambda p: sum(cost[t, s] for t, s in enumerate(p)))
    df = spark.createDataFrame([("a", t, s, float(cost[t, s])) for t in range(5) for s in range(4)], "k string, t int, s int, c double")
    assert tuple(r.s for r in estimators.align_monotone(df, ["k"], "t", "s", "c").orderBy("t").collect()) == want


def test_plane_wave_is_found(spark):
    rows = [("m", x, y, float(np.cos(0.3 * x - 0.2 * y + 0.7)), float(np.sin(0.3 * x - 0.2 * y + 0.7))) for x in range(12) for y in range(10)]
    (r,) = estimators.plane_waves(spark.createDataFrame(rows, "k string, x int, y int, re double, im double"), ["k"], "x", "y", "re", "im").collect()
    assert (r.kx, r.ky, r.phase) == pytest.approx((0.3, -0.2, 0.7), abs=0.01)


def test_bleaching_is_taken_out(spark):
    t = np.arange(0, 100, 0.5)
    base = 5 * np.exp(-t / 30) + 2
    y = base * np.where((t > 40) & (t < 50), 1.8, 1.0)
    df = spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(t, y, strict=True)], "k string, t double, v double")
    got = np.array([r.baseline for r in estimators.bleach_corrected(df, ["k"], "t", "v").orderBy("t").collect()])
    assert np.abs(got / base - 1).max() < 0.05


def test_bounds_are_kept(spark):
    with pytest.raises(Exception, match="is the bound"):
        estimators.bleach_corrected(spark.range(10).selectExpr("'a' as k", "double(id) as t", "double(id) as v"), ["k"], "t", "v", bound=5).count()


def test_asymmetric_statistics_in_both_forms(spark):
    x = np.concatenate([np.random.default_rng(2).normal(0, 1, 300), [30.0, 40.0, np.nan, np.inf]])
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("b", 2.0), ("b", None)], "k string, v double")
    got = {r.k: (r["mean"], r.sd) for r in binning.asymmetric_stats(df, ["k"], "v").collect()}
    assert got["a"] == pytest.approx(estimators.asymmetric_mean(x)) and got["b"] == (2.0, 0.0)
    assert df.where(F.col("v") > 20).count() > 0
