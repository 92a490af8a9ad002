"""Elastic alignment against planted warps and a dense dynamic programme."""

import numpy as np
import pandas as pd

from lumenframe.operators import elastic


def test_tridiagonal_systems():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 17, 300):
        off = rng.normal(size=n - 1)
        diagonal = 2.5 + np.abs(np.append(off, 0)) + np.abs(np.append(0, off))
        x = rng.normal(size=n)
        a = np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1)
        assert np.allclose(elastic.solve_tridiagonal(diagonal, off, a @ x), x)


def planted(rng, n, bend):
    """A known series at steps of 0.1, and n samples of it at times that a smooth monotone map gives."""
    tx = np.arange(0, n * 0.1 + 3, 0.1)
    waves = rng.normal(size=(2, 12)), np.exp(rng.uniform(np.log(0.05), np.log(0.8), 12)), rng.uniform(0, 6, 12)
    signal = lambda t: np.stack([(a[:, None] * np.sin(waves[1][:, None] * t + waves[2][:, None])).sum(0) for a in waves[0]], 1)
    s = np.linspace(0, 1, n + 2)
    t = 1 + n * 0.1 * (s + bend * np.sin(2 * np.pi * s) / (2 * np.pi))
    return tx, signal(tx), t, signal(t[1:-1])


def frames(parts):
    known = pd.concat([pd.DataFrame({"k": k, "i": np.arange(len(tx)), "t": tx, "a": v[:, 0], "b": v[:, 1]}) for k, (tx, v, _, _) in parts.items()])
    unknown = pd.concat([pd.DataFrame({"k": k, "i": np.arange(len(u)), "a": 1.7 * u[:, 0], "b": 1.7 * u[:, 1]}) for k, (_, _, _, u) in parts.items()])
    ends = pd.DataFrame([(k, t[0], t[-1]) for k, (_, _, t, _) in parts.items()], columns=["k", "t0", "t1"])
    return known, unknown, ends


def test_planted_warps_are_found_within_a_sample(spark, monkeypatch):
    """One series of one level, one of many pieces and levels."""
    monkeypatch.setattr(elastic, "PIECE", 400)
    monkeypatch.setattr(elastic, "HALO", 60)
    rng = np.random.default_rng(4)
    parts = {"long": planted(rng, 1500, 0.15), "short": planted(rng, 90, -0.2)}
    known, unknown, ends = (spark.createDataFrame(x) for x in frames(parts))
    got = elastic.aligned(known, unknown, ["k"], "i", "t", ["a", "b"], ends, 0.01, 0.01, 200.0).toPandas()
    for k, (_, _, t, u) in parts.items():
        mine = got[got.k == k].sort_values("i")
        assert len(mine) == len(u) and (np.diff(mine.t) > 0).all()
        assert np.abs(mine.t.to_numpy() - t[1:-1]).max() < 0.1 and abs(mine.magnitude.iloc[0] - 1 / 1.7) < 0.02


def cheapest(tx, known, unknown, m, ends, least, spring, barrier, grid):
    """The least energy of maps onto a grid of times: all monotone paths, by dynamic programming."""
    f = elastic._at(tx, known, grid)[0]
    gap = grid[None] - grid[:, None]
    step = np.where(gap > 0, 0.5 * spring * gap**2 + np.exp(np.minimum(-barrier * (gap - least), 300)), np.inf)
    first = grid - ends[0]
    cost = np.where(first > 0, 0.5 * spring * first**2 + np.exp(np.minimum(-barrier * (first - least), 300)), np.inf)
    for i in range(len(unknown)):
        if i:
            cost = (cost[:, None] + step).min(0)
        cost = cost + 0.5 * np.nansum((f - m * unknown[i]) ** 2, 1)
    last = ends[1] - grid
    return (cost + np.where(last > 0, 0.5 * spring * last**2 + np.exp(np.minimum(-barrier * (last - least), 300)), np.inf)).min()


def test_energy_is_no_more_than_that_of_the_best_path_on_a_grid():
    rng = np.random.default_rng(5)
    tx, v, t, u = planted(rng, 60, 0.25)
    u = u + rng.normal(0, 0.05, u.shape)
    u[7] = np.nan
    ends, how = (t[0], t[-1]), (0.02, 0.05, 200.0)
    start = np.linspace(*ends, len(u) + 2)[1:-1]
    got, m = elastic.fit(start, None, tx, v, u, ends, *how)
    grid = np.arange(ends[0] + 0.01, ends[1], 0.02)
    best, cost = cheapest(tx, v, u, m, ends, *how, grid), elastic.energy(got, m, tx, v, u, ends, *how)
    assert cost <= best + 1e-3 and cost < 0.2 * elastic.energy(start, m, tx, v, u, ends, *how)
    first = elastic.first_map(tx, v, u, ends, *how)
    assert elastic.energy(first, m, tx, v, u, ends, *how) < 10 * best + 1 and (np.diff(first) > 0).all()


def test_halving_keeps_waves_and_times(spark):
    rows = spark.createDataFrame([("x", i, 0.5 * i, float(np.sin(i / 9)), None) for i in range(101)] + [("y", 0, 0.0, 1.0, 2.0)], "k string, i long, t double, a double, b double")
    got = elastic.halved(rows, ["k"], "i", ["a", "b"], "t").orderBy("i").toPandas()
    assert len(got) == 50 and np.allclose(got.t, 0.5 * (2 * got.i + 1)) and got.b.isna().all()
    assert np.abs(got.a - np.sin((2 * got.i + 1) / 9)).max() < 0.05


def test_series_without_a_partner_are_left_out(spark):
    known = spark.createDataFrame([("x", 0, 0.0, 1.0), ("x", 1, 1.0, 2.0), ("y", 0, 0.0, 1.0)], "k string, i long, t double, v double")
    unknown = spark.createDataFrame([("x", 0, 1.5), ("y", 0, 1.0), ("z", 0, None)], "k string, i long, v double")
    ends = spark.createDataFrame([("x", 0.0, 1.0), ("y", 0.0, 1.0)], "k string, t0 double, t1 double")
    got = elastic.aligned(known, unknown, ["k"], "i", "t", ["v"], ends, 0.1, 0.0).collect()
    assert [r.k for r in got] == ["x"] and 0 < got[0].t < 1
    assert elastic.aligned(known, unknown.limit(0), ["k"], "i", "t", ["v"], ends, 0.1, 0.0).count() == 0
