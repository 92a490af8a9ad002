"""Peaks left by suppression in order of height, samples by hash, gaps of any length."""

import numpy as np

from lumenframe.operators import relations, segments


def left_by_order(points, apart):
    out = []
    for h, t in sorted(((h, -t) for t, h in points), reverse=True):
        if all(abs(-t - x) > apart for x, _ in out):
            out.append((-t, h))
    return sorted(out)


def test_greedy_peaks_are_those_of_the_order(spark):
    rng = np.random.default_rng(0)
    parts = {"random": [(float(t), float(h)) for t, h in zip(np.cumsum(rng.uniform(0.1, 2, 400)), rng.integers(0, 30, 400), strict=True)], "chain": [(float(t), float(t)) for t in range(40)], "level": [(float(t), 1.0) for t in range(30)], "one": [(-3.0, 2.0)]}
    rows = [(k, t, h, 1) for k, p in parts.items() for t, h in p] + [("random", None, 9.0, 1), ("random", 1.0, None, 1), ("one", -3.0, 2.0, 1)]
    df = spark.createDataFrame(rows, "k string, t double, h double, x int").repartition(3)
    got = relations.greedy_peaks(df, ["k"], "t", "h", 3.0, span=4).collect()
    for k, p in parts.items():
        assert sorted((r.t, r.h) for r in got if r.k == k) == left_by_order(p, 3.0)
    top = relations.greedy_peaks(df, ["k"], "t", "h", 3.0, 2, span=4).where("k = 'chain'").collect()
    assert sorted(r.t for r in top) == [35.0, 39.0]


def test_a_share_is_the_same_in_any_order_and_near_its_size(spark):
    rows = spark.range(20_000)
    a, b = (sorted(r.id for r in relations.share(x, ["id"], 0.25).collect()) for x in (rows, rows.repartition(7)))
    assert a == b and abs(len(a) / 20_000 - 0.25) < 0.02
    other = {r.id for r in relations.share(rows, ["id"], 0.25, seed=2).collect()}
    assert abs(len(other & set(a)) / 20_000 - 0.0625) < 0.01
    assert {r.id for r in relations.share(rows, ["id"], 0.1).collect()} <= set(a)


def test_long_gaps_are_filled_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(segments, "PIECE", 8)
    seen = [0, 1, 900, 902, 903, 910]
    got = sorted(r.c for r in segments.missing_counters(spark.createDataFrame([(x,) for x in [*seen, None, 1]], "c long"), "c").collect())
    assert got == [x for x in range(911) if x not in seen]
