"""Hulls by merging against brute force; least rectangles against all directions of pairs."""

from itertools import combinations, permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import geometry, hulls
from lumenframe.plans import catalog, hull_queries  # noqa: F401  (it adds to the catalog)


def sets(rng, k):
    for kind in range(5):
        n = rng.integers(1, 40)
        yield rng.normal(size=(n, k)) if kind == 0 else rng.integers(0, 4, (n, k)).astype(float) if kind == 1 else np.repeat(rng.normal(size=(1, k)), n, 0) if kind == 2 else (
            rng.normal(size=(n, 1)) @ rng.normal(size=(1, k)) if kind == 3 else np.round(rng.normal(size=(n, k)), 1)
        )


def outline_by_brute_force(p):
    """Points that some direction of a pair of points has alone, or at an end of what it has furthest out."""
    p = np.unique(p, axis=0)
    if len(p) < 3:
        return p
    out = set()
    for a, b in permutations(range(len(p)), 2):
        d = p[b] - p[a]
        side = d[0] * (p[:, 1] - p[a, 1]) - d[1] * (p[:, 0] - p[a, 0])
        if (side >= -1e-9).all():
            on = np.flatnonzero(np.abs(side) <= 1e-9)
            along = p[on] @ d
            out |= {on[along.argmin()], on[along.argmax()]}
    return p[sorted(out)]


def planes_by_brute_force(p):
    p, out = np.unique(p, axis=0), set()
    for i in combinations(range(len(p)), 3):
        n = np.cross(p[i[1]] - p[i[0]], p[i[2]] - p[i[0]])
        if np.linalg.norm(n) < 1e-9:
            continue
        n = n / np.linalg.norm(n)
        for s in (1, -1):
            if (s * (p @ n - p[i[0]] @ n) <= 1e-9).all():
                out.add(tuple(np.round(np.append(s * n, s * (p[i[0]] @ n)), 5) + 0.0))
    return out


def test_outlines_by_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(25):
        for p in sets(rng, 2):
            got = hulls.hull2d(p)
            assert {tuple(x) for x in got} == {tuple(x) for x in outline_by_brute_force(p)}
            if len(got) > 2:
                e = np.roll(got, -1, 0) - got
                assert (e[:, 0] * np.roll(e, -1, 0)[:, 1] - e[:, 1] * np.roll(e, -1, 0)[:, 0] > 0).all() and tuple(got[0]) == min(map(tuple, got))
    many = rng.normal(size=(3000, 2))
    assert {tuple(x) for x in hulls.hull2d(many)} == {tuple(x) for x in hulls.hull2d(np.concatenate([hulls.hull2d(many[i::7]) for i in range(7)]))}


def test_faces_by_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(12):
        for p in sets(rng, 3):
            v, planes = hulls.hull3d(p)
            u = np.unique(p, axis=0)
            assert (u @ planes[:, :3].T <= planes[:, 3] + 1e-7).all() and len(v) <= len(u)
            if hulls._frame(u)[0] == 3:
                assert {tuple(np.round(r, 5) + 0.0) for r in planes} == planes_by_brute_force(p)
                again, same = hulls.hull3d(np.concatenate([hulls.hull3d(u[::2])[0], hulls.hull3d(u[1::2])[0]]))
                assert np.array_equal(np.unique(again, axis=0), np.unique(v, axis=0)) and np.allclose(same, planes, atol=1e-6)


def test_a_lattice_and_a_ball():
    box = np.stack(np.meshgrid(range(7), range(5), range(4), indexing="ij"), -1).reshape(-1, 3).astype(float)
    v, planes = hulls.hull3d(box)
    assert len(planes) == 6 and len(v) == 8
    rng = np.random.default_rng(3)
    ball = rng.normal(size=(400, 3))
    ball /= np.linalg.norm(ball, axis=1)[:, None]
    v, planes = hulls.hull3d(np.concatenate([ball, 0.5 * ball]))
    assert len(v) == 400 and len(planes) == 2 * 400 - 4


def rectangle_by_brute_force(p, by):
    p, best = np.unique(p, axis=0), np.inf
    for a, b in combinations(range(len(p)), 2):
        d = (p[b] - p[a]) / np.linalg.norm(p[b] - p[a])
        w, h = np.ptp(p @ d), np.ptp(p @ np.array([-d[1], d[0]]))
        best = min(best, w * h if by == "area" else w + h)
    return best if len(p) > 1 else 0.0


@pytest.mark.parametrize("by", ["area", "perimeter"])
def test_rectangles_by_brute_force(by):
    rng = np.random.default_rng(4)
    for _ in range(25):
        for p in sets(rng, 2):
            angle, w, h, area = hulls.callipers(hulls.hull2d(p), by)
            assert (area if by == "area" else w + h) == pytest.approx(rectangle_by_brute_force(p, by), abs=1e-9) and area == pytest.approx(w * h) and 0 <= angle < np.pi / 2
            u, v = np.array([np.cos(angle), np.sin(angle)]), np.array([-np.sin(angle), np.cos(angle)])
            assert np.ptp(p @ u) <= w + 1e-7 and np.ptp(p @ v) <= h + 1e-7  # the box is where it says


def test_hulls_of_tables(spark):
    rng = np.random.default_rng(5)
    rows = [(k, float(x), float(y), float(z), "s") for k, n in (("a", 500), (None, 30), ("flat", 3)) for x, y, z in np.round(rng.normal(size=(n, 3)), 2)]
    df = spark.createDataFrame([*rows, ("a", None, 1.0, 1.0, "s"), ("a", float("nan"), 1.0, 1.0, "s"), ("b", None, None, None, "s")], "k string, x double, y double, z double, _s string").repartition(6)
    got = hulls.outline(df, ["k"], "x", "y").toPandas()
    for k in ("a", None, "flat"):
        mine = got[got.k.isna() if k is None else got.k == k].sort_values("place")
        assert np.allclose(mine[["x", "y"]], hulls.hull2d(np.array([r[1:3] for r in rows if r[0] == k])))
    assert set(got.k.dropna()) == {"a", "flat"} and len(hulls.outline(df, [], "x", "y").collect()) > 3
    planes = [tuple(r)[1:] for r in hulls.facets(df.where("k = 'a'"), ["k"], "x", "y", "z").collect()]
    a = df.where("k = 'a' and x is not null and not isnan(x)")
    slack = [(*r[:3], r[3] + 1e-9) for r in planes]
    assert a.where(geometry.in_hull(F.col("x"), F.col("y"), F.col("z"), slack)).count() == 500
    low, high = hulls.heights(F.col("x"), F.col("y"), planes)
    assert a.where((low - 1e-6 <= F.col("z")) & (F.col("z") <= high + 1e-6)).count() == 500
    edge = [tuple(r) for r in hulls.outline(a, [], "x", "y").orderBy("place").select("x", "y").collect()]
    assert a.where(hulls.over_outline(F.col("x"), F.col("y"), edge)).count() == 500 and a.where(hulls.over_outline(F.col("x") + 9, F.col("y"), edge)).count() == 0
    box = hulls.least_rectangle(a, ["k"], "x", "y").first()
    assert box.area == pytest.approx(rectangle_by_brute_force(np.array(edge), "area"))
    assert hulls.facets(df.limit(0), ["k"], "x", "y", "z").count() == 0


def test_masks_about_a_mean_that_is_a_rounding_tie(spark, tmp_path):
    tax = [5] * 3 + [4] * 77  # on average 4.0375, which SQL rounds to 4.037
    rows = [(1, 16.0 if i < 39 else 15.0, (6 if i < 17 else 5) / 100, z / 100) for i, z in enumerate(tax)]
    spark.createDataFrame(rows, "l_suppkey long, l_quantity double, l_discount double, l_tax double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.execute(f"SELECT voi, kind, ix, iy, iz FROM ({catalog.ORACLE_SQL['voi_masks']})").fetchall()
    got = catalog.QUERIES["voi_masks"](spark, str(tmp_path)).select("voi", "kind", "ix", "iy", "iz")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
