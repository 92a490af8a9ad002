"""Registered queries of fits of frames and of curves, each beside its SQL where SQL can state it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import curves, grid, nonrigid, registration
from .catalog import _P, _points, _t, query

_ROUNDS = 3


def _line(r: int) -> str:
    """SQL of one round of weighted least squares of d by x and f, from the line of the round before."""
    w = "1e0" if not r else f"1 / greatest(abs(d - c{r - 1}.c0 - c{r - 1}.c1 * x), 1e-6)"
    join = f" JOIN c{r - 1} USING (f)" if r else ""
    sums = ", ".join(f"sum(w * {e}) AS {n}" for n, e in (("m0", "1"), ("m1", "x"), ("m2", "x * x"), ("y0", "d"), ("y1", "x * d")))
    return f"c{r} AS (SELECT f, (y0 * m2 - y1 * m1) / (m0 * m2 - m1 * m1) AS c0, (y1 * m0 - y0 * m1) / (m0 * m2 - m1 * m1) AS c1 FROM (SELECT f, {sums} FROM (SELECT p.*, {w} AS w FROM p{join}) GROUP BY f))"


@query(f"WITH {_P}, {', '.join(_line(r) for r in range(_ROUNDS + 1))} SELECT f, round(c0, 2) AS c0, round(c1, 3) AS c1, count(*) AS n, round(sum(abs(d - c0 - c1 * x)), 0) AS deviation FROM p JOIN c{_ROUNDS} USING (f) GROUP BY f, c0, c1")
def least_deviation(spark, sf_dir):
    """The line of least absolute deviation of price by quantity, of each colour."""
    out = curves.least_deviation(_points(spark, sf_dir), ["f"], "x", "d", 1, _ROUNDS)
    return out.select("f", F.round("c0", 2).alias("c0"), F.round("c1", 3).alias("c1"), "n", F.round("deviation", 0).alias("deviation"))


@query()
def curve_fit(spark, sf_dir):
    """Price as a power of quantity, under a cost that grows linearly far off."""
    p = _points(spark, sf_dir).withColumn("y", F.col("d") / 1000)
    at, cost = curves.fitted(p, "y", lambda a: a[0] * F.pow(F.col("x"), a[1]), lambda e: F.sqrt(1 + e * e) - 1, [1.0, 1.0], [0.01, -2.0], [1000.0, 3.0], 30)
    return spark.createDataFrame([(float(at[0]), float(at[1]), cost)], "scale double, power double, cost double")


_CELL = "CAST(floor((l_quantity - 1) / 13) AS BIGINT) AS i, CAST(floor(l_discount * 100 / 3 + 1e-9) AS BIGINT) AS j, CAST(floor(l_tax * 100 / 3 + 1e-9) AS BIGINT) AS k"
_PAIRS = ", ".join(map(str, nonrigid.PAIRS))


@query(f"""WITH c AS (SELECT l_returnflag AS f, {_CELL}, avg(l_quantity - 25) AS dx, avg(l_discount * 100 - 5) AS dy, avg(l_tax * 100 - 4) AS dz FROM lineitem GROUP BY ALL), o AS (SELECT * FROM (VALUES {_PAIRS}) t(a, b, c)),
s AS (SELECT n.f, (a * 13e0 * (m.dx - n.dx) + b * 3e0 * (m.dy - n.dy) + o.c * 3e0 * (m.dz - n.dz)) / (a * 169e0 + b * 9e0 + o.c * 9e0) AS e FROM c n, o, c m WHERE m.f = n.f AND m.i = n.i + a AND m.j = n.j + b AND m.k = n.k + o.c)
SELECT f, (SELECT round(sum(e * e) / 2, 5) FROM s WHERE s.f = c.f) AS spring, round(sum(dx * dx + dy * dy + dz * dz) / 200, 5) AS anchor FROM c GROUP BY f""")
def lattice_energies(spark, sf_dir):
    """Springs and anchors of a lattice of each colour, whose shifts are the cells' mean places."""
    c = F.col
    p = _points(spark, sf_dir).withColumns({"i": F.floor((c("x") - 1) / 13), "j": F.floor(c("y") / 3 + 1e-9), "k": F.floor(c("z") / 3 + 1e-9)})
    nodes = p.groupBy("f", "i", "j", "k").agg(F.avg(c("x") - 25).alias("dx"), F.avg(c("y") - 5).alias("dy"), F.avg(c("z") - 4).alias("dz"))
    out = nonrigid.lattice_energies(nodes, ["f"], ("i", "j", "k"), ("dx", "dy", "dz"), (13.0, 3.0, 3.0), 10.0)
    return out.select("f", F.round("spring", 5).alias("spring"), F.round("anchor", 5).alias("anchor"))


def _template(spark, sf_dir) -> np.ndarray:
    """Prices by quantity, discount and tax, one voxel each, as a dense array of the axes' sizes."""
    axes = [("x", grid.Axis("x", 0.5, 1, 50)), ("y", grid.Axis("y", -0.5, 1, 11)), ("z", grid.Axis("z", -0.5, 1, 9))]
    v = grid.bin_points(_points(spark, sf_dir), axes, {"v": F.col("d")}).toPandas()  # at most 4,950 voxels
    out = np.zeros((50, 11, 9))
    out[v["ix"], v["iy"], v["iz"]] = v["v"]
    return out / out.mean()


@query()
def free_form_fit(spark, sf_dir):
    """Shifts of a lattice that bring all points of one colour to where prices are high."""
    p = _points(spark, sf_dir).where("f = 'R'").select((F.col("x") - 1).alias("x"), "y", "z")
    seen = p.groupBy("x", "y", "z").agg(F.count("*").alias("n"))
    nodes, value = nonrigid.bent_volume(seen, ("x", "y", "z"), _template(spark, sf_dir), [(4, 3, 3)], "n", steps=8)
    return nodes.withColumn("value", F.lit(value))


@query()
def registered_frames(spark, sf_dir):
    """Poses of frames, the months of delivery, to the prices' template: segments of a year, joined where they overlap."""
    c = F.col
    months = F.months_between(F.trunc("l_shipdate", "month"), F.lit("1992-01-01").cast("date")).cast("long")
    p = _t(spark, sf_dir, "lineitem").select(months.alias("frame"), (c("l_quantity") - 1).alias("x"), (c("l_discount") * 100).alias("y"), (c("l_tax") * 100).alias("z"))
    out, _ = registration.stitched(p, "frame", ("x", "y", "z"), _template(spark, sf_dir), width=12, half=2)
    return out
