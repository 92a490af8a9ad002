"""Registered queries of hulls, least rectangles and regions, each beside its SQL where SQL can state it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import binning, geometry, hulls
from .catalog import _P, AXES, _points, _t, query

#: Of each colour the points that a hull in the plane can have: the least and the greatest y of each x.
_RIM = "q AS (SELECT f, x, min(y) AS y FROM p GROUP BY f, x UNION SELECT f, x, max(y) FROM p GROUP BY f, x)"


@query(f"""WITH {_P}, {_RIM}, w AS (SELECT a.f, atan2(b.y - a.y, b.x - a.x) AS t FROM q a JOIN q b ON a.f = b.f AND (a.x < b.x OR a.x = b.x AND a.y < b.y) GROUP BY 1, 2),
r AS (SELECT w.f, t, max(cos(t) * x + sin(t) * y) - min(cos(t) * x + sin(t) * y) AS w, max(cos(t) * y - sin(t) * x) - min(cos(t) * y - sin(t) * x) AS h FROM w JOIN q USING (f) GROUP BY w.f, t) SELECT f, round(min(w * h), 6) AS area FROM r GROUP BY f""")
def least_rectangle(spark, sf_dir):
    """The least area of a rectangle around each colour's points; SQL tries the directions of all pairs."""
    return hulls.least_rectangle(_points(spark, sf_dir), ["f"], "x", "y").select("f", F.round("area", 6).alias("area"))


@query(f"""WITH {_P}, {_RIM}, e AS (SELECT a.f, a.x, a.y, b.x AS u, b.y AS v FROM q a JOIN q b ON a.f = b.f AND (a.x <> b.x OR a.y <> b.y) JOIN q c ON c.f = a.f GROUP BY ALL HAVING min((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)) >= -1e-6),
n AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY f, x, y ORDER BY (u - x) ** 2 + (v - y) ** 2 DESC) = 1), m AS (SELECT f, u, v FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY f, u, v ORDER BY (u - x) ** 2 + (v - y) ** 2 DESC) = 1))
SELECT f, round(x, 6) AS x, round(y, 6) AS y FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.f = n.f AND (e.x <> n.x OR e.y <> n.y) AND (e.u <> n.x OR e.v <> n.y) AND abs((e.u - e.x) * (n.y - e.y) - (e.v - e.y) * (n.x - e.x)) < 1e-6 AND (n.x - e.x) * (n.x - e.u) + (n.y - e.y) * (n.y - e.v) < 0)""")
def hull_outline(spark, sf_dir):
    """Vertices of the hull of each colour's points in the plane."""
    return hulls.outline(_points(spark, sf_dir), ["f"], "x", "y").select("f", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


_WAYS = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if i or j or k]


@query(f"""WITH {_P}, w AS (SELECT * FROM (VALUES {", ".join(map(str, _WAYS))}) t(i, j, k)) SELECT f, CAST(i AS INT) AS i, CAST(j AS INT) AS j, CAST(k AS INT) AS k, round(max(i * x + j * y + k * z), 6) AS reach FROM p, w GROUP BY f, i, j, k""")
def hull_reach(spark, sf_dir):
    """How far each colour's hull in space reaches in 26 directions, from its vertices; SQL asks all points."""
    v = hulls.vertices(_points(spark, sf_dir), ["f"], ["x", "y", "z"])
    ways = F.inline(F.array(*(F.struct(*(F.lit(n).alias(a) for n, a in zip(w, "ijk", strict=True))) for w in _WAYS)))
    far = F.max(F.col("i") * F.col("x") + F.col("j") * F.col("y") + F.col("k") * F.col("z"))
    return v.select("f", "x", "y", "z", ways).groupBy("f", "i", "j", "k").agg(F.round(far, 6).alias("reach"))


@query()
def hull_facets(spark, sf_dir):
    """The faces of the hull of all points of each colour."""
    return hulls.facets(_points(spark, sf_dir), ["f"], "x", "y", "z")


_CENTRES = "c AS (SELECT l_suppkey AS voi, round(avg(l_quantity), 3) AS cx, round(avg(l_discount * 100), 3) AS cy, round(avg(l_tax * 100), 3) AS cz FROM lineitem GROUP BY l_suppkey)"
_GRID = "g AS (SELECT ix, iy, iz, 1 + 5 * (ix + 0.5e0) AS x, 2 * (iy + 0.5e0) AS y, iz + 0.5e0 AS z FROM (SELECT unnest(range(10)) AS ix), (SELECT unnest(range(6)) AS iy), (SELECT unnest(range(9)) AS iz))"


@query(f"""WITH {_CENTRES}, {_GRID} SELECT voi, 'sphere' AS kind, ix, iy, iz FROM c, g WHERE (x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2 < 49 UNION ALL SELECT voi, 'cylinder', ix, iy, iz FROM c, g WHERE (x - cx) ** 2 + (y - cy) ** 2 < 36 AND abs(z - cz) < 2.2
UNION ALL SELECT voi, 'wedge', ix, iy, iz FROM c, g WHERE x + y <= cx + cy AND -x <= 6.3 - cx AND z <= cz + 0.7""")
def voi_masks(spark, sf_dir):
    """Voxels of a sphere, a cylinder and a wedge about the mean place of each supplier's points."""
    t = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("voi"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_tax") * 100).alias("z"))
    mean = lambda a: F.round(F.avg(a) * 1000) / 1000  # noqa: E731  as SQL rounds: 4.0375 becomes 4.037, since its product with 1000 is below 4037.5
    centres = t.groupBy("voi").agg(*(mean(a).alias(f"c{a}") for a in "xyz"))
    (x, y, z), at = (F.col(a) for a in "xyz"), tuple(F.col(f"c{a}") for a in "xyz")
    kinds = {
        "sphere": geometry.in_sphere(x, y, z, at, 7),
        "cylinder": geometry.in_cylinder(x, y, z, at, 6, 2.2),
        "wedge": geometry.in_hull(x, y, z, [(1, 1, 0, at[0] + at[1]), (-1, 0, 0, 6.3 - at[0]), (0, 0, 1, at[2] + 0.7)]),
    }
    return binning.region_masks(centres, ["voi"], [a for _, a in AXES], kinds)
