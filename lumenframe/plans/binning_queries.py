"""Registered queries of weighted bins, templates, regions and traces, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import binning, geometry, grid
from .acquisition_queries import _PHASED, _lens
from .catalog import _BINS, _DAILY, _E, _IN, _P, AXES, _daily, _events, _points, query

_M = [[0.9, -0.1, 0.0, 1.0], [0.1, 0.9, 0.0, 0.5], [0.0, 0.1, 1.0, -0.2]]
_AFFINE = "0.9e0 * x - 0.1e0 * y + 0.0 * z + 1 AS x, 0.1e0 * x + 0.9e0 * y + 0.0 * z + 0.5 AS y, 0.0 * x + 0.1e0 * y + 1.0e0 * z - 0.2 AS z"


@query(f"WITH {_P}, m AS (SELECT {_AFFINE}, d FROM p), b AS (SELECT {_BINS}, d FROM m) SELECT ix, iy, iz, round(sum(d), 2) AS n FROM b WHERE {_IN} GROUP BY ix, iy, iz")
def weighted_affine_bin(spark, sf_dir):
    return binning.affine_bins(_points(spark, sf_dir), AXES, F.col("d"), _M).withColumn("n", F.round("n", 2))


@query(f"{_PHASED}, m AS (SELECT x, y, 8 * cos(a) AS z, abs(sin(a)) / 0.7846 AS w FROM q), b AS (SELECT {_BINS}, w FROM m) SELECT ix, iy, iz, round(sum(w), 4) AS n FROM b WHERE {_IN} GROUP BY ix, iy, iz")
def photon_depth_bin(spark, sf_dir):
    return binning.photon_bins(_lens(spark, sf_dir), AXES, "a", 8.0).withColumn("n", F.round("n", 4))


@query(f"WITH {_P}, b AS (SELECT {_BINS}, d FROM p), v AS (SELECT ix, iy, sum(d) AS d FROM b WHERE ix BETWEEN 0 AND 9 AND iy BETWEEN 0 AND 5 GROUP BY ix, iy) SELECT ix, iy, iz, round(d / 9, 3) AS dwell FROM v, (SELECT unnest(range(9)) AS iz)")
def dwell_spread(spark, sf_dir):
    return binning.spread_dwell(_points(spark, sf_dir), AXES[:2], AXES[2][1], "d").withColumn("dwell", F.round("dwell", 3))


@query(f"{_PHASED}, b AS (SELECT {_BINS}, d, CAST(least(11, floor(a / (2 * pi()) * 12)) AS BIGINT) AS ip FROM q) SELECT ip, ix, iy, count(*) AS n, round(sum(d), 2) AS dwell FROM b WHERE ix BETWEEN 0 AND 9 AND iy BETWEEN 0 AND 5 GROUP BY ip, ix, iy")
def xy_phase_counts(spark, sf_dir):
    return binning.phase_bins(_lens(spark, sf_dir), AXES[:2], "a", 12, "d").withColumn("dwell", F.round("dwell", 2))


@query(f"""WITH {_P}, v AS (SELECT f, d, ((x - 5) * 30 + (y - 1) * 6) / sqrt(936) AS par, ((y - 1) * 30 - (x - 5) * 6) / sqrt(936) AS per FROM p)
SELECT f, CAST(least(9, floor(par / sqrt(936) * 10)) AS BIGINT) AS bin, round(max(d), 2) AS value FROM v WHERE par BETWEEN 0 AND sqrt(936) AND abs(per) <= 3 GROUP BY 1, 2""")
def along_region(spark, sf_dir):
    return binning.along_region(_points(spark, sf_dir), (5, 1), (35, 7), 3, 10, F.max("d"), ["f"]).withColumn("value", F.round("value", 2))


_R = "r AS (SELECT user_id, t AS a, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS nx FROM (SELECT DISTINCT user_id, t FROM e WHERE event_type = 'signup')), s AS (SELECT user_id, a, least(a + 86400000000, coalesce(nx, a + 86400000000)) AS b FROM r)"


@query(f"WITH {_E}, {_R} SELECT s.a AS range, CAST(floor(value / 50 + 1e-9) AS BIGINT) AS iv, count(*) AS n FROM e JOIN s ON e.user_id = s.user_id AND e.t >= a AND e.t < b WHERE value >= 0 AND value < 1000 AND event_type <> 'signup' GROUP BY 1, 2")
def counts_in_ranges(spark, sf_dir):
    e = _events(spark, sf_dir)
    w = Window.partitionBy("user_id").orderBy("t")
    r = e.where("event_type = 'signup'").select("user_id", "t").distinct().withColumn("n", F.lead("t").over(w))
    day = F.col("t") + 86400000000
    ranges = r.select("user_id", F.col("t").alias("start"), F.least(day, F.coalesce("n", day)).alias("end"), F.col("t").alias("range"))
    return binning.in_ranges(e.where("event_type <> 'signup'"), ranges, ["user_id"], "t", [("value", grid.Axis("v", 0, 50, 20))])


_POSE = "(VALUES ('A', 1.0e0, 2.0e0, 0.5e0), ('N', -1.0e0, 0.5e0, 0.25e0)) AS o(g, sx, sy, sz)"


@query(f"""WITH {_P}, s AS (SELECT f, x + sx AS x, y + sy AS y, z + sz AS z FROM p JOIN {_POSE} ON p.f = o.g), b AS (SELECT f, x, y, z, {_BINS} FROM s), d AS (SELECT DISTINCT f, ix, iy, iz FROM b WHERE ix BETWEEN 2 AND 6),
m AS (SELECT b.f, b.x + CASE WHEN d.f IS NOT NULL THEN b.iy / 4.0e0 ELSE 0 END AS x, b.y - CASE WHEN d.f IS NOT NULL THEN b.ix / 8.0e0 ELSE 0 END AS y, b.z - CASE WHEN d.f IS NOT NULL THEN 0.5e0 ELSE 0 END AS z FROM b LEFT JOIN d USING (f, ix, iy, iz)),
c AS (SELECT f, {_BINS} FROM m) SELECT f, ix, iy, iz, count(*) AS n FROM c WHERE {_IN} GROUP BY f, ix, iy, iz""")
def nonrigid_counts(spark, sf_dir):
    poses = spark.sql("SELECT * FROM VALUES ('A', 0D, 0D, 0D, 1D, 2D, 0.5D), ('N', 0D, 0D, 0D, -1D, 0.5D, 0.25D) AS o(f, az, ay, ax, tx, ty, tz)")
    p = _points(spark, sf_dir)
    moved = binning.registered.posed(p, poses, ["f"])
    for c, a in AXES:
        moved = moved.withColumn(f"i{a.name}", a.index(F.col(c)))
    field = moved.where("ix BETWEEN 2 AND 6").select("f", "ix", "iy", "iz").distinct().select("f", "ix", "iy", "iz", (F.col("ix") / 8).alias("tx"), (F.col("iy") / 4).alias("ty"), F.lit(0.5).alias("tz"))
    return binning.nonrigid_bins(p, poses, field, ["f"], AXES)


# ---------------------------------------------------------------- templates


_METRIC = f"WITH {_P}, k AS (SELECT l_orderkey AS frame, sum(d) AS m, l_orderkey % 5 AS chunk FROM p GROUP BY l_orderkey)"
_BEST = "r AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY m) AS i, count(*) OVER (PARTITION BY chunk) AS n FROM k), t AS (SELECT chunk, m AS least FROM r WHERE i = greatest(1, least(n, CAST(round(0.75 * n) AS BIGINT)))), b AS (SELECT frame FROM k JOIN t USING (chunk) WHERE m >= least)"


def _best(spark, sf_dir):
    m = _points(spark, sf_dir).groupBy(F.col("l_orderkey").alias("frame")).agg(F.sum("d").alias("m")).withColumn("m", F.round("m", 2)).withColumn("chunk", F.col("frame") % 5)
    return binning.best_frames(m, "m", 0.75, "chunk")


_METRIC = _METRIC.replace("sum(d) AS m", "round(sum(d), 2) AS m")


@query(f"{_METRIC}, {_BEST} SELECT frame FROM b")
def best_frames(spark, sf_dir):
    return _best(spark, sf_dir).select("frame")


@query(f"""{_METRIC}, {_BEST}, v AS (SELECT l_orderkey AS frame, {_BINS}, d FROM p), s AS (SELECT ix, iy, iz, count(*) AS counts, sum(d) AS dwell FROM v SEMI JOIN b USING (frame) WHERE {_IN} GROUP BY ix, iy, iz)
SELECT ix, iy, iz, counts, round(dwell, 2) AS dwell, round(greatest(counts / dwell * 1e6, 20), 4) AS rate FROM s""")
def template(spark, sf_dir):
    v = grid.bin_points(_points(spark, sf_dir).withColumnRenamed("l_orderkey", "frame"), AXES, {"counts": F.lit(1), "dwell": F.col("d")}, ["frame"])
    out = binning.template(v, _best(spark, sf_dir), ["frame"], ["ix", "iy", "iz"], 20e-6)
    return out.withColumn("dwell", F.round("dwell", 2)).withColumn("rate", F.round(F.col("rate") * 1e6, 4))


@query(f"WITH {_P}, b AS (SELECT {_BINS}, d - 20000 AS w FROM p) SELECT ix, iy, round(sum(w), 2) AS n, 3.5 + 5e0 * ix AS x, 1 + 2e0 * iy AS y FROM b WHERE ix BETWEEN 0 AND 9 AND iy BETWEEN 0 AND 5 GROUP BY ix, iy HAVING sum(w) > 0")
def occupied_voxels(spark, sf_dir):
    return binning.occupied(_points(spark, sf_dir), AXES[:2], F.col("d") - 20000).withColumn("n", F.round("n", 2))


@query(f"WITH {_P}, b AS (SELECT {_BINS} FROM p) SELECT ix // 2 AS ix, iy // 2 AS iy, count(*) AS n FROM b WHERE ix BETWEEN 0 AND 9 AND iy BETWEEN 0 AND 5 GROUP BY 1, 2")
def block_sums(spark, sf_dir):
    return binning.blocks(grid.bin_points(_points(spark, sf_dir), AXES[:2], {"n": F.lit(1)}), ["ix", "iy"], "n")


# ---------------------------------------------------------------- regions

_MASKS = f"WITH {_P}, b AS (SELECT {_BINS} FROM p), m AS (SELECT DISTINCT ix // 4 AS voi, ix, iy, iz FROM b WHERE {_IN})"


@query(f"{_MASKS} SELECT voi, round(avg(ix), 6) AS ix, round(avg(iy), 6) AS iy, round(avg(iz), 6) AS iz, count(*) AS voxels FROM m GROUP BY voi")
def voi_centres(spark, sf_dir):
    m = grid.bin_points(_points(spark, sf_dir), AXES, {"n": F.lit(1)}).withColumn("voi", F.floor(F.col("ix") / 4))
    out = binning.centres(m, ["voi"], ["ix", "iy", "iz"])
    return out.select("voi", *(F.round(a, 6).alias(a) for a in ("ix", "iy", "iz")), "voxels")


@query(f"WITH {_P}, m AS (SELECT f, avg(x) AS mx, avg(y) AS my FROM p GROUP BY f) SELECT l_orderkey, round(sum(x - mx), 4) AS x, round(sum(y - my), 4) AS y FROM p JOIN m USING (f) GROUP BY l_orderkey")
def relative_places(spark, sf_dir):
    out = binning.relative_places(_points(spark, sf_dir), ["f"], ["x", "y"])
    return out.groupBy("l_orderkey").agg(F.round(F.sum("x"), 4).alias("x"), F.round(F.sum("y"), 4).alias("y"))


@query(f"WITH {_P} SELECT l_partkey, round(avg(x), 6) AS x, round(atan2(avg(sin(y / 4)), avg(cos(y / 4))), 5) AS a FROM p GROUP BY l_partkey")
def overlapping_fits(spark, sf_dir):
    out = binning.one_per_time(_points(spark, sf_dir).withColumn("a", F.col("y") / 4), [], "l_partkey", ["x"], ["a"])
    return out.select("l_partkey", F.round("x", 6).alias("x"), F.round("a", 5).alias("a"))


@query(f"WITH {_P}, q AS (SELECT d, (x - 25) ** 2 + (y - 5) ** 2 + (z - 4) ** 2 AS s FROM p), r AS (SELECT unnest([4e0, 8e0, 12e0]) AS radius) SELECT radius, round(avg(d) FILTER (s < radius ** 2) - avg(d) FILTER (s >= radius ** 2 AND s < 2 ** (2 / 3e0) * radius ** 2), 3) AS contrast FROM q, r GROUP BY radius")
def radius_contrast(spark, sf_dir):
    return binning.radius_contrast(_points(spark, sf_dir), (25, 5, 4), [4, 8, 12], "d").withColumn("contrast", F.round("contrast", 3))


# ---------------------------------------------------------------- traces


@query(f"""WITH {_DAILY}, l AS (SELECT unnest([-1, 0, 1, 2]) AS lag), v AS (SELECT event_type, k AS event FROM d WHERE v > 3)
SELECT a.event_type, event, CAST(lag AS DOUBLE) AS lag, CASE WHEN p.k = n.k THEN p.v WHEN p.k IS NOT NULL AND n.k IS NOT NULL THEN round(p.v + (n.v - p.v) * (a.t - p.k) / (n.k - p.k), 6) END AS v
FROM (SELECT event_type, event, lag, event + lag AS t FROM v, l) a ASOF LEFT JOIN d p ON a.event_type = p.event_type AND a.t >= p.k ASOF LEFT JOIN d n ON a.event_type = n.event_type AND a.t <= n.k""")
def stimulus_aligned(spark, sf_dir):
    d = _daily(spark, sf_dir).withColumn("k", F.col("k").cast("double"))
    events = d.where("v > 3").withColumn("event", F.col("k").cast("long"))
    out = binning.around(events, d.select("event_type", "k", "v"), ["event_type"], "event", "k", "v", [-1.0, 0.0, 1.0, 2.0])
    return out.withColumn("v", F.round("v", 6))


_BOUTS = f"WITH {_E}, b AS (SELECT *, CAST(floor(t / 864000000000) AS BIGINT) AS bout FROM e WHERE value IS NOT NULL)"


@query(f"""{_BOUTS}, m AS (SELECT *, row_number() OVER (PARTITION BY user_id, bout ORDER BY value, t) AS i FROM b)
SELECT user_id, bout, min(value) AS least, max(value) AS most, round(avg(value) + 1e-7, 4) AS mean, round(max(value) - min(value), 4) AS range, max(t) - min(t) AS lasts, max(CASE WHEN i = 1 THEN t END) AS lowest_at FROM m GROUP BY 1, 2""")
def bout_summary(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("bout", F.floor(F.col("t") / 864000000000))
    out = binning.bouts(e, ["user_id"], "bout", "t", "value")
    return out.withColumn("mean", F.round(F.col("mean") + 1e-7, 4)).withColumn("range", F.round("range", 4))


@query(f"WITH {_P}, r AS (SELECT f, d, row_number() OVER (PARTITION BY f ORDER BY d) AS i, count(*) OVER (PARTITION BY f) AS n FROM p) SELECT f, CAST(k AS INT) AS k, d AS value FROM r, (SELECT unnest(range(1, 20)) AS k) WHERE i = greatest(1, least(n, CAST(round(k * n / 20) AS BIGINT)))")
def ventiles(spark, sf_dir):
    return binning.ventiles(_points(spark, sf_dir), ["f"], "d")


@query(f"""WITH {_E}, g AS (SELECT user_id, t, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS nx FROM (SELECT DISTINCT user_id, t FROM e WHERE event_type = 'signup'))
SELECT e.user_id, g.t AS cycle, CAST(floor((e.t - g.t) / (nx - g.t) * 8) AS BIGINT) AS bin, round(avg(value), 4) AS mean FROM e JOIN g ON e.user_id = g.user_id AND e.t >= g.t AND e.t < nx WHERE event_type <> 'signup' GROUP BY 1, 2, 3""")
def cycle_aligned(spark, sf_dir):
    e = _events(spark, sf_dir)
    out = binning.cycle_aligned(e.where("event_type <> 'signup'").select("user_id", "t", "value"), ["user_id"], "t", "value", e.where("event_type = 'signup'"), 8)
    return out.withColumn("mean", F.round("mean", 4))


@query(f"""WITH RECURSIVE {_P}, v0 AS (SELECT f, 0 AS i, list(d) AS v FROM p GROUP BY f), r AS (SELECT * FROM v0 UNION ALL SELECT f, i + 1, list_transform(v, lambda x: least(x, m)) FROM (SELECT f, i, v, list_avg(v) + list_stddev_samp(v) AS m FROM r WHERE i < 9))
SELECT f, round(list_avg(v), 2) AS mean, round(list_stddev_samp(v), 2) AS sd FROM r WHERE i = 9""")
def asymmetric_stats(spark, sf_dir):
    return binning.asymmetric_stats(_points(spark, sf_dir), ["f"], "d").select("f", F.round("mean", 2).alias("mean"), F.round("sd", 2).alias("sd"))
