"""Registered queries of phases, strides, extrema, reports and sparse volumes, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grid, registered, segments, volumes
from .catalog import _BINS, _DAILY, _E, _IN, _P, _SIDES, AXES, _daily, _events, _points, _t, query

_PERIODS = f"{_SIDES}, q AS (SELECT user_id, rt, lead(rt) OVER (PARTITION BY user_id ORDER BY rt) - rt AS period FROM r)"
_PHASE = f"{_PERIODS}, h AS (SELECT event_id, l.user_id, rt, 2 * pi() * (l.t - rt) / period AS phase FROM l ASOF LEFT JOIN q ON l.user_id = q.user_id AND l.t >= q.rt)"


def _phases(spark, sf_dir):
    e = _events(spark, sf_dir)
    return segments.tag_phase(e.where("event_type <> 'signup'").select("event_id", "user_id", "t", "value"), e.where("event_type = 'signup'"), ["user_id"], "t")


@query(f"{_PHASE} SELECT event_id, round(phase, 6) AS phase FROM h")
def tag_phase(spark, sf_dir):
    return _phases(spark, sf_dir).select("event_id", F.round("phase", 6).alias("phase"))


@query(f"""{_PHASE}, b AS (SELECT least(35, CAST(floor(phase / (2 * pi()) * 36) AS BIGINT)) AS bin, user_id, rt, value FROM h JOIN (SELECT event_id, value FROM events) USING (event_id) WHERE phase IS NOT NULL AND value IS NOT NULL),
s AS (SELECT user_id, rt, bin, avg(value) AS m FROM b GROUP BY user_id, rt, bin) SELECT bin, round(avg(m), 4) AS mean, count(*) AS strides FROM s GROUP BY bin""")
def phase_aligned(spark, sf_dir):
    return segments.phase_aligned(_phases(spark, sf_dir), ["user_id"], "t_right", "phase", "value").withColumn("mean", F.round("mean", 4))


@query(f"""WITH {_E}, f AS (SELECT CAST(floor(t / 86400000000.0) AS BIGINT) AS frame, t FROM e), s AS (SELECT frame, min(t) AS a, max(t) AS b FROM f GROUP BY frame)
SELECT frame, CAST(least(3, coalesce(floor(4 * (t - a) / CASE WHEN b > a THEN b - a END), 0)) AS BIGINT) AS sub, count(*) AS n FROM f JOIN s USING (frame) GROUP BY 1, 2""")
def subframe_counts(spark, sf_dir):
    f = _events(spark, sf_dir).select(F.floor(F.col("t") / 86400000000.0).alias("frame"), "t")
    return segments.subframes(f, "frame", "t").groupBy("frame", "sub").agg(F.count("*").alias("n"))


_EXTREMA = f"""{_DAILY}, x AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM d WINDOW w AS (PARTITION BY event_type ORDER BY k)),
y AS (SELECT event_type, k, v, CASE WHEN v > a AND v >= b THEN 'high' WHEN v < a AND v <= b THEN 'low' END AS kind FROM x)"""


@query(f"WITH {_EXTREMA} SELECT event_type, k, v, kind FROM y WHERE kind IS NOT NULL")
def local_extrema(spark, sf_dir):
    return segments.extrema(_daily(spark, sf_dir), ["event_type"], "k", "v")


@query(f"""WITH {_EXTREMA}, z AS (SELECT *, CASE WHEN kind = lag(kind) OVER w THEN 0 ELSE 1 END AS new FROM y WHERE kind IS NOT NULL WINDOW w AS (PARTITION BY event_type ORDER BY k)),
r AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY k ROWS UNBOUNDED PRECEDING) AS run FROM z),
n AS (SELECT *, row_number() OVER (PARTITION BY event_type, run ORDER BY CASE kind WHEN 'high' THEN -v ELSE v END, k) AS i FROM r) SELECT event_type, kind, k, v FROM n WHERE i = 1""")
def alternating_extrema(spark, sf_dir):
    return segments.alternating(segments.extrema(_daily(spark, sf_dir), ["event_type"], "k", "v"), ["event_type"], "k", "v")


@query(f"""WITH {_DAILY} SELECT event_type, k, last_value(CASE WHEN v <= 2 THEN k END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS quiet,
first_value(CASE WHEN v > 3 THEN k END IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS busy FROM d WINDOW w AS (PARTITION BY event_type ORDER BY k)""")
def last_and_next_where(spark, sf_dir):
    d = segments.last_where(_daily(spark, sf_dir), ["event_type"], "k", F.col("v") <= 2, "quiet")
    return segments.next_where(d, ["event_type"], "k", F.col("v") > 3, "busy").select("event_type", "k", "quiet", "busy")


_STILL = f"""{_DAILY}, s AS (SELECT event_type, k, abs(coalesce(lead(v) OVER w, 2 * v - lag(v) OVER w) - coalesce(lag(v) OVER w, 2 * v - lead(v) OVER w)) / 2 AS speed FROM d WINDOW w AS (PARTITION BY event_type ORDER BY k)),
o AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY speed) AS i, count(speed) OVER (PARTITION BY event_type) AS n FROM s WHERE speed IS NOT NULL),
q AS (SELECT event_type, speed AS slow FROM o WHERE i = greatest(1, least(n, CAST(round(0.4 * n) AS BIGINT)))),
g AS (SELECT event_type, k, speed <= slow AS still FROM s JOIN q USING (event_type)), h AS (SELECT *, lag(still) OVER (PARTITION BY event_type ORDER BY k) AS p FROM g),
j AS (SELECT *, CAST(sum(CASE WHEN still AND NOT coalesce(p, false) THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY k ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM h),
i AS (SELECT event_type, island, min(k) AS first, max(k) AS last, count(*) AS n FROM j WHERE still GROUP BY 1, 2)"""


@query(f"WITH {_STILL} SELECT * FROM i WHERE last - first >= 1")
def still_intervals(spark, sf_dir):
    return segments.still_intervals(_daily(spark, sf_dir), ["event_type"], "k", "v", 0.4, 1)


@query(f"WITH {_STILL}, r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, island) AS x FROM i WHERE last - first >= 1) SELECT event_type, first, last, n FROM r WHERE x = 1")
def longest_still(spark, sf_dir):
    return segments.longest_run(segments.still_intervals(_daily(spark, sf_dir), ["event_type"], "k", "v", 0.4, 1), ["event_type"])


_K = "PARTITION BY user_id ORDER BY t, event_id"


@query(f"""WITH {_E} SELECT event_id, coalesce(value >= max(value) OVER ({_K} ROWS UNBOUNDED PRECEDING) AND value <= min(value) OVER ({_K} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), false) AS valid,
round(median(value) OVER ({_K} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS med FROM e""")
def monotone_and_median(spark, sf_dir):
    e = segments.monotone(_events(spark, sf_dir), ["user_id"], ["t", "event_id"], "value")
    return segments.rolling_median(e, ["user_id"], ["t", "event_id"], "value", 2, "med").select("event_id", "valid", F.round("med", 6).alias("med"))


@query("""WITH s AS (SELECT l_orderkey, l_partkey - lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS s FROM lineitem)
SELECT l_orderkey, count(*) AS n, CAST(coalesce(sum(CASE WHEN s > 1 THEN s - 1 WHEN s IS NOT NULL THEN 0 END), 0) AS BIGINT) AS skipped, count(CASE WHEN s <= 0 THEN 1 END) AS back FROM s GROUP BY l_orderkey""")
def step_report(spark, sf_dir):
    return segments.step_report(_t(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_partkey", ["l_linenumber", "l_partkey"])


@query(f"WITH {_E}, c AS (SELECT DISTINCT CAST(floor(t / 300000000.0) AS BIGINT) AS counter FROM e) SELECT counter FROM (SELECT unnest(generate_series(min(counter), max(counter))) AS counter FROM c) WHERE counter NOT IN (SELECT counter FROM c)")
def missing_counters(spark, sf_dir):
    return segments.missing_counters(_events(spark, sf_dir).select(F.floor(F.col("t") / 300000000.0).alias("counter")), "counter")


@query(f"""WITH {_E}, a AS (SELECT * FROM e ORDER BY value DESC NULLS LAST, event_id LIMIT 1), b AS (SELECT e.* FROM e, a WHERE abs(e.t - a.t) >= 86400000000 ORDER BY e.value DESC NULLS LAST, e.event_id LIMIT 1)
SELECT event_id, t, value FROM a UNION ALL SELECT event_id, t, value FROM b""")
def strongest_two(spark, sf_dir):
    return segments.strongest_two(_events(spark, sf_dir).select("event_id", "t", "value"), "t", "value", "event_id", 86400000000)


@query("SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) UNION ALL SELECT doc_id, 0 AS quality FROM labels WHERE toxic = 1")
def upsert_rows(spark, sf_dir):
    old = _t(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return segments.upsert(old.drop("toxic"), old.where("toxic = 1").select("doc_id", F.lit(0).alias("quality")), ["doc_id"])


_A = "p2 AS (SELECT *, 2 * pi() * (l_partkey % 360) / 360 AS a FROM p)"


@query(f"""WITH {_P}, {_A} SELECT f, round(atan2(avg(sin(a)), avg(cos(a))), 5) AS polar, round(0.5 * atan2(2 * covar_pop(d, x * 1000), var_pop(d) - var_pop(x * 1000)), 5) AS principal,
round(sum(sin(a)), 3) AS s1, round(sum(cos(a)), 3) AS c1, round(sum(sin(2 * a)), 3) AS s2, round(sum(cos(2 * a)), 3) AS c2, count(*) AS n FROM p2 GROUP BY f""")
def phase_moments(spark, sf_dir):
    p = _points(spark, sf_dir).withColumn("a", F.lit(segments.TURN) * (F.col("l_partkey") % 360) / 360).withColumn("xs", F.col("x") * 1000)
    total = lambda c, out: F.round(F.sum(c), 3).alias(out)
    return p.groupBy("f").agg(
        F.round(segments.polar_mean("a"), 5).alias("polar"), F.round(segments.principal_angle("d", "xs"), 5).alias("principal"), total(F.sin("a"), "s1"), total(F.cos("a"), "c1"),
        total(F.sin(2 * F.col("a")), "s2"), total(F.cos(2 * F.col("a")), "c2"), F.count("*").alias("n"),
    )


# ---------------------------------------------------------------- sparse volumes

_MASK = f"WITH {_P}, b AS (SELECT {_BINS} FROM p), v AS (SELECT ix, iy, count(*) AS n FROM b WHERE ix BETWEEN 0 AND 9 AND iy BETWEEN 0 AND 5 GROUP BY ix, iy), m AS (SELECT ix, iy FROM v WHERE n % 4 <> 0)"
_BOX = "(SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy)"


def _counted(spark, sf_dir):
    return grid.bin_points(_points(spark, sf_dir), AXES[:2], {"n": F.lit(1)})


def _mask(spark, sf_dir):
    return _counted(spark, sf_dir).where("n % 4 <> 0").select("ix", "iy")


@query(f"{_MASK} SELECT DISTINCT ix + dx AS ix, iy + dy AS iy FROM m, {_BOX}")
def dilate_mask(spark, sf_dir):
    return volumes.dilate(_mask(spark, sf_dir), ["ix", "iy"])


@query(f"{_MASK}, g AS (SELECT DISTINCT ix + dx AS ix, iy + dy AS iy FROM m, {_BOX}), s AS (SELECT ix + dx AS ix, iy + dy AS iy FROM g, {_BOX}) SELECT ix, iy FROM s GROUP BY ix, iy HAVING count(*) = 9")
def close_mask(spark, sf_dir):
    return volumes.closed(_mask(spark, sf_dir), ["ix", "iy"])


@query(f"""{_MASK}, k(o, w) AS (VALUES (-1, 0.25e0), (0, 0.5e0), (1, 0.25e0)), g AS (SELECT ix, iy, coalesce(n, 0) AS n FROM (SELECT * FROM (SELECT unnest(range(10)) AS ix), (SELECT unnest(range(6)) AS iy)) LEFT JOIN v USING (ix, iy)),
o AS (SELECT a.ix, a.iy, kx.w * ky.w * b.n AS c FROM (SELECT ix, iy FROM g) a, k kx, k ky, g b WHERE b.ix = greatest(0, least(9, a.ix - kx.o)) AND b.iy = greatest(0, least(5, a.iy - ky.o)))
SELECT ix, iy, round(sum(c), 4) AS n FROM o GROUP BY ix, iy HAVING sum(c) > 0""")
def blur_volume(spark, sf_dir):
    kernel = [(-1, 0.25), (0, 0.5), (1, 0.25)]
    out = volumes.convolve(_counted(spark, sf_dir), {"ix": 10, "iy": 6}, "n", {"ix": kernel, "iy": kernel})
    return out.where("n > 0").withColumn("n", F.round("n", 4))


# ---------------------------------------------------------------- registered volumes

_POSES = "(VALUES ('A', 0.3e0, 0.1e0, -0.2e0, 1.0e0, 2.0e0, 3.0e0), ('N', -0.4e0, 0.2e0, 0.1e0, 0.5e0, 1.5e0, 2.5e0))"
_VOLUME = f"WITH {_P}, b AS (SELECT f, {_BINS}, d FROM p), v AS (SELECT f, ix, iy, iz, count(*) AS counts, sum(d) AS dwell, max(1 + ix / 10.0e0) AS gain FROM b WHERE {_IN} GROUP BY f, ix, iy, iz)"
_VOIS = "m AS (SELECT DISTINCT ix // 4 AS voi, ix, iy, iz FROM v WHERE (ix - 4) * (ix - 4) + (iy - 3) * (iy - 3) < 9 UNION SELECT 9, ix, iy, iz FROM v WHERE iz < 4)"


def _volume(spark, sf_dir):
    binned = grid.bin_points(_points(spark, sf_dir), AXES, {"counts": F.lit(1), "dwell": F.col("d")}, ["f"])
    return binned.withColumn("gain", 1 + F.col("ix") / 10.0)


def _vois(volume):
    disc = volume.where("(ix - 4) * (ix - 4) + (iy - 3) * (iy - 3) < 9").select(F.floor(F.col("ix") / 4).alias("voi"), "ix", "iy", "iz")
    return disc.unionByName(volume.where("iz < 4").select(F.lit(9).cast("long").alias("voi"), "ix", "iy", "iz"))


@query(f"""WITH {_P}, c AS (SELECT p.*, o.* FROM p JOIN {_POSES} AS o(g, az, ay, ax, tx, ty, tz) ON p.f = o.g),
r AS (SELECT f, d, z, az, ay, ax, tx, ty, tz, cos(az) * x - sin(az) * y AS x1, sin(az) * x + cos(az) * y AS y1 FROM c),
s AS (SELECT f, d, ay, tx, ty, tz, x1, cos(ax) * y1 - sin(ax) * z AS y2, sin(ax) * y1 + cos(ax) * z AS z2 FROM r),
q AS (SELECT f, d, cos(ay) * x1 + sin(ay) * z2 + tx AS x, y2 + ty AS y, -sin(ay) * x1 + cos(ay) * z2 + tz AS z FROM s),
b AS (SELECT f, d, {_BINS} FROM q) SELECT f, ix, iy, iz, count(*) AS counts, round(sum(d), 2) AS dwell FROM b WHERE {_IN} GROUP BY f, ix, iy, iz""")
def posed_counts(spark, sf_dir):
    poses = spark.sql("SELECT * FROM VALUES ('A', 0.3D, 0.1D, -0.2D, 1D, 2D, 3D), ('N', -0.4D, 0.2D, 0.1D, 0.5D, 1.5D, 2.5D) AS o(f, az, ay, ax, tx, ty, tz)")
    out = grid.bin_points(registered.posed(_points(spark, sf_dir), poses, ["f"]), AXES, {"counts": F.lit(1), "dwell": F.col("d")}, ["f"])
    return out.withColumn("dwell", F.round("dwell", 2))


@query(f"""{_VOLUME}, {_VOIS}, s AS (SELECT voi, count(*) AS voxels FROM m GROUP BY voi)
SELECT f, voi, round(1e6 * sum(gain * counts / dwell) / any_value(voxels), 6) AS rate, any_value(voxels) AS voxels FROM v JOIN m USING (ix, iy, iz) JOIN s USING (voi) GROUP BY f, voi""")
def voi_rates(spark, sf_dir):
    v = _volume(spark, sf_dir)
    out = registered.voi_rates(v, _vois(v), ["f"], ["voi"], ["ix", "iy", "iz"], "gain")
    return out.withColumn("rate", F.round(F.col("rate") * 1e6, 6))


@query(f"""{_VOLUME}, {_VOIS} SELECT f, voi, sum(counts) AS counts, round(sum(dwell), 2) AS dwell, round(sum(counts * gain), 4) AS counts_gained, round(sum(dwell / gain), 2) AS dwell_gained
FROM v JOIN m USING (ix, iy, iz) GROUP BY f, voi""")
def voi_sums(spark, sf_dir):
    v = _volume(spark, sf_dir)
    out = registered.voi_sums(v, _vois(v), ["f"], ["voi"], ["ix", "iy", "iz"], "gain")
    return out.withColumns({"dwell": F.round("dwell", 2), "counts_gained": F.round("counts_gained", 4), "dwell_gained": F.round("dwell_gained", 2)})


@query(f"{_VOLUME} SELECT f, ix, iy, sum(counts) AS counts, round(sum(dwell), 2) AS dwell FROM v WHERE iz BETWEEN 2 AND 5 GROUP BY f, ix, iy")
def plane_in_time(spark, sf_dir):
    return registered.plane_in_time(_volume(spark, sf_dir), ["f"], ["ix", "iy"], "iz", 2, 5).withColumn("dwell", F.round("dwell", 2))
