"""Registered queries of the analytics operators, each beside the SQL that states it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bits
from ..functions.shared import reachable
from ..operators import estimators, geometry, grid, stats, temporal

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("""
WITH p AS (SELECT CAST(floor((l_quantity - 1) / 5.0) AS BIGINT) AS ix, CAST(floor(l_discount * 100 / 2.0 + 1e-9) AS BIGINT) AS iy,
                  l_returnflag AS f, l_extendedprice AS d FROM lineitem)
SELECT ix, iy, CAST(sum(CASE WHEN f = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS counts, round(sum(d), 2) AS dwell,
       CASE WHEN sum(d) >= 1 THEN round(sum(CASE WHEN f = 'R' THEN 1 ELSE 0 END) * 1e6 / sum(d), 4) ELSE 0.0 END AS rate
FROM p WHERE ix BETWEEN 0 AND 9 AND iy BETWEEN 0 AND 5 GROUP BY ix, iy
""")
def rate_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.floor((F.col("l_quantity") - 1) / 5).alias("ix"), F.floor(F.col("l_discount") * 100 / 2 + 1e-9).alias("iy"), F.col("l_returnflag").alias("f"), F.col("l_extendedprice").alias("d")
    )
    n, d = F.sum(F.when(F.col("f") == "R", 1).otherwise(0)), F.sum("d")
    return p.where(F.col("ix").between(0, 9) & F.col("iy").between(0, 5)).groupBy("ix", "iy").agg(n.alias("counts"), F.round(d, 2).alias("dwell"), F.when(d >= 1, F.round(n * 1e6 / d, 4)).otherwise(0.0).alias("rate"))


# ---------------------------------------------------------------- bindings


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with t, microseconds as a long."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return _t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", us.alias("t"))


_E = "e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS t FROM events)"
_P = "p AS (SELECT l_orderkey, l_partkey, l_quantity AS x, l_discount * 100 AS y, l_tax * 100 AS z, l_returnflag AS f, l_extendedprice AS d FROM lineitem)"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", c("l_quantity").alias("x"), (c("l_discount") * 100).alias("y"), (c("l_tax") * 100).alias("z"), c("l_returnflag").alias("f"), c("l_extendedprice").alias("d"))


AXES = [("x", grid.Axis("x", 1, 5, 10)), ("y", grid.Axis("y", 0, 2, 6)), ("z", grid.Axis("z", 0, 1, 9))]
_BINS = "CAST(floor((x - 1) / 5.0 + 1e-9) AS BIGINT) AS ix, CAST(floor(y / 2.0 + 1e-9) AS BIGINT) AS iy, CAST(floor(z / 1.0 + 1e-9) AS BIGINT) AS iz"
_IN = "ix BETWEEN 0 AND 9 AND iy BETWEEN 0 AND 5 AND iz BETWEEN 0 AND 8"


# ---------------------------------------------------------------- grids


@query(f"WITH {_P}, b AS (SELECT {_BINS} FROM p) SELECT ix, iy, count(*) AS n FROM b WHERE ix BETWEEN 0 AND 9 AND iy BETWEEN 0 AND 5 GROUP BY ix, iy")
def bin2d_counts(spark, sf_dir):
    return grid.bin_points(_points(spark, sf_dir), AXES[:2], {"n": F.lit(1)})


@query(f"WITH {_P}, b AS (SELECT {_BINS}, f FROM p) SELECT f, ix, iy, iz, count(*) AS n FROM b WHERE {_IN} GROUP BY f, ix, iy, iz")
def bin4d_counts(spark, sf_dir):
    return grid.bin_points(_points(spark, sf_dir), AXES, {"n": F.lit(1)}, ["f"])


@query(f"""WITH {_P}, b AS (SELECT {_BINS} FROM p), v AS (SELECT * FROM b WHERE {_IN})
SELECT 'xy' AS plane, ix AS a, iy AS b, count(*) AS total FROM v GROUP BY ix, iy UNION ALL SELECT 'xz', ix, iz, count(*) FROM v GROUP BY ix, iz UNION ALL SELECT 'yz', iy, iz, count(*) FROM v GROUP BY iy, iz""")
def projections_xy_xz_yz(spark, sf_dir):
    return grid.projections(grid.bin_points(_points(spark, sf_dir), AXES, {"n": F.lit(1)}), "n")


@query(f"""WITH {_P}, b AS (SELECT {_BINS} FROM p), v AS (SELECT ix, iy, count(*) AS n FROM b WHERE ix BETWEEN 0 AND 9 AND iy BETWEEN 0 AND 5 GROUP BY ix, iy)
SELECT x.i AS ix, y.i AS iy, coalesce(n, 0) AS n FROM range(10) AS x(i) CROSS JOIN range(6) AS y(i) LEFT JOIN v ON v.ix = x.i AND v.iy = y.i""")
def dense_image(spark, sf_dir):
    return grid.densify(grid.bin_points(_points(spark, sf_dir), AXES[:2], {"n": F.lit(1)}), [AXES[0][1], AXES[1][1]], ["n"])


@query(f"""WITH {_P}, b AS (SELECT {_BINS} FROM p), v AS (SELECT ix, iy, count(*) AS n FROM b WHERE ix BETWEEN 0 AND 9 AND iy BETWEEN 0 AND 5 GROUP BY ix, iy)
SELECT ix, iy, n, CAST(row_number() OVER (ORDER BY n DESC, ix, iy) AS INTEGER) AS rank FROM v""")
def bin_rank(spark, sf_dir):
    return grid.bin_rank(grid.bin_points(_points(spark, sf_dir), AXES[:2], {"n": F.lit(1)}), "n", ["ix", "iy"])


@query(f"""WITH {_P}, b AS (SELECT {_BINS} FROM p), v AS (SELECT ix, iy, iz, count(*) AS n FROM b WHERE {_IN} GROUP BY ix, iy, iz),
w AS (SELECT *, row_number() OVER (ORDER BY n DESC, ix, iy, iz) AS r, sum(n) OVER (ORDER BY n DESC, ix, iy, iz) AS upto, count(*) OVER () AS c, sum(n) OVER () AS s FROM v)
SELECT ix, iy, iz, n FROM w WHERE upto < 0.25 * s AND r <= 0.05 * c""")
def top_bins_quarter(spark, sf_dir):
    return grid.top_share(grid.bin_points(_points(spark, sf_dir), AXES, {"n": F.lit(1)}), "n", ["ix", "iy", "iz"])


# ---------------------------------------------------------------- joins on a clock


def _sides(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.where("event_type <> 'signup'").select("event_id", "user_id", "t"), e.where("event_type = 'signup'").groupBy("user_id", "t").agg(F.max("value").alias("value"))


_SIDES = f"WITH {_E}, l AS (SELECT event_id, user_id, t FROM e WHERE event_type <> 'signup'), r AS (SELECT user_id, t AS rt, max(value) AS value FROM e WHERE event_type = 'signup' GROUP BY user_id, t)"


@query(f"{_SIDES} SELECT event_id, l.user_id, l.t, rt AS t_right, value FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.t >= r.rt")
def asof_prev(spark, sf_dir):
    return temporal.asof_join(*_sides(spark, sf_dir), ["user_id"], "t", ["value"], "previous")


@query(f"{_SIDES} SELECT event_id, l.user_id, l.t, rt AS t_right, value FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.t <= r.rt")
def asof_next(spark, sf_dir):
    return temporal.asof_join(*_sides(spark, sf_dir), ["user_id"], "t", ["value"], "next")


_BOTH = """, b AS (SELECT event_id, l.user_id, l.t, p.rt AS pt, p.value AS pv FROM l ASOF LEFT JOIN r AS p ON l.user_id = p.user_id AND l.t >= p.rt),
c AS (SELECT b.*, n.rt AS nt, n.value AS nv FROM b ASOF LEFT JOIN r AS n ON b.user_id = n.user_id AND b.t <= n.rt)"""


@query(f"{_SIDES}{_BOTH} SELECT event_id, user_id, t, CASE WHEN pt IS NULL OR nt - t <= t - pt THEN nt ELSE pt END AS t_right, CASE WHEN pt IS NULL OR nt - t <= t - pt THEN nv ELSE pv END AS value FROM c")
def asof_nearest(spark, sf_dir):
    return temporal.asof_join(*_sides(spark, sf_dir), ["user_id"], "t", ["value"], "nearest")


_LINE = "CASE WHEN pt = nt THEN pv WHEN pt IS NOT NULL AND nt IS NOT NULL THEN pv + (nv - pv) * (t - pt) / (nt - pt)"


@query(f"{_SIDES}{_BOTH} SELECT event_id, user_id, t, round({_LINE} END, 4) AS value FROM c")
def interp_linear(spark, sf_dir):
    return temporal.interp_join(*_sides(spark, sf_dir), ["user_id"], "t", "value").withColumn("value", F.round("value", 4))


@query(f"{_SIDES}{_BOTH} SELECT event_id, user_id, t, round({_LINE} ELSE coalesce(pv, nv) END, 4) AS value FROM c")
def interp_clamp(spark, sf_dir):
    return temporal.interp_join(*_sides(spark, sf_dir), ["user_id"], "t", "value", "clamp").withColumn("value", F.round("value", 4))


@query(f"WITH {_E} SELECT CAST(floor((t - 1704067200000000) / 3600000000.0) AS BIGINT) AS frame, count(*) AS n, round(sum(value), 2) AS total FROM e GROUP BY 1")
def frame_counts(spark, sf_dir):
    return _events(spark, sf_dir).groupBy(temporal.frame_index(F.col("t"), 1704067200000000.0, 3600000000.0).alias("frame")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(f"""WITH {_E}, l AS (SELECT event_id, user_id, t FROM e WHERE event_type = 'purchase'), r AS (SELECT event_id AS other, user_id, t FROM e WHERE event_type = 'view'),
m AS (SELECT event_id, user_id, other, row_number() OVER (PARTITION BY event_id ORDER BY abs(l.t - r.t), other) AS k FROM l LEFT JOIN r USING (user_id) WHERE abs(l.t - r.t) < 86400000000)
SELECT event_id, l.user_id, other FROM l LEFT JOIN (SELECT event_id, other FROM m WHERE k = 1) USING (event_id)""")
def band_match_nearest(spark, sf_dir):
    """Equal user, less than a day apart, the nearest view; in day buckets, so that a user's pairs stay few."""
    e, day = _events(spark, sf_dir), 86400000000
    bucket = F.floor(F.col("t") / day)
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "t")
    right = e.where("event_type = 'view'").select(F.col("event_id").alias("other"), "user_id", F.col("t").alias("rt"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("b"))
    near = left.withColumn("b", bucket).join(right, ["user_id", "b"]).where(F.abs(F.col("t") - F.col("rt")) < day)
    best = near.groupBy("event_id").agg(F.min(F.struct(F.abs(F.col("t") - F.col("rt")).alias("d"), "other"))["other"].alias("other"))
    return left.join(best, "event_id", "left").select("event_id", "user_id", "other")


@query(f"WITH {_E} SELECT DISTINCT user_id FROM e WHERE event_type = 'purchase' AND user_id NOT IN (SELECT user_id FROM e WHERE event_type = 'error')")
def anti_codes(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.where("event_type = 'purchase'").select("user_id").distinct().join(e.where("event_type = 'error'"), "user_id", "left_anti")


# ---------------------------------------------------------------- windows


_W = "PARTITION BY user_id ORDER BY t, event_id"


@query(f"""WITH {_E} SELECT event_id, t - lag(t) OVER w AS dt, round(sum(value) OVER (w ROWS UNBOUNDED PRECEDING), 2) AS running, round((max(value) OVER m + min(value) OVER m) / 2, 4) AS mid,
round(CASE WHEN count(value) OVER m > 1 THEN (sum(value) OVER m - value) / (count(value) OVER m - 1) END, 4) AS others FROM e WINDOW w AS ({_W}), m AS ({_W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def window_signals(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    m = w.rowsBetween(-2, 2)
    return _events(spark, sf_dir).select(
        "event_id", (F.col("t") - F.lag("t").over(w)).alias("dt"), F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"),
        F.round((F.max("value").over(m) + F.min("value").over(m)) / 2, 4).alias("mid"), F.round(stats.leave_one_out_mean("value", m), 4).alias("others"),
    )


@query(f"""WITH {_E}, s AS (SELECT *, event_type IN ('click', 'view') AS flag, lag(event_type IN ('click', 'view')) OVER ({_W}) AS prev FROM e),
i AS (SELECT *, sum(CASE WHEN flag AND NOT coalesce(prev, false) THEN 1 ELSE 0 END) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS island FROM s)
SELECT user_id, CAST(island AS BIGINT) AS island, min(t) AS first, max(t) AS last, count(*) AS n FROM i WHERE flag GROUP BY user_id, island HAVING count(*) >= 2""")
def islands(spark, sf_dir):
    return temporal.islands(_events(spark, sf_dir).withColumn("flag", F.col("event_type").isin("click", "view")), ["user_id"], ["t", "event_id"], "flag", 2)


@query(f"""WITH {_E}, s AS (SELECT *, t % 4096 AS c, lag(t % 4096) OVER ({_W}) AS prev FROM e)
SELECT event_id, CAST(c + 4096 * sum(CASE WHEN c < prev THEN 1 ELSE 0 END) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS counter FROM s""")
def unwrap_counter(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("c", F.col("t") % 4096)
    return temporal.unwrap_counter(e, ["user_id"], ["t", "event_id"], "c", 4096, "counter").select("event_id", F.col("counter").cast("long").alias("counter"))


@query(f"""WITH {_E}, s AS (SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS filled,
row_number() OVER ({_W}) AS k, max(CASE WHEN event_type = 'signup' AND value IS NOT NULL THEN 1 ELSE 0 END) OVER ({_W}) AS x, user_id, t, event_type, value FROM e),
q AS (SELECT *, max(CASE WHEN event_type = 'signup' AND value IS NOT NULL THEN k END) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS seen FROM s)
SELECT event_id, CASE WHEN k - seen <= 3 THEN filled END AS filled FROM q""")
def fill_gap_limited(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("v", F.when(F.col("event_type") == "signup", F.col("value")))
    return temporal.fill_forward(e, ["user_id"], ["t", "event_id"], "v", "filled", 3).select("event_id", "filled")


@query(f"WITH {_E}, s AS (SELECT *, lag(event_type) OVER ({_W}) AS prev FROM e) SELECT event_id, event_type FROM s WHERE prev IS DISTINCT FROM event_type")
def dedupe_consecutive(spark, sf_dir):
    return temporal.dedupe_consecutive(_events(spark, sf_dir), ["user_id"], ["t", "event_id"], ["event_type"]).select("event_id", "event_type")


_DAILY = f"{_E}, d AS (SELECT event_type, CAST(floor(t / 86400000000.0) AS BIGINT) AS k, CAST(count(*) AS DOUBLE) AS v FROM e GROUP BY 1, 2)"


def _daily(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("event_type", F.floor(F.col("t") / 86400000000.0).alias("k")).agg(F.count("*").cast("double").alias("v"))


def _smooth_sql(sigma: float) -> str:
    k = temporal.gauss_kernel(sigma)
    term = lambda x: "v" if x == 0 else f"coalesce(lag(v, {x}) OVER w, first_value(v) OVER a)" if x > 0 else f"coalesce(lead(v, {-x}) OVER w, last_value(v) OVER a)"
    total = " + ".join(f"{w!r} * {term(x)}" for x, w in k)
    return f"WITH {_DAILY} SELECT event_type, k, round({total}, 6) AS smooth FROM d WINDOW w AS (PARTITION BY event_type ORDER BY k), a AS (PARTITION BY event_type ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


@query(_smooth_sql(1.0))
def gauss_smooth_small(spark, sf_dir):
    return temporal.gauss_smooth(_daily(spark, sf_dir), ["event_type"], ["k"], "v", 1.0, "smooth").select("event_type", "k", F.round("smooth", 6).alias("smooth"))


@query(f"WITH {_DAILY} SELECT event_type, k, (coalesce(lead(v) OVER w, 2 * v - lag(v) OVER w) - coalesce(lag(v) OVER w, 2 * v - lead(v) OVER w)) / 2 AS d FROM d WINDOW w AS (PARTITION BY event_type ORDER BY k)")
def deriv_small(spark, sf_dir):
    return temporal.derivative(_daily(spark, sf_dir), ["event_type"], ["k"], "v", "d").select("event_type", "k", "d")


# ---------------------------------------------------------------- statistics


@query(f"WITH {_P}, r AS (SELECT f, d, row_number() OVER (PARTITION BY f ORDER BY d) AS k, count(*) OVER (PARTITION BY f) AS n FROM p) SELECT f, d AS q FROM r WHERE k = greatest(1, least(n, CAST(round(0.25 * n) AS BIGINT)))")
def percentile_nearest_rank(spark, sf_dir):
    return stats.nearest_rank_by(_points(spark, sf_dir), ["f"], "d", 0.25, "q")


@query(f"""WITH {_P}, r AS (SELECT f, d, row_number() OVER (PARTITION BY f ORDER BY d) AS k, count(*) OVER (PARTITION BY f) AS n FROM p)
SELECT f, round(sum(greatest(0.0, 1 - abs(k - greatest(1.0, least(CAST(n AS DOUBLE), 0.75 * n + 0.5)))) * d), 3) AS q FROM r GROUP BY f""")
def percentile_hazen(spark, sf_dir):
    return stats.hazen(_points(spark, sf_dir), ["f"], "d", 0.75, "q").withColumn("q", F.round("q", 3))


@query(f"WITH {_P}, c AS (SELECT f, x, count(*) AS n FROM p GROUP BY f, x), r AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY n DESC, x) AS k FROM c) SELECT f, x AS mode FROM r WHERE k = 1")
def mode_smallest(spark, sf_dir):
    return stats.mode_smallest(_points(spark, sf_dir), ["f"], "x", "mode")


@query(f"""WITH {_P}, b AS (SELECT CAST(floor((x - 1) / 5.0) AS BIGINT) AS bin, x, d FROM p)
SELECT bin, round(avg(x), 6) AS x, round(avg(d), 3) AS mean, round(stddev_samp(d), 3) AS sd, round(stddev_samp(d) / sqrt(count(d)), 4) AS se, round(sum(d), 1) AS total, count(d) AS n FROM b WHERE bin BETWEEN 0 AND 9 GROUP BY bin""")
def binned_stats(spark, sf_dir):
    s = stats.binned_stats(_points(spark, sf_dir), "x", "d", 1, 5, 10)
    return s.select("bin", F.round("x", 6).alias("x"), F.round("mean", 3).alias("mean"), F.round("sd", 3).alias("sd"), F.round("se", 4).alias("se"), F.round("total", 1).alias("total"), "n")


@query(f"WITH {_P} SELECT f, round(regr_slope(d, x), 4) AS slope, round(regr_intercept(d, x), 2) AS intercept FROM p GROUP BY f")
def ols_line(spark, sf_dir):
    return _points(spark, sf_dir).groupBy("f").agg(F.round(F.regr_slope("d", "x"), 4).alias("slope"), F.round(F.regr_intercept("d", "x"), 2).alias("intercept"))


@query(f"""WITH {_P}, j AS (SELECT f, x, count(*) AS n FROM p GROUP BY f, x), h AS (SELECT log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM j),
a AS (SELECT log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM (SELECT sum(n) AS n FROM j GROUP BY f)), b AS (SELECT log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM (SELECT sum(n) AS n FROM j GROUP BY x))
SELECT round(a.h + b.h - h.h, 8) AS bits FROM h, a, b""")
def mutual_information(spark, sf_dir):
    return stats.mutual_information(_points(spark, sf_dir), "f", "x").select(F.round("bits", 8).alias("bits"))


# ---------------------------------------------------------------- geometry, bits, states


@query(f"WITH {_P} SELECT f, count(*) AS n, round(sum(d), 2) AS dwell FROM p WHERE (x - 25) ** 2 + (y - 5) ** 2 + (z - 4) ** 2 < 100 GROUP BY f")
def voi_sphere_activity(spark, sf_dir):
    p = _points(spark, sf_dir)
    return p.where(geometry.in_sphere(F.col("x"), F.col("y"), F.col("z"), (25, 5, 4), 10)).groupBy("f").agg(F.count("*").alias("n"), F.round(F.sum("d"), 2).alias("dwell"))


@query(f"WITH {_P} SELECT f, count(*) AS n FROM p WHERE (x - 25) ** 2 + (y - 5) ** 2 < 64 AND abs(z - 4) < 3 GROUP BY f")
def voi_cylinder_activity(spark, sf_dir):
    p = _points(spark, sf_dir)
    return p.where(geometry.in_cylinder(F.col("x"), F.col("y"), F.col("z"), (25, 5, 4), 8, 3)).groupBy("f").agg(F.count("*").alias("n"))


@query(f"""WITH {_P} SELECT l_partkey % 7 AS voi, round(sum(CASE WHEN f = 'A' THEN 1 ELSE 0 END) * sum(CASE WHEN f = 'R' THEN d ELSE 0 END) / (sum(CASE WHEN f = 'A' THEN d ELSE 0 END) * sum(CASE WHEN f = 'R' THEN 1 ELSE 0 END)), 6) AS ratio FROM p GROUP BY 1""")
def activity_ratio(spark, sf_dir):
    n, d = (lambda k: F.sum(F.when(F.col("f") == k, 1).otherwise(0)), lambda k: F.sum(F.when(F.col("f") == k, F.col("d")).otherwise(0)))
    return _points(spark, sf_dir).groupBy((F.col("l_partkey") % 7).alias("voi")).agg(F.round(n("A") * d("R") / (d("A") * n("R")), 6).alias("ratio"))


@query("SELECT event_id, " + ", ".join(f"(event_id & {1 << i}) <> 0 AS {n}" for i, n in enumerate(bits.STATUS)) + " FROM events")
def status_bits(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", *(v.alias(k) for k, v in bits.status_bits(F.col("event_id")).items()))


@query("SELECT event_id, CAST((event_id >> 12) & 15 AS BIGINT) AS code, event_id & 4095 AS payload, CASE WHEN event_id % 65536 >= 32768 THEN event_id % 65536 - 65536 ELSE event_id % 65536 END / 64.0 AS value FROM events")
def word_split(spark, sf_dir):
    e = F.col("event_id")
    return _t(spark, sf_dir, "events").select("event_id", bits.word_code(e).alias("code"), bits.word_payload(e).alias("payload"), bits.signed16(e % 65536).alias("value"))


@query("SELECT conv_id, bool_and(role IN ('user', 'assistant')) AS plain, count(*) AS turns FROM conversations GROUP BY conv_id HAVING bool_or(role = 'user') AND NOT bool_or(role = 'system')")
def state_filter(spark, sf_dir):
    r = F.col("role")
    g = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.bool_and(r.isin("user", "assistant")).alias("plain"), F.count("*").alias("turns"), F.bool_or(r == "user").alias("_u"), F.bool_or(r == "system").alias("_s"))
    return g.where(F.col("_u") & ~F.col("_s")).drop("_u", "_s")


@query()
def pca2(spark, sf_dir):
    return estimators.pca2(_t(spark, sf_dir, "embeddings"), "embedding", 64).select("vec_id", F.round("pc1", 6).alias("pc1"), F.round("pc2", 6).alias("pc2"))


@query(f"""WITH RECURSIVE {_E}, s AS (SELECT user_id, t / 1e9 AS s, value, row_number() OVER (PARTITION BY user_id ORDER BY t / 1e9, value) AS i FROM e WHERE value IS NOT NULL AND user_id IS NOT NULL),
k AS (SELECT user_id, i, s, value, CAST(value AS DOUBLE) AS x, 0.0e0 AS v, 0.5e0 AS a, 0.0e0 AS b, 1.0e0 AS c FROM s WHERE i = 1
UNION ALL SELECT user_id, i, s, value, CASE WHEN hit THEN xp + ap / z * err ELSE xp END, CASE WHEN hit THEN v + bp / z * err ELSE v END, CASE WHEN hit THEN ap - ap * ap / z ELSE ap END, CASE WHEN hit THEN bp - ap * bp / z ELSE bp END, CASE WHEN hit THEN cp - bp * bp / z ELSE cp END
FROM (SELECT *, ap + 1 AS z, value - xp AS err, (value - xp) * (value - xp) <= 25 * (ap + 1) AS hit FROM (SELECT k.user_id, s.i, s.s, s.value, k.v, k.x + (s.s - k.s) * k.v AS xp, k.a + 2 * (s.s - k.s) * k.b + (s.s - k.s) ** 2 * k.c + (s.s - k.s) ** 3 / 3 AS ap,
k.b + (s.s - k.s) * k.c + (s.s - k.s) ** 2 / 2 AS bp, k.c + (s.s - k.s) AS cp FROM k JOIN s ON s.user_id = k.user_id AND s.i = k.i + 1)))
SELECT user_id, round(s, 6) AS s, value, round(x, 4) AS value_hat FROM k""")
def kalman_track(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("s", F.col("t") / 1e9)
    out = estimators.kalman_track(e.select("user_id", "s", "value"), ["user_id"], "s", "value")
    return out.withColumn("s", F.round("s", 6)).withColumn("value_hat", F.round("value_hat", 4))


@query()
def two_rate_map(spark, sf_dir):
    e = _events(spark, sf_dir).groupBy("user_id", F.floor(F.col("t") / 86400000000).alias("day")).agg(F.count_if(F.col("event_type") == "view").alias("red"), F.count_if(F.col("event_type") == "click").alias("green"))
    out = estimators.two_rates_by_key(e.withColumn("dt", F.lit(1.0)), ["user_id"], "day", "dt", "red", "green")
    return out.select("user_id", "day", *(F.round(x, 4).alias(x) for x in ("rate", "ratio", "rate_sd", "ratio_sd")))


@query()
def bleach_baseline(spark, sf_dir):
    d = _daily(spark, sf_dir).withColumn("k", F.col("k").cast("double"))
    out = estimators.bleach_corrected(d, ["event_type"], "k", "v")
    return out.select("event_type", "k", F.round("baseline", 4).alias("baseline"), F.round("corrected", 4).alias("corrected"))


@query()
def viterbi_align(spark, sf_dir):
    """Days against ten levels of the day's count, as a path that never falls."""
    d = _daily(spark, sf_dir)
    costs = d.select("event_type", "k", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("state"), "v").withColumn("cost", F.abs(F.col("v") - F.col("state")))
    return estimators.align_monotone(costs, ["event_type"], "k", "state", "cost")


@query()
def plane_wave_fit(spark, sf_dir):
    v = grid.bin_points(_points(spark, sf_dir), AXES[:2], {"n": F.lit(1), "re": F.cos(F.col("x") / 20 + F.col("y") / 15), "im": F.sin(F.col("x") / 20 + F.col("y") / 15)}, ["f"])
    out = estimators.plane_waves(v, ["f"], "ix", "iy", "re", "im")
    return out.select("f", *(F.round(x, 4).alias(x) for x in ("kx", "ky", "phase")))
