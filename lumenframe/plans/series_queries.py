"""Registered queries of filters, fills, motion, images and scalar functions, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import elastic, grid, parts, series, temporal
from .catalog import _BINS, _DAILY, _E, _P, _W, AXES, _daily, _events, _points, _t, query


def _filter_sql(kernel, pad: str, out: str) -> str:
    """The convolution by indices: each tap's place beyond the ends is mapped as the pad says."""
    place = {"circular": "(j + m) % m", "mirror": "CASE WHEN j < 0 THEN -1 - j WHEN j >= m THEN 2 * m - 1 - j ELSE j END"}.get(pad, "greatest(0, least(m - 1, CASE WHEN j < 0 THEN -j WHEN j >= m THEN 2 * (m - 1) - j ELSE j END))" if pad == "linear" else "greatest(0, least(m - 1, j))")
    value = {"linear": "CASE WHEN j < 0 THEN 2 * a - s.v WHEN j >= m THEN 2 * b - s.v ELSE s.v END", "zeros": "CASE WHEN j BETWEEN 0 AND m - 1 THEN s.v ELSE 0 END"}.get(pad, "s.v")
    taps = ", ".join(f"({x}, {w!r})" for x, w in kernel)
    return f"""WITH {_DAILY}, s AS (SELECT event_type, k, v, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY event_type) AS m, first_value(v) OVER w AS a, last_value(v) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS b FROM d WINDOW w AS (PARTITION BY event_type ORDER BY k)),
t AS (SELECT event_type, k, i - x AS j, m, a, b, w FROM s, (VALUES {taps}) t(x, w)), p AS (SELECT *, {place} AS at FROM t)
SELECT p.event_type, p.k, round(sum(w * ({value.replace('j', 'p.j').replace('2 * a', '2 * p.a').replace('2 * b', '2 * p.b').replace('>= m', '>= p.m').replace('m - 1 THEN', 'p.m - 1 THEN')})), 5) AS {out} FROM p JOIN s ON s.event_type = p.event_type AND s.i = p.at GROUP BY 1, 2"""


def _low(spark, sf_dir, pad):
    return series.filtered(_daily(spark, sf_dir), ["event_type"], ["k"], "v", temporal.gauss_kernel(1.0), "smooth", pad).select("event_type", "k", F.round("smooth", 5).alias("smooth"))


@query(_filter_sql(temporal.gauss_kernel(1.0), "zeros", "smooth"))
def lowpass_zeros(spark, sf_dir):
    return _low(spark, sf_dir, "zeros")


@query(_filter_sql(temporal.gauss_kernel(1.0), "circular", "smooth"))
def lowpass_circular(spark, sf_dir):
    return _low(spark, sf_dir, "circular")


@query(_filter_sql(temporal.gauss_kernel(1.0), "mirror", "smooth"))
def lowpass_mirror(spark, sf_dir):
    return _low(spark, sf_dir, "mirror")


@query(_filter_sql(temporal.gauss_kernel(1.0), "linear", "smooth"))
def lowpass_linear(spark, sf_dir):
    return _low(spark, sf_dir, "linear")


@query(_filter_sql(series.derivative_kernel(1.0), "linear", "slope"))
def gauss_derivative(spark, sf_dir):
    return series.gauss_derivative(_daily(spark, sf_dir), ["event_type"], ["k"], "v", 1.0, "slope").select("event_type", "k", F.round("slope", 5).alias("slope"))


@query(f"WITH {_E} SELECT event_id, min(value) OVER ({_W} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS low FROM e")
def rolling_min(spark, sf_dir):
    return series.rolling_least(_events(spark, sf_dir), ["user_id"], ["t", "event_id"], "value", 5, "low").select("event_id", "low")


_GAPS = f"""WITH {_E}, g AS (SELECT user_id, t, max(CASE WHEN event_type IN ('click', 'error') THEN value END) AS v FROM e GROUP BY 1, 2), h AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY user_id) AS c FROM g WINDOW w AS (PARTITION BY user_id ORDER BY t)),
x AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER p AS pt, last_value(v IGNORE NULLS) OVER p AS pv, last_value(CASE WHEN v IS NOT NULL THEN k END IGNORE NULLS) OVER p AS pk, first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER n AS nt, first_value(v IGNORE NULLS) OVER n AS nv,
first_value(CASE WHEN v IS NOT NULL THEN k END IGNORE NULLS) OVER n AS nk FROM h WINDOW p AS (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING), n AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


def _gaps(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.groupBy("user_id", "t").agg(F.max(F.when(F.col("event_type").isin("click", "error"), F.col("value"))).alias("v"))


@query(f"{_GAPS} SELECT user_id, t, round(coalesce(v, CASE WHEN coalesce(nk, c + 1) - coalesce(pk, 0) - 1 <= 3 THEN CASE WHEN pt IS NOT NULL AND nt IS NOT NULL THEN pv + (nv - pv) * (t - pt) / (nt - pt) ELSE coalesce(pv, nv) END END), 4) AS v FROM x")
def fill_linear(spark, sf_dir):
    return series.filled(_gaps(spark, sf_dir), ["user_id"], "t", "v", "linear", 3).withColumn("v", F.round("v", 4))


@query(f"{_GAPS} SELECT user_id, t, coalesce(v, CASE WHEN pt IS NULL OR nt - t <= t - pt THEN nv ELSE pv END) AS v FROM x")
def fill_nearest(spark, sf_dir):
    return series.filled(_gaps(spark, sf_dir), ["user_id"], "t", "v", "nearest")


_MOTION = f"""WITH {_E}, g AS (SELECT user_id, t / 3600000000.0 AS h, max(value) AS x, min(value) / 2 AS y FROM e GROUP BY 1, 2), d AS (SELECT *, nullif(coalesce(lead(h) OVER w, h) - coalesce(lag(h) OVER w, h), 0) AS dt, coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x) AS dx,
coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y) AS dy FROM g WINDOW w AS (PARTITION BY user_id ORDER BY h)), s AS (SELECT *, sqrt((dx / dt) ** 2 + (dy / dt) ** 2) AS speed FROM d)"""


@query(f"{_MOTION} SELECT user_id, round(h, 6) AS h, round(speed, 4) AS speed, round((coalesce(lead(speed) OVER w, speed) - coalesce(lag(speed) OVER w, speed)) / dt, 4) + 0.0e0 AS acceleration FROM s WINDOW w AS (PARTITION BY user_id ORDER BY h)")
def speed_acceleration(spark, sf_dir):
    g = _events(spark, sf_dir).groupBy("user_id", (F.col("t") / 3600000000).alias("h")).agg(F.max("value").alias("x"), (F.min("value") / 2).alias("y"))
    return series.motion(g, ["user_id"], "h", ["x", "y"]).select("user_id", F.round("h", 6).alias("h"), F.round("speed", 4).alias("speed"), (F.round("acceleration", 4) + 0.0).alias("acceleration"))


@query(f"""WITH {_DAILY}, g AS (SELECT event_type, min(k) AS a, max(k) AS b FROM d GROUP BY 1), u AS (SELECT event_type, i, a + i * 0.5e0 AS t FROM g, LATERAL (SELECT unnest(generate_series(0, CAST((b - a) * 2 AS BIGINT))) AS i))
SELECT u.event_type, u.i AS n, round(CASE WHEN p.k = q.k THEN p.v ELSE p.v + (q.v - p.v) * (u.t - p.k) / (q.k - p.k) END, 5) AS v FROM u ASOF JOIN d p ON u.event_type = p.event_type AND u.t >= p.k ASOF JOIN d q ON u.event_type = q.event_type AND u.t <= q.k""")
def resample_uniform(spark, sf_dir):
    d = _daily(spark, sf_dir).select("event_type", F.col("k").cast("double").alias("t"), "v")
    return series.resampled(d, ["event_type"], "t", "v", 0.5).select("event_type", F.col("k").alias("n"), F.round("v", 5).alias("v"))


@query("WITH c AS (SELECT l_returnflag AS f, l_partkey % 36 AS k, CAST(sum(l_quantity) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2) SELECT a.f, a.k * 4 + j AS k, round(a.v + (b.v - a.v) * j / 4, 4) AS v FROM c a JOIN c b ON a.f = b.f AND b.k = (a.k + 1) % 36, (SELECT unnest([0, 1, 2, 3]) AS j)")
def upsample_circular(spark, sf_dir):
    c = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("f"), (F.col("l_partkey") % 36).alias("i")).agg(F.sum("l_quantity").cast("double").alias("v"))
    return series.upsampled_circular(c, ["f"], "i", "v", 36, 4).withColumn("v", F.round("v", 4))


@query(f"""WITH {_P}, a AS (SELECT pi() / 2 * i / 30 AS a FROM (SELECT unnest(range(30)) AS i)), r AS (SELECT f, a, max(cos(a) * x + sin(a) * y) - min(cos(a) * x + sin(a) * y) AS w, max(cos(a) * y - sin(a) * x) - min(cos(a) * y - sin(a) * x) AS h FROM p, a GROUP BY 1, 2)
SELECT f, round(min(w * h), 6) AS area FROM r GROUP BY f""")
def bounding_rectangle(spark, sf_dir):
    return series.bounding_rectangle(_points(spark, sf_dir), ["f"], "x", "y", 30).select("f", F.round("area", 6).alias("area"))


@query(f"""WITH {_P}, b AS (SELECT {_BINS} FROM p), v AS (SELECT ix, iy, count(*) AS n FROM b WHERE ix BETWEEN 0 AND 9 AND iy BETWEEN 0 AND 5 GROUP BY 1, 2)
SELECT ix, iy, n FROM v a WHERE n >= 20 AND NOT EXISTS (SELECT 1 FROM v b WHERE abs(a.ix - b.ix) <= 1 AND abs(a.iy - b.iy) <= 1 AND (a.ix <> b.ix OR a.iy <> b.iy) AND (b.n > a.n OR b.n = a.n AND (b.ix < a.ix OR b.ix = a.ix AND b.iy < a.iy)))""")
def peaks_2d(spark, sf_dir):
    return series.peaks2d(grid.bin_points(_points(spark, sf_dir), AXES[:2], {"n": F.lit(1)}), "ix", "iy", "n", 20)


@query()
def power_spectrum(spark, sf_dir):
    d = _events(spark, sf_dir).withColumn("i", F.col("event_id") - 1)
    return series.spectrum(d.withColumn("one", F.lit("all")), ["one"], "i", "value", 64, 1.0).select("one", F.round("frequency", 6).alias("frequency"), F.round("power", 4).alias("power"))


@query()
def structural_similarity(spark, sf_dir):
    v = grid.bin_points(_points(spark, sf_dir), AXES, {"a": (F.col("f") == "R").cast("int"), "b": (F.col("f") == "A").cast("int")})
    return series.similarity(v, {"ix": 10, "iy": 6, "iz": 9}, "a", "b", 1.0, 20.0, 2).withColumn("ssim", F.round("ssim", 6))


@query()
def analysis_mask(spark, sf_dir):
    return series.analysis_mask(grid.bin_points(_points(spark, sf_dir), AXES[:2], {"n": F.lit(1)}), {"ix": 10, "iy": 6}, "n", 1.0, 0.5)


@query()
def time_warp(spark, sf_dir):
    d = _daily(spark, sf_dir).select("event_type", F.col("k").cast("double").alias("t"), "v")
    mean = d.groupBy("t").agg(F.avg("v").alias("v"))
    return series.time_warp(d, ["event_type"], "t", "v", mean).select("event_type", "t", F.round("warped", 4).alias("warped"))


@query(f"""WITH {_E}, q AS (SELECT event_id, value FROM e WHERE event_type = 'view'), a AS (SELECT * FROM q ORDER BY value DESC NULLS LAST, event_id LIMIT 1), b AS (SELECT q.* FROM q, a WHERE abs(q.event_id - a.event_id) >= 100 ORDER BY q.value DESC NULLS LAST, q.event_id LIMIT 1),
f AS (SELECT min(event_id) AS f0, max(event_id) AS f1 FROM (SELECT * FROM a UNION ALL SELECT * FROM b)), g AS (SELECT min(t) / 1e6 AS t0, max(t) / 1e6 AS t1 FROM e WHERE event_type = 'signup') SELECT round((t1 - t0) / (f1 - f0), 4) AS slope, round(t0 - (t1 - t0) / (f1 - f0) * f0, 2) AS intercept FROM f, g""")
def clock_from_flashes(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("s", F.col("t") / 1e6)
    out = series.clock_from_flashes(e.where("event_type = 'view'"), e, "event_id", "value", "s", F.col("event_type") == "signup", 100)
    return out.select(F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"))


# ---------------------------------------------------------------- scalar functions


@query("SELECT p_partkey, replace(p_name, ' ', '_') AS r, string_split(p_name, ' ')[1] AS first, lower(p_type) AS low, contains(p_name, 'a') AS a, ends_with(p_type, 'L') AS l, regexp_replace(p_brand, '[^0-9]', '', 'g') AS digits, rtrim(p_brand || '  ') AS b, upper(to_hex(p_partkey)) AS h FROM part")
def string_functions(spark, sf_dir):
    c = F.col
    return _t(spark, sf_dir, "part").select(
        "p_partkey", F.replace(c("p_name"), F.lit(" "), F.lit("_")).alias("r"), F.get(F.split("p_name", " "), 0).alias("first"), F.lower("p_type").alias("low"), c("p_name").contains("a").alias("a"), c("p_type").endswith("L").alias("l"),
        F.regexp_replace("p_brand", "[^0-9]", "").alias("digits"), F.rtrim(F.concat("p_brand", F.lit("  "))).alias("b"), F.hex("p_partkey").alias("h"),
    )


@query("SELECT o_orderkey, round(sqrt(o_totalprice), 4) AS s, round(ln(o_totalprice + 1), 6) AS l, round(log2(o_totalprice + 1), 6) AS l2, floor(o_totalprice / 7)::BIGINT AS f, ceil(o_totalprice / 7)::BIGINT AS c, ((o_orderkey - 50) % 7 + 7) % 7 AS m, sign(o_totalprice - 1000)::DOUBLE AS g, round(atan2(o_custkey, 3), 6) AS t, round(exp(-o_custkey / 100.0), 6) AS e FROM orders")
def math_functions(spark, sf_dir):
    p, k = F.col("o_totalprice"), F.col("o_orderkey")
    return _t(spark, sf_dir, "orders").select(
        "o_orderkey", F.round(F.sqrt(p), 4).alias("s"), F.round(F.log(p + 1), 6).alias("l"), F.round(F.log2(p + 1), 6).alias("l2"), F.floor(p / 7).alias("f"), F.ceil(p / 7).alias("c"), F.pmod(k - 50, F.lit(7)).alias("m"), F.signum(p - 1000).alias("g"),
        F.round(F.atan2(F.col("o_custkey").cast("double"), F.lit(3.0)), 6).alias("t"), F.round(F.exp(-F.col("o_custkey") / 100), 6).alias("e"),
    )


@query("SELECT vec_id, round(list_sum(list_transform(embedding[1:4], lambda x: CAST(x AS DOUBLE) * 2)), 5) AS s, round(CAST(list_reverse(embedding)[1] AS DOUBLE), 6) AS last, len(list_concat(embedding[1:3], embedding[60:64])) AS n, list_aggregate(list_filter(embedding, lambda x: x > 0), 'count') AS positive FROM embeddings")
def array_functions(spark, sf_dir):
    v = F.col("embedding")
    twice = F.aggregate(F.transform(F.slice(v, 1, 4), lambda x: x.cast("double") * 2), F.lit(0.0), lambda a, x: a + x)
    return _t(spark, sf_dir, "embeddings").select("vec_id", F.round(twice, 5).alias("s"), F.round(F.get(F.reverse(v), 0).cast("double"), 6).alias("last"), F.size(F.concat(F.slice(v, 1, 3), F.slice(v, 60, 5))).cast("long").alias("n"), F.size(F.filter(v, lambda x: x > 0)).cast("long").alias("positive"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_functions(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT r_name, n AS nations, CAST(len(n) AS INT) AS c FROM (SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS n, count(*) AS c FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1)")
def struct_functions(spark, sf_dir):
    """A map from names to keys, its names in order."""
    j = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    m = j.groupBy("r_name").agg(F.map_from_entries(F.collect_list(F.struct("n_name", "n_nationkey"))).alias("m"))
    names = F.array_join(F.array_sort(F.map_keys("m")), ",")
    return m.select("r_name", names.alias("nations"), F.length(names).alias("c"))


@query("SELECT l_returnflag AS f, bool_or(l_tax > 0.07) AS some, bool_and(l_quantity > 0) AS every, count(*) FILTER (isfinite(l_extendedprice)) AS finite FROM lineitem GROUP BY 1")
def predicate_functions(spark, sf_dir):
    x = F.col("l_extendedprice")
    return _t(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("f")).agg(F.bool_or(F.col("l_tax") > 0.07).alias("some"), F.bool_and(F.col("l_quantity") > 0).alias("every"), F.count_if(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))).alias("finite"))


# ---------------------------------------------------------------- series in parts


@query(_filter_sql(temporal.gauss_kernel(1.0), "ends", "smooth"))
def lowpass_in_parts(spark, sf_dir):
    """The low-pass that holds end values, in parts of eight samples."""
    d = series.numbered(_daily(spark, sf_dir), ["event_type"], ["k"])
    got = parts.filtered(d, ["event_type"], "_i", "v", temporal.gauss_kernel(1.0), "smooth", 8)
    return d.join(got, ["event_type", "_i"]).select("event_type", "k", F.round("smooth", 5).alias("smooth"))


@query()
def band_limited(spark, sf_dir):
    """Each type's values by time, at steps of two hours."""
    e = _events(spark, sf_dir).groupBy("event_type", (F.col("t") / 3.6e9).alias("t")).agg(F.avg("value").alias("v"))
    span = e.groupBy("event_type").agg(F.ceil(F.min("t")).cast("double").alias("start"), F.lit(2.0).alias("step"), F.floor((F.max("t") - F.min("t")) / 2).cast("long").alias("count"))
    return parts.band_limited(e, ["event_type"], "t", "v", span).withColumn("v", F.round("v", 4))


@query()
def shot_spectrum(spark, sf_dir):
    """Spectrum of all events' hourly numbers and of counts drawn at their mean rate."""
    e = _events(spark, sf_dir).groupBy(F.floor(F.col("t") / 3.6e9).cast("long").alias("hour")).agg(F.count("*").cast("double").alias("n"))
    hours = e.agg(F.min("hour").alias("first"), F.max("hour").alias("last")).select("first", F.explode(F.sequence("first", "last")).alias("hour"))
    every = hours.join(e, "hour", "left").select(F.lit("all").alias("k"), (F.col("hour") - F.col("first")).alias("i"), F.coalesce("n", F.lit(0.0)).alias("rate"))
    return parts.shot_noise(every, ["k"], "i", "rate", 1.0, 48).select("k", F.round("frequency", 6).alias("frequency"), F.round("power", 8).alias("power"), F.round("shot", 8).alias("shot"))


# ---------------------------------------------------------------- elastic alignment


@query()
def elastic_alignment(spark, sf_dir):
    """Each type's hourly mean values, aligned in time to those of all events: hour, the hour that it is matched with, magnitude."""
    e = _events(spark, sf_dir).withColumn("hour", F.floor(F.col("t") / 3600000000).cast("long"))
    span = e.agg(F.min("hour").alias("first"), F.max("hour").alias("last"))
    grid_ = e.select("event_type").distinct().join(F.broadcast(span), how="cross").select("event_type", "first", F.explode(F.sequence("first", "last")).alias("hour"))  # span is one row
    both = grid_.join(e.groupBy("hour").agg(F.avg("value").alias("all")), "hour", "left").join(e.groupBy("event_type", "hour").agg(F.avg("value").alias("own")), ["event_type", "hour"], "left").withColumn("i", F.col("hour") - F.col("first"))
    known = both.where("all is not null").select("event_type", "i", F.col("i").cast("double").alias("hour"), F.col("all").alias("w"))
    unknown = both.select("event_type", "i", F.col("own").alias("w"))
    ends = unknown.groupBy("event_type").agg(F.lit(-1.0).alias("t0"), (F.max("i") + 1).cast("double").alias("t1"))
    out = elastic.aligned(known, unknown, ["event_type"], "i", "hour", ["w"], ends, 0.25, 200.0, 20.0)
    return out.select("event_type", "i", F.round("hour", 3).alias("hour"), F.round("magnitude", 4).alias("magnitude"))
