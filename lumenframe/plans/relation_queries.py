"""Registered queries of sets, joins by value, samples, flags and events around a row, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relations, temporal
from .catalog import _BOTH, _DAILY, _E, _SIDES, _W, _events, _sides, _t, query


def _of(spark, sf_dir, kind):
    return _events(spark, sf_dir).where(F.col("event_type") == kind)


@query(f"WITH {_E} SELECT event_id FROM e WHERE event_type = 'view' AND user_id IN (SELECT user_id FROM e WHERE event_type = 'purchase')")
def semi_codes(spark, sf_dir):
    return relations.present(_of(spark, sf_dir, "view"), _of(spark, sf_dir, "purchase"), ["user_id"]).select("event_id")


_TWO = f"WITH {_E}, a AS (SELECT DISTINCT user_id FROM e WHERE event_type = 'purchase'), b AS (SELECT DISTINCT user_id FROM e WHERE event_type = 'error')"


def _two(spark, sf_dir):
    return relations.sides(_of(spark, sf_dir, "purchase"), _of(spark, sf_dir, "error"), ["user_id"])


@query(f"{_TWO} SELECT user_id FROM a UNION SELECT user_id FROM b")
def set_union(spark, sf_dir):
    return _two(spark, sf_dir).select("user_id")


@query(f"{_TWO} SELECT user_id FROM a INTERSECT SELECT user_id FROM b")
def set_intersection(spark, sf_dir):
    return _two(spark, sf_dir).where("in_a AND in_b").select("user_id")


@query(f"{_TWO} SELECT (SELECT count(*) FROM (SELECT user_id FROM a EXCEPT SELECT user_id FROM b)) AS only_a, (SELECT count(*) FROM (SELECT user_id FROM b EXCEPT SELECT user_id FROM a)) AS only_b")
def symmetric_difference_count(spark, sf_dir):
    return _two(spark, sf_dir).agg(F.count_if(~F.col("in_b")).alias("only_a"), F.count_if(~F.col("in_a")).alias("only_b"))


@query(f"""WITH {_E}, a AS (SELECT user_id, min(event_id) AS event_id_a FROM e WHERE event_type = 'purchase' GROUP BY 1), b AS (SELECT user_id, min(event_id) AS event_id_b FROM e WHERE event_type = 'error' GROUP BY 1)
SELECT user_id, event_id_a, event_id_b FROM a JOIN b USING (user_id)""")
def common_places(spark, sf_dir):
    return relations.common_places(_of(spark, sf_dir, "purchase"), _of(spark, sf_dir, "error"), "user_id", "event_id")


@query("SELECT event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM events GROUP BY event_type")
def first_last_place(spark, sf_dir):
    return relations.first_last(_t(spark, sf_dir, "events"), "event_type", "event_id")


@query(f"{_SIDES}{_BOTH} SELECT event_id, CASE WHEN pt IS NULL OR nt - t <= t - pt THEN nt ELSE pt END AS t_right FROM c")
def nearest_row(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    return relations.nearest_row(left, right, ["user_id"], "t", ["value"]).select("event_id", "t_right")


@query(f"""WITH {_E}, q AS (SELECT event_id AS q, user_id, t FROM e WHERE event_type = 'purchase'), r AS (SELECT event_id, user_id, t AS rt FROM e WHERE event_type = 'view'),
x AS (SELECT q, event_id, row_number() OVER (PARTITION BY q ORDER BY abs(t - rt), rt, event_id) AS place FROM q JOIN r USING (user_id)) SELECT q, event_id, place FROM x WHERE place <= 3""")
def k_nearest(spark, sf_dir):
    q = _of(spark, sf_dir, "purchase").select(F.col("event_id").alias("q"), "user_id", "t")
    return relations.k_nearest(q, _of(spark, sf_dir, "view"), ["user_id"], "t", "event_id", 3).select("q", "event_id", "place")


@query("SELECT l_orderkey, l_linenumber, l_quantity, coalesce(s_acctbal, 0) AS s_acctbal FROM lineitem LEFT JOIN (SELECT s_suppkey AS l_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 0) USING (l_suppkey)")
def voxel_lookup(spark, sf_dir):
    table = _t(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), "s_acctbal")
    return relations.looked_up(_t(spark, sf_dir, "lineitem"), table, ["l_suppkey"], ["s_acctbal"], 0.0).select("l_orderkey", "l_linenumber", "l_quantity", "s_acctbal")


@query(f"{_SIDES}{_BOTH} SELECT event_id, CASE WHEN pt IS NULL OR nt - t <= t - pt THEN nv ELSE pv END > 50 AS near, coalesce(pv > 50 AND nv > 50, false) AS both_sides FROM c")
def mask_on_clock(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    mask = right.select("user_id", "t", (F.col("value") > 50).alias("on"))
    near = relations.mask_on_clock(left, mask, ["user_id"], "t", "on").withColumnRenamed("on", "near")
    return relations.mask_on_clock(near, mask, ["user_id"], "t", "on", "both").select("event_id", "near", F.col("on").alias("both_sides"))


@query("SELECT doc_id, CASE WHEN r.doc_id IS NOT NULL THEN r.quality ELSE l.quality END AS quality, l.toxic, r.lang FROM labels l LEFT JOIN (SELECT doc_id, 5 AS quality, lang FROM documents WHERE lang = 'de') r USING (doc_id)")
def merge_structs(spark, sf_dir):
    right = _t(spark, sf_dir, "documents").where("lang = 'de'").select("doc_id", F.lit(5).alias("quality"), "lang")
    return relations.merged(_t(spark, sf_dir, "labels"), right, ["doc_id"])


@query("SELECT doc_id, lang, NULL::INT AS quality FROM documents UNION ALL SELECT doc_id, NULL, quality FROM labels")
def concat_chunks(spark, sf_dir):
    return relations.stacked(_t(spark, sf_dir, "documents").select("doc_id", "lang"), _t(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("quality")))


@query("SELECT DISTINCT l_returnflag AS f, l_partkey % 11 AS ix, l_suppkey % 7 AS iy FROM lineitem")
def mask_union(spark, sf_dir):
    masks = _t(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("f"), "l_linenumber", (F.col("l_partkey") % 11).alias("ix"), (F.col("l_suppkey") % 7).alias("iy"))
    return relations.mask_union(masks, ["ix", "iy"], "f")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25")
def top_n_frames(spark, sf_dir):
    return relations.top(_t(spark, sf_dir, "orders"), "o_totalprice", 25, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("SELECT event_id, event_type, ts FROM (SELECT event_id, event_type, ts, epoch_us(ts) AS u FROM events WHERE event_type IN ('click', 'view'))")
def colours_by_time(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return relations.stacked(*(e.where(F.col("event_type") == k) for k in ("click", "view"))).orderBy("ts", "event_id").select("event_id", "event_type", "ts")


@query("WITH r AS (SELECT l_returnflag AS f, l_extendedprice AS d, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC) AS k FROM lineitem) SELECT f, d AS threshold FROM r WHERE k = 100")
def nth_brightest(spark, sf_dir):
    return relations.nth_value(_t(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("f"), F.col("l_extendedprice").alias("d")), ["f"], "d", 100, "threshold")


@query("""WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_orderstatus) - 1 AS m FROM orders),
k AS (SELECT DISTINCT o_orderstatus, CAST(round(j * m / 19.0) AS BIGINT) AS i FROM (SELECT DISTINCT o_orderstatus, m FROM r), (SELECT unnest(range(20)) AS j)) SELECT o_orderkey, o_orderstatus FROM r JOIN k USING (o_orderstatus, i)""")
def evenly_spaced(spark, sf_dir):
    return relations.evenly(_t(spark, sf_dir, "orders"), ["o_orderstatus"], ["o_orderkey"], 20).select("o_orderkey", "o_orderstatus")


@query()
def random_subset(spark, sf_dir):
    return relations.share(_t(spark, sf_dir, "events"), ["event_id"], 0.25).select("event_id")


@query(f"""WITH {_DAILY}, b AS (SELECT *, max(v) OVER w AS m FROM d WINDOW w AS (PARTITION BY event_type ORDER BY k RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
f AS (SELECT a.event_type, a.k, a.v FROM b a WHERE a.v = a.m AND NOT EXISTS (SELECT 1 FROM d o WHERE o.event_type = a.event_type AND o.v = a.v AND o.k BETWEEN a.k - 3 AND a.k - 1)),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY v DESC, k) AS i FROM f) SELECT event_type, k, v FROM r WHERE i <= 40""")
def spread_peaks(spark, sf_dir):
    d = _events(spark, sf_dir).groupBy("event_type", F.floor(F.col("t") / 86400000000.0).alias("k")).agg(F.count("*").cast("double").alias("v"))
    return relations.spread_peaks(d, ["event_type"], "k", "v", 3, 40)


@query(f"""WITH RECURSIVE {_E}, h AS (SELECT event_type, CAST(floor(t / 3600000000.0) AS BIGINT) AS k, max(value) AS v FROM e GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY v DESC, k) AS n FROM h WHERE v IS NOT NULL),
g AS (SELECT event_type, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS kept FROM r GROUP BY 1 UNION ALL SELECT g.event_type, r.n, CASE WHEN len(list_filter(g.kept, lambda x: abs(x - r.k) <= 5)) = 0 THEN list_append(g.kept, r.k) ELSE g.kept END FROM g JOIN r ON r.event_type = g.event_type AND r.n = g.n + 1),
f AS (SELECT event_type, unnest(arg_max(kept, n)) AS k FROM g GROUP BY 1) SELECT event_type, k, round(v, 4) AS v FROM f JOIN h USING (event_type, k) QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY v DESC, k) <= 40""")
def greedy_peaks(spark, sf_dir):
    """The forty highest hours of each type, none within five hours of a higher one that is left."""
    h = _events(spark, sf_dir).groupBy("event_type", F.floor(F.col("t") / 3600000000.0).cast("long").alias("k")).agg(F.max("value").alias("v"))
    return relations.greedy_peaks(h, ["event_type"], "k", "v", 5, 40).select("event_type", "k", F.round("v", 4).alias("v"))


# ---------------------------------------------------------------- flags

_FLAGS = "g AS (SELECT conv_id * 1000 + turn AS frame, role AS state, turn % 2 = 0 AS on FROM conversations)"


def _flags(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("frame"), F.col("role").alias("state"), (F.col("turn") % 2 == 0).alias("on"))


@query(f"WITH {_FLAGS} SELECT * FROM g WHERE NOT (frame = 1000 AND state IN ('user', 'moving')) UNION ALL SELECT 1000, 'user', false UNION ALL SELECT 1000, 'moving', true")
def set_flags(spark, sf_dir):
    return relations.set_flags(_flags(spark, sf_dir), 1000, {"user": False, "moving": True})


@query(f"WITH {_FLAGS} SELECT frame, coalesce(string_agg(DISTINCT state, ',' ORDER BY state) FILTER (\"on\"), '') AS states FROM g GROUP BY frame")
def flags_of_frame(spark, sf_dir):
    return relations.flags_of(_flags(spark, sf_dir)).select("frame", F.array_join("states", ",").alias("states"))


@query(f"WITH {_FLAGS} SELECT f AS frame, s.state, coalesce(bool_or(\"on\"), false) AS \"on\" FROM (SELECT unnest(range(3000)) AS f) CROSS JOIN (SELECT DISTINCT state FROM g) s LEFT JOIN g ON g.frame = f AND g.state = s.state GROUP BY f, s.state")
def set_length(spark, sf_dir):
    return relations.set_length(_flags(spark, sf_dir), 3000)


@query(f"WITH {_FLAGS} SELECT * FROM g UNION ALL SELECT DISTINCT frame, 'resting', false FROM g")
def add_states(spark, sf_dir):
    return relations.with_states(_flags(spark, sf_dir), ["resting", "user"])


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN abs(l_quantity - 25) >= 5 AND cos(l_partkey) > sqrt(0.5) THEN 1 WHEN abs(l_quantity - 25) >= 5 AND cos(l_partkey) < -sqrt(0.5) THEN 2 ELSE 0 END AS label FROM lineitem""")
def heading_label(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", relations.heading_label(F.cos("l_partkey"), F.col("l_quantity") - 25, 5.0).alias("label"))


_RANGES = "r AS (SELECT user_id, t AS a, t + 3600000000 AS b, event_id AS label FROM e WHERE event_type = 'signup' QUALIFY coalesce(t - lag(t) OVER (PARTITION BY user_id ORDER BY t), 3600000001) > 3600000000)"


@query(f"WITH {_E}, {_RANGES} SELECT event_id, CASE WHEN t <= b THEN label END AS label FROM (SELECT * FROM e WHERE event_type <> 'signup') x ASOF LEFT JOIN r ON x.user_id = r.user_id AND x.t >= r.a")
def labelled_ranges(spark, sf_dir):
    from pyspark.sql import Window

    e = _events(spark, sf_dir)
    s = e.where("event_type = 'signup'").withColumn("p", F.lag("t").over(Window.partitionBy("user_id").orderBy("t"))).where("p IS NULL OR t - p > 3600000000")
    ranges = s.select("user_id", F.col("t").alias("a"), (F.col("t") + 3600000000).alias("b"), F.col("event_id").alias("label"))
    return relations.labelled_ranges(e.where("event_type <> 'signup'").select("event_id", "user_id", "t"), ranges, ["user_id"], "t", "a", "b", "label").select("event_id", "label")


# ---------------------------------------------------------------- around events


@query(f"""WITH {_E} SELECT event_id, t - last_value(CASE WHEN event_type = 'purchase' THEN t END IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS since,
first_value(CASE WHEN event_type = 'purchase' THEN t END IGNORE NULLS) OVER ({_W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - t AS until FROM e""")
def time_to_next_event(spark, sf_dir):
    return relations.around_events(_events(spark, sf_dir), ["user_id"], ["t", "event_id"], "t", F.col("event_type") == "purchase").select("event_id", "since", "until")


@query(f"""WITH {_E}, a AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS new, lag(event_type) OVER w AS p, lead(event_type) OVER w AS n FROM e WINDOW w AS ({_W})),
b AS (SELECT *, sum(new) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS run FROM a), c AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY t, event_id) AS from_start, count(*) OVER (PARTITION BY user_id, run) AS m FROM b)
SELECT event_id, from_start, m - from_start + 1 AS from_end, max(CASE WHEN from_start = 1 THEN p END) OVER (PARTITION BY user_id, run) AS before, max(CASE WHEN from_start = m THEN n END) OVER (PARTITION BY user_id, run) AS after FROM c""")
def run_position(spark, sf_dir):
    return relations.run_places(_events(spark, sf_dir), ["user_id"], ["t", "event_id"], "event_type").select("event_id", "from_start", "from_end", "before", "after")


@query(f"{_SIDES}{_BOTH} SELECT event_id, round(CASE WHEN pt IS NULL OR nt - t <= t - pt THEN nv ELSE pv END, 4) AS value, t - CASE WHEN pt IS NULL OR nt - t <= t - pt THEN nt ELSE pt END AS \"offset\" FROM c")
def nearest_event(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    return relations.nearest_event(left, right, ["user_id"], "t", "value").select("event_id", F.round("value", 4).alias("value"), "offset")


@query(f"""WITH {_DAILY}, s AS (SELECT event_type, k, sum(v * v) OVER w AS total, count(v) OVER w AS n, max(k) OVER w AS last FROM d WINDOW w AS (PARTITION BY event_type ORDER BY k ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY total, k) AS i FROM s WHERE n = 5) SELECT event_type, k AS first, last, total FROM r WHERE i = 1""")
def slowest_window(spark, sf_dir):
    d = _events(spark, sf_dir).groupBy("event_type", F.floor(F.col("t") / 86400000000.0).alias("k")).agg(F.count("*").cast("double").alias("v"))
    return relations.slowest_window(d, ["event_type"], "k", "v", 5)


@query(f"""WITH {_E}, a AS (SELECT *, CASE WHEN event_type IN ('click', 'purchase') THEN 1 WHEN event_type = 'error' THEN -1 END AS s, row_number() OVER ({_W}) AS i FROM e),
b AS (SELECT *, last_value(s IGNORE NULLS) OVER p AS ps, last_value(CASE WHEN s IS NOT NULL THEN i END IGNORE NULLS) OVER p AS pi, first_value(s IGNORE NULLS) OVER n AS ns, first_value(CASE WHEN s IS NOT NULL THEN i END IGNORE NULLS) OVER n AS ni
FROM a WINDOW p AS ({_W} ROWS UNBOUNDED PRECEDING), n AS ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT event_id, coalesce(s, CASE WHEN ps = ns AND ni - pi - 1 <= 2 THEN ps END) AS state FROM b""")
def forward_backward_certainty(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("f", F.col("event_type").isin("click", "purchase")).withColumn("b", F.col("event_type") == "error")
    return relations.certainty(e, ["user_id"], ["t", "event_id"], "f", "b", 2).select("event_id", "state")


@query("""WITH v AS (SELECT l_linenumber AS frame, l_partkey % 5 AS ix, CAST(sum(l_quantity) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2), s AS (SELECT frame + o AS frame, ix, n * w AS n FROM v, (VALUES (1, 0.25e0), (0, 0.5e0), (-1, 0.25e0)) k(o, w))
SELECT frame, ix, round(sum(n), 4) AS n FROM s WHERE frame IN (SELECT frame FROM v) GROUP BY frame, ix""")
def three_frame_blur(spark, sf_dir):
    v = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("frame"), (F.col("l_partkey") % 5).alias("ix")).agg(F.sum("l_quantity").cast("double").alias("n"))
    return relations.three_frames(v, "frame", ["ix"], "n").withColumn("n", F.round("n", 4))


@query(f"""WITH {_E}, f AS (SELECT user_id, t, event_id, event_type IN ('click', 'view') AS x, lag(event_type IN ('click', 'view')) OVER ({_W}) AS p FROM e),
i AS (SELECT *, sum(CASE WHEN x AND NOT coalesce(p, false) THEN 1 ELSE 0 END) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS island FROM f), s AS (SELECT user_id, CAST(island AS BIGINT) AS island, min(t) AS a, max(t) AS b FROM i WHERE x GROUP BY 1, 2)
SELECT user_id, island, greatest(a, 1704153600000000) AS first, least(b, 1704672000000000) AS last FROM s WHERE b >= 1704153600000000 AND a <= 1704672000000000""")
def stimulus_in_view(spark, sf_dir):
    on = temporal.islands(_events(spark, sf_dir).withColumn("on", F.col("event_type").isin("click", "view")), ["user_id"], ["t", "event_id"], "on")
    return relations.clipped(on, "first", "last", 1704153600000000, 1704672000000000).select("user_id", "island", "first", "last")


@query(f"""{_SIDES}, h AS (SELECT user_id, rt AS t, value > 50 AS x FROM r), f AS (SELECT *, lag(x) OVER (PARTITION BY user_id ORDER BY t) AS p FROM h), i AS (SELECT *, sum(CASE WHEN x AND NOT coalesce(p, false) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT user_id, CAST(island AS BIGINT) AS island, min(t) AS first, max(t) AS last, count(*) AS n FROM i WHERE x GROUP BY 1, 2""")
def state_segments(spark, sf_dir):
    _, right = _sides(spark, sf_dir)
    return temporal.islands(right.withColumn("on", F.col("value") > 50), ["user_id"], ["t"], "on")
