"""Registered queries of places, dwell and counts of a recording, each beside its SQL.

Bound to events: clicks and views are photons, signups the galvo's timers, purchases the AOD's settings, errors the lens's tags, users the beams.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import acquisition, grid
from .catalog import _BINS, _E, _IN, _P, AXES, _events, _points, _t, query

_STREAMS = f"""WITH {_E}, ph AS (SELECT event_id, user_id, t FROM e WHERE event_type IN ('click', 'view')), g AS (SELECT user_id, t AS rt, max(value) AS x FROM e WHERE event_type = 'signup' GROUP BY 1, 2),
a AS (SELECT user_id, t AS rt, max(value) AS x FROM e WHERE event_type = 'purchase' GROUP BY 1, 2), tg AS (SELECT user_id, rt, lead(rt) OVER (PARTITION BY user_id ORDER BY rt) - rt AS period FROM (SELECT DISTINCT user_id, t AS rt FROM e WHERE event_type = 'error'))"""


def _knots(spark, sf_dir, kind, name="x"):
    return _events(spark, sf_dir).where(F.col("event_type") == kind).groupBy("user_id", "t").agg(F.max("value").alias(name))


def _photons(spark, sf_dir):
    return _events(spark, sf_dir).where(F.col("event_type").isin("click", "view")).select("event_id", "user_id", "t")


def _line(knots: str, points: str, columns: str, edge: str = "NULL") -> str:
    """SQL of points with the value of knots (user_id, rt, x) interpolated at their time, as v."""
    return f"""SELECT {columns}, CASE WHEN p.rt = n.rt THEN p.x WHEN p.rt IS NOT NULL AND n.rt IS NOT NULL THEN p.x + (n.x - p.x) * (q.t - p.rt) / (n.rt - p.rt) ELSE {edge} END AS v
FROM {points} q ASOF LEFT JOIN {knots} p ON q.user_id = p.user_id AND q.t >= p.rt ASOF LEFT JOIN {knots} n ON q.user_id = n.user_id AND q.t <= n.rt"""


@query(f"{_STREAMS}, l AS ({_line('g', 'ph', 'q.event_id, q.user_id, q.t')}) SELECT event_id, round(v + coalesce(a.x, 0) - 1.5, 4) AS x FROM l ASOF LEFT JOIN a ON l.user_id = a.user_id AND l.t >= a.rt")
def photon_location(spark, sf_dir):
    out = acquisition.located(_photons(spark, sf_dir), _knots(spark, sf_dir, "signup"), _knots(spark, sf_dir, "purchase"), ["user_id"], "t", ["x"], {"x": 1.5})
    return out.select("event_id", F.round("x", 4).alias("x"))


@query(f"{_STREAMS} SELECT event_id, user_id, t FROM ph WHERE t BETWEEN 1704153600000000 - 30000000 AND 1704672000000000 + 30000000")
def time_range(spark, sf_dir):
    return acquisition.in_range(_photons(spark, sf_dir), "t", 1704153600000000, 1704672000000000, 30000000)


@query("WITH c AS (SELECT event_id // 64 AS chunk, epoch_us(min(ts)) AS t0, epoch_us(max(ts)) AS t1 FROM events GROUP BY 1) SELECT * FROM c WHERE 1704153600000000 < t1 AND 1705000000000000 >= t0")
def chunk_pruning(spark, sf_dir):
    """Chunks of 64 events each whose time meets a range."""
    e = _events(spark, sf_dir).groupBy(F.floor(F.col("event_id") / 64).cast("long").alias("chunk")).agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    return acquisition.chunks_for(e, 1704153600000000, 1705000000000000)


_COMMON = "c AS (SELECT user_id, greatest(min(rt), 1704153600000000) AS t0, least(max(rt), 1706745600000000) AS t1 FROM g GROUP BY user_id)"


@query(f"{_STREAMS}, {_COMMON} SELECT * FROM c WHERE t0 <= t1")
def range_intersection(spark, sf_dir):
    return acquisition.common_range(_knots(spark, sf_dir, "signup"), ["user_id"], "t", 1704153600000000, 1706745600000000)


@query(f"{_STREAMS}, {_COMMON} SELECT event_id FROM ph JOIN c USING (user_id) WHERE t0 <= t1 AND t BETWEEN t0 - 3600000000 AND t1 + 3600000000")
def slice_to_range(spark, sf_dir):
    ranges = acquisition.common_range(_knots(spark, sf_dir, "signup"), ["user_id"], "t", 1704153600000000, 1706745600000000)
    return acquisition.sliced(_photons(spark, sf_dir), ranges, ["user_id"], "t", 3600000000).select("event_id")


@query(f"WITH {_P} SELECT f, count(*) AS n FROM p WHERE f = 'R' GROUP BY f UNION ALL SELECT 'all', count(*) FROM p")
def colour_select(spark, sf_dir):
    p = _points(spark, sf_dir)
    one = acquisition.of_colour(p, "R", "f").groupBy("f").agg(F.count("*").alias("n"))
    return one.unionByName(acquisition.of_colour(p, "a", "f").agg(F.lit("all").alias("f"), F.count("*").alias("n")))


@query(f"""{_STREAMS}, s AS (SELECT unnest([0.25e0, 0.75e0]) AS s) SELECT user_id, round(rt + s * period) AS t, round(period / 2, 3) AS dwell, round(2 * pi() * s, 6) AS phase FROM tg, s WHERE period IS NOT NULL""")
def dwell_points(spark, sf_dir):
    out = acquisition.dwell_points(_events(spark, sf_dir).where("event_type = 'error'"), ["user_id"], "t")
    return out.select("user_id", F.round("t").alias("t"), F.round("dwell", 3).alias("dwell"), F.round("phase", 6).alias("phase"))


@query(f"{_STREAMS} SELECT user_id, 5 * count(*) AS n, round(sum(period), 0) AS dwell, 0 AS outside FROM tg WHERE period IS NOT NULL GROUP BY user_id")
def dwell_sampled(spark, sf_dir):
    """Each period's samples keep its dwell, and none is moved out of its fifth."""
    out = acquisition.dwell_sampled(_events(spark, sf_dir).where("event_type = 'error'"), ["user_id"], "t", 5)
    fifth = F.pmod(F.col("phase") / acquisition.TURN * 5, F.lit(1.0))
    return out.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("dwell"), 0).alias("dwell"), F.count_if(~fifth.between(0.24, 0.76)).cast("int").alias("outside"))


_TAGGED = f"{_STREAMS}, h AS (SELECT event_id, ph.user_id, t, 2 * pi() * (t - rt) / period AS phase FROM ph ASOF LEFT JOIN tg ON ph.user_id = tg.user_id AND ph.t >= tg.rt)"


def _phased(spark, sf_dir):
    return acquisition.phased(_photons(spark, sf_dir), _events(spark, sf_dir).where("event_type = 'error'"), ["user_id"], "t").drop("t_right")


@query(f"""{_TAGGED}, gc AS (SELECT user_id, rt, cos(x) AS x FROM g), gs AS (SELECT user_id, rt, sin(x) AS x FROM g), c AS ({_line('gc', 'h', 'q.*')}), s AS ({_line('gs', 'h', 'q.event_id')}),
r AS (SELECT event_id, phase - coalesce(atan2(s.v, c.v), 0) AS d FROM c JOIN s USING (event_id)) SELECT event_id, round(d - 2 * pi() * floor(d / (2 * pi())), 5) AS phase FROM r""")
def phase_correction(spark, sf_dir):
    out = acquisition.phase_corrected(_phased(spark, sf_dir), _knots(spark, sf_dir, "signup", "a"), ["user_id"], "t", "phase", "a")
    return out.select("event_id", F.round("phase", 5).alias("phase"))


@query(f"{_STREAMS}, l AS ({_line('g', 'ph', 'q.event_id', 'coalesce(p.x, n.x)')}) SELECT event_id, round(event_id - coalesce(v, 0), 4) AS x FROM l")
def offset_lookup(spark, sf_dir):
    points = _photons(spark, sf_dir).withColumn("x", F.col("event_id").cast("double"))
    return acquisition.offset_removed(points, _knots(spark, sf_dir, "signup"), ["user_id"], "t", ["x"]).select("event_id", F.round("x", 4).alias("x"))


@query(f"""{_STREAMS}, l AS ({_line('g', 'ph', 'q.event_id, q.user_id, q.t, p.rt AS pt, p.x AS pv, n.rt AS nt, n.x AS nv', 'coalesce(p.x, n.x)')}),
m AS (SELECT *, CASE WHEN pt IS NULL OR nt - t <= t - pt THEN nv ELSE pv END / 100 AS m FROM l)
SELECT event_id, round((1 + m) * (event_id % 7) - m * (event_id % 5) + v, 4) AS x, round(m * (event_id % 7) + (1 - m) * (event_id % 5) - v, 4) AS y FROM m""")
def scan_correction(spark, sf_dir):
    points = _photons(spark, sf_dir).withColumn("x", (F.col("event_id") % 7).cast("double")).withColumn("y", (F.col("event_id") % 5).cast("double"))
    m = F.col("x") / 100
    knots = _knots(spark, sf_dir, "signup").select("user_id", "t", (1 + m).alias("a11"), (-m).alias("a12"), m.alias("a21"), (1 - m).alias("a22"), F.col("x").alias("b1"), (-F.col("x")).alias("b2"))
    return acquisition.scan_corrected(points, knots, ["user_id"], "t").select("event_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(f"{_STREAMS}, l AS ({_line('g', 'ph', 'q.event_id', 'coalesce(p.x, n.x)')}) SELECT event_id, round((1 + event_id % 3) * coalesce(v / 40, 1), 2) AS dwell FROM l")
def dwell_correction(spark, sf_dir):
    points = _photons(spark, sf_dir).withColumn("dwell", (1 + F.col("event_id") % 3).cast("double"))
    return acquisition.dwell_corrected(points, _knots(spark, sf_dir, "signup", "rate"), ["user_id"], "t", "dwell", 40.0).select("event_id", F.round("dwell", 2).alias("dwell"))


_PHASED = f"WITH {_P}, q AS (SELECT *, 2 * pi() * (l_partkey % 360) / 360 AS a FROM p)"


def _lens(spark, sf_dir):
    return _points(spark, sf_dir).withColumn("a", F.lit(acquisition.TURN) * (F.col("l_partkey") % 360) / 360)


@query(f"{_PHASED}, w AS (SELECT *, (l_partkey % 360) / 45 AS s FROM q) SELECT l_partkey, round(sum(1 + abs(4 - floor(s)) + (abs(4 - floor(s) - 1) - abs(4 - floor(s))) * (s - floor(s))), 4) AS weight FROM w GROUP BY l_partkey")
def phase_weight(spark, sf_dir):
    table = spark.range(8).select((F.lit(acquisition.TURN) * F.col("id") / 8).alias("a"), (1.0 + F.abs(4 - F.col("id"))).alias("w"))
    out = acquisition.phase_weight(_lens(spark, sf_dir).select("l_partkey", "a"), table, "a", "w")
    return out.groupBy("l_partkey").agg(F.round(F.sum("w"), 4).alias("weight"))


@query(f"{_PHASED} SELECT f, round(sum(abs(sin(a)) / 0.7846), 4) AS weight, round(sum(30 * cos(a)), 3) AS z, round(sum(x + 0.1 * z), 3) AS sheared, round(sum(greatest(0.1e0, least(10e0, x / 10))), 3) AS clamped FROM q GROUP BY f")
def depth_terms(spark, sf_dir):
    total = lambda c, n, k: F.round(F.sum(c), k).alias(n)
    return _lens(spark, sf_dir).groupBy("f").agg(
        total(acquisition.depth_weight(F.col("a")), "weight", 4), total(acquisition.depth(F.col("a"), 30.0), "z", 3), total(acquisition.sheared(F.col("x"), F.col("z"), 0.1), "sheared", 3), total(acquisition.clamped(F.col("x") / 10, 10), "clamped", 3)
    )


@query(f"{_PHASED} SELECT f, count(*) AS n FROM q WHERE x BETWEEN 5 AND 40 AND y BETWEEN 1 AND 9 AND z BETWEEN 0 AND 7 AND cos(a) BETWEEN -0.9 AND 0.8 AND x * x + y * y < 1200 GROUP BY f")
def geometric_window(spark, sf_dir):
    c = F.col
    p = _lens(spark, sf_dir)
    return p.where(acquisition.in_window(c("x"), c("y"), c("z"), (5, 1, 0), (40, 9, 7), c("a"), (-0.9, 0.8), 1200**0.5)).groupBy("f").agg(F.count("*").alias("n"))


@query(f"""WITH {_P}, b AS (SELECT l_orderkey, l_partkey, x, y, z, {_BINS} FROM p), d AS (SELECT ix, iy, iz, ix / 10.0e0 AS tx, iy / 5.0e0 AS ty, iz / 2.0e0 AS tz FROM (SELECT DISTINCT ix, iy, iz FROM b WHERE ix BETWEEN 2 AND 6))
SELECT ix, iy, round(sum(x + coalesce(ty, 0)), 3) AS x, round(sum(y - coalesce(tx, 0)), 3) AS y, round(sum(z - coalesce(tz, 0)), 3) AS z FROM b LEFT JOIN d USING (ix, iy, iz) GROUP BY ix, iy""")
def displacement_lookup(spark, sf_dir):
    p = _points(spark, sf_dir)
    for column, axis in AXES:
        p = p.withColumn(f"i{axis.name}", axis.index(F.col(column)))
    field = p.where("ix BETWEEN 2 AND 6").select("ix", "iy", "iz").distinct().select("ix", "iy", "iz", (F.col("ix") / 10).alias("tx"), (F.col("iy") / 5).alias("ty"), (F.col("iz") / 2).alias("tz"))
    out = acquisition.displaced(p, field, [], ["ix", "iy", "iz"])
    return out.groupBy("ix", "iy").agg(*(F.round(F.sum(a), 3).alias(a) for a in "xyz"))


@query(f"WITH {_P} SELECT l_partkey, min(1 + 5.0e0 * least(10, greatest(0, floor((x - 1) / 5)))) AS low, max(1 + 5.0e0 * least(10, greatest(0, ceil((x + 3 - 1) / 5)))) AS high FROM p GROUP BY l_partkey")
def snap_to_grid(spark, sf_dir):
    start, width, n = acquisition.regular_axis([1.0 + 5 * i for i in range(11)])
    low, high = acquisition.snapped(F.col("x"), F.col("x") + 3, start, width, n)
    return _points(spark, sf_dir).select("l_partkey", low.alias("low"), high.alias("high")).groupBy("l_partkey").agg(F.min("low").alias("low"), F.max("high").alias("high"))


@query(f"{_STREAMS}, l AS ({_line('g', 'ph', 'q.event_id')}) SELECT event_id, round(event_id % 10 - v, 4) AS neuron_x FROM l")
def neuron_place(spark, sf_dir):
    track = _photons(spark, sf_dir).withColumn("x", (F.col("event_id") % 10).cast("double"))
    return acquisition.neuron_place(track, _knots(spark, sf_dir, "signup"), ["user_id"], "t", ["x"]).select("event_id", F.round("neuron_x", 4).alias("neuron_x"))


@query("SELECT o_orderkey, round((o_custkey % 100) / 100.0e0, 6) AS ax, round((o_custkey % 60) / 30.0e0 - 1, 6) AS ay, round((o_custkey % 40) / 10.0e0 - 2, 6) AS az FROM orders")
def affine_to_pose(spark, sf_dir):
    """Angles come back from the nine entries of ry rx rz."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", ((F.col("o_custkey") % 100) / 100.0).alias("a"), ((F.col("o_custkey") % 60) / 30.0 - 1).alias("b"), ((F.col("o_custkey") % 40) / 10.0 - 2).alias("c"))
    sa, ca, sb, cb, sc, cc = (f(x) for x in ("a", "b", "c") for f in (F.sin, F.cos))
    m = (cb * cc + sb * sa * sc, -cb * sc + sb * sa * cc, sb * ca, ca * sc, ca * cc, -sa, -sb * cc + cb * sa * sc, sb * sc + cb * sa * cc, cb * ca)
    return o.select("o_orderkey", *(F.round(v, 6).alias(k) for k, v in acquisition.pose_of_affine(m).items()))


@query(f"{_STREAMS} SELECT event_id, x AS pose FROM ph ASOF LEFT JOIN g ON ph.user_id = g.user_id AND ph.t >= g.rt")
def pose_at_time(spark, sf_dir):
    return acquisition.pose_at(_photons(spark, sf_dir), _knots(spark, sf_dir, "signup", "pose"), ["user_id"], "t", ["pose"]).select("event_id", "pose")


@query(f"""{_STREAMS}, d AS (SELECT *, x - lag(x) OVER (PARTITION BY user_id ORDER BY rt) AS d FROM (SELECT user_id, rt, x - 2 * pi() * floor(x / (2 * pi())) AS x FROM g)),
u AS (SELECT user_id, rt, x - 2 * pi() * sum(CASE WHEN abs(d) > pi() THEN ceil((abs(d) - pi()) / (2 * pi())) * sign(d) ELSE 0 END) OVER (PARTITION BY user_id ORDER BY rt) AS x FROM d),
l AS ({_line('u', 'ph', 'q.event_id', 'coalesce(p.x, n.x)')}) SELECT event_id, round(v + pi() - 2 * pi() * floor((v + pi()) / (2 * pi())) - pi(), 5) AS a FROM l""")
def pose_interpolation(spark, sf_dir):
    poses = _knots(spark, sf_dir, "signup", "a").withColumn("a", F.pmod(F.col("a"), F.lit(acquisition.TURN)))
    return acquisition.pose_interpolated(_photons(spark, sf_dir), poses, ["user_id"], "t", ["a"], []).select("event_id", F.round("a", 5).alias("a"))


@query(f"WITH {_P}, b AS (SELECT {_BINS} FROM p), v AS (SELECT ix, iy, count(*) AS n FROM b WHERE ix BETWEEN 0 AND 9 AND iy BETWEEN 0 AND 5 GROUP BY ix, iy) SELECT CAST(sum(n * n) AS BIGINT) AS squares, round(var_samp(n), 4) AS variance FROM v")
def sharpness(spark, sf_dir):
    v = grid.bin_points(_points(spark, sf_dir), AXES[:2], {"n": F.lit(1)})
    return acquisition.sharpness(v, "n").withColumn("variance", F.round("variance", 4))


@query("""WITH n AS (SELECT b AS bin, count(l_partkey) AS n FROM (SELECT unnest(range(36)) AS b) LEFT JOIN lineitem ON (l_partkey % 360) // 10 = b GROUP BY b), k(o, w) AS (VALUES (-1, 0.25e0), (0, 0.5e0), (1, 0.25e0)),
s AS (SELECT (bin + o + 36) % 36 AS bin, sum(n * w) AS s FROM n, k GROUP BY 1) SELECT bin, n, round((SELECT median(s) FROM s) / nullif(s, 0), 5) AS factor FROM n JOIN s USING (bin)""")
def phase_corrector(spark, sf_dir):
    p = _t(spark, sf_dir, "lineitem").withColumn("a", F.lit(acquisition.TURN) * (F.col("l_partkey") % 360 + 0.5) / 360)
    return acquisition.phase_corrector(p, "a", 36, [(-1, 0.25), (0, 0.5), (1, 0.25)]).withColumn("factor", F.round("factor", 5))


@query(f"""{_STREAMS}, s AS (SELECT user_id, rt AS t, x, x < 40 AS r FROM g), f AS (SELECT *, lag(r) OVER (PARTITION BY user_id ORDER BY t) AS p FROM s),
i AS (SELECT *, CAST(sum(CASE WHEN r AND NOT coalesce(p, false) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t) AS BIGINT) AS island FROM f),
o AS (SELECT user_id, island, min(t) AS first, max(t) AS last, round(avg(x), 4) AS x FROM i WHERE r GROUP BY 1, 2)
SELECT user_id, island, first, last, any_value(x) AS x, count(ph.t) AS n FROM o LEFT JOIN ph USING (user_id) WHERE ph.t IS NULL OR ph.t BETWEEN first AND last GROUP BY 1, 2, 3, 4
UNION ALL SELECT user_id, island, first, last, x, 0 FROM o WHERE user_id IN (SELECT user_id FROM ph) AND NOT EXISTS (SELECT 1 FROM ph WHERE ph.user_id = o.user_id AND ph.t BETWEEN first AND last)""")
def rest_epochs(spark, sf_dir):
    stage = _knots(spark, sf_dir, "signup").withColumn("r", F.col("x") < 40)
    out = acquisition.rest_epochs(stage, _photons(spark, sf_dir), ["user_id"], "t", ["x"], "r")
    return out.withColumn("x", F.round("x", 4))


@query(f"WITH {_E} SELECT user_id, CAST(floor(t / 3600000000) AS BIGINT) AS bin, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END)::BIGINT AS red, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END)::BIGINT AS green, max(t) AS last FROM e GROUP BY 1, 2")
def binned_counts(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("red", (F.col("event_type") == "click").cast("int")).withColumn("green", (F.col("event_type") == "view").cast("int"))
    return acquisition.binned_counts(e, ["user_id"], "t", 3600000000, ["red", "green"])


@query(f"{_STREAMS}, f AS (SELECT user_id, min(rt) AS a, max(rt) AS b FROM a GROUP BY 1), k AS (SELECT user_id, min(t) AS c, max(t) AS d FROM ph GROUP BY 1) SELECT user_id, greatest(a, c) AS t0, least(b, d) AS t1 FROM f JOIN k USING (user_id)")
def tracking_range(spark, sf_dir):
    frames = _knots(spark, sf_dir, "purchase").withColumn("end", F.col("t"))
    return acquisition.tracking_range(frames, _photons(spark, sf_dir), ["user_id"], "t", "end", "t")


@query(f"""{_STREAMS}, d AS (SELECT user_id, rt AS t, x, coalesce(lead(rt) OVER w, rt) - coalesce(lag(rt) OVER w, rt) AS dt, coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x) AS dx FROM g WINDOW w AS (PARTITION BY user_id ORDER BY rt))
SELECT user_id, t, round(abs(dx) / CASE WHEN dt > 0 THEN dt END * 3600000000, 4) AS speed, coalesce(abs(dx) / CASE WHEN dt > 0 THEN dt END * 3600000000 < 0.1, false) AS resting FROM d""")
def stage_table(spark, sf_dir):
    stage = _knots(spark, sf_dir, "signup").withColumn("h", F.col("t") / 3600000000)
    return acquisition.stage_table(stage, ["user_id"], "h", ["x"], 0.1).select("user_id", "t", F.round("speed", 4).alias("speed"), "resting")


@query("SELECT event_id, (event_id & 1) <> 0 AS scanning, (event_id & 2) <> 0 AS tracking, (event_id & 4) <> 0 AS out_of_range, (event_id & 8) <> 0 AS stim FROM events")
def legacy_bits(spark, sf_dir):
    from ..functions import bits

    return _t(spark, sf_dir, "events").select("event_id", *(v.alias(k) for k, v in list(bits.status_bits(F.col("event_id")).items())[:4]))
