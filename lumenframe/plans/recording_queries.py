"""Registered queries of raw recordings, each beside its SQL: word files are written from events, and decoded."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.shared import scratch
from ..sources import decode, encode, fixed
from .catalog import _events, _t, query

_TICK = "r AS (SELECT event_id * 65536 + (user_id * 7919) % 65536 AS tick, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 ELSE 1 END AS color FROM events)"


def _decoded(spark, sf_dir, absolute: bool):
    """Records of the word files that hold each event as a photon, 4,096 events to a counter."""
    kind = F.when(F.col("event_type") == "view", 2).when(F.col("event_type") == "purchase", 3).otherwise(1)
    photons = _events(spark, sf_dir).select((F.col("event_id") * 65536 + F.col("user_id") * 7919 % 65536).alias("tick"), kind.alias("color"))
    path = scratch(spark, "recording")
    encode.recording(photons, path, absolute).count()
    cut = decode.ranges(spark, path, 1 << 18)
    indexed = decode.index(decode.scan(cut))
    return indexed, decode.decoded(cut, indexed)


@query(f"""WITH {_TICK}, p AS (SELECT 'g' AS color, tick FROM r WHERE color <> 2 UNION ALL SELECT 'r', tick FROM r WHERE color <> 1)
SELECT color, tick, round(2 * pi() * ((tick - 4) % 1024) / 1024, 5) AS phase FROM p""")
def raw_photons(spark, sf_dir):
    """Photons of tags that give their time."""
    photons = decode.of_kind(_decoded(spark, sf_dir, True)[1], "photon", ["color", "tick", "phase"]).where("beam = 1")
    return photons.select("color", "tick", F.round("phase", 5).alias("phase"))


@query(f"""WITH {_TICK}, c AS (SELECT unnest(range(min(tick) // 268435456, max(tick) // 268435456 + 1)) AS counter FROM r), k AS (SELECT * FROM (VALUES ('timer', 65536::BIGINT, 4096::BIGINT, 0::BIGINT), ('aod', 4096, 65536, 160), ('tag', 262144, 1024, 4)) t(kind, n, step, first))
SELECT kind, counter, CAST(n AS BIGINT) AS n, CAST(counter * 268435456 * n + first * n + step * (n * (n - 1) // 2) AS DOUBLE) AS ticks FROM c, k""")
def raw_clock(spark, sf_dir):
    """Timers, settings and tags of each counter, and the sum of their times."""
    e = _decoded(spark, sf_dir, True)[1].where("beam = 1 and kind <> 'photon'")
    counter = F.floor(F.col("tick") / decode.COUNTER)
    return e.groupBy("kind", counter.alias("counter")).agg(F.count("*").alias("n"), F.sum(F.col("tick").cast("double")).alias("ticks"))


@query(f"""WITH {_TICK}, c AS (SELECT unnest(range(min(tick) // 268435456, max(tick) // 268435456 + 1)) AS counter FROM r)
SELECT counter, CAST(65536 AS BIGINT) AS n, true AS complete, CAST(0 AS BIGINT) AS bad, CAST(262144 AS BIGINT) AS tags, CAST(0 AS BIGINT) AS far FROM c""")
def raw_intervals(spark, sf_dir):
    """Of each counter of files whose tags hold the interval since the last one: its timers, tags, and those over half a timer's step off."""
    indexed, events = _decoded(spark, sf_dir, False)
    c = decode.counters(indexed).select("file", "counter", "n", "complete").join(decode.report(indexed).select("file", "bad"), "file")
    tags = events.where("kind = 'tag' and beam = 1").withColumn("i", F.row_number().over(Window.partitionBy("file").orderBy("pos")) - 1)  # a file is one counter
    off = F.abs(F.col("tick") - (F.col("counter") * decode.COUNTER + encode.LATE + F.col("i") * (decode.STEP // encode.TAGS)))
    found = tags.select("file", "tick", "i").join(c.select("file", "counter"), "file").groupBy("file").agg(F.count("*").alias("tags"), F.count_if(off > decode.STEP // 2).alias("far"))
    return c.join(found, "file").drop("file")


@query("""WITH p AS (SELECT l_quantity AS x, l_discount AS y, l_tax AS z, l_extendedprice AS d, CAST(l_orderkey AS DOUBLE) AS o, CAST(l_linenumber AS DOUBLE) AS n FROM lineitem)
SELECT x, count(*) AS n, round(sum(d), 2) AS total, round(sum(o + n), 0) AS keys, round(max(y + z), 6) AS top FROM p WHERE x >= 20 AND d < 60000 GROUP BY x""")
def raw_points(spark, sf_dir):
    """Points written as six raw doubles a row, and read again in ranges of 4,096 rows."""
    c = F.col
    names = ["x", "y", "z", "d", "o", "n"]
    p = _t(spark, sf_dir, "lineitem").select(c("l_quantity").alias("x"), c("l_discount").alias("y"), c("l_tax").alias("z"), c("l_extendedprice").alias("d"), c("l_orderkey").alias("o"), c("l_linenumber").alias("n"))
    path = scratch(spark, "points")
    fixed.write_doubles(p, path, names)
    back = fixed.doubles(spark, path, names, rows=4096).where((c("x") >= 20) & (c("d") < 60000))
    return back.groupBy("x").agg(F.count("*").alias("n"), F.round(F.sum("d"), 2).alias("total"), F.round(F.sum(c("o") + c("n")), 0).alias("keys"), F.round(F.max(c("y") + c("z")), 6).alias("top"))
