"""Registered queries of strides, splits, boxes and repairs, each beside its SQL where SQL can state it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import behaviour
from .catalog import _E, _P, _events, _points, _t, query


@query("SELECT l_returnflag AS f, l_orderkey, l_linenumber, CAST(ntile(7) OVER (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber) AS INT) AS part FROM lineitem")
def equal_count_split(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "f")
    return behaviour.groups_of_equal_count(rows, ["f"], ["l_shipdate", "l_orderkey", "l_linenumber"], 7).select("f", "l_orderkey", "l_linenumber", "part")


def _hazen(p: float) -> str:
    return f"round(sum(greatest(0.0e0, 1 - abs(k - greatest(1.0e0, least(CAST(n AS DOUBLE), {p}e0 * n + 0.5)))) * d), 3)"


@query(f"""WITH {_P}, r AS (SELECT f, d, row_number() OVER (PARTITION BY f ORDER BY d) AS k, count(*) OVER (PARTITION BY f) AS n FROM p), b AS (SELECT f, {_hazen(0.01)} AS low, {_hazen(0.5)} AS middle, {_hazen(0.99)} AS high FROM r GROUP BY f)
SELECT *, (SELECT min(low) FROM b) AS all_low, (SELECT max(high) FROM b) AS all_high FROM b""")
def scan_boxes(spark, sf_dir):
    out = behaviour.scan_boxes(_points(spark, sf_dir), "f", "d")
    return out.select("f", *(F.round(c, 3).alias(c) for c in ("low", "middle", "high", "all_low", "all_high")))


_K = "PARTITION BY user_id ORDER BY t"


@query(f"""WITH {_E}, g AS (SELECT user_id, t, max(value) AS v FROM e GROUP BY 1, 2), m AS (SELECT user_id, t, CASE WHEN v >= max(v) OVER ({_K} ROWS UNBOUNDED PRECEDING) AND v <= min(v) OVER ({_K} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) THEN v END AS v FROM g),
x AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER p AS pt, last_value(v IGNORE NULLS) OVER p AS pv, first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER n AS nt, first_value(v IGNORE NULLS) OVER n AS nv FROM m WINDOW p AS ({_K} ROWS UNBOUNDED PRECEDING), n AS ({_K} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id, t, round(coalesce(v, CASE WHEN pt IS NOT NULL AND nt IS NOT NULL THEN pv + (nv - pv) * (t - pt) / (nt - pt) ELSE coalesce(pv, nv) END), 4) AS v FROM x""")
def monotone_repair(spark, sf_dir):
    g = _events(spark, sf_dir).groupBy("user_id", "t").agg(F.max("value").alias("v"))
    return behaviour.monotone_repaired(g, ["user_id"], "t", "v").withColumn("v", F.round("v", 4))


@query()
def labelled_strides(spark, sf_dir):
    e = _events(spark, sf_dir).groupBy("event_type", F.floor(F.col("t") / 3600000000).cast("double").alias("h")).agg(F.avg("value").alias("v"))
    label = F.when(F.floor(F.col("h") / 48) % 3 == 0, 1).when(F.floor(F.col("h") / 48) % 3 == 1, 2).otherwise(0)
    out = behaviour.labelled_strides(e.withColumn("label", label), ["event_type"], "h", "v", "label")
    return out.withColumn("phase", F.round("phase", 5))
