"""Registered queries of frames of images, each beside its SQL where SQL can state it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blocks, images
from .catalog import _t, query


def _months(spark, sf_dir):
    """Places of lineitem by month of delivery."""
    c = F.col
    month = F.months_between(F.trunc("l_shipdate", "month"), F.lit("1992-01-01").cast("date")).cast("long")
    return _t(spark, sf_dir, "lineitem").select(month.alias("frame"), (c("l_quantity") - 1).cast("int").alias("x"), F.round(c("l_discount") * 100).cast("int").alias("y"), c("l_extendedprice").alias("v"))


_MONTH = "m AS (SELECT CAST(date_diff('month', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS frame, l_extendedprice AS v FROM lineitem)"


@query(f"WITH {_MONTH}, g AS (SELECT frame, sum(v) AS total, avg(v) AS mean FROM m GROUP BY frame) SELECT frame, round(total, 2) AS total, round(mean, 4) AS mean, round(total - lag(total) OVER (ORDER BY frame), 2) AS change FROM g")
def intensity_series(spark, sf_dir):
    out = images.intensity(_months(spark, sf_dir).withColumn("k", F.lit(1)), ["k"], "frame", "v")
    return out.select("frame", F.round("total", 2).alias("total"), F.round("mean", 4).alias("mean"), F.round("change", 2).alias("change"))


@query()
def frame_shifts(spark, sf_dir):
    """How far the prices' image of each month is from that of the month before."""
    return images.frame_shifts(_months(spark, sf_dir).withColumn("k", F.lit(1)), ["k"], "frame", {"x": 50, "y": 11}, "v").drop("k")


@query()
def bright_spots(spark, sf_dir):
    """The centre of the largest bright region of each month's image."""
    return images.bright_spots(_months(spark, sf_dir).withColumn("k", F.lit(1)), ["k"], "frame", {"x": 50, "y": 11}, "v", 0.9).drop("k")


@query()
def smoothed_movie(spark, sf_dir):
    """Prices over places by month, smoothed in blocks."""
    m = _months(spark, sf_dir).where("frame % 12 = 0").groupBy("frame", "x", "y").agg(F.sum("v").alias("counts"), F.count("*").alias("dwell"))
    return blocks.smoothed_movie(m, {"x": 50, "y": 11}, "frame", "rate", 0.5, block=16, halo=4).withColumn("v", F.round("v", 2))
