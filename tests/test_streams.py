"""Streams give what the batch forms give, over several micro-batches."""

from pyspark.sql import functions as F

from lumenframe.operators import temporal
from lumenframe.streaming import frames


def test_unwrapping_carries_state_over_batches(spark, tmp_path):
    rows = [(k, i, (i * 37 + (5 if k == "b" else 0)) % 100) for i in range(60) for k in "ab"]
    for n, at in enumerate(range(0, 120, 40)):
        spark.createDataFrame(rows[at : at + 40], "k string, i int, c int").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema("k string, i int, c int").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(f"{tmp_path}/in")
    query = frames.unwrapped(stream, "k", "c", 100, "i").writeStream.format("memory").queryName("ticks").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.table("ticks").collect())
    want = temporal.unwrap_counter(spark.createDataFrame(rows, "k string, i int, c int"), ["k"], ["i"], "c", 100, "ticks")
    assert got == sorted((r.k, r.i, r.c, int(r.ticks)) for r in want.collect())


def test_issues_are_bits(spark):
    df = frames.flagged(spark.range(4), {"small": F.col("id") < 2, "even": F.col("id") % 2 == 0})
    assert [r.issues for r in df.orderBy("id").collect()] == [0, 2, 1, 3]
