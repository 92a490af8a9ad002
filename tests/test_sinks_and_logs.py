"""What is written comes back; logs are read as they are meant."""

import json

from pyspark.sql import functions as F

from lumenframe.sources import logs, readers, sinks


def test_points_and_frames_come_back(spark, tmp_path):
    p = spark.createDataFrame([(float(i), i % 3, "rg"[i % 2], 1) for i in range(40)], "t double, x int, color string, n int")
    sinks.points(p, f"{tmp_path}/p", ["t", "x"])
    assert spark.read.parquet(f"{tmp_path}/p").dtypes == [("t", "double"), ("x", "double")]
    sinks.points_by_time(p, f"{tmp_path}/c", "t", 5.0, ["color"])
    back = spark.read.parquet(f"{tmp_path}/c")
    assert back.count() == 40 and back.where("chunk = 2 and color = 'g'").agg(F.min("t"), F.max("t")).first()[:] == (11.0, 13.0)
    v = spark.createDataFrame([(f, x, f + x, 1.0 * x) for f in range(3) for x in range(4)], "frame int, ix int, counts int, dwell double")
    sinks.frames(v, f"{tmp_path}/f", "rigid", metric=F.lit(0.5))
    sinks.frames(v, f"{tmp_path}/f", "raw", mode="append")
    got = sinks.stored_frames(spark, f"{tmp_path}/f", "rigid", {"ix": 1}, {"ix": 2})
    assert got.count() == 6 and got.where("metric = 0.5").count() == 6 and sinks.stored_frames(spark, f"{tmp_path}/f", "raw").count() == 11
    sinks.table(v, f"{tmp_path}/t", ["frame"])
    assert spark.read.parquet(f"{tmp_path}/t").count() == 12
    for name in ("a", "b"):
        sinks.append_regions(v.select("ix").distinct(), f"{tmp_path}/v", name)
    assert sorted(r.voiset for r in spark.read.parquet(f"{tmp_path}/v").select("voiset").distinct().collect()) == ["a", "b"]


def test_states_and_places_come_back(spark, tmp_path):
    flags = spark.createDataFrame([(1, "b", True), (1, "a", True), (2, "a", False), (3, None, True), (None, "a", True)], "frame long, state string, on boolean")
    sinks.state_lines(flags, f"{tmp_path}/s")
    sinks.state_lines(flags, f"{tmp_path}/d", condensed=True)
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/s").collect()) == ["1, a, b", "2", "3"]
    lines = spark.read.text(f"{tmp_path}/d")
    assert [r.value for r in lines.collect()] == ["1, a, b"] and sorted((r.frame, r.state) for r in readers.state_lines(lines).collect()) == [(1, "a"), (1, "b")]
    heads = spark.createDataFrame([(1, 2.0, 3.0), (2, None, 1.0), (3, float("nan"), 1.0), (4, 1.0, float("inf"))], "frame long, x double, y double")
    sinks.places_csv(heads, f"{tmp_path}/h", ["frame", "x", "y"])
    assert [tuple(r) for r in logs.places(spark, f"{tmp_path}/h").collect()] == [(1, 2.0, 3.0)]
    merged = sinks.merged_annotations(heads.where("frame < 3"), heads.withColumn("x", F.lit(9.0)))
    assert sorted((r.frame, r.x) for r in merged.where("x is not null").collect()) == [(1, 2.0), (3, 9.0), (4, 9.0)]


def test_logs(spark, tmp_path):
    c = spark.createDataFrame([("a", i, n, s) for i, (n, s) in enumerate([(1, 0), (1, 5), (2, 9), (2, 9), (3, 8), (5, 20)])], "k string, i int, n long, s long")
    got = logs.counter_log(c, ["k"], ["i"], "n", ["s"]).orderBy("i").collect()
    assert [(r.n, r.n_step, r.s_step, r.steady) for r in got] == [(1, None, None, False), (2, 1, 9, True), (3, 1, -1, False), (5, 2, 12, False)]
    log = logs.commands(spark.createDataFrame([("a", 1.0, 3, 10), ("a", 5.0, 3, 20), ("a", 2.0, 1, 0), ("a", 3.0, 99, 0)], "k string, t double, code int, data int"))
    s = {r.command: r for r in logs.command_summary(log, "t").collect()}
    assert set(s) == {"stim", "start"} and s["stim"].n == 2 and s["stim"].times == "1.0 5.0" and s["stim"].line == "stim: 2, from 1.0 to 5.0"
    times = spark.createDataFrame([("a", 0.5), ("a", 1.0), ("a", 4.0), ("a", 9.0)], "k string, t double")
    assert [r.data for r in logs.level_at(times, log, ["k"], "t", "stim", "data").orderBy("t").collect()] == [None, 10, 10, 20]
    (tmp_path / "x.json").write_text(json.dumps([{"imagingSettings": {"xScanRange_Microns": 100.0, "yScanRange_Microns": 50.5, "pixelSize_Microns": 2.0, "numYPixels": 7}}]))
    r = logs.scan_settings(spark, str(tmp_path / "x.json")).collect()[0]
    assert (r.nx, r.ny, r.nz) == (50, 7, 1)
    assert [(r.frame, r.t0, r.t1) for r in logs.frame_edges(spark, 1.0, 2.6, 0.5).collect()] == [(0, 1.0, 1.5), (1, 1.5, 2.0), (2, 2.0, 2.5)]
    assert logs.newest(spark, str(tmp_path / "x.json")).collect()[0].length > 50


def test_all_times_of_a_command_in_order(spark):
    rows = [("stim", float(86400 * (i % 5) + i), 1) for i in range(3000)] + [("stop", 3.0, 1), (None, 1.0, 1), ("stop", None, 1)]
    got = logs.command_times(spark.createDataFrame(rows, "command string, t double, x int").repartition(3), "t").orderBy("command", "place").collect()
    stim = [r for r in got if r.command == "stim"]
    assert [r.place for r in stim] == list(range(3000)) and [r.t for r in stim] == sorted(t for c, t, _ in rows if c == "stim") and len(got) == 3001
