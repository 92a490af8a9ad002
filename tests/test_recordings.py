from lumenframe.sources import recordings as r

HEX = "0f" * 21


def test_tracker_unwraps_scales_and_drops(spark, tmp_path):
    head = "timer\taxis\tstatus\tloc\tnum_phot_detections_from_pmt_in_spot\tweighted_sum\n"
    rows = ["4294967290\t0\t1\t64\t4\t10", "4\t0\t3\t128\t0\t10", "4\t0\t3\t640\t2\t10", "5\t301\t1\t64\t1\t1", "6\t4\t\t\t\t", "\t1\t1\t1\t1\t1"]
    (tmp_path / "a.txt").write_text(head + "\n".join(rows) + "\n")
    raw = r.numbered(spark, str(tmp_path), "timer long, axis int, status int, loc double, num_phot_detections_from_pmt_in_spot long, weighted_sum double")
    got = r.tracker(raw).orderBy("pos").collect()
    assert [round(x["t"] * 1.6e8 / 256) for x in got] == [4294967290, 4294967300, 4294967302]
    assert [(x["spot"], x["dim"], x["loc"], x["com"]) for x in got] == [(1, 0, 1.0, 2.5), (1, 0, 2.0, None), (2, 1, None, None)]


def test_encoder_keeps_whole_lines_near_the_median(spark):
    lines = [f"{k} {k * 10} {100 + k} 200 400 0 {HEX}" for k in range(1, 8)] + [f"8 80 900000 200 400 0 {HEX}", "9 90 100 200 400 0 0f0f", f"x 90 100 200 400 0 {HEX}", "", None]
    got = r.encoder(spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "pos long, value string"), order=["pos"]).orderBy("pos").collect()
    assert [x["valid"] for x in got] == [True] * 7 + [False] * 5
    assert abs(got[0]["x"] - 101 * 0.022) < 1e-9 and abs(got[0]["z"] - 400 * 0.0055) < 1e-9


def test_clock_fit(spark):
    d = spark.createDataFrame([("a", float(k), 2.0 * k + 5) for k in range(5)] + [("b", 1.0, 1.0)], "f string, t double, u double")
    got = {x["f"]: x for x in r.clock_fit(d, ["f"], "t", "u").collect()}
    assert abs(got["a"]["slope"] - 2) < 1e-9 and abs(got["a"]["intercept"] - 5) < 1e-9 and got["b"]["slope"] is None


def test_camera_segments_match_by_length(spark):
    numbers = [1, 2, 3, 90, 91, 93, 98, 99, 100, 101, 102, 103, 7, 8, 9, 10, 11, 12, 13, 14, 15]
    log = spark.createDataFrame([("a", i, n) for i, n in enumerate(numbers)], "f string, pos long, frame long")
    found = r.frame_segments(log, ["f"], ["pos"], "frame")
    assert sorted((x["segment"], x["n"], x["first"], x["last"]) for x in found.collect()) == [(1, 3, 1, 3), (2, 9, 90, 103), (3, 9, 7, 15)]
    assert [tuple(x) for x in r.match_by_length(found, 9, ["f"]).collect()] == [("a", 2, 9, 90, 103)]
    assert r.match_by_length(found, 6, ["f"]).count() == 0 and r.frame_segments(log.where("pos < 0"), ["f"], ["pos"], "frame").count() == 0
