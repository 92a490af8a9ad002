import struct


from lumenframe.operators import estimators, stats, temporal
from lumenframe.sources import readers
from lumenframe.streaming import frames


def test_words_and_records(spark, tmp_path):
    good = [8 << 12 | 5, 5 ^ 3, 3]
    (tmp_path / "a.bin").write_bytes(struct.pack("<7H", 1, *good, 8 << 12 | 5, 1, 2))
    w = readers.words(spark, str(tmp_path))
    assert [(r.pos, r.w0) for r in readers.records(w, 8, 3).collect()] == [(1, good[0])] and w.count() == 7


def test_state_lines(spark):
    df = spark.createDataFrame([("3, fwd, bck",), ("4",), ("x, y",), (None,)], "value string")
    assert sorted(map(tuple, readers.state_lines(df).collect())) == [(3, "bck"), (3, "fwd")]


def test_frames_as_a_stream(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01 00:00:10' as ts, 1.0D as v union all select timestamp'2024-01-01 00:00:50', 2.0D union all select timestamp'2024-01-01 00:02:00', 4.0D").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, v double").parquet(f"{tmp_path}/in")
    q = frames.frame_counts(stream, "ts", "v", "1 minute").writeStream.outputMode("complete").format("memory").queryName("frames").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.n, r.total) for r in spark.table("frames").collect()) == [(1, 4.0), (2, 3.0)]


def test_interpolation_edges_and_ties(spark):
    knots = spark.createDataFrame([(1, 0.0, 0.0), (1, 10.0, 20.0)], "k int, t double, v double")
    at = spark.createDataFrame([(1, -5.0), (1, 5.0), (1, 10.0), (1, 15.0), (2, 1.0)], "k int, t double")
    got = {e: [r.v for r in temporal.interp_join(at, knots, ["k"], "t", "v", e).orderBy("k", "t").collect()] for e in ("null", "clamp", "extrap")}
    assert got == {"null": [None, 10.0, 20.0, None, None], "clamp": [0.0, 10.0, 20.0, 20.0, None], "extrap": [-10.0, 10.0, 20.0, 30.0, None]}
    assert temporal.asof_join(at.where("t = 5"), knots, ["k"], "t", ["v"], "nearest").first().v == 20.0


def test_unwrapped_phase_and_percentile(spark):
    df = spark.createDataFrame([(0, float(i), (i * 1.0 + 3.141592653589793) % (2 * 3.141592653589793) - 3.141592653589793) for i in range(20)], "k int, t double, p double")
    got = [r.u for r in temporal.unwrap_phase(df, ["k"], ["t"], "p", "u").orderBy("t").collect()]
    assert all(abs(b - a - 1) < 1e-9 for a, b in zip(got, got[1:]))
    assert stats.nearest_rank_by(df, ["k"], "t", 0.25, "q").first().q == 4.0


def test_estimators_recover_what_is_known():
    import numpy as np

    cost = np.ones((6, 5))
    for t, s in enumerate([0, 0, 1, 3, 3, 4]):
        cost[t, s] = 0
    assert estimators.viterbi(cost).tolist() == [0, 0, 1, 3, 3, 4]
    x, y = map(np.ravel, np.meshgrid(np.arange(12.0), np.arange(12.0)))
    kx, ky, phase = estimators.plane_wave(x, y, np.exp(1j * (0.3 * x - 0.2 * y + 0.5)))
    assert abs(kx - 0.3) < 1e-3 and abs(ky + 0.2) < 1e-3 and abs(phase - 0.5) < 0.02
    t = np.arange(200.0)
    assert np.abs(estimators.kalman(t, 2 * t, 1e-4, 1.0) - 2 * t)[50:].max() < 0.5
    assert abs(estimators.asymmetric_mean(np.r_[np.zeros(99), 1000.0])[0]) < 1
