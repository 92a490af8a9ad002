"""Files of fixed-width numbers, and the older tracker's text files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.sources import fixed, recordings


@pytest.mark.parametrize("layout", ["rows", "columns"])
def test_ranges_and_types(spark, tmp_path, layout):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(1000, 3)), rng.normal(size=(7, 3))
    for name, x in (("a.bin", a), ("b.bin", b), ("_c.bin", b), ("d.bin", b[:0])):
        (x if layout == "rows" else x.T).astype(">f4").tofile(tmp_path / name)
    with open(tmp_path / "a.bin", "ab") as f:
        f.write(b"abc" if layout == "rows" else b"")  # a last part of a row
    df = fixed.doubles(spark, str(tmp_path), ["t", "x", "y"], ">f4", layout, 300)
    want = np.concatenate([a, b]).astype(np.float32).astype(float)
    got = np.array(sorted(map(tuple, df.collect())))
    assert np.array_equal(got, want[np.lexsort(want.T[::-1])]) and df.rdd.getNumPartitions() == 5
    assert df.where((F.col("t") > 0.5) & (F.col("x") <= 0)).count() == int(((want[:, 0] > 0.5) & (want[:, 1] <= 0)).sum())
    assert df.where("y > 0 and y < 1 or t > 3").select("y").count() == int((((want[:, 2] > 0) & (want[:, 2] < 1)) | (want[:, 0] > 3)).sum())


def test_layouts_are_named():
    with pytest.raises(ValueError):
        fixed.Reader({"path": "/nowhere", "columns": "t x", "layout": "other"})


def test_a_round_trip(spark, tmp_path):
    df = spark.range(5000).select(F.col("id").alias("a"), (F.col("id") / 7).alias("b")).repartition(3)
    assert fixed.write_doubles(df, str(tmp_path / "d"), ["a", "b"]) == 5000
    back = fixed.doubles(spark, str(tmp_path / "d"), ["a", "b"], rows=512)
    assert back.count() == 5000 and back.where("abs(b - a / 7) > 0").count() == 0 and back.agg(F.sum("a")).first()[0] == 5000 * 4999 / 2
    assert fixed.write_doubles(df.limit(0), str(tmp_path / "e"), ["a"]) == 0 and fixed.doubles(spark, str(tmp_path / "e"), ["a"]).count() == 0


def lines(rows):
    return "\n".join("\t".join(map(str, r)) for r in rows) + "\nno numbers here\n"


def test_the_older_tracker(spark, tmp_path):
    # two spots of three channels; the second is never tracked; one row's time does not rise
    rows = [(k % 6, k, 0, 4, 2 if k % 6 < 3 and k > 10 else 0, 1, 1, 0.01 * k, k) for k in range(60)]
    rows.insert(30, (0, 99, 0, 4, 2, 1, 1, 0.05, 99))
    (tmp_path / "a.txt").write_text(lines(rows))
    got = recordings.old_tracker(spark, str(tmp_path / "a.txt")).toPandas()
    assert set(got.spot) == {0} and len(got) == 30 and (got.innovation == 2).all() and got.tracking.sum() == sum(k % 6 < 3 and k > 10 for k in range(60))
    # a status that never says tracking: the longest stretch of close samples of channel 1
    at = np.concatenate([np.arange(0, 5), 100 + np.arange(0, 20), 300 + np.arange(0, 3)]) * 0.0005
    (tmp_path / "b.txt").write_text(lines([(1, 0, 0, 0, 1, 0, 0, t, 0) for t in at]))
    got = recordings.old_tracker(spark, str(tmp_path / "b.txt")).toPandas()
    assert got.tracking.sum() == 18 and got.innovation.isna().all() and got[got.tracking].et.min() == pytest.approx(0.0505)
