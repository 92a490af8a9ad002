"""The toxicity classifier: counts and features by brute force, held-out labels, edge cases."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lumenframe.llm import toxicity

SF = "/root/testdata/sf0.1"


def plain(t):
    t = "".join(x if x.isalnum() else " " for x in f" {(t or '').lower()} ")
    while "  " in t:
        t = t.replace("  ", " ")
    return t


def grams_by_brute_force(t):
    t = plain(t)
    return Counter(t[i : i + n] for n in toxicity.NGRAMS for i in range(len(t) - n + 1))


TEXTS = ["You IDIOT, you!", None, "", " \n\t ..", "é", "naïve  Ünï-cøde 𝒳𝒴 日本語 text", "abc" * 50, "You IDIOT, you!", "x y"]


def test_grams_by_brute_force():
    bucket, row = toxicity.grams(pa.array(TEXTS, pa.string()))
    names = {}
    for i, t in enumerate(TEXTS):
        got, want = Counter(bucket[row == i].tolist()), grams_by_brute_force(t)
        assert sorted(got.values()) == sorted(want.values())  # no two of these meet in one bucket
        for g in want:
            one = toxicity.grams(pa.array([t]))[0]
            assert set(one.tolist()) == set(got)
        names[i] = got
    assert names[0] == names[7]
    alone = toxicity.grams(pa.array(["idiot"]))[0]
    assert set(alone.tolist()) <= set(names[0])  # the same word with its spaces, whatever stands around it


def test_counts_and_ratios_by_brute_force(spark):
    rows = [(i % 3 == 0, t) for i, t in enumerate(TEXTS) if t is not None]
    labelled = spark.createDataFrame([(int(y), t) for y, t in rows], "y int, text string").repartition(3)
    want = {0: Counter(), 1: Counter()}
    for y, t in rows:
        want[int(y)].update(set(toxicity.grams(pa.array([t]))[0].tolist()))
    counted = toxicity.counts(labelled)
    got = {r.bucket: (r.others, r.toxic) for r in counted.collect()}
    assert got == {b: (want[0][b], want[1][b]) for b in {*want[0], *want[1]}}
    p, q = (sum(x[i] + 1 for x in got.values()) for i in (1, 0))
    r = {b: math.log((x[1] + 1) / p) - math.log((x[0] + 1) / q) for b, x in got.items()}
    z = {b: abs(r[b]) / math.sqrt(1 / (got[b][1] + 1) + 1 / (got[b][0] + 1)) for b in got}
    chosen = toxicity.ratios(counted, 20).collect()
    assert sorted(z[x.bucket] for x in chosen) == pytest.approx(sorted(z.values())[-20:]) and all(x.r == pytest.approx(r[x.bucket]) for x in chosen)


def test_features_are_presence_times_ratio():
    rows = [np.array(x, np.uint16) for x in ([0], [0, 1], [1], [], [1], [])]
    y = np.array([1, 1, 0, 0, 0, 0], float)
    w, b = toxicity.fit(rows, y, np.ones(6), np.array([2.0, -1.0]), steps=2000)
    assert w[0] > 0.5 and b < -1 and 2 * w[0] + b > 1
    grown, _ = toxicity.fit(rows, y, np.ones(6), np.array([0.0, -1.0]), steps=200)
    assert grown[0] == 0  # a ratio of 0 gives a feature nothing to say


def test_held_out_labels(spark):
    got = toxicity.op12_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert len(got) > 900 and (got.predicted == got.toxic).mean() > 0.97
    assert got.predicted[got.toxic == 0].mean() < 0.005 and ((got.score >= 0) & (got.score <= 1)).all()


def test_nulls_long_texts_ties_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MOST", 6)
    monkeypatch.setattr(toxicity, "COUNTED", 14)
    rows = [(i, f"a vile word number {i} " if i % 2 else f"some good text {i}", 1.5) for i in range(40)] + [(90, None, 1.0), (91, "", 1.0), (None, "a vile word", None), (92, "good text " * 30_000 + "vile word", 2.0), (1, "a vile word number 1 ", 1.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(1, 0), (None, 1), (3, None), (90, 1)], "doc_id long, toxic int")
    out = toxicity.scored(docs, toxicity.train(docs, labels))
    assert out.columns == ["doc_id", "text", "score", "_score"]
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r._score <= 1 for r in got)
    assert min(r._score for r in got if r.text and r.text.startswith("a vile")) > max(r._score for r in got if r.text and r.text.startswith("some good"))
    assert len({r._score for r in got if not r.text}) == 1
    again = toxicity.scored(docs.repartition(5), toxicity.train(docs.repartition(7), labels)).collect()
    assert sorted((r.doc_id or -1, r._score) for r in again) == sorted((r.doc_id or -1, r._score) for r in got)


def test_without_labels_or_texts(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.scored(docs, toxicity.train(docs, none)).collect()] == [0.5, 0.5]
    assert toxicity.scored(docs.limit(0), toxicity.train(docs.limit(0), none)).count() == 0
    one = toxicity.scored(docs, toxicity.train(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))).collect()
    assert all(r.score > 0.9 for r in one)
