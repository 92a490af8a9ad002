"""Clock joins over parts of the clock give what they give over the whole."""

import random

import pytest

from lumenframe.operators import segments, temporal


@pytest.mark.parametrize("kind", ["previous", "next", "nearest"])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_parts_of_the_clock_change_nothing(spark, keys, kind):
    rng = random.Random(1)
    left = spark.createDataFrame([(i, rng.choice("ab") if i % 9 else None, float(rng.randint(0, 60)) if i % 17 else None) for i in range(150)], "i long, k string, t double")
    right = spark.createDataFrame([(rng.choice("ab"), float(rng.randint(20, 45)), i) for i in range(12)] + [(None, 30.0, 99), ("a", 100.0, 7)], "k string, t double, v long")
    want = sorted(map(str, temporal.asof_join(left, right, keys, "t", ["v"], kind, 1).collect()))
    assert sorted(map(str, temporal.asof_join(left, right, keys, "t", ["v"], kind, 7).collect())) == want and len(want) == 150


def test_no_single_task_without_keys(spark):
    left = spark.range(100).selectExpr("cast(id as double) as t")
    plan = temporal.asof_join(left, left.selectExpr("t", "t as v"), [], "t", ["v"])._jdf.queryExecution().executedPlan().toString()
    windows = [x for x in plan.split("\n") if "Window" in x and "_before" not in x and "_after" not in x]
    assert windows and all("_span" in x for x in windows)


def test_gaps_of_a_wide_range(spark):
    seen = spark.createDataFrame([(x,) for x in (5, 7, 7, 1000, None, 11)], "c long")
    want = sorted(set(range(5, 1001)) - {5, 7, 1000, 11})
    assert [sorted(r.c for r in segments.missing_counters(seen, "c", n).collect()) for n in (1, 5)] == [want, want]
