"""Periodic runs against brute force and on edge cases."""

import zlib

import numpy as np
import pytest

from lumenframe.llm import common, periodic_runs


def runs_by_brute_force(w, least, times=3):
    n, out = len(w), {}
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            first = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            if i > first and i - first + p >= max(least, times * p):
                out.setdefault((first, i - first + p), p)
            i += i == first
    return sorted((s, length, p) for (s, length), p in out.items())


def texts(rng):
    for _ in range(rng.integers(1, 6)):
        unit = rng.integers(0, 3, rng.integers(1, 20))
        kind = rng.integers(0, 4)
        yield (
            rng.integers(0, rng.integers(1, 4), rng.integers(0, 120)) if kind == 0
            else rng.integers(0, 999, rng.integers(0, 60)) if kind == 1
            else np.concatenate([unit, np.tile(unit, rng.integers(1, 12)), unit[:7]]) if kind == 2
            else np.tile(np.concatenate([np.tile(unit, 9), unit[:3]]), 4)
        )


@pytest.mark.parametrize("least", [24, 3])
@pytest.mark.parametrize("pending", [1 << 20, 5])
def test_runs_by_brute_force(monkeypatch, least, pending):
    monkeypatch.setattr(periodic_runs, "PENDING", pending)
    rng = np.random.default_rng(least)
    for _ in range(60):
        rows = list(texts(rng))
        h = common.mix(np.concatenate(rows).astype(np.uint64) + np.uint64(9))
        got = periodic_runs.runs(h, np.cumsum([0, *map(len, rows)]), least)
        assert list(zip(*(x.tolist() for x in got), strict=True)) == [(d, *x) for d, w in enumerate(rows) for x in runs_by_brute_force(w.tolist(), least)]


def test_extensions_of_any_two_places():
    rng = np.random.default_rng(3)
    w = np.concatenate([rng.integers(0, 2, 80), np.tile(rng.integers(0, 2, 31), 20), rng.integers(0, 2, 40)]).astype(np.uint64)
    x, _ = periodic_runs._joined(common.mix(w), np.array([0, len(w)]))
    i, j = (rng.integers(1, len(w), 4000) for _ in range(2))
    i, j = i[i != j], j[i != j]
    want = [next(t for t in range(len(x)) if x[a + t] != x[b + t]) for a, b in zip(i, j, strict=True)]
    assert periodic_runs.Extensions(x).of(i, j).tolist() == want


def test_nulls_long_texts_repeated_rows_and_clashing_names(spark):
    line = "the same line again and again\n"
    long = " ".join(f"w{i}" for i in range(30_000)) + " " + "x y z " * 9000
    rows = [(1, None, 5), (2, "", 5), (3, " \n\t", 5), (4, line * 9, 5), (4, line * 9, 5), (None, "a " * 24 + "b", None), (5, long, 1), (6, "a " * 23, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    out = periodic_runs.with_runs(docs)
    assert out.columns == ["doc_id", "text", "runs", "n_words", "_runs", "collapsed_text"]
    got = sorted(((r.doc_id or 0, r.n_words, [tuple(x) for x in r._runs], r.collapsed_text[-40:]) for r in out.collect()), key=str)
    nine = (4, 54, [(0, 54, 6)], line.strip())
    assert got == sorted([(0, 25, [(0, 24, 1)], "a b"), (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), nine, nine, (5, 57_000, [(30_000, 27_000, 3)], long[:long.index(" x ")][-34:] + " x y z"), (6, 23, [], ("a " * 23).strip()[-40:])], key=str)
    assert periodic_runs.with_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.with_runs(docs, times=2)


def test_rebuilt_words(spark):
    docs = spark.createDataFrame([(i, " ".join(f"{i}-{j}" for j in range(i % 40)) or None, "x") for i in range(400)], "doc_id long, text string, w string")
    got = {r.doc_id: (r.text or "").split() for r in periodic_runs.rebuilt(docs).collect()}
    for i in range(400):
        w, h = [f"{i}-{j}" for j in range(i % 40)], zlib.crc32(str(i).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        assert got[i] == w


def test_the_strongest_run_is_exact_and_the_first(spark):
    df = spark.sql("select array(named_struct('start', 0L, 'length', 30L, 'period', 10L), named_struct('start', 1L, 'length', 301L, 'period', 100L), named_struct('start', 2L, 'length', 903L, 'period', 300L)) as r, filter(array(named_struct('start', 0L, 'length', 1L, 'period', 1L)), x -> false) as e")
    assert df.select(periodic_runs.strongest(df.r).alias("a"), periodic_runs.strongest(df.e).alias("b")).first() == ((1, 301, 100), None)
