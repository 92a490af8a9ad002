"""Fits of curves whose cost is not the squared error: by moments and by candidates, so that a round is one aggregation of any table."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import kept
from . import descent


def _solved(keys: list[str], degree: int, batches):
    """Coefficients of each row's normal equations; of equations without one solution those of least size."""
    for d in batches:
        m = d[[f"_m{i}" for i in range(2 * degree + 1)]].to_numpy(float)
        y = d[[f"_y{i}" for i in range(degree + 1)]].to_numpy(float)
        a = m[:, np.arange(degree + 1)[:, None] + np.arange(degree + 1)[None]]
        c = np.stack([np.linalg.lstsq(p, q, rcond=1e-13)[0] for p, q in zip(a, y, strict=True)]) if len(d) else np.zeros((0, degree + 1))
        yield pd.DataFrame({**{k: d[k] for k in keys}, **{f"c{i}": c[:, i] for i in range(degree + 1)}})


def least_deviation(rows: DataFrame, keys: list[str], x: str, y: str, degree: int = 1, rounds: int = 8, least: float = 1e-6, weight: str | None = None) -> DataFrame:
    """Of each key c0, c1, ... of the polynomial with the least sum of (weighted) absolute deviations, n and `deviation`, that sum.

    Rounds of least squares whose weights are one over the last round's deviation, `least` at the least: each round is one aggregation of
    2 degree + 1 moments of x and degree + 1 of x y by key.  Rows with a null x or y, or a weight that is not positive, are left out.
    """
    own = F.col(weight).cast("double") if weight else F.lit(1.0)
    some = rows.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), own.alias("_o")).where("_x is not null and _y is not null and not isnan(_x) and not isnan(_y) and _o > 0")
    some = kept(some)
    power = lambda n: F.pow("_x", F.lit(n)) if n else F.lit(1.0)
    kinds = dict(some.dtypes)
    ddl = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *(f"c{i} double" for i in range(degree + 1))])
    weighted = some.withColumn("_w", F.col("_o"))
    for r in range(rounds + 1):
        m = weighted.groupBy(*keys).agg(*(F.sum(F.col("_w") * power(i)).alias(f"_m{i}") for i in range(2 * degree + 1)), *(F.sum(F.col("_w") * power(i) * F.col("_y")).alias(f"_y{i}") for i in range(degree + 1)), F.count("*").alias("_n")).where("_n > 0")
        found = m.mapInPandas(partial(_solved, keys, degree), ddl)
        if r and r % 4 == 0:
            found = kept(found)  # a row a key; without it each round would run all before it again
        both = some.join(found, keys) if keys else some.join(F.broadcast(found), how="cross")  # one row
        off = F.abs(F.col("_y") - sum(F.col(f"c{i}") * power(i) for i in range(degree + 1)))
        weighted = both.withColumn("_d", off).withColumn("_w", F.col("_o") / F.greatest(F.col("_d"), F.lit(least)))
    coefficients = [F.first(f"c{i}").alias(f"c{i}") for i in range(degree + 1)]
    return weighted.groupBy(*keys).agg(*coefficients, F.count("*").alias("n"), F.sum(F.col("_o") * F.col("_d")).alias("deviation")).where("n > 0")


def fitted(rows: DataFrame, y: str, model: Callable[[list[Column]], Column], cost: Callable[[Column], Column], start: list[float], lower: list[float] | None = None, upper: list[float] | None = None, steps: int = 60, width: float = 1e-4) -> tuple[np.ndarray, float]:
    """Parameters near start that make the mean cost of model less y small, and that cost, over all rows with both.

    model takes a column for each parameter; cost is any column of the deviation.  A step is one job: the cost at the parameters and a little
    to either side of each, all in one aggregation, gives value and slopes; steps are quasi-Newton ones within bounds.
    """
    some = kept(rows.where(F.col(y).isNotNull()))
    scale = np.maximum(np.abs(np.asarray(start, float)), 1.0) * width

    def value(at: np.ndarray) -> tuple[float, np.ndarray]:
        places = [at, *(at + s * scale[i] * np.eye(len(at))[i] for i in range(len(at)) for s in (1, -1))]
        out = some.agg(*(F.avg(cost(model([F.lit(float(v)) for v in p]) - F.col(y))).alias(f"c{i}") for i, p in enumerate(places))).first()
        c = np.array([np.inf if v is None else float(v) for v in out])
        return float(c[0]), (c[1::2] - c[2::2]) / (2 * scale)

    return descent.minimised(value, np.array(start, float), lower, upper, steps, 1e-9)


def _costs(columns: list[str], f, batches):
    total, n = None, 0
    for b in batches:
        if b.num_rows:
            one = f(*(b.column(c).to_numpy(zero_copy_only=False) for c in columns))
            total, n = one if total is None else total + one, n + b.num_rows
    if n:
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary()), pa.array([n])], names=["sums", "n"])


def summed(rows: DataFrame, columns: list[str], f: Callable[..., np.ndarray]) -> tuple[np.ndarray | None, int]:
    """The sum of f over the table, a vector of numpy arrays' sums, and the number of rows; one row a task reaches the driver."""
    out = rows.select(*columns).mapInArrow(partial(_costs, columns, f), "sums binary, n long").collect()
    return (np.sum([np.frombuffer(r.sums, float) for r in out], axis=0), sum(r.n for r in out)) if out else (None, 0)


def projected(signal: np.ndarray, u: np.ndarray) -> np.ndarray:
    """A periodic signal of evenly spaced samples at u, in periods, between its samples linearly."""
    at = np.mod(u, 1.0) * len(signal)
    i = np.minimum(at.astype(np.int64), len(signal) - 1)
    return signal[i] + (at - i) * (signal[(i + 1) % len(signal)] - signal[i])


def _delayed(signal, candidates, x, t, y, amplitude, weight):
    return np.array([(weight * np.abs(y - amplitude * projected(signal, t - np.polyval(p, x)))).sum() for p in candidates])


def delay_polynomial(rows: DataFrame, x: str, t: str, y: str, signal: np.ndarray, period: float, degree: int = 1, start: float = 0.0, amplitude: str | None = None, weight: str | None = None, grid: int = 20) -> tuple[np.ndarray, float]:
    """The polynomial delay(x), coefficients from the highest power, under which amplitude * signal(t - delay) is nearest y, and the mean cost.

    The cost is weight * |deviation|, the signal is periodic from `start`, and delays are within a period.  A line is looked for over a grid
    of `grid` by `grid` in one job, then improved; powers are added one at a time, each first looked for alone.
    """
    span = rows.agg(F.min(x), F.max(x)).first()
    if span[0] is None:
        raise ValueError("no rows to fit")
    middle, width = (span[0] + span[1]) / 2, max(span[1] - span[0], 1e-300)
    one = F.lit(1.0)
    some = rows.select(((F.col(x) - middle) / width).alias("x"), ((F.col(t) - start) / period).alias("t"), F.col(y).cast("double").alias("y"), (F.col(amplitude).cast("double") if amplitude else one).alias("a"), (F.col(weight).cast("double") if weight else one).alias("w"))
    some = kept(some.dropna())

    def costs(candidates) -> np.ndarray:
        total, n = summed(some, ["x", "t", "y", "a", "w"], partial(_delayed, signal, np.atleast_2d(candidates)))
        if not n:
            raise ValueError("no rows to fit")
        return total / n

    def better(p: np.ndarray) -> tuple[np.ndarray, float]:
        h = 0.02 / len(signal)

        def value(p):
            e = h * np.eye(len(p))
            c = costs([p, *(p + e), *(p - e)])
            return float(c[0]), (c[1 : 1 + len(p)] - c[1 + len(p) :]) / (2 * h)

        return descent.minimised(value, p, -np.ones(len(p)), np.ones(len(p)), 40, 1e-9)

    steps = np.linspace(-1, 1, grid)
    both = np.stack(np.meshgrid(steps, steps, indexing="ij"), -1).reshape(-1, 2)
    p, cost = better(both[costs(both).argmin()])
    for _ in range(2, degree + 1):
        q = np.linspace(-1, 1, 2 * grid + 1)
        tried = np.column_stack([q, np.tile(p, (len(q), 1))])
        p, cost = better(tried[costs(tried).argmin()])
    out = np.zeros(1)  # from the normed x and period to their units
    for k in p:
        out = np.polyadd(np.polymul(out, [1 / width, -middle / width]), [k])
    return np.atleast_1d(period * out)[-len(p) :], cost
