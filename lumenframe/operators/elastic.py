"""Elastic alignment in time: a monotone map from the samples of one series to the times of another, from coarse to fine.

The map t(i) and a magnitude m make
    1/2 sum |known(t(i)) - m unknown(i)|^2 + spring/2 sum (t(i+1) - t(i))^2 + sum exp(-K (t(i+1) - t(i) - least))
small, with t pinned at `ends` one sample before and after the series.  A pyramid of halved series is aggregated by Spark; the coarsest, of COARSE
samples at most, is fitted whole, from the best path over a grid of times, and each finer one starts from the map of the one before.  There a series is cut into pieces with halos, pinned
where the coarser map has their ends, so that pieces of all series are fitted side by side, each with a magnitude of its own, and overlaps
are blended.  The magnitude that is returned is the best one of the whole map.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import kept

COARSE, PIECE, HALO = 128, 2048, 128
_REACH = 3  # samples that the low-pass before halving looks at either side


# ---------------------------------------------------------------- one piece


def solve_tridiagonal(diagonal: np.ndarray, off: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """x of a symmetric tridiagonal system, off[i] between i and i + 1, by cyclic reduction of all rows at once."""
    n = len(diagonal)
    a, b, c, d = np.append(0.0, off), diagonal.astype(float).copy(), np.append(off, 0.0), rhs.astype(float).copy()
    step = 1
    while step < n:
        up, down = np.zeros(n), np.zeros(n)
        up[step:] = -a[step:] / b[:-step]
        down[:-step] = -c[:-step] / b[step:]
        a2, b2, c2, d2 = np.zeros(n), b.copy(), np.zeros(n), d.copy()
        a2[step:], c2[:-step] = up[step:] * a[:-step], down[:-step] * c[step:]
        b2[step:] += up[step:] * c[:-step]
        b2[:-step] += down[:-step] * a[step:]
        d2[step:] += up[step:] * d[:-step]
        d2[:-step] += down[:-step] * d[step:]
        a, b, c, d = a2, b2, c2, d2
        step *= 2
    return d / b


def _at(tx: np.ndarray, v: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linear interpolation of each column at t, held at the ends, and its slope there."""
    i = np.clip(np.searchsorted(tx, t, side="right") - 1, 0, len(tx) - 2)
    slope = (v[i + 1] - v[i]) / (tx[i + 1] - tx[i])[:, None]
    s = np.clip(t, tx[0], tx[-1])
    out = v[i] + slope * (s - tx[i])[:, None]
    slope[(t < tx[0]) | (t > tx[-1])] = 0
    return out, slope


def energy(t: np.ndarray, m: float, tx: np.ndarray, known: np.ndarray, unknown: np.ndarray, ends: tuple[float, float], least: float, spring: float, barrier: float) -> float:
    """What a map costs; samples of unknown that are nan cost nothing."""
    gap = np.diff(np.concatenate([[ends[0]], t, [ends[1]]]))
    miss = np.nan_to_num(_at(tx, known, t)[0] - m * unknown)
    return float(0.5 * (miss**2).sum() + 0.5 * spring * (gap**2).sum() + np.exp(np.minimum(-barrier * (gap - least), 300.0)).sum())


def magnitude(t: np.ndarray, tx: np.ndarray, known: np.ndarray, unknown: np.ndarray) -> tuple[float, float]:
    """Numerator and denominator of the best m for a map."""
    f, u = _at(tx, known, t)[0], np.nan_to_num(unknown)
    return float((np.where(np.isnan(unknown), 0, f) * u).sum()), float((u * u).sum())


def fit(t: np.ndarray, m: float | None, tx: np.ndarray, known: np.ndarray, unknown: np.ndarray, ends: tuple[float, float], least: float, spring: float, barrier: float, steps: int = 200) -> tuple[np.ndarray, float]:
    """The map near t of least energy, by damped Gauss-Newton steps; m is fitted with it if it is None."""
    free, t, damp = m is None, t.copy(), 1e-3

    def best(t):
        a, b = magnitude(t, tx, known, unknown)
        return a / b if b > 0 else 1.0

    m = best(t) if free else m
    now = energy(t, m, tx, known, unknown, ends, least, spring, barrier)
    for _ in range(steps):
        f, slope = _at(tx, known, t)
        miss = np.nan_to_num(f - m * unknown)
        slope = np.where(np.isnan(unknown), 0, slope)
        gap = np.diff(np.concatenate([[ends[0]], t, [ends[1]]]))
        e = np.exp(np.minimum(-barrier * (gap - least), 300.0))
        pull = spring * gap - barrier * e
        stiff = spring + barrier * barrier * e
        g = (miss * slope).sum(1) + pull[:-1] - pull[1:]
        h = (slope * slope).sum(1) + stiff[:-1] + stiff[1:]
        new = t - solve_tridiagonal(h * (1 + damp), -stiff[1:-1], g)
        m_new = best(new) if free else m
        cost = energy(new, m_new, tx, known, unknown, ends, least, spring, barrier)
        if (np.diff(np.concatenate([[ends[0]], new, [ends[1]]])) > 0).all() and cost < now:
            done = now - cost < 1e-10 * (1 + abs(now))
            t, m, now, damp = new, m_new, cost, max(damp / 4, 1e-9)
            if done:
                break
        else:
            damp = damp * 5
            if damp > 1e9:
                break
    return t, m


def first_map(tx: np.ndarray, known: np.ndarray, unknown: np.ndarray, ends: tuple[float, float], least: float, spring: float, barrier: float, per: int = 4, most: int = 4) -> np.ndarray:
    """The cheapest map onto a grid of `per` times a sample whose gaps are `most` mean gaps at the most, by dynamic programming.

    Its magnitude is that of the two series' sizes, whatever the map.
    """
    n = len(unknown)
    total = (n + 1) * per
    step = (ends[1] - ends[0]) / total
    f = _at(tx, known, ends[0] + step * np.arange(total + 1))[0]
    m = float(np.sqrt(np.mean(f**2) / max(np.nanmean(unknown**2), 1e-300))) if np.isfinite(unknown).any() else 1.0
    gap = step * np.arange(1, per * most + 1)
    price = 0.5 * spring * gap**2 + np.exp(np.minimum(-barrier * (gap - least), 300.0))
    cost, back = np.full(total + 1, np.inf), np.zeros((n + 1, total + 1), np.int16)
    cost[0] = 0
    for i in range(n + 1):
        options = np.full((len(gap), total + 1), np.inf)
        for k in range(1, len(gap) + 1):
            options[k - 1, k:] = cost[:-k] + price[k - 1]
        back[i] = options.argmin(0) + 1
        cost = options.min(0)
        if i < n:
            cost = cost + 0.5 * np.nansum((f - m * unknown[i]) ** 2, 1)
    path, g = [], total
    for i in range(n, 0, -1):
        g -= int(back[i, g])
        path.append(g)
    return ends[0] + step * np.array(path[::-1], float)


# ---------------------------------------------------------------- the pyramid


def halved(rows: DataFrame, keys: list[str], i: str, values: list[str], t: str | None = None) -> DataFrame:
    """Every second sample, the first at 1, of the low-passed series (Gaussian of one sample, within the series), numbered anew; t is not low-passed.

    Each sample adds to the few halved ones it reaches, so it is one aggregation and no window, however long the series.
    """
    near = F.explode(F.sequence(F.ceil((F.col(i) - 1 - _REACH) / 2), F.floor((F.col(i) - 1 + _REACH) / 2)))
    spread = rows.select(*keys, F.col(i).alias("_i"), *values, *([t] if t else []), near.alias("_j"))
    off = F.col("_i") - 2 * F.col("_j") - 1
    w = F.exp(-0.5 * off * off)
    mean = lambda v: F.sum(F.col(v) * w) / F.sum(F.when(F.col(v).isNotNull(), w))
    middle = F.count(F.when(off == 0, 1)).alias("_here")
    own = [F.max(F.when(off == 0, F.col(t))).alias(t)] if t else []
    out = spread.groupBy(*keys, "_j").agg(*(mean(v).alias(v) for v in values), *own, middle)
    return out.where("_here > 0").select(*keys, F.col("_j").cast("long").alias(i), *([t] if t else []), *values)


def aligned(known: DataFrame, unknown: DataFrame, keys: list[str], i: str, t: str, values: list[str], ends: DataFrame, least: float, spring: float, barrier: float = 1000.0, bound: int = 200_000) -> DataFrame:
    """unknown with `t`, the time in `known` of each sample, and `magnitude`, that of its series.

    known: keys, i, t and values, sorted by t as by i; unknown: keys, i (0, 1, ...) and values, null where missing; ends: keys, t0 and t1,
    the times one sample before and after each unknown series.  Series without a known one of two samples or more, or
    without ends, are left out.  A piece holds PIECE + 2 HALO samples and the known ones of its time, `bound` at most, else an error.
    """
    spark = unknown.sparkSession
    ends = ends.select(*keys, F.col("t0").cast("double").alias("t0"), F.col("t1").cast("double").alias("t1"))
    pyramid = [(kept(known.where(F.col(t).isNotNull()).select(*keys, i, F.col(t).cast("double").alias(t), *(F.col(v).cast("double").alias(v) for v in values))), kept(unknown.select(*keys, i, *(F.col(v).cast("double").alias(v) for v in values))))]
    sizes = pyramid[0][1].groupBy(*keys).agg((F.max(i) + 1).alias("_n"))
    longest = sizes.agg(F.max("_n")).first()[0] or 0
    while longest > COARSE:
        longest //= 2
        k, u = pyramid[-1]
        pyramid.append((kept(halved(k, keys, i, values, t)), kept(halved(u, keys, i, values))))
    found = None
    for level in range(len(pyramid) - 1, -1, -1):
        # a series takes part in the levels that it has to be halved for, and in the finest
        mine = ends.join(sizes.where(F.shiftright("_n", level - 1) > COARSE).select(*keys), keys) if level else ends
        found = kept(_level(pyramid[level], found, keys, i, t, values, mine, least * 2**level, spring, barrier, bound))
    return unknown.join(found.select(*keys, i, F.col("_t").alias(t), F.col("_m").alias("magnitude")), [*keys, i]) if found is not None else spark.createDataFrame([], unknown.schema)


def _level(pair, above: DataFrame | None, keys, i, t, values, ends, least, spring, barrier, bound) -> DataFrame:
    """keys, i, _t and _m of one level; `above` has those of the level of half its samples, for series long enough."""
    known, unknown = pair
    sizes = unknown.groupBy(*keys).agg((F.max(i) + 1).alias("_n"))
    info = sizes.join(ends, keys).join(known.groupBy(*keys).agg(F.min(t).alias("_from"), F.max(t).alias("_to"), F.count("*").alias("_k")), keys).where("_k > 1 and t1 > t0")
    rows = unknown.join(info.select(*keys, "_n"), keys)
    # pieces of a sample: its own and, in a halo, the one beside it
    place = F.col(i)
    last = F.floor((F.col("_n") - 1) / PIECE)
    of = lambda low, high: F.explode(F.sequence(F.greatest(F.lit(0), F.floor(low / PIECE)), F.least(last, F.floor(high / PIECE))))
    parts = [rows.select(*keys, of(place - HALO, place + HALO).alias("_p"), F.lit("u").alias("_kind"), place.cast("double").alias("_x"), *values)]
    width = (F.col("_to") - F.col("_from")) / F.col("_k") * PIECE
    if above is None:
        spans = info.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_p"), F.col("t0").alias("_low"), F.col("t1").alias("_high"), "_from", "_to", "_k")
    else:
        # sample j of the level above is sample 2 j + 1 here; the ends are samples -1 and n
        knots = above.join(info.select(*keys, "_n", "t0", "t1", "_from", "_to", "_k"), keys)
        at = 2 * F.col(i) + 1
        inner = knots.select(*keys, of(at - HALO - 3, at + HALO + 3).alias("_p"), at.cast("double").alias("_x"), F.col("_t").alias("_y"))
        held = info.join(above.select(*keys).distinct(), keys, "left_semi")
        outer = held.select(*keys, F.lit(0).cast("long").alias("_p"), F.lit(-1.0).alias("_x"), F.col("t0").alias("_y")).unionByName(held.select(*keys, last.alias("_p"), F.col("_n").cast("double").alias("_x"), F.col("t1").alias("_y")))
        knots = inner.unionByName(outer)
        parts.append(knots.withColumn("_kind", F.lit("c")))
        spans = knots.groupBy(*keys, "_p").agg(F.min("_y").alias("_low"), F.max("_y").alias("_high")).join(info.select(*keys, "_from", "_to", "_k"), keys)
        new = info.join(above.select(*keys).distinct(), keys, "left_anti")  # series that are short enough to begin here
        spans = spans.unionByName(new.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_p"), F.col("t0").alias("_low"), F.col("t1").alias("_high"), "_from", "_to", "_k"))
    # known samples reach the pieces of their time by bins of time
    bin_of = lambda x: F.floor((x - F.col("_from")) / width)
    margin = 4 * (F.col("_to") - F.col("_from")) / F.col("_k")
    spans = spans.withColumn("_low", F.col("_low") - margin).withColumn("_high", F.col("_high") + margin)
    clip = lambda x: F.least(F.greatest(x, F.col("_from")), F.col("_to"))
    wanted = spans.select(*keys, "_p", "_low", "_high", F.explode(F.sequence(bin_of(clip(F.col("_low"))), bin_of(clip(F.col("_high"))))).alias("_b"))
    series = known.join(info.select(*keys, "_from", "_to", "_k"), keys).withColumn("_b", bin_of(F.col(t)))
    near = series.join(wanted, [*keys, "_b"]).where(F.col(t).between(F.col("_low"), F.col("_high")))
    parts.append(near.select(*keys, "_p", F.lit("k").alias("_kind"), F.col(t).alias("_x"), *values))
    parts.append(info.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_p"), F.lit("e").alias("_kind"), F.col("_n").cast("double").alias("_x"), F.col("t0").alias("_y"), F.col("t1").alias("_z")))
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    kinds = dict(unknown.dtypes)

    def one(d: pd.DataFrame) -> pd.DataFrame:
        if len(d) > bound:
            raise ValueError(f"{len(d)} samples of a piece; {bound} at most")
        u, k, c, e = (d[d["_kind"] == x].sort_values("_x", kind="stable") for x in "ukce")
        n, (t0, t1), p = int(e["_x"].iloc[0]), (float(e["_y"].iloc[0]), float(e["_z"].iloc[0])), int(d["_p"].iloc[0])
        x, tx = u["_x"].to_numpy(), k["_x"].to_numpy()
        known, unknown = k[values].to_numpy(float), u[values].to_numpy(float)
        keep = np.append(True, np.diff(tx) > 0) & ~np.isnan(known).any(1) if len(tx) else np.zeros(0, bool)
        tx, known = tx[keep], known[keep]
        if len(c):
            knot, when = np.unique(c["_x"].to_numpy(), return_index=True)
            y = c["_y"].to_numpy()[when]
            start = np.interp(x, knot, y)
            pins = tuple(np.interp([x[0] - 1, x[-1] + 1], knot, y))
        else:
            start, pins = t0 + (t1 - t0) * (x + 1) / (n + 1), (t0, t1)  # the series begins here, whole
            if len(tx) > 1:
                start = first_map(tx, known, unknown, pins, least, spring, barrier)
        if len(tx) > 1:
            start, _ = fit(start, None, tx, known, unknown, pins, least, spring, barrier)
            top, bottom = magnitude(start, tx, known, unknown)
        else:
            top, bottom = 0.0, 0.0
        first, past = p * PIECE, min(n, (p + 1) * PIECE)
        core = (x >= first) & (x < past)
        w = np.ones(len(x))
        if first > 0:
            w = np.minimum(w, (x - (first - HALO) + 0.5) / (2 * HALO))
        if past < n:
            w = np.minimum(w, (past + HALO - x - 0.5) / (2 * HALO))
        return pd.DataFrame({**{q: [d[q].iloc[0]] * len(x) for q in keys}, i: x.astype(np.int64), "_t": start, "_w": np.clip(w, 0, 1), "_a": np.where(core, top, 0) / max(1, core.sum()), "_c": np.where(core, bottom, 0) / max(1, core.sum())})

    ddl = ", ".join([*(f"`{q}` {kinds[q]}" for q in keys), f"`{i}` long, _t double, _w double, _a double, _c double"])
    each = both.groupBy(*keys, "_p").applyInPandas(one, ddl)
    each = kept(each)
    m = each.groupBy(*keys).agg(F.sum("_a").alias("_a"), F.sum("_c").alias("_c")).select(*keys, F.when(F.col("_c") > 0, F.col("_a") / F.col("_c")).otherwise(1.0).alias("_m"))
    blended = each.groupBy(*keys, i).agg((F.sum(F.col("_w") * F.col("_t")) / F.sum("_w")).alias("_t"))
    return blended.join(m, keys)
