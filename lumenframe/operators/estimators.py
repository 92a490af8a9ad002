"""Estimators that no SQL states: one Arrow group each, numpy inside, after aggregation to bins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def viterbi(cost: np.ndarray, most: int = 2) -> np.ndarray:
    """The cheapest path through cost[time, state] whose state never falls and rises by `most` at the most a step."""
    best, back = cost[0].astype(float).copy(), np.zeros(cost.shape, int)
    for t in range(1, len(cost)):
        options = np.stack([np.concatenate([np.full(k, np.inf), best[: len(best) - k]]) for k in range(most + 1)])
        back[t] = options.argmin(0)
        best = options.min(0) + cost[t]
    path = [int(best.argmin())]
    for t in range(len(cost) - 1, 0, -1):
        path.append(path[-1] - back[t][path[-1]])
    return np.array(path[::-1])


def kalman(t: np.ndarray, z: np.ndarray, q: float, r: float, gate: float = np.inf) -> np.ndarray:
    """Position by a constant-velocity filter; observations over `gate` standard deviations off are ignored."""
    x, p, out = np.array([z[0], 0.0]), np.diag([r, r]), []
    for i in range(len(z)):
        d = t[i] - t[i - 1] if i else 0.0
        f = np.array([[1, d], [0, 1]])
        x, p = f @ x, f @ p @ f.T + q * np.array([[d**3 / 3, d**2 / 2], [d**2 / 2, d]])
        s, e = p[0, 0] + r, z[i] - x[0]
        if e * e <= gate * gate * s:
            k = p[:, 0] / s
            x, p = x + k * e, p - np.outer(k, p[0])
        out.append(x[0])
    return np.array(out)


def kalman_track(df: DataFrame, keys: list[str], t: str, value: str, q: float = 1.0, r: float = 1.0, gate: float = 5.0) -> DataFrame:
    """df with `<value>_hat`, by key in order of t; rows with null values are left out."""
    df = df.where(F.col(t).isNotNull() & F.col(value).isNotNull())

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values([t, value], kind="stable")
        return p.assign(**{f"{value}_hat": kalman(p[t].to_numpy(float), p[value].to_numpy(float), q, r, gate)})

    return df.groupBy(*keys).applyInPandas(run, f"{_ddl(df)}, {value}_hat double")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def gram(df: DataFrame, vector: str, n: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, covariance and count of an array column of length n: each task sends n * n + n + 1 sums, which are added by place."""
    size = n * n + n + 1

    def sums(batches):
        import pyarrow as pa

        s, m, k = np.zeros((n, n)), np.zeros(n), 0
        for b in batches:
            x = np.array([v for v in b.column(0).to_pylist() if v is not None], float).reshape(-1, n)
            s, m, k = s + x.T @ x, m + x.sum(0), k + len(x)
        yield pa.record_batch([pa.array(np.arange(size)), pa.array(np.concatenate([s.ravel(), m, [float(k)]]))], names=["i", "v"])

    total = np.zeros(size)
    for r in df.select(vector).mapInArrow(sums, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():  # size rows
        total[r["i"]] = r["v"]
    k = max(int(total[-1]), 1)
    mean = total[n * n : -1] / k
    return mean, total[: n * n].reshape(n, n) / k - np.outer(mean, mean), k


def pca2(df: DataFrame, vector: str, n: int) -> DataFrame:
    """df with `pc1` and `pc2`: projections on the two largest eigenvectors (signs set by their largest element)."""
    mean, cov, _ = gram(df, vector, n)
    _, v = np.linalg.eigh(cov)
    v = v[:, ::-1][:, :2]
    v = v * np.sign(v[np.abs(v).argmax(0), [0, 1]])
    dot = lambda w: F.aggregate(F.zip_with(F.col(vector), F.array(*(F.lit(float(x)) for x in w)), lambda a, b: a.cast("double") * b), F.lit(-float(mean @ w)), lambda a, x: a + x)
    return df.withColumn("pc1", dot(v[:, 0])).withColumn("pc2", dot(v[:, 1]))


def asymmetric_mean(x: np.ndarray, rounds: int = 10) -> tuple[float, float]:
    """Mean and deviation of the finite values after `rounds` - 1 times drawing those above mean plus deviation down to it."""
    x = x[np.isfinite(x)].astype(float)
    for i in range(rounds):
        u, s = (float(x.mean()), float(x.std(ddof=1)) if len(x) > 1 else 0.0) if len(x) else (float("nan"), float("nan"))
        if i + 1 < rounds:
            x = np.minimum(x, u + s)
    return u, s


def plane_wave(x: np.ndarray, y: np.ndarray, z: np.ndarray, span: float = 1.0, steps: int = 41) -> tuple[float, float, float]:
    """kx, ky and phase of the wave abs(z) exp(i (kx x + ky y + phase)) nearest z: a grid, refined three times."""
    w, best, size = np.abs(z), (0.0, 0.0), span
    for _ in range(4):
        k = np.linspace(-size, size, steps)
        kx, ky = best[0] + k[:, None], best[1] + k[None]
        fit = np.abs((np.conj(z) * w * np.exp(1j * (kx[..., None] * x + ky[..., None] * y))).sum(-1))
        i, j = np.unravel_index(fit.argmax(), fit.shape)
        best, size = (float(kx[i, 0]), float(ky[0, j])), size * 2 / (steps - 1)
    return *best, float(np.angle((z * w * np.exp(-1j * (best[0] * x + best[1] * y))).sum()))


def by_key(df: DataFrame, keys: list[str], order: list[str], f, schema: str, bound: int) -> DataFrame:
    """f(series as a pandas frame in order) of each key, a frame of `schema`.

    A whole key goes to one task, so `bound` states how many rows one may have; a longer one ends the job with an error and has to
    be cut, for instance by `temporal.spanned`, before.
    """

    def run(p: pd.DataFrame) -> pd.DataFrame:
        if len(p) > bound:
            raise ValueError(f"a series of {len(p)} rows; {bound} is the bound")
        return f(p.sort_values(order, kind="stable"))

    return df.groupBy(*keys).applyInPandas(run, schema)


def align_monotone(costs: DataFrame, keys: list[str], time: str, state: str, cost: str, most: int = 2, bound: int = 1_000_000) -> DataFrame:
    """Of (keys, time, state, cost), a dense grid of either, the cheapest path: keys, time, state."""
    kinds = dict(costs.dtypes)

    def run(p):
        grid = p.pivot(index=time, columns=state, values=cost).sort_index()
        path = viterbi(grid.to_numpy(float), most)
        return pd.DataFrame({**{k: p[k].iloc[0] for k in keys}, time: grid.index, state: grid.columns.to_numpy()[path]})

    return by_key(costs, keys, [time, state], run, ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, time, state]), bound)


def plane_waves(maps: DataFrame, keys: list[str], x: str, y: str, re: str, im: str, span: float = 1.0, bound: int = 1_000_000) -> DataFrame:
    """Of each map of complex values the plane wave that fits it best: keys, kx, ky, phase."""
    kinds = dict(maps.dtypes)

    def run(p):
        kx, ky, phi = plane_wave(p[x].to_numpy(float), p[y].to_numpy(float), p[re].to_numpy(float) + 1j * p[im].to_numpy(float), span)
        return pd.DataFrame({**{k: [p[k].iloc[0]] for k in keys}, "kx": [kx], "ky": [ky], "phase": [phi]})

    return by_key(maps, keys, [x, y], run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "kx double, ky double, phase double"]), bound)


def two_rate_map(nr: np.ndarray, ng: np.ndarray, dt: np.ndarray, drift_red: float = 0.5, drift_ratio: float = 0.5, steps: int = 50) -> tuple[np.ndarray, ...]:
    """Log red rate and log ratio of green to red that are most probable together, and their standard deviations.

    Counts are Poisson, red with rate exp(u) and green with exp(u + v); u and v drift like Brownian motion with these variances a
    second.  Newton's method on the 2n unknowns; the Hessian is block tridiagonal, and each step solves it by elimination.
    """
    n, dt = len(nr), np.maximum(np.asarray(dt, float), 1e-9)
    u = np.full(n, np.log((nr.sum() + 0.5) / dt.sum()))
    v = np.full(n, np.log((ng.sum() + 0.5) / (nr.sum() + 0.5)))
    gap = (dt[1:] + dt[:-1]) / 2
    tie = np.stack([1 / (drift_red * gap), 1 / (drift_ratio * gap)], 1) if n > 1 else np.zeros((0, 2))

    def value(u, v):
        r, g = np.exp(u) * dt, np.exp(u + v) * dt
        return (nr * u - r + ng * (u + v) - g).sum() - 0.5 * (tie[:, 0] * np.diff(u) ** 2).sum() - 0.5 * (tie[:, 1] * np.diff(v) ** 2).sum()

    def blocks(u, v):
        r, g = np.exp(u) * dt, np.exp(u + v) * dt
        grad = np.stack([nr - r + ng - g, ng - g], 1)
        d = np.stack([tie[:, 0] * np.diff(u), tie[:, 1] * np.diff(v)], 1)
        grad[:-1] += d
        grad[1:] -= d
        h = np.zeros((n, 2, 2))
        h[:, 0, 0], h[:, 0, 1], h[:, 1, 0], h[:, 1, 1] = r + g, g, g, g + 1e-9
        for k in (0, 1):
            h[:-1, k, k] += tie[:, k]
            h[1:, k, k] += tie[:, k]
        return grad, h

    now = value(u, v)
    for _ in range(steps):
        grad, h = blocks(u, v)
        step = _block_solve(h, tie, grad)
        scale = 1.0
        while scale > 1e-6 and value(u + scale * step[:, 0], v + scale * step[:, 1]) < now:
            scale /= 2
        u, v = u + scale * step[:, 0], v + scale * step[:, 1]
        new = value(u, v)
        if new - now < 1e-10 * max(1.0, abs(now)):
            break
        now = new
    _, h = blocks(u, v)
    var = _block_variances(h, tie)
    return u, v, np.sqrt(var[:, 0]), np.sqrt(var[:, 1])


def _forward(h: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Pivots of the elimination from the front; off-diagonal blocks are -diag(tie)."""
    s = h.copy()
    for i in range(1, len(h)):
        t = tie[i - 1]
        s[i] -= t[:, None] * np.linalg.inv(s[i - 1]) * t[None]
    return s


def _block_solve(h: np.ndarray, tie: np.ndarray, b: np.ndarray) -> np.ndarray:
    s, y = _forward(h, tie), b.copy()
    for i in range(1, len(h)):
        y[i] += tie[i - 1] * np.linalg.solve(s[i - 1], y[i - 1])
    x = np.empty_like(b)
    x[-1] = np.linalg.solve(s[-1], y[-1])
    for i in range(len(h) - 2, -1, -1):
        x[i] = np.linalg.solve(s[i], y[i] + tie[i] * x[i + 1])
    return x


def _block_variances(h: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Diagonal of the inverse: pivots from the front and from the back meet in each block."""
    front, back = _forward(h, tie), _forward(h[::-1], tie[::-1])[::-1]
    return np.stack([np.diag(np.linalg.inv(front[i] + back[i] - h[i])) for i in range(len(h))])


def two_rates_by_key(bins: DataFrame, keys: list[str], t: str, dt: str, red: str, green: str, bound: int = 1_000_000, **how) -> DataFrame:
    """Of each key's bins of counts: keys, t, rate, ratio and the deviations of their logarithms."""
    kinds = dict(bins.dtypes)

    def run(p):
        u, v, su, sv = two_rate_map(p[red].to_numpy(float), p[green].to_numpy(float), p[dt].to_numpy(float), **how)
        return pd.DataFrame({**{k: p[k] for k in keys}, t: p[t], "rate": np.exp(u), "ratio": np.exp(v), "rate_sd": su, "ratio_sd": sv})

    return by_key(bins, keys, [t], run, ", ".join([*(f"`{c}` {kinds[c]}" for c in [*keys, t]), "rate double, ratio double, rate_sd double, ratio_sd double"]), bound)


def bleach_baseline(t: np.ndarray, y: np.ndarray, rounds: int = 30) -> np.ndarray:
    """An exponential a exp(-t / tau) + c through a trace, points far above it left out: least squares on truncated residuals."""
    ok = np.isfinite(y)
    span, best, keep = max(float(np.ptp(t)), 1e-9), None, ok.copy()
    for _ in range(rounds):
        found = None
        for tau in span * np.geomspace(0.05, 20, 60):
            x = np.stack([np.exp(-(t[keep] - t[0]) / tau), np.ones(keep.sum())], 1)
            coef, *_ = np.linalg.lstsq(x, y[keep], rcond=None)
            e = float(((y[keep] - x @ coef) ** 2).sum())
            if found is None or e < found[0]:
                found = e, tau, coef
        _, tau, coef = found
        fit = coef[0] * np.exp(-(t - t[0]) / tau) + coef[1]
        r = y - fit
        scale = 1.4826 * np.nanmedian(np.abs(r[keep])) + 1e-12
        new = ok & (r < 2.5 * scale)
        if best is not None and (new == keep).all():
            break
        best, keep = fit, new if new.sum() >= 3 else keep
    return fit


def bleach_corrected(rows: DataFrame, keys: list[str], t: str, value: str, bound: int = 1_000_000) -> DataFrame:
    """rows with `baseline` and `corrected`, the value over it, by key; rows with null values are left out."""

    def run(p):
        base = bleach_baseline(p[t].to_numpy(float), p[value].to_numpy(float))
        return p.assign(baseline=base, corrected=p[value].to_numpy(float) / np.where(base == 0, np.nan, base))

    rows = rows.where(F.col(t).isNotNull() & F.col(value).isNotNull())
    return by_key(rows, keys, [t], run, f"{_ddl(rows)}, baseline double, corrected double", bound)
