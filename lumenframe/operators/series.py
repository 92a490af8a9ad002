"""Filters, fills, motion and spectra of sampled series, and regions of images: windows and aggregates by key.

A series is (keys, order, value), one sample a row.  Filters add a few rows beyond its ends, as the pad says, and one window does the
rest.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import estimators, parts, stats, temporal, volumes

PADS = ("ends", "zeros", "linear", "circular", "mirror")


def numbered(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df with `_i` from 0 and `_m`, the number of rows of its key."""
    w = Window.partitionBy(*keys)
    return df.withColumn("_i", (F.row_number().over(w.orderBy(*order)) - 1).cast("long")).withColumn("_m", F.count("*").over(w))


def filtered(df: DataFrame, keys: list[str], order: list[str], value: str, kernel: list[tuple[int, float]], out: str, pad: str = "ends") -> DataFrame:
    """df with the series' convolution, sum of w(x) v(i - x), the series continued as the pad says:

    ends: by its first and last value; zeros; linear: by its reflection through the end samples; circular: by itself; mirror: by
    its reflection, end samples twice.  Where a series is shorter than a reflection needs, its ends are repeated.
    """
    if pad not in PADS:
        raise ValueError(f"pad is one of {PADS}")
    m = max(abs(x) for x, _ in kernel)
    rows = numbered(df, keys, order)
    v, i, n = F.col(value), F.col("_i"), F.col("_m")
    edge = rows.where((i <= m) | (i >= n - 1 - m)).select(*keys, "_i", "_m", v.cast("double").alias("_v"))
    ends = rows.groupBy(*keys).agg(F.min_by(value, "_i").cast("double").alias("_a"), F.max_by(value, "_i").cast("double").alias("_b"), F.max("_m").alias("_n"))
    fill = lambda first, last: ends.select(*keys, F.explode(F.array(*(F.struct((F.lit(-j) if side else F.col("_n") - 1 + j).cast("long").alias("_i"), (first if side else last).alias("_v")) for j in range(1, m + 1) for side in (True, False)))).alias("_x")).select(*keys, "_x.*")
    if m == 0:
        more = None
    elif pad in ("ends", "zeros"):
        more = fill(F.col("_a"), F.col("_b")) if pad == "ends" else fill(F.lit(0.0), F.lit(0.0))
    else:
        mine = edge.join(ends.select(*keys, "_a", "_b"), keys) if keys else edge.crossJoin(F.broadcast(ends.select("_a", "_b")))
        if pad == "circular":
            front, back = mine.where(i >= n - m).select(*keys, (i - n).alias("_i"), "_v"), mine.where(i < m).select(*keys, (i + n).alias("_i"), "_v")
        elif pad == "mirror":
            front, back = mine.where(i < m).select(*keys, (-1 - i).alias("_i"), "_v"), mine.where(i >= n - m).select(*keys, (2 * n - 1 - i).alias("_i"), "_v")
        else:
            front = mine.where(i.between(1, m)).select(*keys, (-i).alias("_i"), (2 * F.col("_a") - F.col("_v")).alias("_v"))
            back = mine.where(i.between(n - 1 - m, n - 2)).select(*keys, (2 * (n - 1) - i).alias("_i"), (2 * F.col("_b") - F.col("_v")).alias("_v"))
        more = front.unionByName(back)
        short = fill(F.col("_a"), F.col("_b"))
        more = more.unionByName(short.join(more.select(*keys, "_i"), [*keys, "_i"], "left_anti"))
    mine = rows.select(*keys, "_i", v.cast("double").alias("_v"), F.struct(*df.columns).alias("_row"))
    both = mine if more is None else mine.unionByName(more, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_i")
    term = lambda x: F.lag("_v", x).over(w) if x else F.col("_v")
    total = sum((F.lit(k) * term(x) for x, k in kernel[1:]), F.lit(kernel[0][1]) * term(kernel[0][0]))
    return both.withColumn(out, total).where("_row is not null").select("_row.*", out)


def derivative_kernel(sigma: float) -> list[tuple[int, float]]:
    """Weights of the smoothed difference: half the differences of the Gaussian weights on either side."""
    g = [v for _, v in temporal.gauss_kernel(sigma)]
    at = [x for x, _ in temporal.gauss_kernel(sigma)]
    d = [b - a for a, b in zip(g, g[1:], strict=False)]
    return [(x, ((d[i] if i < len(d) else 0.0) + (d[i - 1] if i else 0.0)) / 2) for i, x in enumerate(at)]


def gauss_derivative(df: DataFrame, keys: list[str], order: list[str], value: str, sigma: float, out: str, pad: str = "linear") -> DataFrame:
    return filtered(df, keys, order, value, derivative_kernel(sigma), out, pad)


def rolling_least(df: DataFrame, keys: list[str], order: list[str], value: str, reach: int, out: str) -> DataFrame:
    return df.withColumn(out, F.min(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(-reach, reach)))


def filled(df: DataFrame, keys: list[str], t: str, value: str, how: str = "linear", most: int | None = None) -> DataFrame:
    """df with gaps in `value` filled from the known samples around: linear, nearest or previous; gaps of over `most` rows stay.

    Before the first and after the last known sample linear and nearest take that one.
    """
    w = Window.partitionBy(*keys).orderBy(t)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(t).alias("t"), F.col(value).alias("v"), F.row_number().over(w).alias("k")))
    d = df.withColumn("_x", known).withColumn("_k", F.row_number().over(w)).withColumn("_c", F.count("*").over(Window.partitionBy(*keys)))
    d = d.withColumn("_p", F.last("_x", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.first("_x", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    p, n = F.col("_p"), F.col("_n")
    share = (F.col(t) - p["t"]) / (n["t"] - p["t"])
    if how == "linear":
        new = F.when(p.isNotNull() & n.isNotNull(), p["v"] + (n["v"] - p["v"]) * share).otherwise(F.coalesce(p["v"], n["v"]))
    elif how == "nearest":
        new = F.when(p.isNull() | (n["t"] - F.col(t) <= F.col(t) - p["t"]), n["v"]).otherwise(p["v"])
    else:
        new = p["v"]
    gap = F.coalesce(n["k"], F.col("_c") + 1) - F.coalesce(p["k"], F.lit(0)) - 1
    new = new if most is None else F.when(gap <= most, new)
    return d.withColumn(value, F.coalesce(F.col(value), new)).drop("_x", "_k", "_c", "_p", "_n")


def motion(df: DataFrame, keys: list[str], t: str, axes: list[str]) -> DataFrame:
    """df with `v_<axis>`, `speed` and `acceleration` (of the speed), by central differences over the true times."""
    w = Window.partitionBy(*keys).orderBy(t)

    def slope(c):
        dt = F.coalesce(F.lead(t).over(w), F.col(t)) - F.coalesce(F.lag(t).over(w), F.col(t))
        return (F.coalesce(F.lead(c).over(w), F.col(c)) - F.coalesce(F.lag(c).over(w), F.col(c))) / F.when(dt > 0, dt)

    out = df.withColumns({f"v_{a}": slope(a) for a in axes})
    out = out.withColumn("speed", F.sqrt(sum((F.col(f"v_{a}") ** 2 for a in axes[1:]), F.col(f"v_{axes[0]}") ** 2)))
    return out.withColumn("acceleration", slope("speed"))


def along_heading(track: DataFrame, heading: DataFrame, keys: list[str], t: str, hx: str, hy: str) -> DataFrame:
    """track with `along`, its velocity (v_x, v_y) along the heading at its time, and `cosine`, of the angle between."""
    out = temporal.interp_join(track, heading.select(*keys, t, F.col(hx).alias("_hx")), keys, t, "_hx")
    out = temporal.interp_join(out, heading.select(*keys, t, F.col(hy).alias("_hy")), keys, t, "_hy")
    size = F.sqrt(F.col("_hx") ** 2 + F.col("_hy") ** 2)
    along = (F.col("v_x") * F.col("_hx") + F.col("v_y") * F.col("_hy")) / F.when(size > 0, size)
    speed = F.sqrt(F.col("v_x") ** 2 + F.col("v_y") ** 2)
    return out.withColumn("along", along).withColumn("cosine", F.col("along") / F.when(speed > 0, speed)).drop("_hx", "_hy")


def steady_angles(df: DataFrame, keys: list[str], t: str, angle: str, sigma: float, most: float = math.pi / 2) -> DataFrame:
    """df whose angles that are `most` or more off their low-pass (over the circle) are null."""
    c = filtered(df.withColumn("_c", F.cos(angle)), keys, [t], "_c", temporal.gauss_kernel(sigma), "_fc").drop("_c")
    s = filtered(c.withColumn("_s", F.sin(angle)), keys, [t], "_s", temporal.gauss_kernel(sigma), "_fs").drop("_s")
    off = F.atan2(F.sin(F.col(angle) - F.atan2("_fs", "_fc")), F.cos(F.col(angle) - F.atan2("_fs", "_fc")))
    return s.withColumn(angle, F.when(F.abs(off) < most, F.col(angle))).drop("_fc", "_fs")


def resampled(df: DataFrame, keys: list[str], t: str, value: str, step: float) -> DataFrame:
    """The series at start + k step of each key, up to its end, on straight lines between samples: keys, k, t, value."""
    g = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min(t).alias("_a"), F.max(t).alias("_b"))
    at = g.select(*keys, "_a", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_b") - F.col("_a")) / step + 1e-9))).alias("k")).select(*keys, "k", (F.col("_a") + F.col("k") * step).alias(t))
    return temporal.interp_join(at, df.where(F.col(value).isNotNull()).select(*keys, t, value), keys, t, value)


def upsampled_circular(df: DataFrame, keys: list[str], index: str, value: str, n: int, times: int) -> DataFrame:
    """times samples for each of a circle's n: keys, k from 0, value, on straight lines; the last one leads to the first."""
    nxt = df.select(*keys, F.pmod(F.col(index) - 1, F.lit(n)).alias(index), F.col(value).alias("_n"))
    both = df.select(*keys, index, value).join(nxt, [*keys, index])
    k = F.explode(F.sequence(F.lit(0), F.lit(times - 1)))
    both = both.select(*keys, index, value, "_n", k.alias("_j"))
    return both.select(*keys, (F.col(index) * times + F.col("_j")).alias("k"), (F.col(value) + (F.col("_n") - F.col(value)) * F.col("_j") / times).alias(value))


def spectrum(df: DataFrame, keys: list[str], index: str, value: str, n: int, dt: float) -> DataFrame:
    """Welch's power spectrum: Hann-windowed stretches of n samples, half over each other, each transformed on its own and averaged:
    keys, frequency, power; see `parts.welch`."""
    return parts.welch(df, keys, index, value, n, dt)


# ---------------------------------------------------------------- images


def bounding_rectangle(points: DataFrame, keys: list[str], x: str, y: str, steps: int = 90) -> DataFrame:
    """Of each key the rectangle of least area among `steps` directions of a quarter turn: angle, width, height, area; `hulls.least_rectangle` has the exact one."""
    sums, boxes = [], []
    for i in range(steps):
        a = math.pi / 2 * i / steps
        u, v = math.cos(a) * F.col(x) + math.sin(a) * F.col(y), math.cos(a) * F.col(y) - math.sin(a) * F.col(x)
        sums += [(F.max(u) - F.min(u)).alias(f"_w{i}"), (F.max(v) - F.min(v)).alias(f"_h{i}")]
        boxes.append(F.struct(F.round(F.col(f"_w{i}") * F.col(f"_h{i}"), 9).alias("area"), F.lit(a).alias("angle"), F.col(f"_w{i}").alias("width"), F.col(f"_h{i}").alias("height")))
    best = points.groupBy(*keys).agg(*sums).select(*keys, F.array_min(F.array(*boxes)).alias("_b"))
    return best.select(*keys, "_b.angle", "_b.width", "_b.height", "_b.area")


def peaks2d(image: DataFrame, x: str, y: str, value: str, least: float, by: list[str] | None = None) -> DataFrame:
    """Pixels of at least `least` that none of the eight around exceeds, the first in order of x and y among equal neighbours."""
    by = by or []
    around = image.select(*by, F.col(x).alias("_x"), F.col(y).alias("_y"), F.col(value).alias("_v"))
    near = around.select(*by, F.explode(F.array(*(F.struct((F.col("_x") + i).alias(x), (F.col("_y") + j).alias(y)) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j))).alias("_p"), F.struct(F.col("_v").alias("v"), (-F.col("_x")).alias("x"), (-F.col("_y")).alias("y")).alias("_n"))
    best = near.groupBy(*by, F.col(f"_p.{x}").alias(x), F.col(f"_p.{y}").alias(y)).agg(F.max("_n").alias("_n"))
    own = F.struct(F.col(value).alias("v"), (-F.col(x)).alias("x"), (-F.col(y)).alias("y"))
    return image.where(F.col(value) >= least).join(best, [*by, x, y], "left").where(F.col("_n").isNull() | (own > F.col("_n"))).drop("_n")


def similarity(pair: DataFrame, sizes: dict[str, int], a: str, b: str, sigma: float = 1.5, level: float = 255.0, scales: int = 3) -> DataFrame:
    """Structural similarity of two volumes at each scale, halved from one to the next: scale, ssim.

    The local means, variances and covariance are five blurs of the sparse volume; voxels that no blur reaches count as equal.
    """
    kernel, out = temporal.gauss_kernel(sigma), None
    c1, c2 = (0.01 * level) ** 2, (0.03 * level) ** 2
    for s in range(scales):
        t = pair.select(*sizes, F.col(a).cast("double").alias("p"), F.col(b).cast("double").alias("q")).withColumns({"pp": F.col("p") * F.col("p"), "qq": F.col("q") * F.col("q"), "pq": F.col("p") * F.col("q")})
        m = None
        for c in ("p", "q", "pp", "qq", "pq"):
            blurred = volumes.convolve(t.select(*sizes, c), sizes, c, dict.fromkeys(sizes, kernel))
            m = blurred if m is None else m.join(blurred, list(sizes), "full")
        m = m.fillna(0.0, ["p", "q", "pp", "qq", "pq"])
        p, q = F.col("p"), F.col("q")
        ssim = (2 * p * q + c1) * (2 * (F.col("pq") - p * q) + c2) / ((p * p + q * q + c1) * (F.col("pp") - p * p + F.col("qq") - q * q + c2))
        whole = math.prod(sizes.values())
        one = m.agg(((F.coalesce(F.sum(ssim), F.lit(0.0)) + F.lit(whole) - F.count("*")) / whole).alias("ssim")).select(F.lit(s).alias("scale"), "ssim")
        out = one if out is None else out.unionByName(one)
        pair = pair.groupBy(*(F.floor(F.col(x) / 2).cast("long").alias(x) for x in sizes)).agg((F.sum(a) / 2 ** len(sizes)).alias(a), (F.sum(b) / 2 ** len(sizes)).alias(b))
        sizes = {x: -(-n // 2) for x, n in sizes.items()}
    return out


def analysis_mask(volume: DataFrame, sizes: dict[str, int], value: str, sigma: float, p: float, reach: int = 1) -> DataFrame:
    """Voxels whose blurred value reaches its nearest-rank percentile, dilated and closed."""
    kernel = temporal.gauss_kernel(sigma)
    b = volumes.convolve(volume, sizes, value, dict.fromkeys(sizes, kernel)).withColumn("_one", F.lit(1))
    bright = b.join(stats.nearest_rank_by(b, ["_one"], value, p, "_least"), "_one").where(F.col(value) >= F.col("_least"))
    return volumes.closed(volumes.dilate(bright.select(*sizes), list(sizes), reach), list(sizes), reach)


def clock_from_flashes(video: DataFrame, log: DataFrame, frame: str, brightness: str, t: str, command: Column, apart: float) -> DataFrame:
    """The line from frame number to time through the two brightest frames `apart` or more from each other and the log's first and last flash: slope, intercept."""
    from . import segments

    two = segments.strongest_two(video.select(frame, brightness), frame, brightness, frame, apart).agg(F.min(frame).alias("f0"), F.max(frame).alias("f1"))
    flash = log.where(command).agg(F.min(t).alias("t0"), F.max(t).alias("t1"))
    slope = (F.col("t1") - F.col("t0")) / (F.col("f1") - F.col("f0"))
    return two.crossJoin(flash).select(slope.alias("slope"), (F.col("t0") - slope * F.col("f0")).alias("intercept"))  # one row each


def time_warp(rows: DataFrame, keys: list[str], t: str, value: str, target: DataFrame, points: int = 4, most: float = 0.125, bound: int = 100_000) -> DataFrame:
    """rows with `warped`, the time in the target series that fits each best: t plus a spline of `points` shifts within `most` of the
    key's span, found with a scale and an offset of the target by Gauss-Newton; `scale` and `offset` with them.

    target: (t, value), a mean cycle; it is sent to all tasks and has to be short (`bound` rows at the most).
    """
    import numpy as np

    mean = target.select(t, value).where(F.col(value).isNotNull()).orderBy(t).limit(bound + 1).toPandas()
    if len(mean) > bound or len(mean) < 2:
        raise ValueError(f"a target of 2 to {bound} rows, please")
    tt, ty = mean[t].to_numpy(float), mean[value].to_numpy(float)
    slope = np.gradient(ty, tt)

    def one(p):
        x, y = p[t].to_numpy(float), p[value].to_numpy(float)
        ok = np.isfinite(y)
        span = max(np.ptp(x), 1e-9)
        u = (x - x.min()) / span * (points - 1)
        basis = np.maximum(0, 1 - np.abs(u[:, None] - np.arange(points)))
        limit, d, scale, offset, damp = most * span, np.zeros(points), 1.0, 0.0, 1e-3

        def cost(d):
            f = np.interp(x + basis @ d, tt, ty)
            a = np.stack([f[ok], np.ones(ok.sum())], 1)
            (s, o), *_ = np.linalg.lstsq(a, y[ok], rcond=None)
            return float(((y[ok] - s * f[ok] - o) ** 2).sum()), s, o

        now, scale, offset = cost(d)
        for _ in range(60):
            w = x + basis @ d
            j = (scale * np.interp(w, tt, slope))[:, None] * basis
            r = y - scale * np.interp(w, tt, ty) - offset
            h = j[ok].T @ j[ok]
            step = np.linalg.solve(h + (damp * np.trace(h) / points + 1e-12) * np.eye(points), j[ok].T @ r[ok])
            new = np.clip(d + step, -limit, limit)
            c, s, o = cost(new)
            if c < now:
                d, scale, offset, done, now, damp = new, s, o, now - c < 1e-12 * (1 + now), c, damp / 3
                if done:
                    break
            else:
                damp *= 4
                if damp > 1e6:
                    break
        return p.assign(warped=x + basis @ d, scale=scale, offset=offset)

    return estimators.by_key(rows, keys, [t], one, f"{estimators._ddl(rows)}, warped double, scale double, offset double", bound)
