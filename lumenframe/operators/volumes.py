"""Operators on sparse volumes: one row a voxel, integer indices, absent voxels are 0 or outside the mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .temporal import gauss_kernel


def _around(mask: DataFrame, axes: list[str], reach: int) -> DataFrame:
    for a in axes:
        mask = mask.withColumn(a, F.explode(F.sequence(F.col(a) - reach, F.col(a) + reach)))
    return mask


def dilate(mask: DataFrame, axes: list[str], reach: int = 1, by: list[str] | None = None) -> DataFrame:
    """Voxels with one of the mask within a box of `reach`, axis after axis: (2 reach + 1) rows a voxel and shuffle."""
    out = mask.select(*(by or []), *axes).distinct()
    for a in axes:
        out = _around(out, [a], reach).distinct()
    return out


def erode(mask: DataFrame, axes: list[str], reach: int = 1, by: list[str] | None = None) -> DataFrame:
    """Voxels whose whole box of `reach` is in the mask."""
    by, out = by or [], mask.select(*(by or []), *axes).distinct()
    for a in axes:
        out = _around(out, [a], reach).groupBy(*by, *axes).count().where(F.col("count") == 2 * reach + 1).drop("count")
    return out


def closed(mask: DataFrame, axes: list[str], reach: int = 1, by: list[str] | None = None) -> DataFrame:
    return erode(dilate(mask, axes, reach, by), axes, reach, by)


def opened(mask: DataFrame, axes: list[str], reach: int = 1, by: list[str] | None = None) -> DataFrame:
    return dilate(erode(mask, axes, reach, by), axes, reach, by)


def _spread(index: Column, n: int, kernel: list[tuple[int, float]]) -> Column:
    """Where a voxel's value goes along an axis of n and with which weight, edge values continued beyond the ends."""
    step = lambda pairs: F.array(*[F.struct(F.lit(i).cast("long").alias("o"), F.lit(float(w)).alias("w")) for i, w in pairs])
    most = max(abs(x) for x, _ in kernel)
    if n == 1:
        return step([(0, 1.0)])
    first = [(i, sum(w for x, w in kernel if x >= i)) for i in range(min(most, n - 1) + 1)]
    last = [(-i, sum(w for x, w in kernel if x <= -i)) for i in range(min(most, n - 1) + 1)]
    return F.when(index == 0, step(first)).when(index == n - 1, step(last)).otherwise(step(kernel))


def convolve(volume: DataFrame, sizes: dict[str, int], value: str, kernels: dict[str, list[tuple[int, float]]], by: list[str] | None = None) -> DataFrame:
    """Separable convolution of a sparse volume, out[i] = sum of w(x) in[i - x], inside its sizes: one partial aggregation an axis."""
    keys = [*(by or []), *sizes]
    for a, kernel in kernels.items():
        rows = volume.select(*keys, value, F.explode(_spread(F.col(a), sizes[a], kernel)).alias("_s"))
        rows = rows.withColumn(a, F.col(a) + F.col("_s.o")).withColumn(value, F.col(value) * F.col("_s.w")).where(F.col(a).between(0, sizes[a] - 1))
        volume = rows.groupBy(*keys).agg(F.sum(value).alias(value))
    return volume


def blur(volume: DataFrame, sizes: dict[str, int], value: str, sigma: float, by: list[str] | None = None) -> DataFrame:
    return convolve(volume, sizes, value, {a: gauss_kernel(sigma) for a in sizes}, by)


def spline_weights(u: Column) -> list[Column]:
    """The four cubic B-spline weights at u, 0 to 1, of the control points one before to two after."""
    return [F.pow(1 - u, 3) / 6, (3 * F.pow(u, 3) - 6 * F.pow(u, 2) + 4) / 6, (-3 * F.pow(u, 3) + 3 * F.pow(u, 2) + 3 * u + 1) / 6, F.pow(u, 3) / 6]


def spline_field(points: DataFrame, lattice: DataFrame, axes: dict[str, tuple[float, float, int]], values: list[str]) -> DataFrame:
    """points with `values` of a B-spline lattice, whose rows are `i_<axis>` and the values; axes: start, step, count.

    Control points beyond the ends are the last ones.  Rows of points are told apart by a generated key, so equal ones
    all stay; a missing control point is 0.  A point with a null coordinate has null values.
    """
    fits = F.lit(True)
    for a in axes:
        fits = fits & F.col(a).isNotNull()
    keyed = points.withColumn("_k", F.struct(F.monotonically_increasing_id(), *[F.col(c) for c in points.columns]))
    rows = keyed.where(fits).withColumn("_w", F.lit(1.0))
    for a, (start, step, n) in axes.items():
        s = (F.col(a) - start) / step
        low = F.floor(s)
        pairs = F.array(*[F.struct(F.greatest(F.lit(0), F.least(F.lit(n - 1), low + i - 1)).cast("long").alias("i"), w.alias("w")) for i, w in enumerate(spline_weights(s - low))])
        rows = rows.withColumn("_s", F.explode(pairs)).withColumn(f"i_{a}", F.col("_s.i")).withColumn("_w", F.col("_w") * F.col("_s.w")).drop("_s")
    on = [f"i_{a}" for a in axes]
    found = rows.select("_k", "_w", *on).join(lattice.select(*on, *[F.col(v).alias(f"_{v}") for v in values]), on, "left")
    summed = found.groupBy("_k").agg(*[F.coalesce(F.sum(F.col("_w") * F.col(f"_{v}")), F.lit(0.0)).alias(v) for v in values])
    out = summed.select("_k.*", *values).select(*points.columns, *values)
    return out.unionByName(points.where(~fits), allowMissingColumns=True)


def on_grid(volume: DataFrame, sizes: dict[str, int], value: str, by: list[str], change) -> DataFrame:
    """Every voxel of the grid with what `change` makes of each `by`'s dense array, in which missing voxels are nan.

    Absent, null and non-finite values are missing.  Of repeated voxels the largest value counts; voxels outside the
    sizes, or with a null index, are left out.  One volume is one task of the memory of its grid, which `sizes` bounds.
    """
    import numpy as np

    shape = tuple(sizes.values())

    def made(pdf):
        x = np.full(shape, np.nan)
        x[tuple(pdf[a].to_numpy() for a in sizes)] = pdf[value].to_numpy()
        out = dict(zip(sizes, (i.ravel() for i in np.indices(shape)))) | {value: change(x).ravel()}
        first = pdf.iloc[:1][by].reset_index(drop=True)
        return type(pdf)({**{b: first[b].repeat(x.size).to_numpy() for b in by}, **out})

    rows, v = volume, F.col(value).cast("double")
    for a, n in sizes.items():
        rows = rows.where(F.col(a).between(0, n - 1))
    good = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
    rows = rows.groupBy(*by, *sizes).agg(F.max(good).alias(value)).select(*by, *[F.col(a).cast("long").alias(a) for a in sizes], value)
    return rows.groupBy(*by).applyInPandas(made, rows.schema)


def filled(x):
    """A dense array whose nan take the mean of their face neighbours, round after round; all nan: unchanged."""
    import numpy as np

    x = x.copy()
    while (missing := np.isnan(x)).any() and not missing.all():
        pad = np.pad(x, 1, constant_values=np.nan)
        total, n = np.zeros(x.shape), np.zeros(x.shape)
        for d in range(x.ndim):
            for s in (0, 2):
                near = pad[tuple(slice(s if k == d else 1, (s if k == d else 1) + m) for k, m in enumerate(x.shape))]
                total += np.nan_to_num(near)
                n += ~np.isnan(near)
        new = missing & (n > 0)
        x[new] = total[new] / n[new]
    return x


def infill(volume: DataFrame, sizes: dict[str, int], value: str, by: list[str]) -> DataFrame:
    """`on_grid` with missing voxels filled from their face neighbours; a volume without any value stays null."""
    return on_grid(volume, sizes, value, by, filled)


def l1_smoothed(y, s: float, penalty: float = 1.0, most: int = 100, least: float = 1e-5):
    """The z of least sum |z - y| over known voxels + s |Laplacian z|^2 (Neumann ends), by split Bregman in the cosine basis.

    Missing voxels (nan) follow the smooth surface.  It ends after `most` rounds, or once a round changes z by less than
    `least` of its norm.
    """
    import numpy as np

    known = ~np.isnan(y)
    if not known.any():
        return y
    bases, curve = [], np.zeros(y.shape)
    for d, n in enumerate(y.shape):
        k = np.arange(n)
        c = np.cos(np.pi * np.outer(k, k + 0.5) / n) * np.sqrt(2 / n)
        c[0] /= np.sqrt(2)
        bases.append(c)
        curve = curve + (2 - 2 * np.cos(np.pi * k / n)).reshape([-1 if a == d else 1 for a in range(y.ndim)])
    damping = 1 / (1 + 2 * s / penalty * curve**2)

    def smooth(x):
        for turn in (False, True):
            for d, c in enumerate(bases):
                x = np.moveaxis(np.tensordot(c.T if turn else c, x, (1, d)), 0, d)
            x = x if turn else x * damping
        return x

    z, data = filled(y), np.where(known, y, 0.0)
    rest, slack = np.zeros(y.shape), np.zeros(y.shape)
    for _ in range(most):
        before, z = z, smooth(np.where(known, data + rest - slack, z))
        off = z - data + slack
        rest = np.where(known, np.sign(off) * np.maximum(np.abs(off) - 1 / penalty, 0), 0.0)
        slack = np.where(known, off - rest, 0.0)
        if np.linalg.norm(z - before) < least * np.linalg.norm(before):
            break
    return z


def l1_spline(volume: DataFrame, sizes: dict[str, int], value: str, by: list[str], s: float = 0.01, penalty: float = 1.0) -> DataFrame:
    """`on_grid` with robustly smoothed values, missing voxels filled; a volume without any value stays null."""
    return on_grid(volume, sizes, value, by, lambda y: l1_smoothed(y, s, penalty))


def shifted(image, dx: float, dy: float):
    """A dense image moved by a part of a pixel through the phases of its Fourier transform, padded to powers of two."""
    import numpy as np

    n = [2 ** int(np.ceil(np.log2(m + abs(d)))) for m, d in zip(image.shape, (dx, dy))]
    pad = [(a - m) // 2 for a, m in zip(n, image.shape)]
    frame = np.zeros(n)
    inside = tuple(slice(p, p + m) for p, m in zip(pad, image.shape))
    frame[inside] = np.nan_to_num(image)
    turn = np.exp(-2j * np.pi * (dx * np.fft.fftfreq(n[0])[:, None] + dy * np.fft.fftfreq(n[1])))
    return np.abs(np.fft.ifft2(np.fft.fft2(frame) * turn))[inside]


def translate(stack: DataFrame, sizes: dict[str, int], value: str, by: list[str], dx: float, dy: float) -> DataFrame:
    """`on_grid` with each image moved by (dx, dy) along its two axes; missing pixels are 0."""
    return on_grid(stack, sizes, value, by, lambda x: shifted(x, dx, dy))
