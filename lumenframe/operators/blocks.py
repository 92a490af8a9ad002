"""Changes of dense volumes of any size in overlapping blocks, and what is built of them: smoothed movies, template images.

A block is `block` voxels along each axis and `halo` more on either side.  What `change` makes of it counts fully within the block, and fades over the
halo, so that neighbours' values run into each other without a seam.  A change that looks no further than the halo less a
block's fade is that of the whole volume; others differ from it near borders as they forget what is far.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import volumes

MOST = 1 << 24


def in_blocks(volume: DataFrame, sizes: dict[str, int], value: str, by: list[str], change: Callable[[np.ndarray], np.ndarray], block: dict[str, int], halo: int) -> DataFrame:
    """by, axes and value: every voxel of the grid with what `change` makes of its block's dense array (missing voxels nan), blended.

    Null and non-finite values are missing; of repeated voxels the largest counts; voxels outside the sizes are left out.  Every volume
    of `by` with a row makes its whole grid, block by block.  A voxel goes to the blocks whose halo holds it: up to two along an axis
    while the halo is no more than half a block.
    """
    if any(2 * halo > block[a] for a in sizes) or np.prod([block[a] + 2 * halo for a in sizes]) > MOST:
        raise ValueError(f"a halo of half a block at the most, and blocks of {MOST} voxels")
    v = F.col(value).cast("double")
    rows = volume.select(*by, *(F.col(a).cast("long").alias(a) for a in sizes), F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v).alias(value))
    for a, n in sizes.items():
        rows = rows.where(F.col(a).between(0, n - 1))
    rows = rows.groupBy(*by, *sizes).agg(F.max(value).alias(value))
    blocks = {a: -(-n // block[a]) for a, n in sizes.items()}
    every = rows.select(*by).distinct() if by else rows.limit(1).select()
    for a, n in blocks.items():
        every = every.withColumn(f"_{a}", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    sent = rows
    for a, n in blocks.items():
        sent = sent.withColumn(f"_{a}", F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col(a) - halo) / block[a])), F.least(F.lit(n - 1), F.floor((F.col(a) + halo) / block[a])))))
    both = sent.unionByName(every, allowMissingColumns=True)
    kinds, axes = dict(both.dtypes), list(sizes)

    def one(d: pd.DataFrame) -> pd.DataFrame:
        low = [max(0, int(d[f"_{a}"].iloc[0]) * block[a] - halo) for a in axes]
        high = [min(sizes[a], (int(d[f"_{a}"].iloc[0]) + 1) * block[a] + halo) for a in axes]
        x, some = np.full([h - w for h, w in zip(high, low, strict=True)], np.nan), d[d[axes[0]].notna()]
        x[tuple(some[a].to_numpy(np.int64) - w for a, w in zip(axes, low, strict=True))] = some[value].to_numpy(float)
        y, weight = change(x), np.ones(x.shape)
        for k, a in enumerate(axes):
            at, n = np.arange(low[k], high[k]), int(d[f"_{a}"].iloc[0])
            fade = np.ones(len(at))
            if n > 0:
                fade = np.minimum(fade, (at - (n * block[a] - halo) + 0.5) / max(1, 2 * halo))
            if n < blocks[a] - 1:
                fade = np.minimum(fade, ((n + 1) * block[a] + halo - at - 0.5) / max(1, 2 * halo))
            weight = weight * np.clip(fade, 0, 1).reshape([-1 if i == k else 1 for i in range(x.ndim)])
        where = np.indices(x.shape).reshape(x.ndim, -1)
        out = {**{b: d[b].iloc[:1].repeat(x.size).to_numpy() for b in by}, **{a: where[k] + low[k] for k, a in enumerate(axes)}, value: y.ravel(), "_w": weight.ravel()}
        return pd.DataFrame(out)[weight.ravel() > 0]

    ddl = ", ".join([*(f"`{b}` {kinds[b]}" for b in by), *(f"`{a}` long" for a in axes), f"`{value}` double", "_w double"])
    each = both.groupBy(*by, *(f"_{a}" for a in axes)).applyInPandas(one, ddl)
    known = F.when(F.col(value).isNotNull() & ~F.isnan(value), F.col("_w"))
    return each.groupBy(*by, *axes).agg((F.sum(known * F.col(value)) / F.sum(known)).alias(value))


def l1_spline(volume: DataFrame, sizes: dict[str, int], value: str, by: list[str], s: float = 0.01, block: int = 64, halo: int = 12, penalty: float = 1.0) -> DataFrame:
    """`volumes.l1_spline` of volumes that one task could not hold; a block without any value stays null where no other reaches it."""
    return in_blocks(volume, sizes, value, by, lambda y: volumes.l1_smoothed(y, s, penalty), {a: block for a in sizes}, halo)


def smoothed_movie(counts: DataFrame, sizes: dict[str, int], frame: str, mode: str = "rate", s: float = 0.01, least_dwell: float = 1e-3, block: int = 64, halo: int = 12) -> DataFrame:
    """frame, axes and v of every voxel of each frame: its counts, or counts over dwell where the scan dwelt, smoothed and no less than 0.

    counts: frame, axes, counts and dwell; voxels the scan did not dwell on for `least_dwell` are missing from rates, and absent ones
    from both.  mode: count (or counts) or rate.
    """
    if mode not in ("count", "counts", "rate"):
        raise ValueError("mode is count or rate")
    v = F.col("counts").cast("double") if mode != "rate" else F.when(F.col("dwell") >= least_dwell, F.col("counts") / F.col("dwell"))
    out = l1_spline(counts.select(frame, *sizes, v.alias("v")), sizes, "v", [frame], s, block, halo)
    return out.withColumn("v", F.greatest("v", F.lit(0.0)))


def template_image(counts: DataFrame, sizes: dict[str, int], frames: DataFrame, frame: str, least_rate: float, mask: DataFrame | None = None, s: float = 0.01, least_dwell: float = 1e-3, block: int = 64, halo: int = 12) -> DataFrame:
    """axes and v: counts over dwell of the chosen frames together, smoothed, 0 outside the mask's voxels, and no less than `least_rate`."""
    total = counts.join(frames.select(frame).distinct(), frame, "left_semi").groupBy(*sizes).agg(F.sum("counts").alias("counts"), F.sum("dwell").alias("dwell"))
    out = smoothed_movie(total.withColumn("_f", F.lit(0)), sizes, "_f", "rate", s, least_dwell, block, halo).drop("_f")
    if mask is not None:
        kept = mask.select(*sizes).distinct().withColumn("_in", F.lit(1))
        out = out.join(kept, list(sizes), "left").withColumn("v", F.when(F.col("_in").isNotNull(), F.col("v")).otherwise(0.0)).drop("_in")
    return out.withColumn("v", F.greatest("v", F.lit(float(least_rate))))
