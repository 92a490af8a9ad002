"""Video and volumes frame by frame: shifts between frames, the bright spot, intensities.  A frame is one group, which its size bounds."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import stats, temporal

# ---------------------------------------------------------------- shifts by correlation


def correlation_peak(a: np.ndarray, b: np.ndarray, sharpness: float = 0.5) -> tuple[np.ndarray, float]:
    """The shift s for which a(x) and b(x + s) are most alike, to a part of a bin, and the peak's height over the mean.

    The cross-correlation of the arrays less their means, over their sizes and with each frequency's size to the power `sharpness` taken off (1: phases
    alone); arrays are set in zeros of twice their size, so nothing wraps.  Between bins the peak is the top of a parabola along each axis.
    """
    shape = [2 * n for n in a.shape]
    axes = list(range(a.ndim))
    product = np.conj(np.fft.rfftn(a - a.mean(), shape, axes)) * np.fft.rfftn(b - b.mean(), shape, axes)
    c = np.fft.irfftn(product / np.maximum(np.abs(product), 1e-12 * max(np.abs(product).max(), 1e-300)) ** sharpness, shape, axes)
    top = np.unravel_index(int(c.argmax()), c.shape)
    out = np.zeros(a.ndim)
    for k in range(a.ndim):
        side = [c[tuple((t + d * (i == k)) % shape[i] for i, t in enumerate(top))] for d in (-1, 0, 1)]
        bend = side[0] - 2 * side[1] + side[2]
        part = 0.5 * (side[0] - side[2]) / bend if bend < 0 else 0.0
        out[k] = (top[k] if top[k] < a.shape[k] else top[k] - shape[k]) + part
    return out, float(c.max() / max(c.std(), 1e-300))


def frame_shifts(images: DataFrame, keys: list[str], frame: str, sizes: dict[str, int], value: str, sharpness: float = 0.5, bound: int = 1 << 24) -> DataFrame:
    """keys, frame, a shift along each axis (`d_<axis>`) and `height`: where each frame's image is in the next one.

    Bins outside the sizes, or null, are left out; repeated bins are added up; missing ones are 0.  Frames are whole numbers; one without a next one has
    no row.  Each frame goes to two groups, with the one before and the one after.
    """
    if math.prod(sizes.values()) > bound:
        raise ValueError(f"a frame of {math.prod(sizes.values())} bins; {bound} at most")
    rows = images.where(F.col(value).isNotNull() & F.col(frame).isNotNull())
    for a, n in sizes.items():
        rows = rows.where(F.col(a).between(0, n - 1))
    rows = rows.select(*keys, F.col(frame).cast("long").alias("_f"), *(F.col(a).cast("int").alias(a) for a in sizes), F.col(value).cast("double").alias("_v"), F.explode(F.array(F.lit(0), F.lit(1))).alias("_second"))
    rows = rows.withColumn("_pair", F.col("_f") - F.col("_second"))
    kinds, shape = dict(rows.dtypes), tuple(sizes.values())

    def one(d: pd.DataFrame) -> pd.DataFrame:
        names = [*keys, frame, *(f"d_{a}" for a in sizes), "height"]
        if d["_second"].nunique() < 2:
            return pd.DataFrame(columns=names)
        both = []
        for second in (0, 1):
            x, part = np.zeros(shape), d[d["_second"] == second]
            np.add.at(x, tuple(part[a].to_numpy() for a in sizes), part["_v"].to_numpy())
            both.append(x)
        s, height = correlation_peak(*both, sharpness)
        return pd.DataFrame([[*(d[k].iloc[0] for k in keys), int(d["_pair"].iloc[0]), *map(float, s), height]], columns=names)

    ddl = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"`{frame}` long", *(f"`d_{a}` double" for a in sizes), "height double"])
    return rows.groupBy(*keys, "_pair").applyInPandas(one, ddl)


# ---------------------------------------------------------------- spots


def largest_component(mask: np.ndarray) -> np.ndarray:
    """The largest set of cells that are joined by their faces; of equally large ones that with the first cell.

    Each cell takes the least label around it, and then its label's own, until none changes: a few rounds of whole arrays.
    """
    label = np.where(mask.ravel(), np.arange(mask.size), -1)
    if not mask.any():
        return mask.copy()
    grid = np.arange(mask.size).reshape(mask.shape)
    ends = []
    for k in range(mask.ndim):
        a, b = np.moveaxis(grid, k, 0)[:-1].ravel(), np.moveaxis(grid, k, 0)[1:].ravel()
        both = mask.ravel()[a] & mask.ravel()[b]
        ends.append(np.stack([a[both], b[both]]))
    a, b = np.concatenate(ends, 1)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        inside = new >= 0
        new[inside] = new[new[inside]]
        if (new == label).all():
            break
        label = new
    names, n = np.unique(label[label >= 0], return_counts=True)
    return (label == names[n.argmax()]).reshape(mask.shape)


def bright_spots(images: DataFrame, keys: list[str], frame: str, sizes: dict[str, int], value: str, share: float = 0.99, bound: int = 1 << 24) -> DataFrame:
    """keys, frame, the centre of each axis (weighted by value), `cells` and `found`: the largest joined set of cells at or over a frame's percentile.

    The percentile (nearest rank) is over the frame's cells that have a value.  A frame without a cell has the centre of the nearest frame that has one, and found
    is false; frames that no row has at all are not made.
    """
    if math.prod(sizes.values()) > bound:
        raise ValueError(f"a frame of {math.prod(sizes.values())} cells; {bound} at most")
    rows = images.where(F.col(frame).isNotNull()).select(*keys, F.col(frame).cast("long").alias(frame), *(F.col(a).cast("int").alias(a) for a in sizes), F.col(value).cast("double").alias("_v"))
    inside = F.col("_v").isNotNull()
    for a, n in sizes.items():
        inside = inside & F.col(a).between(0, n - 1)
    good = rows.where(inside).groupBy(*keys, frame, *sizes).agg(F.sum("_v").alias("_v"))
    limit = stats.nearest_rank_by(good, [*keys, frame], "_v", share, "_limit")
    some = good.join(limit, [*keys, frame]).where(F.col("_v") >= F.col("_limit"))
    kinds, shape, names = dict(some.dtypes), tuple(sizes.values()), list(sizes)

    def one(d: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros(shape)
        x[tuple(d[a].to_numpy() for a in names)] = d["_v"].to_numpy()
        mask = np.zeros(shape, bool)
        mask[tuple(d[a].to_numpy() for a in names)] = True
        mask = largest_component(mask)
        at, w = np.argwhere(mask), x[mask]
        w = w if w.sum() > 0 else np.ones(len(w))
        middle = (w[:, None] * at).sum(0) / w.sum()
        return pd.DataFrame([[*(d[k].iloc[0] for k in keys), int(d[frame].iloc[0]), *map(float, middle), len(at)]], columns=[*keys, frame, *names, "cells"])

    ddl = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"`{frame}` long", *(f"`{a}` double" for a in names), "cells long"])
    found = some.groupBy(*keys, frame).applyInPandas(one, ddl)
    all_ = rows.select(*keys, frame).distinct()
    near = temporal.asof_join(all_, found, keys, frame, [*names, "cells"], "nearest")
    here = found.select(*keys, frame, F.lit(True).alias("found"))
    return near.join(here, [*keys, frame], "left").select(*keys, frame, *names, "cells", F.coalesce("found", F.lit(False)).alias("found"))


def intensity(images: DataFrame, keys: list[str], frame: str, value: str) -> DataFrame:
    """keys, frame, `total`, `mean` and `change`, the step of the total from the frame before, of each frame's cells that have a value."""
    g = images.where(F.col(frame).isNotNull()).groupBy(*keys, frame).agg(F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return g.withColumn("change", F.col("total") - F.lag("total").over(Window.partitionBy(*keys).orderBy(frame)))
