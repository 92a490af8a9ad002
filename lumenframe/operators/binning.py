"""Weighted counts and dwell on grids, templates, regions and aligned traces: compositions of bins, poses and clock joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import acquisition, geometry, grid, registered, stats, temporal
from .grid import Axis

XYZ = ("x", "y", "z")


def affine_bins(points: DataFrame, axes: list[tuple[str, Axis]], weight: Column, matrix: list[list[float]] | None = None, by: list[str] | None = None) -> DataFrame:
    """Sums of a weight in bins of points under a 3 x 4 affine map (None: as they are): columns of bins and `n`."""
    moved = points
    if matrix is not None:
        x, y, z = (F.col(c) for c in XYZ)
        moved = points.withColumns({c: m[0] * x + m[1] * y + m[2] * z + m[3] for c, m in zip(XYZ, matrix, strict=True)})
    return grid.bin_points(moved, axes, {"n": weight}, by)


def photon_bins(photons: DataFrame, axes: list[tuple[str, Axis]], phase: str, amplitude: float, matrix: list[list[float]] | None = None, by: list[str] | None = None) -> DataFrame:
    """Photons at the depth that their phase gives, each weighing its share of dwell there."""
    placed = photons.withColumn("z", acquisition.depth(F.col(phase), amplitude))
    return affine_bins(placed, axes, acquisition.depth_weight(F.col(phase)), matrix, by)


def spread_dwell(dwell: DataFrame, plane: list[tuple[str, Axis]], depth: Axis, value: str, by: list[str] | None = None) -> DataFrame:
    """Dwell binned in a plane, then shared evenly over the depth's bins: summed first, so that a pixel is spread once."""
    flat = grid.bin_points(dwell, plane, {"dwell": F.col(value)}, by)
    cells = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(depth.n - 1).cast("long")))
    return flat.select(*(by or []), *(f"i{a.name}" for _, a in plane), cells.alias(f"i{depth.name}"), (F.col("dwell") / depth.n).alias("dwell"))


def phase_bins(points: DataFrame, plane: list[tuple[str, Axis]], phase: str, bins: int, dwell: str) -> DataFrame:
    """Counts and dwell by plane and phase bin `ip`."""
    at = F.least(F.lit(bins - 1), F.floor(F.col(phase) / acquisition.TURN * bins)).cast("long")
    return grid.bin_points(points.withColumn("ip", at), plane, {"n": F.lit(1), "dwell": F.col(dwell)}, ["ip"])


def along_region(points: DataFrame, start: tuple, end: tuple, half_width: float, bins: int, how: Column, by: list[str] | None = None) -> DataFrame:
    """Any aggregate of the points in bins along a segment, within half_width of it: `bin` and `value`."""
    par, beside = geometry.along_vector(F.col("x"), F.col("y"), start, end, half_width)
    length = ((end[0] - start[0]) ** 2 + (end[1] - start[1]) ** 2) ** 0.5
    return points.where(beside).groupBy(*(by or []), F.least(F.lit(bins - 1), F.floor(par / length * bins)).cast("long").alias("bin")).agg(how.alias("value"))


def in_ranges(points: DataFrame, ranges: DataFrame, keys: list[str], t: str, axes: list[tuple[str, Axis]]) -> DataFrame:
    """Counts by range (`range`: an id) and bin, for ranges start to end that do not overlap within a key."""
    placed = temporal.frame_join(points, ranges, keys, t, "start", "end", ["range"])
    return grid.bin_points(placed.where("range is not null"), axes, {"n": F.lit(1)}, ["range"])


def nonrigid_bins(points: DataFrame, poses: DataFrame, field: DataFrame, frame: list[str], axes: list[tuple[str, Axis]]) -> DataFrame:
    """Counts by frame and bin of points under their frame's pose and then its displacement field."""
    rows = registered.posed(points, poses, frame)
    for c, a in axes:
        rows = rows.withColumn(f"i{a.name}", a.index(F.col(c)))
    moved = acquisition.displaced(rows, field, frame, [f"i{a.name}" for _, a in axes]).drop(*(f"i{a.name}" for _, a in axes))
    return grid.bin_points(moved, axes, {"n": F.lit(1)}, frame)


# ---------------------------------------------------------------- templates


def best_frames(metrics: DataFrame, metric: str, p: float, chunk: str | None = None) -> DataFrame:
    """Frames whose metric reaches its nearest-rank percentile, over all or in each chunk."""
    keys = [chunk] if chunk else []
    if not keys:
        metrics, keys = metrics.withColumn("_one", F.lit(1)), ["_one"]
    return metrics.join(stats.nearest_rank_by(metrics, keys, metric, p, "_least"), keys).where(F.col(metric) >= F.col("_least")).drop("_least", "_one")


def template(volume: DataFrame, frames: DataFrame, frame: list[str], voxel: list[str], floor: float | None = None) -> DataFrame:
    """Counts and dwell of the chosen frames summed by voxel, and their rate, at least `floor` if one is given."""
    chosen = volume.join(frames.select(*frame).distinct(), frame, "left_semi").groupBy(*voxel).agg(F.sum("counts").alias("counts"), F.sum("dwell").alias("dwell"))
    r = grid.rate(F.col("counts"), F.col("dwell"))
    return chosen.withColumn("rate", r if floor is None else F.greatest(r, F.lit(floor)))


def occupied(points: DataFrame, axes: list[tuple[str, Axis]], weight: Column, by: list[str] | None = None) -> DataFrame:
    """Bins of positive weight with their centres: what a fit of points works on."""
    b = grid.bin_points(points, axes, {"n": weight}, by).where("n > 0")
    return b.withColumns({c: F.lit(a.start) + (F.col(f"i{a.name}") + 0.5) * a.width for c, a in axes})


def blocks(volume: DataFrame, axes: list[str], value: str, size: int = 2, by: list[str] | None = None) -> DataFrame:
    """Sums over blocks of size bins on each axis."""
    return volume.groupBy(*(by or []), *(F.floor(F.col(a) / size).cast("long").alias(a) for a in axes)).agg(F.sum(value).alias(value))


# ---------------------------------------------------------------- regions


def centres(masks: DataFrame, voi: list[str], axes: list[str]) -> DataFrame:
    """Mean voxel of each region, and its number of voxels."""
    return masks.groupBy(*voi).agg(*(F.avg(a).alias(a) for a in axes), F.count("*").alias("voxels"))


def relative_places(spots: DataFrame, keys: list[str], axes: list[str]) -> DataFrame:
    """Places relative to the mean of their key's spots."""
    mean = spots.groupBy(*keys).agg(*(F.avg(a).alias(f"_{a}") for a in axes))
    return spots.join(mean, keys).withColumns({a: F.col(a) - F.col(f"_{a}") for a in axes}).drop(*(f"_{a}" for a in axes))


def one_per_time(fits: DataFrame, keys: list[str], t: str, values: list[str], angles: list[str]) -> DataFrame:
    """Fits that overlap in time reduced to one a time: means, of angles over the circle."""
    return fits.groupBy(*keys, t).agg(*(F.avg(v).alias(v) for v in values), *(F.atan2(F.avg(F.sin(a)), F.avg(F.cos(a))).alias(a) for a in angles))


def region_mask(spark, axes: list[Axis], inside: Column, voi: int) -> DataFrame:
    """Voxels whose centre (columns x, y, z) satisfies a predicate: a sphere's, a cylinder's or a hull's."""
    return region_masks(spark.range(1).select(F.lit(voi).alias("voi")), ["voi"], axes, {"": inside}).drop("kind")


def region_masks(regions: DataFrame, keys: list[str], axes: list[Axis], kinds: dict[str, Column]) -> DataFrame:
    """keys, kind and voxels whose centre (columns x, y, z) lies in each region; what is inside may name the regions' columns.

    Each region makes its own grid, which the axes bound; a region with nulls has none.
    """
    n = math.prod(a.n for a in axes)
    g, step = regions.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))), 1
    for a in reversed(axes):
        g = g.withColumn(f"i{a.name}", (F.floor(F.col("_k") / step) % a.n).cast("long"))
        step *= a.n
    g = g.withColumns({a.name: F.lit(a.start) + (F.col(f"i{a.name}") + 0.5) * a.width for a in axes})
    each = F.explode(F.array_compact(F.array(*(F.when(inside, F.lit(k)) for k, inside in kinds.items()))))
    return g.select(*keys, each.alias("kind"), *(f"i{a.name}" for a in axes))


def radius_contrast(points: DataFrame, centre: tuple, radii: list[float], value: str) -> DataFrame:
    """For each radius the mean inside less that of the shell of equal volume around: one pass, an aggregate a radius."""
    d2 = sum(((F.col(c) - m) ** 2 for c, m in zip(XYZ[1:], centre[1:], strict=True)), (F.col("x") - centre[0]) ** 2)
    out = points.withColumn("_d", d2).agg(*(f for i, r in enumerate(radii) for f in (F.avg(F.when(F.col("_d") < r * r, F.col(value))).alias(f"i{i}"), F.avg(F.when((F.col("_d") >= r * r) & (F.col("_d") < 2 ** (2 / 3) * r * r), F.col(value))).alias(f"s{i}"))))
    each = F.array(*(F.struct(F.lit(float(r)).alias("radius"), (F.col(f"i{i}") - F.col(f"s{i}")).alias("contrast")) for i, r in enumerate(radii)))
    return out.select(F.inline(each))


def moved_sphere(centre: tuple, radius: float, matrix: list[list[float]]) -> tuple[tuple, float]:
    """A sphere under an affine map: its centre moved, its radius by the cube root of the map's determinant."""
    m = matrix
    det = m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])
    return tuple(r[0] * centre[0] + r[1] * centre[1] + r[2] * centre[2] + r[3] for r in m), radius * abs(det) ** (1 / 3)


# ---------------------------------------------------------------- traces


def around(events: DataFrame, signal: DataFrame, keys: list[str], event: str, t: str, value: str, lags: list[float]) -> DataFrame:
    """A row for each event and lag: the signal at that time, null outside it."""
    at = events.select(*keys, event, F.col(t).alias("_e"), F.explode(F.array(*map(F.lit, lags))).alias("lag")).withColumn(t, F.col("_e") + F.col("lag"))
    return temporal.interp_join(at, signal, keys, t, value).select(*keys, event, "lag", value)


def bouts(rows: DataFrame, keys: list[str], bout: str, t: str, value: str) -> DataFrame:
    """Of each bout: least, largest and mean value, their range, its time, and the time of the lowest value (the first of equal ones)."""
    g = rows.where(F.col(value).isNotNull()).groupBy(*keys, bout)
    low = F.min(F.struct(F.col(value).alias("v"), F.col(t).alias("t")))
    return g.agg(F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), (F.max(value) - F.min(value)).alias("range"), (F.max(t) - F.min(t)).alias("lasts"), low["t"].alias("lowest_at"))


def ventiles(rows: DataFrame, keys: list[str], value: str, n: int = 20) -> DataFrame:
    """The n - 1 nearest-rank quantiles that part each key's values into n: `k` and `value`."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys)
    counts = counts.withColumn("_upto", F.sum("_n").over(w.orderBy(value))).withColumn("_all", F.sum("_n").over(w)).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n - 1))))
    rank = F.greatest(F.lit(1), F.least(F.col("_all"), F.round(F.col("k") * F.col("_all") / n).cast("long")))
    return counts.where(F.col("_upto") >= rank).groupBy(*keys, "k").agg(F.min(value).alias("value"))


def cycle_aligned(rows: DataFrame, keys: list[str], t: str, value: str, edges: DataFrame, bins: int) -> DataFrame:
    """Mean by cycle and equal part of it, cycles running from one edge of their key to the next: cycle (its start), bin, mean."""
    w = Window.partitionBy(*keys).orderBy(t)
    spans = edges.select(*keys, t).distinct().withColumn("end", F.lead(t).over(w)).where("end is not null")
    placed = temporal.asof_join(rows, spans, keys, t, ["end"]).where(F.col(t) < F.col("end"))
    part = F.floor((F.col(t) - F.col(f"{t}_right")) / (F.col("end") - F.col(f"{t}_right")) * bins).cast("long")
    return placed.groupBy(*keys, F.col(f"{t}_right").alias("cycle"), part.alias("bin")).agg(F.avg(value).alias("mean"))


def asymmetric_stats(rows: DataFrame, keys: list[str], value: str, rounds: int = 10) -> DataFrame:
    """Mean and deviation by key with values over mean + deviation held at that, again and again.

    Values are counted once and the rounds work on the counts; null and non-finite values are left out.  The last round takes
    its statistics after rounds - 1 cuts.
    """
    finite = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & (F.abs(F.col(value)) < float("inf")))
    v = finite.groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    w, v = Window.partitionBy(*keys), v.withColumn("_w", F.col("_v"))
    for i in range(rounds):  # one shuffle by key, and a pass over a key's distinct values for each round
        n, s = F.sum("_n").over(w), F.sum(F.col("_n") * F.col("_w")).over(w)
        v = v.withColumns({"_c": n, "_s": s, "_q": F.sum(F.col("_n") * F.col("_w") * F.col("_w")).over(w)})
        v = v.withColumn("mean", F.col("_s") / F.col("_c")).withColumn("sd", F.sqrt(F.greatest((F.col("_q") - F.col("_s") * F.col("mean")) / F.greatest(F.col("_c") - 1, F.lit(1)), F.lit(0.0))))
        if i + 1 < rounds:
            v = v.withColumn("_w", F.least("_w", F.col("mean") + F.col("sd")))
    return v.groupBy(*keys).agg(F.max("mean").alias("mean"), F.max("sd").alias("sd"))
