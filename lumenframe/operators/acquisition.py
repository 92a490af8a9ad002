"""From raw streams to places: photons, dwell and scan positions of a recording on one clock.

A photon lies where the scanners are at its time: the galvo is interpolated between its timers, the AOD holds its last setting,
and the lens gives the depth by the phase between its tags.  Every look-up is a clock join; no row meets all knots.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import segments, temporal

TURN = 2 * math.pi
#: Mean depth weight of a sine; ticks a second; ticks of one counter; wrap of the counter.
DEPTH_MEAN, TICKS, COUNTER_TICKS, COUNTER_WRAP = 0.7846, 1.6e8, 2**28, 4096


# ---------------------------------------------------------------- ranges


def in_range(rows: DataFrame, t: str, start: float, end: float, buffer: float = 0.0) -> DataFrame:
    """Rows from start to end, both included, and `buffer` more on either side; the filter reaches the scan."""
    return rows.where(F.col(t).between(start - buffer, end + buffer))


def chunks_for(chunks: DataFrame, start: float, end: float, first: str = "t0", last: str = "t1") -> DataFrame:
    """Chunks whose time meets [start, end)."""
    return chunks.where((F.lit(start) < F.col(last)) & (F.lit(end) >= F.col(first)))


def common_range(timers: DataFrame, keys: list[str], t: str, start: float, end: float) -> DataFrame:
    """By key the part of [start, end] that its timers cover: t0 and t1; keys that have none of it go."""
    g = timers.groupBy(*keys).agg(F.greatest(F.min(t), F.lit(start)).alias("t0"), F.least(F.max(t), F.lit(end)).alias("t1"))
    return g.where(F.col("t0") <= F.col("t1"))


def sliced(rows: DataFrame, ranges: DataFrame, keys: list[str], t: str, margin: float = 0.0) -> DataFrame:
    """Rows within their key's range t0 to t1, `margin` more on either side."""
    near = rows.join(ranges.select(*keys, F.col("t0").alias("_a"), F.col("t1").alias("_b")), keys)
    return near.where(F.col(t).between(F.col("_a") - margin, F.col("_b") + margin)).drop("_a", "_b")


def of_colour(photons: DataFrame, colour: str, column: str = "color") -> DataFrame:
    """Photons of one colour, or of all for `a`."""
    return photons if colour == "a" else photons.where(F.col(column) == colour)


# ---------------------------------------------------------------- places


def located(photons: DataFrame, galvo: DataFrame, aod: DataFrame | None, keys: list[str], t: str, axes: list[str], offset: dict[str, float] | None = None) -> DataFrame:
    """photons with their place on each axis: galvo interpolated, plus the last AOD setting (0 before the first), minus the colour's offset.

    Outside the galvo's timers the place is null.
    """
    out = photons
    for a in axes:
        out = temporal.interp_join(out, galvo.select(*keys, t, F.col(a).alias(f"_g{a}")), keys, t, f"_g{a}")
    if aod is not None:
        out = temporal.asof_join(out, aod.select(*keys, t, *(F.col(a).alias(f"_o{a}") for a in axes)), keys, t, [f"_o{a}" for a in axes]).drop(f"{t}_right")
    shift = lambda a: F.coalesce(F.col(f"_o{a}"), F.lit(0.0)) if aod is not None else F.lit(0.0)
    place = {a: F.col(f"_g{a}") + shift(a) - (offset or {}).get(a, 0.0) for a in axes}
    return out.select(*photons.columns, *(v.alias(a) for a, v in place.items()))


def phase_corrected(points: DataFrame, correction: DataFrame, keys: list[str], t: str, phase: str, angle: str) -> DataFrame:
    """points whose phase is less the correction's angle at their time (interpolated over the circle), 0 to 2 pi; none: as it was."""
    j = temporal.polar_interp(points, correction.select(*keys, t, F.col(angle).alias("_phi")), keys, t, "_phi")
    return j.withColumn(phase, F.pmod(F.col(phase) - F.coalesce("_phi", F.lit(0.0)), F.lit(TURN))).drop("_phi")


def offset_removed(points: DataFrame, track: DataFrame, keys: list[str], t: str, axes: list[str]) -> DataFrame:
    """points less the tracked spot's place at their time: interpolated, its ends continued, 0 without a track."""
    out = points
    for a in axes:
        out = temporal.interp_join(out, track.select(*keys, t, F.col(a).alias(f"_k{a}")), keys, t, f"_k{a}", "clamp")
    return out.select(*[c for c in points.columns if c not in axes], *((F.col(a) - F.coalesce(F.col(f"_k{a}"), F.lit(0.0))).alias(a) for a in axes))


def scan_corrected(points: DataFrame, knots: DataFrame, keys: list[str], t: str, x: str = "x", y: str = "y") -> DataFrame:
    """points under the scan's affine map at their time: matrix a11 a12 a21 a22 of the nearest knot, shift b1 b2 interpolated."""
    m = ["a11", "a12", "a21", "a22"]
    out = temporal.asof_join(points, knots.select(*keys, t, *(F.col(c).alias(f"_{c}") for c in m)), keys, t, [f"_{c}" for c in m], "nearest").drop(f"{t}_right")
    for b in ("b1", "b2"):
        out = temporal.interp_join(out, knots.select(*keys, t, F.col(b).alias(f"_{b}")), keys, t, f"_{b}", "clamp")
    c = lambda n: F.col(f"_{n}")
    new = {x: c("a11") * F.col(x) + c("a12") * F.col(y) + c("b1"), y: c("a21") * F.col(x) + c("a22") * F.col(y) + c("b2")}
    return out.select(*[n for n in points.columns if n not in (x, y)], new[x].alias(x), new[y].alias(y))


def depth_weight(phase: Column) -> Column:
    """A photon's share of dwell at its depth."""
    return F.abs(F.sin(phase)) / DEPTH_MEAN


def depth(phase: Column, amplitude: float) -> Column:
    return F.lit(amplitude) * F.cos(phase)


def sheared(x: Column, z: Column, per_z: float) -> Column:
    """x moved by the depth's cross-talk."""
    return x + F.lit(per_z) * z


def phase_weight(points: DataFrame, table: DataFrame, phase: str, weight: str, spans: int | None = None) -> DataFrame:
    """points with the weight of their phase, interpolated in a table over the circle (its first knot comes again after a turn)."""
    first = table.orderBy(phase).limit(1).select((F.col(phase) + TURN).alias(phase), weight)
    last = table.orderBy(F.desc(phase)).limit(1).select((F.col(phase) - TURN).alias(phase), weight)
    return temporal.interp_join(points, table.select(phase, weight).unionByName(first).unionByName(last), [], phase, weight)


def in_window(x: Column, y: Column, z: Column, low: tuple, high: tuple, phase: Column | None = None, cosines: tuple[float, float] | None = None, radius: float | None = None) -> Column:
    """Inside a box, a range of the phase's cosine, and a circle about the z axis, as far as they are given."""
    out = x.between(low[0], high[0]) & y.between(low[1], high[1]) & z.between(low[2], high[2])
    if cosines is not None:
        out = out & F.cos(phase).between(*cosines)
    return out if radius is None else out & (x * x + y * y < radius * radius)


def clamped(a: Column, m: float) -> Column:
    """Within 1 / m and m."""
    return F.greatest(F.lit(1.0 / m), F.least(F.lit(float(m)), a))


def displaced(points: DataFrame, field: DataFrame, keys: list[str], voxel: list[str]) -> DataFrame:
    """points moved by the field of their voxel, x by ty, y by -tx and z by -tz; outside the field they stay."""
    j = points.join(field.select(*keys, *voxel, "tx", "ty", "tz"), [*keys, *voxel], "left")
    new = {"x": F.col("x") + F.coalesce("ty", F.lit(0.0)), "y": F.col("y") - F.coalesce("tx", F.lit(0.0)), "z": F.col("z") - F.coalesce("tz", F.lit(0.0))}
    return j.withColumns(new).drop("tx", "ty", "tz")


def snapped(low: Column, high: Column, start: float, width: float, n: int) -> tuple[Column, Column]:
    """A range widened to the grid's edges: the last at or before low, the first at or after high, within the grid."""
    edge = lambda k: F.lit(start) + F.lit(width) * F.least(F.greatest(k, F.lit(0)), F.lit(n))
    return edge(F.floor((low - start) / width + 1e-9)), edge(F.ceil((high - start) / width - 1e-9))


def regular_axis(values: list[float], centres: bool = False) -> tuple[float, float, int]:
    """(start, width, bins) of the uniform axis through sorted distinct edges, or half a step about centres."""
    v = sorted(set(values))
    if len(v) < 2:
        raise ValueError("an axis needs two different values")
    step = (v[-1] - v[0]) / (len(v) - 1)
    return (v[0] - step / 2, step, len(v)) if centres else (v[0], step, len(v) - 1)


def neuron_place(track: DataFrame, stage: DataFrame, keys: list[str], t: str, axes: list[str]) -> DataFrame:
    """track with `neuron_<axis>`: its own place less the stage's at its time, whose sign is the other way round."""
    out = track
    for a in axes:
        out = temporal.interp_join(out, stage.select(*keys, t, F.col(a).alias(f"_s{a}")), keys, t, f"_s{a}")
    return out.select(*track.columns, *((F.col(a) - F.col(f"_s{a}")).alias(f"neuron_{a}") for a in axes))


def pose_of_affine(m: tuple[Column, ...]) -> dict[str, Column]:
    """Angles of ry rx rz from a rotation's nine entries by rows."""
    m11, m12, m13, m21, m22, m23, m31, m32, m33 = m
    return {"ax": F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -m23))), "ay": F.atan2(m13, m33), "az": F.atan2(m21, m22)}


def pose_at(points: DataFrame, poses: DataFrame, keys: list[str], t: str, values: list[str]) -> DataFrame:
    """points with the pose that holds at their time: the last one set."""
    return temporal.asof_join(points, poses, keys, t, values).drop(f"{t}_right")


def pose_interpolated(times: DataFrame, poses: DataFrame, keys: list[str], t: str, angles: list[str], shifts: list[str]) -> DataFrame:
    """times with the pose between its neighbours: shifts on a line, angles over the circle, ends continued."""
    out = times
    for s in shifts:
        out = temporal.interp_join(out, poses, keys, t, s, "clamp")
    for a in angles:
        smooth = temporal.unwrap_phase(poses.select(*keys, t, a), keys, [t], a, "_u").select(*keys, t, "_u")
        out = temporal.interp_join(out, smooth, keys, t, "_u", "clamp").withColumn(a, F.pmod(F.col("_u") + math.pi, F.lit(TURN)) - math.pi).drop("_u")
    return out


# ---------------------------------------------------------------- dwell


def dwell_points(tags: DataFrame, keys: list[str], t: str, shares: tuple[float, ...] = (0.25, 0.75)) -> DataFrame:
    """Points at these shares of each period between tags, each with its part of the period as `dwell` and its `phase`."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(t)
    p = tags.select(*keys, t).distinct().withColumn("period", F.lead(t).over(w) - F.col(t)).where("period is not null")
    p = p.withColumn("_s", F.explode(F.array(*map(F.lit, shares))))
    return p.select(*keys, (F.col(t) + F.col("_s") * F.col("period")).alias(t), "period", (F.col("period") / len(shares)).alias("dwell"), (F.lit(TURN) * F.col("_s")).alias("phase"))


def dwell_sampled(tags: DataFrame, keys: list[str], t: str, k: int, seed: int = 1) -> DataFrame:
    """k points a period, each moved by up to a quarter of a step: by a hash of its tag and place, so that reruns agree."""
    p = dwell_points(tags, keys, t, tuple((i + 0.5) / k for i in range(k)))
    jitter = (F.pmod(F.xxhash64(F.lit(seed), *keys, F.round(F.col(t), 9)), F.lit(1 << 20)) / float(1 << 20) - 0.5) / 2 / k
    return p.withColumn(t, F.col(t) + jitter * F.col("period")).withColumn("phase", F.col("phase") + F.lit(TURN) * jitter)


def dwell_corrected(points: DataFrame, rate: DataFrame, keys: list[str], t: str, dwell: str, target: float) -> DataFrame:
    """points whose dwell is multiplied by the tracker's rate at their time over the target; as it was without a rate."""
    j = temporal.interp_join(points, rate.select(*keys, t, F.col("rate").alias("_r")), keys, t, "_r", "clamp")
    return j.withColumn(dwell, F.col(dwell) * F.coalesce(F.col("_r") / F.lit(target), F.lit(1.0))).drop("_r")


def scan_lag(score, lags: list[float], rounds: int = 12) -> float:
    """The lag of the largest score: a grid, then golden sections about the best; `score` runs one aggregation a call."""
    found = [(score(x), x) for x in lags]
    i = max(range(len(found)), key=lambda j: found[j][0])
    a, b = lags[max(0, i - 1)], lags[min(len(lags) - 1, i + 1)]
    ratio = (math.sqrt(5) - 1) / 2
    x, y = b - ratio * (b - a), a + ratio * (b - a)
    sx, sy = score(x), score(y)
    for _ in range(rounds):
        if sx >= sy:
            b, y, sy = y, x, sx
            x = b - ratio * (b - a)
            sx = score(x)
        else:
            a, x, sx = x, y, sy
            y = a + ratio * (b - a)
            sy = score(y)
    return max((found[i], (sx, x), (sy, y)))[1]


# ---------------------------------------------------------------- counts


def sharpness(volume: DataFrame, value: str) -> DataFrame:
    """Sum of squares and variance of a histogram's bins."""
    return volume.agg(F.sum(F.col(value) * F.col(value)).alias("squares"), F.var_samp(value).alias("variance"))


def phase_corrector(points: DataFrame, phase: str, bins: int, kernel: list[tuple[int, float]]) -> DataFrame:
    """bin, count and factor: the median of the circularly smoothed counts over the bin's own."""
    at = F.pmod(F.floor(F.col(phase) / TURN * bins), F.lit(bins)).cast("long")
    n = points.where(F.col(phase).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    n = points.sparkSession.range(bins).withColumnRenamed("id", "bin").join(n, "bin", "left").fillna(0, ["n"])
    steps = F.array(*(F.struct(F.lit(o).alias("o"), F.lit(w).alias("w")) for o, w in kernel))
    s = n.select("bin", "n", F.explode(steps).alias("k")).groupBy(F.pmod(F.col("bin") + F.col("k.o"), F.lit(bins)).alias("bin")).agg(F.sum(F.col("n") * F.col("k.w")).alias("smooth"))
    mid = s.agg(F.median("smooth").alias("_m"))  # one row
    return n.join(s, "bin").crossJoin(F.broadcast(mid)).select("bin", "n", F.when(F.col("smooth") > 0, F.col("_m") / F.col("smooth")).alias("factor"))


def rest_epochs(stage: DataFrame, photons: DataFrame, keys: list[str], t: str, axes: list[str], flag: str) -> DataFrame:
    """Runs of rest with the stage's mean place and the photons in them: keys, island, first, last, means and n."""
    runs = temporal.islands(stage, keys, [t], flag).select(*keys, "island", "first", "last")
    at = runs.select(*keys, F.col("first").alias(t), "last", "island")
    placed = temporal.asof_join(stage, at, keys, t, ["last", "island"]).drop(f"{t}_right").where(F.col(t) <= F.col("last"))
    mean = placed.groupBy(*keys, "island").agg(*(F.avg(a).alias(a) for a in axes))
    near = temporal.asof_join(photons.select(*keys, t), at, keys, t, ["last", "island"]).drop(f"{t}_right").where(F.col(t) <= F.col("last"))
    counted = near.groupBy(*keys, "island").agg(F.count("*").alias("n"))
    return runs.join(mean, [*keys, "island"], "left").join(counted, [*keys, "island"], "left").fillna(0, ["n"])


def binned_counts(photons: DataFrame, keys: list[str], t: str, width: float, counts: list[str]) -> DataFrame:
    """Sums of counts in bins of time, and the last time in each."""
    return photons.groupBy(*keys, F.floor(F.col(t) / width).cast("long").alias("bin")).agg(*(F.sum(x).alias(x) for x in counts), F.max(t).alias("last"))


def tracking_range(frames: DataFrame, tracked: DataFrame, keys: list[str], start: str, end: str, t: str) -> DataFrame:
    """By key the time that frames and tracked samples share: t0 and t1."""
    f = frames.groupBy(*keys).agg(F.min(start).alias("_a"), F.max(end).alias("_b"))
    g = tracked.groupBy(*keys).agg(F.min(t).alias("_c"), F.max(t).alias("_d"))
    return f.join(g, keys).select(*keys, F.greatest("_a", "_c").alias("t0"), F.least("_b", "_d").alias("t1"))


def stage_table(encoder: DataFrame, keys: list[str], t: str, axes: list[str], still: float) -> DataFrame:
    """encoder with `speed`, by central differences over the true times, and `resting`: slower than `still`."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(t)
    dt = F.coalesce(F.lead(t).over(w), F.col(t)) - F.coalesce(F.lag(t).over(w), F.col(t))
    d = [F.coalesce(F.lead(a).over(w), F.col(a)) - F.coalesce(F.lag(a).over(w), F.col(a)) for a in axes]
    speed = F.sqrt(sum((x * x for x in d[1:]), d[0] * d[0])) / F.when(dt > 0, dt)
    return encoder.withColumn("speed", speed).withColumn("resting", F.coalesce(F.col("speed") < still, F.lit(False)))


def sigma_of_bandwidth(hertz: float, dt: float) -> float:
    """Width, in samples, of the Gaussian filter with this bandwidth."""
    return 1 / (7.3 * hertz * dt)


def decimated(series: DataFrame, keys: list[str], order: list[str], value: str, sigma: float = 1.0) -> DataFrame:
    """Every second sample of the smoothed series, from the first."""
    from pyspark.sql import Window

    smooth = temporal.gauss_smooth(series, keys, order, value, sigma, "_v")
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) % 2 == 1
    return smooth.withColumn("_k", at).where("_k").withColumn(value, F.col("_v")).drop("_k", "_v")


def phased(points: DataFrame, tags: DataFrame, keys: list[str], t: str) -> DataFrame:
    """points with phase and period of the lens."""
    return segments.tag_phase(points, tags, keys, t)
