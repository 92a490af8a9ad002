"""Joins and windows on a clock: as-of, nearest and interpolating joins, islands, unwrapping, filling, smoothing.

Every function takes and returns DataFrames, shuffles once on its keys, and breaks ties by what the docstring says.
Missing values are null, never NaN.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _merged(left: DataFrame, right: DataFrame, keys: list[str], t: str, values: list[str]) -> DataFrame:
    """Rows of both sides on one clock: at equal times right rows come first."""
    knot = F.struct(F.col(t).alias("t"), *values).alias("_knot")
    side = right.select(*keys, F.col(t), knot).withColumn("_left", F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType))
    mine = left.select(*keys, F.col(t), F.lit(None).cast(side.schema["_knot"].dataType).alias("_knot"), F.struct(*left.columns).alias("_left"))
    return mine.unionByName(side).withColumn("_side", F.when(F.col("_left").isNull(), 0).otherwise(1))


def spanned(rows: DataFrame, t: str, spans: int, out: str = "_span") -> DataFrame:
    """rows with the equal part of the clock, from 0, that holds their time; a null time is in part 0."""
    ends = rows.agg(F.min(t).alias("a"), F.max(t).alias("b")).first()
    if ends["a"] is None or ends["a"] == ends["b"]:
        return rows.withColumn(out, F.lit(0))
    share = (F.col(t) - F.lit(ends["a"])) / (F.lit(ends["b"]) - F.lit(ends["a"]))
    return rows.withColumn(out, F.coalesce(F.least(F.floor(share * spans), F.lit(spans - 1)), F.lit(0)).cast("int"))


def _carried(rows: DataFrame, keys: list[str], t: str) -> DataFrame:
    """rows with `_before` and `_after`: the last knot of the spans before a row's own, and the first of those after it.

    A line for each key and span is all that goes to one task together.
    """
    knot = F.struct(F.col(t), "_knot")
    ends = rows.groupBy(*keys, "_span").agg(F.max(F.when(F.col("_knot").isNotNull(), knot))["_knot"].alias("_l"))
    same = rows.where(F.col("_knot").isNotNull()).groupBy(*keys, "_span", t).agg(F.max("_knot").alias("_k"))
    firsts = same.groupBy(*keys, "_span").agg(F.min_by("_k", t).alias("_first"))
    w = Window.partitionBy(*keys).orderBy("_span")
    on = lambda other: [F.col(k).eqNullSafe(other[f"_x{i}"]) for i, k in enumerate([*keys, "_span"])]
    renamed = lambda df: df.withColumnsRenamed({k: f"_x{i}" for i, k in enumerate([*keys, "_span"])})
    f = renamed(firsts)
    ends = ends.join(f, on(f), "left").drop(*(f"_x{i}" for i in range(len(keys) + 1)))
    ends = ends.select(*keys, "_span", F.last("_l", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.first("_first", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    e = renamed(ends)
    return rows.join(e, on(e), "left").drop(*(f"_x{i}" for i in range(len(keys) + 1)))


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], t: str, values: list[str], kind: str = "previous", spans: int | None = None) -> DataFrame:
    """left with the `values` and time (`<t>_right`) of the right row of the same keys that is previous, next or nearest.

    A right row at the same time matches either way; a tie of nearest goes to the later.  Left rows without a match, or without a
    time, keep nulls.  Of right rows with equal times that with the largest values counts.  Names of values must not be those of left.
    spans: into how many parts of the clock each key's rows are cut, so that one long recording is not one task's work; a
    part starts with the knots that the parts around it hand over.  By default one where there are keys, else as many as there
    are shuffle partitions.
    """
    rows = _merged(left, right, keys, t, values)
    spans = spans or (1 if keys else int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    part = list(keys)
    if spans > 1:
        rows, part = _carried(spanned(rows, t, spans), keys, t), [*keys, "_span"]
    w = Window.partitionBy(*part)
    back = F.last("_knot", ignorenulls=True).over(w.orderBy(F.col(t), F.col("_side"), F.col("_knot")).rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.last("_knot", ignorenulls=True).over(w.orderBy(F.col(t).desc(), F.col("_side"), F.col("_knot")).rowsBetween(Window.unboundedPreceding, 0))
    if spans > 1:
        back, ahead = F.coalesce(back, "_before"), F.coalesce(ahead, "_after")
    if kind == "previous":
        rows = rows.withColumn("_m", back)
    elif kind == "next":
        rows = rows.withColumn("_m", ahead)
    else:
        rows = rows.withColumn("_p", back).withColumn("_n", ahead)
        later = F.abs(F.col("_n.t") - F.col(t)) <= F.abs(F.col(t) - F.col("_p.t"))
        rows = rows.withColumn("_m", F.when(F.col("_p").isNull() | later, F.col("_n")).otherwise(F.col("_p")))
    rows = rows.withColumn("_m", F.when(F.col(t).isNotNull(), F.col("_m")))
    return rows.where("_side = 1").select("_left.*", F.col("_m.t").alias(f"{t}_right"), *(F.col(f"_m.{v}") for v in values))


def interp_join(left: DataFrame, right: DataFrame, keys: list[str], t: str, value: str, edge: str = "null") -> DataFrame:
    """left with `value` linearly interpolated between the right rows around it; edge: null, clamp, or extrap.

    Beyond the first or last right row: null, the end's value, or the line through the two at that end.
    """
    w = Window.partitionBy(*keys).orderBy(t)
    knots = right.select(*keys, t, value)
    if edge == "extrap":
        near = lambda k: F.struct(F.lag(t, k).over(w).alias("t"), F.lag(value, k).over(w).alias("v"))
        knots = knots.withColumn("_b", near(1)).withColumn("_a", near(-1))
        back = asof_join(left, knots.withColumnsRenamed({value: "_pv", "_b": "_pb"}).drop("_a"), keys, t, ["_pv", "_pb"], "previous").withColumnRenamed(f"{t}_right", "_pt")
        both = asof_join(back, knots.withColumnsRenamed({value: "_nv", "_a": "_na"}).drop("_b"), keys, t, ["_nv", "_na"], "next").withColumnRenamed(f"{t}_right", "_nt")
    else:
        back = asof_join(left, knots.withColumnRenamed(value, "_pv"), keys, t, ["_pv"], "previous").withColumnRenamed(f"{t}_right", "_pt")
        both = asof_join(back, knots.withColumnRenamed(value, "_nv"), keys, t, ["_nv"], "next").withColumnRenamed(f"{t}_right", "_nt")
    line = lambda t0, v0, t1, v1: v0 + (v1 - v0) * (F.col(t) - t0) / (t1 - t0)
    pt, pv, nt, nv = (F.col(x) for x in ("_pt", "_pv", "_nt", "_nv"))
    out = F.when(pt == nt, pv).when(pt.isNotNull() & nt.isNotNull(), line(pt, pv, nt, nv))
    if edge == "clamp":
        out = out.otherwise(F.coalesce(pv, nv))
    elif edge == "extrap":
        out = out.when(pt.isNotNull() & F.col("_pb.t").isNotNull(), line(F.col("_pb.t"), F.col("_pb.v"), pt, pv)).when(nt.isNotNull() & F.col("_na.t").isNotNull(), line(nt, nv, F.col("_na.t"), F.col("_na.v")))
    return both.select(*left.columns, out.alias(value))


def polar_interp(left: DataFrame, right: DataFrame, keys: list[str], t: str, angle: str) -> DataFrame:
    """left with `angle` interpolated over the circle: by its cosine and sine."""
    knots = right.withColumn("_c", F.cos(angle)).withColumn("_s", F.sin(angle))
    a = interp_join(left, knots, keys, t, "_c")
    b = interp_join(a, knots, keys, t, "_s")
    return b.withColumn(angle, F.atan2("_s", "_c")).drop("_c", "_s")


def frame_index(t: Column, start: float, width: float) -> Column:
    """Frame of a uniform grid, as an expression: no interval join."""
    return F.floor((t - F.lit(start)) / F.lit(width)).cast("long")


def frame_join(points: DataFrame, frames: DataFrame, keys: list[str], t: str, start: str, end: str, values: list[str]) -> DataFrame:
    """points with the frame [start, end) that holds them, frames not overlapping within keys; else nulls."""
    j = asof_join(points, frames.withColumn(t, F.col(start)), keys, t, [end, *values], "previous").drop(f"{t}_right")
    inside = F.col(t) < F.col(end)
    return j.select(*points.columns, *(F.when(inside, F.col(v)).alias(v) for v in values))


def unwrap_counter(df: DataFrame, keys: list[str], order: list[str], value: str, modulus: float, out: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    df = df.withColumn("_down", F.when(F.col(value) < F.lag(value).over(w), 1).otherwise(0))
    return df.withColumn(out, F.col(value) + F.lit(modulus) * F.sum("_down").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_down")


def unwrap_phase(df: DataFrame, keys: list[str], order: list[str], phase: str, out: str) -> DataFrame:
    """Jumps of more than pi are taken back by whole turns; a jump of exactly pi stays."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = F.col(phase) - F.lag(phase).over(w)
    df = df.withColumn("_turn", F.coalesce(F.when(F.abs(d) > math.pi, F.ceil((F.abs(d) - math.pi) / (2 * math.pi)) * F.signum(d)), F.lit(0.0)))
    return df.withColumn(out, F.col(phase) - 2 * math.pi * F.sum("_turn").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_turn")


def islands(df: DataFrame, keys: list[str], order: list[str], flag: str, least: int = 1) -> DataFrame:
    """One row for each run of rows whose flag is true: keys, island (from 1), first and last of the first order column, n."""
    w = Window.partitionBy(*keys).orderBy(*order)
    on = F.coalesce(F.col(flag), F.lit(False))
    df = df.withColumn("_start", F.when(on & ~F.coalesce(F.lag(on).over(w), F.lit(False)), 1).otherwise(0))
    df = df.withColumn("island", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))).where(on)
    return df.groupBy(*keys, "island").agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("n")).where(F.col("n") >= least)


def fill_forward(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, most: int | None = None) -> DataFrame:
    """The last value that is not null; over `most` rows later it is null again."""
    w = Window.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    filled = F.last(value, ignorenulls=True).over(upto)
    if most is None:
        return df.withColumn(out, filled)
    df = df.withColumn("_k", F.row_number().over(w)).withColumn("_at", F.last(F.when(F.col(value).isNotNull(), F.col("_k")), ignorenulls=True).over(upto))
    return df.withColumn(out, F.when(F.col("_k") - F.col("_at") <= most, filled)).drop("_k", "_at")


def dedupe_consecutive(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Rows that differ from the row before in one of the columns."""
    w = Window.partitionBy(*keys).orderBy(*order)
    row = F.struct(*columns)
    return df.withColumn("_same", row.eqNullSafe(F.lag(row).over(w)) & (F.row_number().over(w) > 1)).where(~F.col("_same")).drop("_same")


def gauss_kernel(sigma: float) -> list[tuple[int, float]]:
    """Offsets from floor(-3 sigma) to ceil(3 sigma) and normalised weights."""
    at = range(math.floor(-3 * sigma), math.ceil(3 * sigma) + 1)
    w = [math.exp(-(x**2) / (2 * sigma**2)) for x in at]
    return [(x, v / sum(w)) for x, v in zip(at, w, strict=True)]


def convolve(df: DataFrame, keys: list[str], order: list[str], value: str, kernel: list[tuple[int, float]], out: str) -> DataFrame:
    """sum of kernel(x) * value(k - x) over a series, ends continued by their first and last value."""
    w = Window.partitionBy(*keys).orderBy(*order)
    all_ = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.withColumn("_first", F.first(value).over(all_)).withColumn("_last", F.last(value).over(all_))
    term = lambda x: F.coalesce(F.lag(value, x).over(w), F.col("_first") if x > 0 else F.col("_last")) if x else F.col(value)
    total = sum((F.lit(v) * term(x) for x, v in kernel[1:]), F.lit(kernel[0][1]) * term(kernel[0][0]))
    return df.withColumn(out, total).drop("_first", "_last")


def gauss_smooth(df: DataFrame, keys: list[str], order: list[str], value: str, sigma: float, out: str) -> DataFrame:
    return convolve(df, keys, order, value, gauss_kernel(sigma), out)


def derivative(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Central difference per sample; ends reflected oddly, so that they get the one-sided difference."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before, after, v = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    return df.withColumn(out, (F.coalesce(after, 2 * v - before) - F.coalesce(before, 2 * v - after)) / 2)


def event_aligned(events: DataFrame, signal: DataFrame, keys: list[str], t: str, value: str, lags: list[float]) -> DataFrame:
    """Of each event and lag the signal interpolated at event time plus lag, averaged by lag."""
    at = events.select(*keys, F.col(t).alias("_event"), F.explode(F.array(*map(F.lit, lags))).alias("lag")).withColumn(t, F.col("_event") + F.col("lag"))
    return interp_join(at, signal, keys, t, value).groupBy("lag").agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
