"""Phases between tags, strides, extrema, still intervals and reports on clocks; all windows are partitioned by key."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import stats, temporal

TURN = 2 * math.pi


def tag_phase(points: DataFrame, tags: DataFrame, keys: list[str], t: str, out: str = "phase") -> DataFrame:
    """points with the time of the last tag (`<t>_right`) and the phase in its period, 0 to 2 pi.

    The period runs to the next tag; before the first tag and after the last one the phase is null.  Repeated tags count once.
    """
    w = Window.partitionBy(*keys).orderBy(t)
    periods = tags.select(*keys, t).distinct().withColumn("period", F.lead(t).over(w) - F.col(t))
    joined = temporal.asof_join(points, periods, keys, t, ["period"])
    return joined.withColumn(out, F.lit(TURN) * (F.col(t) - F.col(f"{t}_right")) / F.col("period")).drop("period")


def phase_aligned(points: DataFrame, keys: list[str], stride: str, phase: str, value: str, bins: int = 36) -> DataFrame:
    """Mean of each stride and phase bin, then over strides: bin, mean, strides.  Rows without phase or value are left out."""
    bin_ = F.least(F.lit(bins - 1), F.floor(F.col(phase) / F.lit(TURN) * bins)).cast("long")
    each = points.where(F.col(phase).isNotNull() & F.col(value).isNotNull()).groupBy(*keys, stride, bin_.alias("bin")).agg(F.avg(value).alias("m"))
    return each.groupBy("bin").agg(F.avg("m").alias("mean"), F.count("*").alias("strides"))


def subframes(points: DataFrame, frame: str, t: str, parts: int = 4) -> DataFrame:
    """points with `sub`, the equal part of the time its frame's points span; a frame of one time has part 0.

    The spans are one row a frame, so no window gathers a frame's points.
    """
    span = points.groupBy(frame).agg(F.min(t).alias("_a"), F.max(t).alias("_b"))
    part = F.floor(parts * (F.col(t) - F.col("_a")) / F.when(F.col("_b") > F.col("_a"), F.col("_b") - F.col("_a")))
    return points.join(span, frame).withColumn("sub", F.least(F.lit(parts - 1), F.coalesce(part, F.lit(0))).cast("long")).drop("_a", "_b")


def extrema(series: DataFrame, keys: list[str], t: str, value: str) -> DataFrame:
    """Rows that are above the one before and not below the next (`high`), or the reverse (`low`); ends are neither."""
    w = Window.partitionBy(*keys).orderBy(t)
    a, b, v = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    kind = F.when((v > a) & (v >= b), "high").when((v < a) & (v <= b), "low")
    return series.withColumn("kind", kind).where("kind is not null")


def alternating(found: DataFrame, keys: list[str], t: str, value: str) -> DataFrame:
    """Of neighbouring extrema of one kind the strongest, the first of equal ones."""
    w = Window.partitionBy(*keys).orderBy(t)
    new = F.when(F.col("kind").eqNullSafe(F.lag("kind").over(w)), 0).otherwise(1)
    run = found.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    strength = F.when(F.col("kind") == "high", F.col(value)).otherwise(-F.col(value))
    best = F.max_by(F.struct(t, value), F.struct(strength, -F.col(t)))
    return run.groupBy(*keys, "_run", "kind").agg(best.alias("_b")).select(*keys, "kind", f"_b.{t}", f"_b.{value}")


def last_where(series: DataFrame, keys: list[str], t: str, holds: Column, out: str) -> DataFrame:
    """The last time up to each row at which a condition held, else null."""
    w = Window.partitionBy(*keys).orderBy(t)
    return series.withColumn(out, F.last(F.when(holds, F.col(t)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def next_where(series: DataFrame, keys: list[str], t: str, holds: Column, out: str) -> DataFrame:
    """The first time after each row at which a condition holds, else null."""
    w = Window.partitionBy(*keys).orderBy(t)
    return series.withColumn(out, F.first(F.when(holds, F.col(t)), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))


def still_intervals(series: DataFrame, keys: list[str], t: str, value: str, share: float = 0.1, least: float = 0.5) -> DataFrame:
    """Runs whose speed is at most the key's `share` percentile and that last `least` or longer."""
    moving = temporal.derivative(series, keys, [t], value, "_d").withColumn("_speed", F.abs("_d"))
    slow = stats.nearest_rank_by(moving, keys, "_speed", share, "_slow")
    flagged = moving.join(slow, keys).withColumn("_still", F.col("_speed") <= F.col("_slow"))
    return temporal.islands(flagged, keys, [t], "_still").where(F.col("last") - F.col("first") >= least)


def longest_run(runs: DataFrame, keys: list[str]) -> DataFrame:
    """The longest of each key's islands, the first of equal ones."""
    return runs.groupBy(*keys).agg(F.max_by(F.struct("first", "last", "n"), F.struct("n", -F.col("island"))).alias("_b")).select(*keys, "_b.*")


def monotone(series: DataFrame, keys: list[str], order: list[str], value: str, out: str = "valid") -> DataFrame:
    """Whether a row is nowhere passed: not under any value before it, nor over any after it; null values are not valid."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before, after = F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.min(value).over(w.rowsBetween(0, Window.unboundedFollowing))
    return series.withColumn(out, F.coalesce((F.col(value) >= before) & (F.col(value) <= after), F.lit(False)))


def rolling_median(series: DataFrame, keys: list[str], order: list[str], value: str, reach: int, out: str) -> DataFrame:
    """Median of the rows up to `reach` away, fewer at the ends, nulls left out."""
    near = F.sort_array(F.collect_list(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(-reach, reach)))  # 2 reach + 1 values at most
    low, high = F.get(near, F.floor((F.size(near) - 1) / 2).cast("int")), F.get(near, F.floor(F.size(near) / 2).cast("int"))
    return series.withColumn(out, (low + high) / 2)


def step_report(series: DataFrame, keys: list[str], number: str, order: list[str]) -> DataFrame:
    """By key: rows, numbers that are skipped, and steps that do not go forward."""
    step = F.col(number) - F.lag(number).over(Window.partitionBy(*keys).orderBy(*order))
    return series.withColumn("_s", step).groupBy(*keys).agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.greatest(F.col("_s") - 1, F.lit(0))), F.lit(0)).cast("long").alias("skipped"), F.count_if(F.col("_s") <= 0).alias("back")
    )


PIECE = 1 << 12  # numbers that a gap's array holds at most


def missing_counters(seen: DataFrame, counter: str, spans: int | None = None) -> DataFrame:
    """Counters between the first and the last that no row has: each gap is filled where it is, part of the range by part."""
    each = seen.select(F.col(counter).cast("long").alias(counter)).where(F.col(counter).isNotNull()).distinct()
    spans = spans or int(seen.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = temporal.spanned(each, counter, spans)
    ends = each.groupBy("_span").agg(F.max(counter).alias("_last"))
    ends = ends.select(F.col("_span").alias("_s"), F.lag("_last").over(Window.orderBy("_span")).alias("_before"))  # a line a part
    rows = each.join(ends, F.col("_span") == F.col("_s")).withColumn("_p", F.coalesce(F.lag(counter).over(Window.partitionBy("_span").orderBy(counter)), "_before"))
    gaps = rows.where(F.col(counter) - F.col("_p") > 1).select((F.col("_p") + 1).alias("_a"), (F.col(counter) - 1).alias("_b"))
    # a long gap is cut, and its pieces are dealt out, before any array is made
    gaps = gaps.select("_a", "_b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_b") - F.col("_a")) / PIECE**2))).alias("_i")).select((F.col("_a") + F.col("_i") * PIECE**2).alias("_a"), "_b")
    gaps = gaps.select("_a", F.least("_b", F.col("_a") + PIECE**2 - 1).alias("_b")).repartition(spans)
    gaps = gaps.select("_a", "_b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_b") - F.col("_a")) / PIECE))).alias("_i")).select((F.col("_a") + F.col("_i") * PIECE).alias("_a"), "_b")
    return gaps.select(F.explode(F.sequence(F.col("_a"), F.least("_b", F.col("_a") + PIECE - 1))).alias(counter))


def strongest_two(events: DataFrame, t: str, value: str, tie: str, apart: float) -> DataFrame:
    """The strongest row and the strongest that is `apart` or more from it in time."""
    rank = [F.desc_nulls_last(value), F.asc(tie)]
    top = events.orderBy(*rank).limit(1)
    centre = top.select(F.col(t).alias("_t"))  # one row
    rest = events.join(F.broadcast(centre), F.abs(F.col(t) - F.col("_t")) >= apart).drop("_t").orderBy(*rank).limit(1)
    return top.unionByName(rest)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new, and those of old whose keys new does not have."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def polar_mean(angle: str) -> Column:
    """Direction of the mean unit vector."""
    return F.atan2(F.avg(F.sin(angle)), F.avg(F.cos(angle)))


def principal_angle(x: str, y: str) -> Column:
    """Direction of the larger axis of the second moments, from the x axis."""
    return 0.5 * F.atan2(2 * F.covar_pop(x, y), F.var_pop(x) - F.var_pop(y))
