"""Sets, joins by value, samples, flags and events around a row: small relational operators on recordings.

Nulls never match in joins here; ties are broken as the docstrings say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import temporal

# ---------------------------------------------------------------- joins and sets


def present(df: DataFrame, among: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of df whose keys occur in `among`."""
    return df.join(among.select(*keys).distinct(), keys, "left_semi")


def sides(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of either side with `in_a` and `in_b`: their union; both true is the intersection, one the differences."""
    both = a.select(*keys).distinct().withColumn("_a", F.lit(True)).unionByName(b.select(*keys).distinct().withColumn("_b", F.lit(True)), allowMissingColumns=True)
    return both.groupBy(*keys).agg(F.coalesce(F.bool_or("_a"), F.lit(False)).alias("in_a"), F.coalesce(F.bool_or("_b"), F.lit(False)).alias("in_b"))


def common_places(a: DataFrame, b: DataFrame, key: str, place: str) -> DataFrame:
    """Values that both sides have, each with its first place on either side: key, place_a, place_b."""
    first = lambda df, out: df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(place).alias(out))
    return first(a, f"{place}_a").join(first(b, f"{place}_b"), key)


def first_last(df: DataFrame, value: str, place: str) -> DataFrame:
    """Distinct values with their first and last place and their number."""
    return df.groupBy(value).agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n"))


def nearest_row(queries: DataFrame, rows: DataFrame, keys: list[str], t: str, columns: list[str]) -> DataFrame:
    """For each query the row of its keys whose time is nearest (the later of two as near); one clock join, no pairs."""
    return temporal.asof_join(queries, rows, keys, t, columns, "nearest")


def k_nearest(queries: DataFrame, rows: DataFrame, keys: list[str], t: str, tie: str, k: int) -> DataFrame:
    """The k rows nearest in time to each query, of its keys: query columns, `<t>_row`, tie and `place` from 1.

    On one clock the k nearest are among the k rows before and the k after; these are gathered by one window each.
    """
    row = F.struct(F.col(t).alias("t"), F.col(tie).alias("tie"))
    side = rows.select(*keys, F.col(t), row.alias("_row"))
    mine = queries.select(*keys, F.col(t), F.struct(*queries.columns).alias("_q"))
    both = mine.unionByName(side, allowMissingColumns=True).withColumn("_o", F.when(F.col("_q").isNull(), 0).otherwise(1))
    w = Window.partitionBy(*keys)
    both = both.withColumn("_n", F.count("_row").over(w.orderBy(t, "_o", "_row").rowsBetween(Window.unboundedPreceding, 0)))
    asked = both.where("_o = 1").select("_q", F.explode(F.sequence(F.col("_n") - k + 1, F.col("_n") + k)).alias("_n"))
    named = both.where("_o = 0").select(*[F.col(x).alias(f"_{x}") for x in keys], "_n", "_row")
    on = [F.col(f"_q.{x}") == F.col(f"_{x}") for x in keys]
    cand = asked.join(named, "_n").where(_all(on)) if not keys else asked.join(named, [asked["_n"] == named["_n"], *on])
    near = F.abs(F.col("_row.t") - F.col(f"_q.{t}"))
    best = F.slice(F.array_sort(F.collect_list(F.struct(near.alias("d"), F.col("_row.t").alias("t"), F.col("_row.tie").alias("tie")))), 1, k)  # 2 k at most
    out = cand.groupBy("_q").agg(best.alias("_b")).select("_q.*", F.posexplode("_b").alias("place", "_b"))
    return out.select(*queries.columns, F.col("_b.t").alias(f"{t}_row"), F.col("_b.tie").alias(tie), (F.col("place") + 1).alias("place"))


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for x in conditions:
        out = out & x
    return out


def looked_up(df: DataFrame, table: DataFrame, keys: list[str], values: list[str], default: float | None = None) -> DataFrame:
    """df with the values of the table's row of the same indices; outside the table the default."""
    out = df.join(table.select(*keys, *values), keys, "left")
    return out if default is None else out.fillna(default, values)


def mask_on_clock(times: DataFrame, mask: DataFrame, keys: list[str], t: str, flag: str, how: str = "nearest") -> DataFrame:
    """A boolean series brought to another clock: by the nearest sample, or true where the samples on both sides are."""
    if how == "nearest":
        return temporal.asof_join(times, mask, keys, t, [flag], "nearest").drop(f"{t}_right")
    before = temporal.asof_join(times, mask.withColumnRenamed(flag, "_p"), keys, t, ["_p"], "previous").drop(f"{t}_right")
    both = temporal.asof_join(before, mask.withColumnRenamed(flag, "_n"), keys, t, ["_n"], "next").drop(f"{t}_right")
    return both.withColumn(flag, F.coalesce(F.col("_p") & F.col("_n"), F.lit(False))).drop("_p", "_n")


def merged(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Columns of both tables on shared keys; where both have a column, the right one's value counts."""
    new = [x for x in right.columns if x not in left.columns]
    shared = [x for x in right.columns if x in left.columns and x not in keys]
    r = right.select(*keys, *new, *(F.col(x).alias(f"_r_{x}") for x in shared), F.lit(True).alias("_r"))
    out = left.join(r, keys, "left")
    return out.select(*keys, *(F.when(F.col("_r"), F.col(f"_r_{x}")).otherwise(F.col(x)).alias(x) if x in shared else F.col(x) for x in left.columns if x not in keys), *new)


def stacked(*parts: DataFrame) -> DataFrame:
    """All rows of results that may lack some of the others' columns."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def mask_union(masks: DataFrame, voxel: list[str], sets: str) -> DataFrame:
    """Voxels of any mask of a set, each once."""
    return masks.select(sets, *voxel).distinct()


# ---------------------------------------------------------------- order, limits and samples


def top(df: DataFrame, metric: str, n: int, tie: str) -> DataFrame:
    """The n rows of the largest metric, nulls last, ties by the smaller `tie`: each task keeps n."""
    return df.orderBy(F.desc_nulls_last(metric), F.asc(tie)).limit(n)


def nth_value(df: DataFrame, keys: list[str], value: str, n: int, out: str) -> DataFrame:
    """The n-th largest value of each key, equal values counted each; the smallest where there are fewer."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_k"))
    counts = counts.withColumn("_upto", F.sum("_k").over(Window.partitionBy(*keys).orderBy(F.desc(value))))
    return counts.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("_upto") >= n, F.col(value))), F.min(value)).alias(out))


def evenly(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """n rows of each key at even steps from its first to its last, both included; all where there are fewer."""
    w = Window.partitionBy(*keys)
    rows = df.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_m", F.count("*").over(w) - 1)
    if n == 1:
        return rows.where("_i = 0").drop("_i", "_m")
    k = F.round(F.col("_i") * (n - 1) / F.greatest(F.col("_m"), F.lit(1)))  # the step that lands on this row, if one does
    return rows.where((F.col("_m") < n) | (F.round(k * F.col("_m") / (n - 1)) == F.col("_i"))).drop("_i", "_m")


def share(df: DataFrame, keys: list[str], fraction: float, seed: int = 1) -> DataFrame:
    """A part of the rows, by a hash of their keys: the same rows on every run and in every order."""
    return df.where(F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 30)) < int(fraction * (1 << 30)))


def spread_peaks(peaks: DataFrame, keys: list[str], t: str, height: str, apart: float, most: int | None = None) -> DataFrame:
    """Peaks of which none has a higher one within `apart` (the earlier of equal ones), `most` highest of each key at most.

    A peak beaten by a neighbour goes even if that neighbour goes too: one window, whatever the order.
    """
    w = Window.partitionBy(*keys).orderBy(t).rangeBetween(-apart, apart)
    best = F.max(F.struct(F.col(height).alias("h"), (-F.col(t)).alias("m"))).over(w)
    kept = peaks.withColumn("_b", best).where((F.col("_b.h") == F.col(height)) & (F.col("_b.m") == -F.col(t))).drop("_b")
    if most is None:
        return kept
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(height), t))
    return kept.withColumn("_r", r).where(F.col("_r") <= most).drop("_r")


def greedy_peaks(peaks: DataFrame, keys: list[str], t: str, height: str, apart: float, most: int | None = None, span: int = 64) -> DataFrame:
    """Peaks as they are left when the highest (the earliest of equal ones) takes all others within `apart` off, then the next, and so on;
    `most` highest of each key at most.  Rows with a null time or height, or of equal time and height but one, are left out.

    Rounds, not an order: in each, every peak that is the highest of those still open around it stays, and what is within reach of one that
    stays goes.  A round is two windows over parts of the time of `span` reaches, with halos, so a key is as many tasks as it has parts;
    there are as many rounds as the longest chain of peaks each higher than the one before, some tens in random data.
    """
    from ..functions.shared import kept

    some = peaks.where(F.col(t).isNotNull() & F.col(height).isNotNull()).dropDuplicates([*keys, t, height])
    state = kept(some.withColumn("_stays", F.lit(None).cast("boolean")))
    part = F.floor(F.col(t) / (span * apart))
    order = F.struct(F.col(height).alias("h"), (-F.col(t)).alias("m"))
    reach, along = (int(apart), F.col(t)) if float(apart).is_integer() else (1, F.col(t) / apart)  # frames are of whole numbers

    def around(what, name):
        """state with the greatest of `what` within reach of each row; halos are other parts' rows."""
        cut = state.withColumn("_part", F.explode(F.array_distinct(F.array(F.floor((F.col(t) - apart) / (span * apart)), part, F.floor((F.col(t) + apart) / (span * apart))))))
        w = Window.partitionBy(*keys, "_part").orderBy(along).rangeBetween(-reach, reach)
        return cut.withColumn(name, F.max(what).over(w)).where(F.col("_part") == part).drop("_part")

    while not state.where("_stays is null").isEmpty():
        state = around(F.when(F.col("_stays").isNull(), order), "_best")
        wins = F.col("_stays").isNull() & (F.col("_best") == order)
        state = state.withColumn("_wins", wins).drop("_best")
        state = around(F.col("_wins"), "_near")
        state = kept(state.withColumn("_stays", F.when(F.col("_wins"), True).when(F.col("_stays").isNull() & F.col("_near"), False).otherwise(F.col("_stays"))).drop("_wins", "_near"))
    out = state.where("_stays").drop("_stays")
    if most is None:
        return out
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(height), t))
    return out.withColumn("_r", r).where(F.col("_r") <= most).drop("_r")


# ---------------------------------------------------------------- flags of frames


def set_flags(flags: DataFrame, frame: int, states: dict[str, bool]) -> DataFrame:
    """(frame, state, on) rows in which the named states of a frame are as given; other rows as they were."""
    rows = [(frame, s, v) for s, v in states.items()]
    new = flags.sparkSession.createDataFrame(rows, flags.select("frame", "state", "on").schema)
    return flags.join(new.select("frame", "state"), ["frame", "state"], "left_anti").unionByName(new)


def flags_of(flags: DataFrame) -> DataFrame:
    """Of each frame the sorted states that are on."""
    return flags.groupBy("frame").agg(F.array_sort(F.collect_set(F.when(F.col("on"), F.col("state")))).alias("states"))


def set_length(flags: DataFrame, n: int) -> DataFrame:
    """Frames 0 to n - 1 for every state: further ones cut off, missing ones false."""
    states = flags.select("state").distinct()  # a handful of names
    grid = flags.sparkSession.range(n).withColumnRenamed("id", "frame").crossJoin(F.broadcast(states))
    known = flags.groupBy("frame", "state").agg(F.bool_or("on").alias("on"))
    return grid.join(known, ["frame", "state"], "left").fillna(False, ["on"])


def with_states(flags: DataFrame, names: list[str]) -> DataFrame:
    """The rows, and a false one of each frame for each named state that no frame has."""
    have = flags.select("state").distinct()
    new = flags.sparkSession.createDataFrame([(x,) for x in names], "state string").join(have, "state", "left_anti")
    return flags.unionByName(flags.select("frame").distinct().crossJoin(F.broadcast(new)).select("frame", "state", F.lit(False).alias("on")))


def heading_label(along: Column, speed: Column, least: float) -> Column:
    """1 forwards, 2 backwards, else 0: within 45 degrees of the heading, at `least` speed or faster.  along: cosine to the heading."""
    quick = F.abs(speed) >= least
    return F.when(quick & (along > 0.5**0.5), 1).when(quick & (along < -(0.5**0.5)), 2).otherwise(0)


def labelled_ranges(points: DataFrame, ranges: DataFrame, keys: list[str], t: str, start: str, end: str, label: str) -> DataFrame:
    """points with the label of the range [start, end] that holds them; ranges of a key do not overlap; else null."""
    j = temporal.asof_join(points, ranges.select(*keys, F.col(start).alias(t), end, label), keys, t, [end, label]).drop(f"{t}_right")
    return j.withColumn(label, F.when(F.col(t) <= F.col(end), F.col(label))).drop(end)


# ---------------------------------------------------------------- around events


def around_events(rows: DataFrame, keys: list[str], order: list[str], t: str, event: Column) -> DataFrame:
    """rows with `since` and `until`: time from the last event (own included) and to the next one after; null without one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    last = F.last(F.when(event, F.col(t)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    next_ = F.first(F.when(event, F.col(t)), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return rows.withColumn("since", F.col(t) - last).withColumn("until", next_ - F.col(t))


def run_places(rows: DataFrame, keys: list[str], order: list[str], kind: str) -> DataFrame:
    """rows with their place in the run of equal kinds from its start and its end (from 1), and the kinds before and after the run."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = F.when(F.col(kind).eqNullSafe(F.lag(kind).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    runs = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    one = Window.partitionBy(*keys, "_run")
    runs = runs.withColumn("from_start", F.row_number().over(one.orderBy(*order))).withColumn("from_end", F.count("*").over(one) - F.col("from_start") + 1)
    edges = runs.withColumn("_p", F.lag(kind).over(w)).withColumn("_n", F.lead(kind).over(w))
    return edges.withColumn("before", F.max(F.when(F.col("from_start") == 1, F.col("_p"))).over(one)).withColumn("after", F.max(F.when(F.col("from_end") == 1, F.col("_n"))).over(one)).drop("_new", "_run", "_p", "_n")


def nearest_event(times: DataFrame, events: DataFrame, keys: list[str], t: str, event: str) -> DataFrame:
    """Each time with the event that is nearest to it, and the time from that event."""
    j = temporal.asof_join(times, events, keys, t, [event], "nearest")
    return j.withColumn("offset", F.col(t) - F.col(f"{t}_right")).drop(f"{t}_right")


def slowest_window(series: DataFrame, keys: list[str], t: str, value: str, n: int) -> DataFrame:
    """Of each key the window of n samples with the least sum of squares: first and last time, and the sum; the earliest of equal ones."""
    w = Window.partitionBy(*keys).orderBy(t).rowsBetween(0, n - 1)
    rows = series.withColumn("_s", F.sum(F.col(value) * F.col(value)).over(w)).withColumn("_n", F.count(value).over(w)).withColumn("_e", F.max(t).over(w)).where(F.col("_n") == n)
    return rows.groupBy(*keys).agg(F.min(F.struct(F.col("_s").alias("total"), F.col(t).alias("first"), F.col("_e").alias("last"))).alias("_b")).select(*keys, "_b.first", "_b.last", "_b.total")


def certainty(rows: DataFrame, keys: list[str], order: list[str], ahead: str, behind: str, most: int) -> DataFrame:
    """rows with `state`: 1 where only `ahead` holds, -1 where only `behind` does, null where neither or both; gaps of at most
    `most` rows between equal states are filled with that state."""
    plain = F.when(F.col(ahead) & ~F.col(behind), 1).when(F.col(behind) & ~F.col(ahead), -1)
    w = Window.partitionBy(*keys).orderBy(*order)
    r = rows.withColumn("_s", plain).withColumn("_i", F.row_number().over(w))
    known = F.when(F.col("_s").isNotNull(), F.struct("_i", "_s"))
    r = r.withColumn("_p", F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    fill = (F.col("_p._s") == F.col("_n._s")) & (F.col("_n._i") - F.col("_p._i") - 1 <= most)
    return r.withColumn("state", F.coalesce("_s", F.when(fill, F.col("_p._s")))).drop("_s", "_i", "_p", "_n")


def three_frames(volume: DataFrame, frame: str, voxel: list[str], value: str, weights: tuple[float, float, float] = (0.25, 0.5, 0.25), by: list[str] | None = None) -> DataFrame:
    """Each frame's voxels blurred with the frames before and after: a voxel goes out to three frames and is summed there."""
    out = volume.select(*(by or []), *voxel, value, F.explode(F.array(*(F.struct((F.col(frame) + o).alias("f"), F.lit(w).alias("w")) for o, w in zip((1, 0, -1), weights, strict=True)))).alias("_x"))
    blurred = out.groupBy(*(by or []), F.col("_x.f").alias(frame), *voxel).agg(F.sum(F.col(value) * F.col("_x.w")).alias(value))
    return blurred.join(volume.select(*(by or []), frame).distinct(), [*(by or []), frame], "left_semi")


def clipped(intervals: DataFrame, start: str, end: str, low, high) -> DataFrame:
    """Intervals that meet [low, high], cut to it."""
    inside = intervals.where((F.col(end) >= low) & (F.col(start) <= high))
    return inside.withColumn(start, F.greatest(F.col(start), F.lit(low))).withColumn(end, F.least(F.col(end), F.lit(high)))
