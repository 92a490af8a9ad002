"""Statistics with the ranks and ties that the analyses rely on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


BINS = 1024


def at_places(df: DataFrame, keys: list[str], value: str, places: dict[str, Column], rounds: int = 2) -> DataFrame:
    """keys, `_n`, the number of values that are not null, and of each place (a column of `_n`, from 1, held within 1 and `_n`) the value there in order.

    No key is sorted in one task: each round counts the values in BINS equal bins between the least and the greatest that are left and goes on
    with the bin that holds the place, which two rounds make a millionth of the range; equal values there are one row.  nan is not a value.
    """
    from functools import reduce

    from pyspark.sql import Window

    v = F.col(value).cast("double")
    some = df.where(F.col(value).isNotNull() & ~F.isnan(v)).select(*keys, F.col(value).alias("_value"), v.alias("_v"))
    spans = some.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    k = [F.struct(F.lit(name).alias("_name"), F.greatest(F.lit(1), F.least(F.col("_n"), p.cast("long"))).alias("_k")) for name, p in places.items()]
    # of each key and place: the range that holds it, and its place in there
    left = spans.select(*keys, "_n", "_low", "_high", F.inline(F.array(*k)))
    hit = lambda t, what: t.join(what, keys) if keys else t.join(F.broadcast(what), how="cross")  # noqa: E731  (a row a place)
    inside = F.col("_v").between(F.col("_low"), F.col("_high"))
    cell = F.least(F.lit(BINS - 1), F.floor(F.coalesce(F.try_divide(F.col("_v") - F.col("_low"), F.col("_high") - F.col("_low")), F.lit(0.0)) * BINS)).cast("int")
    for _ in range(rounds):
        cells = hit(some, left).where(inside).groupBy(*keys, "_name", cell.alias("_cell")).agg(F.count("*").alias("_c"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
        w = Window.partitionBy(*keys, "_name").orderBy("_cell")  # BINS rows at most
        cells = cells.withColumn("_before", F.sum("_c").over(w) - F.col("_c"))
        both = cells.join(left.select(*keys, "_name", "_n", "_k"), [*keys, "_name"]).where((F.col("_before") < F.col("_k")) & (F.col("_k") <= F.col("_before") + F.col("_c")))
        left = both.select(*keys, "_n", F.col("_a").alias("_low"), F.col("_b").alias("_high"), "_name", (F.col("_k") - F.col("_before")).alias("_k"))
    same = hit(some, left).where(inside).groupBy(*keys, "_name", "_n", "_k", "_value").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys, "_name").orderBy("_value")
    found = same.withColumn("_upto", F.sum("_c").over(w)).where(F.col("_upto") >= F.col("_k")).groupBy(*keys, "_name", "_n").agg(F.min("_value").alias("_value"))
    each = [found.where(F.col("_name") == name).select(*keys, "_n", F.col("_value").alias(name)) for name in places]
    return reduce(lambda a, b: a.join(b, [*keys, "_n"]), each)


def nearest_rank_by(df: DataFrame, keys: list[str], value: str, p: float, out: str) -> DataFrame:
    """The value at rank round(p n), held within 1 and n, of the values that are not null."""
    return at_places(df, keys, value, {out: F.round(F.lit(p) * F.col("_n"))}).drop("_n")


def hazen(df: DataFrame, keys: list[str], value: str, p: float, out: str) -> DataFrame:
    """Percentile with knots at (k - 0.5) / n and straight lines between them, clamped at the ends."""
    x = F.greatest(F.lit(1.0), F.least(F.col("_n").cast("double"), F.lit(p) * F.col("_n") + 0.5))
    got = at_places(df, keys, value, {"_lower": F.floor(x), "_upper": F.floor(x) + 1})
    part = x - F.floor(x)
    return got.select(*keys, ((1 - part) * F.col("_lower") + part * F.col("_upper")).alias(out))


def mode_smallest(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """The commonest value; of equally common ones the smallest."""
    n = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return n.groupBy(*keys).agg(F.max(F.struct(F.col("_n"), (-F.col(value)).alias("v")))["v"].alias("_v")).withColumn(out, -F.col("_v")).drop("_v")


def binned_stats(df: DataFrame, x: str, y: str, start: float, width: float, n: int) -> DataFrame:
    """Of y in half-open bins of x: mean x, mean, standard deviation and error, sum and count."""
    b = F.floor((F.col(x) - start) / width).cast("long")
    g = df.where(F.col(y).isNotNull()).withColumn("bin", b).where(F.col("bin").between(0, n - 1)).groupBy("bin")
    sd = F.stddev_samp(y)
    return g.agg(F.avg(x).alias("x"), F.avg(y).alias("mean"), sd.alias("sd"), (sd / F.sqrt(F.count(y))).alias("se"), F.sum(y).alias("total"), F.count(y).alias("n"))


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """In bits, of two discrete columns; rows with a null are left out."""
    joint = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    h = lambda g, name: g.agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias(name))
    one = h(joint, "ab").crossJoin(h(joint.groupBy("a").agg(F.sum("n").alias("n")), "ha")).crossJoin(h(joint.groupBy("b").agg(F.sum("n").alias("n")), "hb"))  # one row each
    return one.select((F.col("ha") + F.col("hb") - F.col("ab")).alias("bits"))


def leave_one_out_mean(value: str, w) -> Column:
    """Mean of the others in a window frame."""
    n = F.count(value).over(w)
    return F.when(n > 1, (F.sum(value).over(w) - F.col(value)) / (n - 1))
