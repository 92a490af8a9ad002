"""Event, counter and place logs, and what the settings imply."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import temporal
from . import readers

# Codes of the event log.
COMMANDS = {0: "none", 1: "start", 2: "stop", 3: "stim", 4: "move", 5: "camera_flash", 6: "track", 7: "untrack"}


def counter_log(rows: DataFrame, keys: list[str], order: list[str], counter: str, sums: list[str]) -> DataFrame:
    """Of a log of running sums one row for each time the counter changed: its step and the sums' steps since the last change, and
    `steady`: the counter rose by one and no sum fell."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = rows.withColumn("_p", F.lag(counter).over(w)).where(F.col("_p").isNull() | (F.col("_p") != F.col(counter)))
    step = lambda c: F.col(c) - F.lag(c).over(w)
    out = changed.withColumns({f"{c}_step": step(c) for c in [counter, *sums]})
    ok = F.col(f"{counter}_step") == 1
    for c in sums:
        ok = ok & (F.col(f"{c}_step") >= 0)
    return out.withColumn("steady", F.coalesce(ok, F.lit(False))).drop("_p")


def commands(log: DataFrame, names: dict[int, str] | None = None) -> DataFrame:
    """log with `command`, its code's name; codes without one have null.  The table of names is a literal of a few entries."""
    pairs = [x for k, v in (names or COMMANDS).items() for x in (F.lit(k), F.lit(v))]
    return log.withColumn("command", F.try_element_at(F.create_map(*pairs), F.col("code").cast("int")))


def command_times(log: DataFrame, t: str) -> DataFrame:
    """A row for each time of each command: command, its place from 0 by time, and the time; all of them, however many.

    Places are counted in days first, so that a command's times are not one task's.
    """
    day = F.floor(F.col(t) / 86400)
    some = log.where(F.col("command").isNotNull() & F.col(t).isNotNull()).withColumn("_day", day)
    days = some.groupBy("command", "_day").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("command").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")  # a row a day
    own = F.row_number().over(Window.partitionBy("command", "_day").orderBy(t)) - 1
    return some.withColumn("_own", own).join(days, ["command", "_day"]).select("command", (F.col("_before") + F.col("_own")).alias("place"), t)


def command_summary(log: DataFrame, t: str, most: int = 1000) -> DataFrame:
    """Of each command how often it came, first and last time, and a line of text with its first times (`most` at the most; `command_times` has all)."""
    r = F.row_number().over(Window.partitionBy("command").orderBy(t))
    g = log.where("command is not null").withColumn("_r", r).groupBy("command")
    times = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_r") <= most, F.col(t)))), lambda x: x.cast("string")), " ")
    return g.agg(F.count("*").alias("n"), F.min(t).alias("first"), F.max(t).alias("last"), times.alias("times")).withColumn("line", F.format_string("%s: %d, from %s to %s", "command", "n", F.col("first").cast("string"), F.col("last").cast("string")))


def level_at(times: DataFrame, log: DataFrame, keys: list[str], t: str, command: str, value: str) -> DataFrame:
    """times with the level that a command's last row set: a step function; null before the first."""
    return temporal.asof_join(times, log.where(F.col("command") == command).select(*keys, t, value), keys, t, [value]).drop(f"{t}_right")


def places(spark: SparkSession, path: str, clicked: bool = False) -> DataFrame:
    """Head or tail places: frame, x, y and, where they are marked by hand, `clicked`."""
    return spark.read.csv(path, header=True, schema="frame long, x double, y double" + ", clicked boolean" * clicked)


def scan_settings(spark: SparkSession, path: str) -> DataFrame:
    """The settings' scan ranges and pixel size with pixel counts, derived where they are not given: rounded up to whole pixels."""
    s = readers.settings(spark, path).select("imagingSettings.*")
    have = set(s.columns)
    size = F.col("pixelSize_Microns")
    ratio = F.coalesce(F.col("aspectRatio_x_y_"), F.lit(1.0)) if "aspectRatio_x_y_" in have else F.lit(1.0)
    given = lambda c: F.col(c).cast("long") if c in have else F.lit(None).cast("long")
    nx, ny = F.ceil(F.col("xScanRange_Microns") / size).cast("long"), F.ceil(F.col("yScanRange_Microns") / (size * ratio)).cast("long")
    return s.select(F.col("xScanRange_Microns").alias("x_range"), F.col("yScanRange_Microns").alias("y_range"), size.alias("pixel"), F.coalesce(given("numXPixels"), nx).alias("nx"), F.coalesce(given("numYPixels"), ny).alias("ny"), F.coalesce(given("numZPixels"), F.lit(1).cast("long")).alias("nz"))


def frame_edges(spark: SparkSession, start: float, end: float, width: float) -> DataFrame:
    """frame, t0 and t1 of whole frames of one width from start on that end by end."""
    n = max(0, int((end - start) / width + 1e-9))
    return spark.range(n).select(F.col("id").alias("frame"), (F.lit(start) + F.col("id") * width).alias("t0"), (F.lit(start) + (F.col("id") + 1) * width).alias("t1"))


def newest(spark: SparkSession, path: str) -> DataFrame:
    """The last changed file of a path, by name among equals: path, length and time."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    return files.orderBy(F.desc("modificationTime"), "path").limit(1)
