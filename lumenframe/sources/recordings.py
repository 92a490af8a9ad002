"""Logs of a recording: tracker, stage encoder, camera; one row a line, told apart by `file` and `pos`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bits
from ..operators import segments, temporal

# Fixed values of the formats: ticks a second, timer wrap, scales of the logs' columns and of the encoder (micrometres a count).
TICKS, WRAP = 1.6e8, 4294967296
TRACKER = {"timer": 256 / 1.6e8, "loc": 1 / 64}
ENCODER = {"x_enc": 0.022, "y_enc": 0.022, "z_enc": 0.0055}
RAW_BYTES = 21


def numbered(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A tab-separated log with `file` and `pos`, which grows along each file.

    A file is read as one split's lines or several; the key is the line's place in its file's splits, in order.
    """
    rows = spark.read.csv(path, sep="\t", header=True, schema=schema, nanValue="NaN")
    return rows.select("*", F.col("_metadata.file_path").alias("file"), (F.col("_metadata.file_block_start") * 2048 + F.pmod(F.monotonically_increasing_id(), F.lit(1 << 33))).alias("pos"))


def tracker(rows: DataFrame) -> DataFrame:
    """Tracker rows with `timer` and `loc` in seconds and micrometres, `spot` from 1, `dim` 0 to 2, status flags and `com`.

    The 32-bit timer is unwrapped along the file.  com is weighted_sum over the gated photons, null where there are none.
    Rows of an axis over 300 or below 0, or null, go; as do repeats of an axis at a timer (the first by pos stays).
    """
    valid = rows.where(F.col("axis").between(0, 300))
    unwrapped = temporal.unwrap_counter(valid.where("timer is not null"), ["file"], ["pos"], "timer", WRAP, "ticks")
    first = Window.partitionBy("file", "axis", "ticks").orderBy("pos")
    once = unwrapped.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    photons = F.col("num_phot_detections_from_pmt_in_spot")
    return once.select(
        "file", "pos", (F.col("ticks") * TRACKER["timer"]).alias("t"), (F.floor(F.col("axis") / 3) + 1).cast("int").alias("spot"), (F.col("axis") % 3).cast("int").alias("dim"),
        (F.col("loc") * TRACKER["loc"]).alias("loc"), F.when(photons > 0, F.col("weighted_sum") / photons).alias("com"), *[c.alias(n) for n, c in bits.status_bits(F.col("status")).items()],
    )


def encoder(lines: DataFrame, value: str = "value", order: list[str] | None = None, keys: list[str] | None = None, reach: int = 5, most: float = 1000.0) -> DataFrame:
    """Encoder lines as request, t, x, y and z in micrometres, and `valid`.

    A line is `request time x y z f` and the raw bytes in hexadecimal digits.  Valid: seven fields that are numbers,
    RAW_BYTES raw bytes, and every axis within `most` of the median of the valid lines up to `reach` away.
    """
    order, keys = order or ["request"], keys or []
    f = F.split(F.trim(F.col(value)), r"\s+")
    part = lambda i: F.expr(f"try_cast(get(_f, {i}) AS double)")
    raw = F.regexp_replace(F.concat_ws("", F.slice("_f", 7, 1000)), "[^0-9A-Fa-f]", "")
    rows = lines.withColumn("_f", f).select(
        *keys, *[c for c in order if c in lines.columns], part(0).cast("long").alias("request"), part(1).alias("t"),
        *[(part(i + 2) * k).alias(n[0]) for i, (n, k) in enumerate(ENCODER.items())], (F.length(raw) == 2 * RAW_BYTES).alias("valid"),
    )
    whole = F.coalesce(F.col("valid"), F.lit(False))
    for c in ("request", "t", "x", "y", "z"):
        whole = whole & F.col(c).isNotNull()
    rows = rows.withColumn("valid", whole)
    for a in "xyz":
        rows = segments.rolling_median(rows.withColumn("_v", F.when(F.col("valid"), F.col(a))), keys, order, "_v", reach, f"_{a}").drop("_v")
    near = F.lit(True)
    for a in "xyz":
        near = near & (F.abs(F.col(a) - F.col(f"_{a}")) <= most)
    return rows.withColumn("valid", F.col("valid") & F.coalesce(near, F.lit(False))).drop("_x", "_y", "_z")


def clock_fit(pairs: DataFrame, keys: list[str], own: str, other: str) -> DataFrame:
    """By key the line that takes one clock to another: slope and intercept; null with under two times."""
    return pairs.groupBy(*keys).agg(F.regr_slope(other, own).alias("slope"), F.regr_intercept(other, own).alias("intercept"), F.count("*").alias("n"))


def frame_segments(log: DataFrame, keys: list[str], order: list[str], number: str, least: int = 1, most: int = 5) -> DataFrame:
    """Runs of a log in which the frame number rises by `least` to `most` a row: keys, segment (from 1), rows, first and last number."""
    w = Window.partitionBy(*keys).orderBy(*order)
    step = F.col(number) - F.lag(number).over(w)
    new = F.when(step.between(least, most), 0).otherwise(1)
    run = log.withColumn("_new", new).withColumn("segment", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first, last = F.min_by(number, F.struct(*order)), F.max_by(number, F.struct(*order))
    return run.groupBy(*keys, "segment").agg(F.count("*").alias("n"), first.alias("first"), last.alias("last"))


def match_by_length(found: DataFrame, wanted: Column | int, keys: list[str], share: float = 0.05) -> DataFrame:
    """Of each key the segment whose number of rows is nearest a length, if it is off by under `share` of it; the earliest of equal ones."""
    length = wanted if isinstance(wanted, Column) else F.lit(wanted)
    off = F.abs(F.col("n") - length) / length
    close = found.withColumn("_off", off).where(F.col("_off") < share)
    return close.groupBy(*keys).agg(F.min_by(F.struct("segment", "n", "first", "last"), F.struct("_off", "segment")).alias("_b")).select(*keys, "_b.*")


#: Fixed names: the nine values of a row of the older tracker's files, in their order.
OLD_TRACKER = ["ax", "pos", "vel", "perr", "status", "gphoton", "rphoton", "et", "mstimer"]


def old_tracker(spark: SparkSession, path: str, gap: float = 0.001) -> DataFrame:
    """The older tracker's text files: file, spot and axis (0 to 2) of each row's channel, its values, `innovation` (position error per photon) and `tracking`.

    Rows whose time does not rise from the row before them go.  Tracking is the status' second bit; of a file whose status says something but never
    that, the longest stretch of channel 1 whose samples are less than `gap` apart, its ends left out.  Where any row of a file is
    tracked, spots that never are go.  Lines without nine numbers are left out; a file is one task.
    """
    line = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("a"), F.monotonically_increasing_id().alias("b")).alias("_at"), F.split(F.trim("value"), r"[\s,]+").alias("_v"))
    rows = line.where(F.size("_v") == len(OLD_TRACKER)).select("file", "_at", *(F.expr(f"try_cast(_v[{i}] as double)").alias(c) for i, c in enumerate(OLD_TRACKER))).dropna()
    by = Window.partitionBy("file")
    before = F.lag("et").over(by.orderBy("_at"))
    rows = rows.withColumn("_p", before).where(F.col("_p").isNull() | (F.col("et") > F.col("_p"))).drop("_p")
    rows = rows.withColumn("tracking", F.col("status").cast("long").bitwiseAND(2) != 0)
    files = rows.groupBy("file").agg(F.max(F.col("status") != 0).alias("_says"), F.max("tracking").alias("_ever"))
    # the stretch to fall back on: runs of close samples of channel 1
    one = rows.where("ax = 1").withColumn("_d", F.col("et") - F.lag("et").over(by.orderBy("et"))).withColumn("_run", F.count_if(F.col("_d").isNull() | (F.col("_d") >= gap)).over(by.orderBy("et")))
    runs = one.groupBy("file", "_run").agg(F.min("et").alias("_a"), F.max("et").alias("_b"), F.count("*").alias("_n")).where("_n > 1")
    longest = runs.groupBy("file").agg(F.max_by(F.struct("_a", "_b"), F.struct("_n", (-F.col("_a")).alias("m"))).alias("_s"))
    rows = rows.join(files, "file").join(longest, "file", "left")
    fall = F.col("_says") & ~F.col("_ever")
    inside = F.coalesce((F.col("et") > F.col("_s._a")) & (F.col("et") < F.col("_s._b")), F.lit(False))
    rows = rows.withColumn("tracking", F.when(fall, inside).otherwise(F.col("tracking")))
    rows = rows.withColumns({"spot": F.floor(F.col("ax") / 3).cast("int"), "axis": (F.col("ax") % 3).cast("int"), "innovation": F.try_divide("perr", F.col("gphoton") + F.col("rphoton"))})
    spot, whole = F.max("tracking").over(Window.partitionBy("file", "spot")), F.max("tracking").over(by)
    rows = rows.withColumns({"_mine": spot, "_any": whole}).where("_mine or not _any")
    return rows.select("file", "spot", "axis", *OLD_TRACKER[1:], "innovation", "tracking")
