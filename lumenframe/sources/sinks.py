"""Writers of what the analyses keep: partitioned Parquet for tables, text for hand-edited lists.

Every writer is one Spark job and returns nothing; files appear only when the job commits.  Paths are Spark's, of any file system.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def points(df: DataFrame, path: str, columns: list[str], mode: str = "error") -> None:
    """Photons or dwell: the named columns as doubles."""
    df.select(*(F.col(c).cast("double").alias(c) for c in columns)).write.mode(mode).parquet(path)


def points_by_time(df: DataFrame, path: str, t: str, seconds: float = 5.0, by: list[str] | None = None, mode: str = "error") -> None:
    """Rows in folders of `chunk` (equal parts of time) and the named columns; a chunk's rows come from one task each."""
    out = df.withColumn("chunk", F.floor(F.col(t) / seconds).cast("long"))
    out.repartition("chunk", *(by or [])).sortWithinPartitions("chunk", *(by or []), t).write.mode(mode).partitionBy("chunk", *(by or [])).parquet(path)


def frames(volume: DataFrame, path: str, kind: str, frame: str = "frame", metric: Column | None = None, mode: str = "error") -> None:
    """Registered volumes, a folder for each kind (raw, rigid, non_rigid) and frame, voxels without counts and dwell left out."""
    out = volume.where((F.col("counts") != 0) | (F.col("dwell") != 0)).withColumn("kind", F.lit(kind))
    if metric is not None:
        out = out.withColumn("metric", metric)
    out.repartition(frame).write.mode(mode).partitionBy("kind", frame).parquet(path)


def stored_frames(spark, path: str, kind: str, low: dict[str, int] | None = None, high: dict[str, int] | None = None) -> DataFrame:
    """Frames of a kind as `frames` wrote them, cut to a box of voxels; folders of other kinds are not read."""
    df = spark.read.option("mergeSchema", True).parquet(path).where(F.col("kind") == kind).drop("kind")
    for axis, v in (low or {}).items():
        df = df.where(F.col(axis) >= v)
    for axis, v in (high or {}).items():
        df = df.where(F.col(axis) <= v)
    return df


def table(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "error") -> None:
    """A template, a stack or the activity in regions: Parquet, in folders of `by` if there are any."""
    w = df.write.mode(mode)
    (w.partitionBy(*by) if by else w).parquet(path)


def append_regions(masks: DataFrame, path: str, name: str) -> None:
    """Adds a named set of regions to those that are there."""
    masks.withColumn("voiset", F.lit(name)).write.mode("append").partitionBy("voiset").parquet(path)


def state_lines(flags: DataFrame, path: str, condensed: bool = False, mode: str = "error") -> None:
    """(frame, state, on) as lines `frame, state, state`; condensed: frames without a state have no line."""
    g = flags.where("frame is not null").groupBy("frame").agg(F.array_sort(F.collect_set(F.when(F.col("on"), F.col("state")))).alias("s"))
    g = g.where(F.size("s") > 0) if condensed else g
    line = F.concat_ws(", ", F.concat(F.array(F.col("frame").cast("string")), F.col("s")))
    g.orderBy("frame").select(line.alias("value")).write.mode(mode).text(path)


def places_csv(places: DataFrame, path: str, columns: list[str], mode: str = "error") -> None:
    """Head or tail places, rows that are finite in every column."""
    ok = F.lit(True)
    for c in columns:
        v = F.col(c).cast("double")
        ok = ok & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    places.where(ok).select(*columns).orderBy(columns[0]).write.mode(mode).csv(path, header=True)


def merged_annotations(old: DataFrame, new: DataFrame, key: str = "frame") -> DataFrame:
    """old, and of new the rows of frames that old does not have."""
    return old.unionByName(new.join(old.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)
