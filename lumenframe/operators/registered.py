"""Photons and volumes under the pose of their frame: posed points, rates, activity in volumes of interest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import rigid

#: Seconds of one tick of the native clock: less dwell than that counts as none.
TICK = 1 / 1.6e8
POSE = ["az", "ay", "ax", "tx", "ty", "tz"]


def posed(points: DataFrame, poses: DataFrame, frame: list[str], xyz: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """Points whose xyz are turned and shifted by the pose of their frame (columns of POSE, angles in radians).

    One equi-join on `frame`; Spark broadcasts the poses if they are small, and splits a frame with very many photons
    if not.  Points of a frame without a pose, or of a null frame, have null coordinates, as have those of a null pose;
    `bin_points` leaves them out.  Every other column is kept; poses must have one row a frame.
    """
    own = poses.select(*frame, F.struct(*POSE).alias("_pose"))
    rows = points.join(own, frame, "left")
    p = {c: F.col(f"_pose.{c}") for c in POSE}
    moved = rigid(*(F.col(c) for c in xyz), (p["az"], p["ay"], p["ax"]), (p["tx"], p["ty"], p["tz"]))
    out = rows.withColumns({c: v for c, v in zip(xyz, moved)})
    return out.select(*points.columns)


def frame_rate(counts: Column, dwell: Column, gain: Column | None = None) -> Column:
    """gain counts / dwell; 0 where that is not finite or the dwell is under a tick."""
    r = F.when(dwell >= TICK, counts / dwell * (F.lit(1.0) if gain is None else gain)).otherwise(0.0)
    return F.when(F.isnan(r) | (F.abs(r) == float("inf")) | r.isNull(), 0.0).otherwise(r)


def _masks(masks: DataFrame, voi: list[str], voxel: list[str]) -> DataFrame:
    return masks.select(*voi, *voxel).dropna().distinct()


def voi_rates(volume: DataFrame, masks: DataFrame, frame: list[str], voi: list[str], voxel: list[str], gain: str | None = None) -> DataFrame:
    """Mean over a mask's voxels of a frame's corrected rate: `rate`, of all `voxels` of the mask.

    volume: (frame, voxel, counts, dwell), sparse; rows of one voxel (sub-frames, repeats) are summed before the rate is
    taken, absent voxels have rate 0.  A frame that has no voxel in a mask has no row for it (its rate is 0).  `gain` is
    a column of the correction, one value a frame and voxel.  Masks may overlap; repeated mask rows count once.
    """
    sums = [F.sum("counts").alias("counts"), F.sum("dwell").alias("dwell"), *([F.max(gain).alias("_gain")] if gain else [])]
    summed = volume.groupBy(*frame, *voxel).agg(*sums)
    rated = summed.withColumn("_rate", frame_rate(F.col("counts"), F.col("dwell"), F.col("_gain") if gain else None))
    mask = _masks(masks, voi, voxel)
    size = mask.groupBy(*voi).agg(F.count("*").alias("voxels"))
    total = rated.select(*frame, *voxel, "_rate").join(mask, voxel).groupBy(*frame, *voi).agg(F.sum("_rate").alias("_rate"))
    return total.join(size, voi).select(*frame, *voi, (F.col("_rate") / F.col("voxels")).alias("rate"), "voxels")


def voi_sums(volume: DataFrame, masks: DataFrame, by: list[str], voi: list[str], voxel: list[str], gain: str | None = None) -> DataFrame:
    """Counts and dwell inside a mask by frame or sub-frame; with `gain` also gained counts and dwell over gain."""
    sums = [F.sum("counts").alias("counts"), F.sum("dwell").alias("dwell")]
    if gain:
        sums += [F.sum(F.col("counts") * F.col(gain)).alias("counts_gained"), F.sum(F.when(F.col(gain) != 0, F.col("dwell") / F.col(gain))).alias("dwell_gained")]
    return volume.join(_masks(masks, voi, voxel), voxel).groupBy(*by, *voi).agg(*sums)


def plane_in_time(volume: DataFrame, by: list[str], plane: list[str], depth: str, low: int, high: int, gain: str | None = None) -> DataFrame:
    """Counts (gained, if a gain is named) and dwell of each pixel and (sub-)frame, summed over low <= depth <= high."""
    counts = F.col("counts") * F.col(gain) if gain else F.col("counts")
    return volume.where(F.col(depth).between(low, high)).groupBy(*by, *plane).agg(F.sum(counts).alias("counts"), F.sum("dwell").alias("dwell"))
