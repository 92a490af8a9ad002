"""Weighted points on regular grids: bins, volumes, projections, rates, ranks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Axis:
    """n half-open bins of one width from start, numbered from 0."""

    name: str
    start: float
    width: float
    n: int

    def index(self, x: Column) -> Column:
        return F.floor((x - self.start) / self.width + 1e-9).cast("long")

    def inside(self, i: Column) -> Column:
        return i.between(0, self.n - 1)


def bin_points(points: DataFrame, axes: list[tuple[str, Axis]], sums: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """Sums by bin (sparse: bins without points have no row); points outside any axis, or null, are left out."""
    for column, axis in axes:
        points = points.withColumn(f"i{axis.name}", axis.index(F.col(column)))
    for _, axis in axes:
        points = points.where(axis.inside(F.col(f"i{axis.name}")))
    return points.groupBy(*(by or []), *(f"i{a.name}" for _, a in axes)).agg(*(F.sum(v).alias(k) for k, v in sums.items()))


def rate(counts: Column, dwell: Column, least: float = 0.0) -> Column:
    """counts / dwell, 0 where dwell is null or under `least` or not above 0."""
    return F.when((dwell >= least) & (dwell > 0), counts / dwell).otherwise(0.0)


def projections(volume: DataFrame, value: str) -> DataFrame:
    """The three projections of (ix, iy, iz) in one pass: plane, a, b and the sum."""
    sets = volume.groupingSets([["ix", "iy"], ["ix", "iz"], ["iy", "iz"]], "ix", "iy", "iz").agg(F.sum(value).alias("total"), F.grouping_id().alias("g"))
    plane = F.when(F.col("g") == 1, "xy").when(F.col("g") == 2, "xz").otherwise("yz")
    return sets.select(plane.alias("plane"), F.coalesce("ix", "iy").alias("a"), F.when(F.col("g") == 1, F.col("iy")).otherwise(F.col("iz")).alias("b"), "total")


def densify(sparse: DataFrame, axes: list[Axis], values: list[str]) -> DataFrame:
    """Every bin of the axes, with 0 where there is no row.  For output: the grid is generated, not joined pair by pair."""
    grid = sparse.sparkSession.range(0, _size(axes)).withColumnRenamed("id", "_k")
    step = 1
    for a in reversed(axes):
        grid = grid.withColumn(f"i{a.name}", F.floor(F.col("_k") / step) % a.n)
        step *= a.n
    return grid.drop("_k").join(sparse, [f"i{a.name}" for a in axes], "left").fillna(0, values)


def _size(axes: list[Axis]) -> int:
    n = 1
    for a in axes:
        n *= a.n
    return n


def _ranked(bins: DataFrame, value: str) -> DataFrame:
    """A line for each distinct value: `_at`, how many bins have a larger one, `_over`, their sum, `_bins` and `_all`.

    Values are counted first, so that only distinct values meet in one task.
    """
    lines = bins.groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_k"))
    down = Window.orderBy(F.desc("_v")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    return lines.select("_v", F.coalesce(F.sum("_k").over(down), F.lit(0)).alias("_at"), F.coalesce(F.sum(F.col("_k") * F.col("_v")).over(down), F.lit(0)).alias("_over"), F.sum("_k").over(whole).alias("_bins"), F.sum(F.col("_k") * F.col("_v")).over(whole).alias("_all"))


def bin_rank(bins: DataFrame, value: str, ties: list[str], out: str = "rank") -> DataFrame:
    """1 for the largest bin; equal ones by `ties`, among themselves only."""
    rows = bins.join(_ranked(bins, value), F.col(value).eqNullSafe(F.col("_v")))
    return rows.withColumn(out, (F.col("_at") + F.row_number().over(Window.partitionBy(value).orderBy(*ties))).cast("int")).drop("_v", "_at", "_over", "_bins", "_all")


def top_share(bins: DataFrame, value: str, ties: list[str], share: float = 0.25, part: float = 0.05) -> DataFrame:
    """The brightest bins: those before `share` of the total is reached, and no more than `part` of the bins."""
    rows = bins.join(_ranked(bins, value), F.col(value).eqNullSafe(F.col("_v"))).withColumn("_r", F.row_number().over(Window.partitionBy(value).orderBy(*ties)))
    upto, rank = F.col("_over") + F.col("_r") * F.col(value), F.col("_at") + F.col("_r")
    return rows.where((upto < share * F.col("_all")) & (rank <= part * F.col("_bins"))).drop("_v", "_at", "_over", "_bins", "_all", "_r")
