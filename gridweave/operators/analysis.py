"""Linear drift, temporal signal-to-noise, and convergence tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridweave.schema import EPS32


def detrend(series: DataFrame, *, values: tuple[str, ...] = ("re", "im"), keys: tuple[str, ...] = ("x", "y", "z"), preserve_mean: bool = False) -> DataFrame:
    """Subtracts slope * t from each series (keys, t, values), or slope * (t - mean t), which
    keeps its mean. A single frame's slope is that of the minimum-norm fit of (1, t), v t / (1 + t^2).

    One exchange by voxel: slopes are window aggregates beside the rows, and what aggregates by voxel
    afterwards needs no further one."""
    own = Window.partitionBy(*keys)
    n, total = F.count(F.lit(1)).over(own), F.sum("t").over(own)
    slope = lambda v: F.when(n > 1, F.regr_slope(F.col(v), F.col("t")).over(own)).otherwise(F.max(v).over(own) * total / (1 + total * total))
    held = series.withColumns({**{f"_b_{v}": slope(v) for v in values}, "_m": F.avg("t").over(own)})
    shift = F.col("t") - F.col("_m") if preserve_mean else F.col("t")
    return held.withColumns({v: F.col(v) - F.col(f"_b_{v}") * shift for v in values}).drop("_m", *(f"_b_{v}" for v in values))


def tsnr(series: DataFrame, magnitude: Column, *, keys: tuple[str, ...] = ("x", "y", "z"), eps: float = EPS32) -> DataFrame:
    """Mean over sample deviation plus eps of each series' magnitude: keys, tsnr."""
    return series.groupBy(*keys).agg((F.avg(magnitude) / (F.stddev_samp(magnitude) + F.lit(eps))).alias("tsnr"))


def tsnr_summary(tsnr_map: DataFrame) -> DataFrame:
    """One row: mean and largest over positive voxels."""
    return tsnr_map.where("tsnr > 0").agg(F.avg("tsnr").alias("mean_tsnr"), F.max("tsnr").alias("max_tsnr"))


def convergence(spark: SparkSession, log: list[tuple[int, float, float, bool]]) -> DataFrame:
    """iter, dc_cost, reg_cost, restart of a solver's log, with the total and its log10."""
    rows = spark.createDataFrame([(int(i), float(d), float(r), bool(b)) for i, d, r, b in log], "iter int, dc_cost double, reg_cost double, restart boolean")
    total = F.col("dc_cost") + F.col("reg_cost")
    return rows.select("*", total.alias("total"), F.log10(total).alias("log_total"))


def restart_marks(convergence_table: DataFrame) -> DataFrame:
    return convergence_table.where("restart").select("iter")


def first_frames(components: DataFrame) -> DataFrame:
    """Frame 1 of each scale."""
    return components.where("t = 1")
