"""Drift and signal-to-noise of series from sums that can be merged.

The batch operators (``operators.analysis``) need a series whole. Here each part of a series leaves
seven numbers, parts are merged by adding them, and slope, mean and deviation of the detrended
series follow from the sums. So frames that arrive later cost only themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.schema import EPS32

SUMS = ("n", "st", "stt", "sv", "svv", "stv")


def moments(samples: DataFrame, *, t: Column, v: Column, keys: tuple[str, ...]) -> DataFrame:
    """keys, rows, and the sums of the rows that are samples: both t and v are there and finite."""
    far = float("inf")
    t, v = t.cast("double"), v.cast("double")
    good = t.isNotNull() & v.isNotNull() & ~F.isnan(v) & ~F.isnan(t) & (F.abs(v) < far) & (F.abs(t) < far)
    held = samples.select(*keys, F.when(good, t).alias("_t"), F.when(good, v).alias("_v"))
    t, v = F.col("_t"), F.col("_v")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return held.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count(v).alias("n"), total(t).alias("st"), total(t * t).alias("stt"), total(v).alias("sv"), total(v * v).alias("svv"), total(t * v).alias("stv")
    )


def merged(parts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Moments of whole series from moments of their parts."""
    return parts.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("rows", *SUMS)))


def trend(sums: DataFrame, keys: tuple[str, ...], eps: float = EPS32) -> DataFrame:
    """keys, rows, n, mean, slope, sd, tsnr.

    slope is the least-squares slope; a series of one sample has the slope of its minimum-norm fit;
    without two different t there is none. sd and tsnr are those of the series less slope * t, null for
    fewer than three samples, where the fit leaves nothing over. No sample: only rows and n.
    """
    n = F.col("n")
    some = lambda c: F.when(n > 0, c)
    mt, mv = some(F.col("st") / n), some(F.col("sv") / n)
    sxx, sxy, syy = F.col("stt") - mt * F.col("st"), F.col("stv") - mt * F.col("sv"), F.col("svv") - mv * F.col("sv")
    spread = F.when((n > 1) & (sxx > F.abs(F.col("stt")) * 1e-12), sxx)
    out = sums.withColumns({"mean": mv, "_syy": syy, "_sxy": sxy, "_mt": mt})
    out = out.withColumn("slope", F.when(n == 1, F.col("sv") * F.col("st") / (1 + F.col("st") * F.col("st"))).otherwise(sxy / spread))
    out = out.withColumn("sd", F.when(n > 2, F.sqrt(F.greatest(F.col("_syy") - F.col("slope") * F.col("_sxy"), F.lit(0.0)) / (n - 1))))
    return out.select(*keys, "rows", "n", "mean", "slope", "sd", ((F.col("mean") - F.col("slope") * F.col("_mt")) / (F.col("sd") + F.lit(eps))).alias("tsnr"))
