"""Signal-to-noise of series that still arrive: sums by voxel, kept by Structured Streaming.

A convenience of this engine on top of the batch operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.schema import EPS32


def running_tsnr(cells: DataFrame, eps: float = EPS32) -> DataFrame:
    """cells: a stream of x, y, z, t, re, im. A streaming aggregate for the update or complete
    output mode: frames seen and tsnr of each voxel so far. State is four numbers a voxel."""
    magnitude = F.hypot("re", "im")
    return cells.groupBy("x", "y", "z").agg(F.count(F.lit(1)).alias("frames"), (F.avg(magnitude) / (F.stddev_samp(magnitude) + F.lit(eps))).alias("tsnr"))
