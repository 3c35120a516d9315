"""Sampling masks, their validation, gap filling and normalisation of measurements."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from gridweave.schema import CELL, EPS32
from gridweave.scratch import Scratch


def drop_unsampled(kspace: DataFrame) -> DataFrame:
    """Exact zero means not sampled; such rows go at ingest."""
    return kspace.where((F.col("re") != 0) | (F.col("im") != 0))


def sampling_mask(kspace: DataFrame) -> DataFrame:
    """The sampled cells (x, y, z, t), judged by coil 1."""
    return kspace.where("coil = 1 and (re <> 0 or im <> 0)").select(*CELL)


def acceleration(mask: DataFrame, voxels: int) -> DataFrame:
    """Voxels over the samples of frame 1: one row (acceleration)."""
    return mask.where("t = 1").agg((F.lit(float(voxels)) / F.count(F.lit(1))).alias("acceleration"))


def compact(kspace: DataFrame, mask: DataFrame) -> DataFrame:
    """Measurements of sampled cells only."""
    return kspace.join(mask, list(CELL), "left_semi")


def scatter(compacted: DataFrame, cells: DataFrame, keys: tuple[str, ...] = CELL) -> DataFrame:
    """All cells; those without a measurement are zero."""
    out = cells.join(compacted, list(keys), "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("re", "im")})


def coil_mask_faults(kspace: DataFrame, coils: int) -> DataFrame:
    """Cells that not all coils have sampled; empty if the masks agree."""
    return drop_unsampled(kspace).groupBy(*CELL).agg(F.count_distinct("coil").alias("n_coils")).where(F.col("n_coils") != coils)


def frame_counts(mask: DataFrame) -> DataFrame:
    return mask.groupBy("t").agg(F.count(F.lit(1)).alias("n"))


def _inside(grid: tuple[int, int, int], coils: int, frames: int) -> Column:
    ok = F.lit(True)
    for name, low, high in (("x", 0, grid[0] - 1), ("y", 0, grid[1] - 1), ("z", 0, grid[2] - 1), ("coil", 1, coils), ("t", 1, frames)):
        ok = ok & F.col(name).between(low, high)
    return ok


def extent_faults(kspace: DataFrame, grid: tuple[int, int, int], coils: int, frames: int) -> DataFrame:
    """Rows that lie outside the declared shape."""
    return kspace.where(~_inside(grid, coils, frames))


def validate(kspace: DataFrame, grid: tuple[int, int, int], coils: int, frames: int, voxels: int | None = None) -> float:
    """Checks shape, coil masks and frame counts in one job; returns the acceleration factor, of ``voxels`` or all
    cells of the grid.

    Rows are grouped by cell once: the number of coils of a cell, and from cells the number of a frame."""
    seen = Observation()
    bad = ~_inside(grid, coils, frames)
    rows = drop_unsampled(kspace).observe(seen, F.count(F.when(F.coalesce(bad, F.lit(True)), 1)).alias("outside"))
    cells = rows.groupBy(*CELL).agg(F.count_distinct("coil").alias("c"), F.max(F.when(F.col("coil") == 1, 1)).alias("first"))
    by_frame = cells.groupBy("t").agg(F.count("first").alias("n"), F.count(F.when(F.col("c") != coils, 1)).alias("odd"))
    found = by_frame.agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count(F.when(F.col("n") > 0, 1)).alias("frames"), F.coalesce(F.sum("odd"), F.lit(0)).alias("odd")).first()
    if seen.get["outside"]:
        raise ValueError("measurements outside the declared shape")
    if found.odd:
        raise ValueError("coils differ in their sampling masks")
    if found.frames != frames or found.low != found.high:
        raise ValueError("frames differ in their number of samples")
    return (voxels or grid[0] * grid[1] * grid[2]) / found.low


def nearest_frame(samples: DataFrame, frames: int, *, location: tuple[str, ...] = ("x", "y", "z"), values: tuple[str, ...] = ("re", "im")) -> DataFrame:
    """Each frame of each sampled location takes the nearest sampled frame's values, the earlier
    of two as near: location, t, t_src, values. Locations that were never sampled stay absent.

    One shuffle by location: every sample covers the frames up to halfway to its neighbours, so
    it is exploded over those frames; no grid is joined.
    """
    order = Window.partitionBy(*location).orderBy("t")
    before, after = F.lag("t").over(order), F.lead("t").over(order)
    # Halfway frames belong to the earlier sample.
    first = F.when(before.isNull(), 1).otherwise(F.floor((before + F.col("t")) / 2) + 1)
    last = F.when(after.isNull(), frames).otherwise(F.floor((F.col("t") + after) / 2))
    reach = samples.select(*location, F.col("t").alias("t_src"), *values, first.cast("int").alias("a"), last.cast("int").alias("b"))
    return reach.where("a <= b").select(*location, F.explode(F.sequence("a", "b")).alias("t"), "t_src", *values)


def viewshare(kspace: DataFrame, frames: int) -> DataFrame:
    """nearest_frame() by the frames that coil 1 has sampled, for all coils alike."""
    picked = nearest_frame(sampling_mask(kspace), frames, values=())
    source = kspace.select(*(F.col(c) for c in ("x", "y", "z", "coil")), F.col("t").alias("t_src"), "re", "im")
    return picked.join(source, ["x", "y", "z", "t_src"]).select("x", "y", "z", "coil", "t", "t_src", "re", "im")


#: Size of the quantile sketch, and the rank error it keeps to with near certainty (checked afterwards).
_SKETCH, _RANK_ERROR = 4096, 0.004
#: Bins of a pass over the bracket, and values of a bin that are sorted by themselves.
_BINS, _FEW = 4096, 100_000


def quantile_scale(values: DataFrame, magnitude: Column, q: float = 0.99) -> DataFrame:
    """One row (scale): the exact, interpolated quantile of the magnitude; null without values.

    Two scans of the values, however many there are: a sketch brackets the quantile, then the values
    inside the bracket are written and those below it counted. The counts prove whether the two order statistics are
    inside (else the bracket is widened). The written part, under a hundredth of all values, is cut
    into bins until few are left."""
    spark = values.sparkSession
    rows = values.select(magnitude.cast("double").alias("m")).where("m is not null")
    found = rows.agg(F.kll_sketch_agg_double("m", F.lit(_SKETCH)).alias("s"), F.min("m").alias("low"), F.max("m").alias("high"), F.count("m").alias("n"))
    error = _RANK_ERROR
    ranks = lambda e: (max(0.0, q - e), min(1.0, q + e))
    held = found.select("low", "high", "n", *(F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("s", F.lit(r))).alias(c) for e, names in ((error, "ab"), (8 * error, "cd")) for r, c in zip(ranks(e), names))).first()
    if not held.n:
        return spark.createDataFrame([(None,)], "scale double")
    place = q * (held.n - 1)
    scratch = Scratch(spark, "quantile")
    tries = [(held.a, held.b, error), (held.c, held.d, 8 * error), (held.low, held.high, 1.0)]
    for low, high, e in tries:
        least, most = ranks(e)
        low, high = held.low if least == 0 else low, held.high if most == 1 else high
        seen = Observation()
        below, inside = F.count(F.when(F.col("m") < low, 1)).alias("below"), F.count(F.when(F.col("m").between(low, high), 1)).alias("inside")
        bracket = scratch.keep(rows.observe(seen, below, inside).where(F.col("m").between(low, high)))
        if seen.get["below"] <= math.floor(place) and math.ceil(place) < seen.get["below"] + seen.get["inside"]:
            break
        scratch.drop()
    scale = _order_statistics(bracket, low, high, seen.get["below"], seen.get["inside"], place)
    scratch.drop()
    return spark.createDataFrame([(scale,)], "scale double")


def _order_statistics(rows: DataFrame, low: float, high: float, below: int, left: int, place: float) -> float:
    """The interpolated value at ``place`` among all, from rows m between low and high with so many below.

    The bins that hold the two order statistics are cut into finer ones until few values are left in
    them; only counts of bins and those few leave a task."""
    while left > _FEW and low < high:
        step = (high - low) / _BINS
        if low + step == low:
            break
        at = F.least(F.floor((F.col("m") - F.lit(low)) / F.lit(step)), F.lit(_BINS - 1)).cast("int")
        counts = rows.where(F.col("m").between(low, high)).groupBy(at.alias("b")).agg(F.count("m").alias("n"), F.min("m").alias("low"), F.max("m").alias("high")).orderBy("b").collect()
        held, chosen = below, []
        for r in counts:
            if held + r.n > math.floor(place) and held <= math.ceil(place):
                chosen.append((held, r))
            held += r.n
        below, low, high, left, before = chosen[0][0], chosen[0][1].low, chosen[-1][1].high, sum(r.n for _, r in chosen), left
        if left == before:
            break
    inside = rows.where(F.col("m").between(low, high))
    return inside.agg(F.percentile("m", F.lit(min(1.0, max(0.0, (place - below) / max(1, left - 1)))))).first()[0]


def normalise(kspace: DataFrame, scale: float) -> DataFrame:
    """Measurements over max(scale, eps)."""
    by = max(scale, EPS32)
    return kspace.withColumns({c: F.col(c) / F.lit(by) for c in ("re", "im")})


def normalise_maps(maps: DataFrame) -> DataFrame:
    """Coil maps over sqrt of their summed squared magnitude plus eps."""
    total = F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")).over(Window.partitionBy("x", "y", "z"))
    return maps.withColumn("_n", F.sqrt(total) + F.lit(EPS32)).withColumns({c: F.col(c) / F.col("_n") for c in ("re", "im")}).drop("_n")
