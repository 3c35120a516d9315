"""Overlapping spatial windows (patches) and their overlap-averaged recombination.

A voxel's patches follow from its coordinates alone, so extraction is an explode, never a range
join. Two modes per axis: ``clamp`` clips the patch to the volume, takes ceil((N - p) / stride)
steps and moves the last patch inward to end with the volume; ``drop_tail`` takes
floor((N - p) / stride) steps, clips nothing, and leaves the trailing voxels in no patch.
Patch ids run x fastest, then y, then z.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.functions.complexes import array_sum


@dataclass(frozen=True)
class Axis:
    """Windows along one axis."""

    n: int
    patch: int
    stride: int
    clamp: bool = True

    def __post_init__(self):
        if self.n < 1 or self.patch < 1 or self.stride < 1:
            raise ValueError("size, patch and stride must be positive")

    @property
    def size(self) -> int:
        return min(self.patch, self.n) if self.clamp else self.patch

    @property
    def count(self) -> int:
        room = self.n - self.size
        if room < 0:
            return 0
        return 1 + (math.ceil(room / self.stride) if self.clamp else room // self.stride)

    def origin(self, i: int) -> int:
        return min(i * self.stride, self.n - self.size) if self.clamp else i * self.stride

    def windows(self, x: Column) -> Column:
        """Array of the windows that hold coordinate x. At most overlap + 1 candidates are tried."""
        last = self.count - 1
        if last < 0:
            return F.array().cast("array<int>")
        low = F.greatest(F.lit(0), F.ceil((x - (self.size - 1)) / self.stride)).cast("int")
        high = F.least(F.lit(last), F.floor(x / self.stride)).cast("int")
        inner = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
        origin = lambda i: F.least(i * self.stride, F.lit(self.n - self.size)) if self.clamp else i * self.stride
        held = F.filter(inner, lambda i: (x >= origin(i)) & (x < origin(i) + self.size))
        if self.clamp and self.origin(last) != last * self.stride:
            # The clamped last window begins earlier than its step says.
            held = F.array_union(held, F.when(x >= self.origin(last), F.array(F.lit(last))).otherwise(F.array().cast("array<int>")))
        return held

    def offset(self, x: Column, i: Column) -> Column:
        return x - (F.least(i * self.stride, F.lit(self.n - self.size)) if self.clamp else i * self.stride)


@dataclass(frozen=True)
class Patches:
    """Geometry of one scale."""

    grid: tuple[int, int, int]
    patch: tuple[int, int, int]
    stride: tuple[int, int, int]
    mode: str = "clamp"

    def __post_init__(self):
        if self.mode not in ("clamp", "drop_tail"):
            raise ValueError(f"no mode {self.mode!r}")

    @property
    def axes(self) -> tuple[Axis, Axis, Axis]:
        return tuple(Axis(n, p, s, self.mode == "clamp") for n, p, s in zip(self.grid, self.patch, self.stride))

    @property
    def count(self) -> int:
        return math.prod(a.count for a in self.axes)

    @property
    def volume(self) -> int:
        """Voxels of a patch, after clipping."""
        return math.prod(a.size for a in self.axes)

    @property
    def disjoint(self) -> bool:
        """Whether no voxel is in two patches."""
        return all(all(a.origin(i + 1) >= a.origin(i) + a.size for i in range(a.count - 1)) for a in self.axes)

    @property
    def covers(self) -> bool:
        return all(a.count and a.origin(a.count - 1) + a.size >= a.n and all(a.origin(i + 1) <= a.origin(i) + a.size for i in range(a.count - 1)) for a in self.axes)


def extract(series: DataFrame, geometry: Patches) -> DataFrame:
    """Adds patch_id and vox (place in the patch, x fastest) to rows with x, y, z; one row for
    each patch that holds the voxel. Works on long and packed series alike. No shuffle."""
    ax, ay, az = geometry.axes
    out = series
    for axis, name in ((ax, "x"), (ay, "y"), (az, "z")):
        out = out.withColumn(f"_p{name}", F.explode(axis.windows(F.col(name))))
    patch = F.col("_px") + ax.count * (F.col("_py") + ay.count * F.col("_pz"))
    vox = ax.offset(F.col("x"), F.col("_px")) + ax.size * (ay.offset(F.col("y"), F.col("_py")) + ay.size * az.offset(F.col("z"), F.col("_pz")))
    return out.withColumn("patch_id", patch.cast("int")).withColumn("vox", vox.cast("int")).drop("_px", "_py", "_pz")


def combine(patches: DataFrame, *, value: str = "v", keys: tuple[str, ...] = ("x", "y", "z", "t")) -> DataFrame:
    """Overlap average of long rows: sum over count, in one aggregation."""
    return patches.groupBy(*keys).agg((F.sum(value) / F.count(F.lit(1))).alias(value))


def combine_packed(patches: DataFrame, geometry: Patches) -> DataFrame:
    """Overlap average of packed rows (x, y, z, re, im). A voxel has as many rows as patches hold
    it; disjoint patches need no shuffle at all."""
    if geometry.disjoint:
        return patches.select("x", "y", "z", "re", "im")
    both = patches.groupBy("x", "y", "z").agg(F.collect_list(F.struct("re", "im")).alias("a"))
    mean = lambda c: F.transform(array_sum(F.col(f"a.{c}")), lambda v: v / F.size("a"))
    return both.select("x", "y", "z", mean("re").alias("re"), mean("im").alias("im"))


def fill_uncovered(covered: DataFrame, series: DataFrame, *, value: str = "v", keys: tuple[str, ...] = ("x", "y", "z", "t")) -> DataFrame:
    """All cells of ``series``; those in no patch are zero."""
    return series.select(*keys).join(covered, list(keys), "left").withColumn(value, F.coalesce(value, F.lit(0.0)))
