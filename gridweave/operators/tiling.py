"""Halo tiling: blocks of voxels with ghost cells, so that overlapping patches are cut inside a task.

Space is dealt to blocks by the origins of patches: a block owns the patches that begin in it and gets
the voxels that they reach, its own and a halo of patch size less one on the far side. So a voxel is sent to
at most ((b + h) / b)^3 blocks on average, b the edge of a block and h the halo, however much patches
overlap, instead of once a patch; never more often than that either, as only blocks with a patch that holds
the voxel are meant. Blocks are known by Morton keys. In the task a block is one dense array; patches
are strided views of it, stacked and decomposed many to a call. Overlap sums leave the task once a voxel and
block, and are added up by voxel.

A group is one block: its size is bounded by ``Tiles.block``, whatever the volume.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.functions.complexes import array_sum
from gridweave.operators.patches import Axis, Patches

#: Voxels of a block with its halo, unless a single patch has more; at 400 frames about 100 MB.
BLOCK_VOXELS = 16_384
#: Bytes of patches that are decomposed in one call.
STACK_BYTES = 16 << 20
_SPREAD = [(32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)]


def _spread(c: Column) -> Column:
    out = c.cast("long")
    for by, mask in _SPREAD:
        out = out.bitwiseOR(F.shiftleft(out, by)).bitwiseAND(F.lit(mask))
    return out


def morton(x: Column, y: Column, z: Column) -> Column:
    """Interleaved bits of three coordinates of up to 21 bits."""
    return _spread(x).bitwiseOR(F.shiftleft(_spread(y), 1)).bitwiseOR(F.shiftleft(_spread(z), 2))


def from_morton(key: int) -> tuple[int, int, int]:
    return tuple(sum((key >> (3 * i + axis) & 1) << i for i in range(21)) for axis in range(3))


@dataclass(frozen=True)
class Tiles:
    """Blocks of ``block`` voxels an axis over the patches of a geometry."""

    geometry: Patches
    block: tuple[int, int, int]

    @classmethod
    def of(cls, geometry: Patches, voxels: int = BLOCK_VOXELS) -> Tiles:
        """Edges of three halos, made smaller until a block with its halo has at most so many voxels."""
        axes = geometry.axes
        edge = [max(1, min(3 * max(a.size - 1, a.stride), a.n)) for a in axes]
        while math.prod(b + a.size - 1 for b, a in zip(edge, axes)) > voxels and max(edge) > 1:
            k = max(range(3), key=lambda i: edge[i])
            edge[k] = -(-edge[k] // 2)
        return cls(geometry, tuple(edge))

    def most_copies(self) -> float:
        """Bound of the mean number of blocks that a voxel is sent to."""
        return math.prod((b + a.size - 1) / b for b, a in zip(self.block, self.geometry.axes))

    def _blocks(self, axis: Axis, b: int, x: Column) -> Column:
        """Array of the blocks with a patch that holds coordinate x."""
        none = F.array().cast("array<int>")
        if not axis.count:
            return none
        last = axis.count - 1
        moved = axis.origin(last) != last * axis.stride  # the clamped last one
        regular = axis.count - 1 if moved else axis.count
        low, high = F.greatest(F.lit(0), F.floor((x - (axis.size - 1)) / b)), F.least(F.floor(x / b), F.lit(axis.origin(last) // b))

        def held(k: Column) -> Column:
            first, end = F.greatest(k * b, x - (axis.size - 1)), F.least((k + 1) * b - 1, x)
            found = F.least(F.floor(end / axis.stride), F.lit(regular - 1)) * axis.stride >= first
            return found | F.lit(axis.origin(last)).between(first, end) if moved else found

        return F.when(low <= high, F.filter(F.sequence(low.cast("int"), high.cast("int")), held)).otherwise(none)

    def send(self, series: DataFrame) -> DataFrame:
        """Packed series (x, y, z, re, im) with their block; a row for each block that needs it. No exchange."""
        out = series.select("x", "y", "z", "re", "im")
        for axis, b, name in zip(self.geometry.axes, self.block, "xyz"):
            out = out.withColumn(f"_b{name}", F.explode(self._blocks(axis, b, F.col(name))))
        return out.select(morton(F.col("_bx"), F.col("_by"), F.col("_bz")).alias("block"), "x", "y", "z", "re", "im")

    def owner(self, patch_id: Column) -> Column:
        """The block that owns a patch."""
        ax, ay, az = self.geometry.axes
        at = (patch_id % ax.count, F.floor(patch_id / ax.count) % ay.count, F.floor(patch_id / (ax.count * ay.count)))
        origin = lambda a, i: F.least(i * a.stride, F.lit(a.n - a.size)) if a.clamp else i * a.stride
        return morton(*(F.floor(origin(a, i) / b) for a, i, b in zip((ax, ay, az), at, self.block)))


class _Block:
    """A block as a dense array; voxels that are absent are zero and come back in nothing."""

    def __init__(self, tiles: Tiles, key: int, table: pa.Table):
        axes = tiles.geometry.axes
        self.axes, self.size = axes, tuple(a.size for a in axes)
        self.base = tuple(k * b for k, b in zip(from_morton(key), tiles.block))
        shape = tuple(max(1, min(b + a.size - 1, a.n - o)) for a, b, o in zip(axes, tiles.block, self.base))
        self.at = tuple(table.column(c).to_numpy() - o for c, o in zip("xyz", self.base))
        re, im = (table.column(c).combine_chunks() for c in ("re", "im"))
        frames = {len(a.flatten()) // max(1, len(a)) for a in (re, im)}
        self.frames = frames.pop()
        if frames or any(len(a.flatten()) != self.frames * len(a) for a in (re, im)):
            raise ValueError("series differ in their number of frames")
        self.v = np.zeros((*shape, self.frames), complex)
        self.v[self.at] = (re.flatten().to_numpy() + 1j * im.flatten().to_numpy()).reshape(-1, self.frames)
        self.there = np.zeros(shape, bool)
        self.there[self.at] = True
        #: (number, origin) of the patches of each axis that begin here.
        self.origins = [[(i, a.origin(i) - o) for i in range(a.count) if o <= a.origin(i) < o + b] for a, b, o in zip(axes, tiles.block, self.base)]

    def stacks(self) -> Iterator[tuple[list[int], list[tuple[int, int, int]], np.ndarray]]:
        """(patch ids, origins, patches): as many patches as STACK_BYTES hold, one matrix each."""
        view = np.lib.stride_tricks.sliding_window_view(self.v, self.size, axis=(0, 1, 2))
        there = np.lib.stride_tricks.sliding_window_view(self.there, self.size)
        most = max(1, STACK_BYTES // (16 * math.prod(self.size) * max(1, self.frames)))
        (cx, cy, _), ids, held = (a.count for a in self.axes), [], []
        for k, oz in self.origins[2]:
            for j, oy in self.origins[1]:
                for i, ox in self.origins[0]:
                    if not there[ox, oy, oz].any():
                        continue
                    ids.append(i + cx * (j + cy * k))
                    held.append((ox, oy, oz))
                    if len(ids) == most:
                        yield ids, held, self._cut(view, held)
                        ids, held = [], []
        if ids:
            yield ids, held, self._cut(view, held)

    def _cut(self, view: np.ndarray, origins: list) -> np.ndarray:
        return np.stack([view[o].transpose(1, 2, 3, 0).reshape(-1, self.frames) for o in origins])

    def averaged(self, results: Iterator[tuple[list, np.ndarray]]) -> pa.Table:
        """Sums of patches and their number, of the voxels that are there: x, y, z, re, im, n."""
        total, n = np.zeros_like(self.v), np.zeros(self.v.shape[:3], np.int32)
        for origins, stack in results:
            for o, m in zip(origins, stack):
                own = tuple(slice(a, a + s) for a, s in zip(o, self.size))
                total[own] += m.reshape(*self.size, self.frames)
                n[own] += 1
        found = np.argwhere((n > 0) & self.there)
        at = tuple(found.T)
        ends = pa.array(np.arange(len(found) + 1, dtype=np.int32) * self.frames, pa.int32())
        part = lambda v: pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(v).ravel()))
        place = [pa.array((c + o).astype(np.int32)) for c, o in zip(at, self.base)]
        values = total[at]
        return pa.table([*place, part(values.real), part(values.imag), pa.array(n[at], pa.int32())], names=["x", "y", "z", "re", "im", "n"])


SUMS = "x int, y int, z int, re array<double>, im array<double>, n int"


def shrink(series: DataFrame, tiles: Tiles, step: Callable[[np.ndarray, np.ndarray], np.ndarray], beta: float | DataFrame) -> DataFrame:
    """Every patch changed by ``step(stack, thresholds)`` and recombined by overlap average; voxels in no
    patch are absent. beta: one threshold, or a table (patch_id, beta), where patches without one are left out."""
    sent = tiles.send(series).groupBy("block")

    def one(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        block = _Block(tiles, key[0].as_py(), table)
        return block.averaged((held, step(m, np.full(len(m), beta))) for _, held, m in block.stacks())

    def several(key: tuple[pa.Scalar, ...], table: pa.Table, betas: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int32(),) * 3 + (pa.list_(pa.float64()),) * 2 + (pa.int32(),)], names=["x", "y", "z", "re", "im", "n"])
        block = _Block(tiles, key[0].as_py(), table)
        by = dict(zip(betas.column("patch_id").to_pylist(), betas.column("beta").to_pylist()))

        def results():
            for ids, held, m in block.stacks():
                own = [k for k, i in enumerate(ids) if i in by]
                if own:
                    yield [held[k] for k in own], step(m[own], np.array([by[ids[k]] for k in own], float))

        return block.averaged(results())

    if isinstance(beta, DataFrame):
        owned = beta.select(tiles.owner(F.col("patch_id")).alias("block"), F.col("patch_id").cast("int").alias("patch_id"), F.col("beta").cast("double").alias("beta"))
        sums = sent.cogroup(owned.groupBy("block")).applyInArrow(several, SUMS)
    else:
        sums = sent.applyInArrow(one, SUMS)
    if tiles.geometry.disjoint:
        return sums.select("x", "y", "z", "re", "im")
    both = sums.groupBy("x", "y", "z").agg(F.collect_list(F.struct("re", "im")).alias("a"), F.sum("n").alias("n"))
    mean = lambda c: F.transform(array_sum(F.col(f"a.{c}")), lambda v: v / F.col("n"))
    return both.select("x", "y", "z", mean("re").alias("re"), mean("im").alias("im"))


def each_patch(series: DataFrame, tiles: Tiles, facts: Callable[[list[int], np.ndarray], pa.Table], schema: str, columns: pa.Schema) -> DataFrame:
    """Rows that ``facts(patch ids, stack)`` gives of the patches with any voxel there."""

    def one(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        found = [facts(ids, m) for ids, _, m in _Block(tiles, key[0].as_py(), table).stacks()]
        return pa.concat_tables(found) if found else columns.empty_table()

    return tiles.send(series).groupBy("block").applyInArrow(one, schema)
