"""Three-dimensional transforms of volumes that no task holds: a pass an axis, with transposing exchanges.

The first pass groups cells into pencils along x and transforms them; its results leave in chunks of
``chunk`` neighbours in x. The second pass groups chunks by z into slabs that are whole in y, the third by
chunks of x and y into bars that are whole in z. So the largest thing in a task is a bar of
chunk * chunk * nz cells, and what is exchanged are arrays, not cells. Absent cells are zero.

Sampling masks travel as bitmaps: one bit a cell, a row for each frame and bar.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Neighbours that stay together in an exchange.
CHUNK = 16
#: Bytes of an Arrow batch; a batch has at least one bar.
BATCH = "16m"
#: Bytes of all bitmaps up to which they are broadcast.
MAX_BITMAP_BYTES = 64 << 20


def shifted(values: np.ndarray, axis: int, *, forward: bool, norm: str) -> np.ndarray:
    """Centred transform along one axis, right for odd and even sizes."""
    step = np.fft.fft if forward else np.fft.ifft
    return np.fft.fftshift(step(np.fft.ifftshift(values, axes=axis), axis=axis, norm=norm), axes=axis)


def _lists(values: np.ndarray) -> pa.ListArray:
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.ascontiguousarray(values).ravel()))


def _whole(batch: pa.RecordBatch, axis: str, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, values): rows of the batch whose parts have one width, and their values (rows, n, width)."""
    s = batch.column("_s")
    row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(s).to_numpy(zero_copy_only=False))
    parts = s.flatten()
    at, re, im = (parts.field(c) for c in (axis, "re", "im"))
    at = at.to_numpy()
    nested = pa.types.is_list(re.type)
    width = pc.list_value_length(re).to_numpy(zero_copy_only=False) if nested else np.ones(len(at), np.int64)
    first = np.cumsum(width) - width
    re, im = ((c.flatten() if nested else c).to_numpy() for c in (re, im))
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        rows, place = np.unique(row[own], return_inverse=True)
        take = first[own][:, None] + np.arange(w)
        out = np.zeros((len(rows), n, w), complex)
        np.add.at(out, (place, at[own]), re[take] + 1j * im[take])
        yield rows, out


def _pass(cells: DataFrame, keys: list[str], axis: str, n: int, split: str | None, chunk: int, **how) -> DataFrame:
    """Transforms along ``axis``; results leave in parts of ``chunk`` along it, numbered by ``split``, or
    whole where that is None."""
    grouped = cells.groupBy(*keys).agg(F.collect_list(F.struct(axis, "re", "im")).alias("_s"))
    size = chunk if split else n
    names = [*keys, *([split] if split else []), "re", "im"]
    numbers = [T.StructField(split, T.IntegerType())] if split else []
    schema = T.StructType([*grouped.select(*keys).schema.fields, *numbers, *(T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("re", "im"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, values in _whole(b, axis, n) if b.num_rows else ():
                done = shifted(values, 1, **how)
                held = [b.column(k).take(pa.array(rows)) for k in keys]
                for k in range(0, n, size):
                    part = done[:, k : k + size].reshape(len(rows), -1)
                    lead = [pa.array(np.full(len(rows), k // size), pa.int32())] if split else []
                    yield pa.RecordBatch.from_arrays([*held, *lead, _lists(part.real), _lists(part.imag)], names=names)

    return grouped.mapInArrow(run, schema)


def bars(cells: DataFrame, shape: tuple[int, int, int], *, keys: tuple[str, ...] = ("coil", "t"), forward: bool, norm: str = "ortho", chunk: int = CHUNK) -> DataFrame:
    """Long rows (x, y, z, keys, re, im) to transformed bars: keys, xb, yb, re, im, each with the values of
    chunk xb of x and yb of y over all z, z slowest and x fastest."""
    cells.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    how = {"forward": forward, "norm": norm}
    rows = cells.select(*keys, *(F.col(c).cast("int").alias(c) for c in "xyz"), F.col("re").cast("double").alias("re"), F.col("im").cast("double").alias("im"))
    along_x = _pass(rows, [*keys, "y", "z"], "x", shape[0], "xb", chunk, **how)
    along_y = _pass(along_x, [*keys, "xb", "z"], "y", shape[1], "yb", chunk, **how)
    return _pass(along_y, [*keys, "xb", "yb"], "z", shape[2], None, chunk, **how)


def mask_bitmaps(mask: DataFrame, shape: tuple[int, int, int], chunk: int | None = CHUNK) -> DataFrame:
    """t, xb, yb, bits: the sampled cells of each frame and bar, a bit a cell in the order of bars(); without
    a chunk, one row a frame."""
    cx, cy = (chunk, chunk) if chunk else shape[:2]
    width, height = (F.least(F.lit(c), F.lit(n) - F.col(b) * c) for c, n, b in ((cx, shape[0], "xb"), (cy, shape[1], "yb")))
    placed = mask.select("t", F.floor(F.col("x") / cx).cast("int").alias("xb"), F.floor(F.col("y") / cy).cast("int").alias("yb"), "x", "y", "z")
    at = (F.col("z") * height + F.col("y") - F.col("yb") * cy) * width + F.col("x") - F.col("xb") * cx
    grouped = placed.select("t", "xb", "yb", at.cast("int").alias("at")).groupBy("t", "xb", "yb").agg(F.collect_list("at").alias("at"))
    schema = T.StructType([*grouped.select("t", "xb", "yb").schema.fields, T.StructField("bits", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = []
            for i, (xb, yb) in enumerate(zip(b.column("xb").to_pylist(), b.column("yb").to_pylist())):
                held = np.zeros(min(cx, shape[0] - xb * cx) * min(cy, shape[1] - yb * cy) * shape[2], bool)
                held[b.column("at")[i].values.to_numpy()] = True
                bits.append(np.packbits(held).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("t"), b.column("xb"), b.column("yb"), pa.array(bits, pa.binary())], names=["t", "xb", "yb", "bits"])

    return grouped.mapInArrow(run, schema)


def cells_of(found: DataFrame, shape: tuple[int, int, int], *, keys: tuple[str, ...] = ("coil", "t"), bitmaps: DataFrame | None = None, frames: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """Bars to long rows (x, y, z, keys, re, im); with bitmaps, only sampled cells leave the task. ``frames``
    bounds the bitmaps' size; where it is small they are broadcast."""
    rows, masked = found, bitmaps is not None
    if masked:
        small = frames is not None and shape[0] * shape[1] * shape[2] * frames // 8 <= MAX_BITMAP_BYTES
        rows = found.join(F.broadcast(bitmaps) if small else bitmaps, ["t", "xb", "yb"])
    schema = T.StructType([*(T.StructField(c, T.IntegerType()) for c in "xyz"), *found.select(*keys).schema.fields, T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                xb, yb = b.column("xb")[i].as_py(), b.column("yb")[i].as_py()
                w, h = min(chunk, shape[0] - xb * chunk), min(chunk, shape[1] - yb * chunk)
                re, im = (b.column(c)[i].values.to_numpy() for c in ("re", "im"))
                at = np.arange(len(re))
                if masked:
                    at = np.flatnonzero(np.unpackbits(np.frombuffer(b.column("bits")[i].as_py(), np.uint8), count=len(re)))
                place = [(at % w + xb * chunk).astype(np.int32), (at // w % h + yb * chunk).astype(np.int32), (at // (w * h)).astype(np.int32)]
                held = [b.column(k).take(pa.array(np.full(len(at), i))) for k in keys]
                yield pa.RecordBatch.from_arrays([*map(pa.array, place), *held, pa.array(re[at]), pa.array(im[at])], names=schema.names)

    return rows.mapInArrow(run, schema)


def transform(cells: DataFrame, shape: tuple[int, int, int], *, keys: tuple[str, ...] = ("coil", "t"), forward: bool, norm: str = "ortho", chunk: int = CHUNK) -> DataFrame:
    """All cells of the centred transform of long rows (x, y, z, keys, re, im)."""
    return cells_of(bars(cells, shape, keys=keys, forward=forward, norm=norm, chunk=chunk), shape, keys=keys, chunk=chunk)
