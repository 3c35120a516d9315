"""Discrete Fourier transforms: of packed series along one axis, and of whole frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dft(series: DataFrame, n: int, *, keys: tuple[str, ...], axis: str = "t", out: str = "k", inverse: bool = False, unitary: bool = False) -> DataFrame:
    """Transform along ``axis`` (from 0 to n - 1) of long rows (keys, axis, re, im): a series is
    packed by one shuffle and transformed where it lies; absent samples are zero. The forward transform has no factor, the inverse
    1/n, a unitary one 1/sqrt(n) both ways."""
    norm = "ortho" if unitary else "backward"
    step = np.fft.ifft if inverse else np.fft.fft
    packed = series.groupBy(*keys).agg(F.collect_list(F.struct(F.col(axis).cast("int").alias("t"), F.col("re").cast("double").alias("re"), F.col("im").cast("double").alias("im"))).alias("_s"))
    packed = packed.select(*keys, F.col("_s.t").alias("_t"), F.col("_s.re").alias("_re"), F.col("_s.im").alias("_im"))
    schema = T.StructType([*packed.select(*keys).schema.fields, *(T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("_re", "_im"))])

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grid = np.zeros((b.num_rows, n), complex)
            at = b.column("_t")
            row = np.repeat(np.arange(b.num_rows), pc.list_value_length(at).to_numpy(zero_copy_only=False))
            re, im = (b.column(c).flatten().to_numpy() for c in ("_re", "_im"))
            np.add.at(grid, (row, at.flatten().to_numpy()), re + 1j * im)
            done = step(grid, axis=1, norm=norm)
            ends = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * n, pa.int32())
            parts = [pa.ListArray.from_arrays(ends, pa.array(x.ravel())) for x in (done.real, done.imag)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), *parts], names=[*keys, "_re", "_im"])

    cells = packed.mapInArrow(transform, schema).select(*keys, F.posexplode(F.arrays_zip("_re", "_im")).alias(out, "_v"))
    return cells.select(*keys, out, F.col("_v._re").alias("re"), F.col("_v._im").alias("im"))


def centred(volume: np.ndarray, *, forward: bool, norm: str = "ortho") -> np.ndarray:
    """Centred transform over the last three axes: shift after, inverse shift before, right for
    odd and even sizes."""
    axes = (-3, -2, -1)
    step = np.fft.fftn if forward else np.fft.ifftn
    return np.fft.fftshift(step(np.fft.ifftshift(volume, axes=axes), axes=axes, norm=norm), axes=axes)
