"""Triangular factors of tall patches whose rows are spread over tasks: a tree of QR decompositions.

Each task reduces its rows of a patch to a triangle of frames by frames, a few rows at a time; triangles of
neighbouring tasks are stacked and reduced again, sixteen to one, up to a single one a patch. It
has the singular values and right singular vectors of the patch to working precision, where the Gram matrix
squares them and loses those below 1e-8 of the largest. The orthogonal factor is never formed: what is done to
rows is done where they lie, by their right singular vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Triangles that one step of the tree stacks.
FAN = 16
TRIANGLE = "patch_id int, part int, re array<double>, im array<double>"
_ARROW = pa.schema([("patch_id", pa.int32()), ("part", pa.int32()), ("re", pa.list_(pa.float64())), ("im", pa.list_(pa.float64()))])


def triangle_of(m: np.ndarray) -> np.ndarray:
    """Upper triangle R of m = Q R; square, whatever the number of rows."""
    n = m.shape[1]
    if len(m) < n:
        m = np.vstack([m, np.zeros((n - len(m), n), complex)])
    return np.linalg.qr(m, mode="r")


def _row(patch: int, part: int, r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([patch], pa.int32()), pa.array([part], pa.int32()), pa.array([r.real.ravel()], pa.list_(pa.float64())), pa.array([r.imag.ravel()], pa.list_(pa.float64()))], schema=_ARROW)


def square(re, im) -> np.ndarray:
    """A triangle from its flat parts."""
    n = round(len(re) ** 0.5)
    return (np.asarray(re) + 1j * np.asarray(im)).reshape(n, n)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    re, im = (batch.column(c).flatten().to_numpy() for c in ("re", "im"))
    return (re + 1j * im).reshape(batch.num_rows, -1)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list[np.ndarray]] = {}
    part = TaskContext.get().partitionId()
    for b in batches:
        if not b.num_rows:
            continue
        m, patches = _matrix(b), b.column("patch_id").to_numpy()
        for p in np.unique(patches).tolist():
            own = held.setdefault(p, [])
            own.append(m[patches == p])
            if sum(map(len, own)) >= 4 * m.shape[1]:
                held[p] = [triangle_of(np.vstack(own))]
    for p, own in held.items():
        yield _row(p, part, triangle_of(np.vstack(own)))


def _stacked(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    whole = np.vstack([square(re.values.to_numpy(), im.values.to_numpy()) for re, im in zip(table.column("re"), table.column("im"))])
    return pa.Table.from_batches([_row(table.column("patch_id")[0].as_py(), table.column("part")[0].as_py(), triangle_of(whole))])


def triangles(patches: DataFrame) -> DataFrame:
    """(patch_id, re, im) of exploded patches (patch_id, re, im): one triangle a patch, flat, row by row."""
    held = patches.select("patch_id", "re", "im").mapInArrow(_partial, TRIANGLE)
    for step in (FAN, FAN * FAN, None):
        keys = ["patch_id"] if step is None else ["patch_id", F.floor(F.col("part") / step).alias("_g")]
        held = held.groupBy(*keys).applyInArrow(_stacked, TRIANGLE)
    return held.select("patch_id", "re", "im")
