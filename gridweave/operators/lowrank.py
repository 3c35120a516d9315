"""Nuclear norms and singular-value soft-thresholding of patches.

A patch is the matrix of its voxels' series (rows: voxels, columns: frames). Strategies:

* one voxel a patch: its series is shrunk by its own norm; native expressions, no grouping;
* small patches: cut inside blocks of voxels with a halo (``operators.tiling``), decomposed in stacks;
* large patches: a tree of QR decompositions (``operators.tsqr``) gives the singular values and right
  vectors, whose spectral function is applied to the rows where they lie; no patch ever meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.functions.complexes import array_dot
from gridweave.operators import tiling, tsqr
from gridweave.operators.patches import Patches, combine_packed, extract
from gridweave.schema import require

#: Voxels of a patch up to which it is decomposed in one task.
GROUPED_ROWS = 4096
PACKED = "x int, y int, z int, re array<double>, im array<double>"


def svst(x: np.ndarray, beta: float) -> np.ndarray:
    """Soft-thresholds the singular values of one matrix."""
    if not x.any():
        return np.zeros_like(x)
    u, s, vh = singular(x)
    keep = s > beta
    return (u[:, keep] * (s[keep] - beta)) @ vh[keep]


def singular(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Reduced SVD; should the iteration fail, by the eigenvalues of the smaller Gram matrix."""
    try:
        return np.linalg.svd(x, full_matrices=False)
    except np.linalg.LinAlgError:
        wide = x.shape[0] < x.shape[1]
        a = x.conj().T if wide else x
        w, v = np.linalg.eigh(a.conj().T @ a)
        s, v = np.sqrt(np.maximum(w[::-1], 0)), v[:, ::-1]
        u = np.divide(a @ v, s, out=np.zeros_like(a @ v), where=s > 0)
        return (v, s, u.conj().T) if wide else (u, s, v.conj().T)


def contrast_svst(x: np.ndarray, beta: float) -> np.ndarray:
    """Thresholds after scaling to a leading singular value of one, and restores it."""
    eps = float(np.finfo(np.float32).eps)
    lead = np.linalg.norm(x, 2) if x.any() else 0.0
    out = svst(x / (lead or eps), beta)
    after = np.linalg.norm(out, 2) if out.any() else 0.0
    return out * lead / (after or eps)


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack(pdf["re"].to_list()) + 1j * np.stack(pdf["im"].to_list())


def _rows(pdf: pd.DataFrame, x: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"x": pdf["x"], "y": pdf["y"], "z": pdf["z"], "re": list(x.real.copy()), "im": list(x.imag.copy())})


def shrunk(re: Column, im: Column, beta: Column | float) -> tuple[Column, Column]:
    """A series v as v * max(1 - beta / |v|, 0)."""
    norm = F.sqrt(array_dot(re, re) + array_dot(im, im))
    factor = F.when(norm > 0, F.greatest(F.lit(1.0) - beta / norm, F.lit(0.0))).otherwise(F.lit(0.0))
    # An array of one: the factor is found once a row, not once an element.
    return tuple(F.flatten(F.transform(F.array(factor), lambda f: F.transform(c, lambda v: v * f))) for c in (re, im))


def shrink_voxels(series: DataFrame, beta: Column | float) -> DataFrame:
    """Patches of one voxel: v * max(1 - beta / |v|, 0)."""
    norm = F.sqrt(array_dot(F.col("re"), F.col("re")) + array_dot(F.col("im"), F.col("im")))
    factor = F.when(norm > 0, F.greatest(F.lit(1.0) - beta / norm, F.lit(0.0))).otherwise(F.lit(0.0))
    out = series.withColumn("_f", factor)
    return out.withColumns({c: F.transform(c, lambda v: v * F.col("_f")) for c in ("re", "im")}).drop("_f")


def shrink_stack(m: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """svst() of a stack of matrices, a threshold each, by one decomposition of them all."""
    try:
        u, s, vh = np.linalg.svd(m, full_matrices=False)
    except np.linalg.LinAlgError:
        return np.stack([svst(x, b) for x, b in zip(m, beta)])
    return (u * np.maximum(s - beta[:, None], 0)[:, None, :]) @ vh


def contrast_stack(m: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """contrast_svst() of a stack of matrices."""
    try:
        u, s, vh = np.linalg.svd(m, full_matrices=False)
    except np.linalg.LinAlgError:
        return np.stack([contrast_svst(x, b) for x, b in zip(m, beta)])
    lead = s[:, :1]
    kept = np.maximum(np.divide(s, lead, out=np.zeros_like(s), where=lead > 0) - beta[:, None], 0)
    kept *= np.divide(lead, kept[:, :1], out=np.zeros_like(lead), where=kept[:, :1] > 0)
    return (u * kept[:, None, :]) @ vh


def _pack(g: np.ndarray) -> np.ndarray:
    return np.concatenate([g.real.ravel(), g.imag.ravel()])


def gram(patches: DataFrame) -> DataFrame:
    """(patch_id, g): the Gram matrix of each patch, real part then imaginary part, row by row.
    Summed within partitions, then over them element by element."""

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for pdf in frames:
            for patch, own in pdf.groupby("patch_id"):
                m = _matrix(own)
                g = m.conj().T @ m
                held[patch] = held[patch] + g if patch in held else g
        for patch, g in held.items():
            flat = _pack(g)
            yield pd.DataFrame({"patch_id": np.int32(patch), "k": np.arange(len(flat), dtype=np.int32), "v": flat})

    cells = patches.select("patch_id", "re", "im").mapInPandas(partial, "patch_id int, k int, v double")
    sums = cells.groupBy("patch_id", "k").agg(F.sum("v").alias("v"))
    return sums.groupBy("patch_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s.v).alias("g"))


def threshold_tall(patches: DataFrame, beta: float | DataFrame) -> DataFrame:
    """Large patches: rows times V diag(max(s - beta, 0) / s) V^H, singular values and right vectors by a
    tree of QR decompositions; beta: one threshold, or a table (patch_id, beta)."""

    def function(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for patch, re, im, b in zip(pdf["patch_id"], pdf["re"], pdf["im"], pdf["beta"]):
            _, s, vh = singular(tsqr.square(re, im))
            h = (vh.conj().T * np.divide(np.maximum(s - b, 0), s, out=np.zeros_like(s), where=s > 0)) @ vh
            out.append((patch, _pack(h)))
        return pd.DataFrame(out, columns=["patch_id", "h"])

    matrices = tsqr.triangles(patches)
    matrices = matrices.join(beta, "patch_id").select("patch_id", "re", "im", "beta") if isinstance(beta, DataFrame) else matrices.withColumn("beta", F.lit(float(beta)))
    functions = matrices.mapInPandas(lambda frames: map(function, frames), "patch_id int, h array<double>")
    joined = patches.select("patch_id", "x", "y", "z", "re", "im").join(functions, "patch_id")

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for _, own in pdf.groupby("patch_id"):
                flat = np.asarray(own["h"].iloc[0])
                n = int(round((len(flat) / 2) ** 0.5))
                yield _rows(own, _matrix(own) @ (flat[: n * n].reshape(n, n) + 1j * flat[n * n :].reshape(n, n)))

    return joined.mapInPandas(apply, PACKED)


def patch_svst(series: DataFrame, geometry: Patches, beta: float | DataFrame, *, grouped_rows: int = GROUPED_ROWS) -> DataFrame:
    """Extract, threshold, recombine by overlap average; series is packed (x, y, z, re, im).

    beta: one threshold, or a table (patch_id, beta). Voxels in no patch become zero.
    """
    require(series, "x", "y", "z", "re[", "im[")
    table = isinstance(beta, DataFrame)
    if geometry.volume > grouped_rows:
        found = combine_packed(threshold_tall(extract(series, geometry), beta), geometry)
    elif geometry.volume == 1:
        patches = extract(series, geometry)
        held = patches.join(beta, "patch_id") if table else patches
        found = shrink_voxels(held, F.col("beta") if table else beta).select("x", "y", "z", "re", "im")
    else:
        found = tiling.shrink(series, tiling.Tiles.of(geometry), shrink_stack, beta)
    return found if geometry.covers else _zero_elsewhere(found, series)


def patch_svst_2d(series: DataFrame, grid: tuple[int, int, int], patch: tuple[int, int], stride: tuple[int, int], beta: float) -> DataFrame:
    """Contrast-preserving thresholding within planes of equal x; patch and stride are (y, z). No
    clipping or clamping: trailing voxels in no patch become zero."""
    geometry = Patches(grid, (1, *patch), (1, *stride), "drop_tail")
    found = tiling.shrink(series, tiling.Tiles.of(geometry), contrast_stack, beta)
    return found if geometry.covers else _zero_elsewhere(found, series)


def _zero_elsewhere(found: DataFrame, series: DataFrame) -> DataFrame:
    cells = series.select("x", "y", "z", F.size("re").alias("_n"))
    zero = F.array_repeat(F.lit(0.0), F.col("_n"))
    return cells.join(found, ["x", "y", "z"], "left").select("x", "y", "z", F.coalesce("re", zero).alias("re"), F.coalesce("im", zero).alias("im"))


_NORMS = pa.schema([("patch_id", pa.int32()), ("nn", pa.float64()), ("lead", pa.float64())])


def _stack_norms(ids: list[int], m: np.ndarray) -> pa.Table:
    s = np.linalg.svd(m, compute_uv=False)
    return pa.table([pa.array(ids, pa.int32()), pa.array(s.sum(axis=1)), pa.array(s.max(axis=1))], schema=_NORMS)


def nuclear_norms(series: DataFrame, geometry: Patches, *, grouped_rows: int = GROUPED_ROWS) -> DataFrame:
    """(patch_id, nn, lead): the sum of singular values and the largest one of each patch of packed series."""
    require(series, "x", "y", "z", "re[", "im[")
    if geometry.volume == 1:
        norm = F.sqrt(array_dot(F.col("re"), F.col("re")) + array_dot(F.col("im"), F.col("im")))
        return extract(series, geometry).select("patch_id", norm.alias("nn"), norm.alias("lead"))
    if geometry.volume > grouped_rows:

        def spectral(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                s = [np.linalg.svd(tsqr.square(re, im), compute_uv=False) for re, im in zip(pdf["re"], pdf["im"])]
                yield pd.DataFrame({"patch_id": pdf["patch_id"], "nn": [x.sum() for x in s], "lead": [x.max() for x in s]})

        return tsqr.triangles(extract(series, geometry)).mapInPandas(spectral, "patch_id int, nn double, lead double")
    return tiling.each_patch(series, tiling.Tiles.of(geometry), _stack_norms, "patch_id int, nn double, lead double", _NORMS)


_GRAMS = pa.schema([("patch_id", pa.int32()), ("g", pa.list_(pa.float64()))])


def _stack_grams(ids: list[int], m: np.ndarray) -> pa.Table:
    g = m.conj().transpose(0, 2, 1) @ m
    flat = np.concatenate([g.real.reshape(len(m), -1), g.imag.reshape(len(m), -1)], axis=1)
    ends = pa.array(np.arange(len(m) + 1, dtype=np.int32) * flat.shape[1], pa.int32())
    return pa.table([pa.array(ids, pa.int32()), pa.ListArray.from_arrays(ends, pa.array(flat.ravel()))], schema=_GRAMS)


def grams(series: DataFrame, geometry: Patches, *, grouped_rows: int = GROUPED_ROWS) -> DataFrame:
    """(patch_id, g) as gram() has them, of packed series: small patches are cut inside blocks, large ones
    summed over partitions."""
    if geometry.volume > grouped_rows:
        return gram(extract(series, geometry))
    return tiling.each_patch(series, tiling.Tiles.of(geometry), _stack_grams, "patch_id int, g array<double>", _GRAMS)


def nuclear_norm(series: DataFrame, geometry: Patches) -> DataFrame:
    """One row (nn): the sum of nuclear norms over all patches."""
    return nuclear_norms(series, geometry).agg(F.coalesce(F.sum("nn"), F.lit(0.0)).alias("nn"))


def weighted_nuclear_norm(series: DataFrame, geometry: Patches, weights: DataFrame) -> DataFrame:
    """One row (nn): the mean over patches of weight times nuclear norm; patches whose leading
    singular value is zero count as zero. weights: (patch_id, weight)."""
    norms = nuclear_norms(series, geometry).join(weights, "patch_id")
    return norms.agg((F.sum(F.when(F.col("lead") > 0, F.col("weight") * F.col("nn")).otherwise(0.0)) / F.count(F.lit(1))).alias("nn"))


def closed_form(a: Column, b: Column, c: Column) -> tuple[Column, Column]:
    """Singular values of a matrix of rank two or less from its Gram matrix [[a, c], [c, b]]."""
    half, spread = (a + b) / 2, F.sqrt(F.pow((a - b) / 2, 2) + c * c)
    return F.sqrt(half + spread), F.sqrt(F.greatest(half - spread, F.lit(0.0)))


def threshold_two_voxels(pairs: DataFrame, beta: Column | float) -> DataFrame:
    """Patches of two voxels, real series, without a UDF. pairs: v0, v1 (arrays). Adds nn, s1, s2,
    and w0, w1, the thresholded series.

    With G the 2x2 Gram matrix of the rows, the result is h(G) X; h(G) = p I + q G takes the
    value max(s - beta, 0) / s at both squared singular values.
    """
    a, b, c = (array_dot(F.col(x), F.col(y)) for x, y in (("v0", "v0"), ("v1", "v1"), ("v0", "v1")))
    out = pairs.withColumns({"_a": a, "_b": b, "_c": c})
    s1, s2 = closed_form(F.col("_a"), F.col("_b"), F.col("_c"))
    out = out.withColumns({"s1": s1, "s2": s2})
    h = lambda s: F.when(F.col(s) > 0, F.greatest(F.col(s) - beta, F.lit(0.0)) / F.col(s)).otherwise(F.lit(0.0))
    gap = F.col("s1") * F.col("s1") - F.col("s2") * F.col("s2")
    out = out.withColumns({"_h1": h("s1"), "_h2": h("s2")})
    out = out.withColumn("_q", F.when(gap > 1e-12 * F.col("s1") * F.col("s1"), (F.col("_h1") - F.col("_h2")) / gap).otherwise(F.lit(0.0)))
    out = out.withColumn("_p", F.col("_h1") - F.col("_q") * F.col("s1") * F.col("s1"))
    mix = lambda own, d, other: F.zip_with(own, other, lambda u, v: (F.col("_p") + F.col("_q") * F.col(d)) * u + F.col("_q") * F.col("_c") * v)
    out = out.withColumns({"w0": mix("v0", "_a", "v1"), "w1": mix("v1", "_b", "v0"), "nn": F.col("s1") + F.col("s2")})
    return out.drop("_a", "_b", "_c", "_h1", "_h2", "_q", "_p")
