"""Windows against a plain enumeration, and their recombination."""

import math

import numpy as np
import pytest

from gridweave.operators.patches import Axis, Patches, combine, combine_packed, extract, fill_uncovered

CASES = [
    ((10, 10, 5), (6, 6, 3), (3, 3, 2), "clamp"),
    ((10, 10, 5), (2, 2, 2), (4, 4, 4), "clamp"),
    ((4, 4, 2), (8, 8, 8), (8, 8, 8), "clamp"),
    ((7, 5, 1), (3, 3, 1), (3, 1, 1), "clamp"),
    ((1, 7, 7), (1, 3, 3), (1, 3, 3), "drop_tail"),
    ((1, 7, 7), (1, 3, 3), (1, 2, 1), "drop_tail"),
    ((2, 2, 2), (1, 3, 1), (1, 1, 1), "drop_tail"),
]


def plain(grid, patch, stride, mode):
    """{(patch_id, vox): voxel}, patches and voxels with x fastest."""
    axes = []
    for n, p, s in zip(grid, patch, stride):
        p = min(p, n) if mode == "clamp" else p
        last = math.ceil((n - p) / s) if mode == "clamp" else (n - p) // s
        axes.append((p, [min(i * s, n - p) if mode == "clamp" else i * s for i in range(last + 1)] if n >= p else []))
    out, patch_id = {}, 0
    for oz in axes[2][1]:
        for oy in axes[1][1]:
            for ox in axes[0][1]:
                vox = 0
                for dz in range(axes[2][0]):
                    for dy in range(axes[1][0]):
                        for dx in range(axes[0][0]):
                            out[patch_id, vox] = (ox + dx, oy + dy, oz + dz)
                            vox += 1
                patch_id += 1
    return out


def volume(spark, grid, frames=2, seed=0):
    v = np.random.default_rng(seed).normal(size=(*grid, frames))
    rows = [(x, y, z, t + 1, float(v[x, y, z, t])) for x, y, z, t in np.ndindex(v.shape)]
    return spark.createDataFrame(rows, "x int, y int, z int, t int, v double"), v


@pytest.mark.parametrize("grid,patch,stride,mode", CASES)
def test_extract_and_combine(spark, grid, patch, stride, mode):
    series, v = volume(spark, grid)
    g = Patches(grid, patch, stride, mode)
    want = plain(grid, patch, stride, mode)
    got = [(r.patch_id, r.vox, r.x, r.y, r.z) for r in extract(series.where("t = 1"), g).collect()]
    assert sorted(got) == sorted((*k, *c) for k, c in want.items())
    assert g.count == len({p for p, _ in want})
    covered = set(want.values())
    assert g.covers == (len(covered) == math.prod(grid))
    assert g.disjoint == (len(covered) == len(want))
    back = {(r.x, r.y, r.z, r.t): r.v for r in fill_uncovered(combine(extract(series, g)), series).collect()}
    for x, y, z, t in np.ndindex(v.shape):
        assert back[x, y, z, t + 1] == pytest.approx(v[x, y, z, t] if (x, y, z) in covered else 0.0)


def test_packed_average(spark):
    g = Patches((3, 1, 1), (2, 1, 1), (1, 1, 1))
    rows = [(0, 0, 0, [1.0], [0.0]), (1, 0, 0, [2.0], [1.0]), (1, 0, 0, [4.0], [3.0]), (2, 0, 0, [5.0], [5.0])]
    got = {r.x: (r.re, r.im) for r in combine_packed(spark.createDataFrame(rows, "x int, y int, z int, re array<double>, im array<double>"), g).collect()}
    assert got == {0: ([1.0], [0.0]), 1: ([3.0], [2.0]), 2: ([5.0], [5.0])}


def test_no_shuffle_no_join(spark):
    series, _ = volume(spark, (4, 4, 2))
    plan = extract(series, Patches((4, 4, 2), (3, 3, 2), (1, 1, 1)))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_bad_geometry():
    with pytest.raises(ValueError):
        Axis(5, 0, 1)
    with pytest.raises(ValueError):
        Patches((1, 1, 1), (1, 1, 1), (1, 1, 1), "wrap")
