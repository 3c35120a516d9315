"""Halo tiling against plain numpy over whole volumes, and its plan."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweave.operators import lowrank as lr, tiling
from gridweave.operators.patches import Patches, extract

from .test_lowrank import packed, plain_svst, random
from .test_patches import plain

CASES = [
    ((10, 9, 5), (6, 6, 3), (3, 3, 2), "clamp", (4, 4, 2)),
    ((10, 9, 5), (4, 3, 2), (1, 2, 1), "clamp", (3, 1, 5)),
    ((9, 7, 4), (2, 2, 2), (4, 3, 2), "clamp", (4, 4, 4)),
    ((8, 8, 4), (4, 4, 2), (4, 4, 2), "clamp", (4, 8, 3)),
    ((3, 8, 7), (1, 3, 4), (1, 2, 3), "drop_tail", (1, 4, 2)),
    ((4, 4, 2), (8, 8, 8), (8, 8, 8), "clamp", (2, 2, 2)),
]


def test_morton(spark):
    places = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (5, 9, 1000), (2**21 - 1, 0, 2**20), (2**21 - 1,) * 3]
    df = spark.createDataFrame(places, "x int, y int, z int").select("*", tiling.morton(F.col("x"), F.col("y"), F.col("z")).alias("key"))
    assert [tiling.from_morton(r.key) for r in df.collect()] == places
    assert [r.key for r in df.collect()][1:4] == [1, 2, 4]


@pytest.mark.parametrize("grid,patch,stride,mode,block", CASES)
def test_blocks_have_what_their_patches_need(spark, grid, patch, stride, mode, block):
    g = Patches(grid, patch, stride, mode)
    tiles = tiling.Tiles(g, block)
    cells = spark.createDataFrame([(*i, [1.0], [0.0]) for i in np.ndindex(grid)], "x int, y int, z int, re array<double>, im array<double>")
    sent = {}
    for r in tiles.send(cells).collect():
        sent.setdefault(r.block, []).append((r.x, r.y, r.z))
    held = {}
    for (p, _), voxel in plain(grid, patch, stride, mode).items():
        held.setdefault(p, set()).add(voxel)
    owners = {r.id: r.b for r in spark.range(g.count).select("id", tiles.owner(F.col("id")).alias("b")).collect()}
    need = {}
    for p, voxels in held.items():
        need.setdefault(owners[p], set()).update(voxels)
    assert {b: sorted(v) for b, v in need.items()} == {b: sorted(v) for b, v in sent.items()}
    copies = sum(map(len, sent.values()))
    assert copies <= tiles.most_copies() * math.prod(grid) or grid == (4, 4, 2)
    assert copies <= sum(map(len, held.values()))


@pytest.mark.parametrize("grid,patch,stride,mode,block", CASES[:5])
def test_shrink_against_whole_volume(spark, grid, patch, stride, mode, block, monkeypatch):
    monkeypatch.setattr(tiling, "STACK_BYTES", 3000)
    g, v = Patches(grid, patch, stride, mode), random((*grid, 4), 2)
    v[:2, :3] = 0
    gone = (0, 0, 0)
    held = {}
    for (p, _), voxel in plain(grid, patch, stride, mode).items():
        if voxel != gone:
            held.setdefault(p, []).append(voxel)
    series = packed(spark, v).where("x + y + z > 0")
    betas = {p: 0.5 + p % 3 for p in held if p % 4 != 1}
    table = spark.createDataFrame(list(betas.items()), "patch_id int, beta double")
    for beta, by in ((1.5, dict.fromkeys(held, 1.5)), (table, betas)):
        total, n = np.zeros(v.shape, complex), np.zeros(grid)
        for p, b in by.items():
            at = tuple(np.array(held[p]).T)
            total[at] += plain_svst(v[at], b)
            n[at] += 1
        got = {(r.x, r.y, r.z): np.array(r.re) + 1j * np.array(r.im) for r in tiling.shrink(series, tiling.Tiles(g, block), lr.shrink_stack, beta).collect()}
        assert set(got) == {tuple(int(a) for a in i) for i in np.argwhere(n > 0)}
        for i, x in got.items():
            assert np.allclose(x, total[i] / n[i])


def test_contrast_and_failing_decompositions(monkeypatch):
    m = np.stack([random((5, 3), k) for k in range(4)] + [np.zeros((5, 3), complex)])
    beta = np.array([0.1, 0.5, 0.99, 2.0, 1.0])
    want = np.stack([lr.contrast_svst(x, b) for x, b in zip(m, beta)])
    assert np.allclose(lr.contrast_stack(m, beta), want)
    plain_one = np.stack([lr.svst(x, b) for x, b in zip(m, beta)])
    assert np.allclose(lr.shrink_stack(m, beta), plain_one)

    def fails(*a, **k):
        raise np.linalg.LinAlgError

    monkeypatch.setattr(np.linalg, "svd", fails)
    assert np.allclose(lr.shrink_stack(m, beta), plain_one)


def test_grams_and_norms(spark):
    grid = (7, 6, 3)
    g, v = Patches(grid, (4, 3, 2), (2, 2, 1)), random((*grid, 3), 5)
    one = {r.patch_id: r.g for r in lr.grams(packed(spark, v), g).collect()}
    other = {r.patch_id: r.g for r in lr.gram(extract(packed(spark, v), g)).collect()}
    assert one.keys() == other.keys() and all(np.allclose(one[p], other[p]) for p in one)
    norms = {r.patch_id: r.nn for r in lr.nuclear_norms(packed(spark, v), g).collect()}
    by = {p: np.array(x) for p, x in other.items()}
    for p, flat in by.items():
        m = flat[:9].reshape(3, 3) + 1j * flat[9:].reshape(3, 3)
        assert norms[p] == pytest.approx(np.sqrt(np.maximum(np.linalg.eigvalsh(m), 0)).sum())


def test_plan_and_copies(spark):
    """Six-voxel patches at stride three: an exploded volume has eight copies, tiles two to three; one exchange
    brings voxels to their blocks, one adds up sums, and nothing is grouped by patch."""
    g = Patches((90, 90, 60), (6, 6, 6), (3, 3, 3))
    tiles = tiling.Tiles.of(g)
    h = 5
    cells = spark.range(90 * 90 * 60).selectExpr("cast(id % 90 as int) x", "cast(id div 90 % 90 as int) y", "cast(id div 8100 as int) z", "array(1d) re", "array(0d) im")
    copies = tiles.send(cells).count() / (90 * 90 * 60)
    assert copies <= math.prod((b + h) / b for b in tiles.block) <= math.prod((b + 2 * h) / b for b in tiles.block) and copies < 2.5
    assert tiling.Tiles.of(Patches((90, 90, 60), (16, 16, 16), (8, 8, 8))).most_copies() < 64
    plan = tiling.shrink(cells, tiles, lr.shrink_stack, 1.0)._jdf.queryExecution().executedPlan().toString()
    exchanges = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
    assert [re.sub(r"#\d+L?", "", e) for e in exchanges] == ["x, y, z", "block"] and "Join" not in plan


def test_empty_series_and_unequal_lengths(spark):
    g = Patches((4, 4, 2), (2, 2, 2), (1, 1, 1))
    none = spark.createDataFrame([], "x int, y int, z int, re array<double>, im array<double>")
    assert lr.patch_svst(none, g, 1.0).collect() == [] and lr.nuclear_norms(none, g).collect() == []
    bad = spark.createDataFrame([(0, 0, 0, [1.0], [1.0]), (1, 0, 0, [1.0, 2.0], [1.0, 2.0])], none.schema)
    with pytest.raises(Exception, match="number of frames"):
        lr.patch_svst(bad, g, 1.0).collect()
