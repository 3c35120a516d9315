"""Pencil transforms against numpy, their bounds and plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweave.operators import pencils, sense
from gridweave.operators.fourier import centred

from .test_sense import dense, plain_forward, setting


def table(spark, v):
    return spark.createDataFrame([(*i[1:], int(i[0]), 1, float(v[i].real), float(v[i].imag)) for i in np.ndindex(v.shape) if v[i]], "x int, y int, z int, coil int, t int, re double, im double")


@pytest.mark.parametrize("shape", [(4, 6, 2), (5, 7, 3), (9, 4, 5), (1, 8, 1)])
@pytest.mark.parametrize("forward,norm", [(True, "ortho"), (False, "backward")])
def test_against_numpy(spark, shape, forward, norm):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(2, *shape)) + 1j * rng.normal(size=(2, *shape))
    v[rng.random(v.shape) < 0.3] = 0  # absent cells
    got = np.zeros_like(v)
    for r in pencils.transform(table(spark, v), shape, forward=forward, norm=norm, chunk=3).collect():
        got[r.coil, r.x, r.y, r.z] = r.re + 1j * r.im
    assert np.allclose(got, np.stack([centred(x, forward=forward, norm=norm) for x in v]))


def test_bars_are_bounded_and_exchanges_are_few(spark):
    shape = (40, 36, 8)
    cells = spark.range(40 * 36 * 8).selectExpr("cast(id % 40 as int) x", "cast(id div 40 % 36 as int) y", "cast(id div 1440 as int) z", "1 coil", "1 t", "1d re", "0d im")
    found = pencils.bars(cells, shape, forward=True)
    c = pencils.CHUNK
    assert found.agg(F.max(F.size("re"))).first()[0] == c * c * 8 and found.count() == 3 * 3
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3 and "Join" not in plan


def test_bitmaps(spark):
    rng = np.random.default_rng(2)
    shape, chunk = (7, 5, 3), 3
    inside = rng.random((*shape, 2)) < 0.4
    mask = spark.createDataFrame([(int(x), int(y), int(z), int(t) + 1) for x, y, z, t in np.argwhere(inside)], "x int, y int, z int, t int")
    got = np.zeros_like(inside)
    for r in pencils.mask_bitmaps(mask, shape, chunk).collect():
        w, h = min(chunk, 7 - r.xb * chunk), min(chunk, 5 - r.yb * chunk)
        at = np.flatnonzero(np.unpackbits(np.frombuffer(r.bits, np.uint8), count=w * h * 3))
        got[at % w + r.xb * chunk, at // w % h + r.yb * chunk, at // (w * h), r.t - 1] = True
    assert (got == inside).all()
    whole = pencils.mask_bitmaps(mask, shape, None).collect()
    assert {r.t: int(np.unpackbits(np.frombuffer(r.bits, np.uint8)).sum()) for r in whole} == {t + 1: int(inside[..., t].sum()) for t in range(2)}


def test_large_volumes_go_by_pencils(spark, monkeypatch):
    monkeypatch.setattr(sense, "MAX_VOLUME_BYTES", 0)
    cell, maps, mask, image, op = setting(spark, (5, 3, 3), max_map_bytes=0, chunk=2)
    assert np.allclose(dense(op.forward(image), (3, *cell.shape), coil=True), plain_forward(cell, maps, mask))
    kspace = op.forward(image)
    y = dense(kspace, (3, *cell.shape), coil=True)
    coils = np.stack([centred(y[..., t], forward=False, norm="backward") for t in range(3)], -1)
    want = (maps.conj()[..., None] * coils).sum(0) / ((np.abs(maps) ** 2).sum(0) + np.finfo(np.float32).eps)[..., None]
    assert np.allclose(dense(sense.sense_combine(kspace, op.maps, (5, 3, 3)), cell.shape), want)


def test_only_samples_leave_and_nothing_is_joined_by_cell(spark):
    for limit in (sense.MAX_MAP_BYTES, 0):
        cell, maps, mask, image, op = setting(spark, (4, 4, 2), max_map_bytes=limit)
        samples = op.forward(image)
        assert samples.count() == 3 * mask.sum()
        for df in (samples, op._fused(image, samples, lambda t, m, away: None, "c double"), op.gradient(image, samples)) if limit else (samples,):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert all(not (", coil" in line and "Join" in line and ", y#" in line) for line in plan.splitlines())
            assert not limit or "Join" not in plan


def test_frames_without_cells_or_samples(spark):
    cell, maps, mask, image, op = setting(spark, (4, 4, 2))
    y = op.forward(image)
    less = image.where("t <> 2")
    got = dense(op.forward(less), (3, *cell.shape), coil=True)
    assert not got[..., 1].any() and np.allclose(got[..., 0], dense(y, (3, *cell.shape), coil=True)[..., 0])
    # The residual of an absent frame is what was measured.
    assert op.cost(less, y) == pytest.approx(0.5 * float(np.sum(np.abs(dense(y, (3, *cell.shape), coil=True)[..., 1]) ** 2)))
    assert op.cost(image, y.where("t <> 2")) == pytest.approx(op.cost(less, y))
    nothing = y.where("false")
    assert op.adjoint(nothing).count() == 0
