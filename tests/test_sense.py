import numpy as np
import pytest

from gridweave.operators import sense
from gridweave.operators.fourier import centred, dft

GRIDS = [(4, 4, 2), (5, 3, 3)]


def setting(spark, grid, coils=3, frames=3, seed=0, **options):
    rng = np.random.default_rng(seed)
    cell = rng.normal(size=(*grid, frames)) + 1j * rng.normal(size=(*grid, frames))
    maps = rng.normal(size=(coils, *grid)) + 1j * rng.normal(size=(coils, *grid))
    mask = rng.random((*grid, frames)) < 0.6
    image = spark.createDataFrame([(*i[:3], i[3] + 1, float(cell[i].real), float(cell[i].imag)) for i in np.ndindex(cell.shape)], "x int, y int, z int, t int, re double, im double")
    smaps = spark.createDataFrame([(*i[1:], i[0] + 1, float(maps[i].real), float(maps[i].imag)) for i in np.ndindex(maps.shape)], "x int, y int, z int, coil int, re double, im double")
    sampled = spark.createDataFrame([(*(int(a) for a in i[:3]), int(i[3]) + 1) for i in np.argwhere(mask)], "x int, y int, z int, t int")
    return cell, maps, mask, image, sense.SenseOp(grid, sampled, smaps, **options)


def plain_forward(cell, maps, mask, norm="ortho", forward=True):
    out = np.stack([centred(maps * cell[..., t], forward=forward, norm=norm) for t in range(cell.shape[-1])], -1)
    return out * mask


def dense(df, shape, coil=False):
    out = np.zeros(shape, complex)
    for r in df.collect():
        at = (r.x, r.y, r.z, r.t - 1)
        out[(r.coil - 1, *at) if coil else at] = r.re + 1j * r.im
    return out


@pytest.mark.parametrize("grid", GRIDS)
@pytest.mark.parametrize("options", [{}, {"unitary": False}, {"fft_forward": False}, {"fft_forward": False, "unitary": False}, {"max_map_bytes": 0}])
def test_forward_and_true_adjoint(spark, grid, options):
    cell, maps, mask, image, op = setting(spark, grid, **options)
    forward = op.forward(image)
    y = dense(forward, (3, *cell.shape), coil=True)
    way = options.get("fft_forward", True)
    norm = "ortho" if options.get("unitary", True) else "backward" if way else "forward"
    assert np.allclose(y, plain_forward(cell, maps, mask, norm, way))
    other = np.random.default_rng(5)
    z = (other.normal(size=y.shape) + 1j * other.normal(size=y.shape)) * mask
    samples = spark.createDataFrame([(*i[1:4], i[0] + 1, i[4] + 1, float(z[i].real), float(z[i].imag)) for i in np.ndindex(z.shape) if z[i]], "x int, y int, z int, coil int, t int, re double, im double")
    back = dense(op.adjoint(samples), cell.shape)
    assert np.vdot(z, y) == pytest.approx(np.vdot(back, cell))
    gradient = dense(op.gradient(image, samples), cell.shape)
    both = dense(op.adjoint(op.residual(image, samples)), cell.shape)
    assert np.allclose(gradient, both)
    assert op.cost(image, samples) == pytest.approx(0.5 * np.sum(np.abs(y - z) ** 2))


def test_unitary_with_full_sampling(spark):
    grid = (5, 3, 3)
    cell, maps, _, image, op = setting(spark, grid)
    from gridweave.operators.kspace import normalise_maps

    full = image.select("x", "y", "z", "t")
    unit = sense.SenseOp(grid, full, normalise_maps(op.maps))
    assert np.allclose(dense(unit.adjoint(unit.forward(image)), cell.shape), cell, atol=1e-5)


def test_combination(spark):
    cell, maps, mask, image, op = setting(spark, (5, 3, 3))
    kspace = op.forward(image)
    y = dense(kspace, (3, *cell.shape), coil=True)
    coils = np.stack([centred(y[..., t], forward=False, norm="backward") for t in range(3)], -1)
    want = (maps.conj()[..., None] * coils).sum(0) / ((np.abs(maps) ** 2).sum(0) + np.finfo(np.float32).eps)[..., None]
    assert np.allclose(dense(sense.sense_combine(kspace, op.maps, (5, 3, 3)), cell.shape), want)


def test_dft_against_numpy(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(2, 15)) + 1j * rng.normal(size=(2, 15))
    df = spark.createDataFrame([(g, t, float(v[g, t].real), float(v[g, t].imag)) for g, t in np.ndindex(v.shape)], "g int, t int, re double, im double")
    for options, want in (({}, np.fft.fft(v)), ({"inverse": True}, np.fft.ifft(v)), ({"unitary": True}, np.fft.fft(v, norm="ortho")), ({"unitary": True, "inverse": True}, np.fft.ifft(v, norm="ortho"))):
        got = np.zeros(v.shape, complex)
        for r in dft(df, 15, keys=("g",), **options).collect():
            got[r.g, r.k] = r.re + 1j * r.im
        assert np.allclose(got, want)


def test_pack_round_trip(spark):
    cell, _, _, image, _ = setting(spark, (4, 4, 2))
    assert np.allclose(dense(sense.unpack(sense.pack(image)), cell.shape), cell)
