import numpy as np
import pytest

from gridweave.operators import lowrank as lr, tsqr
from gridweave.operators.patches import Patches, extract

PACKED = "x int, y int, z int, re array<double>, im array<double>"


def packed(spark, v):
    rows = [(x, y, z, v[x, y, z].real.tolist(), v[x, y, z].imag.tolist()) for x, y, z in np.ndindex(v.shape[:3])]
    return spark.createDataFrame(rows, PACKED)


def dense(df, shape):
    out = np.full(shape, np.nan, complex)
    for r in df.collect():
        out[r.x, r.y, r.z] = np.array(r.re) + 1j * np.array(r.im)
    return out


def random(shape, seed=0):
    rng = np.random.default_rng(seed)
    return rng.normal(size=shape) + 1j * rng.normal(size=shape)


def plain_svst(m, beta):
    u, s, vh = np.linalg.svd(m, full_matrices=False)
    return (u * np.maximum(s - beta, 0)) @ vh


def test_one_matrix():
    m = random((6, 4))
    s = np.linalg.svd(m, compute_uv=False)
    assert np.allclose(lr.svst(m, 1.0), plain_svst(m, 1.0))
    assert np.allclose(lr.svst(m, 0.0), m) and not lr.svst(m, s[0] + 1e-9).any()
    assert not lr.svst(np.zeros((3, 2)), 1.0).any()
    other = random((6, 4), 1)
    assert np.linalg.norm(lr.svst(m, 1.0) - lr.svst(other, 1.0)) <= np.linalg.norm(m - other)
    kept = lr.contrast_svst(m, 0.5)
    assert np.linalg.norm(kept, 2) == pytest.approx(s[0])
    assert not lr.contrast_svst(np.zeros((2, 2)), 0.5).any()


def test_fallback_decomposition(monkeypatch):
    def fails(*a, **k):
        raise np.linalg.LinAlgError

    for shape in ((7, 3), (3, 7)):
        m = random(shape)
        want = plain_svst(m, 1.0)
        with monkeypatch.context() as c:
            c.setattr(np.linalg, "svd", fails)
            assert np.allclose(lr.svst(m, 1.0), want)


@pytest.mark.parametrize("patch,stride,rows", [((2, 2, 1), (2, 2, 1), 4096), ((3, 2, 2), (1, 2, 1), 4096), ((4, 4, 2), (4, 4, 2), 1), ((2, 4, 2), (1, 4, 2), 1), ((1, 1, 1), (1, 1, 1), 4096), ((2, 2, 1), (3, 3, 1), 4096)])
def test_patch_svst(spark, patch, stride, rows):
    v = random((4, 4, 2, 5))
    g = Patches((4, 4, 2), patch, stride)
    series = packed(spark, v)
    total, count = np.zeros(v.shape, complex), np.zeros(v.shape[:3])
    at = {}
    for r in extract(series, g).collect():
        at.setdefault(r.patch_id, []).append((r.x, r.y, r.z))
    for cells in at.values():
        m = plain_svst(np.stack([v[c] for c in cells]), 1.5)
        for c, row in zip(cells, m):
            total[c] += row
            count[c] += 1
    got = dense(lr.patch_svst(series, g, 1.5, grouped_rows=rows), v.shape)
    assert np.allclose(got, total / np.maximum(count, 1)[..., None], atol=1e-8)


def test_thresholds_by_patch(spark):
    v = random((4, 2, 1, 3))
    g = Patches((4, 2, 1), (2, 2, 1), (2, 2, 1))
    betas = spark.createDataFrame([(0, 0.5), (1, 2.0)], "patch_id int, beta double")
    got = dense(lr.patch_svst(packed(spark, v), g, betas), v.shape)
    for k, b in ((0, 0.5), (1, 2.0)):
        m = v[2 * k : 2 * k + 2, :, 0].reshape(4, 3)
        assert np.allclose(got[2 * k : 2 * k + 2, :, 0].reshape(4, 3), plain_svst(m, b))


def test_norms(spark):
    v = random((4, 2, 1, 3))
    v[2:] = 0
    g = Patches((4, 2, 1), (2, 2, 1), (2, 2, 1))
    s = np.linalg.svd(v[:2, :, 0].reshape(4, 3), compute_uv=False)
    for rows in (4096, 1):
        got = {r.patch_id: (r.nn, r.lead) for r in lr.nuclear_norms(packed(spark, v), g, grouped_rows=rows).collect()}
        assert got[0] == pytest.approx((s.sum(), s[0])) and got[1] == pytest.approx((0, 0), abs=1e-6)
    assert lr.nuclear_norm(packed(spark, v), g).first().nn == pytest.approx(s.sum())
    weights = spark.createDataFrame([(0, 2.0), (1, 5.0)], "patch_id int, weight double")
    assert lr.weighted_nuclear_norm(packed(spark, v), g, weights).first().nn == pytest.approx(2 * s.sum() / 2)


def test_two_voxels(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=6).tolist(), rng.normal(size=6).tolist()) for k in range(8)]
    rows += [(8, [0.0] * 6, [0.0] * 6), (9, [3.0, 0, 0, 0, 0, 0], [0, 3.0, 0, 0, 0, 0]), (10, [1.0, 2, 3, 0, 0, 0], [2.0, 4, 6, 0, 0, 0])]
    rows = [(k, [float(x) for x in a], [float(x) for x in b]) for k, a, b in rows]
    for r in lr.threshold_two_voxels(spark.createDataFrame(rows, "k int, v0 array<double>, v1 array<double>"), 1.0).collect():
        m = np.array([r.v0, r.v1])
        assert np.allclose([r.w0, r.w1], plain_svst(m, 1.0), atol=1e-7)
        assert r.nn == pytest.approx(np.linalg.svd(m, compute_uv=False).sum(), abs=1e-6)


WIDE = np.logspace(0, -10, 6)


def wide(rows=32, seed=8):
    """A matrix of that spectrum, as a volume too."""
    rng = np.random.default_rng(seed)
    q = lambda n, k: np.linalg.qr(rng.normal(size=(n, k)) + 1j * rng.normal(size=(n, k)))[0]
    m = (q(rows, 6) * WIDE) @ q(6, 6)
    return m, m.reshape(4, 4, -1, 6)


@pytest.mark.parametrize("beta", [0.0, 1e-9, 1e-3])
def test_tall_patches_at_tiny_thresholds(spark, beta):
    """To working precision, where a Gram matrix can't tell values below 1e-8 of the leading one apart."""
    m, v = wide()
    g = Patches((4, 4, 2), (4, 4, 2), (4, 4, 2))
    got = np.zeros_like(v)
    for r in lr.patch_svst(packed(spark, v), g, beta, grouped_rows=1).collect():
        got[r.x, r.y, r.z] = np.array(r.re) + 1j * np.array(r.im)
    assert np.abs(got.reshape(32, 6) - plain_svst(m, beta)).max() < 1e-14


def test_tree_of_triangles(spark):
    """Over many tasks: the triangle has the singular values of the whole to working precision."""
    m, v = wide(16 * 40)
    g = Patches((4, 4, 40), (4, 4, 40), (4, 4, 40))
    series = packed(spark, v).repartition(37)
    row = lr.nuclear_norms(series, g, grouped_rows=1).first()
    assert row.nn == pytest.approx(WIDE.sum(), rel=1e-14) and row.lead == pytest.approx(1, rel=1e-14)
    r = tsqr.triangles(extract(series, g)).first()
    s = np.linalg.svd(tsqr.square(r.re, r.im), compute_uv=False)
    assert np.abs(s - WIDE).max() < 1e-15 and s[-1] == pytest.approx(1e-10, rel=1e-4)
    # The smallest one is lost in the Gram matrix.
    gram = np.linalg.eigvalsh(m.conj().T @ m)
    assert abs(np.sqrt(max(gram[0], 0)) - 1e-10) > 1e-11
    # Fewer rows than frames, and several patches.
    small, u = Patches((4, 2, 1), (2, 2, 1), (2, 2, 1)), random((4, 2, 1, 7), 3)
    got = {x.patch_id: x.nn for x in lr.nuclear_norms(packed(spark, u), small, grouped_rows=1).collect()}
    assert got == pytest.approx({k: np.linalg.svd(u[2 * k : 2 * k + 2].reshape(4, 7), compute_uv=False).sum() for k in range(2)})
