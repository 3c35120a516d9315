import numpy as np
import pytest

from gridweave.operators import kspace as ks

SCHEMA = "x int, y int, z int, coil int, t int, re double, im double"


def samples(spark, cells, coils=2):
    return spark.createDataFrame([(x, 0, 0, c, t, float(10 * x + t), float(c)) for x, t in cells for c in range(1, coils + 1)], SCHEMA)


def test_nearest_frame_takes_the_earlier_of_two(spark):
    rng = np.random.default_rng(1)
    frames = 12
    cells = {(0, 2), (0, 4), (1, 12), (2, 1), (3, 5), (3, 6), (3, 11)} | {(x, int(t)) for x in range(4, 20) for t in rng.integers(1, frames + 1, 4)}
    got = {(r.x, r.t): r.t_src for r in ks.nearest_frame(spark.createDataFrame([(x, 0, 0, t, 0.0, 0.0) for x, t in cells], "x int, y int, z int, t int, re double, im double"), frames).collect()}
    want = {}
    for x in {x for x, _ in cells}:
        own = sorted(t for y, t in cells if y == x)
        for t in range(1, frames + 1):
            want[x, t] = min(own, key=lambda s: (abs(s - t), s))
    assert got == want and got[0, 3] == 2


def test_viewshare_applies_coil_one_to_all(spark):
    k = samples(spark, [(0, 1), (0, 4)]).where("not (coil = 2 and t = 4)")
    got = sorted((r.coil, r.t, r.t_src) for r in ks.viewshare(k, 4).collect())
    assert got == [(1, 1, 1), (1, 2, 1), (1, 3, 4), (1, 4, 4), (2, 1, 1), (2, 2, 1)]


def test_validation(spark):
    good = samples(spark, [(0, 1), (1, 1), (2, 2), (0, 2)])
    assert ks.validate(good, (4, 1, 1), 2, 2) == 2.0
    for bad, says in ((good.where("not (x = 0 and coil = 2 and t = 1)"), "coils"), (good.where("not (x = 0 and t = 1)"), "frames"), (good.withColumn("x", good.x + 3), "shape")):
        with pytest.raises(ValueError, match=says):
            ks.validate(bad, (4, 1, 1), 2, 2)


def test_compact_scatter_and_mask(spark):
    k = samples(spark, [(0, 1), (1, 2)])
    zero = spark.createDataFrame([(5, 0, 0, 1, 1, 0.0, 0.0)], SCHEMA)
    both = k.unionByName(zero)
    assert {(r.x, r.t) for r in ks.sampling_mask(both).collect()} == {(0, 1), (1, 2)}
    assert ks.compact(both, ks.sampling_mask(both)).count() == 4
    cells = spark.createDataFrame([(x, 0, 0, t) for x in range(2) for t in (1, 2)], "x int, y int, z int, t int")
    dense = {(r.x, r.t): r.re for r in ks.scatter(k.where("coil = 1"), cells).collect()}
    assert dense == {(0, 1): 1.0, (0, 2): 0.0, (1, 1): 0.0, (1, 2): 12.0}


def test_quantile_and_normalisation(spark):
    v = np.random.default_rng(2).normal(size=200)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    scale = ks.quantile_scale(df, df.v).first().scale
    assert scale == pytest.approx(np.quantile(v, 0.99))
    k = samples(spark, [(1, 1)])
    assert ks.normalise(k, 0.0).first().re == pytest.approx(11 / ks.EPS32)
    maps = ks.normalise_maps(spark.createDataFrame([(0, 0, 0, 1, 3.0, 0.0), (0, 0, 0, 2, 0.0, 4.0)], "x int, y int, z int, coil int, re double, im double"))
    assert {(r.coil): (r.re, r.im) for r in maps.collect()} == {1: (pytest.approx(0.6), 0.0), 2: (0.0, pytest.approx(0.8))}


def counted(spark, df):
    """The same rows, and a counter of how many were read."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema), seen


@pytest.mark.parametrize("q", [0.0, 0.5, 0.99, 1.0])
@pytest.mark.parametrize("kind", ["normal", "ties", "constant", "heavy"])
def test_quantile_takes_two_scans(spark, monkeypatch, q, kind):
    monkeypatch.setattr(ks, "_FEW", 50)
    rng = np.random.default_rng(4)
    n = 30_000
    v = {"normal": rng.normal(size=n), "ties": rng.integers(0, 40, n).astype(float), "constant": np.full(n, 2.5), "heavy": np.exp(8 * rng.normal(size=n))}[kind]
    df, seen = counted(spark, spark.createDataFrame([(float(x),) for x in v], "v double").repartition(6))
    assert ks.quantile_scale(df, df.v, q).first().scale == pytest.approx(np.quantile(v, q), rel=1e-12)
    assert seen.value == 2 * n


def test_quantile_widens_a_bracket_that_misses(spark, monkeypatch):
    monkeypatch.setattr(ks, "_RANK_ERROR", 1e-9)
    monkeypatch.setattr(ks, "_SKETCH", 8)
    v = np.random.default_rng(5).permutation(20_000).astype(float)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    for q in (0.25, 0.99):
        assert ks.quantile_scale(df, df.v, q).first().scale == pytest.approx(np.quantile(v, q))


def test_quantile_without_values(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert ks.quantile_scale(df, df.v).first().scale is None and ks.quantile_scale(df.limit(0), df.v).first().scale is None


def test_validation_reads_once(spark):
    df, seen = counted(spark, samples(spark, [(0, 1), (1, 1), (2, 2), (0, 2)]))
    assert ks.validate(df, (4, 1, 1), 2, 2) == 2.0 and seen.value == 8
