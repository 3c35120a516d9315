import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweave.functions import scalars
from gridweave.operators import analysis
from gridweave.schema import EPS32, PARAMETER_SETS, ReconConfig


def series(spark, values):
    return spark.createDataFrame([(k, 0, 0, t + 1, float(v.real), float(v.imag)) for k, row in enumerate(values) for t, v in enumerate(np.asarray(row, complex))], "x int, y int, z int, t int, re double, im double")


def test_detrend_line(spark):
    line = 3 + 0.2 * np.arange(1, 51)
    got = sorted(((r.t, r.re) for r in analysis.detrend(series(spark, [line])).collect()))
    assert np.allclose([v for _, v in got], 3.0)
    kept = analysis.detrend(series(spark, [line]), preserve_mean=True)
    assert np.allclose([r.re for r in kept.collect()], line.mean())


def test_detrend_random_and_single_frame(spark):
    v = np.random.default_rng(0).normal(size=(3, 9)) + 1j
    t = np.arange(1, 10)
    got = {(r.x, r.t): r.re for r in analysis.detrend(series(spark, v)).collect()}
    for k in range(3):
        slope = np.polyfit(t, v[k].real, 1)[0]
        assert np.allclose([got[k, i] for i in t], v[k].real - slope * t)
    assert analysis.detrend(series(spark, [[4.0]])).first().re == pytest.approx(2.0)


def test_tsnr_and_summary(spark):
    v = np.random.default_rng(1).normal(size=(4, 12)) * 0.1 + 2
    df = analysis.tsnr(series(spark, v), F.hypot("re", "im"))
    want = [a.mean() / (a.std(ddof=1) + EPS32) for a in np.abs(v)]
    assert np.allclose(sorted(r.tsnr for r in df.collect()), sorted(want))
    row = analysis.tsnr_summary(df.unionByName(df.limit(1).withColumn("tsnr", F.lit(-1.0)))).first()
    assert (row.mean_tsnr, row.max_tsnr) == (pytest.approx(np.mean(want)), pytest.approx(max(want)))
    flat = analysis.tsnr(series(spark, [[1.0, 1.0]]), F.col("re")).first().tsnr
    assert flat == pytest.approx(1 / EPS32)


def test_convergence(spark):
    table = analysis.convergence(spark, [(0, 5.0, 5.0, False), (1, 0.5, 0.5, True)])
    assert [(r.total, r.log_total) for r in table.orderBy("iter").collect()] == [(10.0, 1.0), (1.0, 0.0)]
    assert [r.iter for r in analysis.restart_marks(table).collect()] == [1]


def test_weights():
    # Computed from the published formula.
    golden = [(300, (90, 90, 60), 716.8458), (300, (30, 30, 30), 184.5689), (300, (10, 10, 10), 52.3915), (387, (90, 90, 60), 719.2503), (387, (6, 6, 6), 37.9878), (387, (1, 1, 1), 24.2909)]
    for frames, patch, want in golden:
        assert scalars.threshold_weight(patch, frames, (90, 90, 60)) == pytest.approx(want, abs=1e-4)
    assert scalars.lipschitz(3, 2.0) == 12.0 and scalars.next_t(1.0) == pytest.approx(1.618034)


def test_settings_round_trip():
    for c in PARAMETER_SETS.values():
        assert ReconConfig.from_json(c.to_json()) == c and c.scales == 3
    with pytest.raises(ValueError):
        ReconConfig((1, 1, 1), 1, 1, ((1, 1, 1),), ())


def test_detrend_and_tsnr_share_one_exchange(spark):
    plain = spark.range(64).selectExpr("cast(id % 8 as int) x", "0 y", "0 z", "cast(id div 8 + 1 as int) t", "cast(id * id as double) re", "0d im")
    plan = analysis.tsnr(analysis.detrend(plain), F.hypot("re", "im"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
