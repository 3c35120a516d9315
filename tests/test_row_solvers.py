"""Solvers whose gradient and proximal map work on the row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweave.operators import lowrank
from gridweave.operators.solvers import PerRow, solve

from .test_solvers import Y, table, vector


@pytest.mark.parametrize("mode", ["pgm", "fpgm", "pogm"])
@pytest.mark.parametrize("restart", ["none", "gr", "fr"])
def test_row_by_row(spark, mode, restart):
    """Maps on the row give what joined ones give; no iteration has a join or an exchange."""
    joined = lambda x, c: lowrank.shrink_voxels(x, 0.3 * c)
    rowwise = PerRow(lambda re, im, c: lowrank.shrunk(re, im, 0.3 * c))
    plans = []

    def per_row(re, im):
        return F.zip_with(re, F.col("a"), lambda v, w: v - w), im

    def cost(x):
        plans.append(x._jdf.queryExecution().executedPlan().toString())
        return x.agg(F.sum(lowrank.array_dot(F.col("re"), F.col("re")))).first()[0]

    options = dict(mode=mode, restart=restart, iterations=4, bsig=0.5, cost=cost)
    data = table(spark, Y).withColumn("a", F.transform("re", lambda v: v * -2))
    want = solve(table(spark, Y), lambda x: x.join(data.select("x", "y", "z", "a"), ["x", "y", "z"]).select("x", "y", "z", F.zip_with("re", "a", lambda v, w: v - w).alias("re"), "im"), 1.0, prox=joined, **options)
    plans.clear()
    got = solve(data, PerRow(per_row), 1.0, prox=rowwise, carry=("a",), **options)
    assert np.allclose(vector(got.x), vector(want.x)) and got.restarts == want.restarts
    plans.append(got.x._jdf.queryExecution().executedPlan().toString())
    assert not any("Join" in p or "Exchange" in p for p in plans)
