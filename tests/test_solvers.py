"""The solvers against a plain numpy restatement of the published iterations."""

import math

import numpy as np
import pytest

from gridweave.operators.solvers import power_iteration, solve

N = 6
RNG = np.random.default_rng(0)
D = np.linspace(0.3, 1.0, N)
Y = RNG.normal(size=N) * 3
PACKED = "x int, y int, z int, re array<double>, im array<double>"


def table(spark, v):
    v = np.asarray(v, complex)
    return spark.createDataFrame([(k, 0, 0, [float(v[k].real)], [float(v[k].imag)]) for k in range(len(v))], PACKED)


def vector(df):
    out = np.zeros(N, complex)
    for r in df.collect():
        out[r.x] = r.re[0] + 1j * r.im[0]
    return out


def gradient(df):
    return df.selectExpr("x", "y", "z", "re", "im").join(_weights(df.sparkSession), "x").selectExpr("x", "y", "z", "array(d * d * re[0] - d * v) re", "array(d * d * im[0]) im")


def _weights(spark):
    return spark.createDataFrame([(k, float(D[k]), float(Y[k])) for k in range(N)], "x int, d double, v double")


def prox(df, c):
    return df.selectExpr("x", "y", "z", f"array(signum(re[0]) * greatest(abs(re[0]) - {0.4 * c!r}, 0)) re", "im")


def shrink(v, c):
    return np.sign(v) * np.maximum(np.abs(v) - 0.4 * c, 0)


def plain(mode, n, restart=True, mu=0.0, alias=False):
    grad = lambda x: D * D * x - D * Y
    x = y = u = z = np.zeros(N)
    g_old = np.zeros(N)
    t = sigma = zeta = 1.0
    alpha = 2 / (1 + mu) if mode == "pgm" and mu else 1.0
    marks = [False]
    for k in range(1, n + 1):
        d = grad(x)
        if mode == "pogm":
            u2 = x - alpha * d
            if mu:
                root = math.sqrt(mu * mu + 8 * mu)
                beta, gamma, t2 = (2 + mu - root) ** 2 / (4 * (1 - mu)), (2 + mu - root) / 2, t
            else:
                t2 = (1 + math.sqrt(1 + (8 if k == n else 4) * t * t)) / 2
                beta, gamma = (t - 1) / t2, sigma * t / t2
            z2 = u2 + beta * (u2 - u) + gamma * (u2 - x) - (0 if alias else beta * alpha / zeta * (x - z))
            zeta = alpha * (1 + beta + gamma)
            x2 = shrink(z2, zeta)
            z2 = x2 if alias else z2
            g = d - (x2 - z2) / zeta
            y2 = x - alpha * g
        else:
            y2 = shrink(x - alpha * d, alpha)
            g = -(y2 - x) / alpha
            u2, z2 = u, z
        again = restart and -(g * (y2 - y)).sum() <= 0
        if mode == "pogm":
            if again:
                t2 = sigma = 1.0
            t = t2
        elif mode == "fpgm":
            t = 1.0 if again else t
            if mu:
                beta = (1 - math.sqrt(mu)) / (1 + math.sqrt(mu))
            else:
                t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
                beta, t = (t - 1) / t2, t2
            x2 = y2 + beta * (y2 - y)
        else:
            x2 = y2
        marks.append(bool(again))
        x, y, u, z, g_old = x2, y2, u2, z2, g
    return (x if mode == "pogm" else y), marks


@pytest.mark.parametrize("mode,mu,alias", [("pgm", 0.0, False), ("pgm", 0.09, False), ("fpgm", 0.0, False), ("fpgm", 0.09, False), ("pogm", 0.0, False), ("pogm", 0.09, False), ("pogm", 0.0, True)])
def test_iterates(spark, mode, mu, alias):
    got = solve(table(spark, np.zeros(N)), gradient, 1.0, prox=prox, mode=mode, iterations=5, mu=mu, parity_alias=alias)
    want, marks = plain(mode, 5, mu=mu, alias=alias)
    assert np.allclose(vector(got.x).real, want) and got.restarts == marks


def test_cost_restart_log_and_argument_checks(spark):
    seen = []
    cost = lambda df: float(sum((D[r.x] * r.re[0] - Y[r.x]) ** 2 / 2 + 0.4 * abs(r.re[0]) for r in df.collect()))
    got = solve(table(spark, np.zeros(N)), gradient, 1.0, prox=prox, cost=cost, restart="fr", iterations=3, fun=lambda k, x, y, again: seen.append((k, cost(x))) or k)
    assert [k for k, _ in seen] == [0, 1, 2, 3] and [e[0] for e in got.log] == [0, 1, 2, 3]
    assert seen[-1][1] < seen[0][1]
    for bad in ({"mode": "x"}, {"restart": "x"}, {"restart": "fr"}, {"iterations": -1}, {"mu": 2.0}, {"bsig": -0.5}):
        with pytest.raises(ValueError):
            solve(table(spark, np.zeros(N)), gradient, 1.0, **bad)


def test_no_iteration_returns_the_start(spark):
    assert np.allclose(vector(solve(table(spark, Y), gradient, 1.0, iterations=0).x), Y)


def test_power_iteration(spark):
    scale = lambda power: lambda df: df.join(_weights(spark), "x").selectExpr("x", "y", "z", f"array(re[0] * pow(d, {power})) re", f"array(im[0] * pow(d, {power})) im")
    x, value = power_iteration(scale(2), scale(1), table(spark, np.ones(N)), iterations=8, tolerance=1e-9)
    v = np.ones(N)
    for _ in range(8):
        v = D * D * v
        v /= np.linalg.norm(v)
    assert value == pytest.approx(np.linalg.norm(D * v)) and np.allclose(vector(x).real, v)


def test_state_does_not_move(spark):
    """State and a slope that follows from it row by row are joined in their buckets; of a slope from
    elsewhere, the slope alone is exchanged."""
    plans = {}

    def step(x):
        plans["own"] = x.join(x.selectExpr("x", "y", "z", "transform(re, v -> v / 2) d"), ["x", "y", "z"])
        other = x.groupBy("x", "y", "z").agg({"re": "max"})
        plans["grouped"] = x.join(other, ["x", "y", "z"])
        plans["elsewhere"] = x.join(table(spark, Y), ["x", "y", "z"])
        plans.update({k: (v._jdf.queryExecution().executedPlan().toString() if not isinstance(v, str) else v) for k, v in plans.items()})
        return x.selectExpr("x", "y", "z", "transform(re, v -> v / 2) re", "im")

    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    before = {t.name for t in spark.catalog.listTables()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = solve(table(spark, Y), step, 1.0, mode="pogm", iterations=2)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert [plans[k].count("Exchange hashpartitioning") for k in ("own", "grouped", "elsewhere")] == [0, 0, 1]
    assert np.isfinite(vector(found.x)).all()
    # One table is left, the one that the solution reads.
    assert len({t.name for t in spark.catalog.listTables()} - before) == 1


@pytest.mark.parametrize("bad", [{"lipschitz": 0.0}, {"lipschitz": -1.0}, {"mu": -0.1}, {"mu": 1.0}, {"cutoff": 1.0}, {"cutoff": -1.0}, {"bsig": -1.0}, {"iterations": -1}, {"mode": "gd"}, {"restart": "now"}, {"restart": "fr"}])
def test_settings_are_checked(spark, bad):
    """A bound of zero is refused as well as negative ones: the step is its inverse."""
    settings = {"lipschitz": 1.0, **bad}
    with pytest.raises(ValueError):
        solve(table(spark, Y), gradient, settings.pop("lipschitz"), **settings)


def test_cutoff_near_its_limits(spark):
    """A cutoff near 1 restarts unless slope and step are all but opposite, as they are in the first iteration; one near -1
    restarts nowhere here."""
    runs = {c: solve(table(spark, Y), gradient, 1.0, prox=prox, iterations=4, cutoff=c).restarts[1:] for c in (0.999, -0.999)}
    assert runs[0.999] == [False, True, True, True] and not any(runs[-0.999])
