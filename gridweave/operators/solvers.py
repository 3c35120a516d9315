"""First-order proximal solvers on tables, and power iteration.

The state of a solver is one table with a column per iterate; it is written to the shared folder
each iteration, so plans stay short and a lost executor costs at most one iteration. It is bucketed by its
keys: neither the gradient nor the proximal point that is joined to it makes it move, and a gradient or proximal map
that works row by row joins it without any exchange.
Iterates are packed rows: keys (say scale, x, y, z) and arrays re, im. Only what a later step reads is written.

A gradient or proximal map that is a PerRow is an expression over the row, and what it needs besides may be carried
along with the state: then nothing is joined. If both are, an iteration is one pass over the
state, without any exchange.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.functions.complexes import array_dot, linear
from gridweave.functions.scalars import next_t, strongly_convex_momentum
from gridweave.scratch import Scratch

Gradient = Callable[[DataFrame], DataFrame]
Prox = Callable[[DataFrame, float], DataFrame]
PARTS = ("re", "im")


@dataclass(frozen=True)
class PerRow:
    """A gradient (re, im) -> (re, im), or a proximal map (re, im, c) -> (re, im), on columns of packed rows."""

    of: Callable[..., tuple[Column, Column]]

    def named(self, name: str, source: str, *rest: float) -> dict[str, Column]:
        return dict(zip((f"{name}_{p}" for p in PARTS), self.of(*(F.col(f"{source}_{p}") for p in PARTS), *rest)))


@dataclass
class Solution:
    """x: the last iterate (keys, re, im). log: (iteration, value of ``fun``, restarted)."""

    x: DataFrame
    log: list[tuple] = field(default_factory=list)
    restarts: list[bool] = field(default_factory=list)


def _named(df: DataFrame, keys: tuple[str, ...], name: str) -> DataFrame:
    return df.select(*keys, *(F.col(p).alias(f"{name}_{p}") for p in PARTS))


def _iterate(state: DataFrame, keys: tuple[str, ...], name: str) -> DataFrame:
    return state.select(*keys, *(F.col(f"{name}_{p}").alias(p) for p in PARTS))


def _mix(name: str, *terms: tuple[float, str]) -> dict:
    return {f"{name}_{p}": linear(*((c, F.col(f"{n}_{p}")) for c, n in terms if c != 0 or len(terms) == 1)) for p in PARTS}


def _real_dot(a: str, b: str, conjugate: bool):
    """Sum of real parts of a*b, or of conj(a)*b."""
    re, im = (array_dot(F.col(f"{a}_{p}"), F.col(f"{b}_{p}")) for p in PARTS)
    return F.coalesce(F.sum(re + im if conjugate else re - im), F.lit(0.0))


def _norm2(a: str):
    return F.coalesce(F.sum(array_dot(F.col(f"{a}_re"), F.col(f"{a}_re")) + array_dot(F.col(f"{a}_im"), F.col(f"{a}_im"))), F.lit(0.0))


def _proximal(work: DataFrame, prox: Prox | PerRow, c: float, name: str, rows: tuple[str, ...], keys: tuple[str, ...], needed: tuple[str, ...], scratch: Scratch) -> DataFrame:
    """Adds the proximal point of z2; what is needed after it is written first, unless the map works on the row."""
    if isinstance(prox, PerRow):
        return work.withColumns(prox.named(name, "z2", c))
    work = scratch.keep(work.select(*rows, *(f"{n}_{p}" for n in needed for p in PARTS)), keys)
    return work.join(_named(prox(_iterate(work, keys, "z2"), c), keys, name), list(keys))


def solve(
    x0: DataFrame,
    gradient: Gradient | PerRow,
    lipschitz: float,
    *,
    keys: tuple[str, ...] = ("x", "y", "z"),
    prox: Prox | PerRow | None = None,
    carry: tuple[str, ...] = (),
    cost: Callable[[DataFrame], float] | None = None,
    mode: str = "pogm",
    restart: str = "gr",
    iterations: int = 10,
    mu: float = 0.0,
    cutoff: float = 0.0,
    bsig: float = 1.0,
    conjugate: bool = False,
    parity_alias: bool = False,
    fun: Callable[[int, DataFrame, DataFrame, bool], object] | None = None,
) -> Solution:
    """Minimises f + g, given f's gradient (Lipschitz constant L) and g's proximal map.

    mode: pgm (proximal gradient), fpgm (with momentum) or pogm (optimised momentum). restart: gr
    (by the generalised gradient), fr (by the cost, which is evaluated only then) or none.
    ``conjugate`` uses true inner products in the restart test; without it complex entries are
    multiplied as they are. ``bsig`` scales the momentum down where two generalised gradients point
    apart, in the optimised method with a restart rule. ``carry``: columns of x0 that stay with the state, for a gradient or
    proximal map that is a PerRow and for ``cost``. ``parity_alias`` treats the proximal point and its argument as one
    array, as implementations with an overwriting proximal map do.
    """
    if mode not in ("pgm", "fpgm", "pogm"):
        raise ValueError(f"no mode {mode!r}")
    if restart not in ("gr", "fr", "none"):
        raise ValueError(f"no restart rule {restart!r}")
    if restart == "fr" and cost is None:
        raise ValueError("restart by the cost needs the cost")
    if lipschitz <= 0 or mu < 0 or mu >= lipschitz or iterations < 0 or bsig < 0 or not -1 < cutoff < 1:
        raise ValueError("settings out of range")
    prox = prox or PerRow(lambda re, im, c: (re, im))
    scratch = Scratch(x0.sparkSession, "solver")
    # Without joins nothing has to lie by keys.
    plain = isinstance(gradient, PerRow) and isinstance(prox, PerRow)
    by = () if plain else keys
    rows = (*keys, *carry)
    names = (*(("x", "u", "z") if mode == "pogm" else ("x",)), *(("y",) if mode == "fpgm" or restart == "gr" or fun else ()))
    # Two generalised gradients are compared where that may change the momentum.
    turns = mode == "pogm" and restart != "none" and bsig != 1
    names = (*names, *(("g",) if turns else ()))
    start = x0.select(*rows, *PARTS)
    if plain:  # dealt once, however few files it came in
        start = start.repartition(int(x0.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    zero = {p: F.transform(p, lambda v: F.lit(0.0)) for p in PARTS}
    state = scratch.keep(start.select(*rows, *((zero[p] if n == "g" else F.col(p)).alias(f"{n}_{p}") for n in names for p in PARTS)), by)
    iterate = lambda name, after="": _iterate(state if not after else work, rows, f"{name}{after}")
    solution = Solution(_iterate(state, keys, "x"))
    t = sigma = zeta = 1.0
    q = mu / lipschitz
    alpha = 2 / (lipschitz + mu) if mode == "pgm" and mu else 1 / lipschitz
    held = cost(iterate("x")) if restart == "fr" else math.inf
    if fun:
        solution.log.append((0, fun(0, iterate("x"), iterate("y"), False), False))
    solution.restarts.append(False)
    for k in range(1, iterations + 1):
        if isinstance(gradient, PerRow):
            work = state.withColumns(gradient.named("d", "x"))
        else:
            work = state.join(_named(gradient(_iterate(state, keys, "x")), keys, "d"), list(keys))
        again = turned = False
        if mode == "pogm":
            work = work.withColumns(_mix("u2", (1, "x"), (-alpha, "d")))
            if mu:
                beta, gamma = strongly_convex_momentum(q, True)
                t2 = t
            else:
                t2 = next_t(t, k == iterations)
                beta, gamma = (t - 1) / t2, sigma * t / t2
            # z2 = u2 + beta (u2 - u) + gamma (u2 - x) - (beta alpha / zeta) (x - z)
            drift = 0.0 if parity_alias else beta * alpha / zeta
            work = work.withColumns(_mix("z2", (1 + beta + gamma, "u2"), (-beta, "u"), (-gamma - drift, "x"), (drift, "z")))
            zeta = alpha * (1 + beta + gamma)
            work = _proximal(work, prox, zeta, "x2", rows, keys, ("x", "d", "u2", "z2", *(n for n in ("y", "g") if n in names)), scratch)
            if parity_alias:
                work = work.withColumns(_mix("z2", (1, "x2")))
            work = work.withColumns(_mix("g2", (1, "d"), (-1 / zeta, "x2"), (1 / zeta, "z2")))
            work = work.withColumns(_mix("y2", (1, "x"), (-alpha, "g2")))
        else:
            work = work.withColumns(_mix("z2", (1, "x"), (-alpha, "d")))
            work = _proximal(work, prox, alpha, "y2", rows, keys, ("x", "z2", *(n for n in ("y",) if n in names)), scratch)
            work = work.withColumns(_mix("g2", (-1 / alpha, "y2"), (1 / alpha, "x")))
        kept = ["x2", "u2", "z2"] if mode == "pogm" else ["y2"]
        if "y" in names:
            work = work.withColumns(_mix("step", (1, "y2"), (-1, "y")))
            kept += ["step", *(["y2"] if mode == "pogm" else [])]
        if turns:
            kept.append("g")
        if turns or restart == "gr":
            kept.append("g2")
        work = scratch.keep(work.select(*rows, *(f"{n}_{p}" for n in kept for p in PARTS)), by)
        if restart == "fr":
            now = cost(iterate("x" if mode == "pogm" else "y", "2"))
            again, held = now > held, now
            turned = turns and work.agg(_real_dot("g2", "g", conjugate).alias("s")).first().s < 0
        elif restart == "gr":
            r = work.agg(_real_dot("g2", "step", conjugate).alias("d"), _norm2("g2").alias("a"), _norm2("step").alias("b"), *([_real_dot("g2", "g", conjugate).alias("s")] if turns else [])).first()
            again = -r.d <= cutoff * math.sqrt(r.a * r.b)
            turned = turns and r.s < 0
        if mode == "pogm":
            if again:
                t2, sigma = 1.0, 1.0
            elif turned:
                sigma *= bsig
            t = t2 if not mu else t
        elif mode == "fpgm":
            if again:
                t = 1.0
            if mu:
                beta = strongly_convex_momentum(q, False)[0]
            else:
                t2 = next_t(t)
                beta, t = (t - 1) / t2, t2
            work = work.withColumns(_mix("x2", (1, "y2"), (beta, "step")))
        else:
            work = work.withColumns(_mix("x2", (1, "y2")))
        # A projection of the table just written.
        state = work.select(*rows, *(F.col(f"{n}2_{p}").alias(f"{n}_{p}") for n in names for p in PARTS))
        if fun:
            solution.log.append((k, fun(k, iterate("x"), iterate("y"), again), again))
        solution.restarts.append(again)
        scratch.drop(but_last=1)
    solution.x = _iterate(state, keys, "y" if mode == "fpgm" and iterations else "x")
    return solution


def power_iteration(
    apply_normal: Callable[[DataFrame], DataFrame] | None,
    apply_forward: Callable[[DataFrame], DataFrame],
    x0: DataFrame,
    *,
    apply_adjoint: Callable[[DataFrame], DataFrame] | None = None,
    keys: tuple[str, ...] = ("x", "y", "z"),
    iterations: int = 200,
    tolerance: float = 1e-6,
    chat: Callable[[int, float], None] | None = None,
) -> tuple[DataFrame, float]:
    """The leading right singular vector and singular value of A. apply_forward is A, apply_normal
    is A^H A; stops when the value's relative change is below the tolerance. With apply_adjoint, A x is
    written once a step and serves for the value and for A^H (A x); apply_normal is then not needed."""
    if apply_normal is None and apply_adjoint is None:
        raise ValueError("either A^H A or A^H is needed")
    scratch = Scratch(x0.sparkSession, "power")

    def square(df: DataFrame) -> float:
        one = "array" in dict(df.dtypes)["re"]
        own = array_dot(F.col("re"), F.col("re")) + array_dot(F.col("im"), F.col("im")) if one else F.col("re") * F.col("re") + F.col("im") * F.col("im")
        return df.agg(F.coalesce(F.sum(own), F.lit(0.0)).alias("n")).first().n

    def forward(x: DataFrame) -> DataFrame:
        return scratch.keep(apply_forward(x)) if apply_adjoint else apply_forward(x)

    x, ratio = scratch.keep(x0.select(*keys, *PARTS)), 0.0
    for k in range(1, iterations + 1):
        encoded = forward(x)
        new = math.sqrt(square(encoded) / square(x))
        if chat:
            chat(k, new)
        if new == 0 or abs(new - ratio) / new < tolerance:
            return x, new
        ratio = new
        y = scratch.keep((apply_adjoint(encoded) if apply_adjoint else apply_normal(x)).select(*keys, *PARTS))
        norm = math.sqrt(square(y))
        x = scratch.keep(y.select(*keys, *(F.transform(p, lambda v: v / F.lit(norm)).alias(p) for p in PARTS)))
        scratch.drop(but_last=1)
    return x, math.sqrt(square(forward(x)) / square(x))
