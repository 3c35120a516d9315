"""Complex arithmetic on (re, im) pairs of columns, single values or packed arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Pair = tuple[Column, Column]


def pair(re: str | Column = "re", im: str | Column = "im") -> Pair:
    return (F.col(re) if isinstance(re, str) else re, F.col(im) if isinstance(im, str) else im)


def magnitude(a: Pair) -> Column:
    return F.hypot(*a)


def squared_magnitude(a: Pair) -> Column:
    return a[0] * a[0] + a[1] * a[1]


def multiply(a: Pair, b: Pair) -> Pair:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def conj_multiply(a: Pair, b: Pair) -> Pair:
    """conj(a) * b."""
    return a[0] * b[0] + a[1] * b[1], a[0] * b[1] - a[1] * b[0]


def linear(*terms: tuple[float, Column]) -> Column:
    """The sum of coefficient times array, element by element, over packed arrays of one length."""
    (c, first), *rest = terms
    out = F.transform(first, lambda v: v * F.lit(float(c)))
    for k, column in rest:
        out = F.zip_with(out, column, _plus_times(float(k)))
    return out


def _plus_times(k: float):
    return lambda p, q: p + q * F.lit(k)


def array_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def array_sum(arrays: Column) -> Column:
    """Element-wise sum of an array of arrays of one length."""
    return F.aggregate(F.slice(arrays, 2, F.greatest(F.size(arrays) - 1, F.lit(0))), arrays[0], lambda s, v: F.zip_with(s, v, lambda p, q: p + q))
