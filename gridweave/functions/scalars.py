"""Scalar formulas: threshold weights, step sizes, momentum."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def threshold_weight(patch: tuple[int, int, int], frames: int, grid: tuple[int, int, int]) -> float:
    """sqrt(p) + sqrt(Nt) + sqrt(ln(voxels * Nt / max(p, Nt))), p the patch's volume, unclipped."""
    p = math.prod(patch)
    return math.sqrt(p) + math.sqrt(frames) + math.sqrt(math.log(math.prod(grid) * frames / max(p, frames)))


def threshold_weight_column(p: Column, frames: Column, voxels: Column) -> Column:
    return F.sqrt(p) + F.sqrt(frames) + F.sqrt(F.log(voxels * frames / F.greatest(p, frames)))


def lipschitz(scales: int, sigma1: float) -> float:
    return scales * sigma1 * sigma1


def soft_threshold(value: Column, beta: Column | float) -> Column:
    return F.greatest(value - beta, F.lit(0.0))


def next_t(t: float, last: bool = False) -> float:
    """The momentum sequence; the last step of the optimised method doubles its radicand."""
    return 0.5 * (1 + math.sqrt(1 + (8 if last else 4) * t * t))


def strongly_convex_momentum(q: float, optimised: bool) -> tuple[float, float]:
    """(beta, gamma) for q = mu / L > 0."""
    root = math.sqrt(q * q + 8 * q)
    if optimised:
        return (2 + q - root) ** 2 / (4 * (1 - q)), (2 + q - root) / 2
    return (1 - math.sqrt(q)) / (1 + math.sqrt(q)), 0.0
