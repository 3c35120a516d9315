"""Settings of a reconstruction, its parameter sets, and the grid conventions.

Long form: one row per cell, x, y, z from 0, t (frame) from 1, values in ``re`` and ``im``.
Packed form: one row per voxel (x, y, z), the series in two parallel arrays ``re`` and ``im``.
A cell that was not sampled is absent.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

#: Machine epsilon of 32-bit floats, the guard in ratios.
EPS32 = 1.1920928955078125e-07

VOXEL = ("x", "y", "z")
CELL = ("x", "y", "z", "t")
SAMPLE = ("x", "y", "z", "coil", "t")


def require(df, *columns: str) -> None:
    """Raises a ValueError unless the table has these columns: whole numbers, but for values (re, im, v),
    which are numbers in long form and arrays of numbers in packed form."""
    kinds = dict(df.dtypes)
    for c in columns:
        name, packed, _ = c.partition("[")
        kind = kinds.get(name)
        if kind is None:
            raise ValueError(f"no column {name!r} among {df.columns}")
        whole = ("tinyint", "smallint", "int", "bigint")
        numbers = (*whole, "float", "double")
        fits = kind in [f"array<{n}>" for n in numbers] if packed else kind in (numbers if name in ("re", "im", "v") else whole)
        if not fits:
            raise ValueError(f"column {name!r} has type {kind}")


@dataclass(frozen=True)
class Grid:
    nx: int
    ny: int
    nz: int

    @property
    def shape(self) -> tuple[int, int, int]:
        return (self.nx, self.ny, self.nz)

    @property
    def voxels(self) -> int:
        return self.nx * self.ny * self.nz


@dataclass(frozen=True)
class ReconConfig:
    """One run: geometry, the patch size and stride of every scale, and the solver's settings."""

    grid: tuple[int, int, int]
    frames: int
    coils: int
    patch_sizes: tuple[tuple[int, int, int], ...]
    strides: tuple[tuple[int, int, int], ...]
    iterations: int = 50
    sigma1: float | None = 1.0
    mode: str = "pogm"
    restart: str = "gr"
    parity_alias: bool = False
    field_of_view_mm: tuple[float, float, float] | None = None
    name: str = "recon"
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        if len(self.patch_sizes) != len(self.strides):
            raise ValueError("every scale needs a patch size and a stride")

    @property
    def scales(self) -> int:
        return len(self.patch_sizes)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> ReconConfig:
        raw = json.loads(text)
        for key in ("patch_sizes", "strides"):
            raw[key] = tuple(tuple(x) for x in raw[key])
        raw["grid"] = tuple(raw["grid"])
        if raw.get("field_of_view_mm"):
            raw["field_of_view_mm"] = tuple(raw["field_of_view_mm"])
        return ReconConfig(**raw)


def _full(grid, *rest):
    return (grid, *rest)


_GRID, _FOV = (90, 90, 60), (216.0, 216.0, 144.0)

# The acquisition settings of four published runs.
PARAMETER_SETS = {
    "20241017": ReconConfig(_GRID, 300, 10, _full(_GRID, (30, 30, 30), (10, 10, 10)), _full(_GRID, (30, 30, 30), (10, 10, 10)), 50, 1.0, field_of_view_mm=_FOV, name="20241017"),
    "20251106": ReconConfig(_GRID, 300, 18, _full(_GRID, (30, 30, 30), (10, 10, 10)), _full(_GRID, (30, 30, 30), (10, 10, 10)), 50, 1.0, field_of_view_mm=_FOV, name="20251106"),
    "20260317": ReconConfig(_GRID, 387, 18, _full(_GRID, (6, 6, 6), (1, 1, 1)), _full((45, 45, 30), (3, 3, 3), (1, 1, 1)), 50, 1.0, field_of_view_mm=_FOV, name="20260317"),
    "20260409": ReconConfig(_GRID, 387, 18, _full(_GRID, (6, 6, 6), (1, 1, 1)), _full(_GRID, (3, 3, 3), (1, 1, 1)), 100, 1.0, field_of_view_mm=_FOV, name="20260409"),
}
