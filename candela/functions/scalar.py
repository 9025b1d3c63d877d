"""Scalar helpers shared by operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A value that is exactly half-way in real arithmetic can come out a last bit
# below or above the boundary depending on the order of operations; the nudge
# makes such ties round up in every engine (DuckDB oracles use the same).
ROUND_NUDGE = 1e-9


def rnd(x: Column, d: int) -> Column:
    """round(x, d), half up, robust to last-bit noise at exact ties."""
    return F.round(x + F.lit(ROUND_NUDGE), d)


def sql_rnd(expr: str, d: int) -> str:
    return f"round(({expr}) + {ROUND_NUDGE}, {d})"
