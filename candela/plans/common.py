"""Helpers shared by the registered queries and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Registered outputs round doubles to this many decimals, in Spark and in the
# oracle alike, so sums added in a different order compare equal. The grid is
# shifted by TIE_SHIFT (about 0.03 of the last unit): data values are "nice"
# decimals (2-dp prices over integer quantities), and a value that is exactly
# half-way in real arithmetic lands a last bit either side in two engines;
# with the shift no such value sits on a rounding boundary.
DIGITS = 6
TIE_SHIFT = 3.18309886e-8


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name) + TIE_SHIFT, digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def sql_round(expr: str, digits: int = DIGITS) -> str:
    """The same shifted rounding as ``rounded`` in DuckDB SQL."""
    return f"round(CAST({expr} AS DOUBLE) + {TIE_SHIFT}, {digits})"


def sql_rounded(inner: str, cols: list[str], double_cols: list[str], digits: int = DIGITS) -> str:
    sel = ", ".join(f"{sql_round(c, digits)} AS {c}" if c in double_cols else c for c in cols)
    return f"SELECT {sel} FROM ({inner}) q"
