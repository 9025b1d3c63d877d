"""Correlation of daily log returns (family E).

Returns are aligned positionally from the newest bar (stock and crypto
calendars differ), trimmed to the shortest series. The matrix is computed in
tiles: symbols are cut into blocks of ``BLOCK`` rows of returns, every unordered pair of blocks
meets in one row, and a handful of small matrix products gives the sums of all its
pairs. Tasks grow with the number of tiles, not of days, and each pair is
computed once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candela.operators.snapshot import tail_rows

BLOCK = 256            # symbols of a tile's side
DAYS = (30, 90, 180, 365)


def log_return_tail(series: DataFrame, symbols: list[str] | None = None, days: int = 90,
                    min_closes: int = 10) -> DataFrame:
    """Log returns of the last days+1 closes per symbol; k = 0 is the newest.

    Symbols with fewer than ``min_closes`` closes are dropped; unknown
    ``days`` fall back to 90; ``symbols`` None takes every symbol.
    """
    if days not in DAYS:
        days = 90
    s = series.select("symbol", "d", "close")
    if symbols is not None:
        s = s.filter(F.col("symbol").isin(symbols))
    s = tail_rows(s, days + 1).filter(F.col("n") >= min_closes)
    w = Window.partitionBy("symbol").orderBy("pos")  # at most days + 1 rows per symbol
    lr = F.log("close") - F.log(F.lag("close").over(w))
    return (s.withColumn("lr", lr).filter(F.col("pos") > 0)
            .select("symbol", (F.col("n") - 1 - F.col("pos")).alias("k"), "d", "lr"))


def _rows(column: pa.Array, width: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, their numbers, returns about their mean (0 where missing) and presence of one block."""
    row = column.values
    flat, at = row.field("v").flatten(), np.repeat(np.arange(len(row)), np.diff(row.field("v").offsets.to_numpy()))
    x, there = np.zeros((len(row), width)), np.zeros((len(row), width))
    t, value = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("t", "lr"))
    x[at, t], there[at, t] = value, 1.0
    x = np.where(there > 0, x - (x.sum(1) / np.maximum(there.sum(1), 1))[:, None], 0.0)
    return row.field("symbol").to_pylist(), row.field("i").to_numpy(), x, there


def _tile(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                p, q = b.column(0)[k].as_py(), b.column(1)[k].as_py()
                (na, ia, x, mx), (nb, ib, y, my) = _rows(b.column(2)[k], width), _rows(b.column(3)[k], width)
                n, sx, sy = mx @ my.T, x @ my.T, mx @ y.T
                with np.errstate(all="ignore"):
                    r = ((n * (x @ y.T) - sx * sy)
                         / (np.sqrt(n * (x * x @ my.T) - sx ** 2) * np.sqrt(n * (mx @ (y * y).T) - sy ** 2)))
                i, j = np.nonzero(np.isfinite(r) & (ia[:, None] <= ib[None, :] if p == q else True))
                for left, right, a, c, u, v in ((na, nb, ia, ib, i, j), (nb, na, ib, ia, j, i)):
                    keep = a[u] != c[v] if left is nb else slice(None)            # the diagonal once
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.array(left, object)[u][keep], pa.string()), pa.array(np.array(right, object)[v][keep], pa.string()),
                         pa.array(np.clip(r[i, j][keep], -1, 1)), pa.array(a[u][keep].astype(np.int32)), pa.array(c[v][keep].astype(np.int32))],
                        ["a", "b", "r", "ia", "ib"])
    return run


def correlation_matrix(rets: DataFrame, symbols: list[str] | None = None, align: str = "position", block: int = BLOCK) -> DataFrame:
    """Long (a, b, r) Pearson matrix, r to 4 dp; ia, ib: places of the symbols
    in ``symbols`` (from 1), or among all symbols by name.

    align='position' trims to the shortest series and pairs returns by
    position from the end (the reference); align='date' pairs by date. Pairs without variance are left out.
    """
    key = "d" if align == "date" else "k"
    # At most days rows per symbol: written once, read by the names, the trim and the blocks.
    r = rets.filter(F.col("lr").isNotNull() & F.col(key).isNotNull()).select("symbol", key, "lr").checkpoint()
    if symbols is not None:
        place = F.array_position(F.array(*[F.lit(s) for s in dict.fromkeys(symbols)]), F.col("symbol")).cast("int")
        r = r.withColumn("i", place).filter(F.col("i") > 0)
    else:
        names = r.select("symbol").distinct()     # one row per symbol, where the matrix has one per pair
        r = r.join(names.withColumn("i", F.row_number().over(Window.orderBy("symbol"))), "symbol")
    if align == "date":
        days = r.select("d").distinct()           # one row per day
        r = r.join(days.withColumn("t", F.row_number().over(Window.orderBy("d")) - 1), "d")
    else:
        shortest = r.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n"))
        r = r.filter(F.col("k") < shortest.scalar()).withColumn("t", F.col("k").cast("int"))
    series = r.groupBy("symbol", "i").agg(F.collect_list(F.struct("t", "lr")).alias("v"))              # at most days values
    blocks = (series.groupBy(F.floor((F.col("i") - 1) / block).cast("int").alias("p"))
              .agg(F.collect_list(F.struct("symbol", "i", "v")).alias("rows")).checkpoint())           # at most ``block`` symbols
    last, width = blocks.agg(F.max("p"), F.max(F.array_max(F.transform("rows", lambda x: F.array_max(x["v"])["t"])))).first()
    last, width = last or 0, (width if width is not None else -1) + 1
    left = blocks.select("p", F.explode(F.sequence("p", F.lit(last))).alias("q"), F.col("rows").alias("x"))
    right = blocks.select(F.col("p").alias("q"), F.explode(F.sequence(F.lit(0), "p")).alias("p"), F.col("rows").alias("y"))
    tiles = left.join(right, ["p", "q"]).select("p", "q", "x", "y").mapInArrow(_tile(width), "a string, b string, r double, ia int, ib int")
    return tiles.select("a", "b", F.round("r", 4).alias("r"), "ia", "ib")


def correlation_pairs(matrix: DataFrame, k: int = 3) -> DataFrame:
    """Unordered pairs (a before b in symbol order): the k highest and the k
    lowest r; ties keep the pair order (as a stable sort would)."""
    p = matrix.filter(F.col("ia") < F.col("ib"))
    high, low = (F.col("r").desc(), "ia", "ib"), (F.col("r").asc(), F.col("ia").desc(), F.col("ib").desc())

    def best(order, kind):      # limit first: the window numbers k rows
        rank = F.row_number().over(Window.orderBy(*order)).cast("long")
        return p.orderBy(*order).limit(k).select(F.lit(kind).alias("kind"), rank.alias("rank"), "a", "b", "r")

    return best(high, "top_pos").unionByName(best(low, "top_neg"))
