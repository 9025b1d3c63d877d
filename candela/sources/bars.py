"""Bar sources: trades to OHLCV bars, bar files, chart JSON, CSV, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAR_COLS = ["symbol", "d", "open", "high", "low", "close", "volume"]
BROADCAST_BARS = 200_000        # bars whose ends are sent to every task (about 20 MB); beyond, trades are shuffled to them


def bars_from_trades(trades: DataFrame, order_cols: list[str], unit: str = "day",
                     symbol: str = "symbol", ts: str = "ts", px: str = "px",
                     size: str = "size") -> DataFrame:
    """Resample trades/ticks to OHLCV bars.

    open/close are the prices of the first/last trade by ``order_cols`` inside
    the bar, high/low the extreme prices, volume the summed size. The first pass keeps
    numbers only (extremes, volume, the ends of the first order column) and is a hash aggregate
    combined in the map tasks; the second reads the trades at those ends alone, so the
    whole order key is compared for a few rows a bar. A hot symbol never lands in a single task.
    """
    if unit == "day":
        bucket = F.to_date(F.col(ts))
    else:
        bucket = F.date_trunc(unit, F.col(ts))
    rows = trades.select(F.col(symbol).alias("symbol"), bucket.alias("d"), F.col(px).alias("_px"), F.col(size).alias("_size"),
                         F.col(order_cols[0]).alias("_first"), F.struct(*[F.col(c) for c in order_cols]).alias("_key"))
    edges = (rows.groupBy("symbol", "d")
             .agg(F.max("_px").alias("high"), F.min("_px").alias("low"), F.sum("_size").cast("double").alias("volume"),
                  F.count_if(F.col("_first").isNull()).alias("_nulls"), F.min("_first").alias("_lo"), F.max("_first").alias("_hi"))
             .withColumn("_lo", F.when(F.col("_nulls") == 0, F.col("_lo")))     # a null comes first in a key
             .withColumnsRenamed({"symbol": "_s", "d": "_d"}).checkpoint())
    if edges.count() <= BROADCAST_BARS:
        edges = F.broadcast(edges)
    at = F.col("_first")
    ends = rows.join(edges, F.col("symbol").eqNullSafe(F.col("_s")) & F.col("d").eqNullSafe(F.col("_d"))
                     & (at.eqNullSafe(F.col("_lo")) | at.eqNullSafe(F.col("_hi"))))
    return (ends.groupBy("symbol", "d")
            .agg(F.min_by("_px", "_key").alias("open"), F.max("high").alias("high"), F.max("low").alias("low"),
                 F.max_by("_px", "_key").alias("close"), F.max("volume").alias("volume")))


def bars_scan(spark: SparkSession, path: str, start: str = "2018-01-01") -> DataFrame:
    """Read stored bars from ``start`` on; the date filter reaches the scan."""
    return (spark.read.parquet(path).select(*BAR_COLS)
            .filter(F.col("d") >= F.lit(start).cast("date")))


def bars_sink(bars: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write bars partitioned by symbol (parquet or json). Rows are grouped
    by (symbol, year) first: few files per symbol folder, and no symbol's
    whole history goes through one write task."""
    (bars.repartition("symbol", F.year("d")).write.mode("overwrite").partitionBy("symbol")
     .format(fmt).save(path))


# --------------------------------------------------------------------------
# chart JSON (nested parallel arrays) and CSV sources
# --------------------------------------------------------------------------

CHART_SCHEMA = T.StructType([
    T.StructField("chart", T.StructType([
        T.StructField("result", T.ArrayType(T.StructType([
            T.StructField("meta", T.StructType([T.StructField("symbol", T.StringType())])),
            T.StructField("timestamp", T.ArrayType(T.LongType())),
            T.StructField("indicators", T.StructType([
                T.StructField("quote", T.ArrayType(T.StructType([
                    T.StructField(k, T.ArrayType(T.DoubleType()))
                    for k in ("open", "high", "low", "close", "volume")]))),
                T.StructField("adjclose", T.ArrayType(T.StructType([
                    T.StructField("adjclose", T.ArrayType(T.DoubleType()))]))),
            ])),
        ]))),
    ])),
])


def chart_json_source(docs: DataFrame, json_col: str = "json", symbol_col: str | None = None,
                      tz: str = "America/New_York") -> DataFrame:
    """Chart JSON documents -> bars.

    Parallel arrays are zipped and exploded; adjusted close is preferred over
    close; epoch seconds become the exchange-local date; rows with any null
    OHLCV are dropped.
    """
    parsed = docs.select(
        *([F.col(symbol_col).alias("_sym")] if symbol_col else []),
        F.from_json(F.col(json_col), CHART_SCHEMA).alias("j"))
    res = parsed.select(
        *(["_sym"] if symbol_col else []),
        F.explode(F.col("j.chart.result")).alias("r"))
    q = F.col("r.indicators.quote")[0]
    adj = F.col("r.indicators.adjclose")[0]["adjclose"]
    close = F.when(adj.isNotNull() & (F.size(adj) > 0), adj).otherwise(q["close"])
    z = res.select(
        (F.col("_sym") if symbol_col else F.col("r.meta.symbol")).alias("symbol"),
        F.explode(F.arrays_zip(
            F.col("r.timestamp").alias("t"), q["open"].alias("open"), q["high"].alias("high"),
            q["low"].alias("low"), close.alias("close"), q["volume"].alias("volume"))).alias("z"))
    out = z.select(
        "symbol",
        F.to_date(F.from_utc_timestamp(F.timestamp_seconds(F.col("z.t")), tz)).alias("d"),
        *[F.col(f"z.{k}").alias(k) for k in ("open", "high", "low", "close", "volume")])
    return out.dropna(subset=["d", "open", "high", "low", "close", "volume"])


def csv_source(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    """CSV bars: headers lower-cased and trimmed; ``adj close`` wins over close where it
    has a value. Rows whose date or numbers cannot be read are dropped."""
    raw = spark.read.option("header", True).csv(path)
    cols = {c: c.strip().lower() for c in raw.columns}
    df = raw.select(*[F.col(f"`{c}`").alias(n) for c, n in cols.items()])
    close = F.coalesce(*[F.expr(f"try_cast(`{c}` as double)") for c in ("adj close", "close") if c in df.columns])
    sym = F.lit(symbol) if symbol else F.col("symbol")
    out = df.select(
        sym.alias("symbol"), F.expr("try_to_date(`date`)").alias("d"),
        *[F.expr(f"try_cast(`{c}` as double)").alias(c) for c in ("open", "high", "low")],
        close.alias("close"),
        F.expr("try_cast(volume as double)").alias("volume"))
    return out.dropna(subset=["d", "open", "high", "low", "close", "volume"])


def source_priority(sources: list[DataFrame], min_rows: int = 51) -> DataFrame:
    """Per symbol, keep the bars of the first source (list order) with >= min_rows rows."""
    tagged = None
    for i, s in enumerate(sources):
        t = s.select(*BAR_COLS).withColumn("_prio", F.lit(i))
        tagged = t if tagged is None else tagged.unionByName(t)
    tagged = tagged.checkpoint()      # bars, far fewer than the trades behind them: each feed is read once
    counts = (tagged.groupBy("symbol", "_prio").agg(F.count(F.lit(1)).alias("_n"))
              .filter(F.col("_n") >= min_rows)
              .groupBy("symbol").agg(F.min("_prio").alias("_prio")))
    return tagged.join(counts, ["symbol", "_prio"], "left_semi").select(*BAR_COLS, F.col("_prio").alias("source_rank"))
