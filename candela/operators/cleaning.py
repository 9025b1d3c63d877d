"""Bar cleaning, universe checks and data freshness (family A)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.functions.scalar import rnd
from candela.operators.indicators import require_rows

OHLCV = ["open", "high", "low", "close", "volume"]
MIN_ROWS = 120
TTL_OPEN_SEC = 3600
TTL_CLOSED_SEC = 6 * 3600
SESSION_TZ = "America/New_York"


def clean_bars(raw: DataFrame, arrival: str = "arrival", min_rows: int = MIN_ROWS) -> DataFrame:
    """Raw bar feed -> clean bars.

    Column names are trimmed and lower-cased (the first of duplicate names
    wins), the last arrival per (symbol, d) wins (of equal arrivals the one
    with the larger values), OHLCV are coerced to numbers (unparseable ->
    null), rows with a null symbol, day or OHLCV are dropped and symbols with
    fewer than ``min_rows`` rows are dropped.
    """
    seen: dict[str, str] = {}
    for c in raw.columns:
        seen.setdefault(c.strip().lower(), c)
    df = raw.select(*[F.col(f"`{orig}`").alias(name) for name, orig in seen.items()])
    values = F.struct(*[F.col(c) for c in OHLCV])
    last = (df.filter(F.col("symbol").isNotNull() & F.col("d").isNotNull()).groupBy("symbol", "d")
            .agg(F.max(F.struct(F.col(arrival).alias("_at"), values.alias("_b")))["_b"].alias("_b")))
    typed = last.select("symbol", "d", *[F.col(f"_b.{c}").cast("string").try_cast("double").alias(c) for c in OHLCV])
    return require_rows(typed.dropna(subset=OHLCV), min_rows)


def universe_filter(bars: DataFrame, universe: DataFrame) -> DataFrame:
    """Keep bars of whitelisted symbols (``universe``: symbol[, kind]) - a
    semi join; the universe is a list of instruments, small by nature."""
    return bars.join(universe.select("symbol"), "symbol", "left_semi")


def universe_rejects(requested: DataFrame, universe: DataFrame) -> DataFrame:
    """Requested symbols that are not in the universe (anti join)."""
    return requested.select(F.upper(F.trim("symbol")).alias("symbol")).join(
        universe.select("symbol"), "symbol", "left_anti")


def market_session(ts: F.Column, tz: str = SESSION_TZ) -> tuple[F.Column, F.Column]:
    """(is_open, ttl_seconds) for a UTC timestamp: open on weekdays from
    09:30 to before 16:00 exchange time; cache life 1 h open, 6 h closed."""
    local = F.from_utc_timestamp(ts.cast("timestamp"), tz)
    mins = F.hour(local) * 60 + F.minute(local)
    is_open = (~F.dayofweek(local).isin(1, 7)) & (mins >= 570) & (mins < 960)
    ttl = F.when(is_open, F.lit(TTL_OPEN_SEC)).otherwise(F.lit(TTL_CLOSED_SEC))
    return is_open, ttl


def freshness_report(loads: DataFrame, bars: DataFrame, as_of) -> DataFrame:
    """Per symbol: minutes since its data was loaded (1 dp), rows, last bar
    date and whether it is fresh (age below the session's TTL at as_of).
    ``loads``: (symbol, loaded_at); ``as_of`` is a parameter, never now()."""
    stats = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.max("d").alias("last_date"))
    now = F.lit(as_of).cast("timestamp_ntz")
    _, ttl = market_session(now)
    age_sec = F.unix_micros(now.cast("timestamp")) / 1e6 - F.unix_micros(F.col("loaded_at").cast("timestamp")) / 1e6
    j = loads.join(stats, "symbol")
    return j.select("symbol", rnd(age_sec / 60, 1).alias("age_min"), "rows",
                    F.date_format("last_date", "yyyy-MM-dd").alias("last_date"),
                    (age_sec < ttl).alias("fresh"))


def refresh_report(spark: SparkSession, universe: list[str], bars: DataFrame, first: int = 10) -> DataFrame:
    """Refresh the first ``first`` universe symbols: refreshed when bars
    exist, failed otherwise; the rest are skipped."""
    u = spark.createDataFrame([(s, i) for i, s in enumerate(universe)], "symbol string, idx int")
    have = bars.select("symbol").distinct().withColumn("_has", F.lit(True))
    j = u.join(have, "symbol", "left")
    status = (F.when(F.col("idx") >= first, "skipped")
              .when(F.col("_has"), "refreshed").otherwise("failed"))
    return j.select("symbol", "idx", status.alias("status"))

