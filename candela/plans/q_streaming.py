"""Streaming keys: each runs its Structured Streaming job over the whole
fixture stream (availableNow) and returns the table it wrote. The oracle is
the batch twin in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from candela.operators import wallet as wl
from candela.plans.common import rounded
from candela.plans.q_alerts import ALERTS
from candela.plans.q_wallet import _PAY
from candela.plans.registry import register
from candela.plans.sql_parts import BARS_SQL, with_ctes
from candela.sources import tables
from candela.streaming import jobs


@register("alert_stream", with_ctes([("b", BARS_SQL), ALERTS], """SELECT a.id, a.user_id, a.symbol, a.target_price, a.direction,
  min(b.d) AS fired_on, round(arg_min(b.close, b.d) + 3.18309886e-8, 6) AS price
  FROM b JOIN alerts a USING (symbol)
  WHERE a.status = 'active' AND ((a.direction = 'above' AND b.close >= a.target_price) OR (a.direction = 'below' AND b.close <= a.target_price))
  GROUP BY a.id, a.user_id, a.symbol, a.target_price, a.direction"""))
def alert_stream(spark, sf_dir):
    out = jobs.alert_stream(spark, tables.bar_stream_dir(spark, sf_dir), tables.alerts(spark, sf_dir),
                            tables.BAR_SCHEMA)
    return rounded(out)


@register("payment_stream", _PAY)
def payment_stream(spark, sf_dir):
    out = jobs.payment_stream(spark, tables.payment_stream_dir(spark, sf_dir), wl.price_plans(spark),
                              tables.PAYMENT_EVENT_SCHEMA)
    return rounded(out)


@register("stream_bars", """SELECT event_type AS symbol, date_trunc('hour', ts) AS d,
  round(arg_min(value, (ts, event_id)) + 3.18309886e-8, 6) AS open, round(max(value) + 3.18309886e-8, 6) AS high,
  round(min(value) + 3.18309886e-8, 6) AS low, round(arg_max(value, (ts, event_id)) + 3.18309886e-8, 6) AS close,
  CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY event_type, date_trunc('hour', ts)""")
def stream_bars(spark, sf_dir):
    """Hourly bars of the event stream; a tenth of the trades come late and revise bars already published."""
    trades = tables.event_stream(spark, sf_dir).select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("px"),
                                                       F.lit(1.0).alias("size"), "event_id")
    out = jobs.bars_stream(trades).drop("revisions")
    return rounded(out.withColumn("d", F.col("d").cast("timestamp_ntz")))


@register("stream_rate_windows", """SELECT user_id AS key_id, date_trunc('hour', ts) AS window_start, count(*) AS requests,
  greatest(count(*) - 60, 0) AS refused FROM events WHERE event_type IN ('click', 'view') GROUP BY user_id, date_trunc('hour', ts)""")
def stream_rate_windows(spark, sf_dir):
    req = (tables.event_stream(spark, sf_dir).filter(F.col("event_type").isin("click", "view"))
           .select(F.col("user_id").alias("key_id"), "ts"))
    out = jobs.rate_windows_stream(req, "1 hour", 60).drop("revisions")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
