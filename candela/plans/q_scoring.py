"""Family J: scoring of past predictions against the processed series."""

from __future__ import annotations

from pyspark.sql import functions as F

from candela.operators import scoring as sc
from candela.plans.common import rounded, sql_round
from candela.plans.q_snapshot import SER
from candela.plans.registry import register
from candela.plans.sql_parts import symbol_of, trimmed_ctes, with_ctes
from candela.sources import tables

PRED = ("pred", f"""SELECT o_orderkey AS id, o_custkey AS user_id, {symbol_of('o_orderkey')} AS symbol,
  '$' || CAST(round(o_totalprice / 50 + 1e-9, 2) AS VARCHAR) AS predicted_result, o_orderdate AS created_at FROM orders""")
ACC = [PRED,
       ("p1", "SELECT * FROM pred WHERE created_at < (SELECT max(o_orderdate) FROM orders) - INTERVAL 14 DAYS"),
       ("p2", """SELECT *, CASE WHEN created_at + INTERVAL 14 DAYS = date_trunc('day', created_at + INTERVAL 14 DAYS)
          THEN CAST(created_at + INTERVAL 14 DAYS AS DATE) ELSE CAST(created_at + INTERVAL 14 DAYS AS DATE) + 1 END AS dday FROM p1"""),
       ("acc", """SELECT p.id, p.user_id, p.symbol, p.created_at, s.d AS actual_date, s.close AS actual,
          try_cast(replace(p.predicted_result, '$', '') AS DOUBLE) AS predicted,
          round(greatest(100 - abs((s.close - try_cast(replace(p.predicted_result, '$', '') AS DOUBLE)) / s.close * 100), 0.0) + 1e-9, 2) AS accuracy_pct
          FROM p2 p ASOF JOIN ser s ON p.symbol = s.symbol AND s.d >= p.dday
          WHERE p.predicted_result IS NOT NULL AND p.predicted_result <> ''""")]


def _acc(spark, sf_dir):
    return sc.accuracy_update(tables.predictions(spark, sf_dir), tables.processed(spark, sf_dir),
                              tables.as_of(spark, sf_dir), 14)


@register("accuracy_update", with_ctes(trimmed_ctes() + [SER] + ACC, f"""SELECT id, user_id, symbol, created_at,
  actual_date, {sql_round('actual')} AS actual, {sql_round('predicted')} AS predicted, accuracy_pct FROM acc"""))
def accuracy_update(spark, sf_dir):
    return rounded(_acc(spark, sf_dir))


_INTRADAY = """WITH p AS (SELECT event_id AS id, user_id, (['click','error','purchase','signup','view'])[(event_id % 5) + 1] AS symbol,
    '$' || CAST(round(value + 1e-9, 2) AS VARCHAR) AS predicted_result, ts AS created_at FROM events
    WHERE event_type = 'view' AND ts < (SELECT max(ts) FROM events) - INTERVAL 3 DAYS),
  b AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS d, arg_max(value, (ts, event_id)) AS close FROM events GROUP BY ALL)
  SELECT p.id, p.user_id, p.symbol, p.created_at, b.d AS actual_date, round(b.close + 3.18309886e-8, 6) AS actual,
    round(try_cast(replace(p.predicted_result, '$', '') AS DOUBLE) + 3.18309886e-8, 6) AS predicted,
    round(round(greatest(100 - abs((b.close - try_cast(replace(p.predicted_result, '$', '') AS DOUBLE)) / b.close * 100), 0.0) + 1e-9, 2) + 3.18309886e-8, 6) AS accuracy_pct
  FROM p ASOF JOIN b ON p.symbol = b.symbol AND b.d >= p.created_at + INTERVAL 3 DAYS"""


@register("accuracy_update_intraday", _INTRADAY)
def accuracy_update_intraday(spark, sf_dir):
    """Predictions made at a time of day, scored by the first hourly bar three days later."""
    newest = tables.table(spark, sf_dir, "events").select(F.max("ts")).scalar()
    out = sc.accuracy_update(tables.intraday_predictions(spark, sf_dir), tables.hourly_event_bars(spark, sf_dir), newest, 3)
    return rounded(out.withColumn("actual_date", F.col("actual_date").cast("timestamp_ntz")))


@register("user_accuracy", with_ctes(trimmed_ctes() + [SER] + ACC, """SELECT user_id,
  round(avg(accuracy_pct) + 1e-9, 1) AS avg_accuracy, count(accuracy_pct) AS scored_count FROM (
    SELECT p.*, a.accuracy_pct, row_number() OVER (PARTITION BY p.user_id ORDER BY p.created_at DESC, p.id DESC) AS k
    FROM pred p LEFT JOIN acc a USING (id)) WHERE k <= 100 GROUP BY user_id"""))
def user_accuracy(spark, sf_dir):
    scored = _acc(spark, sf_dir).select("id", "accuracy_pct")
    p = tables.predictions(spark, sf_dir).join(scored, "id", "left")
    return rounded(sc.user_accuracy(p, 100))

