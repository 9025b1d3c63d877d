"""Family A: sources, cleaning, universe, freshness and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from candela.operators import cleaning as cl
from candela.plans.common import rounded, sql_round
from candela.plans.registry import register
from candela.plans.sql_parts import BARS_SQL, with_ctes
from candela.sources import bars as bs
from candela.sources import tables

START = "1995-01-01"
B = ["symbol", "d", "open", "high", "low", "close", "volume"]
RB = ", ".join(["symbol", "d"] + [f"{sql_round(c)} AS {c}" for c in B[2:]])


def _bars_sql(where: str = "") -> str:
    return with_ctes([("b", BARS_SQL)], f"SELECT {RB} FROM b {where}")


@register("bars_from_trades", _bars_sql())
def bars_from_trades(spark, sf_dir):
    return rounded(tables.bars(spark, sf_dir))


@register("bars_scan", _bars_sql(f"WHERE d >= DATE '{START}'"))
def bars_scan(spark, sf_dir):
    return rounded(bs.bars_scan(spark, tables.stored_bars_path(spark, sf_dir), START))


@register("bars_sink", _bars_sql())
def bars_sink(spark, sf_dir):
    return rounded(spark.read.parquet(tables.stored_bars_path(spark, sf_dir)).select(*B))


def _feed_sql(where: str) -> str:
    return BARS_SQL.replace("FROM lineitem", f"FROM lineitem {where}")


@register("source_priority", with_ctes([
    ("f0", _feed_sql("WHERE l_quantity = 50")), ("f1", _feed_sql("WHERE l_linenumber = 1")), ("f2", BARS_SQL),
    ("allf", "SELECT *, 0 AS pr FROM f0 UNION ALL SELECT *, 1 FROM f1 UNION ALL SELECT *, 2 FROM f2"),
    ("pick", "SELECT symbol, min(pr) AS pr FROM (SELECT symbol, pr FROM allf GROUP BY symbol, pr HAVING count(*) >= 51) GROUP BY symbol")],
    f"SELECT {RB}, a.pr AS source_rank FROM allf a JOIN pick p USING (symbol, pr)"))
def source_priority(spark, sf_dir):
    return rounded(bs.source_priority(tables.bar_feeds(spark, sf_dir), 51))


@register("chart_json_source", with_ctes([("b", BARS_SQL)], f"""SELECT symbol, d, {sql_round('open')} AS open,
  {sql_round('high')} AS high, {sql_round('low')} AS low,
  {sql_round("CASE WHEN symbol LIKE 'A%' THEN close * 0.98 ELSE close END")} AS close,
  {sql_round('volume')} AS volume FROM b WHERE dayofmonth(d) <> 15"""))
def chart_json_source(spark, sf_dir):
    return rounded(bs.chart_json_source(tables.chart_docs(spark, sf_dir)))


@register("csv_source", with_ctes([("b", BARS_SQL)], f"""SELECT symbol, d, {sql_round('open')} AS open,
  {sql_round('high')} AS high, {sql_round('low')} AS low, {sql_round('close * 0.98')} AS close,
  {sql_round('volume')} AS volume FROM b"""))
def csv_source(spark, sf_dir):
    return rounded(bs.csv_source(spark, tables.csv_bars_path(spark, sf_dir)))


_RAW = BARS_SQL.replace("l_returnflag || '-' || l_linestatus AS symbol,",
                        "l_returnflag || '-' || l_linestatus AS symbol, l_linenumber AS arrival,").replace(
    "GROUP BY 1, 2", "GROUP BY 1, 2, 3")


@register("clean_bars", with_ctes([
    ("raw", _RAW),
    ("last", """SELECT symbol, d, arg_max(open, arrival) AS open, arg_max(high, arrival) AS high, arg_max(low, arrival) AS low,
       arg_max(close, arrival) AS close, arg_max_null(CASE WHEN arrival = 3 THEN NULL ELSE volume END, arrival) AS volume,
       max(arrival) AS a FROM raw GROUP BY symbol, d"""),
    ("ok", "SELECT * FROM last WHERE open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL AND volume IS NOT NULL")],
    f"SELECT {RB} FROM ok WHERE symbol IN (SELECT symbol FROM ok GROUP BY symbol HAVING count(*) >= 120)"))
def clean_bars(spark, sf_dir):
    return rounded(cl.clean_bars(tables.raw_bar_feed(spark, sf_dir), "arrival", 120))


UNIVERSE = ["A-F", "N-F", "R-F", "R-O"]


@register("universe_filter", _bars_sql("WHERE symbol IN (" + ", ".join(f"'{s}'" for s in UNIVERSE) + ")"))
def universe_filter(spark, sf_dir):
    u = spark.createDataFrame([(s,) for s in UNIVERSE], "symbol string")
    return rounded(cl.universe_filter(tables.bars(spark, sf_dir), u))


@register("market_session", """SELECT event_id, ts, is_open, CASE WHEN is_open THEN 3600 ELSE 21600 END AS ttl_sec FROM (
  SELECT event_id, ts, isodow(lt) < 6 AND hour(lt) * 60 + minute(lt) >= 570 AND hour(lt) * 60 + minute(lt) < 960 AS is_open
  FROM (SELECT event_id, ts, timezone('America/New_York', ts AT TIME ZONE 'UTC') AS lt FROM events))""")
def market_session(spark, sf_dir):
    ev = tables.table(spark, sf_dir, "events").select("event_id", "ts")
    is_open, ttl = cl.market_session(F.col("ts"))
    return ev.select("event_id", "ts", is_open.alias("is_open"), ttl.alias("ttl_sec"))


@register("freshness_report", with_ctes([
    ("b", BARS_SQL),
    ("asoft", "SELECT max(l_shipdate) + INTERVAL 2 HOURS AS t FROM lineitem"),
    ("loads", "SELECT l_returnflag || '-' || l_linestatus AS symbol, max(l_shipdate) AS loaded_at FROM lineitem GROUP BY 1"),
    ("sess", """SELECT CASE WHEN isodow(lt) < 6 AND hour(lt) * 60 + minute(lt) BETWEEN 570 AND 959 THEN 3600 ELSE 21600 END AS ttl
        FROM (SELECT timezone('America/New_York', t AT TIME ZONE 'UTC') AS lt FROM asoft)""")],
    """SELECT l.symbol, round(epoch(a.t - l.loaded_at) / 60 + 1e-9, 1) AS age_min, s.rows,
  strftime(s.last_date, '%Y-%m-%d') AS last_date, epoch(a.t - l.loaded_at) < (SELECT ttl FROM sess) AS fresh
  FROM loads l JOIN (SELECT symbol, count(*) AS rows, max(d) AS last_date FROM b GROUP BY symbol) s USING (symbol), asoft a"""))
def freshness_report(spark, sf_dir):
    return rounded(cl.freshness_report(tables.symbol_loads(spark, sf_dir), tables.bars(spark, sf_dir),
                                       tables.data_as_of(spark, sf_dir)))


REFRESH_UNIVERSE = ["A-F", "X-1", "A-O", "N-F", "X-2", "N-O", "R-F", "X-3", "R-O", "X-4", "X-5", "A-F2"]


@register("refresh_report", "SELECT symbol, CAST(idx AS INTEGER) AS idx, CASE WHEN idx >= 10 THEN 'skipped' WHEN symbol IN "
          "(SELECT DISTINCT l_returnflag || '-' || l_linestatus FROM lineitem) THEN 'refreshed' ELSE 'failed' END AS status "
          "FROM (VALUES " + ", ".join(f"('{s}', {i})" for i, s in enumerate(REFRESH_UNIVERSE)) + ") v(symbol, idx)")
def refresh_report(spark, sf_dir):
    return cl.refresh_report(spark, REFRESH_UNIVERSE, tables.bars(spark, sf_dir), 10)
