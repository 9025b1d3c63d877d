"""Family C: snapshots, screening and chart series over the processed series."""

from __future__ import annotations

from candela.functions.scalar import sql_rnd as R
from candela.operators import snapshot as snp
from candela.plans.common import rounded
from candela.plans.registry import register
from candela.plans.sql_parts import symbol_of, trimmed_ctes, with_ctes
from candela.sources import tables

# ---------------------------------------------------------------- SQL parts

SER = ("ser", """SELECT symbol, d, open, high, low, close, volume, rsi_14, macd, macd_sig, bb_pct,
  row_number() OVER (PARTITION BY symbol ORDER BY d) - 1 AS pos,
  count(*) OVER (PARTITION BY symbol) AS n FROM ft""")

LAST2 = ("last2", """SELECT symbol, max(d) AS d, max(close) FILTER (WHERE pos = n - 1) AS cur,
  max(close) FILTER (WHERE pos = n - 2) AS prev FROM ser WHERE pos >= n - 2 GROUP BY symbol""")

SNAP = [
    ("tl", """SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY pos) - 1 AS pct,
       close - lag(close) OVER (PARTITION BY symbol ORDER BY pos) AS diff
       FROM ser WHERE pos >= n - 62 AND n >= 30"""),
    ("ag", """SELECT symbol, any_value(n) AS n,
       max(close) FILTER (WHERE pos = n - 1) AS cur,
       max(close) FILTER (WHERE pos = n - 2) AS prev,
       max(close) FILTER (WHERE pos = n - 21) AS c21,
       max(close) FILTER (WHERE pos = n - 61) AS c61,
       avg(close) FILTER (WHERE pos >= n - 20) AS sma20,
       avg(close) FILTER (WHERE pos >= n - 50) AS sma50_raw,
       stddev_samp(pct) FILTER (WHERE pos >= n - 20) AS sd20,
       avg(greatest(diff, 0.0)) FILTER (WHERE pos >= n - 14) AS gains,
       avg(-least(diff, 0.0)) FILTER (WHERE pos >= n - 14) AS losses
       FROM tl GROUP BY symbol"""),
    ("sn0", """SELECT symbol, cur AS p,
       CASE WHEN prev IS NOT NULL AND prev <> 0 THEN (cur - prev) / prev * 100 ELSE 0.0 END AS c1,
       CASE WHEN n > 21 AND c21 <> 0 THEN (cur - c21) / c21 * 100 ELSE 0.0 END AS c20,
       CASE WHEN n > 61 AND c61 <> 0 THEN (cur - c61) / c61 * 100
            WHEN n > 21 AND c21 <> 0 THEN (cur - c21) / c21 * 100 ELSE 0.0 END AS c60,
       sma20 AS s20, CASE WHEN n >= 50 THEN sma50_raw ELSE sma20 END AS s50,
       coalesce(sd20 * sqrt(252) * 100, 0.0) AS vol,
       coalesce(100 - 100 / (1 + CASE WHEN losses <> 0 THEN gains / losses ELSE 99.0 END), 50.0) AS rsi
       FROM ag"""),
    ("snap", f"""SELECT symbol, {R('p', 4)} AS price, {R('c1', 2)} AS change_1d, {R('c20', 2)} AS change_20d,
       {R('c60', 2)} AS change_60d, {R('s20', 4)} AS sma20, {R('s50', 4)} AS sma50, {R('rsi', 2)} AS rsi,
       CASE WHEN rsi >= 70 THEN 'overbought' WHEN rsi <= 30 THEN 'oversold' ELSE 'neutral' END AS rsi_state,
       CASE WHEN p > s20 AND s20 > s50 THEN 'bullish' WHEN p < s20 AND s20 < s50 THEN 'bearish' ELSE 'mixed' END AS trend,
       {R('vol', 2)} AS volatility FROM sn0"""),
]

SNAP_COLS = ("symbol, price, change_1d, change_20d, change_60d, sma20, sma50, rsi, rsi_state, "
             "trend, volatility")


def risk_sql(er: str | None = None) -> str:
    pts = ("(CASE WHEN volatility >= 55 THEN 2 WHEN volatility >= 35 THEN 1 ELSE 0 END"
           " + CASE WHEN rsi_state IN ('overbought', 'oversold') THEN 1 ELSE 0 END"
           " + CASE WHEN trend = 'mixed' THEN 1 ELSE 0 END")
    if er:
        pts += f" + CASE WHEN abs({er}) >= 12 THEN 1 ELSE 0 END"
    pts += ")"
    return f"CASE WHEN {pts} >= 3 THEN 'HIGH' WHEN {pts} >= 1 THEN 'MEDIUM' ELSE 'LOW' END"


def score_sql(profile: str = "balanced") -> str:
    s = ("50 + CASE trend WHEN 'bullish' THEN 28 WHEN 'mixed' THEN 10 WHEN 'bearish' THEN -18 ELSE 0 END"
         " + greatest(least(change_20d, 25.0), -25.0)"
         " + CASE WHEN rsi >= 45 AND rsi <= 62 THEN 12 WHEN (rsi >= 35 AND rsi < 45) OR (rsi > 62 AND rsi <= 70)"
         " THEN 6 ELSE -10 END - least(volatility / 3, 22.0)")
    if profile == "low_risk":
        s += " - least(volatility / 2, 28.0)"
    elif profile == "momentum":
        s += " + greatest(least(change_60d, 30.0), -20.0) * 0.6"
    return R(f"greatest(0.0, least(100.0, {s}))", 1)


WATCH = ("watch", f"""SELECT o_custkey AS user_id, {symbol_of('o_orderkey')} AS symbol,
  min(o_orderdate) AS added_at FROM orders GROUP BY 1, 2""")

FORECAST = ("fc", f"""SELECT symbol, try_cast(replace(arg_max(pr, (created_at, id)), '$', '') AS DOUBLE) AS prediction
  FROM (SELECT o_orderkey AS id, {symbol_of('o_orderkey')} AS symbol, o_orderdate AS created_at,
        '$' || CAST({R('o_totalprice / 50', 2)} AS VARCHAR) AS pr FROM orders) GROUP BY symbol""")


def snap_query(final: str, extra: list | None = None) -> str:
    return with_ctes(trimmed_ctes() + [SER, LAST2] + SNAP + (extra or []), final)


# ---------------------------------------------------------------- queries

def _series(spark, sf_dir):
    return tables.processed(spark, sf_dir)


def _snap(spark, sf_dir):
    return snp.technical_snapshot(_series(spark, sf_dir))


@register("market_summary", snap_query(f"""SELECT symbol, {R('cur', 2)} AS price,
  {R('(cur - prev) / prev * 100', 2)} AS change,
  CASE WHEN (cur - prev) / prev * 100 >= 0 THEN 'up' ELSE 'down' END AS trend
  FROM last2 WHERE prev IS NOT NULL"""))
def market_summary(spark, sf_dir):
    return rounded(snp.market_summary(_series(spark, sf_dir), None))


@register("latest_price", snap_query(f"""SELECT symbol, {R('cur', 4)} AS price, {R('prev', 4)} AS prev_close,
  {R(f"({R('cur', 4)} - {R('prev', 4)}) / nullif({R('prev', 4)}, 0) * 100", 4)} AS change_pct,
  strftime(d, '%Y-%m-%d') AS date FROM last2 WHERE prev IS NOT NULL"""))
def latest_price(spark, sf_dir):
    return rounded(snp.latest_price(_series(spark, sf_dir)))


@register("price_history", snap_query(f"SELECT symbol, d, {R('close', 2)} AS close FROM ser WHERE pos >= n - 100"))
def price_history(spark, sf_dir):
    return rounded(snp.price_history(_series(spark, sf_dir), 100))


@register("ohlc_history", snap_query(f"""SELECT symbol, d, {R('open', 4)} AS open, {R('high', 4)} AS high,
  {R('low', 4)} AS low, {R('close', 4)} AS close, CAST(volume AS BIGINT) AS volume
  FROM ser WHERE pos >= n - 30 AND open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL"""))
def ohlc_history(spark, sf_dir):
    return rounded(snp.ohlc_history(_series(spark, sf_dir), 30))


@register("volume_direction", snap_query(
    "SELECT symbol, d, CAST(volume AS BIGINT) AS volume, CASE WHEN close >= open THEN 'up' ELSE 'down' END AS direction FROM ser"))
def volume_direction(spark, sf_dir):
    return snp.volume_direction(_series(spark, sf_dir))


_W = "OVER (PARTITION BY symbol ORDER BY k ROWS BETWEEN {p} PRECEDING AND CURRENT ROW)"
_CHART = [
    ("ct", """SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY pos) - 1 AS k,
       close - lag(close) OVER (PARTITION BY symbol ORDER BY pos) AS dd
       FROM ser WHERE pos >= n - 120 AND open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL"""),
    ("cw", f"""SELECT *, avg(close) {_W.format(p=19)} AS m20, stddev_samp(close) {_W.format(p=19)} AS sd,
       avg(close) {_W.format(p=49)} AS m50,
       avg(CASE WHEN dd > 0 THEN dd ELSE 0.0 END) {_W.format(p=13)} AS ag,
       avg(CASE WHEN dd < 0 THEN -dd ELSE 0.0 END) {_W.format(p=13)} AS al,
       max(CASE WHEN dd < 0 THEN 1 ELSE 0 END) {_W.format(p=13)} AS anyl FROM ct"""),
]


@register("chart_overlays", snap_query(f"""SELECT symbol, d, {R('open', 4)} AS open, {R('high', 4)} AS high,
  {R('low', 4)} AS low, {R('close', 4)} AS close,
  CASE WHEN k >= 19 THEN {R('m20', 4)} END AS sma20, CASE WHEN k >= 49 THEN {R('m50', 4)} END AS sma50,
  CASE WHEN k >= 19 THEN {R('m20', 4)} END AS bb_mid, CASE WHEN k >= 19 THEN {R('m20 + 2 * sd', 4)} END AS bb_upper,
  CASE WHEN k >= 19 THEN {R('m20 - 2 * sd', 4)} END AS bb_lower,
  CASE WHEN k >= 14 THEN {R('100 - 100 / (1 + ag / CASE WHEN anyl = 1 THEN al ELSE 1e-9 END)', 2)} END AS rsi14,
  CAST(volume AS BIGINT) AS volume, CASE WHEN close >= open THEN 'up' ELSE 'down' END AS direction FROM cw""", _CHART))
def chart_overlays(spark, sf_dir):
    return rounded(snp.chart_overlays(_series(spark, sf_dir), 120))


@register("period_stats", snap_query("""SELECT symbol, arg_max(c2, d) AS last, max(c2) AS high, min(c2) AS low,
  (arg_max(c2, d) - arg_min(c2, d)) / arg_min(c2, d) * 100 AS change_pct,
  (arg_max(c2, d) - arg_min(c2, d)) / arg_min(c2, d) * 100 >= 0 AS is_up
  FROM (SELECT symbol, d, """ + R('close', 2) + """ AS c2 FROM ser WHERE pos >= n - 100) GROUP BY symbol"""))
def period_stats(spark, sf_dir):
    return rounded(snp.period_stats(_series(spark, sf_dir), 100))


@register("technical_snapshot", snap_query(f"SELECT {SNAP_COLS} FROM snap"))
def technical_snapshot(spark, sf_dir):
    return rounded(_snap(spark, sf_dir))


@register("trend_label", snap_query("SELECT symbol, trend FROM snap"))
def trend_label(spark, sf_dir):
    return _snap(spark, sf_dir).select("symbol", "trend")


@register("rsi_state", snap_query("SELECT symbol, rsi, rsi_state FROM snap"))
def rsi_state(spark, sf_dir):
    return rounded(_snap(spark, sf_dir).select("symbol", "rsi", "rsi_state"))


@register("risk_level", snap_query(f"SELECT symbol, {risk_sql()} AS risk FROM snap"))
def risk_level(spark, sf_dir):
    s = _snap(spark, sf_dir)
    return s.select("symbol", snp.snapshot_risk(s).alias("risk"))


@register("snapshot_score", snap_query(
    f"SELECT symbol, {score_sql('balanced')} AS balanced, {score_sql('low_risk')} AS low_risk, "
    f"{score_sql('momentum')} AS momentum FROM snap"))
def snapshot_score(spark, sf_dir):
    s = _snap(spark, sf_dir)
    return rounded(s.select("symbol", *[snp.snapshot_score(p).alias(p) for p in snp.PROFILES]))


@register("screener", snap_query(f"""SELECT {SNAP_COLS}, {score_sql()} AS score, {risk_sql()} AS risk,
  printf('%s trend, RSI %s, 20d %+.2f%%', trend, CAST(rsi AS VARCHAR), change_20d) AS reason,
  'balanced' AS profile FROM snap ORDER BY score DESC, symbol LIMIT 12"""))
def screener(spark, sf_dir):
    return rounded(snp.screener(_snap(spark, sf_dir), "balanced", 12))


@register("asset_insight", snap_query(f"""SELECT symbol, price, prediction, er AS expected_return,
  CASE WHEN coalesce(er, 0) > 1 THEN 'upside' WHEN coalesce(er, 0) < -1 THEN 'downside' ELSE 'flat' END AS direction,
  {risk_sql('er')} AS risk,
  CASE WHEN trend <> 'mixed' AND {risk_sql('er')} <> 'HIGH' THEN 'HIGH' WHEN {risk_sql('er')} <> 'HIGH' THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
  CASE WHEN coalesce(er, 0) > 1 THEN symbol || ': forecast up over 14 days.'
       WHEN coalesce(er, 0) < -1 THEN symbol || ': forecast down over 14 days.'
       ELSE symbol || ': forecast flat over 14 days.' END AS summary,
  concat_ws('; ', CASE WHEN er IS NOT NULL THEN printf('expected %+.2f%%', er) END, printf('trend %s', trend),
    printf('RSI %s %s', CAST(rsi AS VARCHAR), rsi_state), printf('20 bars %+.2f%%', change_20d), printf('volatility %.2f%%', volatility)) AS bullets
  FROM (SELECT snap.*, fc.prediction,
        CASE WHEN fc.prediction IS NOT NULL AND fc.prediction <> 0 AND price <> 0
             THEN {R('(fc.prediction - price) / price * 100', 2)} END AS er
        FROM snap LEFT JOIN fc USING (symbol))""", [FORECAST]))
def asset_insight(spark, sf_dir):
    return rounded(snp.asset_insight(_snap(spark, sf_dir), tables.latest_forecasts(spark, sf_dir), 14))


_PI = [WATCH, ("items", f"""SELECT w.user_id, w.symbol, w.added_at, s.*, {score_sql()} AS score, {risk_sql()} AS risk
  FROM watch w JOIN snap s USING (symbol)"""),
       ("pg", """SELECT user_id, count(*) AS n_items, count(*) FILTER (WHERE trend = 'bullish') AS bullish_count,
  count(*) FILTER (WHERE risk = 'HIGH') AS high_risk_count,
  arg_min(symbol, (-score, -epoch_us(added_at), symbol)) AS best_symbol,
  arg_min(score, (-score, -epoch_us(added_at), symbol)) AS best_score,
  arg_min(symbol, (-volatility, -abs(change_20d), -epoch_us(added_at), symbol)) AS riskiest_symbol,
  arg_min(volatility, (-volatility, -abs(change_20d), -epoch_us(added_at), symbol)) AS riskiest_volatility,
  string_agg(symbol, ',' ORDER BY -score, -epoch_us(added_at), symbol) AS ranked_items
  FROM items GROUP BY user_id""")]


@register("portfolio_insight", snap_query("""SELECT *,
  printf('%d of %d in bullish trend; best score %s, most volatile %s.',
         bullish_count, n_items, best_symbol, riskiest_symbol) AS summary,
  concat_ws(' ', CASE WHEN high_risk_count > 0 THEN printf('High risk: %d held.', high_risk_count) END,
    printf('Follow %s while above its SMA20.', best_symbol),
    CASE WHEN riskiest_symbol <> best_symbol THEN printf('Set close alerts on %s (volatility %s%%).', riskiest_symbol, CAST(riskiest_volatility AS VARCHAR)) END) AS actions
  FROM pg""", _PI))
def portfolio_insight(spark, sf_dir):
    return rounded(snp.portfolio_insight(tables.watchlist(spark, sf_dir), _snap(spark, sf_dir)))


_WQ = f"""SELECT w.user_id, w.symbol, strftime(w.added_at, '%Y-%m-%d') AS added_date, w.added_at,
  q.price, q.change FROM watch w LEFT JOIN (SELECT symbol, {R('cur', 2)} AS price,
  {R('(cur - prev) / prev * 100', 2)} AS change FROM last2 WHERE prev IS NOT NULL) q USING (symbol)"""


@register("watchlist_quotes", snap_query(_WQ, [WATCH]))
def watchlist_quotes(spark, sf_dir):
    return rounded(snp.watchlist_quotes(tables.watchlist(spark, sf_dir), _series(spark, sf_dir)))


@register("watchlist_signal", snap_query(
    f"SELECT *, CASE WHEN change > 1 THEN 'UP' WHEN change < -1 THEN 'DOWN' ELSE 'FLAT' END AS signal FROM ({_WQ})",
    [WATCH]))
def watchlist_signal(spark, sf_dir):
    q = snp.watchlist_quotes(tables.watchlist(spark, sf_dir), _series(spark, sf_dir))
    return rounded(snp.watchlist_signal(q))


@register("watchlist_stats", snap_query(f"""SELECT user_id, count(*) AS instruments, avg(chg) AS avg_change,
  arg_min(symbol, (-chg, symbol)) AS best_symbol, max(chg) AS best_change,
  arg_min(symbol, (chg, symbol)) AS worst_symbol, min(chg) AS worst_change,
  count(*) FILTER (WHERE chg >= 0) AS gainers, count(*) FILTER (WHERE chg < 0) AS losers
  FROM watch JOIN (SELECT symbol, ({R('cur', 2)} - {R('prev', 2)}) / {R('prev', 2)} * 100 AS chg
                   FROM last2 WHERE prev IS NOT NULL) USING (symbol) GROUP BY user_id""", [WATCH]))
def watchlist_stats(spark, sf_dir):
    return rounded(snp.watchlist_stats(tables.watchlist(spark, sf_dir), _series(spark, sf_dir)))


_REC = ("rec", f"""SELECT symbol, {R('close', 2)} AS last_price, {R('future', 2)} AS predicted_price,
  {R('(future / close - 1) * 100', 2)} AS potential_gain_pct, {R('rsi_14', 2)} AS rsi,
  CASE WHEN score >= 4 THEN 'STRONG BUY' WHEN score >= 2 THEN 'BUY' WHEN score >= 0 THEN 'HOLD'
       WHEN score >= -2 THEN 'CAUTION' ELSE 'SELL' END AS recommendation,
  CASE WHEN score >= 4 THEN 'LOW' WHEN score >= 2 THEN 'LOW-MED' WHEN score >= 0 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level,
  score FROM (SELECT l.*, fc.prediction AS future,
    CASE WHEN (fc.prediction / close - 1) * 100 > 5 THEN 3 WHEN (fc.prediction / close - 1) * 100 > 2 THEN 2
         WHEN (fc.prediction / close - 1) * 100 > 0 THEN 1 WHEN (fc.prediction / close - 1) * 100 < -2 THEN -2 ELSE 0 END
    + CASE WHEN rsi_14 < 30 THEN 3 WHEN rsi_14 < 45 THEN 1 WHEN rsi_14 > 70 THEN -3 WHEN rsi_14 > 60 THEN -1 ELSE 0 END
    + CASE WHEN macd > macd_sig THEN 1 ELSE -1 END
    + CASE WHEN bb_pct < 0.2 THEN 1 WHEN bb_pct > 0.8 THEN -1 ELSE 0 END AS score
    FROM (SELECT * FROM ser WHERE pos = n - 1) l JOIN fc USING (symbol) WHERE close <> 0)""")


@register("recommendation", snap_query("SELECT * FROM rec", [FORECAST, _REC]))
def recommendation(spark, sf_dir):
    return rounded(snp.recommendation(_series(spark, sf_dir), tables.latest_forecasts(spark, sf_dir)))


COMPARE_PAIRS = [("A-F", "N-O"), ("R-F", "A-O"), ("N-F", "R-O")]


@register("compare_assets", snap_query("""SELECT p.t1, p.t2, a.last_price AS price1, a.predicted_price AS predicted1,
  a.potential_gain_pct AS gain1, a.rsi AS rsi1, b.last_price AS price2, b.predicted_price AS predicted2,
  b.potential_gain_pct AS gain2, b.rsi AS rsi2,
  CASE WHEN a.potential_gain_pct > b.potential_gain_pct THEN p.t1
       WHEN b.potential_gain_pct > a.potential_gain_pct THEN p.t2 ELSE 'NEUTRAL' END AS winner
  FROM (VALUES """ + ", ".join(f"('{a}', '{b}')" for a, b in COMPARE_PAIRS) + """) p(t1, t2)
  JOIN rec a ON a.symbol = p.t1 JOIN rec b ON b.symbol = p.t2""", [FORECAST, _REC]))
def compare_assets(spark, sf_dir):
    rec = snp.recommendation(_series(spark, sf_dir), tables.latest_forecasts(spark, sf_dir))
    pairs = spark.createDataFrame(COMPARE_PAIRS, "t1 string, t2 string")
    return rounded(snp.compare_assets(rec, pairs))

