"""Family D: signals and backtests over the processed series."""

from __future__ import annotations

from candela.functions.scalar import sql_rnd as R
from candela.operators import backtest as bt
from candela.plans.common import rounded
from candela.plans.q_snapshot import SER
from candela.plans.registry import register
from candela.plans.sql_parts import trimmed_ctes, with_ctes
from candela.sources import tables

# Default run of the reference test: horizon 14, lookback 365, capital 1000, shorts allowed.
DEFAULT = bt.params_frame((14,), (365,), 1000.0, True)
SWEEP = bt.params_frame(bt.HORIZONS, bt.LOOKBACKS, 1000.0, True)
K = "symbol, horizon, lookback, capital, allow_short"


def _params_sql(params) -> str:
    rows = ", ".join(f"({h}, {lb}, {cap}::DOUBLE, {str(sh).lower()})" for h, lb, cap, sh in params)
    return f"SELECT * FROM (VALUES {rows}) v(horizon, lookback, capital, allow_short)"


def _signal_sql(part: str) -> str:
    w = f"OVER (PARTITION BY {part} ORDER BY p ROWS BETWEEN {{a}} PRECEDING AND CURRENT ROW)"
    dd = f"(close - lag(close) OVER (PARTITION BY {part} ORDER BY p))"
    return f"""CASE WHEN least(p + 1, 61) < 15 THEN 'neutral'
      WHEN rsi < 55 AND close > s20 AND s20 > s50 THEN 'long'
      WHEN rsi > 65 OR (close < s20 AND s20 < s50) THEN 'short' ELSE 'neutral' END""", f"""
      100 - 100 / (1 + avg(CASE WHEN dd > 0 THEN dd ELSE 0.0 END) {w.format(a=13)}
        / CASE WHEN max(CASE WHEN dd < 0 THEN -dd ELSE 0.0 END) {w.format(a=13)} > 0
               THEN avg(CASE WHEN dd < 0 THEN -dd ELSE 0.0 END) {w.format(a=13)} ELSE 1e-9 END) AS rsi,
      CASE WHEN least(p + 1, 61) >= 20 THEN avg(close) {w.format(a=19)} ELSE close END AS s20,
      CASE WHEN least(p + 1, 61) >= 50 THEN avg(close) {w.format(a=49)} ELSE close END AS s50""", dd


def bt_ctes(params) -> list[tuple[str, str]]:
    sig, cols, dd = _signal_sql(K)
    return trimmed_ctes() + [SER,
        ("prm", _params_sql(params)),
        ("bt0", """SELECT s.symbol, s.d, s.close, v.horizon, v.lookback, v.capital, v.allow_short,
            s.pos - greatest(s.n - (v.lookback + v.horizon + 60), 0) AS p,
            least(s.n, v.lookback + v.horizon + 60) AS n
            FROM ser s, prm v WHERE s.pos >= s.n - (v.lookback + v.horizon + 60)"""),
        ("bt1", f"SELECT *, {dd} AS dd FROM bt0 WHERE n >= 3 * horizon AND n > 60"),
        ("bt2", f"SELECT *, {cols}, lead(close, horizon) OVER (PARTITION BY {K} ORDER BY p) AS exit_px FROM bt1"),
        ("bt3", f"SELECT *, {sig} AS signal FROM bt2"),
        ("trades", f"""SELECT {K}, p, d, signal, {R('close', 2)} AS entry, {R('exit_px', 2)} AS exit,
            {R('''CASE WHEN signal = 'long' THEN (exit_px - close) / close
                 WHEN signal = 'short' AND allow_short THEN -(exit_px - close) / close ELSE 0.0 END * 100''', 2)} AS pct_return,
            CASE WHEN signal = 'long' THEN (exit_px - close) / close > 0
                 WHEN signal = 'short' AND allow_short THEN (exit_px - close) / close < 0 END AS won
            FROM bt3 WHERE p >= 60 AND p < n - horizon AND (p - 60) % horizon = 0"""),
        ("equity", f"""SELECT b.symbol, b.horizon, b.lookback, b.capital, b.allow_short, b.p, b.d,
            {R('b.capital * coalesce(product(CASE WHEN b.p > 60 THEN 1 + t.pct_return / 100 END) OVER (PARTITION BY b.symbol, b.horizon, b.lookback, b.capital, b.allow_short ORDER BY b.p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1.0)', 2)} AS portfolio,
            {R('b.close / first(b.close) OVER (PARTITION BY b.symbol, b.horizon, b.lookback, b.capital, b.allow_short ORDER BY b.p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * b.capital', 2)} AS buy_and_hold
            FROM bt3 b LEFT JOIN trades t USING (symbol, horizon, lookback, capital, allow_short, p) WHERE b.p >= 60"""),
        ("dd", f"""SELECT {K}, {R('greatest(0.0, max((pk - v) / pk * 100))', 2)} AS max_drawdown FROM (
            SELECT *, greatest(capital, max(v) OVER (PARTITION BY {K} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS pk
            FROM (SELECT *, capital * product(1 + pct_return / 100) OVER (PARTITION BY {K} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v
                  FROM trades)) GROUP BY {K}"""),
        ("summ", f"""SELECT {K}, {R('(final_value - capital) / capital * 100', 2)} AS total_return,
            {R('(bah - capital) / capital * 100', 2)} AS bah_return,
            {R('CASE WHEN coalesce(tc, 0) > 0 THEN wc / tc * 100 ELSE 0.0 END', 1)} AS win_rate,
            {R('CASE WHEN coalesce(tc, 0) > 1 AND sd > 0 THEN m / sd * sqrt(252.0 / horizon) ELSE 0.0 END', 2)} AS sharpe,
            coalesce(max_drawdown, 0.0) AS max_drawdown, CAST(coalesce(tc, 0) AS BIGINT) AS trade_count,
            CAST(coalesce(wc, 0) AS BIGINT) AS win_count, {R('final_value', 2)} AS final_value
            FROM (SELECT {K}, arg_max(portfolio, p) AS final_value, arg_max(buy_and_hold, p) AS bah FROM equity GROUP BY {K})
            LEFT JOIN (SELECT {K}, count(*) FILTER (WHERE won IS NOT NULL) AS tc, count(*) FILTER (WHERE won) AS wc,
                       avg(pct_return / 100) FILTER (WHERE won IS NOT NULL) AS m,
                       stddev_pop(pct_return / 100) FILTER (WHERE won IS NOT NULL) AS sd FROM trades GROUP BY {K}) USING ({K})
            LEFT JOIN dd USING ({K})"""),
    ]


def _series(spark, sf_dir):
    return tables.processed(spark, sf_dir)


_sig_w = "OVER (PARTITION BY symbol ORDER BY p ROWS BETWEEN {a} PRECEDING AND CURRENT ROW)"


@register("trade_signal", with_ctes(trimmed_ctes() + [SER,
    ("ts0", "SELECT symbol, d, close, pos AS p, close - lag(close) OVER (PARTITION BY symbol ORDER BY pos) AS dd FROM ser"),
    ("ts1", f"""SELECT *, 100 - 100 / (1 + avg(CASE WHEN dd > 0 THEN dd ELSE 0.0 END) {_sig_w.format(a=13)}
        / CASE WHEN max(CASE WHEN dd < 0 THEN -dd ELSE 0.0 END) {_sig_w.format(a=13)} > 0
               THEN avg(CASE WHEN dd < 0 THEN -dd ELSE 0.0 END) {_sig_w.format(a=13)} ELSE 1e-9 END) AS rsi,
        CASE WHEN least(p + 1, 61) >= 20 THEN avg(close) {_sig_w.format(a=19)} ELSE close END AS s20,
        CASE WHEN least(p + 1, 61) >= 50 THEN avg(close) {_sig_w.format(a=49)} ELSE close END AS s50 FROM ts0""")],
    f"SELECT symbol, d, {_signal_sql('symbol')[0]} AS signal FROM ts1"))
def trade_signal(spark, sf_dir):
    return bt.trade_signal(_series(spark, sf_dir))


@register("backtest_trades", with_ctes(bt_ctes(DEFAULT), "SELECT * FROM trades"))
def backtest_trades(spark, sf_dir):
    return rounded(bt.backtest_trades(_series(spark, sf_dir), DEFAULT))


@register("backtest_equity", with_ctes(bt_ctes(DEFAULT), "SELECT * FROM equity"))
def backtest_equity(spark, sf_dir):
    return rounded(bt.backtest_equity(_series(spark, sf_dir), DEFAULT))


@register("backtest_summary", with_ctes(bt_ctes(DEFAULT), "SELECT * FROM summ"))
def backtest_summary(spark, sf_dir):
    return rounded(bt.backtest_summary(_series(spark, sf_dir), DEFAULT))


@register("max_drawdown", with_ctes(bt_ctes(DEFAULT), "SELECT * FROM dd"))
def max_drawdown(spark, sf_dir):
    return rounded(bt.max_drawdown(_series(spark, sf_dir), DEFAULT))


@register("recent_trades", with_ctes(bt_ctes(DEFAULT), f"""SELECT * FROM (SELECT *,
    row_number() OVER (PARTITION BY {K} ORDER BY p DESC) AS rank FROM trades) WHERE rank <= 10"""))
def recent_trades(spark, sf_dir):
    return rounded(bt.recent_trades(_series(spark, sf_dir), DEFAULT, 10))


_RISK = ("CASE WHEN max_drawdown >= 20 OR sharpe < 0 THEN 'HIGH' "
         "WHEN max_drawdown >= 10 OR sharpe < 1 THEN 'MEDIUM' ELSE 'LOW' END")


@register("backtest_explain", with_ctes(bt_ctes(DEFAULT), f"""SELECT {K}, edge AS edge_vs_buy_hold, {_RISK} AS risk,
  CASE WHEN edge > 3 THEN printf('Edge of %+.2f%% over holding %s.', edge, symbol)
       WHEN edge < -3 THEN printf('Edge of %+.2f%%: holding paid more.', edge)
       ELSE 'No clear edge over holding.' END AS summary,
  concat_ws(' ', printf('%s%% of %d trades won.', CAST(win_rate AS VARCHAR), trade_count),
    printf('Largest fall %s%% (%s risk).', CAST(max_drawdown AS VARCHAR), lower({_RISK})),
    printf('Sharpe %s (%s).', CAST(sharpe AS VARCHAR),
           CASE WHEN sharpe >= 1 THEN 'strong' WHEN sharpe < 0 THEN 'weak' ELSE 'moderate' END)) AS notes,
  coalesce(nullif(concat_ws(' ', CASE WHEN trade_count < 5 THEN 'Too few trades: lengthen the lookback.' END,
    CASE WHEN max_drawdown >= 15 THEN 'Deep falls: shorten the horizon or turn shorts off.' END,
    CASE WHEN win_rate < 45 THEN 'Few wins: ask for a stronger entry signal.' END), ''),
    'Repeat with horizons of 30 and 90 before relying on it.') AS suggestions
  FROM (SELECT *, {R('total_return - bah_return', 2)} AS edge FROM summ)"""))
def backtest_explain(spark, sf_dir):
    return rounded(bt.backtest_explain(bt.backtest_summary(_series(spark, sf_dir), DEFAULT)))


@register("backtest_sweep", with_ctes(bt_ctes(SWEEP), "SELECT * FROM summ"))
def backtest_sweep(spark, sf_dir):
    return rounded(bt.backtest_summary(_series(spark, sf_dir), SWEEP))
