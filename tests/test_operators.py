"""Operator behaviour on the reference's own fixtures and invariants."""

import datetime
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candela.operators import backtest as bt
from candela.operators import ledger as lg
from candela.operators import snapshot as snp
from candela.operators import text as tx
from candela.operators import wallet as wl


def synthetic_bars(spark, n=160, symbol="AAPL"):
    """FIXTURES.md 1: close = linspace(200, 80, n) + 3 sin(i), high +1 %,
    low -1 %, volume 1e6, daily from 2024-01-01."""
    i = np.arange(n)
    close = np.linspace(200, 80, n) + 3 * np.sin(i)
    pdf = pd.DataFrame({"symbol": symbol, "d": (pd.Timestamp("2024-01-01") + pd.to_timedelta(i, "D")).date,
                        "open": close, "high": close * 1.01, "low": close * 0.99, "close": close,
                        "volume": 1_000_000.0})
    return spark.createDataFrame(pdf)


def test_backtest_short_trades_on_falling_series(spark):
    bars = synthetic_bars(spark)
    params = bt.params_frame((14,), (365,), 1000.0, True)
    trades = bt.backtest_trades(bars, params).toPandas()
    assert len(trades) > 0
    recent = bt.recent_trades(bars, params, 10).toPandas()
    shorts = recent[recent["signal"] == "short"]
    assert len(shorts) > 0 and shorts["won"].map(lambda v: isinstance(v, (bool, np.bool_))).all()
    summ = bt.backtest_summary(bars, params).toPandas()
    assert (summ["max_drawdown"] >= 0).all()
    assert int(summ["trade_count"].iloc[0]) == int(trades["won"].notna().sum())


def test_backtest_loop_equivalence(spark):
    """The window form equals a plain loop over the same rules."""
    bars = synthetic_bars(spark, n=200)
    params = bt.params_frame((7,), (90,), 1000.0, True)
    got = bt.backtest_trades(bars, params).toPandas().sort_values("p")
    c = bars.toPandas()["close"].to_numpy()[-(90 + 7 + 60):]
    n, exp = len(c), []
    for i in range(60, n - 7, 7):
        w = c[max(0, i - 60): i + 1]
        d = np.diff(w[-15:])
        g = d[d > 0].sum() / 14 if (d > 0).any() else 0.0
        lo = (-d[d < 0]).sum() / 14 if (d < 0).any() else 1e-9
        rsi = 100 - 100 / (1 + g / lo)
        s20, s50 = w[-20:].mean(), w[-50:].mean()
        sig = "long" if (rsi < 55 and w[-1] > s20 > s50) else ("short" if (rsi > 65 or w[-1] < s20 < s50) else "neutral")
        raw = (c[i + 7] - c[i]) / c[i]
        ret = raw if sig == "long" else (-raw if sig == "short" else 0.0)
        exp.append((sig, round(ret * 100, 2)))
    assert [(s, round(r, 2)) for s, r in zip(got["signal"], got["pct_return"])] == exp


def test_intent_route_backtest_question(spark):
    msgs = spark.createDataFrame([("Allow short selling nedir?",), ("",), ("x" * 601,), ("hi",)], "message string")
    out = tx.intent_route(msgs).toPandas()
    assert out["intent"].tolist()[0] == "backtest" and out["link"].tolist()[0] == "/backtest"
    assert out["error"].tolist()[1] == "empty message"
    assert out["error"].tolist()[2].startswith("over 600")
    assert out["intent"].tolist()[3] == "help"


def test_snapshot_labels_and_score_bounds(spark):
    bars = synthetic_bars(spark, n=120)
    snap = snp.technical_snapshot(bars).toPandas()
    assert snap["trend"].iloc[0] == "bearish"
    assert 0 <= snap["rsi"].iloc[0] <= 100
    sc = snp.screener(snp.technical_snapshot(bars), "momentum").toPandas()
    assert 0 <= sc["score"].iloc[0] <= 100


def test_feature_bounds(spark, sf):
    from candela.operators import indicators as ind
    from candela.sources import tables
    fm = ind.feature_matrix(tables.bars(spark, sf), trim="ref")
    r = fm.agg(F.min("rsi_14"), F.max("rsi_14"), F.min("bb_pct"), F.max("bb_pct"),
               F.min("v_ratio"), F.max("v_ratio"), F.count("*")).first()
    assert 0 <= r[0] <= r[1] <= 100 and 0 <= r[2] <= r[3] <= 1 and 0 <= r[4] <= r[5] <= 10 and r[6] > 0


def test_wallet_closed_form_equals_loop(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(300):
        u = int(rng.integers(0, 4))
        kind = "credit" if rng.random() < 0.15 else "debit"
        rows.append((u, pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=int(i * 37)), i, kind,
                     int(rng.integers(1, 4))))
    pdf = pd.DataFrame(rows, columns=["user_id", "ts", "id", "kind", "tokens"])
    cr = spark.createDataFrame(pdf[pdf.kind == "credit"][["user_id", "ts", "id", "tokens"]])
    db = spark.createDataFrame(pdf[pdf.kind == "debit"][["user_id", "ts", "id"]])
    users = spark.createDataFrame([(u,) for u in range(5)], "user_id long")
    got = wl.wallet_balance(users, wl.wallet_ledger(users, cr, db)).toPandas().set_index("user_id")
    for u in range(5):
        b, refused = 5, 0
        for r in pdf[pdf.user_id == u].sort_values(["ts", "id"]).itertuples():
            if r.kind == "credit":
                b += r.tokens
            elif b <= 0:
                refused += 1
            else:
                b -= 1
        assert got.loc[u, "balance"] == b and got.loc[u, "refused"] == refused


def test_ledger_fold_conserves_cash_and_matches_loop(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(200):
        rows.append((int(rng.integers(0, 3)), i, pd.Timestamp("2024-01-01") + pd.Timedelta(hours=i),
                     str(rng.choice(["A", "B"])), str(rng.choice(["buy", "buy", "sell"])),
                     float(rng.integers(1, 40)), float(rng.uniform(50, 150))))
    pdf = pd.DataFrame(rows, columns=["user_id", "order_id", "executed_at", "symbol", "action", "quantity", "price"])
    led = lg.ledger_apply(spark.createDataFrame(pdf), 10000.0).toPandas()
    for u, g in pdf.groupby("user_id"):
        cash, pos = 10000.0, {}
        for r in g.sort_values(["executed_at", "order_id"]).itertuples():
            cost = lg.r6(r.quantity * r.price)
            if r.action == "buy" and cash >= cost:
                cash = lg.r6(cash - cost)
                q, a = pos.get(r.symbol, (0.0, 0.0))
                pos[r.symbol] = (lg.r6(q + r.quantity), lg.r6((a * q + r.price * r.quantity) / (q + r.quantity)) if q else lg.r6(r.price))
            elif r.action == "sell" and pos.get(r.symbol, (0, 0))[0] >= r.quantity:
                cash = lg.r6(cash + cost)
                q = lg.r6(pos[r.symbol][0] - r.quantity)
                pos[r.symbol] = (q, pos[r.symbol][1])
                if q < 1e-6:
                    del pos[r.symbol]
        last = led[led.user_id == u].sort_values(["executed_at", "order_id"]).iloc[-1]
        assert math.isclose(last["cash_after"], cash, abs_tol=1e-9)


@pytest.mark.parametrize("block", [5, 41, 512])
def test_ledger_rounds_equal_a_plain_loop(spark, block):
    """Null users share an account, large ids stay whole, blocks of any size give the same statuses."""
    rng = np.random.default_rng(8)
    big = 9007199254740993
    rows = []
    for i in range(240):
        user = [None, big, big - 1, 3][int(rng.integers(0, 4))]
        when = None if i % 40 == 0 else datetime.datetime(2024, 1, 1) + datetime.timedelta(days=int(rng.integers(0, 90)))
        rows.append((user, big + i, when, [None, "A", "B"][int(rng.integers(0, 3))], ["buy", "buy", "sell", "hold", None][int(rng.integers(0, 5))],
                     [float(rng.integers(0, 40)), None][int(i % 31 == 0)], [float(rng.uniform(50, 150)), None, float("nan")][int(rng.choice(3, p=[.9, .05, .05]))]))
    ddl = "user_id long, order_id long, executed_at timestamp_ntz, symbol string, action string, quantity double, price double"
    got = {r.order_id: r for r in lg.ledger_apply(spark.createDataFrame(rows, ddl), 10000.0, block).collect()}
    assert len(got) == len(rows)
    for user in (None, big, big - 1, 3):
        cash, held = 10000.0, {}
        mine = sorted((r for r in rows if r[0] == user), key=lambda r: (r[2] is not None, r[2] or datetime.datetime.min, r[1]))
        for u, oid, _, sym, action, q, px in mine:
            h = held.get(sym)
            cost = None if px is None or px != px or q is None else lg.r6(q * px)
            if px is None or px != px:
                status = "no_price"
            elif q is None or q <= 0 or action not in ("buy", "sell"):
                status = "invalid"
            elif action == "buy":
                status = "executed" if cash >= cost else "insufficient_cash"
                if status == "executed":
                    cash = lg.r6(cash - cost)
                    held[sym] = (lg.r6(h[0] + q), lg.r6((h[1] * h[0] + px * q) / (h[0] + q))) if h else (lg.r6(q), lg.r6(px))
            else:
                status = "executed" if h and h[0] >= q else "insufficient_position"
                if status == "executed":
                    cash = lg.r6(cash + cost)
                    held[sym] = (lg.r6(h[0] - q), h[1])
                    if held[sym][0] < lg.DUST:
                        del held[sym]
            r = got[oid]
            assert (r.user_id, r.status, r.cash_after) == (u, status, cash)
            assert (r.position_qty, r.position_avg) == held.get(sym, (0.0, None))


def test_two_buys_of_a_null_user_share_the_cash(spark):
    rows = [(None, 1, datetime.datetime(2024, 1, 1), "A", "buy", 60.0, 100.0), (None, 2, datetime.datetime(2024, 1, 2), "A", "buy", 60.0, 100.0)]
    ddl = "user_id long, order_id long, executed_at timestamp_ntz, symbol string, action string, quantity double, price double"
    assert [r.status for r in lg.ledger_apply(spark.createDataFrame(rows, ddl)).orderBy("order_id").collect()] == ["executed", "insufficient_cash"]
    assert lg.ledger_apply(spark.createDataFrame([], ddl)).count() == 0


def test_ridge_matches_closed_form(spark):
    from candela.operators import forecast as fc
    rng = np.random.default_rng(2)
    n, k = 150, 3
    X = rng.normal(size=(n, k))
    y = X @ np.array([0.5, -0.2, 0.1]) + 0.3 + rng.normal(0, 0.1, n)
    pdf = pd.DataFrame(X, columns=["a", "b", "c"]).assign(symbol="S", split="train", target_lr=y)
    m = fc.forecast_ridge(spark.createDataFrame(pdf), ["a", "b", "c"], 2.0).toPandas()
    xc, yc = X - X.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + 2.0 * np.eye(k), xc.T @ yc)
    assert np.allclose(m["coef"].iloc[0], w) and math.isclose(m["intercept"].iloc[0], y.mean() - X.mean(0) @ w)


def test_forecast_steps_stay_within_clip(spark, sf):
    from candela.plans import q_forecast
    fut = q_forecast.forecast_rolling(spark, sf).toPandas().sort_values(["symbol", "step"])
    for _, g in fut.groupby("symbol"):
        p = g["predicted"].to_numpy()
        assert (np.abs(np.log(p[1:] / p[:-1])) <= 0.15 + 1e-12).all()


def test_correlation_symmetric_unit_diagonal(spark, sf):
    from candela.plans import q_correlation
    m = q_correlation.correlation_matrix(spark, sf).toPandas()
    d = {(r.a, r.b): r.r for r in m.itertuples()}
    assert all(abs(d[(a, a)] - 1.0) < 1e-9 for a, _ in d if (a, a) in d)
    assert all(abs(d[(a, b)] - d[(b, a)]) < 1e-9 for a, b in d)
