"""Paper-trading ledger (family H): apply a table of trade orders to cash,
positions and executed trades.

Whether an order executes depends on all earlier ones of its account (cash couples
all symbols), so an account is a sequence, but its state is small: cash and
open positions. ``fold_rounds`` applies blocks of orders of all accounts at once,
in the JVM, and never collects an account.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candela.functions.folds import BLOCK, fold_rounds, let
from candela.functions.scalar import rnd
from candela.functions.windows import asof_join, asof_join_daily

STARTING_CASH = 10000.0
DUST = 1e-6
NUMBER_DAYS = 30       # bucket in which an account's orders are numbered

LEDGER_COLS = ["user_id", "order_id", "executed_at", "symbol", "action", "quantity", "price", "total", "status",
               "cash_after", "position_qty", "position_avg"]
_HELD = "MAP<STRING, STRUCT<q: DOUBLE, a: DOUBLE>>"


def order_pricing(orders: DataFrame, bars: DataFrame) -> DataFrame:
    """Price every order with the newest close known when it is placed: that of a
    day before its own, whose bar closes only after the order."""
    b = bars.select("symbol", F.date_add("d", 1).alias("d"), F.col("close").alias("price"))
    return asof_join_daily(orders, b, "d", ["price"], direction="backward").drop("_asof_d")


def order_pricing_at(orders: DataFrame, quotes: DataFrame, t: str = "executed_at", quote_t: str = "ts", price: str = "px",
                     quote_order: list[str] | None = None, bucket_seconds: int = 86400) -> DataFrame:
    """Price every order with the newest quote (symbol, time, price) at or before its time: intraday fills.

    ``quotes`` may be trades or bars stamped with the time their close is known. ``quote_order`` orders quotes of one time.
    Adds ``price`` and ``priced_at``; orders before the first quote have none.
    """
    q = quotes.select("symbol", F.col(quote_t).alias("_qt"), F.col(price).cast("double").alias("price"), *(quote_order or []))
    return asof_join(orders, q, "symbol", t, "_qt", ["price"], right_order=quote_order,
                     bucket_seconds=bucket_seconds).withColumnRenamed("_asof_t", "priced_at")


def r6(x: float) -> float:
    """Money and quantity rounding to 6 dp: floor(x * 1e6 + 0.5) / 1e6.

    Half-up on the scaled binary value; plain IEEE operations, so any SQL
    engine evaluating the same expression gets the same bits (Python's
    round() differs only at exact ties)."""
    return math.floor(x * 1e6 + 0.5) / 1e6


def _r6(x: str) -> str:
    return f"floor(({x}) * 1e6D + 0.5D) / 1e6D"


def _step() -> str:
    """SQL of the account after order ``o``: (cash, held, out)."""
    status = """CASE WHEN o.price IS NULL THEN 'no_price'
        WHEN coalesce(o.quantity <= 0, true) OR coalesce(o.action NOT IN ('buy', 'sell'), true) THEN 'invalid'
        WHEN o.action = 'buy' AND s.cash < c.cost THEN 'insufficient_cash'
        WHEN o.action = 'sell' AND coalesce(c.h.q < o.quantity, true) THEN 'insufficient_position' ELSE 'executed' END"""
    cash = f"""CASE WHEN st <> 'executed' THEN s.cash WHEN o.action = 'buy' THEN {_r6('s.cash - c.cost')}
        ELSE {_r6('s.cash + c.cost')} END"""
    bought = f"""named_struct('q', CASE WHEN c.h IS NULL THEN {_r6('o.quantity')} ELSE {_r6('c.h.q + o.quantity')} END,
        'a', CASE WHEN c.h IS NULL THEN {_r6('o.price')}
             ELSE {_r6('(c.h.a * c.h.q + o.price * o.quantity) / (c.h.q + o.quantity)')} END)"""
    left = _r6("c.h.q - o.quantity")
    position = f"""CASE WHEN st <> 'executed' THEN c.h WHEN o.action = 'buy' THEN {bought}
        WHEN {left} < {DUST}D THEN NULL ELSE named_struct('q', {left}, 'a', c.h.a) END"""
    others = "map_filter(s.held, (k, v) -> k <> o.name)"
    held = f"CASE WHEN st <> 'executed' THEN s.held WHEN p IS NULL THEN {others} ELSE map_concat({others}, map(o.name, p)) END"
    row = """named_struct('user_id', o.user_id, 'order_id', o.order_id, 'executed_at', o.executed_at, 'symbol', o.symbol,
        'action', o.action, 'quantity', o.quantity, 'price', o.price, 'total', c.cost, 'status', st, 'cash_after', cash,
        'position_qty', coalesce(p.q, 0.0D), 'position_avg', p.a)"""
    step = let("c", f"named_struct('h', s.held[o.name], 'cost', {_r6('o.quantity * o.price')})", let("st", status, let(
        "p", position, let("cash", cash, f"named_struct('cash', cash, 'held', {held}, 'out', concat(s.out, array({row})))"))))
    return step


def ledger_apply(priced: DataFrame, start_cash: float = STARTING_CASH, block: int = BLOCK) -> DataFrame:
    """One row per order: status (executed / insufficient_cash /
    insufficient_position / no_price / invalid), cash after it and the position of its
    symbol after it. Orders are applied per user by (executed_at, order_id), null times first;
    orders without a user share one account. Price and total are unrounded here
    (display rounding is the caller's). The result is a checkpoint, so reading it again applies nothing again.
    """
    price = F.col("price").cast("double")
    rows = priced.select("user_id", "order_id", "executed_at", "symbol", "action", F.col("quantity").cast("double").alias("quantity"),
                         F.when(~F.isnan(price), price).alias("price"))
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    row_type = "STRUCT<" + ", ".join(f"{c}: {kind.get(c, 'string' if c == 'status' else 'double')}" for c in LEDGER_COLS) + ">"
    rows = rows.withColumn("name", F.coalesce("symbol", F.lit("\0")))
    bucket = F.coalesce(F.floor(F.unix_date(F.to_date("executed_at")) / NUMBER_DAYS), F.lit(-1 << 40))
    return fold_rounds(rows, F.col("user_id"), ["executed_at", "order_id"], bucket, [*LEDGER_COLS[:7], "name"],
                       {"cash": f"{float(start_cash)!r}D", "held": f"CAST(map() AS {_HELD})"}, _step(), row_type, block)


def ledger_positions(ledger: DataFrame) -> DataFrame:
    """Open positions after the fold: the last state of every (user, symbol)."""
    done = ledger.filter(F.col("status") == "executed")
    last = done.groupBy("user_id", "symbol").agg(
        F.max_by(F.struct("position_qty", "position_avg"), F.struct("executed_at", "order_id")).alias("p"))
    return (last.select("user_id", "symbol", F.col("p.position_qty").alias("quantity"),
                        F.col("p.position_avg").alias("avg_cost"))
            .filter(F.col("quantity") >= DUST))


def ledger_cash(ledger: DataFrame, users: DataFrame | None = None, start_cash: float = STARTING_CASH) -> DataFrame:
    c = ledger.groupBy("user_id").agg(F.max_by("cash_after", F.struct("executed_at", "order_id")).alias("cash"))
    if users is not None:
        c = users.select("user_id").join(c, "user_id", "left")
    return c.select("user_id", F.coalesce("cash", F.lit(start_cash)).alias("cash"))


def portfolio_valuation(positions: DataFrame, cash: DataFrame, latest: DataFrame,
                        start_cash: float = STARTING_CASH) -> DataFrame:
    """Per position: value, cost basis, P&L, P&L % (2 dp); per user totals:
    market value, equity, return and return %. One row per position plus
    the user's totals (positions sorted by value: ``rank``)."""
    p = positions.join(latest, "symbol", "left")
    mv = F.when(F.col("current_price").isNotNull() & (F.col("current_price") != 0),
                rnd(F.col("quantity") * F.col("current_price"), 2))
    cb = rnd(F.col("quantity") * F.col("avg_cost"), 2)
    p = p.select("user_id", "symbol", rnd(F.col("quantity"), 6).alias("quantity"),
                 rnd(F.col("avg_cost"), 4).alias("avg_cost"), rnd(F.col("current_price"), 4).alias("cur_price"),
                 mv.alias("market_value"), cb.alias("cost_basis"))
    p = p.withColumn("pnl", rnd(F.col("market_value") - F.col("cost_basis"), 2))
    p = p.withColumn("pnl_pct", F.when(F.col("pnl").isNotNull() & (F.col("cost_basis") != 0),
                                       rnd(F.col("pnl") / F.col("cost_basis") * 100, 2)))
    tot = p.groupBy("user_id").agg(F.coalesce(F.sum("market_value"), F.lit(0.0)).alias("_mv"))
    t = cash.join(tot, "user_id", "left").select(
        "user_id", rnd(F.col("cash"), 2).alias("cash"),
        rnd(F.coalesce(F.col("_mv"), F.lit(0.0)), 2).alias("total_market_value"),
        rnd(F.col("cash") + F.coalesce(F.col("_mv"), F.lit(0.0)), 2).alias("total_equity"))
    t = t.withColumn("total_return", rnd(F.col("total_equity") - start_cash, 2))
    t = t.withColumn("total_return_pct", rnd(F.col("total_return") / start_cash * 100, 2))
    w = Window.partitionBy("user_id").orderBy(F.coalesce(F.col("market_value"), F.lit(0.0)).desc(), "symbol")
    p = p.withColumn("rank", F.row_number().over(w).cast("long"))
    return t.join(p, "user_id", "left")


def trade_history(ledger: DataFrame, k: int = 50) -> DataFrame:
    """Last k executed trades per user, newest first (grouped top-k)."""
    t = ledger.filter(F.col("status") == "executed")
    w = Window.partitionBy("user_id").orderBy(F.col("executed_at").desc(), F.col("order_id").desc())
    return (t.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)
            .select("user_id", "rank", "order_id", "symbol", "action", "quantity", "price", "total",
                    F.date_format("executed_at", "yyyy-MM-dd HH:mm").alias("executed_at")))


def portfolio_reset(orders: DataFrame, resets: DataFrame) -> DataFrame:
    """Drop orders placed before the user's last reset (user_id, reset_at):
    the fold then restarts from the starting cash with no positions."""
    last = resets.groupBy("user_id").agg(F.max("reset_at").alias("_reset"))
    j = orders.join(last, "user_id", "left")
    return j.filter(F.col("_reset").isNull() | (F.col("executed_at") >= F.col("_reset"))).drop("_reset")
