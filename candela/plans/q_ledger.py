"""Family H: paper-trading ledger over the fixture trade orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from candela.functions.scalar import rnd
from candela.operators import alerts as al
from candela.operators import ledger as lg
from candela.plans.common import rounded
from candela.plans.q_snapshot import SER
from candela.plans.registry import register
from candela.plans.sql_parts import BARS_SQL, symbol_of, trimmed_ctes, with_ctes
from candela.sources import tables

R6 = "floor(({x}) * 1e6 + 0.5) / 1e6"


def r6(x: str) -> str:
    return R6.format(x=x)


def _ledger_ctes(reset: bool = False) -> list[tuple[str, str]]:
    keep = ("WHERE NOT EXISTS (SELECT 1 FROM (SELECT user_id, max(ts) AS r FROM events WHERE event_type = 'signup' "
            "GROUP BY user_id) z WHERE z.user_id = o.o_custkey AND o.o_orderdate < z.r)") if reset else ""
    return [
        ("lbars", BARS_SQL),
        ("tord", f"""SELECT o_custkey AS user_id, CAST(o_orderdate AS DATE) AS d, o_orderdate AS executed_at,
            o_orderkey AS order_id, {symbol_of('o_orderkey')} AS symbol,
            CASE WHEN o_orderstatus = 'F' THEN 'sell' ELSE 'buy' END AS action,
            (o_orderkey % 10 + 1) / 10.0 AS quantity FROM orders o {keep}"""),
        ("priced", "SELECT t.*, b.close AS price FROM tord t ASOF LEFT JOIN lbars b ON t.symbol = b.symbol AND t.d > b.d"),
        ("num", "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY executed_at, order_id) AS rn FROM priced"),
        ("led", f"""SELECT user_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS order_id, 10000.0::DOUBLE AS cash,
              []::STRUCT(s VARCHAR, q DOUBLE, a DOUBLE)[] AS pos, CAST(NULL AS VARCHAR) AS status,
              CAST(NULL AS DOUBLE) AS cost, CAST(NULL AS VARCHAR) AS symbol
            FROM (SELECT DISTINCT user_id FROM num)
            UNION ALL
            SELECT user_id, rn, order_id,
              CASE WHEN st = 'executed' AND action = 'buy' THEN {r6('cash - cost')}
                   WHEN st = 'executed' THEN {r6('cash + cost')} ELSE cash END,
              CASE WHEN st <> 'executed' THEN pos
                   WHEN action = 'buy' THEN list_append(list_filter(pos, lambda e: e.s <> symbol),
                     {{'s': symbol, 'q': CASE WHEN hq IS NULL THEN {r6('quantity')} ELSE {r6('hq + quantity')} END,
                      'a': CASE WHEN hq IS NULL THEN {r6('price')} ELSE {r6('(ha * hq + price * quantity) / (hq + quantity)')} END}})
                   WHEN {r6('hq - quantity')} < 1e-6 THEN list_filter(pos, lambda e: e.s <> symbol)
                   ELSE list_append(list_filter(pos, lambda e: e.s <> symbol), {{'s': symbol, 'q': {r6('hq - quantity')}, 'a': ha}}) END,
              st, cost, symbol
            FROM (SELECT n.user_id, n.rn, n.order_id, n.symbol, n.action, n.quantity, n.price, l.cash, l.pos,
                    {r6('n.quantity * n.price')} AS cost,
                    (list_filter(l.pos, lambda e: e.s = n.symbol))[1].q AS hq,
                    (list_filter(l.pos, lambda e: e.s = n.symbol))[1].a AS ha,
                    CASE WHEN n.price IS NULL THEN 'no_price'
                         WHEN n.action = 'buy' AND l.cash < {r6('n.quantity * n.price')} THEN 'insufficient_cash'
                         WHEN n.action = 'sell' AND coalesce((list_filter(l.pos, lambda e: e.s = n.symbol))[1].q < n.quantity, true)
                           THEN 'insufficient_position'
                         ELSE 'executed' END AS st
                  FROM led l JOIN num n ON n.user_id = l.user_id AND n.rn = l.rn + 1) x"""),
        ("lrows", """SELECT n.user_id, n.order_id, n.executed_at, n.symbol, n.action, n.quantity, n.price, l.cost AS total,
            l.status, l.cash AS cash_after,
            coalesce((list_filter(l.pos, lambda e: e.s = n.symbol))[1].q, 0.0) AS position_qty,
            (list_filter(l.pos, lambda e: e.s = n.symbol))[1].a AS position_avg
            FROM led l JOIN num n ON n.user_id = l.user_id AND n.rn = l.rn WHERE l.rn > 0"""),
        ("fin", "SELECT user_id, arg_max(cash, rn) AS cash, arg_max(pos, rn) AS pos FROM led GROUP BY user_id"),
        ("fpos", """SELECT user_id, p.s AS symbol, p.q AS quantity, p.a AS avg_cost FROM (
            SELECT user_id, unnest(pos) AS p FROM fin) WHERE p.q >= 1e-6"""),
    ]


LEDGER_OUT = """SELECT user_id, order_id, executed_at, symbol, action, round(quantity + 3.18309886e-8, 6) AS quantity,
  round(price + 1e-9, 4) AS price, round(total + 1e-9, 2) AS total, status,
  round(cash_after + 3.18309886e-8, 6) AS cash_after, round(position_qty + 3.18309886e-8, 6) AS position_qty,
  round(position_avg + 3.18309886e-8, 6) AS position_avg FROM lrows"""


def _orders(spark, sf_dir, reset=False):
    o = tables.trade_orders(spark, sf_dir)
    if reset:
        o = lg.portfolio_reset(o, tables.resets(spark, sf_dir))
    return lg.order_pricing(o, tables.bars(spark, sf_dir))


def _ledger(spark, sf_dir, reset=False):
    return lg.ledger_apply(_orders(spark, sf_dir, reset))


def _display(led):
    return rounded(led.withColumns({"price": rnd(F.col("price"), 4), "total": rnd(F.col("total"), 2)}))


@register("order_pricing", with_ctes(_ledger_ctes(), """SELECT user_id, order_id, d, executed_at, symbol, action,
  quantity, round(price + 3.18309886e-8, 6) AS price FROM priced"""))
def order_pricing(spark, sf_dir):
    return rounded(_orders(spark, sf_dir).select("user_id", "order_id", "d", "executed_at", "symbol", "action",
                                                 "quantity", "price"))


_QUOTED = f"""SELECT o.user_id, o.event_id AS order_id, o.ts AS executed_at, {symbol_of('o.event_id')} AS symbol,
  CASE WHEN o.event_type = 'click' THEN 'buy' ELSE 'sell' END AS action, (o.event_id % 10 + 1) / 10.0 AS quantity
  FROM events o WHERE o.event_type IN ('click', 'error')"""


@register("order_pricing_intraday", f"""WITH o AS ({_QUOTED}),
  q AS (SELECT {symbol_of('user_id')} AS symbol, ts, arg_max(value, event_id) AS px FROM events WHERE event_type = 'purchase' GROUP BY ALL)
  SELECT o.*, round(q.px + 3.18309886e-8, 6) AS price, q.ts AS priced_at FROM o ASOF LEFT JOIN q ON o.symbol = q.symbol AND o.executed_at >= q.ts""")
def order_pricing_intraday(spark, sf_dir):
    """Orders at a time of day, filled at the newest price of their symbol at that time."""
    return rounded(lg.order_pricing_at(tables.intraday_orders(spark, sf_dir), tables.quotes(spark, sf_dir), quote_order=["event_id"]))


@register("ledger_apply", with_ctes(_ledger_ctes(), LEDGER_OUT))
def ledger_apply(spark, sf_dir):
    return _display(_ledger(spark, sf_dir))


@register("ledger_positions", with_ctes(_ledger_ctes(), """SELECT user_id, symbol, round(quantity + 3.18309886e-8, 6) AS quantity,
  round(avg_cost + 3.18309886e-8, 6) AS avg_cost FROM fpos"""))
def ledger_positions(spark, sf_dir):
    return rounded(lg.ledger_positions(_ledger(spark, sf_dir)))


_VAL = [("latest", "SELECT symbol, close AS current_price FROM ser WHERE pos = n - 1"),
        ("pv", """SELECT f.user_id, f.symbol, round(f.quantity + 1e-9, 6) AS quantity, round(f.avg_cost + 1e-9, 4) AS avg_cost,
            round(l.current_price + 1e-9, 4) AS cur_price,
            CASE WHEN l.current_price IS NOT NULL AND l.current_price <> 0 THEN round(f.quantity * l.current_price + 1e-9, 2) END AS market_value,
            round(f.quantity * f.avg_cost + 1e-9, 2) AS cost_basis FROM fpos f LEFT JOIN latest l USING (symbol)"""),
        ("pv2", """SELECT *, round(market_value - cost_basis + 1e-9, 2) AS pnl FROM pv"""),
        ("pv3", """SELECT *, CASE WHEN pnl IS NOT NULL AND cost_basis <> 0 THEN round(pnl / cost_basis * 100 + 1e-9, 2) END AS pnl_pct,
            row_number() OVER (PARTITION BY user_id ORDER BY coalesce(market_value, 0.0) DESC, symbol) AS rank FROM pv2"""),
        ("tot", """SELECT c.c_custkey AS user_id, coalesce(fin.cash, 10000.0) AS cash,
            coalesce((SELECT sum(market_value) FROM pv WHERE pv.user_id = c.c_custkey), 0.0) AS mv
            FROM customer c LEFT JOIN fin ON fin.user_id = c.c_custkey""")]


@register("portfolio_valuation", with_ctes(trimmed_ctes() + [SER] + _ledger_ctes() + _VAL, """SELECT t.user_id,
  round(t.cash + 1e-9, 2) AS cash, round(t.mv + 1e-9, 2) AS total_market_value, round(t.cash + t.mv + 1e-9, 2) AS total_equity,
  round(round(t.cash + t.mv + 1e-9, 2) - 10000.0 + 1e-9, 2) AS total_return,
  round(round(round(t.cash + t.mv + 1e-9, 2) - 10000.0 + 1e-9, 2) / 10000.0 * 100 + 1e-9, 2) AS total_return_pct,
  p.symbol, p.quantity, p.avg_cost, p.cur_price, p.market_value, p.cost_basis, p.pnl, p.pnl_pct, p.rank
  FROM tot t LEFT JOIN pv3 p USING (user_id)"""))
def portfolio_valuation(spark, sf_dir):
    led = _ledger(spark, sf_dir)
    out = lg.portfolio_valuation(lg.ledger_positions(led), lg.ledger_cash(led, tables.users(spark, sf_dir)),
                                 al.latest_close(tables.processed(spark, sf_dir)))
    return rounded(out)


@register("trade_history", with_ctes(_ledger_ctes(), """SELECT user_id, rank, order_id, symbol, action,
  round(quantity + 3.18309886e-8, 6) AS quantity, round(price + 1e-9, 4) AS price, round(total + 1e-9, 2) AS total,
  strftime(executed_at, '%Y-%m-%d %H:%M') AS executed_at FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY executed_at DESC, order_id DESC) AS rank FROM lrows
  WHERE status = 'executed') WHERE rank <= 50"""))
def trade_history(spark, sf_dir):
    led = _ledger(spark, sf_dir).withColumns({"price": rnd(F.col("price"), 4), "total": rnd(F.col("total"), 2)})
    return rounded(lg.trade_history(led, 50))


@register("portfolio_reset", with_ctes(_ledger_ctes(reset=True), """SELECT user_id, count(*) AS orders,
  count(*) FILTER (WHERE status = 'executed') AS executed,
  round(arg_max(cash_after, (executed_at, order_id)) + 3.18309886e-8, 6) AS cash
  FROM lrows GROUP BY user_id"""))
def portfolio_reset(spark, sf_dir):
    led = _ledger(spark, sf_dir, reset=True)
    g = led.groupBy("user_id").agg(F.count(F.lit(1)).alias("orders"),
                                   F.count_if(F.col("status") == "executed").alias("executed"),
                                   F.max_by("cash_after", F.struct("executed_at", "order_id")).alias("cash"))
    return rounded(g)
