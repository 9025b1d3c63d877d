"""Family G: price alerts over the fixture alerts and the processed series."""

from __future__ import annotations

from candela.operators import alerts as al
from candela.plans.common import rounded
from candela.plans.q_snapshot import SER
from candela.plans.registry import register
from candela.plans.sql_parts import symbol_of, trimmed_ctes, with_ctes
from candela.sources import tables

ALERTS = ("alerts", f"""SELECT c_custkey AS id, c_custkey AS user_id, {symbol_of('c_custkey')} AS symbol,
  abs(c_acctbal) + 1 AS target_price, CASE WHEN c_custkey % 2 = 0 THEN 'above' ELSE 'below' END AS direction,
  CASE WHEN c_custkey % 10 = 0 THEN 'cancelled' ELSE 'active' END AS status, c_name AS note FROM customer""")
LATEST = ("latest", "SELECT symbol, close AS current_price FROM ser WHERE pos = n - 1")
CHECK = ("chk", """SELECT a.id, a.user_id, a.symbol, a.target_price, a.direction, a.note, l.current_price,
  coalesce((a.direction = 'above' AND l.current_price >= a.target_price)
        OR (a.direction = 'below' AND l.current_price <= a.target_price), false) AS fired
  FROM alerts a LEFT JOIN latest l USING (symbol) WHERE a.status = 'active'""")
ASOF = "(SELECT max(o_orderdate) FROM orders)"


def q(final: str, extra=None) -> str:
    return with_ctes(trimmed_ctes() + [SER, ALERTS, LATEST, CHECK] + (extra or []), final)


def _checked(spark, sf_dir):
    return al.alert_check(tables.alerts(spark, sf_dir), al.latest_close(tables.processed(spark, sf_dir)))


@register("alert_check", q("SELECT * FROM chk"))
def alert_check(spark, sf_dir):
    return rounded(_checked(spark, sf_dir))


@register("alert_trigger_update", q(f"""SELECT a.id, a.user_id, a.symbol, a.target_price, a.direction,
  CASE WHEN c.fired THEN 'triggered' ELSE a.status END AS status, a.note,
  CASE WHEN c.fired THEN {ASOF} END AS triggered_at
  FROM alerts a LEFT JOIN (SELECT id, fired FROM chk WHERE fired) c USING (id)"""))
def alert_trigger_update(spark, sf_dir):
    out = al.alert_trigger_update(tables.alerts(spark, sf_dir), _checked(spark, sf_dir),
                                  tables.as_of(spark, sf_dir))
    return rounded(out.select("id", "user_id", "symbol", "target_price", "direction", "status", "note",
                              "triggered_at"))


@register("alert_check_summary", q("SELECT count(*) AS checked, count(*) FILTER (WHERE fired) AS triggered FROM chk"))
def alert_check_summary(spark, sf_dir):
    return al.alert_check_summary(_checked(spark, sf_dir))


_WORD = "CASE WHEN direction = 'above' THEN 'at or above' ELSE 'at or below' END"


@register("alert_notifications", q(f"""SELECT id, user_id, symbol,
  printf('Target reached: %s %s $%s', symbol, {_WORD}, format('{{:,.2f}}', target_price)) AS subject,
  printf('For %s: %s reached a target price.\n\n', name, symbol)
  || printf('target  %s %s $%s\n', symbol, {_WORD}, format('{{:,.2f}}', target_price))
  || printf('close   $%s\n', format('{{:,.2f}}', current_price))
  || CASE WHEN coalesce(note, '') <> '' THEN printf('note    %s\n', note) ELSE '' END
  || printf('at      %s UTC\n', strftime({ASOF}, '%Y-%m-%d %H:%M')) AS body
  FROM chk LEFT JOIN (SELECT c_custkey AS user_id, c_name AS name FROM customer) u USING (user_id) WHERE fired"""))
def alert_notifications(spark, sf_dir):
    return al.alert_notifications(_checked(spark, sf_dir), tables.users(spark, sf_dir), tables.as_of(spark, sf_dir))


@register("alert_list", q("""SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY id DESC) AS rank, id, symbol,
  target_price, direction, coalesce(note, '') AS note, status,
  count(*) FILTER (WHERE status = 'active') OVER (PARTITION BY user_id) AS active_count,
  count(*) OVER (PARTITION BY user_id) AS total_count FROM alerts"""))
def alert_list(spark, sf_dir):
    return rounded(al.alert_list(tables.alerts(spark, sf_dir)))


_REQ = ("req", f"""SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS user_id,
  upper(trim(lower({symbol_of('c_custkey')}))) AS symbol,
  lower(trim(CASE WHEN c_custkey % 11 = 0 THEN 'sideways' WHEN c_custkey % 2 = 0 THEN ' Above ' ELSE 'below' END)) AS direction,
  c_acctbal AS t, trim(substr(c_name, 1, 200)) AS note FROM customer""")
_VAL = ("val", """SELECT *, CASE WHEN symbol NOT IN (SELECT DISTINCT l_returnflag || '-' || l_linestatus FROM lineitem) THEN 'unknown symbol'
  WHEN direction NOT IN ('above', 'below') THEN 'unknown direction'
  WHEN t IS NULL OR t <= 0 THEN 'target price must be a positive number' END AS err FROM req""")
_TAKEN = ("taken", """SELECT id FROM (SELECT v.id, row_number() OVER (PARTITION BY v.user_id ORDER BY v.id) AS k,
  coalesce(a.act, 0) AS act FROM val v LEFT JOIN (SELECT user_id, count(*) AS act FROM alerts WHERE status = 'active' GROUP BY user_id) a
  USING (user_id) WHERE v.err IS NULL) WHERE k <= 20 - act""")


@register("alert_validation", q("""SELECT id, user_id, symbol, direction,
  CASE WHEN err IS NULL THEN round(t + 1e-9, 6) END AS target_price, CASE WHEN note <> '' THEN note END AS note,
  CASE WHEN err IS NOT NULL THEN err WHEN id IN (SELECT id FROM taken) THEN 'created'
       ELSE 'limit of 20 active alerts reached' END AS status FROM val""", [_REQ, _VAL, _TAKEN]))
def alert_validation(spark, sf_dir):
    return rounded(al.alert_validation(tables.alert_requests(spark, sf_dir), tables.alerts(spark, sf_dir),
                                       tables.universe(spark, sf_dir)))
