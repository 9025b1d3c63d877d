"""Family K: activity reports and watchlist maintenance."""

from __future__ import annotations

from candela.operators import reports as rp
from candela.plans.common import rounded
from candela.plans.q_scoring import PRED
from candela.plans.q_snapshot import WATCH
from candela.plans.registry import register
from candela.plans.sql_parts import symbol_of, with_ctes
from candela.sources import tables

TX = ("tx", """SELECT event_id AS id, user_id, value AS amount_paid, CAST(floor(value) + 1 AS BIGINT) AS tokens_added,
  ts AS date FROM events WHERE event_type = 'purchase'""")
USERS = ("users", "SELECT c_custkey AS user_id, c_name AS name FROM customer")


@register("admin_kpis", with_ctes([PRED, TX, USERS], """SELECT uc AS user_count, pc AS pred_count,
  round(rev + 1e-9, 2) AS revenue, ts AS token_sales, pt AS preds_today,
  CASE WHEN uc > 0 THEN round(rev / uc + 1e-9, 2) ELSE 0.0 END AS revenue_per_user,
  CASE WHEN uc > 0 THEN round(pc / uc + 1e-9, 1) ELSE 0.0 END AS preds_per_user
  FROM (SELECT (SELECT count(*) FROM users) AS uc, (SELECT count(*) FROM pred) AS pc,
    (SELECT count(*) FROM pred WHERE created_at >= date_trunc('day', (SELECT max(o_orderdate) FROM orders))) AS pt,
    (SELECT coalesce(sum(amount_paid), 0.0) FROM tx) AS rev, (SELECT CAST(coalesce(sum(tokens_added), 0) AS BIGINT) FROM tx) AS ts)"""))
def admin_kpis(spark, sf_dir):
    return rounded(rp.admin_kpis(tables.users(spark, sf_dir), tables.predictions(spark, sf_dir),
                                 tables.transactions(spark, sf_dir), tables.as_of(spark, sf_dir)))


@register("top_users", with_ctes([PRED, USERS], """SELECT u.user_id, u.name, count(p.id) AS pc
  FROM users u LEFT JOIN pred p USING (user_id) GROUP BY u.user_id, u.name ORDER BY pc DESC, u.user_id LIMIT 10"""))
def top_users(spark, sf_dir):
    return rp.top_users(tables.users(spark, sf_dir), tables.predictions(spark, sf_dir), 10)


@register("recent_predictions", with_ctes([PRED, USERS], """SELECT p.id, p.user_id, u.name, p.symbol, p.predicted_result,
  p.created_at FROM (SELECT * FROM pred ORDER BY created_at DESC, id DESC LIMIT 20) p LEFT JOIN users u USING (user_id)"""))
def recent_predictions(spark, sf_dir):
    return rp.recent_predictions(tables.predictions(spark, sf_dir), tables.users(spark, sf_dir), 20)


@register("user_history", with_ctes([PRED, TX], """
  SELECT 'transaction' AS kind, user_id, rank, id, date AS ts, amount_paid AS amount, CAST(tokens_added AS VARCHAR) AS detail
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date DESC, id DESC) AS rank FROM tx) WHERE rank <= 50
  UNION ALL
  SELECT 'prediction', user_id, rank, id, created_at, NULL::DOUBLE, predicted_result
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rank FROM pred) WHERE rank <= 100"""))
def user_history(spark, sf_dir):
    return rounded(rp.user_history(tables.transactions(spark, sf_dir), tables.predictions(spark, sf_dir)))


_WREQ = ("wreq", f"""SELECT user_id, {symbol_of('event_id')} AS symbol,
  CASE WHEN event_type = 'click' THEN 'add' ELSE 'remove' END AS action, ts, event_id AS seq
  FROM events WHERE event_type IN ('click', 'error')""")
_WNUM = ("wnum", """SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, seq) AS rn FROM wreq
  WHERE symbol IN (SELECT DISTINCT l_returnflag || '-' || l_linestatus FROM lineitem)""")
_WFOLD = ("wfold", """SELECT n.user_id, CAST(0 AS BIGINT) AS rn, coalesce(any_value(w.held), []::VARCHAR[]) AS held, '' AS outcome
  FROM (SELECT DISTINCT user_id FROM wnum) n
  LEFT JOIN (SELECT user_id, list(DISTINCT symbol) AS held FROM watch GROUP BY user_id) w USING (user_id) GROUP BY n.user_id
  UNION ALL
  SELECT f.user_id, n.rn, CASE WHEN action = 'add' AND NOT list_contains(held, symbol) AND len(held) < 30 THEN list_append(held, symbol)
      WHEN action = 'remove' THEN list_filter(held, lambda x: x <> symbol) ELSE held END,
    CASE WHEN action = 'add' THEN CASE WHEN list_contains(held, symbol) THEN 'already there' WHEN len(held) >= 30 THEN 'full' ELSE 'added' END
      WHEN list_contains(held, symbol) THEN 'removed' ELSE 'not found' END
  FROM wfold f JOIN wnum n ON n.user_id = f.user_id AND n.rn = f.rn + 1""")
_WEV = ("wev", """SELECT n.user_id, n.symbol, n.action, n.ts, n.seq, f.outcome FROM wnum n JOIN wfold f USING (user_id, rn)
  UNION ALL SELECT user_id, symbol, action, ts, seq, 'invalid' FROM wreq
  WHERE symbol NOT IN (SELECT DISTINCT l_returnflag || '-' || l_linestatus FROM lineitem)""")
_WEVENTS = [WATCH, _WREQ, _WNUM, _WFOLD, _WEV]


def _events(spark, sf_dir):
    return rp.watchlist_events(tables.watchlist(spark, sf_dir), tables.watchlist_requests(spark, sf_dir), tables.universe(spark, sf_dir))


@register("watchlist_events", with_ctes(_WEVENTS, "SELECT * FROM wev"))
def watchlist_events(spark, sf_dir):
    return _events(spark, sf_dir)


@register("watchlist_upsert", with_ctes(_WEVENTS, """SELECT w.user_id, w.symbol, w.added_at FROM watch w
  WHERE NOT EXISTS (SELECT 1 FROM wev e WHERE e.user_id = w.user_id AND e.symbol = w.symbol AND e.outcome IN ('added', 'removed'))
  UNION ALL SELECT user_id, symbol, arg_max(ts, (ts, seq)) FROM wev WHERE outcome IN ('added', 'removed')
  GROUP BY user_id, symbol HAVING arg_max(outcome, (ts, seq)) = 'added'"""))
def watchlist_upsert(spark, sf_dir):
    return rp.watchlist_upsert(tables.watchlist(spark, sf_dir), _events(spark, sf_dir))
