"""Family I: wallet, payments, quotas and rate limits over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from candela.operators import wallet as wl
from candela.plans.common import rounded
from candela.plans.registry import register
from candela.plans.sql_parts import with_ctes
from candela.sources import tables


def _entries(spark, sf_dir):
    tx = tables.transactions(spark, sf_dir).select("user_id", F.col("date").alias("ts"), "id",
                                                   F.col("tokens_added").alias("tokens"))
    use = tables.wallet_usage(spark, sf_dir)
    return wl.wallet_ledger(tables.users(spark, sf_dir), tx, use)


# Oracle: the literal sequential fold as a recursive CTE (an independent
# method from the Spark closed form).
FOLD = [
    ("ent", """SELECT user_id, ts, event_id AS id, CASE WHEN event_type = 'purchase' THEN floor(value) + 1 ELSE -1 END AS x,
        CASE WHEN event_type = 'purchase' THEN 'credit' ELSE 'debit' END AS kind
        FROM events WHERE event_type IN ('purchase', 'view')"""),
    ("num", "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, id) AS rn FROM ent"),
    ("fold", """SELECT user_id, rn, id, kind, x, 5.0::DOUBLE AS before, CASE WHEN kind = 'debit' AND 5.0 <= 0 THEN 5.0
          ELSE 5.0 + x END AS after, kind = 'debit' AND 5.0 <= 0 AS refused FROM num WHERE rn = 1
        UNION ALL
        SELECT n.user_id, n.rn, n.id, n.kind, n.x, f.after, CASE WHEN n.kind = 'debit' AND f.after <= 0 THEN f.after
          ELSE f.after + n.x END, n.kind = 'debit' AND f.after <= 0
        FROM fold f JOIN num n ON n.user_id = f.user_id AND n.rn = f.rn + 1"""),
]


@register("wallet_balance", with_ctes(FOLD, """SELECT c.c_custkey AS user_id,
  CAST(coalesce(g.balance, 5) AS BIGINT) AS balance, CAST(coalesce(g.bought, 0) AS BIGINT) AS tokens_bought,
  CAST(coalesce(g.used, 0) AS BIGINT) AS used, CAST(coalesce(g.refused, 0) AS BIGINT) AS refused
  FROM customer c LEFT JOIN (SELECT user_id, arg_max(after, rn) AS balance, sum(x) FILTER (WHERE kind = 'credit') AS bought,
    count(*) FILTER (WHERE kind = 'debit' AND NOT refused) AS used, count(*) FILTER (WHERE refused) AS refused
    FROM fold GROUP BY user_id) g ON g.user_id = c.c_custkey"""))
def wallet_balance(spark, sf_dir):
    return wl.wallet_balance(tables.users(spark, sf_dir), _entries(spark, sf_dir))


@register("insufficient_balance", with_ctes(FOLD, """SELECT f.user_id, f.id, e.ts, CAST(f.before AS BIGINT) AS balance_before,
  f.refused FROM fold f JOIN ent e ON e.id = f.id WHERE f.kind = 'debit'"""))
def insufficient_balance(spark, sf_dir):
    return wl.insufficient_balance(_entries(spark, sf_dir))


_PAY = """SELECT 'evt_' || CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS BIGINT) AS user_id, kind, mode, plan_id,
  CAST(tokens AS BIGINT) AS tokens, round(amount + 1e-9, 2) AS amount_paid FROM (
  SELECT event_id, user_id, 'checkout' AS kind, 'payment' AS mode,
    (['starter','explorer','pro','whale'])[(event_id % 4) + 1] AS plan_id, ([20,50,100,500])[(event_id % 4) + 1] AS tokens,
    ([299,599,999,3999])[(event_id % 4) + 1] / 100.0 AS amount FROM events WHERE event_type = 'purchase'
  UNION ALL
  SELECT event_id, user_id, 'checkout', 'subscription', (['pro_monthly','enterprise_monthly'])[(event_id % 2) + 1],
    ([200,999])[(event_id % 2) + 1], ([1500,4999])[(event_id % 2) + 1] / 100.0 FROM events WHERE event_type = 'signup'
  UNION ALL
  SELECT event_id, user_id, 'renewal', 'payment', (['pro_monthly','enterprise_monthly'])[(event_id % 2) + 1],
    ([200,999])[(event_id % 2) + 1], round(value * 100) / 100.0 FROM events WHERE event_type = 'view' AND event_id % 3 = 0
  ) WHERE user_id % 50 <> 0"""


def _credits(spark, sf_dir):
    parsed = wl.parse_payment_events(tables.payment_json(spark, sf_dir))
    return wl.payment_credits(parsed, wl.price_plans(spark))


@register("payment_events", _PAY)
def payment_events(spark, sf_dir):
    return rounded(_credits(spark, sf_dir))


@register("price_plans", f"""SELECT p.plan_id, p.kind, p.price_cents, p.billing_interval,
  coalesce(g.purchases, 0) AS purchases, CAST(coalesce(g.tokens, 0) AS BIGINT) AS tokens_sold, round(coalesce(g.revenue, 0.0) + 1e-9, 2) AS revenue
  FROM (VALUES ('starter','pack',20,299,NULL), ('explorer','pack',50,599,NULL), ('pro','pack',100,999,NULL),
    ('whale','pack',500,3999,NULL), ('pro_monthly','plan',200,1500,'month'), ('enterprise_monthly','plan',999,4999,'month'))
    p(plan_id, kind, tokens, price_cents, billing_interval)
  LEFT JOIN (SELECT plan_id, count(*) AS purchases, sum(tokens) AS tokens, sum(amount_paid) AS revenue FROM ({_PAY}) GROUP BY plan_id) g
  USING (plan_id)""")
def price_plans(spark, sf_dir):
    return rounded(wl.plan_revenue(_credits(spark, sf_dir), wl.price_plans(spark)))


_API = "SELECT event_id AS id, user_id AS key_id, ts FROM events WHERE event_type IN ('click', 'view')"


@register("usage_quota", f"""SELECT key_id, CAST(ts AS DATE) AS day, count(*) AS requests, least(count(*), 100) AS allowed,
  greatest(count(*) - 100, 0) AS refused, count(*) > 100 AS over_limit FROM ({_API}) GROUP BY key_id, CAST(ts AS DATE)""")
def usage_quota(spark, sf_dir):
    return wl.usage_quota(tables.api_requests(spark, sf_dir), wl.API_DAILY_LIMIT)


@register("rate_limit_windows", f"""
  SELECT key_id, 'hour' AS "window", date_trunc('hour', ts) AS window_start, count(*) AS requests, 60 AS "limit",
    greatest(count(*) - 60, 0) AS refused FROM ({_API}) GROUP BY key_id, date_trunc('hour', ts)
  UNION ALL
  SELECT key_id, 'day', date_trunc('day', ts), count(*), 300, greatest(count(*) - 300, 0) FROM ({_API}) GROUP BY key_id, date_trunc('day', ts)""")
def rate_limit_windows(spark, sf_dir):
    return wl.rate_limit_windows(tables.api_requests(spark, sf_dir))


_VERDICT = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY key_id, date_trunc('hour', ts) ORDER BY ts, id) AS h FROM ({api})),
  d AS (SELECT *, sum(CASE WHEN h <= {hour} THEN 1 ELSE 0 END) OVER (PARTITION BY key_id, CAST(ts AS DATE) ORDER BY ts, id) AS n FROM r)
  SELECT key_id, id, ts, CASE WHEN h > {hour} THEN 'hour' WHEN n > {day} THEN 'day' ELSE 'admitted' END AS verdict FROM d"""


@register("rate_limit_verdicts", _VERDICT.format(api=_API, hour=60, day=300))
def rate_limit_verdicts(spark, sf_dir):
    """Every request under 60 an hour and 300 a day together."""
    return wl.admissions(tables.api_requests(spark, sf_dir)).select("key_id", "id", "ts", "verdict")


@register("usage_verdicts", f"""SELECT key_id, id, ts, CASE WHEN row_number() OVER (PARTITION BY key_id, CAST(ts AS DATE) ORDER BY ts, id) > 100
  THEN 'day' ELSE 'admitted' END AS verdict FROM ({_API})""")
def usage_verdicts(spark, sf_dir):
    """Every request under the daily quota."""
    return wl.admissions(tables.api_requests(spark, sf_dir), (("day", "1 day", wl.API_DAILY_LIMIT),)).select("key_id", "id", "ts", "verdict")


# A literal fold over the users' events, with a list of the keys that are active.
_KEYS = [
    ("kev", """SELECT user_id, event_id AS seq, ts, event_type = 'signup' AS asks,
        last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS key_id
        FROM events WHERE event_type IN ('signup', 'error')"""),
    ("kn", "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, seq) AS rn FROM kev WHERE key_id IS NOT NULL"),
    ("kf", """SELECT user_id, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS keys, CAST(NULL AS VARCHAR) AS status FROM (SELECT DISTINCT user_id FROM kn)
        UNION ALL
        SELECT n.user_id, n.rn, CASE WHEN n.asks AND len(f.keys) < 5 THEN list_append(f.keys, n.key_id) WHEN n.asks THEN f.keys
            ELSE list_filter(f.keys, lambda x: x <> n.key_id) END,
          CASE WHEN n.asks AND len(f.keys) < 5 THEN 'created' WHEN n.asks THEN 'limit reached'
            WHEN list_contains(f.keys, n.key_id) THEN 'revoked' ELSE 'not found' END
        FROM kf f JOIN kn n ON n.user_id = f.user_id AND n.rn = f.rn + 1"""),
    ("kr", "SELECT n.*, f.status, len(f.keys) AS active FROM kn n JOIN kf f ON f.user_id = n.user_id AND f.rn = n.rn"),
]


@register("key_events", with_ctes(_KEYS, """SELECT user_id, seq, ts, CASE WHEN asks THEN 'create' ELSE 'revoke' END AS action, key_id, status,
  CAST(active AS INTEGER) AS active FROM kr"""))
def key_events(spark, sf_dir):
    """Key creations and revocations in order, with their outcomes."""
    return wl.key_events(tables.key_events(spark, sf_dir))


@register("active_keys", with_ctes(_KEYS, """SELECT c.user_id, row_number() OVER (PARTITION BY c.user_id ORDER BY c.ts DESC, c.seq DESC) AS rank,
  c.key_id, c.ts AS created_at, c.key_id NOT IN (SELECT key_id FROM kr WHERE status = 'revoked') AS is_active FROM kr c WHERE c.status = 'created'"""))
def active_keys(spark, sf_dir):
    return wl.active_keys(tables.key_events(spark, sf_dir))
