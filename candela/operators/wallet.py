"""Token wallet, payments, usage quotas and rate limits (family I)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candela.functions.scalar import rnd
from candela.functions.windows import prefix_sum_min

FREE_TOKENS = 5
API_DAILY_LIMIT = 100
MAX_KEYS_PER_USER = 5
RATE_LIMITS = (("hour", "1 hour", 60), ("day", "1 day", 300))

# Token packs and subscription plans (id, tokens, price in cents,
# billing interval), as the reference prices them.
PRICE_PLANS = [
    ("starter", "pack", 20, 299, None),
    ("explorer", "pack", 50, 599, None),
    ("pro", "pack", 100, 999, None),
    ("whale", "pack", 500, 3999, None),
    ("pro_monthly", "plan", 200, 1500, "month"),
    ("enterprise_monthly", "plan", 999, 4999, "month"),
]
PRICE_SCHEMA = "plan_id string, kind string, tokens int, price_cents int, billing_interval string"


def price_plans(spark: SparkSession) -> DataFrame:
    """The six-row price table (a fixed size, safe to broadcast)."""
    return spark.createDataFrame(PRICE_PLANS, PRICE_SCHEMA)


def wallet_ledger(users: DataFrame, credits: DataFrame, debits: DataFrame) -> DataFrame:
    """Signed wallet entries per user: credits (user_id, ts, id, tokens) and
    debit requests (user_id, ts, id) of one token each; the free tokens are
    the scan's start value."""
    c = credits.select("user_id", "ts", "id", F.col("tokens").cast("double").alias("x"), F.lit("credit").alias("kind"))
    d = debits.select("user_id", "ts", "id", F.lit(-1.0).alias("x"), F.lit("debit").alias("kind"))
    return c.unionByName(d)


def wallet_balance_fold(entries: DataFrame, start: float = FREE_TOKENS) -> DataFrame:
    """Balance after every entry, with debits refused at a zero balance.

    b_t = max(b_{t-1} + x_t, 0) (a refused unit debit leaves 0, an accepted
    one never goes below 0), so b_t = S_t - min(0, min_{k<=t} S_k) with S the
    running sum from ``start``; a debit is refused exactly when S_t drops
    below min(0, min_{k<t} S_k). Running sums and minima are a two-level scan:
    no sequential fold and no whole user in one task.
    """
    s = prefix_sum_min(entries, "user_id", ["ts", "id"], "x", init=float(start), time_col="ts")
    bal = F.col("_S") - F.least(F.lit(0.0), F.col("_min_incl"))
    refused = (F.col("kind") == "debit") & (F.col("_S") < F.least(F.lit(0.0), F.coalesce(F.col("_min_excl"), F.lit(0.0))))
    out = s.withColumns({"balance": bal, "refused": refused})
    return out.withColumn("balance_before", F.when(F.col("refused"), F.col("balance"))
                          .otherwise(F.col("balance") - F.col("x"))).drop("_S", "_min_incl", "_min_excl")


def wallet_balance(users: DataFrame, entries: DataFrame, start: float = FREE_TOKENS) -> DataFrame:
    """Per user: final balance, tokens bought, debits accepted and refused."""
    f = wallet_balance_fold(entries, start)
    g = f.groupBy("user_id").agg(
        F.max_by("balance", F.struct("ts", "id")).alias("balance"),
        F.sum(F.when(F.col("kind") == "credit", F.col("x"))).alias("bought"),
        F.count_if((F.col("kind") == "debit") & ~F.col("refused")).alias("used"),
        F.count_if(F.col("refused")).alias("refused"))
    u = users.select("user_id").join(g, "user_id", "left")
    return u.select("user_id", F.coalesce("balance", F.lit(float(start))).cast("long").alias("balance"),
                    F.coalesce("bought", F.lit(0.0)).cast("long").alias("tokens_bought"),
                    F.coalesce("used", F.lit(0)).cast("long").alias("used"),
                    F.coalesce("refused", F.lit(0)).cast("long").alias("refused"))


def insufficient_balance(entries: DataFrame, start: float = FREE_TOKENS) -> DataFrame:
    """Every debit request with the balance before it and whether it was refused."""
    f = wallet_balance_fold(entries, start).filter(F.col("kind") == "debit")
    return f.select("user_id", "id", "ts", F.col("balance_before").cast("long").alias("balance_before"),
                    "refused")


# --------------------------------------------------------------------------
# payment events (JSON)
# --------------------------------------------------------------------------

META = T.StructType([T.StructField(k, T.StringType()) for k in ("user_id", "tokens", "pack_id", "plan_id")])
PAYMENT_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("data", T.StructType([T.StructField("object", T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("mode", T.StringType()),
        T.StructField("metadata", META),
        T.StructField("billing_reason", T.StringType()),
        T.StructField("amount_paid", T.LongType()),
        T.StructField("subscription", T.StructType([T.StructField("id", T.StringType()),
                                                    T.StructField("metadata", META)])),
    ]))])),
])


def parse_payment_events(raw: DataFrame, json_col: str = "json") -> DataFrame:
    return raw.select("*", F.from_json(F.col(json_col), PAYMENT_SCHEMA).alias("e"))


def payment_credits(parsed: DataFrame, plans: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Credits from parsed events: completed checkouts (amount from the
    pack or plan price) and subscription renewals of billing reason
    ``subscription_cycle`` (amount from the invoice); other events are
    ignored, as are events whose user or tokens are zero or missing. ``keep``
    names columns of ``parsed`` to carry along."""
    keep = keep or []
    o = F.col("e.data.object")
    is_checkout = F.col("e.type") == "checkout.session.completed"
    is_renewal = (F.col("e.type") == "invoice.payment_succeeded") & (o["billing_reason"] == "subscription_cycle")
    meta = F.when(is_checkout, o["metadata"]).when(is_renewal, o["subscription"]["metadata"])
    ev = parsed.select(
        F.col("e.id").alias("event_id"),
        F.when(is_checkout, "checkout").when(is_renewal, "renewal").alias("kind"),
        F.coalesce(o["mode"], F.lit("payment")).alias("mode"),
        F.coalesce(meta["user_id"].try_cast("long"), F.lit(0)).alias("user_id"),
        F.coalesce(meta["tokens"].try_cast("long"), F.lit(0)).alias("tokens"),
        F.when(o["mode"] == "subscription", meta["plan_id"]).when(is_renewal, meta["plan_id"])
         .otherwise(meta["pack_id"]).alias("plan_id"),
        o["amount_paid"].alias("_invoice_cents"), *keep)
    ev = ev.filter(F.col("kind").isNotNull() & (F.col("user_id") != 0) & (F.col("tokens") != 0))
    # six-row price table: broadcast is bounded by construction
    j = ev.join(F.broadcast(plans.select("plan_id", "kind", "price_cents").withColumnRenamed("kind", "_pk")),
                "plan_id", "left")
    amount = F.when(F.col("kind") == "renewal", F.coalesce(F.col("_invoice_cents"), F.lit(0)) / 100.0) \
        .otherwise(F.coalesce(F.col("price_cents"), F.lit(0)) / 100.0)
    return j.select("event_id", "user_id", "kind", "mode", "plan_id", "tokens", rnd(amount, 2).alias("amount_paid"), *keep)


def plan_revenue(credits: DataFrame, plans: DataFrame) -> DataFrame:
    """Per pack / plan: purchases, tokens and revenue from the credited events."""
    g = credits.groupBy("plan_id").agg(F.count(F.lit(1)).alias("purchases"),
                                       F.sum("tokens").alias("tokens_sold"),
                                       F.sum("amount_paid").alias("revenue"))
    return (F.broadcast(plans).join(g, "plan_id", "left")
            .select("plan_id", "kind", "price_cents", "billing_interval",
                    F.coalesce("purchases", F.lit(0)).alias("purchases"),
                    F.coalesce("tokens_sold", F.lit(0)).alias("tokens_sold"),
                    rnd(F.coalesce("revenue", F.lit(0.0)), 2).alias("revenue")))


# --------------------------------------------------------------------------
# quotas, rate limits, keys
# --------------------------------------------------------------------------

def usage_quota(requests: DataFrame, limit: int = API_DAILY_LIMIT) -> DataFrame:
    """Requests per key and UTC day against the daily limit (the counter is
    per day here; requests past the limit are refused and not counted)."""
    g = requests.groupBy("key_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("requests"))
    return g.select("key_id", "day", "requests",
                    F.least(F.col("requests"), F.lit(limit)).alias("allowed"),
                    F.greatest(F.col("requests") - limit, F.lit(0)).alias("refused"),
                    (F.col("requests") > limit).alias("over_limit"))


def rate_limit_windows(requests: DataFrame, limits=RATE_LIMITS) -> DataFrame:
    """Fixed-window request counts per client against 60/hour and 300/day."""
    out = None
    for name, dur, lim in limits:
        g = (requests.groupBy("key_id", F.window("ts", dur).alias("w"))
             .agg(F.count(F.lit(1)).alias("requests"))
             .select("key_id", F.lit(name).alias("window"), F.col("w.start").alias("window_start"),
                     "requests", F.lit(lim).alias("limit"),
                     F.greatest(F.col("requests") - lim, F.lit(0)).alias("refused")))
        out = g if out is None else out.unionByName(g)
    return out


def admissions(requests: DataFrame, limits=RATE_LIMITS) -> DataFrame:
    """Every request (key_id, id, ts) with its ``verdict`` under all ``limits`` together.

    ``limits`` are (unit, duration, limit), finest first, each unit nested in the next. A request is admitted if it is among the
    first of its window and every finer limit admitted it; else the verdict names the finest limit that refuses it.
    Requests refused by one limit do not count against the next. (ts, id) orders the requests of a client;
    null clients are one client.

    What a window admits is its beginning, so per finest window only the last admitted (ts, id) of each limit is
    needed: ranks are cut off at the limit before anything is shuffled, and requests meet one row of their window.
    """
    from pyspark.sql import Window
    finest = limits[0][0]
    key = F.coalesce(F.col("key_id").cast("string"), F.lit(""))
    rows = requests.withColumns({"_k": key, "_w": F.date_trunc(finest, "ts")})
    at = F.struct("ts", "id")
    left, marks = rows.select("_k", "_w", "ts", "id"), None
    for name, _, most in limits:
        window = Window.partitionBy("_k", F.date_trunc(name, "ts")).orderBy("ts", "id")
        left = left.withColumn("_n", F.row_number().over(window)).filter(F.col("_n") <= most).drop("_n")
        last = left.groupBy("_k", "_w").agg(F.max(at).alias(f"_{name}"))
        marks = last if marks is None else marks.join(last, ["_k", "_w"], "left")
    verdict = F.lit("admitted")
    for name, _, _ in reversed(limits):
        verdict = F.when(F.coalesce(at <= F.col(f"_{name}"), F.lit(False)), verdict).otherwise(F.lit(name))
    return rows.join(marks, ["_k", "_w"]).select(*requests.columns, verdict.alias("verdict"))


def key_events(events: DataFrame, cap: int = MAX_KEYS_PER_USER) -> DataFrame:
    """Every event (user_id, seq, ts, action create / revoke, key_id) with its outcome and the user's active keys after it.

    A key is created while the user has fewer than ``cap`` active keys; a revocation frees the slot of an active
    key of that user and is ``not found`` for any other. Events go by (ts, seq).
    """
    from candela.functions.folds import fold_rounds, let
    kind = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    status = f"""CASE WHEN o.action = 'create' THEN CASE WHEN size(s.keys) < {cap} THEN 'created' ELSE 'limit reached' END
        WHEN o.action = 'revoke' THEN CASE WHEN coalesce(array_contains(s.keys, o.key_id), false) THEN 'revoked' ELSE 'not found' END
        ELSE 'invalid' END"""
    keys = """CASE WHEN st = 'created' THEN array_append(s.keys, o.key_id) WHEN st = 'revoked' THEN array_remove(s.keys, o.key_id)
        ELSE s.keys END"""
    fields = ["user_id", "seq", "ts", "action", "key_id"]
    row = "named_struct(" + ", ".join(f"'{c}', o.{c}" for c in fields) + ", 'status', st, 'active', size(k))"
    step = let("st", status, let("k", keys, f"named_struct('keys', k, 'out', concat(s.out, array({row})))"))
    out = "STRUCT<" + ", ".join(f"{c}: {kind[c]}" for c in fields) + ", status: STRING, active: INT>"
    bucket = F.coalesce(F.floor(F.unix_date(F.to_date("ts")) / 30), F.lit(-1 << 40))
    return fold_rounds(events.filter(F.col("key_id").isNotNull()), F.col("user_id"), ["ts", "seq"], bucket, fields,
                       {"keys": f"CAST(array() AS ARRAY<{kind['key_id']}>)"}, step, out)


def active_keys(events: DataFrame, cap: int = MAX_KEYS_PER_USER) -> DataFrame:
    """The keys that were created, newest first per user, and whether each is still active (events as in ``key_events``)."""
    from pyspark.sql import Window
    done = key_events(events, cap)
    made = done.filter("status = 'created'").select("user_id", "key_id", F.col("ts").alias("created_at"), "seq")
    gone = done.filter("status = 'revoked'").select("user_id", "key_id", F.lit(False).alias("_on"))
    # A user's keys: at most ``cap`` at a time, in all as many as were created; numbered newest first.
    newest = Window.partitionBy("user_id").orderBy(F.col("created_at").desc(), F.col("seq").desc())
    same = (made["user_id"].eqNullSafe(gone["user_id"])) & (made["key_id"] == gone["key_id"])
    listed = made.join(gone, same, "left").select(made["user_id"], made["key_id"], "created_at", "seq",
                                                  F.coalesce("_on", F.lit(True)).alias("is_active"))
    return listed.withColumn("rank", F.row_number().over(newest).cast("long")).select("user_id", "rank", "key_id", "created_at", "is_active")
