"""Price alerts (family G).

The sweep is one join of the alert table to the newest close per symbol
(one row per symbol; AQE broadcasts it when its measured size is small,
otherwise it is a shuffle join), and the trigger rule is a projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candela.functions.scalar import rnd
from candela.functions.windows import with_position

MAX_ALERTS_PER_USER = 20
MAX_NOTE = 200
ID_BUCKET = 1 << 20


def latest_close(series: DataFrame) -> DataFrame:
    """(symbol, current_price): the newest close of each series (partial aggregate, one exchange)."""
    return series.groupBy("symbol").agg(F.max_by("close", "d").alias("current_price"))


def alert_check(alerts: DataFrame, latest: DataFrame) -> DataFrame:
    """Active alerts vs newest close: above fires at price >= target, below at
    price <= target; an alert without a price stays active (fired false)."""
    act = alerts.filter(F.col("status") == "active")
    j = act.join(latest, "symbol", "left")
    p, t = F.col("current_price"), F.col("target_price")
    fired = (((F.col("direction") == "above") & (p >= t)) | ((F.col("direction") == "below") & (p <= t)))
    return j.select("id", "user_id", "symbol", "target_price", "direction", "note", "current_price",
                    F.coalesce(fired, F.lit(False)).alias("fired"))


def alert_trigger_update(alerts: DataFrame, checked: DataFrame, as_of) -> DataFrame:
    """New version of the alert table: fired alerts become triggered at as_of."""
    fired = checked.filter("fired").select("id", F.lit(True).alias("_fired"))
    j = alerts.join(fired, "id", "left")
    f = F.coalesce(F.col("_fired"), F.lit(False))
    out = j.withColumn("status", F.when(f, F.lit("triggered")).otherwise(F.col("status")))
    return out.withColumn("triggered_at", F.when(f, F.lit(as_of).cast("timestamp_ntz"))).drop("_fired")


def alert_check_summary(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count(F.lit(1)).alias("checked"), F.count_if("fired").alias("triggered"))


def alert_notifications(checked: DataFrame, users: DataFrame, as_of) -> DataFrame:
    """Subject and body text for every fired alert (delivery stays outside)."""
    f = checked.filter("fired").join(users.select("user_id", "name"), "user_id", "left")
    word = F.when(F.col("direction") == "above", "at or above").otherwise("at or below")
    tgt = F.format_number(F.col("target_price"), 2)
    cur = F.format_number(F.col("current_price"), 2)
    subject = F.format_string("Target reached: %s %s $%s", F.col("symbol"), word, tgt)
    note = F.when(F.coalesce(F.col("note"), F.lit("")) != "",
                  F.format_string("note    %s\n", F.col("note"))).otherwise(F.lit(""))
    body = F.concat(
        F.format_string("For %s: %s reached a target price.\n\n", F.col("name"), F.col("symbol")),
        F.format_string("target  %s %s $%s\n", F.col("symbol"), word, tgt),
        F.format_string("close   $%s\n", cur),
        note,
        F.format_string("at      %s UTC\n", F.date_format(F.lit(as_of).cast("timestamp_ntz"), "yyyy-MM-dd HH:mm")))
    return f.select("id", "user_id", "symbol", subject.alias("subject"), body.alias("body"))


def alert_list(alerts: DataFrame) -> DataFrame:
    """Alerts per user, newest first (rank 1 = newest by id), with the user's
    active and total counts."""
    counts = alerts.groupBy("user_id").agg(F.count_if(F.col("status") == "active").alias("active_count"))
    # rank = n - pos over ids; positions are numbered per (user, id range),
    # so a user with very many alerts is not one task
    ranked = with_position(alerts, order=["id"], key="user_id", time_col="id",
                           bucket=F.floor(F.col("id") / ID_BUCKET))
    return (ranked.withColumn("rank", (F.col("n") - F.col("pos")).cast("long")).join(counts, "user_id")
            .select("user_id", "rank", "id", "symbol", "target_price", "direction",
                    F.coalesce(F.col("note"), F.lit("")).alias("note"), "status", "active_count",
                    F.col("n").alias("total_count")))


def alert_validation(requests: DataFrame, alerts: DataFrame, universe: DataFrame) -> DataFrame:
    """Validate alert requests (id, user_id, symbol, direction, target_price, note).

    Symbol upper-cased and known, direction above/below, target a positive
    number (kept to 6 dp), note cut to 200 characters; at most 20 active
    alerts per user: valid requests are taken in id order while the user's
    active count stays below 20 (top-k per user, a grouped limit).
    """
    sym = F.upper(F.trim(F.col("symbol")))
    dirn = F.lower(F.trim(F.col("direction")))
    tgt = F.col("target_price").cast("string").try_cast("double")
    r = requests.select("id", "user_id", sym.alias("symbol"), dirn.alias("direction"), tgt.alias("_t"),
                        F.trim(F.substring(F.coalesce(F.col("note").cast("string"), F.lit("")), 1, MAX_NOTE)).alias("note"))
    known = universe.select("symbol", F.lit(True).alias("_known")).distinct()
    r = r.join(known, "symbol", "left")
    reason = (F.when(F.col("_known").isNull(), "unknown symbol")
              .when(~F.col("direction").isin("above", "below"), "unknown direction")
              .when(F.col("_t").isNull() | (F.col("_t") <= 0), "target price must be a positive number"))
    r = r.withColumn("_err", reason)
    active = (alerts.filter(F.col("status") == "active").groupBy("user_id")
              .agg(F.count(F.lit(1)).alias("_active")))
    ok = r.filter(F.col("_err").isNull()).join(active, "user_id", "left")
    w = Window.partitionBy("user_id").orderBy("id")
    # the literal bound lets Spark cut each user to 20 rows before the shuffle
    taken = (ok.withColumn("_k", F.row_number().over(w))
             .filter(F.col("_k") <= MAX_ALERTS_PER_USER)
             .filter(F.col("_k") <= MAX_ALERTS_PER_USER - F.coalesce(F.col("_active"), F.lit(0)))
             .select("id", F.lit(True).alias("_taken")))
    out = r.join(taken, "id", "left")
    status = (F.when(F.col("_err").isNotNull(), F.col("_err"))
              .when(F.col("_taken"), F.lit("created"))
              .otherwise(F.lit(f"limit of {MAX_ALERTS_PER_USER} active alerts reached")))
    return out.select("id", "user_id", "symbol", "direction",
                      F.when(F.col("_err").isNull(), rnd(F.col("_t"), 6)).alias("target_price"),
                      F.when(F.col("note") != "", F.col("note")).alias("note"), status.alias("status"))
