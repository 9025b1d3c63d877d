"""Activity reports and watchlist maintenance (family K)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candela.functions.scalar import rnd
from candela.functions.windows import prefix_sum_min

MAX_WATCHLIST = 30


def admin_kpis(users: DataFrame, predictions: DataFrame, transactions: DataFrame, as_of) -> DataFrame:
    """Users, predictions, revenue, tokens sold, predictions since midnight of
    ``as_of``; revenue and predictions per user. Global aggregates (partial
    aggregation, one row each) side by side."""
    midnight = F.date_trunc("day", F.lit(as_of).cast("timestamp_ntz"))
    u = users.agg(F.count(F.lit(1)).alias("user_count"))
    p = predictions.agg(F.count(F.lit(1)).alias("pred_count"),
                        F.count_if(F.col("created_at") >= midnight).alias("preds_today"))
    t = transactions.agg(F.coalesce(F.sum("amount_paid"), F.lit(0.0)).alias("_rev"),
                         F.coalesce(F.sum("tokens_added"), F.lit(0)).cast("long").alias("token_sales"))
    # one-row aggregates side by side as scalar subqueries (no join)
    j = u.select("user_count", *[p.select(c).scalar().alias(c) for c in p.columns],
                 *[t.select(c).scalar().alias(c) for c in t.columns])
    uc = F.col("user_count")
    return j.select("user_count", "pred_count", rnd(F.col("_rev"), 2).alias("revenue"), "token_sales",
                    "preds_today",
                    F.when(uc > 0, rnd(F.col("_rev") / uc, 2)).otherwise(F.lit(0.0)).alias("revenue_per_user"),
                    F.when(uc > 0, rnd(F.col("pred_count") / uc, 1)).otherwise(F.lit(0.0)).alias("preds_per_user"))


def top_users(users: DataFrame, predictions: DataFrame, k: int = 10) -> DataFrame:
    """Users left-joined to their prediction counts, top k (ties by user id).
    Counts are aggregated before the join, so a heavy user is one row."""
    pc = predictions.groupBy("user_id").agg(F.count("id").alias("pc"))
    j = users.join(pc, "user_id", "left").select("user_id", "name", F.coalesce("pc", F.lit(0)).alias("pc"))
    return j.orderBy(F.col("pc").desc(), F.col("user_id")).limit(k)


def recent_predictions(predictions: DataFrame, users: DataFrame, k: int = 20) -> DataFrame:
    top = predictions.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(k)
    return top.join(users.select("user_id", "name"), "user_id", "left").select(
        "id", "user_id", "name", "symbol", "predicted_result", "created_at")


def user_history(transactions: DataFrame, predictions: DataFrame, n_tx: int = 50, n_pred: int = 100) -> DataFrame:
    """Per user: newest 50 transactions and newest 100 predictions (grouped
    top-k: each user is cut to k rows before the shuffle)."""
    wt = Window.partitionBy("user_id").orderBy(F.col("date").desc(), F.col("id").desc())
    wp = Window.partitionBy("user_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    tx = (transactions.withColumn("rank", F.row_number().over(wt).cast("long")).filter(F.col("rank") <= n_tx)
          .select(F.lit("transaction").alias("kind"), "user_id", "rank", "id", F.col("date").alias("ts"),
                  F.col("amount_paid").alias("amount"), F.col("tokens_added").cast("string").alias("detail")))
    pr = (predictions.withColumn("rank", F.row_number().over(wp).cast("long")).filter(F.col("rank") <= n_pred)
          .select(F.lit("prediction").alias("kind"), "user_id", "rank", "id", F.col("created_at").alias("ts"),
                  F.lit(None).cast("double").alias("amount"), F.col("predicted_result").alias("detail")))
    return tx.unionByName(pr)


def _watchlist_fold(cap: int):
    """Requests of one user after the other, in order; ``held0`` is the list before the first."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, held = object(), set()
        for pdf in batches:
            out = []
            for u, symbol, action, held0 in zip(pdf["user_id"].tolist(), pdf["symbol"].tolist(), pdf["action"].tolist(),
                                                pdf["held0"].tolist()):
                if u != user:
                    user, held = u, set(held0)
                if action == "add":
                    out.append("already there" if symbol in held else "full" if len(held) >= cap else "added")
                    if out[-1] == "added":
                        held.add(symbol)
                else:
                    out.append("removed" if symbol in held else "not found")
                    held.discard(symbol)
            yield pdf.drop(columns="held0").assign(outcome=out)
    return run


def watchlist_events(watchlist: DataFrame, requests: DataFrame, universe: DataFrame, cap: int = MAX_WATCHLIST) -> DataFrame:
    """Every add / remove request (user_id, symbol, action, ts, seq) with its outcome, applied in the order of (ts, seq).

    Outcomes: added, already there, full, removed, not found, invalid (symbol
    outside the universe). Without the cap a request depends only on the
    one before it for the same item, which a window gives; the list sizes are a
    two-level running sum. Only users whose list would grow beyond ``cap``
    are folded request by request (a streamed fold; the state is at most ``cap`` symbols).
    """
    req = requests.select("user_id", F.upper(F.trim("symbol")).alias("symbol"), "action", "ts", "seq")
    known = universe.select("symbol", F.lit(True).alias("_known")).distinct()
    req = req.join(known, "symbol", "left").select("user_id", "symbol", "action", "ts", "seq", F.col("_known").isNotNull().alias("_ok"))
    items = watchlist.select("user_id", "symbol").distinct()
    had = items.withColumn("_had", F.lit(True))
    w = Window.partitionBy("user_id", "symbol").orderBy("ts", "seq")
    good = req.filter("_ok").drop("_ok").join(had, ["user_id", "symbol"], "left")
    held = F.coalesce(F.lag("action").over(w) == "add", F.col("_had"), F.lit(False))
    good = good.withColumn("_held", held).withColumn(
        "_delta", F.when((F.col("action") == "add") & ~F.col("_held"), 1.0)
        .when((F.col("action") == "remove") & F.col("_held"), -1.0).otherwise(0.0))
    sizes = items.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n0"))
    sized = prefix_sum_min(good, "user_id", ["ts", "seq"], "_delta", time_col="ts").join(sizes, "user_id", "left")
    full = (sized.filter(F.col("_S") + F.coalesce("_n0", F.lit(0)) > cap).select("user_id").distinct())
    free = good.join(full, "user_id", "left_anti").select(
        "user_id", "symbol", "action", "ts", "seq",
        F.when(F.col("action") == "add", F.when(F.col("_held"), "already there").otherwise("added"))
        .otherwise(F.when(F.col("_held"), "removed").otherwise("not found")).alias("outcome"))
    lists = items.groupBy("user_id").agg(F.collect_set("symbol").alias("held0"))     # at most a user's list
    tight = (good.join(full, "user_id", "left_semi").join(lists, "user_id", "left")
             .select("user_id", "symbol", "action", "ts", "seq", F.coalesce("held0", F.array().cast("array<string>")).alias("held0"))
             .repartition("user_id").sortWithinPartitions("user_id", "ts", "seq")
             .mapInPandas(_watchlist_fold(cap), free.schema))
    bad = req.filter(~F.col("_ok")).select("user_id", "symbol", "action", "ts", "seq", F.lit("invalid").alias("outcome"))
    return free.unionByName(tight).unionByName(bad)


def watchlist_upsert(watchlist: DataFrame, events: DataFrame) -> DataFrame:
    """The watchlist (user_id, symbol, added_at) after ``watchlist_events``: the last request that took effect decides."""
    last = (events.filter(F.col("outcome").isin("added", "removed")).groupBy("user_id", "symbol")
            .agg(F.max(F.struct("ts", "seq", "outcome")).alias("e")))
    kept = watchlist.select("user_id", "symbol", "added_at").join(last, ["user_id", "symbol"], "left_anti")
    return kept.unionByName(last.filter(F.col("e.outcome") == "added").select("user_id", "symbol", F.col("e.ts").alias("added_at")))
