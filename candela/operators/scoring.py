"""Scoring of past price predictions (family J)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candela.functions.scalar import rnd
from candela.functions.windows import asof_join, asof_join_daily


def accuracy_update(predictions: DataFrame, series: DataFrame, as_of, horizon_days: int = 14,
                    per_user: int | None = None) -> DataFrame:
    """Score unscored predictions older than ``horizon_days`` at ``as_of``.

    The actual price is the first close on or after created_at + horizon
    (forward as-of join on the day calendar, or on the time if the bars' ``d`` is one); accuracy is
    max(0, 100 - |actual - predicted| / actual * 100) to 2 dp, the "$" is
    stripped from the stored text. ``per_user``, if given, limits a run to so many
    scorable predictions per user, lowest ids first; those that still wait
    for a bar never hold up others.
    """
    p = predictions
    if "accuracy_pct" in p.columns:
        p = p.filter(F.col("accuracy_pct").isNull())
    intraday = series.schema["d"].dataType.typeName() != "date"
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {horizon_days} DAYS")
    p = p.filter(F.col("created_at") < cutoff)
    target = F.col("created_at") + F.expr(f"INTERVAL {horizon_days} DAYS")
    # first bar whose midnight is >= target: day of target, or the next day
    # when target is past midnight
    day = F.when(F.col("_tgt") == F.col("_tgt").cast("date").cast("timestamp_ntz"),
                 F.col("_tgt").cast("date")).otherwise(F.date_add(F.col("_tgt").cast("date"), 1))
    p = p.withColumn("_tgt", target).withColumn("_day", day)
    bars = series.select("symbol", "d", F.col("close").alias("actual"))
    if intraday:
        j = asof_join(p, bars, "symbol", "_tgt", "d", ["actual"], direction="forward").withColumnRenamed("_asof_t", "_asof_d")
    else:
        j = asof_join_daily(p, bars, "_day", ["actual"], direction="forward")
    pred = F.replace(F.col("predicted_result"), F.lit("$"), F.lit("")).try_cast("double")
    acc = 100 - F.abs((F.col("actual") - pred) / F.col("actual") * 100)
    scored = j.filter(F.col("actual").isNotNull() & F.col("predicted_result").isNotNull()
                      & (F.col("predicted_result") != ""))
    if per_user is not None:
        w = Window.partitionBy("user_id").orderBy("id")
        scored = scored.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= per_user).drop("_k")
    return scored.select("id", "user_id", "symbol", "created_at", F.col("_asof_d").alias("actual_date"),
                         "actual", pred.alias("predicted"),
                         rnd(F.greatest(acc, F.lit(0.0)), 2).alias("accuracy_pct"))


def user_accuracy(predictions: DataFrame, k: int = 100) -> DataFrame:
    """Per user: mean accuracy of the scored ones among the newest k
    predictions (1 dp) and how many were scored; null mean when none."""
    w = Window.partitionBy("user_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    last = predictions.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= k)
    return last.groupBy("user_id").agg(rnd(F.avg("accuracy_pct"), 1).alias("avg_accuracy"),
                                       F.count("accuracy_pct").alias("scored_count"))
