"""Structured Streaming forms of the alert sweep, payment events, intraday
bars and rate-limit windows.

Every job reads a file stream and keeps its progress in a checkpoint under the
shared ``spark.checkpoint.dir``. A micro-batch writes its rows to the folder
``epoch=N`` of the job's table and overwrites it when the batch is retried, so
each batch counts once. A job given a ``run`` name resumes where the last job
of that name stopped; without a name it starts anew.

What a job must remember is keyed state: Spark's state store holds the event
ids already credited and the open bars and windows, and a table per epoch the alerts
already fired. A batch reads the state it needs, never the output of earlier
batches, so its cost does not grow with their number. No watermark: nothing is
ever too late. Late trades revise bars that are already published.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candela.functions.windows import BUCKET_DAYS
from candela.operators.wallet import parse_payment_events, payment_credits
from candela.session import checkpoint_dir, shared_path

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"   # state on disk, not in the heap


def run_available(stream: DataFrame, name: str, mode: str = "append", run: str | None = None,
                  step: Callable[[DataFrame, DataFrame | None], DataFrame] | None = None,
                  remember: Callable[[DataFrame, DataFrame | None], DataFrame] | None = None) -> str:
    """Run a streaming query over everything available now; return the path of its table.

    ``step(batch, state)`` turns a micro-batch into the rows to write, and
    ``remember(rows, state)`` gives the state that the next batch sees (None before
    the first). Each epoch's state is one table, so a batch reads one of them.
    """
    spark = stream.sparkSession
    run = run or uuid.uuid4().hex[:12]
    out = shared_path(spark, f"stream_{name}_{run}")
    held = shared_path(spark, f"stream_{name}_{run}_state")
    ckpt = f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}_{run}"

    def write(batch: DataFrame, epoch: int) -> None:
        session = batch.sparkSession
        state = session.read.parquet(f"{held}/epoch={epoch - 1}") if epoch and remember else None
        rows = step(batch, state) if step else batch
        rows.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        if remember:
            done = session.read.schema(rows.schema).parquet(f"{out}/epoch={epoch}")
            remember(done, state).write.mode("overwrite").parquet(f"{held}/epoch={epoch}")

    was = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKS)
    try:
        q = (stream.writeStream.outputMode(mode).foreachBatch(write)
             .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        spark.conf.set(STATE_STORE, was) if was else spark.conf.unset(STATE_STORE)
    return out


def newest_revision(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The rows of an update-mode table as they stand: of every key the row of the newest epoch, and ``revisions``."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "epoch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("_r"), F.count(F.lit(1)).alias("revisions"))
    return last.select(*keys, "_r.*", "revisions")


# --------------------------------------------------------------------------
# price alerts on a bar stream
# --------------------------------------------------------------------------

def record_closes(bars: DataFrame) -> DataFrame:
    """Bars that set a new highest or lowest close of their symbol so far.

    Extremes run inside (symbol, year) and are carried between years by a table
    of one row each, so no symbol is one task. Bars of one time go by close.
    Only record bars can be the first to cross a target. Columns: symbol, d, close,
    ``above`` and ``below``: the extreme before the bar (null on the first) where it is passed.
    """
    bucket = F.coalesce(F.floor(F.unix_date(F.to_date("d")) / BUCKET_DAYS), F.lit(-1 << 40))
    rows = bars.select(F.coalesce("symbol", F.lit("")).alias("_s"), "symbol", "d", "close", bucket.alias("_b"))
    before = Window.unboundedPreceding, -1
    inside = Window.partitionBy("_s", "_b").orderBy("d", "close").rowsBetween(*before)
    earlier = Window.partitionBy("_s").orderBy("_b").rowsBetween(*before)
    edges = (rows.groupBy("_s", "_b").agg(F.max("close").alias("h"), F.min("close").alias("l"))
             .select("_s", "_b", F.max("h").over(earlier).alias("h"), F.min("l").over(earlier).alias("l")))
    b = (rows.withColumns({"hi": F.max("close").over(inside), "lo": F.min("close").over(inside)}).join(edges, ["_s", "_b"])
         .withColumns({"hi": F.greatest("hi", "h"), "lo": F.least("lo", "l")}))
    new = F.col("hi").isNull()
    return (b.select("symbol", "d", "close", "hi", "lo", (new | (F.col("close") > F.col("hi"))).alias("above"),
                     (new | (F.col("close") < F.col("lo"))).alias("below")).filter("above or below"))


def alert_fires(bars: DataFrame, alerts: DataFrame) -> DataFrame:
    """The first bar of ``bars`` that crosses each active alert.

    An alert meets exactly the record bar that passes its target, at or beyond
    the target with the record before it short of it, so the output has one row per
    fired alert however many bars lie beyond it.
    """
    act = alerts.filter(F.col("status") == "active").select("id", "user_id", "symbol", "target_price", "direction")
    t, c = F.col("target_price"), F.col("close")
    up = F.col("above") & (F.col("direction") == "above") & (c >= t) & (F.col("hi").isNull() | (F.col("hi") < t))
    down = F.col("below") & (F.col("direction") == "below") & (c <= t) & (F.col("lo").isNull() | (F.col("lo") > t))
    return act.join(record_closes(bars), "symbol").filter(up | down).select(
        "id", "user_id", "symbol", "target_price", "direction", F.col("d").alias("fired_on"), c.alias("price"))


def alert_stream(spark: SparkSession, bar_dir: str, alerts: DataFrame, bar_schema: str, run: str | None = None) -> DataFrame:
    """Fired alerts of a bar stream, each once, at the first bar to arrive that crosses it.

    A batch looks only at alerts that no earlier batch fired; bars are taken in
    the order of their files, inside a batch in the order of their days.
    """
    def step(batch: DataFrame, fired: DataFrame | None) -> DataFrame:
        return alert_fires(batch, alerts if fired is None else alerts.join(fired, "id", "left_anti"))

    def remember(rows: DataFrame, fired: DataFrame | None) -> DataFrame:
        return rows.select("id") if fired is None else rows.select("id").unionByName(fired)

    bars = spark.readStream.schema(bar_schema).option("maxFilesPerTrigger", 1).parquet(bar_dir)
    return spark.read.parquet(run_available(bars, "alerts", run=run, step=step, remember=remember)).drop("epoch")


# --------------------------------------------------------------------------
# payment events with redelivery
# --------------------------------------------------------------------------

def payment_stream(spark: SparkSession, event_dir: str, plans: DataFrame, schema: str, run: str | None = None) -> DataFrame:
    """Credits from a stream of payment JSON events, one per event.

    A delivery is dropped only if its event was credited before, whatever the
    time of the event: late first deliveries count. Events are told apart by their id,
    those without one by the digest of their whole payload.
    """
    ev = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(event_dir)
    known = parse_payment_events(ev).withColumn(
        "event_key", F.coalesce(F.concat(F.lit("id:"), F.col("e.id")), F.concat(F.lit("payload:"), F.sha2("json", 256))))
    credits = payment_credits(known, plans, keep=["event_key"]).dropDuplicates(["event_key"]).drop("event_key")
    return spark.read.parquet(run_available(credits, "payments", run=run)).drop("epoch")


# --------------------------------------------------------------------------
# intraday bars and rate-limit windows on event streams
# --------------------------------------------------------------------------

def stream_bars(trades: DataFrame, interval: str = "1 hour") -> DataFrame:
    """OHLCV bars from a trade stream, for update mode: a batch publishes the bars it touched.

    A bar's state holds price and order key of its first and last trade, extremes and
    volume; it merges with whatever comes, so a trade of any age revises its bar.
    """
    key = F.struct("ts", "event_id")
    return (trades.withColumn("ts", F.col("ts").cast("timestamp"))
            .groupBy("symbol", F.window("ts", interval).alias("w"))
            .agg(F.min_by("px", key).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"),
                 F.max_by("px", key).alias("close"), F.sum("size").alias("volume"))
            .select("symbol", F.col("w.start").alias("d"), "open", "high", "low", "close", "volume"))


def bars_stream(trades: DataFrame, interval: str = "1 hour", run: str | None = None) -> DataFrame:
    """Bars of a trade stream as they stand after everything available now, with the number of their ``revisions``."""
    path = run_available(stream_bars(trades, interval), "bars", "update", run)
    return newest_revision(trades.sparkSession, path, ["symbol", "d"])


def stream_rate_windows(requests: DataFrame, duration: str, limit: int) -> DataFrame:
    """Fixed-window request counts per client on a request stream, for update mode; late requests count."""
    return (requests.withColumn("ts", F.col("ts").cast("timestamp"))
            .groupBy("key_id", F.window("ts", duration).alias("w"))
            .agg(F.count(F.lit(1)).alias("requests"))
            .select("key_id", F.col("w.start").alias("window_start"), "requests",
                    F.greatest(F.col("requests") - limit, F.lit(0)).alias("refused")))


def rate_windows_stream(requests: DataFrame, duration: str, limit: int, run: str | None = None) -> DataFrame:
    """Counts of a request stream as they stand after everything available now."""
    path = run_available(stream_rate_windows(requests, duration, limit), "rates", "update", run)
    return newest_revision(requests.sparkSession, path, ["key_id", "window_start"])
