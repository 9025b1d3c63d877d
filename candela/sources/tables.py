"""Table readers and the fixture mappings of FIXTURES.md §3.

Every reader selects only the columns it needs so the parquet scan prunes
them (``ReadSchema``) and filters reach the scan (``PushedFilters``).
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.functions.scalar import rnd
from candela.sources.bars import bars_from_trades

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Symbols by index (fixed values of the fixture mapping): o_orderkey % 6 etc.
SYMBOLS_BY_INDEX = ["A-F", "A-O", "N-F", "N-O", "R-F", "R-O"]


def symbol_of(idx: F.Column) -> F.Column:
    """Symbol for an integer index 0..5 (FIXTURES.md: 0 A-F ... 5 R-O)."""
    return F.element_at(F.array(*[F.lit(s) for s in SYMBOLS_BY_INDEX]), (idx % 6).cast("int") + 1)


def lineitem_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem rows as trades: (symbol, ts, px, size, order key...)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat(F.col("l_returnflag"), F.lit("-"), F.col("l_linestatus")).alias("symbol"),
        F.col("l_shipdate").alias("ts"),
        (F.col("l_extendedprice") / F.when(F.col("l_quantity") != 0, F.col("l_quantity"))).alias("px"),
        F.col("l_quantity").alias("size"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")


# Unique trade order inside (symbol, day) for open/close; the last two keys
# only break exact duplicates of the first four.
TRADE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


_CACHES: list[dict] = []
_BARS_CACHE: dict = {}


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars (symbol, d, open, high, low, close, volume) from lineitem.

    lineitem is scanned once per session; the bars (one row per symbol and
    day, tiny next to lineitem) are persisted so every branch of a plan that
    uses them (positions, row-count checks, joins) reads the same copy.
    """
    return _session_cached(_BARS_CACHE, spark, sf_dir, lambda: bars_from_trades(
        lineitem_trades(spark, sf_dir), order_cols=TRADE_ORDER, unit="day"))


def _version(spark: SparkSession, sf_dir: str) -> int:
    """Hash of names, sizes and times of the files under ``sf_dir``: changed data are other data."""
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
        files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        found = [f for top in files.listStatus(path) for f in (files.listStatus(top.getPath()) if top.isDirectory() else [top])]
        return hash(frozenset((str(f.getPath()), f.getLen(), f.getModificationTime()) for f in found))
    except Exception:  # noqa: BLE001 - a session without a JVM handle
        return 0


def _session_cached(cache: dict, spark: SparkSession, sf_dir: str, build) -> DataFrame:
    """Persist ``build()`` once per (live session, sf_dir, state of its files); a new session,
    even one that reuses an old object id, gets its own copy. Changed files release what was built from the old ones."""
    key = (id(spark), sf_dir)
    version = _version(spark, sf_dir)
    hit = cache.get(key)
    if not any(c is cache for c in _CACHES):
        _CACHES.append(cache)
    if hit is not None and hit[0] is spark and hit[2] != version:
        for other in _CACHES:
            old = other.pop(key, None)
            if old is not None and old[0] is spark:
                old[1].unpersist()
        hit = None
    if hit is None or hit[0] is not spark:
        cache[key] = (spark, build().persist(StorageLevel.MEMORY_AND_DISK), version)
    return cache[key][1]


def hourly_event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars per event_type from events (intraday mapping)."""
    ev = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), "ts", F.col("value").alias("px"),
        F.lit(1.0).alias("size"), "event_id")
    return bars_from_trades(ev, order_cols=["ts", "event_id"], unit="hour")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))


def watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, symbol, added_at): distinct (o_custkey, symbol of o_orderkey % 6)."""
    o = table(spark, sf_dir, "orders")
    return (o.groupBy(F.col("o_custkey").alias("user_id"), symbol_of(F.col("o_orderkey")).alias("symbol"))
            .agg(F.min("o_orderdate").alias("added_at")))


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("id"), F.col("c_custkey").alias("user_id"),
        symbol_of(F.col("c_custkey")).alias("symbol"),
        (F.abs(F.col("c_acctbal")) + 1).alias("target_price"),
        F.when(F.col("c_custkey") % 2 == 0, "above").otherwise("below").alias("direction"),
        F.when(F.col("c_custkey") % 10 == 0, "cancelled").otherwise("active").alias("status"),
        F.col("c_name").alias("note"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"),
        symbol_of(F.col("o_orderkey")).alias("symbol"),
        F.concat(F.lit("$"), rnd(F.col("o_totalprice") / 50, 2).cast("string")).alias("predicted_result"),
        F.col("o_orderdate").alias("created_at"))


def trade_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, d, seq_key, symbol, action, quantity): one order per orders row."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").alias("user_id"),
        F.to_date("o_orderdate").alias("d"),
        F.col("o_orderdate").alias("executed_at"),
        F.col("o_orderkey").alias("order_id"),
        symbol_of(F.col("o_orderkey")).alias("symbol"),
        F.when(F.col("o_orderstatus") == "F", "sell").otherwise("buy").alias("action"),
        ((F.col("o_orderkey") % 10 + 1) / 10.0).alias("quantity"))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").filter(F.col("event_type") == "purchase")
    return ev.select(
        F.col("event_id").alias("id"), "user_id",
        F.col("value").alias("amount_paid"),
        (F.floor("value") + 1).cast("long").alias("tokens_added"),
        F.col("ts").alias("date"))


def wallet_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").filter(F.col("event_type") == "view")
    return ev.select(F.col("event_id").alias("id"), "user_id", "ts")


def api_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "view"))
    return ev.select(F.col("event_id").alias("id"), F.col("user_id").alias("key_id"), "ts")


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines from whole documents: symbol = source, title = the first
    line, summary = the rest of the text, published in doc_id order."""
    d = table(spark, sf_dir, "documents")
    nl = F.instr("text", "\n")
    return d.select(
        "doc_id", F.col("source").alias("symbol"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.when(nl > 0, F.expr("substr(text, instr(text, '\\n') + 1)")).otherwise(F.lit("")).alias("summary"),
        F.col("doc_id").alias("published"))


# Test lexicon (token, weight): tokens that occur in the invented prose of
# ``documents`` plus a few real sentiment words. A parameter, not a model.
LEXICON = [("that", 0.5), ("with", 1.2), ("this", -0.8), ("from", -1.1), ("than", 0.9),
           ("thing", 1.5), ("then", -0.6), ("ther", -0.4), ("tion", 0.3), ("worthless", -2.5),
           ("good", 1.9), ("great", 3.1), ("bad", -2.5), ("loss", -1.3), ("gain", 1.4)]


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEXICON, "token string, weight double")


# Literal chat messages, one per keyword set plus the edge cases (FIXTURES).
CHAT_EXTRA = ["Allow short selling nedir?", "Which model gives the best forecast?", "Show my watchlist",
              "Can you recommend something?", "How much does a token cost?", "What is the Sharpe ratio?",
              "hello there", "   ", "x" * 601]


def chat_messages_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame([(-(i + 1), 0, m) for i, m in enumerate(CHAT_EXTRA)],
                                  "conv_id long, turn long, message string")
    return chat_messages(spark, sf_dir).unionByName(extra)


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    cv = table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    return cv.select("conv_id", "turn", F.col("text").alias("message"))


def labelled_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    lab = table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id")


_PROCESSED_CACHE: dict = {}


def processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The processed series: trimmed feature frame (52 features, target, OHLCV).

    Its complete rows are persisted once per session; the snapshot, screener,
    chart, backtest and forecast queries all read them, as the reference reads
    its feature frame.
    """
    from candela.operators.indicators import feature_matrix, require_rows
    return require_rows(_session_cached(_PROCESSED_CACHE, spark, sf_dir,
                                        lambda: feature_matrix(bars(spark, sf_dir), trim="complete")), 60)


def forget(spark: SparkSession) -> None:
    """Release every frame persisted for the queries (a cold start)."""
    for cache in _CACHES:
        cache.clear()
    spark.catalog.clearCache()


def parse_price(s: F.Column) -> F.Column:
    """'$123.4' -> 123.4 (null when not a number)."""
    return F.replace(s, F.lit("$"), F.lit("")).try_cast("double")


def latest_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per symbol, the newest prediction's price: (symbol, prediction)."""
    p = predictions(spark, sf_dir)
    return (p.groupBy("symbol")
            .agg(F.max_by("predicted_result", F.struct("created_at", "id")).alias("_r"))
            .select("symbol", parse_price(F.col("_r")).alias("prediction")))


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instrument universe: every symbol that has bars."""
    return bars(spark, sf_dir).select("symbol").distinct()


def as_of(spark: SparkSession, sf_dir: str) -> F.Column:
    """The data's "now": the newest order timestamp (a scalar subquery), so
    no query depends on the wall clock."""
    return table(spark, sf_dir, "orders").select(F.max("o_orderdate")).scalar()


def alert_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert creation requests from customer rows: user = nation (so the
    20-alert cap binds), symbol in lower case, some invalid directions, the
    account balance as target (negative ones are invalid)."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("user_id"),
        F.lower(symbol_of(F.col("c_custkey"))).alias("symbol"),
        F.when(F.col("c_custkey") % 11 == 0, F.lit("sideways"))
         .when(F.col("c_custkey") % 2 == 0, F.lit(" Above ")).otherwise(F.lit("below")).alias("direction"),
        F.col("c_acctbal").alias("target_price"), F.col("c_name").alias("note"))


def watchlist_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watchlist add (click events) and remove (error events) requests."""
    ev = table(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "error"))
    return ev.select("user_id", symbol_of(F.col("event_id")).alias("symbol"),
                     F.when(F.col("event_type") == "click", "add").otherwise("remove").alias("action"),
                     "ts", F.col("event_id").alias("seq"))


# Fixed values of the payment fixture mapping (index -> pack / plan id).
PACKS_BY_INDEX = ["starter", "explorer", "pro", "whale"]
PACK_TOKENS = [20, 50, 100, 500]
PLANS_BY_INDEX = ["pro_monthly", "enterprise_monthly"]
PLAN_TOKENS = [200, 999]


def _pick(values: list, idx: F.Column) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx % len(values)).cast("int") + 1)


def payment_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payment-provider events as JSON text built from ``events`` with
    to_json(struct): purchase -> completed one-off checkout (pack by event id),
    signup -> completed subscription checkout (plan by event id), view ->
    invoice paid (every third one a renewal cycle), click / error -> other
    event types. Users divisible by 50 carry no user id (skipped)."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    eid = F.col("event_id")
    uid = F.when(F.col("user_id") % 50 == 0, F.lit(0)).otherwise(F.col("user_id")).cast("string")
    pack, plan = _pick(PACKS_BY_INDEX, eid), _pick(PLANS_BY_INDEX, eid)
    ptok, stok = _pick(PACK_TOKENS, eid).cast("string"), _pick(PLAN_TOKENS, eid).cast("string")
    et = F.col("event_type")
    typ = (F.when(et.isin("purchase", "signup"), "checkout.session.completed")
           .when(et == "view", "invoice.payment_succeeded")
           .when(et == "click", "customer.subscription.updated").otherwise("charge.failed"))
    meta = F.struct(uid.alias("user_id"),
                    F.when(et == "purchase", ptok).otherwise(stok).alias("tokens"),
                    F.when(et == "purchase", pack).alias("pack_id"),
                    F.when(et != "purchase", plan).alias("plan_id"))
    obj = F.struct(
        F.concat(F.lit("obj_"), eid.cast("string")).alias("id"),
        F.when(et == "purchase", "payment").when(et == "signup", "subscription").alias("mode"),
        F.when(et.isin("purchase", "signup"), meta).alias("metadata"),
        F.when(et == "view", F.when(eid % 3 == 0, "subscription_cycle").otherwise("subscription_create"))
         .alias("billing_reason"),
        F.when(et == "view", F.round(F.col("value") * 100).cast("long")).alias("amount_paid"),
        F.when(et == "view", F.struct(F.concat(F.lit("sub_"), F.col("user_id").cast("string")).alias("id"),
                                      meta.alias("metadata"))).alias("subscription"))
    doc = F.struct(F.concat(F.lit("evt_"), eid.cast("string")).alias("id"), typ.alias("type"),
                   F.struct(obj.alias("object")).alias("data"))
    return ev.select("event_id", "ts", F.to_json(doc).alias("json"))


def key_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """API key events: a signup asks for a key named by the event, an error event revokes the key that the
    user's newest earlier signup asked for (null if there was none)."""
    from pyspark.sql import Window
    ev = table(spark, sf_dir, "events").filter(F.col("event_type").isin("signup", "error"))
    before = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    asked = F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), True).over(before)
    return ev.select("user_id", F.col("event_id").alias("seq"), "ts",
                     F.when(F.col("event_type") == "signup", "create").otherwise("revoke").alias("action"), asked.alias("key_id"))


def resets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paper-portfolio resets: a user's signup events (user_id, reset_at)."""
    ev = table(spark, sf_dir, "events").filter(F.col("event_type") == "signup")
    return ev.select("user_id", F.col("ts").alias("reset_at"))


# --------------------------------------------------------------------------
# source fixtures written to (and read back from) the shared folder
# --------------------------------------------------------------------------

_WRITTEN: dict = {}


def _written(spark: SparkSession, sf_dir: str, name: str, build) -> str:
    """Write a fixture table once per session into the shared folder."""
    from candela.session import shared_path
    key = (id(spark), sf_dir, name, _version(spark, sf_dir))
    hit = _WRITTEN.get(key)
    if hit is None or hit[0] is not spark:
        import uuid
        path = shared_path(spark, f"{name}_{uuid.uuid4().hex[:12]}")   # fresh folder per run
        build(path)
        _WRITTEN[key] = (spark, path)
    return _WRITTEN[key][1]


def stored_bars_path(spark: SparkSession, sf_dir: str) -> str:
    from candela.sources.bars import bars_sink
    return _written(spark, sf_dir, "bars", lambda p: bars_sink(bars(spark, sf_dir), p))


def bars_feed(spark: SparkSession, sf_dir: str, where: F.Column | None = None) -> DataFrame:
    tr = lineitem_trades(spark, sf_dir)
    if where is not None:
        tr = tr.filter(where)
    return bars_from_trades(tr, order_cols=TRADE_ORDER, unit="day")


def bar_feeds(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Three bar feeds in priority order: trades of full lots (quantity 50),
    first lines of orders, then all trades."""
    return [bars_feed(spark, sf_dir, F.col("l_quantity") == 50),
            bars_feed(spark, sf_dir, F.col("l_linenumber") == 1),
            bars(spark, sf_dir)]


def chart_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chart JSON documents, one per (symbol, month), built from the bars:
    parallel arrays, epoch seconds at 21:00 UTC, an adjusted close (0.98 x
    close) for symbols starting with 'A', and a null volume on the 15th."""
    b = bars(spark, sf_dir)
    row = F.struct(
        F.unix_timestamp(F.to_timestamp(F.concat(F.date_format("d", "yyyy-MM-dd"), F.lit(" 21:00:00")))).alias("t"),
        "open", "high", "low", "close",
        F.when(F.dayofmonth("d") == 15, F.lit(None).cast("double")).otherwise(F.col("volume")).alias("volume"),
        (F.col("close") * 0.98).alias("adj"))
    g = (b.groupBy("symbol", F.date_trunc("month", "d").alias("m"))
         .agg(F.array_sort(F.collect_list(row)).alias("rows")))   # at most 31 rows per document
    has_adj = F.col("symbol").startswith("A")
    def field(name):
        return lambda r: r[name]
    quote = F.struct(*[F.transform("rows", field(k)).alias(k) for k in ("open", "high", "low", "close", "volume")])
    res = F.struct(
        F.struct(F.col("symbol").alias("symbol")).alias("meta"),
        F.transform("rows", lambda r: r["t"]).alias("timestamp"),
        F.struct(F.array(quote).alias("quote"),
                 F.when(has_adj, F.array(F.struct(F.transform("rows", lambda r: r["adj"]).alias("adjclose"))))
                 .alias("adjclose")).alias("indicators"))
    doc = F.struct(F.struct(F.array(res).alias("result")).alias("chart"))
    return g.select("symbol", "m", F.to_json(doc).alias("json"))


def csv_bars_path(spark: SparkSession, sf_dir: str) -> str:
    """Bars written as CSV with vendor headers (Symbol, Date, Open, High,
    Low, Close, Adj Close, Volume); adjusted close = 0.98 x close."""
    def build(path):
        b = bars(spark, sf_dir)
        out = b.select(F.col("symbol").alias("Symbol"), F.date_format("d", "yyyy-MM-dd").alias("Date"),
                       F.col("open").alias("Open"), F.col("high").alias("High"), F.col("low").alias("Low"),
                       F.col("close").alias("Close"), (F.col("close") * 0.98).alias("Adj Close"),
                       F.col("volume").alias("Volume"))
        out.write.mode("overwrite").option("header", True).csv(path)
    return _written(spark, sf_dir, "bars_csv", build)


def raw_bar_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw feed with repeated deliveries: one bar per (symbol, day, line
    number) as text with vendor-cased headers; the line number is the
    arrival order and line 3 carries an unparseable volume."""
    tr = lineitem_trades(spark, sf_dir)
    g = bars_from_trades(tr.withColumnRenamed("symbol", "_s").withColumn(
        "symbol", F.concat_ws("#", "_s", F.col("l_linenumber").cast("string"))),
        order_cols=TRADE_ORDER, unit="day")
    sym = F.split("symbol", "#")
    return g.select(sym[0].alias("Symbol"), F.col("d").alias("D"),
                    F.col("open").cast("string").alias("Open"), F.col("high").cast("string").alias(" HIGH "),
                    F.col("low").cast("string").alias("low"), F.col("close").cast("string").alias("Close"),
                    F.when(sym[1] == "3", F.lit("n/a")).otherwise(F.col("volume").cast("string")).alias("Volume"),
                    sym[1].cast("int").alias("Arrival"))


def symbol_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each symbol's data was last loaded: its newest trade time."""
    return (lineitem_trades(spark, sf_dir).groupBy("symbol").agg(F.max("ts").alias("loaded_at")))


def data_as_of(spark: SparkSession, sf_dir: str) -> F.Column:
    """Report time for freshness: two hours after the newest trade."""
    return table(spark, sf_dir, "lineitem").select(
        F.max("l_shipdate") + F.expr("INTERVAL 2 HOURS")).scalar()


BAR_SCHEMA = "symbol string, d date, open double, high double, low double, close double, volume double"
PAYMENT_EVENT_SCHEMA = "event_id long, ts timestamp_ntz, json string"


def bar_stream_dir(spark: SparkSession, sf_dir: str) -> str:
    """The daily bars as a file stream: three files, oldest bars first."""
    def build(path):
        b = bars(spark, sf_dir)
        for lo, hi in (("1900-01-01", "1995-01-01"), ("1995-01-01", "1997-01-01"), ("1997-01-01", "2100-01-01")):
            b.filter((F.col("d") >= lo) & (F.col("d") < hi)).coalesce(1).write.mode("append").parquet(path)
    return _written(spark, sf_dir, "bar_stream", build)


def payment_stream_dir(spark: SparkSession, sf_dir: str) -> str:
    """Payment JSON events as a file stream in three time slices; every
    slice after the first also redelivers some events of the slice before
    (event id divisible by 17), and a last file redelivers the tail."""
    def build(path):
        ev = payment_json(spark, sf_dir)
        t = F.col("ts")
        cuts = ["1900-01-01", "2024-01-11", "2024-01-21", "2100-01-01"]
        slices = [ev.filter((t >= cuts[i]) & (t < cuts[i + 1])) for i in range(3)]
        for i, sl in enumerate(slices):
            out = sl if i == 0 else sl.unionByName(slices[i - 1].filter(F.col("event_id") % 17 == 0))
            out.write.mode("append").parquet(path)
        slices[2].filter(F.col("event_id") % 17 == 0).write.mode("append").parquet(path)
    return _written(spark, sf_dir, "payment_stream", build)


def event_stream_dir(spark: SparkSession, sf_dir: str) -> str:
    """Events as a file stream: two time slices without every tenth event, which come weeks late in a last file."""
    def build(path):
        ev = table(spark, sf_dir, "events")
        late = F.col("event_id") % 10 == 0
        for where in (~late & (F.col("ts") < "2024-01-16"), ~late & (F.col("ts") >= "2024-01-16"), late):
            ev.filter(where).coalesce(1).write.mode("append").parquet(path)
    return _written(spark, sf_dir, "event_stream", build)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (spark.readStream.schema(table(spark, sf_dir, "events").schema).option("maxFilesPerTrigger", 1)
            .parquet(event_stream_dir(spark, sf_dir)))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intraday prices: purchases quote the symbol of their user (user_id % 6) at their time."""
    ev = table(spark, sf_dir, "events").filter(F.col("event_type") == "purchase")
    return ev.select(symbol_of(F.col("user_id")).alias("symbol"), "ts", F.col("value").alias("px"), "event_id")


def intraday_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders at a time of day: clicks buy, errors sell, in the symbol event_id % 6."""
    ev = table(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "error"))
    return ev.select("user_id", F.col("event_id").alias("order_id"), F.col("ts").alias("executed_at"), symbol_of(F.col("event_id")).alias("symbol"),
                     F.when(F.col("event_type") == "click", "buy").otherwise("sell").alias("action"),
                     ((F.col("event_id") % 10 + 1) / 10.0).alias("quantity"))


def intraday_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions made at a time of day: views predict the value of an event type (event_id % 5) three days ahead."""
    ev = table(spark, sf_dir, "events").filter(F.col("event_type") == "view")
    kinds = F.array(*[F.lit(x) for x in EVENT_TYPES])
    return ev.select(F.col("event_id").alias("id"), "user_id", F.element_at(kinds, (F.col("event_id") % 5).cast("int") + 1).alias("symbol"),
                     F.concat(F.lit("$"), rnd(F.col("value"), 2).cast("string")).alias("predicted_result"), F.col("ts").alias("created_at"))


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
