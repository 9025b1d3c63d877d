"""Rule-level unit tests on tiny hand-made tables (edge cases the driver
tables do not reach)."""

import datetime
import json

from pyspark.sql import functions as F

from candela.operators import alerts as al
from candela.operators import reports as rp
from candela.operators import snapshot as snp
from candela.operators import text as tx
from candela.operators import wallet as wl

SNAP_SCHEMA = ("symbol string, price double, change_1d double, change_20d double, change_60d double, "
               "sma20 double, sma50 double, rsi double, rsi_state string, trend string, volatility double")


def test_risk_points_and_score_profiles(spark):
    rows = [("CALM", 10.0, 0.1, 2.0, 5.0, 9.5, 9.0, 50.0, "neutral", "bullish", 10.0),
            ("WILD", 10.0, 0.1, 40.0, -50.0, 9.5, 9.0, 75.0, "overbought", "mixed", 60.0)]
    s = spark.createDataFrame(rows, SNAP_SCHEMA)
    out = {r.symbol: r for r in s.select(
        "symbol", snp.snapshot_risk(s).alias("risk"),
        *[snp.snapshot_score(p).alias(p) for p in snp.PROFILES]).collect()}
    assert out["CALM"].risk == "LOW" and out["WILD"].risk == "HIGH"
    # 50 + 28 + 2 + 12 - 10/3 = 88.7; low risk also loses 5; momentum adds 3
    assert out["CALM"].balanced == 88.7 and out["CALM"].low_risk == 83.7 and out["CALM"].momentum == 91.7
    # 50 + 10 + 25 - 10 - 20 = 55; momentum adds -20 * 0.6
    assert out["WILD"].balanced == 55.0 and out["WILD"].momentum == 43.0
    er = spark.createDataFrame([("CALM", 12.5)], "symbol string, er double")
    j = s.join(er, "symbol")
    assert j.select(snp.risk_level(F.col("volatility"), F.col("rsi_state"), F.col("trend"),
                                   F.col("er")).alias("r")).first().r == "MEDIUM"


def test_intent_order_price_is_pricing(spark):
    m = spark.createDataFrame([("What is the price of a model forecast?",), ("show the RSI",),
                               ("recommend a watchlist",)], "message string")
    got = [r.intent for r in tx.intent_route(m).collect()]
    assert got == ["forecast", "risk", "portfolio"]


def test_alert_validation_statuses_and_cap(spark):
    alerts = spark.createDataFrame([(i, 7, "A-F", 1.0, "above", "active", None) for i in range(18)],
                                   "id long, user_id long, symbol string, target_price double, direction string, "
                                   "status string, note string")
    reqs = spark.createDataFrame([
        (100, 7, "a-f", "Above", "12.3456789", "x" * 250),
        (101, 7, "n-o", "below", "5", ""),
        (102, 7, "r-f", "below", "5", None),
        (103, 8, "zz", "above", "5", None),
        (104, 8, "a-f", "sideways", "5", None),
        (105, 8, "a-f", "above", "-1", None)],
        "id long, user_id long, symbol string, direction string, target_price string, note string")
    out = {r.id: r for r in al.alert_validation(reqs, alerts, spark.createDataFrame([("A-F",), ("N-O",), ("R-F",)], "symbol string")).collect()}
    assert out[100].status == "created" and out[100].target_price == 12.345679 and len(out[100].note) == 200
    assert out[101].status == "created" and out[101].note is None
    assert out[102].status.startswith("limit of 20")
    assert out[103].status == "unknown symbol"
    assert out[104].status.startswith("unknown direction")
    assert out[105].status == "target price must be a positive number"


def test_watchlist_cap_of_thirty(spark):
    wl_rows = [(1, f"S{i}", None) for i in range(29)]
    watch = spark.createDataFrame(wl_rows, "user_id long, symbol string, added_at timestamp_ntz")
    uni = [f"S{i}" for i in range(40)]
    reqs = spark.createDataFrame(
        [(1, "S35", "add", None, 1), (1, "S36", "add", None, 2), (1, "S3", "remove", None, 3),
         (1, "S37", "add", None, 4), (1, "S37", "remove", None, 5)],
        "user_id long, symbol string, action string, ts timestamp_ntz, seq long")
    reqs = reqs.withColumn("ts", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,seq)"))
    out = {r.symbol for r in rp.watchlist_upsert(
        watch, rp.watchlist_events(watch, reqs, spark.createDataFrame([(u,) for u in uni], "symbol string"))).collect()}
    # S36 meets a full list; removing S3 later makes room for S37, which goes again
    assert "S3" not in out and "S37" not in out and "S36" not in out and "S35" in out and len(out) == 29


def test_watchlist_outcomes_equal_a_plain_fold(spark):
    """Requests in order, for users that hit the cap and users that do not."""
    import random
    rng = random.Random(3)
    watch = [(u, f"S{i}", None) for u in range(5) for i in range(u)]
    reqs = [(u, rng.choice([" s%d", "S%d"]) % rng.randint(0, 12), rng.choice(["add", "add", "remove"]), None, k)
            for k in range(300) for u in [rng.randint(0, 5)]]
    held, want = {u: {s for v, s, _ in watch if v == u} for u in range(6)}, {}
    for u, s, a, _, k in reqs:
        s, h = s.strip().upper(), held[u]
        if s == "S12":
            want[k] = "invalid"
        elif a == "add":
            want[k] = "already there" if s in h else "full" if len(h) >= 6 else "added"
            h |= {s} if want[k] == "added" else set()
        else:
            want[k] = "removed" if s in h else "not found"
            h -= {s}
    schema = "user_id long, symbol string, action string, ts timestamp_ntz, seq long"
    r = spark.createDataFrame(reqs, schema).withColumn("ts", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,seq,0,0)"))
    w = spark.createDataFrame(watch, "user_id long, symbol string, added_at timestamp_ntz")
    ev = rp.watchlist_events(w, r, spark.createDataFrame([(f"S{i}",) for i in range(12)], "symbol string"), cap=6)
    got = {x.seq: x.outcome for x in ev.collect()}
    assert got == want and set(want.values()) == {"added", "already there", "full", "removed", "not found", "invalid"}
    final = {(x.user_id, x.symbol) for x in rp.watchlist_upsert(w, ev).collect()}
    assert final == {(u, s) for u, h in held.items() for s in h}


def test_usage_quota_with_low_limit(spark):
    rows = [(1, f"2024-01-0{d} 10:00:00") for d in (1, 1, 1, 2)] + [(2, "2024-01-01 11:00:00")]
    req = spark.createDataFrame(rows, "key_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    out = {(r.key_id, str(r.day)): r for r in wl.usage_quota(req, limit=2).collect()}
    r = out[(1, "2024-01-01")]
    assert (r.requests, r.allowed, r.refused, r.over_limit) == (3, 2, 1, True)
    assert out[(2, "2024-01-01")].over_limit is False


def test_payment_rules(spark):
    def ev(i, typ, obj):
        return (i, json.dumps({"id": f"evt_{i}", "type": typ, "data": {"object": obj}}))
    rows = [
        ev(1, "checkout.session.completed", {"mode": "payment", "metadata": {"user_id": "5", "tokens": "50", "pack_id": "explorer"}}),
        ev(2, "checkout.session.completed", {"mode": "payment", "metadata": {"user_id": "0", "tokens": "50", "pack_id": "explorer"}}),
        ev(3, "checkout.session.completed", {"mode": "subscription", "metadata": {"user_id": "6", "tokens": "200", "plan_id": "pro_monthly"}}),
        ev(4, "invoice.payment_succeeded", {"billing_reason": "subscription_create", "amount_paid": 1500,
                                            "subscription": {"metadata": {"user_id": "6", "tokens": "200", "plan_id": "pro_monthly"}}}),
        ev(5, "invoice.payment_succeeded", {"billing_reason": "subscription_cycle", "amount_paid": 1499,
                                            "subscription": {"metadata": {"user_id": "6", "tokens": "200", "plan_id": "pro_monthly"}}}),
        ev(6, "charge.failed", {}),
    ]
    raw = spark.createDataFrame(rows, "event_id long, json string")
    out = {r.event_id: r for r in wl.payment_credits(wl.parse_payment_events(raw), wl.price_plans(spark)).collect()}
    assert set(out) == {"evt_1", "evt_3", "evt_5"}
    assert out["evt_1"].amount_paid == 5.99 and out["evt_3"].amount_paid == 15.0
    assert out["evt_5"].kind == "renewal" and out["evt_5"].amount_paid == 14.99


def test_repeated_lexicon_tokens_add_up(spark, sf):
    from candela.sources import tables
    h, lex = tables.headlines(spark, sf), tables.lexicon(spark)
    half = lex.withColumn("weight", F.col("weight") / 2)
    a = {r.doc_id: r.score for r in tx.headline_sentiment(h, lex).collect()}
    b = {r.doc_id: r.score for r in tx.headline_sentiment(h, half.unionAll(half)).collect()}
    assert a == b and len(a) == h.count()


def test_waiting_predictions_do_not_block_others(spark):
    """All scorable predictions of a user are scored, however many older ones still wait for a bar."""
    import datetime

    from candela.operators import scoring as sc
    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)
    rows = [(i, 1, "NEVER", "$5", day(0)) for i in range(25)] + [(100 + i, 1, "A", "$10", day(i % 3)) for i in range(25)]
    p = spark.createDataFrame(rows, "id long, user_id long, symbol string, predicted_result string, created_at timestamp_ntz")
    bars = spark.createDataFrame([("A", day(n).date(), 10.0) for n in range(40)], "symbol string, d date, close double")
    out = sc.accuracy_update(p, bars, day(60)).collect()
    assert len(out) == 25 and {r.accuracy_pct for r in out} == {100.0}
    assert sc.accuracy_update(p, bars, day(60), per_user=7).count() == 7


def test_orders_never_fill_at_a_later_close(spark):
    import datetime

    from candela.operators import ledger as lg
    d = lambda n: datetime.date(2024, 1, n)
    bars = spark.createDataFrame([("A", d(2), 10.0), ("A", d(3), 99.0)], "symbol string, d date, close double")
    orders = spark.createDataFrame([(1, "A", d(2)), (2, "A", d(3)), (3, "A", d(4)), (4, "A", d(9)), (5, "B", d(9))], "id long, symbol string, d date")
    assert {r.id: r.price for r in lg.order_pricing(orders, bars).collect()} == {1: None, 2: 10.0, 3: 99.0, 4: 99.0, 5: None}



def test_market_session_edges(spark):
    from candela.operators import cleaning as cl
    # UTC instants: Tue 2024-01-02 14:30 = 09:30 EST (open), 20:59 = 15:59 (open),
    # 21:00 = 16:00 (closed); Sat 2024-01-06 15:00 (closed); Mon 2024-07-01 13:30 = 09:30 EDT (open)
    rows = [("2024-01-02 14:30:00",), ("2024-01-02 20:59:00",), ("2024-01-02 21:00:00",),
            ("2024-01-06 15:00:00",), ("2024-07-01 13:30:00",), ("2024-07-01 13:29:00",)]
    df = spark.createDataFrame(rows, "ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    is_open, ttl = cl.market_session(F.col("ts"))
    got = [(r.o, r.t) for r in df.select(is_open.alias("o"), ttl.alias("t")).collect()]
    assert got == [(True, 3600), (True, 3600), (False, 21600), (False, 21600), (True, 3600), (False, 21600)]


def test_source_priority_falls_back(spark):
    import datetime as dt

    from candela.sources.bars import source_priority

    def feed(symbol, n, px):
        return [(symbol, dt.date(2024, 1, 1) + dt.timedelta(days=i), px, px, px, px, 1.0) for i in range(n)]
    schema = "symbol string, d date, open double, high double, low double, close double, volume double"
    s0 = spark.createDataFrame(feed("A", 60, 1.0) + feed("B", 10, 1.0), schema)   # B too short here
    s1 = spark.createDataFrame(feed("A", 80, 2.0) + feed("B", 70, 2.0), schema)
    out = source_priority([s0, s1], 51).groupBy("symbol").agg(F.max("source_rank").alias("r"),
                                                                 F.count("*").alias("n")).collect()
    got = {r.symbol: (r.r, r.n) for r in out}
    assert got == {"A": (0, 60), "B": (1, 70)}


def test_clean_bars_rules(spark):
    import datetime as dt

    from candela.operators.cleaning import clean_bars
    rows = []
    for i in range(125):
        d = dt.date(2024, 1, 1) + dt.timedelta(days=i)
        rows.append(("A", d, "1", "2", "0.5", "1.5", "100", 1))
        rows.append(("A", d, "1", "2", "0.5", "1.6", "n/a" if i == 3 else "200", 2))   # later arrival wins
    rows += [("B", dt.date(2024, 1, 1) + dt.timedelta(days=i), "1", "1", "1", "1", "1", 1) for i in range(50)]
    raw = spark.createDataFrame(rows, "Symbol string, D date, Open string, ` HIGH ` string, low string, "
                                      "Close string, Volume string, Arrival int")
    out = clean_bars(raw, "arrival", 120).collect()
    assert {r.symbol for r in out} == {"A"}             # B has fewer than 120 rows
    assert len(out) == 124                               # day 3's last arrival has no volume
    assert all(r.close == 1.6 and r.volume == 200.0 for r in out)


def test_refresh_and_freshness_reports(spark):
    import datetime as dt

    from candela.operators import cleaning as cl
    bars = spark.createDataFrame([("A", dt.date(2024, 1, 2), 1.0, 1.0, 1.0, 1.0, 1.0)],
                                 "symbol string, d date, open double, high double, low double, close double, volume double")
    uni = ["A", "X"] + [f"Y{i}" for i in range(10)]
    rep = {r.symbol: r.status for r in cl.refresh_report(spark, uni, bars, 10).collect()}
    assert rep["A"] == "refreshed" and rep["X"] == "failed" and rep["Y9"] == "skipped" and rep["Y7"] == "failed"
    loads = spark.createDataFrame([("A", dt.datetime(2024, 1, 2, 14, 0))], "symbol string, loaded_at timestamp_ntz")
    # 15:20 UTC on a Tuesday is 10:20 in New York: market open, TTL one hour
    fr = cl.freshness_report(loads, bars, dt.datetime(2024, 1, 2, 15, 20)).first()
    assert fr.age_min == 80.0 and fr.fresh is False and fr.rows == 1 and fr.last_date == "2024-01-02"
    fr2 = cl.freshness_report(loads, bars, dt.datetime(2024, 1, 2, 14, 50)).first()
    assert fr2.age_min == 50.0 and fr2.fresh is True


def test_changed_files_are_read_again(spark, tmp_path):
    from candela.sources import tables
    rows = [("A", "F", "2024-01-01 10:00:00", 1, 1, 1, 1, 10.0, 2.0)]
    ddl = ("l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz, l_orderkey long, l_linenumber int, l_partkey long, "
           "l_suppkey long, l_extendedprice double, l_quantity double")

    def write(rows):
        df = spark.createDataFrame([(*r[:2], datetime.datetime.fromisoformat(r[2]), *r[3:]) for r in rows], ddl)
        df.write.mode("overwrite").parquet(str(tmp_path / "lineitem.parquet"))

    write(rows)
    assert [r.close for r in tables.bars(spark, str(tmp_path)).collect()] == [5.0]
    assert tables.bars(spark, str(tmp_path)) is tables.bars(spark, str(tmp_path))
    write([(*rows[0][:7], 20.0, 2.0)])
    assert [r.close for r in tables.bars(spark, str(tmp_path)).collect()] == [10.0]


def _requests(spark, n, seed):
    import random
    rng = random.Random(seed)
    start = datetime.datetime(2024, 1, 1, 20)
    rows = [(rng.choice([None, 1, 1, 1, 2]), i, start + datetime.timedelta(minutes=rng.randint(0, 60 * 30))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "key_id long, id long, ts timestamp_ntz").repartition(3)


def test_verdicts_under_nested_limits_equal_a_plain_loop(spark):
    """Fixed windows, counted request by request: 4 an hour and 30 a day together; null clients are one client."""
    rows, df = _requests(spark, 400, 3)
    want, hours, days = {}, {}, {}
    for key, i, ts in sorted(rows, key=lambda r: (r[2], r[1])):
        hour, day = (key, ts.replace(minute=0)), (key, ts.date())
        hours[hour] = hours.get(hour, 0) + 1
        if hours[hour] > 4:
            want[i] = "hour"
            continue
        days[day] = days.get(day, 0) + 1
        want[i] = "admitted" if days[day] <= 30 else "day"
    got = {r.id: r.verdict for r in wl.admissions(df, (("hour", "1 hour", 4), ("day", "1 day", 30))).collect()}
    assert got == want and set(want.values()) == {"admitted", "hour", "day"}
    single = {r.id: r.verdict for r in wl.admissions(df, (("day", "1 day", 10),)).collect()}
    assert sum(v == "admitted" for v in single.values()) == sum(min(10, n) for n in _per_day(rows).values())


def _per_day(rows):
    out = {}
    for key, _, ts in rows:
        out[key, ts.date()] = out.get((key, ts.date()), 0) + 1
    return out


def test_key_events_equal_a_plain_loop(spark):
    import random
    rng = random.Random(4)
    start, rows, asked = datetime.datetime(2024, 1, 1), [], {}
    for i in range(300):
        user = rng.choice([None, 1, 2])
        if rng.random() < 0.6 or not asked.get(user):
            asked.setdefault(user, []).append(i)
            rows.append((user, i, start + datetime.timedelta(hours=i // 3), "create", i))
        else:
            rows.append((user, i, start + datetime.timedelta(hours=i // 3), "revoke", rng.choice([*asked[user], 9999])))
    rows.append((1, 999, start, "rename", 5))
    df = spark.createDataFrame(rows, "user_id long, seq long, ts timestamp_ntz, action string, key_id long").repartition(4)
    want, active = {}, {}
    for user, seq, ts, action, key in sorted(rows, key=lambda r: (r[2], r[1])):
        mine = active.setdefault(user, [])
        if action == "create":
            status = "created" if len(mine) < 5 else "limit reached"
            mine += [key] * (status == "created")
        elif action == "revoke":
            status = "revoked" if key in mine else "not found"
            if key in mine:
                mine.remove(key)
        else:
            status = "invalid"
        want[seq] = (user, status, len(mine))
    got = {r.seq: (r.user_id, r.status, r.active) for r in wl.key_events(df).collect()}
    assert got == want and {s for _, s, _ in want.values()} == {"created", "limit reached", "revoked", "not found", "invalid"}
    listed = wl.active_keys(df).collect()
    assert {u: sorted(r.key_id for r in listed if r.user_id == u and r.is_active) for u in active} == {u: sorted(k) for u, k in active.items()}
    assert sorted(r.rank for r in listed if r.user_id == 1) == list(range(1, 1 + sum(r.user_id == 1 for r in listed)))
