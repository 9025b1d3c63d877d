"""Steps that must grow no faster than their input: what is shuffled, sorted and read again."""

import datetime as dt
import random

from pyspark.sql import functions as F

from candela.operators import analyst as an
from candela.operators import snapshot as snp
from candela.operators import text as tx
from candela.sources import bars as br

LETTERS = "abcdefghijklmnop"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _docs(spark, n=60, seed=5):
    r = random.Random(seed)
    words = [a + b for a in LETTERS for b in LETTERS]
    rows = [(i % 50, " ".join(r.choice(words[: 20 if r.random() < 0.7 else 256]) for _ in range(r.randint(0, 40))), i % 3 % 2)
            for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, quality int")


def test_naive_bayes_common_and_rare_tokens(spark, monkeypatch):
    """Common tokens are summed before any shuffle; with a small table of common tokens the results are the same."""
    lab, docs = _docs(spark), _docs(spark, 80, 7).drop("quality")
    whole = an.nb_text_class(lab, score=docs)
    assert "hashpartitioning(doc_id" in _plan(whole) and "token" not in "".join(
        x for x in _plan(whole).splitlines() if "Exchange hashpartitioning" in x)
    want = sorted(map(tuple, whole.collect()))
    monkeypatch.setattr(tx, "BROADCAST_TOKENS", 7)
    got = sorted(map(tuple, an.nb_text_class(lab, score=docs).collect()))
    assert len(got) == 80 and [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(g[2] - w[2]) < 1e-9 for g, w in zip(got, want))


def test_logreg_splits_labelled_texts_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def look(text):
        seen.add(1)
        return text
    lab = _docs(spark).filter(F.length("text") > 0)
    n = lab.count()
    watched = lab.withColumn("text", F.udf(look, "string").asNondeterministic()("text"))
    out = an.tfidf_logreg(watched, num_features=1 << 8, max_iter=5, score=lab.select("doc_id", "text"))
    assert seen.value == n
    assert out.count() == n and out.columns == ["doc_id", "prediction", "p_positive"]


def test_portfolio_insight_moves_each_item_once(spark, monkeypatch):
    r = random.Random(3)
    t0 = dt.datetime(2024, 1, 1)
    snap = [(f"S{k}", r.choice([10.0, 0.0, -5.0]), 60.0, r.choice(["neutral", "overbought"]), r.choice(["bullish", "mixed"]),
             r.choice([20.0, 60.0]), 1.0) for k in range(8)]
    watch = [(u, f"S{k}", t0 + dt.timedelta(days=r.randint(0, 2))) for u in [None, *range(30)] for k in r.sample(range(10), r.randint(1, 9))]
    s = spark.createDataFrame(snap, "symbol string, change_20d double, rsi double, rsi_state string, trend string, volatility double, change_60d double")
    w = spark.createDataFrame(watch, "user_id long, symbol string, added_at timestamp_ntz")
    out = snp.portfolio_insight(w, s)
    assert "hashpartitioning(symbol" not in _plan(out)
    got = {x.user_id: x for x in out.collect()}
    info = {x.symbol: x for x in s.select("*", snp.snapshot_score().alias("score"), snp.snapshot_risk(s).alias("risk")).collect()}
    for u in {x[0] for x in watch}:
        held = [(info[k], t) for v, k, t in watch if v == u and k in info]
        if not held:
            assert u not in got
            continue
        rank = sorted(held, key=lambda h: (-h[0].score, -h[1].timestamp(), h[0].symbol))
        risky = min(held, key=lambda h: (-h[0].volatility, -abs(h[0].change_20d), -h[1].timestamp(), h[0].symbol))[0]
        x = got[u]
        assert x.ranked_items == ",".join(h[0].symbol for h in rank) and x.n_items == len(held)
        assert (x.best_symbol, x.best_score) == (rank[0][0].symbol, rank[0][0].score)
        assert (x.riskiest_symbol, x.riskiest_volatility) == (risky.symbol, risky.volatility)
        assert x.bullish_count == sum(h[0].trend == "bullish" for h in held)
        assert x.high_risk_count == sum(h[0].risk == "HIGH" for h in held)
    monkeypatch.setattr(snp, "BROADCAST_SYMBOLS", 0)
    assert sorted(map(str, snp.portfolio_insight(w, s).collect())) == sorted(map(str, got.values()))


def test_bars_compare_whole_keys_of_few_trades(spark, monkeypatch):
    """Ties and nulls in the first order column, null symbols, prices and times; with and without a broadcast."""
    r = random.Random(11)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(r.choice(["A", "B", None]), r.choice([None, t0, t0 + dt.timedelta(days=1, hours=3)]), r.choice([None, 1.5, 2.0, 7.25]),
             float(r.randint(1, 5)), r.choice([None, 1, 2, 3, 4]) if i % 2 else r.randint(5, 9), i) for i in range(400)]
    rows += [("C", t0, 3.0, 1.0, k, k) for k in (4, 4, 6)]
    tr = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, px double, size double, k long, line long")
    want = {}
    for s, t, px, size, k, line in rows:
        want.setdefault((s, t and t.date()), []).append(((k is not None, k or 0), line, px, size))
    bars = br.bars_from_trades(tr, ["k", "line"])
    assert "Join" in _plan(bars)
    for limit in (br.BROADCAST_BARS, 0):
        monkeypatch.setattr(br, "BROADCAST_BARS", limit)
        got = {(x.symbol, x.d): x for x in br.bars_from_trades(tr, ["k", "line"]).collect()}
        assert got.keys() == want.keys()
        for key, trades in want.items():
            first, last = min(trades, key=lambda x: x[:2]), max(trades, key=lambda x: x[:2])
            px = [x[2] for x in trades if x[2] is not None]
            assert tuple(got[key])[2:] == (first[2], max(px), min(px), last[2], sum(x[3] for x in trades))
