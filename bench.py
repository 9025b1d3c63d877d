"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full (``noop`` sink, every row computed) and timed;
one JSON line is printed:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}
Queries share one session but no data: whatever an earlier query persisted is
released before the next one is timed, so every figure holds the full work of
its query (for most of them the lineitem aggregate and the feature windows).
"shared" times those two builds by themselves; they are not part of the sum.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "bars_from_trades",      # lineitem scan + partial aggregate (grows with sf)
    "feature_matrix",        # 52 indicators, one window exchange
    "technical_snapshot",
    "screener",
    "backtest_sweep",        # 16 parameter sets x all symbols
    "correlation_matrix",
    "alert_check",
    "accuracy_update",       # forward as-of join
    "ledger_apply",          # rounds of bounded blocks of orders
    "wallet_balance",        # two-level prefix scan
    "payment_events",        # JSON build + parse
    "headline_sentiment",    # whole-document lexicon scoring
    "user_history",          # grouped top-k
    "robust_scale",          # exact order statistics per symbol and feature
    "forecast_ridge",        # Gram sums and one solve per symbol
    "forecast_rolling",      # 14 steps of an incremental indicator state
    "sequence_windows",
    "source_priority",
    "nb_text_class",         # grouped token counts, all documents scored
    "payment_stream",        # Structured Streaming with keyed state
    "forecast_forest",       # 100 trees per symbol
    "order_pricing_intraday",  # as-of join in time buckets
    "rate_limit_verdicts",   # nested limits, a verdict per request
    "stream_bars",           # bars revised by late trades
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from candela.session import get_session
    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    from candela.plans import registry
    from candela.sources import tables
    registry.load_all()
    # JIT warm-up on a generated range (no query input is touched)
    spark.range(200_000).selectExpr("sum(id)", "max(id % 7)").collect()
    times: dict[str, float] = {}
    for k in HEADLINE:
        if k not in registry.QUERIES:
            continue
        tables.forget(spark)
        t0 = time.time()
        registry.QUERIES[k](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[k] = round(time.time() - t0, 3)
    tables.forget(spark)
    shared: dict[str, float] = {}
    for name, build in (("bars", tables.bars), ("features", tables.processed)):
        t0 = time.time()
        build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        shared[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "shared": shared, "sf": float(m.group(1)) if m else sf_dir}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
