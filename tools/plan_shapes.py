"""Summarise the physical plan of every bench query (AQE's initial plan).

usage: python tools/plan_shapes.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def shape(df, skip_cached: bool = True) -> dict:
    plan = df._jdf.queryExecution().executedPlan().toString()
    nodes, skip_below = [], None
    for ln in plan.split("\n"):
        body = ln.lstrip(" :+-*")
        if not body:
            continue
        depth = len(ln) - len(body)
        if skip_below is not None and depth > skip_below:
            continue   # the plan that built a cached input: printed, not re-run
        skip_below = None
        name = body.split(" ")[0].split("(")[0]
        nodes.append(name)
        if name == "InMemoryTableScan" and skip_cached:
            skip_below = depth
    plan = "\n".join(ln for ln in plan.split("\n"))
    count = lambda name: sum(1 for n in nodes if n == name)
    pushed = re.findall(r"PushedFilters: \[([^\]]*)\]", plan)
    return {"exchange": count("Exchange"), "sort": count("Sort"), "window": count("Window"),
            "bhj": count("BroadcastHashJoin"), "smj": count("SortMergeJoin"),
            "pushed": "; ".join(p for p in pushed if p)[:80]}


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    import bench
    from candela.plans import registry
    from candela.session import get_session
    spark = get_session()
    registry.load_all()
    print("# Plan shapes of the bench queries\n")
    print(f"Physical plans at {sf_dir} (before AQE re-planning). Persisted inputs (bars, the processed")
    print("feature frame) count as one in-memory scan in the query rows. The (build) rows show the")
    print("plans that make them: the lineitem aggregate, and the feature windows with row numbering")
    print("(the reference trim adds one count and a semi join on the persisted complete rows).")
    print("Queries that write checkpoints on their way (ledger, correlation, order statistics, streams) show what follows the last one. Generated by `tools/plan_shapes.py`.\n")
    print("| query | exchanges | sorts | windows | broadcast joins | sort-merge joins | pushed filters |")
    print("|---|---|---|---|---|---|---|")
    from candela.operators import indicators
    from candela.sources import tables
    # each shape is taken before the next input is cached (a cached plan
    # replaces any identical plan that is analysed after it)
    builds = [
        ("(build) bars from lineitem", lambda: tables.bars_feed(spark, sf_dir)),
        ("(build) feature windows on bars", lambda: indicators.feature_matrix(tables.bars(spark, sf_dir), trim="none")),
    ]
    for k, make in builds:
        s = shape(make(), skip_cached=False)
        print(f"| {k} | {s['exchange']} | {s['sort']} | {s['window']} | {s['bhj']} | {s['smj']} | {s['pushed'] or '-'} |")
    for k in bench.HEADLINE:
        s = shape(registry.QUERIES[k](spark, sf_dir))
        print(f"| {k} | {s['exchange']} | {s['sort']} | {s['window']} | {s['bhj']} | {s['smj']} | {s['pushed'] or '-'} |")


if __name__ == "__main__":
    main()
