"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

usage: python tools/check_oracles.py [sf_dir] [key-substring ...]
Compares row count, column names and an order-insensitive hash of values
(doubles rounded to 6 dp), like the driver's correctness gate.
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402


def norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "∅"
        s = f"{v:.6f}"
        return "0.000000" if s == "-0.000000" else s
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    try:
        import numpy as np
        if isinstance(v, np.ndarray):
            return "[" + ",".join(norm(x) for x in v.tolist()) + "]"
        if isinstance(v, np.generic):
            return norm(v.item())
    except Exception:
        pass
    return str(v)


def digest(df):
    """df: a pyarrow Table (exact types, nulls kept)."""
    cols = sorted(df.column_names)
    recs = df.to_pylist()
    rows = sorted("|".join(norm(r[c]) for c in cols) for r in recs)
    return hashlib.sha1("\n".join(rows).encode()).hexdigest(), rows


def main():
    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf_dir = args.pop(0)
    from candela.session import get_session
    from candela.plans import registry
    registry.load_all()
    spark = get_session()
    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents "
              "embeddings pages benchmark labels conversations").split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    keys = [k for k in registry.QUERIES if not args or any(a in k for a in args)]
    bad = 0
    for k in keys:
        t0 = time.time()
        try:
            sdf = registry.QUERIES[k](spark, sf_dir).toArrow()
        except Exception as e:  # noqa: BLE001
            print(f"{k:28s} SPARK ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        t1 = time.time()
        sql = registry.ORACLES.get(k)
        if sql is None:
            print(f"{k:28s} rows={sdf.num_rows:6d} (no oracle) spark={t1-t0:.1f}s")
            continue
        try:
            odf = con.execute(sql).to_arrow_table()
            if hasattr(odf, "read_all"):
                odf = odf.read_all()
        except Exception as e:  # noqa: BLE001
            print(f"{k:28s} DUCKDB ERROR {str(e)[:300]}")
            bad += 1
            continue
        t2 = time.time()
        same_cols = sorted(sdf.column_names) == sorted(odf.column_names)
        hs, rs = digest(sdf) if same_cols else ("", [])
        ho, ro = digest(odf) if same_cols else ("", [])
        ok = same_cols and sdf.num_rows == odf.num_rows and hs == ho
        print(f"{k:28s} {'OK ' if ok else 'BAD'} rows={sdf.num_rows}/{odf.num_rows} spark={t1-t0:.1f}s duck={t2-t1:.1f}s")
        if not ok:
            bad += 1
            if not same_cols:
                print("   spark cols:", sorted(sdf.column_names))
                print("   duck  cols:", sorted(odf.column_names))
            else:
                a, b = set(rs), set(ro)
                for r in sorted(a - b)[:3]:
                    print("   spark-only:", r[:400])
                for r in sorted(b - a)[:3]:
                    print("   duck-only: ", r[:400])
    print(f"done: {len(keys)} keys, {bad} bad")


if __name__ == "__main__":
    main()
