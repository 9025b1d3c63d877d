"""Series layout, EWM without UDF, prefix scans and as-of joins against
brute force on small fixtures."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candela.functions import windows as W


def _series(spark, n, symbols=("X", "Y"), seed=7):
    rng = np.random.default_rng(seed)
    rows = []
    for s in symbols:
        px = 100.0
        for i in range(n):
            px *= math.exp(rng.normal(0, 0.02))
            rows.append((s, pd.Timestamp("2000-01-01") + pd.Timedelta(days=i), px))
    pdf = pd.DataFrame(rows, columns=["symbol", "d", "close"])
    pdf["d"] = pdf["d"].dt.date
    return spark.createDataFrame(pdf), pdf


def test_positions_are_row_numbers(spark):
    df, pdf = _series(spark, 900)
    got = W.with_position(df, order=["d"], bucket_days=30).toPandas().sort_values(["symbol", "d"])
    exp = pdf.sort_values(["symbol", "d"]).groupby("symbol").cumcount()
    assert (got["pos"].to_numpy() == exp.to_numpy()).all()
    assert set(got["n"]) == {900}


def test_ewm_matches_pandas_across_blocks_and_halo(spark):
    # 3000 rows: several EWM blocks; small parts force halo copies
    df, pdf = _series(spark, 3000, symbols=("X",))
    blocks = W.series_blocks(W.with_position(df, order=["d"]), part_rows=1 << 12, halo=W.HALO_ROWS)
    small = W.series_blocks(W.with_position(df, order=["d"]), part_rows=1 << 11, halo=W.HALO_ROWS // 2)
    for frame in (blocks, small):
        out = W.own_rows(W.ewm_columns(frame, {"e12": ("close", 12), "e26": ("close", 26)}))
        got = out.toPandas().sort_values("d")
        for span, col in ((12, "e12"), (26, "e26")):
            exp = pdf.sort_values("d")["close"].ewm(span=span, adjust=False).mean().to_numpy()
            assert np.max(np.abs(got[col].to_numpy() / exp - 1)) < 1e-12


def test_rolling_frames_same_with_and_without_split(spark):
    from candela.operators import indicators as ind
    df, _ = _series(spark, 2600, symbols=("X",))
    bars = df.withColumns({"open": F.col("close"), "high": F.col("close") * 1.01,
                           "low": F.col("close") * 0.99, "volume": F.lit(1000.0)})
    cols = ["rsi_14", "dist_52w_high", "vol_20d", "cci", "macd_sig", "target_lr"]
    whole = ind.finish(ind.compute_features(ind.prepare(bars)), cols).toPandas().sort_values("d")
    split = W.series_blocks(W.with_position(bars, order=["d"]), part_rows=1 << 11, halo=W.HALO_ROWS // 2)
    parts = ind.finish(ind.compute_features(split), cols).toPandas().sort_values("d")
    assert len(parts) == len(whole) == 2600
    for c in cols:
        a, b = whole[c].to_numpy(), parts[c].to_numpy()
        ok = (np.isnan(a) & np.isnan(b)) | (np.abs(a - b) <= 1e-9 * np.maximum(1, np.abs(a)))
        assert ok.all(), c


def test_prefix_sum_min_matches_loop(spark):
    rng = np.random.default_rng(3)
    rows = [(int(u), (pd.Timestamp("2024-01-01") + pd.Timedelta(hours=int(h))).to_pydatetime(), i, float(x))
            for i, (u, h, x) in enumerate(zip(rng.integers(0, 3, 400), rng.integers(0, 2000, 400),
                                              rng.choice([-1.0, 3.0, -1.0, -1.0], 400)))]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, id long, x double")
    got = W.prefix_sum_min(df, "user_id", ["ts", "id"], "x", init=5.0, time_col="ts", bucket_days=3).toPandas()
    for u, g in got.groupby("user_id"):
        g = g.sort_values(["ts", "id"])
        s = 5.0 + g["x"].cumsum()
        assert np.allclose(g["_S"], s)
        assert np.allclose(g["_min_incl"], s.cummin())


def test_asof_daily_matches_merge_asof(spark):
    bars = pd.DataFrame({"symbol": ["A"] * 5, "d": pd.to_datetime(
        ["2024-01-02", "2024-01-03", "2024-01-05", "2024-01-08", "2024-01-09"]).date,
        "close": [1.0, 2.0, 3.0, 4.0, 5.0]})
    left = pd.DataFrame({"symbol": ["A"] * 6, "k": range(6), "d": pd.to_datetime(
        ["2024-01-01", "2024-01-03", "2024-01-04", "2024-01-06", "2024-01-09", "2024-01-12"]).date})
    b, lft = spark.createDataFrame(bars), spark.createDataFrame(left)
    for direction in ("backward", "forward"):
        got = W.asof_join_daily(lft, b, "d", ["close"], direction=direction).toPandas().sort_values("k")
        exp = pd.merge_asof(left.assign(t=pd.to_datetime(left.d)).sort_values("t"),
                            bars.assign(t=pd.to_datetime(bars.d))[["t", "close"]], on="t", direction=direction)
        assert got["close"].fillna(-1).tolist() == exp.sort_values("k")["close"].fillna(-1).tolist()


@pytest.mark.parametrize("seconds", [600, 86400, 10 ** 9])
def test_general_asof_matches_merge_asof(spark, seconds):
    """One hot symbol, ties and gaps of many empty buckets; buckets of any size give what merge_asof gives."""
    rng = np.random.default_rng(9)
    at = lambda n, most: pd.to_datetime("2024-01-01") + pd.to_timedelta(np.sort(rng.integers(0, most, n)), "min")
    right = pd.concat([pd.DataFrame({"symbol": s, "t": at(n, 10_000), "px": rng.uniform(1, 2, n)}) for s, n in (("A", 90), ("B", 5))])
    right = right.sort_values(["t", "symbol", "px"]).reset_index(drop=True)
    left = pd.concat([pd.DataFrame({"symbol": s, "t": at(n, 12_000)}) for s, n in (("A", 120), ("B", 20), ("C", 3))])
    left = left.sort_values("t").reset_index(drop=True).assign(k=lambda x: range(len(x)))
    r = spark.createDataFrame(right).withColumn("t", F.col("t").cast("timestamp_ntz"))
    lf = spark.createDataFrame(left).withColumn("t", F.col("t").cast("timestamp_ntz"))
    nulls = spark.createDataFrame([(None, None, -1), ("A", None, -2)], "symbol string, t timestamp_ntz, k long")
    for direction in ("backward", "forward"):
        got = W.asof_join(lf.unionByName(nulls), r.withColumnRenamed("t", "rt"), "symbol", "t", "rt", ["px"], direction=direction,
                          bucket_seconds=seconds).toPandas().sort_values("k")
        exp = pd.merge_asof(left, right, on="t", by="symbol", direction=direction).sort_values("k")
        assert got["px"].iloc[:2].isna().all() and len(got) == len(left) + 2
        assert np.allclose(got["px"].iloc[2:].fillna(-1).to_numpy(), exp["px"].fillna(-1).to_numpy())


def test_correlation_by_date_pairs_common_days(spark):
    from candela.operators import correlation as cor
    rows = [("A", k, pd.Timestamp("2024-01-01") + pd.Timedelta(days=i), float(x))
            for k, (i, x) in enumerate([(0, 0.01), (1, -0.02), (2, 0.03), (3, 0.01)])]
    rows += [("B", k, pd.Timestamp("2024-01-01") + pd.Timedelta(days=i), float(x))
             for k, (i, x) in enumerate([(1, -0.01), (2, 0.02), (3, 0.0), (4, 0.05)])]
    rets = spark.createDataFrame([(s, k, t.date(), x) for s, k, t, x in rows], "symbol string, k long, d date, lr double")
    m = {(r.a, r.b): r.r for r in cor.correlation_matrix(rets, ["A", "B"], align="date").collect()}
    a, b = np.array([-0.02, 0.03, 0.01]), np.array([-0.01, 0.02, 0.0])
    assert abs(m[("A", "B")] - round(float(np.corrcoef(a, b)[0, 1]), 4)) < 1e-9


@pytest.mark.parametrize("align", ["position", "date"])
def test_correlation_tiles_of_any_size_equal_numpy(spark, align):
    from candela.operators import correlation as cor
    rng = np.random.default_rng(4)
    day = lambda k: (pd.Timestamp("2024-06-01") - pd.Timedelta(days=k)).date()
    x = {f"S{i:02d}": rng.normal(0, 1, int(rng.integers(20, 40))) for i in range(17)} | {"FLAT": np.zeros(30)}
    skip = {s: int(rng.integers(0, 6)) for s in x}
    rows = [(s, k, day(k + skip[s]), float(v)) for s, values in x.items() for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, "symbol string, k long, d date, lr double")
    least, names = min(map(len, x.values())), sorted(x)
    want = {}
    for a in names:
        for b in names:
            if align == "position":
                u, v = x[a][:least], x[b][:least]
            else:
                days = [(k + skip[a] - skip[b], k) for k in range(len(x[a])) if 0 <= k + skip[a] - skip[b] < len(x[b])]
                u, v = np.array([x[a][k] for _, k in days]), np.array([x[b][k] for k, _ in days])
            if "FLAT" not in (a, b):
                want[a, b] = float(np.corrcoef(u, v)[0, 1])
    for block in (1, 5, 256):
        got = {(r.a, r.b): r for r in cor.correlation_matrix(df, align=align, block=block).collect()}
        assert set(got) == set(want) and all(abs(got[k].r - want[k]) < 6e-5 for k in want)
        assert all((names[r.ia - 1], names[r.ib - 1]) == k for k, r in got.items())


def test_forecast_windows_on_tiny_blocks_equal_whole_series(spark):
    """One symbol holds 90 % of the rows; blocks of 20 rows give what one block gives."""
    import datetime

    from candela.operators import forecast as fc
    day = lambda n: datetime.date(2020, 1, 1) + datetime.timedelta(days=n)
    rows = [(s, day(i), i, "test" if i % 500 > 30 else "train", float(i * 7 % 13), float(i), 0.01 * (i % 5), 0.001 * i)
            for s, n in (("HOT", 180), ("A", 12), ("B", 8)) for i in range(n)]
    df = spark.createDataFrame(rows, "symbol string, d date, pos long, split string, x double, close double, prediction double, target_lr double")
    for run in (lambda k: fc.holdout_eval(df, k), lambda k: fc.sequence_windows(df, ["x", "close"], 15, k)):
        tiny, whole = (sorted(map(str, run(k).collect())) for k in (20, 1 << 20))
        assert tiny == whole and len(whole) > 100
