"""Reusable DuckDB SQL fragments for the oracle queries.

The oracle is written independently of the Spark code: plain per-symbol
window SQL (``ROWS BETWEEN``), a recursive CTE for the exponential means and
list lambdas for CCI. Fragments are CTE bodies joined by ``with_ctes``.
"""

from __future__ import annotations

BARS_SQL = """
SELECT l_returnflag || '-' || l_linestatus AS symbol,
       CAST(l_shipdate AS DATE) AS d,
       first(l_extendedprice / nullif(l_quantity, 0) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS open,
       max(l_extendedprice / nullif(l_quantity, 0)) AS high,
       min(l_extendedprice / nullif(l_quantity, 0)) AS low,
       last(l_extendedprice / nullif(l_quantity, 0) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS close,
       CAST(sum(l_quantity) AS DOUBLE) AS volume
FROM lineitem
GROUP BY 1, 2
"""

SYMBOL_OF = "(['A-F','A-O','N-F','N-O','R-F','R-O'])[({x} % 6) + 1]"


def symbol_of(x: str) -> str:
    return SYMBOL_OF.format(x=x)


def with_ctes(ctes: list[tuple[str, str]], final: str) -> str:
    body = ",\n".join(f"{name} AS ({sql})" for name, sql in ctes)
    return f"WITH RECURSIVE {body}\n{final}"


W = "OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN {p} PRECEDING AND CURRENT ROW)"
WS = "OVER (PARTITION BY symbol ORDER BY d)"


def roll(n: int, expr: str, agg: str) -> str:
    """pandas rolling(n).agg: null until n non-null values."""
    w = W.format(p=n - 1)
    return f"(CASE WHEN count({expr}) {w} = {n} THEN {agg}({expr}) {w} END)"


def lagx(expr: str, k: int = 1) -> str:
    return f"lag({expr}, {k}) {WS}"


def nzs(expr: str) -> str:
    return f"nullif({expr}, 0)"


def clips(expr: str, lo=None, hi=None) -> str:
    out = expr
    if lo is not None:
        out = f"greatest({out}, {lo})"
    if hi is not None:
        out = f"least({out}, {hi})"
    return f"(CASE WHEN ({expr}) IS NULL THEN NULL ELSE {out} END)"


# Step 1: base series with position; step 2: first-level columns; step 3:
# exponential means by recursion; step 4: second-level; step 5: all features.
F1 = f"""
SELECT *,
  ln(close / {nzs(lagx('close'))}) AS lr,
  close - {lagx('close')} AS dd,
  {lagx('close')} AS pc,
  high - {lagx('high')} AS dh,
  -(low - {lagx('low')}) AS dl,
  (high + low + close) / 3.0 AS tp
FROM s0
"""

F2 = f"""
SELECT *,
  CASE WHEN dd > 0 THEN dd ELSE 0.0 END AS gain,
  CASE WHEN dd < 0 THEN -dd ELSE 0.0 END AS loss,
  greatest(high - low, coalesce(abs(high - pc), high - low), coalesce(abs(low - pc), high - low)) AS tr,
  CASE WHEN dh IS NULL THEN NULL ELSE greatest(dh, 0.0) END AS pdm,
  CASE WHEN dl IS NULL THEN NULL ELSE greatest(dl, 0.0) END AS mdm
FROM f1
"""

EWM_REC = """
SELECT symbol, pos, close AS e12, close AS e26, close AS e9, close AS e21,
       0.0::DOUBLE AS macd, 0.0::DOUBLE AS sig
FROM s0 WHERE pos = 0
UNION ALL
SELECT s.symbol, s.pos,
  (2.0/13) * s.close + (1 - 2.0/13) * r.e12,
  (2.0/27) * s.close + (1 - 2.0/27) * r.e26,
  (2.0/10) * s.close + (1 - 2.0/10) * r.e9,
  (2.0/22) * s.close + (1 - 2.0/22) * r.e21,
  (((2.0/13) * s.close + (1 - 2.0/13) * r.e12) - ((2.0/27) * s.close + (1 - 2.0/27) * r.e26)) / nullif(s.close, 0),
  (2.0/10) * ((((2.0/13) * s.close + (1 - 2.0/13) * r.e12) - ((2.0/27) * s.close + (1 - 2.0/27) * r.e26)) / nullif(s.close, 0))
    + (1 - 2.0/10) * r.sig
FROM ewm r JOIN s0 s ON s.symbol = r.symbol AND s.pos = r.pos + 1
"""

F3 = f"""
SELECT f2.*, e.e12, e.e26, e.e9, e.e21, e.macd, e.sig,
  {roll(20, 'close', 'avg')} AS s20,
  {roll(20, 'close', 'stddev_samp')} AS sd20,
  {roll(50, 'close', 'avg')} AS s50,
  {roll(14, 'tr', 'avg')} AS atr14,
  {roll(14, 'low', 'min')} AS ll14,
  {roll(14, 'high', 'max')} AS hh14,
  {roll(20, 'tp', 'avg')} AS tp_ma,
  list(tp) {W.format(p=19)} AS tp_l,
  {roll(14, 'volume', 'avg')} AS vsma,
  {roll(50, 'volume', 'avg')} AS v50,
  {roll(14, 'pdm', 'avg')} AS pdm14,
  {roll(14, 'mdm', 'avg')} AS mdm14
FROM f2 JOIN ewm e USING (symbol, pos)
"""


def _rsi(p: int) -> str:
    g, l_ = roll(p, "gain", "avg"), roll(p, "loss", "avg")
    return f"coalesce(100 - 100 / (1 + {g} / nullif({l_}, 0)), 50.0)"


F4 = f"""
SELECT *,
  {_rsi(7)} AS rsi_7, {_rsi(14)} AS rsi_14, {_rsi(21)} AS rsi_21,
  coalesce(100 * (close - ll14) / nullif(hh14 - ll14, 0), 50.0) AS stoch_k,
  CASE WHEN len(tp_l) = 20 THEN list_sum(list_transform(tp_l, lambda x: abs(x - tp_ma))) / 20 END AS tp_md
FROM f3
"""

FEATURE_EXPRS = {
    "lr_1": "lr",
    "lr_2": lagx("lr", 1),
    "lr_3": lagx("lr", 2),
    "lr_5": f"ln(close / nullif({lagx('close', 5)}, 0)) / 5",
    "lr_10": f"ln(close / nullif({lagx('close', 10)}, 0)) / 10",
    "lr_20": f"ln(close / nullif({lagx('close', 20)}, 0)) / 20",
    "rsi_7": "rsi_7", "rsi_14": "rsi_14", "rsi_21": "rsi_21",
    "rsi_diff": "rsi_14 - rsi_7",
    "rsi_mom": f"rsi_14 - {lagx('rsi_14', 5)}",
    "macd": "macd", "macd_sig": "sig", "macd_hist": "macd - sig",
    "macd_mom": f"macd - {lagx('macd', 3)}",
    "bb_pct": clips("(close - (s20 - 2*sd20)) / nullif(4*sd20, 0)", 0.0, 1.0),
    "bb_width": "(4*sd20) / nullif(s20, 0)",
    "dist_sma5": f"(close - {roll(5, 'close', 'avg')}) / nullif({roll(5, 'close', 'avg')}, 0)",
    "dist_sma10": f"(close - {roll(10, 'close', 'avg')}) / nullif({roll(10, 'close', 'avg')}, 0)",
    "dist_sma20": "(close - s20) / nullif(s20, 0)",
    "dist_sma50": "(close - s50) / nullif(s50, 0)",
    "dist_sma100": f"(close - {roll(100, 'close', 'avg')}) / nullif({roll(100, 'close', 'avg')}, 0)",
    "dist_ema9": "(close - e9) / nullif(e9, 0)",
    "dist_ema21": "(close - e21) / nullif(e21, 0)",
    "vol_5d": roll(5, "lr", "stddev_samp"),
    "vol_10d": roll(10, "lr", "stddev_samp"),
    "vol_20d": roll(20, "lr", "stddev_samp"),
    "rvol_20": f"{roll(20, 'lr', 'stddev_samp')} * sqrt(252)",
    "vol_ratio": f"{roll(10, 'lr', 'stddev_samp')} / nullif({roll(20, 'lr', 'stddev_samp')}, 0)",
    "atr_pct": "atr14 / nullif(close, 0)",
    "atr_trend": f"atr14 / nullif({roll(14, 'atr14', 'avg')}, 0)",
    "stoch_k": "stoch_k",
    "stoch_d": roll(3, "stoch_k", "avg"),
    "stoch_diff": f"stoch_k - {roll(3, 'stoch_k', 'avg')}",
    "willr": "coalesce(-100 * (hh14 - close) / nullif(hh14 - ll14, 0), -50.0)",
    "cci": "coalesce(" + clips("(tp - tp_ma) / (0.015 * nullif(tp_md, 0))", -300.0, 300.0) + ", 0.0)",
    "adx_plus": "coalesce(100 * pdm14 / nullif(atr14, 0), 0.0)",
    "adx_minus": "coalesce(100 * mdm14 / nullif(atr14, 0), 0.0)",
    "adx_diff": "coalesce(100 * pdm14 / nullif(atr14, 0), 0.0) - coalesce(100 * mdm14 / nullif(atr14, 0), 0.0)",
    "roc_3": f"(close / nullif({lagx('close', 3)}, 0) - 1) * 100",
    "roc_5": f"(close / nullif({lagx('close', 5)}, 0) - 1) * 100",
    "roc_10": f"(close / nullif({lagx('close', 10)}, 0) - 1) * 100",
    "roc_20": f"(close / nullif({lagx('close', 20)}, 0) - 1) * 100",
    "v_ratio": clips("volume / nullif(vsma, 0)", 0.0, 10.0),
    "v_trend": clips("vsma / nullif(v50, 0)", 0.0, 5.0),
    "pv_corr": clips("lr * (volume / nullif(vsma, 0))", -5.0, 5.0),
    "hl_pct": "(high - low) / nullif(close, 0)",
    "open_close": "(close - open) / nullif(close, 0)",
    "dist_52w_high": f"(close - {roll(252, 'close', 'max')}) / nullif(close, 0)",
    "dist_52w_low": f"(close - {roll(252, 'close', 'min')}) / nullif(close, 0)",
    "sma20_slope": f"(s20 - {lagx('s20', 5)}) / nullif({lagx('s20', 5)}, 0)",
    "sma50_slope": f"(s50 - {lagx('s50', 5)}) / nullif({lagx('s50', 5)}, 0)",
    "target_lr": f"lead(lr, 1) {WS}",
    "ewm_12": "e12", "ewm_26": "e26",
}


def feature_ctes(bars_source: str = BARS_SQL, where: str = "") -> list[tuple[str, str]]:
    """CTEs: bars, s0 (with pos), f1..f4, ewm (recursive), feat (all columns)."""
    cols = ",\n  ".join(f"{e} AS {k}" for k, e in FEATURE_EXPRS.items())
    return [
        ("bars", bars_source),
        ("s0", f"SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY d) - 1 AS pos FROM bars {where}"),
        ("ewm", EWM_REC),
        ("f1", F1), ("f2", F2), ("f3", F3), ("f4", F4),
        ("feat", f"SELECT symbol, d, pos, open, high, low, close, volume,\n  {cols}\nFROM f4"),
    ]


FEATURE_NAMES = [k for k in FEATURE_EXPRS if k not in ("target_lr", "ewm_12", "ewm_26")]


def trimmed_ctes(min_rows: int = 120, min_left: int = 60) -> list[tuple[str, str]]:
    """Features with the reference trim: >= min_rows bars per symbol, complete
    rows only, >= min_left rows left. Adds CTE ``ft``."""
    bars_ok = (f"SELECT * FROM ({BARS_SQL}) b WHERE open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL "
               f"AND close IS NOT NULL AND volume IS NOT NULL AND symbol IN (SELECT symbol FROM ({BARS_SQL}) x "
               f"WHERE open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL "
               f"AND volume IS NOT NULL GROUP BY symbol HAVING count(*) >= {min_rows})")
    ctes = feature_ctes(bars_ok)
    notnull = " AND ".join(f"{k} IS NOT NULL" for k in FEATURE_NAMES + ["target_lr"])
    ctes.append(("ft0", f"SELECT * FROM feat WHERE {notnull}"))
    ctes.append(("ft", f"SELECT * FROM ft0 WHERE symbol IN (SELECT symbol FROM ft0 GROUP BY symbol HAVING count(*) >= {min_left})"))
    return ctes


def prefixed_feature_ctes(bars_source: str, prefix: str) -> list[tuple[str, str]]:
    """``feature_ctes`` with every CTE renamed ``<prefix><name>`` so the
    feature SQL can run a second time in one query (e.g. on a short window)."""
    import re
    names = ["bars", "s0", "ewm", "f1", "f2", "f3", "f4", "feat"]
    pat = re.compile(r"\b(" + "|".join(names) + r")\b")
    out = []
    for name, body in feature_ctes(bars_source):
        if name == "bars":
            out.append((prefix + name, body))
            continue
        out.append((prefix + name, pat.sub(lambda m: prefix + m.group(1), body)))
    return out
