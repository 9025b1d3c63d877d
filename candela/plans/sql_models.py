"""DuckDB SQL of the forecast models: ridge by its normal equations, and the roll-forward on shortcut features.

Independent of the Spark code: the normal equations are solved by Gauss-Jordan steps in a
recursive CTE, the roll-forward appends to lists in another.
"""

from __future__ import annotations


def ridge_ctes(cols: list[str], alpha: float = 2.0) -> list[tuple[str, str]]:
    """``ridge`` (symbol, coef, intercept) from ``scaled``."""
    k = len(cols)
    row = lambda i: "[" + ", ".join([f"covar_pop({cols[i]}, {c}) * count(*)" + (f" + {alpha}" if i == j else "")
                                     for j, c in enumerate(cols)] + [f"covar_pop({cols[i]}, target_lr) * count(*)"]) + "]"
    return [
        ("rsys", f"""SELECT symbol, [{', '.join(map(row, range(k)))}] AS a, [{', '.join(f'avg({c})' for c in cols)}] AS mx, avg(target_lr) AS my
            FROM scaled WHERE split = 'train' GROUP BY symbol"""),
        ("gauss", f"""SELECT symbol, 0 AS k, a FROM rsys UNION ALL
            SELECT symbol, k + 1, list_transform(a, lambda r, i: CASE WHEN i = k + 1 THEN list_transform(r, lambda x: x / a[k + 1][k + 1])
              ELSE list_transform(r, lambda x, j: x - r[k + 1] * a[k + 1][j] / a[k + 1][k + 1]) END) FROM gauss WHERE k < {k}"""),
        ("ridge", f"""SELECT symbol, coef, my - list_sum(list_transform(list_zip(mx, coef), lambda z: z[1] * z[2])) AS intercept
            FROM (SELECT symbol, mx, my, list_transform(g.a, lambda r: r[{k + 1}]) AS coef FROM gauss g JOIN rsys USING (symbol) WHERE k = {k})""")]


def ref_base_sql(table: str) -> str:
    """``table`` (lists p, h, l, v: closes, highs, lows, volumes of at least 56 bars) with what the shortcut features are made of."""
    recent = lambda n, x: f"list_transform(range(1, {n + 1}), lambda i: {x})"
    ewm = lambda s: f"list_reduce(p, lambda y, x: {2.0 / (s + 1)!r} * x + {1 - 2.0 / (s + 1)!r} * y)"
    step = "p[n - i + 1] - p[n - i]"
    rsi = {f"{way}{w}": f"list_avg({recent(w + 1, f'greatest({sign}({step}), 0)')})" for w in (7, 14, 21) for way, sign in (("g", ""), ("s", "-"))}
    return f"""SELECT *, {', '.join(f'{x} AS {name}' for name, x in rsi.items())},
        {', '.join(f'{ewm(s)} AS e{s}' for s in (9, 12, 21, 26))},
        {', '.join(f'list_avg(p[greatest(n - {w - 1}, 1):n]) AS m{w}' for w in (5, 10, 20, 50, 100))},
        list_aggregate(p[n - 19:n], 'stddev_pop') AS sd,
        {recent(21, 'ln(p[n - i + 1] / p[n - i])')} AS rets,
        list_avg({recent(14, 'greatest(h[n - i + 1] - l[n - i + 1], abs(h[n - i + 1] - p[n - i]), abs(l[n - i + 1] - p[n - i]))')}) AS atr,
        list_max(h[n - 13:n]) AS hh, list_min(l[n - 13:n]) AS ll, {recent(20, '(h[n - i + 1] + l[n - i + 1] + p[n - i + 1]) / 3')} AS tps,
        list_avg({recent(14, 'greatest(h[n - i + 1] - h[n - i], 0)')}) AS up, list_avg({recent(14, 'greatest(l[n - i] - l[n - i + 1], 0)')}) AS dn,
        list_avg(v[n - 13:n]) AS v14, list_avg(v[n - 49:n]) AS v50,
        list_avg(p[n - 24:n - 5]) AS o20, list_avg(p[n - 54:n - 5]) AS o50
        FROM (SELECT *, len(p) AS n, p[-1] AS c FROM {table})"""


def ref_step_sql(cols: list[str]) -> dict[str, str]:
    """Shortcut features by column, over the columns of ``ref_base_sql``."""
    div = lambda a, b, d=0.0: f"(CASE WHEN {b} = 0 THEN {d} ELSE ({a}) / ({b}) END)"
    rsi = {w: f"(CASE WHEN s{w} > 0 THEN 100 - 100 / (1 + g{w} / s{w}) ELSE 100.0 END)" for w in (7, 14, 21)}
    vol = {w: f"list_aggregate(rets[{22 - w}:21], 'stddev_pop')" for w in (5, 10, 20)}
    macd = div("e12 - e26", "c")
    tp, ma = "((h[-1] + l[-1] + c) / 3)", "list_avg(tps)"
    md = f"(0.015 * list_avg(list_transform(tps, lambda x: abs(x - {ma}))))"
    stoch, plus, minus = div("100 * (c - ll)", "hh - ll", 50.0), div("100 * up", "atr"), div("100 * dn", "atr")
    ratio = f"least({div('v[-1]', 'v14', 1.0)}, 10.0)"
    made = {
        "lr_1": "ln(c / p[n - 1])", "lr_2": "ln(c / p[n - 2])", "lr_3": "ln(c / p[n - 3])",
        **{f"lr_{k}": f"ln(c / p[n - {k}]) / {k}" for k in (5, 10, 20)},
        **{f"rsi_{w}": x for w, x in rsi.items()}, "rsi_diff": f"{rsi[14]} - {rsi[7]}", "rsi_mom": f"{rsi[14]} - {rsi[21]}",
        "macd": macd, "macd_sig": f"0.85 * {macd}", "macd_hist": f"{macd} - 0.85 * {macd}", "macd_mom": f"0.05 * {macd}",
        "bb_pct": div("c - m20 + 2 * sd", "4 * sd", 0.5), "bb_width": div("4 * sd", "m20"),
        **{f"dist_sma{w}": div(f"c - m{w}", f"m{w}") for w in (5, 10, 20, 50, 100)},
        "dist_ema9": div("c - e9", "e9"), "dist_ema21": div("c - e21", "e21"),
        **{f"vol_{w}d": x for w, x in vol.items()}, "rvol_20": f"{vol[20]} * sqrt(252)", "vol_ratio": div(vol[10], vol[20], 1.0),
        "atr_pct": div("atr", "c"), "atr_trend": "1.0",
        "stoch_k": stoch, "stoch_d": stoch, "stoch_diff": "0.0", "willr": div("-100 * (hh - c)", "hh - ll", -50.0),
        "cci": f"greatest(-300.0, least(300.0, {div(f'{tp} - {ma}', md)}))",
        "adx_plus": plus, "adx_minus": minus, "adx_diff": f"{plus} - {minus}",
        **{f"roc_{w}": div(f"c - p[n - {w}]", f"p[n - {w}]") + " * 100" for w in (3, 5, 10, 20)},
        "v_ratio": ratio, "v_trend": f"least({div('v14', 'v50', 1.0)}, 5.0)", "pv_corr": f"greatest(-5.0, least(5.0, ln(c / p[n - 1]) * {ratio}))",
        "hl_pct": div("h[-1] - l[-1]", "c"), "open_close": "0.0",
        "dist_52w_high": div("c - list_max(p[greatest(n - 251, 1):n])", "c"), "dist_52w_low": div("c - list_min(p[greatest(n - 251, 1):n])", "c"),
        "sma20_slope": div("m20 - o20", "o20"), "sma50_slope": div("m50 - o50", "o50"),
    }
    return {c: made[c] for c in cols}


def ref_step_ctes(cols: list[str], horizon: int) -> list[tuple[str, str]]:
    """``walk``: the tails after every step, predicted by ``ridge`` on features scaled by ``qs``."""
    width = lambda c: f"(CASE WHEN q_{c}[3] - q_{c}[1] = 0 THEN 1.0 ELSE q_{c}[3] - q_{c}[1] END)"
    dot = " + ".join(f"coef[{i + 1}] * (({x}) - q_{c}[2]) / {width(c)}" for i, (c, x) in enumerate(ref_step_sql(cols).items()))
    return [("walk", f"""SELECT symbol, d, p, h, l, v, 0 AS step FROM tails UNION ALL
        SELECT symbol, d, list_append(p, nxt), list_append(h, nxt * 1.005), list_append(l, nxt * 0.995), list_append(v, list_avg(v[n - 4:n])), step + 1
        FROM (SELECT *, c * exp(greatest(-0.15, least(0.15, intercept + {dot}))) AS nxt
              FROM ({ref_base_sql(f'(SELECT * FROM walk WHERE step < {horizon})')}) JOIN ridge USING (symbol) JOIN qs USING (symbol))""")]
