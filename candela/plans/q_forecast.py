"""Family F: training set, scaling, models, hold-out and roll-forward."""

from __future__ import annotations

from pyspark.sql import functions as F

from candela.operators import forecast as fc
from candela.operators import rollforward as rf
from candela.operators import trees as tr
from candela.operators.indicators import FEATURE_COLS, select_group_cols
from candela.plans.common import TIE_SHIFT, rounded, sql_round
from candela.plans.registry import register
from candela.plans.sql_models import ref_base_sql, ref_step_ctes, ref_step_sql, ridge_ctes
from candela.plans.sql_parts import prefixed_feature_ctes, trimmed_ctes, with_ctes
from candela.sources import tables

COLS = select_group_cols(None)      # the default groups
HORIZON = 14

_TS = [("ts0", f"""SELECT symbol, d, {', '.join(COLS)}, target_lr, close FROM ft
         WHERE {' AND '.join(f'{c} IS NOT NULL' for c in COLS + ['target_lr'])}"""),
       ("ts1", """SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY d) - 1 AS pos,
         count(*) OVER (PARTITION BY symbol) AS n FROM ts0"""),
       ("tset", "SELECT *, CASE WHEN pos < floor(n * 0.9) THEN 'train' ELSE 'test' END AS split FROM ts1 WHERE n >= 100"),
       ("qs", "SELECT symbol, " + ", ".join(f"quantile_cont({c}, [0.25, 0.5, 0.75]) AS q_{c}" for c in COLS)
        + " FROM tset GROUP BY symbol"),
       ("scaled", "SELECT t.symbol, t.d, t.pos, t.n, t.split, t.target_lr, t.close, "
        + ", ".join(f"(t.{c} - q.q_{c}[2]) / CASE WHEN q.q_{c}[3] - q.q_{c}[1] = 0 THEN 1.0 ELSE q.q_{c}[3] - q.q_{c}[1] END AS {c}"
                    for c in COLS) + " FROM tset t JOIN qs q USING (symbol)")]


def _ctes():
    return trimmed_ctes() + _TS


def _tset(spark, sf_dir):
    return fc.training_set(tables.processed(spark, sf_dir))


_TRAINING: dict = {}
_STATS: dict = {}
_SCALED: dict = {}
_MODEL: dict = {}
_BLOCKS: dict = {}


def _training(spark, sf_dir):
    """The training set, persisted: the search for its order statistics reads it once a round."""
    return tables._session_cached(_TRAINING, spark, sf_dir, lambda: _tset(spark, sf_dir))


def _stats(spark, sf_dir):
    return tables._session_cached(_STATS, spark, sf_dir, lambda: fc.scaler_stats(_training(spark, sf_dir), COLS))


def _scaled(spark, sf_dir):
    """The scaled training set, persisted once per session: the hold-out,
    the tree models, the roll-forward and the sequence windows share it."""
    return tables._session_cached(_SCALED, spark, sf_dir, lambda: fc.scale_rows(_training(spark, sf_dir), _stats(spark, sf_dir), COLS))


_R = ", ".join(f"{sql_round(c)} AS {c}" for c in COLS)


@register("training_set", with_ctes(_ctes(), f"""SELECT symbol, d, pos, n, split, {_R},
  {sql_round('target_lr')} AS target_lr, {sql_round('close')} AS close FROM tset"""))
def training_set(spark, sf_dir):
    return rounded(_tset(spark, sf_dir))


@register("robust_scale", with_ctes(_ctes(), f"""SELECT symbol, d, pos, n, split, {sql_round('target_lr')} AS target_lr,
  {sql_round('close')} AS close, {_R} FROM scaled"""))
def robust_scale(spark, sf_dir):
    return rounded(_scaled(spark, sf_dir))


def _ridge(spark, sf_dir):
    sc = _scaled(spark, sf_dir)
    return sc, tables._session_cached(_MODEL, spark, sf_dir, lambda: fc.forecast_ridge(sc, COLS, 2.0))


@register("forecast_ridge", with_ctes(_ctes() + ridge_ctes(COLS), f"""SELECT symbol,
  list_transform(coef, lambda x: round(x + {TIE_SHIFT}, 6)) AS coef, {sql_round('intercept')} AS intercept FROM ridge"""))
def forecast_ridge(spark, sf_dir):
    _, m = _ridge(spark, sf_dir)
    return rounded(m.withColumn("coef", F.transform("coef", lambda x: F.round(x + TIE_SHIFT, 6))))


def _blocks(spark, sf_dir):
    return tables._session_cached(_BLOCKS, spark, sf_dir, lambda: tr.blocks_of(_scaled(spark, sf_dir), COLS))


def _trees(kind):
    def q(spark, sf_dir):
        blocks = _blocks(spark, sf_dir)
        return fc.holdout_eval(tr.predict(blocks, tr.fit(blocks, len(COLS), kind), len(COLS)))
    return q


register("forecast_forest")(_trees("forest"))
register("forecast_extra_trees")(_trees("extra_trees"))
register("forecast_gbt")(_trees("gbt"))
register("forecast_gbt_xgb")(_trees("gbt_xgb"))
register("forecast_gbt_lgb")(_trees("gbt_lgb"))


def _holdout(spark, sf_dir):
    sc, m = _ridge(spark, sf_dir)
    return fc.holdout_eval(fc.ridge_predict(sc, m, COLS))


_HOLDOUT = ("hold", f"""SELECT symbol, d, actual, close * exp(greatest(-0.15, least(0.15, pred))) AS predicted, 'holdout' AS kind FROM (
  SELECT s.symbol, s.d, s.close, s.split, lead(s.close) OVER (PARTITION BY s.symbol ORDER BY s.pos) AS actual,
    r.intercept + list_sum(list_transform(list_zip([{', '.join('s.' + c for c in COLS)}], r.coef), lambda z: z[1] * z[2])) AS pred
  FROM scaled s JOIN ridge r USING (symbol)) WHERE split = 'test' AND actual IS NOT NULL""")


@register("holdout_eval", with_ctes(_ctes() + ridge_ctes(COLS) + [_HOLDOUT], f"""SELECT symbol, d, {sql_round('actual')} AS actual,
  {sql_round('predicted')} AS predicted, kind FROM hold"""))
def holdout_eval(spark, sf_dir):
    return rounded(_holdout(spark, sf_dir))


def _linear(spark, sf_dir):
    _, m = _ridge(spark, sf_dir)
    return m.join(_stats(spark, sf_dir), "symbol")


def _future(spark, sf_dir, mode="train"):
    return rf.forecast_rolling(tables.processed(spark, sf_dir), _linear(spark, sf_dir), rf.linear, COLS, HORIZON, mode)


@register("forecast_rolling")
def forecast_rolling(spark, sf_dir):
    """Roll-forward on the training definitions of the features."""
    return _future(spark, sf_dir)


_REF_TAIL = ("tails", f"""SELECT symbol, max(d) AS d, list(close ORDER BY d) AS p, list(high ORDER BY d) AS h, list(low ORDER BY d) AS l,
  list(volume ORDER BY d) AS v FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY d DESC) AS kk FROM ft)
  WHERE kk <= {rf.SHORT_HISTORY} GROUP BY symbol""")


@register("forecast_rolling_ref", with_ctes(_ctes() + ridge_ctes(COLS) + [_REF_TAIL] + ref_step_ctes(COLS, HORIZON), f"""
  SELECT symbol, CAST(step AS INTEGER) AS step, CAST(d + CAST(step AS INTEGER) AS DATE) AS d, {sql_round('p[-1]')} AS predicted FROM walk WHERE step > 0"""))
def forecast_rolling_ref(spark, sf_dir):
    """Roll-forward on the shortcut definitions of a step."""
    return rounded(_future(spark, sf_dir, "ref"))


@register("forecast_rolling_forest")
def forecast_rolling_forest(spark, sf_dir):
    """Roll-forward of the per-symbol forests."""
    blocks = _blocks(spark, sf_dir)
    models = tr.fit(blocks, len(COLS), "forest").join(_stats(spark, sf_dir), "symbol")
    return rf.forecast_rolling(tables.processed(spark, sf_dir), models, tr.step_predict, COLS, HORIZON)


_STEP = trimmed_ctes() + prefixed_feature_ctes(
    f"""SELECT symbol, d, open, high, low, close, volume FROM (SELECT *, row_number() OVER (PARTITION BY symbol
        ORDER BY d DESC) AS kk FROM ft) WHERE kk <= {rf.HISTORY}""", "w80_")


@register("forecast_step_features", with_ctes(_STEP, f"""SELECT symbol, d, {sql_round('close')} AS close,
  {', '.join(sql_round(f'coalesce({c}, 0.0)') + ' AS ' + c for c in FEATURE_COLS)}
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY d DESC) AS kk FROM w80_feat) WHERE kk = 1"""))
def forecast_step_features(spark, sf_dir):
    """All 52 step features of the newest bar, from each symbol's newest bars alone."""
    return rounded(rf.step_features(tables.processed(spark, sf_dir), FEATURE_COLS))


@register("forecast_step_features_ref", with_ctes(trimmed_ctes() + [_REF_TAIL], "SELECT symbol, d, " + sql_round("p[-1]") + " AS close, "
                                                  + ", ".join(f"{sql_round(x)} AS {c}" for c, x in ref_step_sql(FEATURE_COLS).items())
                                                  + " FROM (" + ref_base_sql("tails") + ")"))
def forecast_step_features_ref(spark, sf_dir):
    """The 52 shortcut features of the newest bar, from the newest 80 closes, highs, lows and volumes."""
    return rounded(rf.step_features(tables.processed(spark, sf_dir), FEATURE_COLS, "ref"))


@register("forecast_series")
def forecast_series(spark, sf_dir):
    return fc.forecast_series(_holdout(spark, sf_dir), _future(spark, sf_dir))


_W = ", ".join(COLS)


@register("sequence_windows", with_ctes(_ctes(), f"""SELECT symbol, d, pos,
  list_transform(flatten(list([{_W}]) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING)),
                 lambda x: round(x + {TIE_SHIFT}, 6)) AS window,
  {sql_round('target_lr')} AS target_lr FROM scaled
  QUALIFY len(flatten(list([{_W}]) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING))) = {15 * len(COLS)}"""))
def sequence_windows(spark, sf_dir):
    out = fc.sequence_windows(_scaled(spark, sf_dir), COLS, 15)
    return rounded(out.withColumn("window", F.transform("window", lambda x: F.round(x + TIE_SHIFT, 6))))
