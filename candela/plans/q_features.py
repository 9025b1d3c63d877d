"""Family B: indicator queries over the lineitem bars."""

from __future__ import annotations

from candela.operators import indicators as ind
from candela.plans.common import rounded, sql_rounded
from candela.plans.registry import register
from candela.plans.sql_parts import feature_ctes, trimmed_ctes, with_ctes
from candela.sources import tables


def _ind_query(name: str):
    def q(spark, sf_dir):
        return rounded(ind.indicator(tables.bars(spark, sf_dir), name))
    q.__name__ = name
    return q


for _name, _cols in ind.INDICATOR_COLS.items():
    _sql = sql_rounded(with_ctes(feature_ctes(), f"SELECT symbol, d, {', '.join(_cols)} FROM feat"),
                       ["symbol", "d", *_cols], _cols)
    register(_name, _sql)(_ind_query(_name))


FM_COLS = ind.FEATURE_COLS + ["target_lr", "open", "high", "low", "close", "volume"]


@register("feature_matrix", sql_rounded(
    with_ctes(trimmed_ctes(), f"SELECT symbol, d, {', '.join(FM_COLS)} FROM ft"),
    ["symbol", "d", *FM_COLS], FM_COLS))
def feature_matrix(spark, sf_dir):
    return rounded(tables.processed(spark, sf_dir))


SEL_GROUPS = ["RSI", "MACD", "Volume", "Nope"]
SEL_COLS = ind.select_group_cols(SEL_GROUPS)


@register("feature_select", sql_rounded(
    with_ctes(trimmed_ctes(), f"SELECT symbol, d, {', '.join(SEL_COLS)}, target_lr, close FROM ft"),
    ["symbol", "d", *SEL_COLS, "target_lr", "close"], SEL_COLS + ["target_lr", "close"]))
def feature_select(spark, sf_dir):
    return rounded(ind.feature_select(tables.processed(spark, sf_dir), SEL_GROUPS))


@register("trim_features", with_ctes(trimmed_ctes(), "SELECT symbol, count(*) AS n_rows, min(d) AS first_d, max(d) AS last_d FROM ft GROUP BY symbol"))
def trim_features(spark, sf_dir):
    from pyspark.sql import functions as F
    feat = tables.processed(spark, sf_dir)
    return feat.groupBy("symbol").agg(F.count("*").alias("n_rows"), F.min("d").alias("first_d"),
                                      F.max("d").alias("last_d"))

