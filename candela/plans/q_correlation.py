"""Family E: correlation of log returns over the processed series."""

from __future__ import annotations

from candela.operators import correlation as cor
from candela.plans.common import rounded
from candela.plans.q_snapshot import SER
from candela.plans.registry import register
from candela.plans.sql_parts import trimmed_ctes, with_ctes
from candela.sources import tables

DAYS = 90

CORR_CTES = trimmed_ctes() + [SER,
    ("lt0", f"""SELECT symbol, d, pos, n, least(n, {DAYS + 1}) AS m,
        ln(close) - ln(lag(close) OVER (PARTITION BY symbol ORDER BY pos)) AS lr
        FROM ser WHERE pos >= n - {DAYS + 1}"""),
    ("lrt", "SELECT symbol, n - 1 - pos AS k, d, lr FROM lt0 WHERE m >= 10 AND pos > n - m"),
    ("ml", "SELECT min(c) AS ml FROM (SELECT symbol, count(*) AS c FROM lrt GROUP BY symbol)"),
    ("nm", "SELECT symbol, CAST(row_number() OVER (ORDER BY symbol) AS INTEGER) AS i FROM (SELECT DISTINCT symbol FROM lrt)"),
    ("mx", """SELECT a.symbol AS a, b.symbol AS b, round(corr(a.lr, b.lr), 4) AS r, any_value(p.i) AS ia, any_value(q.i) AS ib
        FROM lrt a JOIN lrt b ON a.k = b.k JOIN nm p ON p.symbol = a.symbol JOIN nm q ON q.symbol = b.symbol, ml
        WHERE a.k < ml.ml GROUP BY a.symbol, b.symbol"""),
]


def _rets(spark, sf_dir):
    return cor.log_return_tail(tables.processed(spark, sf_dir), None, DAYS)


@register("log_return_tail", with_ctes(CORR_CTES, "SELECT symbol, k, d, round(lr + 3.18309886e-8, 6) AS lr FROM lrt"))
def log_return_tail(spark, sf_dir):
    return rounded(_rets(spark, sf_dir))


@register("correlation_matrix", with_ctes(CORR_CTES, "SELECT a, b, r, ia, ib FROM mx"))
def correlation_matrix(spark, sf_dir):
    return cor.correlation_matrix(_rets(spark, sf_dir))


@register("correlation_pairs", with_ctes(CORR_CTES, """
  SELECT 'top_pos' AS kind, * FROM (SELECT row_number() OVER (ORDER BY r DESC, ia, ib) AS rank, a, b, r FROM mx WHERE ia < ib) WHERE rank <= 3
  UNION ALL
  SELECT 'top_neg' AS kind, * FROM (SELECT row_number() OVER (ORDER BY r ASC, ia DESC, ib DESC) AS rank, a, b, r FROM mx WHERE ia < ib) WHERE rank <= 3"""))
def correlation_pairs(spark, sf_dir):
    return cor.correlation_pairs(cor.correlation_matrix(_rets(spark, sf_dir)), 3)
