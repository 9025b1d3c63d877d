"""Family M: the documented analyst models (rule engine, text classifiers, vote)."""

from __future__ import annotations

from pyspark.sql import functions as F

from candela.operators import analyst as an
from candela.operators.snapshot import tail_rows
from candela.plans.common import rounded, sql_round
from candela.plans.registry import register
from candela.plans.sql_parts import trimmed_ctes, with_ctes
from candela.sources import tables

_RULE_COLS = ["rsi_14", "macd", "macd_sig", "bb_pct", "dist_sma50", "sma20_slope", "v_ratio", "lr_1",
              "dist_52w_high", "dist_52w_low", "rvol_20"]
_TOTAL = sum(abs(w) for _, _, w in an.DEFAULT_RULES) / 2
_SCORE = " + ".join(f"CASE WHEN {c} THEN {w} ELSE 0.0 END" for _, c, w in an.DEFAULT_RULES)
_FIRED = " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for _, c, _ in an.DEFAULT_RULES)
_LAST = ("lastf", f"SELECT symbol, d, {', '.join(_RULE_COLS)} FROM (SELECT *, row_number() OVER "
         "(PARTITION BY symbol ORDER BY d DESC) AS k FROM ft) WHERE k = 1")


def _last_rows(spark, sf_dir):
    return tail_rows(tables.processed(spark, sf_dir), 1).select("symbol", "d", *_RULE_COLS)


@register("rule_expert", with_ctes(trimmed_ctes() + [_LAST], f"""SELECT symbol, d, round(CAST(score AS DOUBLE) + 3.18309886e-8, 6) AS rule_score, fired AS rules_fired,
  CASE WHEN score >= 2.0 THEN 'BUY' WHEN score <= -2.0 THEN 'SELL' ELSE 'HOLD' END AS rule_decision,
  round(CAST(greatest(-1.0, least(1.0, score / {_TOTAL})) AS DOUBLE) + 3.18309886e-8, 6) AS rule_signal
  FROM (SELECT symbol, d, {_SCORE} AS score, {_FIRED} AS fired FROM lastf)"""))
def rule_expert(spark, sf_dir):
    out = an.rule_expert(_last_rows(spark, sf_dir))
    return rounded(out.select("symbol", "d", "rule_score", "rules_fired", "rule_decision", "rule_signal"))


def _documents(spark, sf_dir):
    return tables.table(spark, sf_dir, "documents").select("doc_id", "text")


_NB = [("tok", r"""SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}]+'), lambda t: t <> '')) AS token
        FROM documents"""),
       ("cnt", """SELECT token, count(*) FILTER (quality = 1) AS n1, count(*) FILTER (quality = 0) AS n0
        FROM tok JOIN labels USING (doc_id) WHERE quality IN (0, 1) GROUP BY token"""),
       ("tot", "SELECT sum(n1)::DOUBLE AS t1, sum(n0)::DOUBLE AS t0, count(*) AS v FROM cnt"),
       ("wts", "SELECT token, ln((n1 + 1.0::DOUBLE) / (t1 + v)) - ln((n0 + 1.0::DOUBLE) / (t0 + v)) AS w FROM cnt, tot"),
       ("pri", "SELECT ln(count(*) FILTER (quality = 1) / count(*) FILTER (quality = 0)) AS b FROM labels JOIN documents USING (doc_id)"),
       ("odd", "SELECT doc_id, sum(w) AS o FROM tok JOIN wts USING (token) GROUP BY doc_id"),
       ("nb", "SELECT doc_id, coalesce(o, 0.0) + b AS z FROM documents LEFT JOIN odd USING (doc_id), pri")]


@register("nb_text_class", with_ctes(_NB, f"""SELECT doc_id, CASE WHEN z > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS prediction,
  {sql_round('1 / (1 + exp(greatest(-700.0, least(700.0, -z))))')} AS p_positive FROM nb"""))
def nb_text_class(spark, sf_dir):
    """Fitted on the labelled documents, scores all of them."""
    return rounded(an.nb_text_class(tables.labelled_text(spark, sf_dir), score=_documents(spark, sf_dir)))


@register("tfidf_logreg")
def tfidf_logreg(spark, sf_dir):
    return an.tfidf_logreg(tables.labelled_text(spark, sf_dir), score=_documents(spark, sf_dir))


@register("ensemble_vote")
def ensemble_vote(spark, sf_dir):
    """Per bar symbol: rule signal of its newest feature row, and the mean
    (2 P(positive) - 1) of the two text models over the documents of the
    sources mapped to it (source k -> symbol k % 6)."""
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    lab = tables.labelled_text(spark, sf_dir)
    idx = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    sym = docs.select("doc_id", tables.symbol_of(idx).alias("symbol"))

    def per_symbol(pred, name):
        return (pred.join(sym, "doc_id").groupBy("symbol")
                .agg(F.avg(2 * F.col("p_positive") - 1).alias(name)))
    nb = per_symbol(an.nb_text_class(lab, score=docs), "nb_signal")
    lr = per_symbol(an.tfidf_logreg(lab, score=docs), "lr_signal")
    rules = an.rule_expert(_last_rows(spark, sf_dir)).select("symbol", "rule_signal")
    return rounded(an.ensemble_vote(rules.join(nb, "symbol", "left").join(lr, "symbol", "left")))

