"""Family L: headline sentiment and chat intent routing."""

from __future__ import annotations

from candela.operators import text as tx
from candela.plans.registry import register
from candela.plans.sql_parts import with_ctes
from candela.sources import tables

_LEX = "SELECT * FROM (VALUES " + ", ".join(f"('{t}', {w})" for t, w in tables.LEXICON) + ") v(token, weight)"
_SCORE = [
    ("lex", _LEX),
    ("tok", r"""SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}]+'), lambda t: t <> '')) AS token
        FROM documents"""),
    ("ssum", "SELECT t.doc_id, sum(l.weight) AS s FROM tok t JOIN lex l USING (token) GROUP BY t.doc_id"),
    ("scored", """SELECT d.doc_id, d.source AS symbol, d.doc_id AS published, coalesce(s.s, 0.0) / sqrt(coalesce(s.s, 0.0) ^ 2 + 15) AS c
        FROM documents d LEFT JOIN ssum s USING (doc_id)"""),
]


def _scored(spark, sf_dir):
    return tx.headline_sentiment(tables.headlines(spark, sf_dir), tables.lexicon(spark))


@register("headline_sentiment", with_ctes(_SCORE, """SELECT doc_id, symbol, published, round(c + 1e-9, 3) AS score,
  CASE WHEN c >= 0.05 THEN 'positive' WHEN c <= -0.05 THEN 'negative' ELSE 'neutral' END AS sentiment FROM scored"""))
def headline_sentiment(spark, sf_dir):
    return _scored(spark, sf_dir).drop("_compound")


@register("symbol_sentiment", with_ctes(_SCORE, """SELECT symbol,
  CASE WHEN a >= 0.05 THEN 'BULLISH' WHEN a <= -0.05 THEN 'BEARISH' ELSE 'NEUTRAL' END AS overall,
  round(a + 1e-9, 3) AS score, n AS count FROM (
  SELECT symbol, avg(c) AS a, count(*) AS n FROM (
    SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY published DESC) AS k FROM scored) WHERE k <= 8
  GROUP BY symbol)"""))
def symbol_sentiment(spark, sf_dir):
    return tx.symbol_sentiment(_scored(spark, sf_dir), None, 8)


def _intent_sql() -> str:
    case_i, case_l = [], []
    for name, url, words in tx.INTENTS:
        cond = " OR ".join(f"contains(low, '{w}')" for w in words)
        case_i.append(f"WHEN {cond} THEN '{name}'")
        case_l.append(f"WHEN {cond} THEN {repr(url) if url else 'NULL'}")
    extra = ", ".join(f"({-(i + 1)}, 0, '{m}')" for i, m in enumerate(tables.CHAT_EXTRA))
    return f"""SELECT conv_id, turn, message,
      CASE WHEN err IS NULL THEN CASE {' '.join(case_i)} ELSE 'help' END END AS intent,
      CASE WHEN err IS NULL THEN CASE {' '.join(case_l)} ELSE NULL END END AS link, err AS error
      FROM (SELECT *, lower(m) AS low, CASE WHEN length(m) = 0 THEN 'empty message'
              WHEN length(m) > 600 THEN 'over 600 characters' END AS err
            FROM (SELECT conv_id, turn, message, regexp_replace(coalesce(message, ''), '^\\s+|\\s+$', '', 'g') AS m
                  FROM (SELECT conv_id, turn, text AS message FROM conversations WHERE role = 'user'
                        UNION ALL SELECT * FROM (VALUES {extra}) v(conv_id, turn, message))))"""


@register("intent_route", _intent_sql())
def intent_route(spark, sf_dir):
    return tx.intent_route(tables.chat_messages_all(spark, sf_dir))
