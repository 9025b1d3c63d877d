"""Headline sentiment and chat intent routing (family L).

Sentiment is re-aimed from a packaged lexicon scorer to a lexicon argument:
a document's valence is the sum of the weights of its tokens, normalised as
s / sqrt(s^2 + 15). Tokens meet the lexicon in an equi-join: broadcast up to
``BROADCAST_TOKENS`` counted tokens, shuffled beyond. ``doc_id`` names a headline.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candela.functions.scalar import rnd

TOKEN_SPLIT = r"[^\p{L}]+"
ALPHA = 15.0
BROADCAST_TOKENS = 200_000      # a lexicon of at most so many tokens (about 10 MB) is sent to every task


def tokens(text: F.Column) -> F.Column:
    return F.filter(F.split(F.lower(text), TOKEN_SPLIT), lambda t: t != "")


def compound(s: F.Column) -> F.Column:
    return s / F.sqrt(s * s + F.lit(ALPHA))


def label(c: F.Column) -> F.Column:
    return F.when(c >= 0.05, "positive").when(c <= -0.05, "negative").otherwise("neutral")


def headline_text(headlines: DataFrame, title_chars: int | None = None,
                  summary_chars: int | None = None) -> F.Column:
    """title + ". " + summary (title alone without a summary). Optional cuts
    reproduce the reference's 140/200-character feed items; the default
    scores whole texts."""
    t = F.coalesce(F.col("title"), F.lit(""))
    s = F.coalesce(F.col("summary"), F.lit(""))
    if title_chars:
        t = F.substring(t, 1, title_chars)
    if summary_chars:
        s = F.substring(s, 1, summary_chars)
    return F.when(s != "", F.concat(t, F.lit(". "), s)).otherwise(t)


def headline_sentiment(headlines: DataFrame, lexicon: DataFrame, title_chars: int | None = None,
                       summary_chars: int | None = None) -> DataFrame:
    """Per headline: compound score (3 dp) and positive / negative / neutral."""
    weights = lexicon.groupBy("token").agg(F.sum("weight").alias("_w")).checkpoint()     # a token listed twice adds both weights
    if weights.count() <= BROADCAST_TOKENS:
        weights = F.broadcast(weights)
    # Tokens are summed per row where they are split, so one row a headline is shuffled, without its text.
    h = headlines.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "symbol", "published",
                         headline_text(headlines, title_chars, summary_chars).alias("_text"))
    h = h.select("_row", "doc_id", "symbol", "published", F.explode_outer(tokens(F.col("_text"))).alias("token"))
    scored = (h.join(weights, "token", "left").groupBy("_row", "doc_id", "symbol", "published")
              .agg(F.coalesce(F.sum("_w"), F.lit(0.0)).alias("_s")))
    c = compound(F.col("_s"))
    return scored.select("doc_id", "symbol", "published", rnd(c, 3).alias("score"), label(c).alias("sentiment"),
                         c.alias("_compound"))


def symbol_sentiment(scored: DataFrame, symbols: list[str] | None = None, k: int = 8) -> DataFrame:
    """Newest k headlines per symbol: mean score, BULLISH / BEARISH / NEUTRAL
    at +-0.05; a symbol without headlines scores 0 (NEUTRAL)."""
    w = Window.partitionBy("symbol").orderBy(F.col("published").desc(), F.col("doc_id").desc())
    top = scored.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= k)
    g = top.groupBy("symbol").agg(F.avg("_compound").alias("_avg"), F.count(F.lit(1)).alias("count"))
    if symbols is not None:
        spark = scored.sparkSession
        g = spark.createDataFrame([(s,) for s in symbols], "symbol string").join(g, "symbol", "left")
    avg = F.coalesce(F.col("_avg"), F.lit(0.0))
    return g.select("symbol", F.when(avg >= 0.05, "BULLISH").when(avg <= -0.05, "BEARISH").otherwise("NEUTRAL")
                    .alias("overall"), rnd(avg, 3).alias("score"),
                    F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"))


# Keyword sets of the chat router, in the order they are tried,
# with the intent label and page each one routes to.
INTENTS = [
    ("backtest", "/backtest", ["backtest", "short", "açığa", "aciga", "strategy", "strateji"]),
    ("forecast", "/predict", ["tahmin", "forecast", "predict", "prediction", "model"]),
    ("portfolio", "/portfolio", ["portfolio", "watchlist", "portföy", "portfoy", "takip", "track"]),
    ("screener", "/all_stocks", ["screener", "hisse bul", "listele", "öner", "oner", "recommend", "find"]),
    ("pricing", "/prices", ["token", "bakiye", "ödeme", "odeme", "pricing", "price", "balance", "pay"]),
    ("risk", None, ["risk", "rsi", "drawdown", "sharpe", "volatil", "volatile"]),
]
MAX_MESSAGE = 600


def intent_route(messages: DataFrame, msg_col: str = "message") -> DataFrame:
    """First keyword set contained in the lower-cased message, else help;
    empty messages and messages over 600 characters are rejected."""
    m = F.regexp_replace(F.coalesce(F.col(msg_col), F.lit("")), r"^\s+|\s+$", "")
    low = F.lower(m)
    intent = F.lit("help")
    link = F.lit(None).cast("string")
    for name, url, words in reversed(INTENTS):
        hit = None
        for wd in words:
            c = low.contains(wd)
            hit = c if hit is None else (hit | c)
        intent = F.when(hit, F.lit(name)).otherwise(intent)
        link = F.when(hit, F.lit(url)).otherwise(link)
    err = (F.when(F.length(m) == 0, "empty message")
           .when(F.length(m) > MAX_MESSAGE, "over 600 characters"))
    return messages.select("*", F.when(err.isNull(), intent).alias("intent"),
                           F.when(err.isNull(), link).alias("link"), err.alias("error"))
