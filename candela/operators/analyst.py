"""Analyst models described by the reference's documentation only (family M).

The reference documents (no code is shipped) a naive Bayes text classifier,
a TF-IDF + logistic regression classifier, a weighted rule engine and a
50/25/25 weighted vote. Here they are MLlib pipelines and column
expressions: the text models train on the labelled documents, the rule
engine applies a rule table of (name, SQL expression, weight) to feature
rows, and the vote is a projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN_PATTERN = r"[^\p{L}]+"

# The documented rule set is not published; these rules (name, condition on
# feature columns, signed weight) are this library's defaults and callers
# pass their own table.
DEFAULT_RULES = [
    ("rsi_oversold", "rsi_14 < 30", 2.0),
    ("rsi_overbought", "rsi_14 > 70", -2.0),
    ("macd_above_signal", "macd > macd_sig", 1.0),
    ("macd_below_signal", "macd < macd_sig", -1.0),
    ("near_lower_band", "bb_pct < 0.2", 1.0),
    ("near_upper_band", "bb_pct > 0.8", -1.0),
    ("above_sma50", "dist_sma50 > 0", 1.0),
    ("below_sma50", "dist_sma50 < 0", -1.0),
    ("sma20_rising", "sma20_slope > 0", 0.5),
    ("sma20_falling", "sma20_slope < 0", -0.5),
    ("volume_spike_up", "v_ratio > 2 AND lr_1 > 0", 1.0),
    ("volume_spike_down", "v_ratio > 2 AND lr_1 < 0", -1.0),
    ("near_52w_high", "dist_52w_high > -0.05", -0.5),
    ("near_52w_low", "dist_52w_low < 0.05", 0.5),
    ("high_volatility", "rvol_20 > 0.6", -0.5),
]
BUY_AT, SELL_AT = 2.0, -2.0


def rule_expert(rows: DataFrame, rules=DEFAULT_RULES, buy_at: float = BUY_AT,
                sell_at: float = SELL_AT) -> DataFrame:
    """Sum of the weights of the rules a row meets -> BUY / SELL / HOLD, the
    number of rules fired and a signal in [-1, 1] (score / total weight)."""
    hits = [F.when(F.expr(cond), F.lit(float(w))).otherwise(F.lit(0.0)) for _, cond, w in rules]
    fired = [F.when(F.expr(cond), F.lit(1)).otherwise(F.lit(0)) for _, cond, _ in rules]
    score = sum(hits[1:], hits[0])
    total = sum(abs(w) for _, _, w in rules) / 2
    out = rows.withColumns({"rule_score": score, "rules_fired": sum(fired[1:], fired[0])})
    s = F.col("rule_score")
    return out.withColumns({
        "rule_decision": F.when(s >= buy_at, "BUY").when(s <= sell_at, "SELL").otherwise("HOLD"),
        "rule_signal": F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s / F.lit(total))),
    })


def _tokens(text_col: str = "text"):
    from pyspark.ml.feature import RegexTokenizer
    return RegexTokenizer(inputCol=text_col, outputCol="words", pattern=TOKEN_PATTERN, toLowercase=True)


def _p1(pred: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array
    return pred.select("doc_id", *(["label"] if "label" in pred.columns else []), "prediction",
                       vector_to_array("probability")[1].alias("p_positive"))


def nb_text_class(labelled: DataFrame, label_col: str = "quality", smoothing: float = 1.0,
                  score: DataFrame | None = None) -> DataFrame:
    """Multinomial naive Bayes with Laplace smoothing on token counts, in grouped sums.

    Fitted on the labelled rows (0 or 1) over every token they hold; scores ``score``
    (default: the labelled rows) with prediction and P(class 1). Tokens that
    training never met say nothing. The model is a table (token, weight) and
    one row of priors; documents meet it in an equi-join on the token. The ``BROADCAST_TOKENS``
    tokens most frequent in training are sent to every task, so that most weights are summed per
    document where it is split; only the other tokens are shuffled, to meet the rest of the table.
    """
    from candela.operators.text import BROADCAST_TOKENS, tokens
    y = F.col(label_col).cast("int")
    train = labelled.filter(y.isin(0, 1)).select(y.alias("y"), F.col("text"))
    counts = (train.select("y", F.explode(tokens(F.col("text"))).alias("token")).groupBy("token")
              .agg(F.count_if(F.col("y") == 1).alias("n1"), F.count_if(F.col("y") == 0).alias("n0"))).checkpoint()
    total = counts.agg(F.sum("n1").alias("t1"), F.sum("n0").alias("t0"), F.count(F.lit(1)).alias("v"))
    prior = train.agg(F.log(F.count_if(F.col("y") == 1) / F.count_if(F.col("y") == 0)).alias("b"))
    sums = total.select(F.struct("t1", "t0", "v")).scalar()
    t1, t0, v = (sums[c] for c in ("t1", "t0", "v"))
    s = F.lit(float(smoothing))
    w = F.log((F.col("n1") + s) / (t1 + s * v)) - F.log((F.col("n0") + s) / (t0 + s * v))
    many = counts.count() > BROADCAST_TOKENS
    common = counts.orderBy((F.col("n1") + F.col("n0")).desc(), "token").limit(BROADCAST_TOKENS).checkpoint() if many else counts
    docs = score if score is not None else labelled
    words = docs.select("doc_id", F.explode(tokens(F.col("text"))).alias("token"))
    told = words.join(F.broadcast(common.select("token", w.alias("w"))), "token").select("doc_id", "w")
    if many:
        names = F.broadcast(common.select("token"))
        rest = words.join(names, "token", "left_anti").groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))
        rare = counts.join(names, "token", "left_anti").select("token", w.alias("w"))
        told = told.unionByName(rest.join(rare, "token").select("doc_id", (F.col("n") * F.col("w")).alias("w")))
    odds = told.groupBy("doc_id").agg(F.sum("w").alias("odds"))
    z = F.coalesce(F.col("odds"), F.lit(0.0)) + prior.scalar()
    p = 1 / (1 + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), -z))))
    keep = [F.col(label_col).cast("double").alias("label")] if label_col in docs.columns else []
    return (docs.select("doc_id", *keep).join(odds, "doc_id", "left")
            .select("doc_id", *[c for c in ("label",) if keep], F.when(z > 0, 1.0).otherwise(0.0).alias("prediction"),
                    p.alias("p_positive")))


def tfidf_logreg(labelled: DataFrame, label_col: str = "quality", num_features: int = 1 << 18,
                 max_iter: int = 100, reg: float = 0.01, score: DataFrame | None = None) -> DataFrame:
    """Hashed term frequencies, IDF weighting and logistic regression.

    Every term takes part; ``num_features`` is the number of hash buckets, a
    parameter of the model (terms that share a bucket share a weight). Labelled texts are
    split and hashed once: their frequencies stay on disk while the two models are fitted.
    """
    from pyspark import StorageLevel
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF
    data = labelled.withColumn("label", F.col(label_col).cast("double"))
    terms = PipelineModel(stages=[_tokens(), HashingTF(inputCol="words", outputCol="tf", numFeatures=num_features)])
    train = terms.transform(data).select("label", "tf").persist(StorageLevel.DISK_ONLY)
    try:
        idf = IDF(inputCol="tf", outputCol="features").fit(train)
        logreg = LogisticRegression(maxIter=max_iter, regParam=reg).fit(idf.transform(train))
    finally:
        train.unpersist()
    return _p1(PipelineModel(stages=[terms, idf, logreg]).transform(score if score is not None else data))


def ensemble_vote(signals: DataFrame, weights=(0.50, 0.25, 0.25), buy_at: float = 0.2,
                  sell_at: float = -0.2) -> DataFrame:
    """Weighted vote of three signals in [-1, 1] (rule, nb, lr): combined
    score, decision and confidence (|score| as a percentage)."""
    wr, wn, wl = weights
    s = (F.coalesce(F.col("rule_signal"), F.lit(0.0)) * wr + F.coalesce(F.col("nb_signal"), F.lit(0.0)) * wn
         + F.coalesce(F.col("lr_signal"), F.lit(0.0)) * wl)
    out = signals.withColumn("ensemble_score", s)
    e = F.col("ensemble_score")
    return out.withColumns({"decision": F.when(e >= buy_at, "BUY").when(e <= sell_at, "SELL").otherwise("HOLD"),
                            "confidence": F.round(F.abs(e) * 100, 1)})
