import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from candela.llm import langid

from .helpers import SCHEMA, corpus, documents


def test_codewords():
    for n in range(0, 12):
        c = langid.codewords(n)
        assert c.shape[0] == n
        if n > 1:
            assert len({tuple(x) for x in c}) == n and (np.abs(c.sum(0)) < n).all()
    assert langid.codewords(4).shape[1] == 7


def test_long_text_in_pieces(monkeypatch):
    text = ("Les été où nous étions " * 300).encode()
    whole = langid.features(text)
    monkeypatch.setattr(langid, "_PIECE", 97)
    assert (langid.features(text) == whole).all() and whole.sum() > 0


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit_on_fold(docs)
    got = langid.predict(docs, model).select("row.doc_id", "row.lang", "lang_pred", "score", langid.held_out("row.doc_id").alias("h")).collect()
    test = [r for r in got if r.h]
    assert len(test) > 40 and {r.h for r in got} == {True, False}
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.lang == r.lang_pred for r in test]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_special_rows(spark):
    docs = documents(spark)
    model = langid.fit_on_fold(docs)
    assert model.languages == ["en", "fr"]
    got = {(r.doc_id, r.text): r for r in langid.predict(docs, model).select("row.*", "lang_pred", "score").collect()}
    for text in (None, "", " \t\n", "1234 ++ 99"):
        assert {r.lang_pred for (_, t), r in got.items() if t == text} == {"und"}
    assert got[73, "Word"].lang_pred in ("en", "fr") and got[0, next(t for i, t in got if i == 0)].lang_pred == "fr"
    kept = langid.keep_identified(docs)
    assert kept.schema == docs.schema and kept.filter(F.col("text").isNull()).count() == 0 and kept.count() > 60


def test_held_out_rows_teach_nothing(spark):
    docs = documents(spark)
    a = langid.fit_on_fold(docs)
    b = langid.fit_on_fold(docs.withColumn("lang", F.when(langid.held_out(), "xx").otherwise(F.col("lang"))))
    assert a.languages == b.languages and np.array_equal(a.weights, b.weights) and np.array_equal(a.trust, b.trust)


def test_all_rows_teach(spark):
    """A language whose texts all lie in the fifth kept for the trial is learned, and final weights count every row."""
    rows = [(t, "en") for t in ("the house of the old man %d" % i + " and the sea" * (i % 9) for i in range(60))]
    rows += [(t, "fr") for t in ("la maison de la vieille dame %d" % i + " sur la mer" * (i % 9) for i in range(60))]
    extra = spark.createDataFrame([(i, "zażółć gęślą jaźń przez świat który więc %d" % i) for i in range(40)], "i int, text string")
    rare = next(r.text for r in extra.filter(F.pmod(F.xxhash64("text"), F.lit(5)) == 0).collect())
    docs = spark.createDataFrame(rows + [(rare, "pl")] * 3, "text string, lang string")
    model = langid.fit(docs)
    assert model.languages == ["en", "fr", "pl"]
    assert {r.lang_pred for r in langid.predict(docs.filter("lang = 'pl'"), model).collect()} == {"pl"}
    assert langid.predict(docs, model).filter("lang_pred <> row.lang").count() == 0
    counts = np.array([sum(langid.features(t.encode()) for t, x in rows + [(rare, "pl")] * 3 if x == lang) for lang in model.languages])
    assert np.allclose(model.weights, langid.log_odds(counts, model.codes))


def test_without_labels(spark):
    for docs in (spark.createDataFrame([], SCHEMA), documents(spark).withColumn("lang", F.lit(None).cast("string"))):
        got = langid.predict(docs, langid.fit_on_fold(docs))
        assert got.filter("lang_pred <> 'und' or score <> 0").count() == 0 and got.count() == docs.count()
    one = documents(spark).withColumn("lang", F.lit("en"))
    assert {r.lang_pred for r in langid.predict(one, langid.fit(one)).collect()} == {"en", "und"}


def plain_grams(text):
    """bucket -> count of a text's byte trigrams, one at a time."""
    out = {}
    folded = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in text.lower().encode())
    padded = b" " + folded + b" "
    for i in range(len(folded)):
        a, b, c = padded[i:i + 3]
        if b != 32:
            at = ((a * 65536 + b * 256 + c) * 0x9E3779B1 % 2 ** 32) >> 20
            out[at] = out.get(at, 0) + 1
    return out


def plain_model(rows):
    """Languages, codewords, bucket weights per bit and loss weights from (text, label, kept) rows, with dictionaries."""
    names = sorted({label for _, label, _ in rows})
    n = len(names)
    codes = [[1 if i == 0 or (s >> i) & 1 else -1 for s in range(0, 2 ** n - 2, 2)] for i in range(n)]
    bits = range(len(codes[0]))

    def weights(chosen):
        counts = [{} for _ in names]
        for text, label, _ in chosen:
            mine = counts[names.index(label)]
            for at, c in plain_grams(text).items():
                mine[at] = mine.get(at, 0) + c
        total = [sum(c.values()) + 0.5 * 4096 for c in counts]

        def weight(bit, at):
            share = {1: [], -1: []}
            for i in range(n):
                share[codes[i][bit]].append((counts[i].get(at, 0) + 0.5) / total[i])
            return math.log(sum(share[1]) / len(share[1])) - math.log(sum(share[-1]) / len(share[-1]))
        return weight, [bool(c) for c in counts]

    def margins(weight, text):
        grams = plain_grams(text)
        size = sum(grams.values())
        return [sum(c * weight(bit, at) for at, c in grams.items()) * min(size, 40) / max(size, 1) for bit in bits]

    trial, known = weights([r for r in rows if not r[2]])
    trust = []
    for i, name in enumerate(names):
        tried = [margins(trial, text) for text, label, kept in rows if kept and label == name]
        hits = [sum(np.sign(m[b]) == codes[i][b] for m in tried) for b in bits]
        mine = [max((h + 1) / (len(tried) + 2) - 0.5, 0.05) if known[i] else 0.05 for h in hits]
        trust.append([x / (sum(mine) / len(mine)) for x in mine])
    final, _ = weights(rows)

    def decode(text):
        if not any(c.isalpha() for c in text or ""):
            return "und", 0.0
        m = margins(final, text)
        loss = [sum(trust[i][b] * math.log1p(math.exp(-codes[i][b] * m[b])) for b in bits) for i in range(n)]
        odds = [math.exp(min(loss) - x) for x in loss]
        best = loss.index(min(loss))
        return names[best], odds[best] / sum(odds)
    return decode


def test_equals_a_plain_version(spark):
    """Four languages, every document: the same label and score from dictionaries of trigrams."""
    extra = [(200 + i, " ".join(w[::-1] for w in r[1].split()[:60]), "rev", *r[3:]) for i, r in enumerate(corpus()[:25]) if r[1]]
    extra += [(300 + i, " ".join(w + w for w in r[1].split()[:50]), "dup", *r[3:]) for i, r in enumerate(corpus()[:20]) if r[1]]
    rows = [r for r in corpus() if r[1] is None or len(r[1]) < 5000] + extra
    docs = documents(spark, rows)
    fold = docs.filter(~langid.held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    taught = [(r.text, r.lang, r.k) for r in fold.select("text", "lang", (F.pmod(F.xxhash64("text"), F.lit(5)) == 0).alias("k")).collect()]
    decode = plain_model(taught)
    got = langid.predict(docs, langid.fit_on_fold(docs)).select("row.text", "lang_pred", "score").distinct().collect()
    assert {r.lang_pred for r in got} == {"en", "fr", "rev", "dup", "und"}
    for r in got:
        label, score = decode(r.text)
        assert r.lang_pred == label and abs(r.score - score) < 1e-9
