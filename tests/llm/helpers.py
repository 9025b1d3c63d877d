"""Fixtures and brute-force versions for the training-data operators."""

import random
import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns whose names clash with those the operators use inside.
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("row", T.StringType()),
    T.StructField("text_hash", T.IntegerType()), T.StructField("ids", T.StringType()), T.StructField("fp", T.LongType()),
    T.StructField("size", T.DoubleType()), T.StructField("lo", T.StringType()), T.StructField("odd name.x", T.LongType())])

EN = ("the of and to in is that it was for on are as with his they at be this from have or by one had not but what all were when "
      "we there can an your which their said if do will each about how up out them then she many some so these would").split()
FR = ("le de un être et à il avoir ne je son que se qui ce dans en du elle au pour pas cela par sur faire plus dire me on mon lui "
      "nous comme mais pouvoir avec tout y aller voir bien où sans tu ou leur homme si deux mari").split()


def sentence(rng, words, n):
    return " ".join(rng.choice(words) + rng.choice(["", "", "ing", "s", "x%d" % rng.randint(0, 99)]) for _ in range(n))


def corpus():
    """About 90 rows: copies, near copies, shared passages, repeated rows, nulls, empty and very long texts."""
    rng = random.Random(5)
    passage = sentence(rng, EN, 70)
    rows = []
    for i in range(60):
        lang, words = ("en", EN) if i % 3 else ("fr", FR)
        text = sentence(rng, words, rng.randint(40, 220)).replace(" the ", ". The ") + rng.choice(["", "\n", "  \n\ttail", "<|endoftext|> x"])
        if i % 7 == 0:
            text = text[:len(text) // 2] + "\n" + passage + "\n" + text[len(text) // 2:]
        rows.append([i, text, lang, f"s{i % 4}"])
    for i in range(60, 70):                                        # copies, exact and near
        text = rows[i % 5][1]
        rows.append([i, text if i % 2 else text + " end", "en", "s0"])
    rows += [[70, None, None, None], [71, "", "en", "s1"], [72, " \t\n", None, "s1"], [73, "Word", "en", None],
             [None, rows[3][1], "en", "s2"], [None, None, "fr", "s2"], [74, "1234 ++ 99", "en", "s3"],
             [75, "MIT License. mit  license; Apache License, Version 2.0 GNU General Public License v3 mit licenses", "en", "s3"],
             [76, sentence(rng, EN, 60000), "en", "s3"], [77, "日本語のテキスト " * 40 + "été", None, "s1"], [78, "a b " * 300, "en", "s1"]]
    rows += [list(rows[8]), list(rows[8]), list(rows[70]), [rows[9][0], rows[10][1], "en", "s1"]]
    return [(*r, len(r[1]) if r[1] is not None else None, "r", 1, "i", 2, 0.5, "lo", 7) for r in rows]


def documents(spark, rows=None):
    return spark.createDataFrame(corpus() if rows is None else rows, SCHEMA).repartition(5)


def words(text):
    return WORD.findall(text or "")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
