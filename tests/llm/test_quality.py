import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from candela.llm import quality

from .helpers import SCHEMA, corpus, documents, words


def brute(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    met = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    inside = set()
    for i in range(len(w) - 7):
        if met[tuple(w[i:i + 8])] > 1:
            inside.update(range(i, i + 8))
    n = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside))
    return (*n, n[0] < 20 or 100 * n[4] > 30 * n[0])


def test_counts_match_brute_force(spark):
    extra = ["a b\na b\n\na b \n a\x0bb", "# * $ % & | < > a", "x " * 8, "x " * 9, "p q r s t u v w " * 3, "é" * 30 + "\x85 \xa0 b"]
    rows = corpus() + [(100 + i, t, "en", "s", 1, "r", 1, "i", 2, 0.5, "l", 7) for i, t in enumerate(extra)]
    got = quality.measures(documents(spark, rows)).select("row.doc_id", *quality.COUNTS, "base_failed").collect()
    want = [(r[0], *brute(r[1])) for r in rows]
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_binomial_tail_is_exact():
    for n, p in ((5, 0.3), (60, 0.05)):
        for k in range(n + 1):
            want = sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1))
            assert quality.binomial_tail(k, n, p) == pytest.approx(want)


def test_choose_needs_evidence():
    assert quality.choose([0, 0], [5, 9], 10, 10, 0.05, 0.05) is None             # 0.95^10 > 0.05
    assert quality.choose([0, 0, 50], [5, 9, 10], 1000, 10, 0.05, 0.05) == 1      # 50 of 1000 are not certified
    assert quality.choose([0, 0], [0, 0], 1000, 10, 0.05, 0.05) is None           # nothing bad is caught
    assert quality.choose([60, 0], [10, 10], 1000, 10, 0.05, 0.05) is None        # testing stops at the first failure
    assert quality.choose([], [], 0, 0, 0.05, 0.05) is None


def _measured(spark, rows):
    """(stratum, symbol_share, good) as measured rows; the other rules hold nothing against them."""
    df = spark.createDataFrame(rows, "stratum string, symbol_share double, good boolean")
    return df.withColumns({r: F.lit(0.0) for r in quality.GRID if r != "symbol_share"} | {"base_failed": F.lit(False)})


def test_thresholds_hold_the_risk_per_stratum(spark):
    rows = [("a", 0.0, True)] * 2000 + [("a", 0.4, False)] * 100 + [("b", 0.4, True)] * 300 + [("b", 0.0, True)] * 1700 \
        + [("b", 0.4, False)] * 100 + [("c", 0.0, True)] * 5 + [("c", 0.4, False)] * 5 + [(None, 0.0, True)] * 2000 + [(None, 0.4, False)] * 9
    m = _measured(spark, rows)
    cut = quality.thresholds(m, m, F.col("stratum"))
    got = {(r.stratum, r.rule) for r in cut.collect()}
    assert got == {(s, r) for s in ("a", None) for r in quality.GRID}             # b would lose 15 % of its good, c has too few
    done = quality.judge(m, cut, F.col("stratum"))
    lost = {r.stratum: r.n for r in done.filter("not kept").groupBy("stratum").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert lost == {"a": 100, None: 9} and done.count() == len(rows)


def test_a_small_stratum_of_four_is_certified(spark):
    rows = [(s, 0.0, True) for s in "abcd" for _ in range(90 if s != "d" else 80)] + [(s, 0.4, False) for s in "abcd" for _ in range(5)]
    m = _measured(spark, rows)
    assert {r.stratum for r in quality.thresholds(m, m, F.col("stratum")).collect()} == {"a", "b", "c"}


def test_levels_are_nested_and_joint(spark):
    """A text's level is the first whose cutoffs reject it by any rule."""
    import random
    rng = random.Random(2)
    rows = [tuple(rng.choice([0.0, rng.random(), 1.0]) if r in rng.sample(list(quality.GRID), 2) else 0.0 for r in quality.GRID) for _ in range(300)]
    df = spark.createDataFrame(rows, ", ".join(f"{r} double" for r in quality.GRID)).withColumn("t", quality.rejected_from(F.col))
    for row in df.collect():
        hit = [any(row[r] > quality.cutoff_at(r, t) for r in quality.GRID) for t in range(quality.LEVELS)]
        assert hit == sorted(hit) and row.t == (hit.index(True) if True in hit else quality.LEVELS)


def test_empty_and_unlabelled(spark):
    none = quality.measures(spark.createDataFrame([], SCHEMA))
    assert none.count() == 0
    m = quality.measures(documents(spark))
    cut = quality.thresholds(m, m.withColumn("good", F.lit(True)).filter("1 = 0"), F.col("row.lang"))
    done = quality.judge(m, cut, F.col("row.lang"))
    assert cut.count() == 0 and done.filter("kept = base_failed").count() == 0 and done.count() == len(corpus())
