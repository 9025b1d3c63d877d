from collections import defaultdict

import pytest

from candela.llm import mixing

from .helpers import SCHEMA, corpus, documents, words


def brute_targets(sizes, cap=3.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, rest, free = {}, float(sum(sizes.values())), set(order)
    while free:
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > cap * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = cap * sizes[s]
            rest -= target[s]
        free -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10, "d": 500}, {"é": 5, "z": 100, "Z": 1, None: 40, "": 7}, {"x": 0, "y": 3},
                                   {"one": 9}, {"a": 1, "b": 2, "c": 3, "d": 4000, "e": 1, "f": 6}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixing.mix(docs).select("row.doc_id", "row.text", "row.source", "size", "source_size", "target", "copies").collect()
    sizes = defaultdict(int)
    for r in rows:
        assert r.size == len(words(r.text)) and 0 <= r.copies <= 3
        sizes[r.source] += r.size
    want, taken = brute_targets(dict(sizes)), defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        taken[r.source] += r.size * r.copies
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(r.size for r in rows if r.source == s)
    again = mixing.mix(docs.repartition(7)).select("row.doc_id", "row.text", "copies").collect()
    assert sorted(map(tuple, again)) == sorted((r.doc_id, r.text, r.copies) for r in rows)


def test_rates_follow_the_dual(spark):
    """At the solution, capped rates meet the target of each source: checked from the cells by plain arithmetic."""
    import math
    cells = [("a", s, 3) for s in range(1, 40)] + [("b", s, 2) for s in (5, 50, 500)]
    total = {"a": sum(s * n for x, s, n in cells if x == "a"), "b": sum(s * n for x, s, n in cells if x == "b")}
    cells += [("c", 2, 400), ("c", 90000, 1)]
    total["c"] = 90800
    docs = {"a": 117, "b": 6, "c": 401}
    goal = {"a": 0.4 * total["a"], "b": 2.7 * total["b"], "c": 0.002 * total["c"]}
    c = spark.createDataFrame(cells, "source string, size long, n long")
    s = spark.createDataFrame([(k, goal[k], total[k] / docs[k]) for k in goal], "source string, target double, mean double")
    lam = {r.source: r.lam for r in mixing._rates(c, s, 3.0, 15, 1e-7).collect()}
    for k in goal:
        got = sum(n * z * min(3.0, math.exp(lam[k] * z * docs[k] / total[k])) for x, z, n in cells if x == k)
        assert got == pytest.approx(goal[k], rel=1e-5)


def test_special_rows_and_columns(spark):
    docs = documents(spark)
    rows = mixing.mix(docs, bucket_rows=2).select("row.doc_id", "row.text", "row.source", "size", "copies").collect()
    assert len(rows) == len(corpus())
    assert {r.size for r in rows if not words(r.text)} == {0} and {r.copies for r in rows if r.size == 0} == {1}
    out = mixing.take_copies(docs)
    assert out.schema == docs.schema and out.count() == sum(r.copies for r in rows)
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
