from collections import Counter

import pyarrow as pa

from candela.llm import substring
from candela.llm.common import word_hashes

from .helpers import SCHEMA, corpus, documents, words


def brute(texts, window):
    w = [words(t) for t in texts]
    met = Counter(tuple(x[i:i + window]) for x in w for i in range(len(x) - window + 1))
    out = []
    for x in w:
        gone = set()
        for i in range(len(x) - window + 1):
            if met[tuple(x[i:i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(x), len(gone), " ".join(v for i, v in enumerate(x) if i not in gone)))
    return out


def check(spark, docs, rows, **how):
    got = substring.remove_repeats(docs, **how).select("row.doc_id", "row.`odd name.x`", "n_words", "n_removed", "kept_text").collect()
    want = [(r[0], r[-1], *b) for r, b in zip(rows, brute([r[1] for r in rows], how["window"]))]
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_matches_brute_force(spark):
    rows = corpus()
    check(spark, documents(spark), rows, window=35)


def test_short_windows_and_tiny_sketch(spark):
    """Everything collides in the sketch and the place bits; results stay exact."""
    rows = [r for r in corpus() if r[0] != 76]
    check(spark, documents(spark, rows), rows, window=5, gram=2, bits=17)


def test_periodic_and_shifted_texts(spark):
    base = [f"w{i}" for i in range(90)]
    texts = [" ".join(base), " ".join(base[20:70]), " ".join(["x"] * 50), " ".join(["p", "q", "r"] * 30), " ".join(base[:34]),
             " ".join([*base[:40], "new", *base[40:]])]
    rows = [(i, t, None, None, None, None, None, None, None, None, None, 7) for i, t in enumerate(texts)]
    check(spark, documents(spark, rows), rows, window=35)


def test_very_long_text_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(substring, "_BLOCK", 500)
    texts = pa.array([" ".join(f"a{i % 997}" for i in range(3000)), "short", None, " ".join(f"b{i}" for i in range(1500))])
    pieces = list(substring._blocks(texts, 35))
    assert max(len(w) for w, *_ in pieces) <= 534
    starts = Counter((int(r[0]), int(o[0]) + i) for w, s, r, o in pieces for i in range(len(w) - 34))
    assert set(starts.values()) == {1} and len(starts) == 3000 - 34 + 1500 - 34


def test_drop_repeats_keeps_columns(spark):
    docs = documents(spark)
    out = substring.drop_repeats(docs)
    assert out.columns == docs.columns
    brute_out = brute([r[1] for r in corpus()], 35)
    assert out.count() == sum(1 for n, gone, _ in brute_out if gone == 0 or gone < n)
    untouched = {r[1] for r, b in zip(corpus(), brute_out) if b[1] == 0}
    assert untouched <= {r.text for r in out.select("text").collect()}


def test_empty_table(spark):
    assert substring.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_word_hashes_follow_words():
    texts = ["a b  a", None, "", "\ta\x1cb\n", "éa é", "b"]
    h, n = word_hashes(pa.array(["skip", *texts]).slice(1))
    w = [x for t in texts for x in words(t)]
    assert n.tolist() == [len(words(t)) for t in texts]
    assert len(set(zip(w, h.tolist()))) == len(set(w)) == len(set(h.tolist()))
