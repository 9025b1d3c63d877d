import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from candela.llm import infill
from tests.llm.helpers import corpus, documents


def brute(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in range(0, 32, 8))
    n = len(text)
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text, text
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b, c = text[:i], text[i:j], text[j:]
    spm = h4 % 100 < 20
    return doc_id, n, "spm" if spm else "psm", i, j - i, f"<S>{c}<P>{a}<M>{b}" if spm else f"<P>{a}<S>{c}<M>{b}", text


def run(df):
    done = infill.fill_in_middle(df)
    got = done.select("row.doc_id", "n", "form", "prefix_units", "middle_units", "output", infill.restored(F.col("output"), F.col("form")))
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_matches_brute_force(spark):
    rng = random.Random(1)
    base = corpus()
    mixed = "".join(rng.choice("aé日😀 \n<>PSM") for _ in range(200_000))
    more = [(1000 + i, rng.choice(["<P>", "x<S>", "<M", "<<P", "P>", "S><", "é" * 70000, "😀" * 40000 + "a" * 70000, mixed]), *base[0][2:])
            for i in range(60)]
    rows = [*base, *more]
    got = run(documents(spark, rows))
    assert got == sorted((brute(r[0], r[1]) for r in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    assert run(documents(spark, [])) == []


@pytest.mark.parametrize("density, kind", [(1.0, "run"), (0.3, "bitmap"), (0.01, "array")])
def test_containers_select(density, kind):
    rng = np.random.default_rng(3)
    low = np.flatnonzero(rng.random(infill.BLOCK) < density)
    held = infill.Container(low)
    assert held.kind == kind and held.card == len(low)
    assert [held.select(k) for k in range(0, len(low), 97)] == low[::97].tolist() and held.select(len(low) - 1) == low[-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "é", "日", "😀", "\n", " "]), st.integers(1, 30000)), max_size=8))
def test_boundaries_are_those_of_the_decoded_text(parts):
    text = "".join(c * n for c, n in parts)
    edges = infill.Boundaries(text.encode())
    assert len(edges) == len(text) + 1
    for k in {0, len(text), len(text) // 3, len(text) // 2}:
        assert edges.select(k) == len(text[:k].encode())


@pytest.mark.parametrize("unit, pattern", [("word", r"[^ \t\n]+[ \t\n]*|[ \t\n]+"), ("line", r"[^\n]*\n|[^\n]+$")])
def test_other_units(spark, unit, pattern):
    text = "\n\n two  words\tand é 日本 more\nend" * 4000
    edges, pieces = infill.Boundaries(text.encode(), unit), re.findall(pattern, text)
    ends = np.r_[0, np.cumsum([len(p.encode()) for p in pieces])]
    assert len(edges) == len(ends) and [edges.select(k) for k in range(0, len(ends), 101)] == ends[::101].tolist()
    done = infill.fill_in_middle(spark.createDataFrame([(i, text) for i in range(8)], "doc_id long, text string"), unit=unit)
    assert {r[0] for r in done.select(infill.restored(F.col("output"), F.col("form"))).collect()} == {text}
