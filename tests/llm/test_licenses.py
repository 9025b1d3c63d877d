import re
from re import _parser

import pytest

from candela.llm import licenses

from .helpers import SCHEMA, corpus, documents, fold

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    """Every rule on every text without gate or keyword, suppression by comparing all pairs."""
    w = WORDS.findall(fold(text))
    norm = " " + " ".join(w) + " "
    hits = sorted((i, label) for phrase, label in licenses.BASE.items() for p in [phrase.split()]
                  for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p)
    found = sorted((m.start(), -m.end(), -r.priority, k) for k, r in enumerate(licenses.rules())
                   for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", norm))
    kept = [d for i, d in enumerate(found) if not any(e[1] <= d[1] and e[2] <= d[2] for e in found[:i])]
    rules = licenses.rules()
    base = {label for _, label in hits}
    top = max((-d[2] for d in kept), default=1 if hits else 0)
    return (len(w), len(hits), hits[0][0] if hits else None, hits[-1][0] if hits else None, ",".join(sorted(base)),
            ",".join(sorted(base | {rules[d[3]].label for d in kept})), {0: 0.0, 1: 0.4, 2: 0.7, 3: 1.0}[top],
            [(rules[d[3]].rule, d[0], -d[1]) for d in kept])


TEXTS = ["Licensed under the MIT License", "SPDX-License-Identifier: Apache-2.0 or later", "GNU Lesser General Public License v2.1, see the GNU General Public License",
         "mit license apache license mit license MIT LICENSE", "This work is licensed under CC BY-NC 4.0.", "cc by-nc-sa 4.0 / CC BY 4.0 license",
         "Permission is hereby granted, free of charge, to any person obtaining a copy of this MIT license", "All rights reserved. Copyright 2020 x",
         "Released under the terms of the Mozilla Public License, version 2.0", "you may not use this file except in compliance with the License",
         "general public license", "License", "unlicense", "Creative Commons Attribution ShareAlike License 3.0", "éMIT license été mit licenseé",
         "dedicated to the public domain", "mit x11 licence", "Redistribution and use in source and binary forms under the 3-clause BSD license", "", None]


def test_rules_are_many_and_gated():
    rules = licenses.rules()
    assert len(rules) >= 250 and len({r.rule for r in rules}) == len(rules)
    for r in rules:
        re.compile(r.pattern)


def samples(items):
    """Strings that a parsed pattern matches, every alternative and every bound of a repeat in one of them at least."""
    parts = []
    for op, arg in items:
        op = str(op)
        if op == "LITERAL":
            parts.append([chr(arg)])
        elif op == "IN":
            parts.append([chr(a if str(kind) == "LITERAL" else a[0]) if str(kind) != "CATEGORY" else "1" for kind, a in arg])
        elif op == "BRANCH":
            parts.append([x for branch in arg[1] for x in samples(branch)])
        elif op == "SUBPATTERN":
            parts.append(samples(arg[-1]))
        elif op == "MAX_REPEAT":
            low, _, body = arg
            parts.append([x * n for n in {low, low + 1} for x in samples(body)])
        else:
            assert op in ("ASSERT", "ASSERT_NOT"), op
    plain = [p[0] for p in parts]
    return ["".join(plain), *("".join([*plain[:i], x, *plain[i + 1:]]) for i, p in enumerate(parts) for x in p[1:])]


def test_gate_and_keyword_stand_in_every_match():
    gate = re.compile("|".join(licenses.GATE))
    for r in licenses.rules():
        found = [x for x in samples(_parser.parse(r.pattern)) if re.search(f"(?<= )(?:{r.pattern})(?= )", f" {x} ")]
        assert found, r.rule
        for x in found:
            assert gate.search(x) and r.keyword in f" {x} ", (r.rule, x)


def test_matches_brute_force(spark):
    texts = TEXTS + [r[1] for r in corpus()] + ["mit license " * 3000]
    rows = [(i, t, None, None, None, None, None, None, None, None, None, 7) for i, t in enumerate(texts)]
    got = licenses.scan(documents(spark, rows)).select("row.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
                                                       "detections").collect()
    assert len(got) == len(texts)
    for r in got:
        if r.doc_id == len(texts) - 1:
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.labels) == (6000, 3000, 0, 5998, "mit") and len(r.detections) == 3000
            continue
        want = brute(texts[r.doc_id])
        assert tuple(r)[1:8] == want[:7], texts[r.doc_id]
        assert [(d.rule, d.start, d.end) for d in r.detections] == want[7], texts[r.doc_id]


@pytest.mark.parametrize("text, labels", [("Licensed under the MIT License", "mit"), ("SPDX-License-Identifier: Apache-2.0", "apache"),
                                          ("under the GNU Affero General Public License", "agpl,gpl"), ("nothing here", ""),
                                          ("free for non-commercial use only", "non-commercial"),
                                          ("licensed under the GPL", "gpl"), ("licensed under the GPLv3", "gpl"), ("License: GPLv3", "gpl"),
                                          ("released under the GNU GPL v2", "gpl"), ("distributed under the terms of the LGPL v2.1+.", "lgpl"),
                                          ("Available under an MIT license", "mit"), ("is released under MPL 2.0 or Apache2", "mpl"),
                                          ("made available subject to the GNU AGPL version 3", "agpl"), ("released under the BSD", "bsd"),
                                          ("License: EPL-2.0", "epl"), ("offered under the Apache 2.0 license", "apache"),
                                          ("released under CC BY-NC 4.0", "cc-by-nc"), ("published by MIT, provided with vim", "")])
def test_labels(spark, text, labels):
    rows = [(0, text, None, None, None, None, None, None, None, None, None, 7)]
    assert licenses.scan(documents(spark, rows)).first().labels == labels


def test_no_python_and_no_shuffle(spark, capsys):
    licenses.scan(documents(spark).select("doc_id", "text")).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).count() == 0
