"""License detection by ordered signature rules, in DataFrame functions only.

Texts are reduced to lower-case words with single spaces. A first pattern lets
only texts with a license word through; each rule then has a keyword that
must occur before its regular expression is tried. Matches are intervals
with a priority (3 identifiers and notices, 2 grants and references, 1 bare
names). A match is suppressed if an earlier one in the order (start, longest,
highest priority, rule) with the same or a higher priority contains it.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_V = r"(?: version)?(?: v?\d+(?: \d+)*)?"
_L = "licen[sc]e"
#: A version after a short name: v3, v2 1, 2 0, fused or not.
_N = r"(?: ?v ?\d+(?: \d+)*| version v?\d+(?: \d+)*|\d+(?: \d+)*)?"

#: label: (keyword, pattern of the name, words of its short identifier), in normalised words.
NAMES = {
    "0bsd": ("0bsd", "0bsd", "0bsd"),
    "aal": ("attribution assurance", f"attribution assurance {_L}", "aal"),
    "afl": ("academic free", f"academic free {_L}{_V}", r"afl(?: \d+)*"),
    "agpl": ("affero", f"affero general public {_L}{_V}", r"agpl(?: \d+)*"),
    "apache": ("apache", f"apache {_L}{_V}", r"apache(?: \d+)*"),
    "apsl": ("apple public", f"apple public source {_L}{_V}", r"apsl(?: \d+)*"),
    "artistic": ("artistic", f"artistic {_L}{_V}", r"artistic(?: \d+)*"),
    "beerware": ("beerware", f"beerware {_L}", "beerware"),
    "bittorrent": ("bittorrent", f"bittorrent open source {_L}{_V}", r"bittorrent(?: \d+)*"),
    "blueoak": ("blue oak", f"blue oak model {_L}{_V}", r"blueoak(?: \d+)*"),
    "bsd": ("bsd", f"(?:(?:2|3|4|two|three|four) clause )?bsd(?: style)? {_L}", r"bsd(?: \d clause)?"),
    "bsl": ("boost", f"boost software {_L}{_V}", r"bsl(?: \d+)*"),
    "busl": ("business source", f"business source {_L}{_V}", r"busl(?: \d+)*"),
    "cc0": ("cc0", r"cc0(?: \d+)*", r"cc0(?: \d+)*"),
    "cc-by": ("cc by", r"cc by(?! (?:nc|sa|nd)\b)(?: \d+)*", r"cc by(?! (?:nc|sa|nd)\b)(?: \d+)*"),
    "cc-by-nc": ("cc by nc", r"cc by nc(?! (?:sa|nd)\b)(?: \d+)*", r"cc by nc(?! (?:sa|nd)\b)(?: \d+)*"),
    "cc-by-nc-nd": ("cc by nc nd", r"cc by nc nd(?: \d+)*", r"cc by nc nd(?: \d+)*"),
    "cc-by-nc-sa": ("cc by nc sa", r"cc by nc sa(?: \d+)*", r"cc by nc sa(?: \d+)*"),
    "cc-by-nd": ("cc by nd", r"cc by nd(?: \d+)*", r"cc by nd(?: \d+)*"),
    "cc-by-sa": ("cc by sa", r"cc by sa(?: \d+)*", r"cc by sa(?: \d+)*"),
    "cddl": ("common development", f"common development and distribution {_L}{_V}", r"cddl(?: \d+)*"),
    "cecill": ("cecill", f"cecill(?: [bc])?(?: free software)? {_L}{_V}", r"cecill(?: [bc]|(?: \d+)*)"),
    "cpl": ("common public", f"common public {_L}{_V}", r"cpl(?: \d+)*"),
    "creative-commons": ("creative commons", f"creative commons(?: [a-z]+)* (?:{_L}|deed|dedication){_V}", "creative commons"),
    "ecl": ("educational community", f"educational community {_L}{_V}", r"ecl(?: \d+)*"),
    "elastic": ("elastic", f"elastic {_L}{_V}", r"elastic(?: \d+)*"),
    "epl": ("eclipse", f"eclipse public {_L}{_V}", r"epl(?: \d+)*"),
    "eupl": ("european union", f"european union public {_L}{_V}", r"eupl(?: \d+)*"),
    "fdl": ("free documentation", f"free documentation {_L}{_V}", r"gfdl(?: \d+)*"),
    "gpl": ("general public", f"(?<!lesser )(?<!library )(?<!affero )general public {_L}{_V}", r"gpl(?: \d+)*"),
    "hpnd": ("historical permission", "historical permission notice and disclaimer", "hpnd"),
    "ibm": ("ibm public", f"ibm public {_L}{_V}", r"ipl(?: \d+)*"),
    "isc": ("isc", f"isc {_L}", "isc"),
    "jpeg": ("independent jpeg", f"independent jpeg group {_L}", "ijg"),
    "json": ("json", f"json {_L}", "json"),
    "lgpl": ("general public", f"(?:lesser|library) general public {_L}{_V}", r"lgpl(?: \d+)*"),
    "llama": ("llama", f"llama(?: \\d+)* community {_L}", r"llama(?: \d+)*"),
    "lppl": ("latex project", f"latex project public {_L}{_V}", r"lppl(?: \d+)*"),
    "mit": ("mit", f"mit(?: x11)? {_L}", "mit"),
    "mpl": ("mozilla", f"mozilla public {_L}{_V}", r"mpl(?: \d+)*"),
    "ms-pl": ("microsoft public", f"microsoft public {_L}", "ms pl"),
    "ms-rl": ("microsoft reciprocal", f"microsoft reciprocal {_L}", "ms rl"),
    "ncsa": ("ncsa", f"(?:university of illinois )?ncsa(?: open source)? {_L}", "ncsa"),
    "odbl": ("open database", f"open database {_L}{_V}", r"odbl(?: \d+)*"),
    "odc-by": ("open data commons", f"open data commons attribution {_L}{_V}", r"odc by(?: \d+)*"),
    "ofl": ("open font", f"(?:sil )?open font {_L}{_V}", r"ofl(?: \d+)*"),
    "openssl": ("openssl", f"openssl {_L}", "openssl"),
    "osl": ("open software", f"open software {_L}{_V}", r"osl(?: \d+)*"),
    "php": ("php", f"php {_L}{_V}", r"php(?: \d+)*"),
    "postgresql": ("postgresql", f"postgresql {_L}", "postgresql"),
    "psf": ("python software", f"python software foundation {_L}{_V}", r"psf(?: \d+)*"),
    "qpl": ("q public", f"q public {_L}{_V}", r"qpl(?: \d+)*"),
    "rail": ("rail", f"(?:open )?rail(?: [ms])? {_L}", "openrail"),
    "sspl": ("server side", f"server side public {_L}{_V}", r"sspl(?: \d+)*"),
    "unlicense": ("unlicense", "unlicense", "unlicense"),
    "upl": ("universal permissive", f"universal permissive {_L}{_V}", r"upl(?: \d+)*"),
    "vim": ("vim", f"vim {_L}", "vim"),
    "w3c": ("w3c", f"w3c(?: software)?(?: notice and)? {_L}", "w3c"),
    "wtfpl": ("want to public", f"what the [a-z]+ you want to public {_L}", "wtfpl"),
    "zlib": ("zlib", f"zlib(?: libpng)? {_L}", "zlib"),
    "zpl": ("zope", f"zope public {_L}{_V}", r"zpl(?: \d+)*"),
}

#: (label, keyword, pattern): wording of notices and statements that name no license.
NOTICES = [
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission to use copy", "permission to use copy modify and or distribute this software for any purpose"),
    ("hpnd", "permission to use copy", "permission to use copy modify and distribute this software and its documentation"),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms"),
    ("bsd", "redistributions of source", "redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions in binary", "redistributions in binary form must reproduce the above copyright notice"),
    ("gpl", "free software you can", "(?:program|library) is free software you can redistribute it and or modify it"),
    ("gpl", "everyone is permitted", "everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("apache", "except in compliance", "you may not use this file except in compliance with the license"),
    ("mpl", "subject to the terms", f"this source code form is subject to the terms of the mozilla public {_L}"),
    ("boost", "permission is hereby granted", "permission is hereby granted free of charge to any person or organization"),
    ("unlicense", "unencumbered", "free and unencumbered software released into the public domain"),
    ("zlib", "altered source versions", "altered source versions must be plainly marked as such"),
    ("ofl", "font software", "the font software may be sold as part of a larger software package"),
    ("wtfpl", "you just do what", "you just do what the [a-z]+ you want to"),
    ("public-domain", "public domain", "(?:released|dedicated|placed) (?:in|into|to) the public domain"),
    ("public-domain", "public domain", "public domain(?: mark| dedication)"),
    ("proprietary", "all rights reserved", "all rights reserved"),
    ("proprietary", "proprietary", f"proprietary (?:software )?{_L}"),
    ("proprietary", "without permission", "may not be (?:copied|reproduced|distributed)(?: [a-z]+){0,6} without permission"),
    ("commercial", "commercial", f"commercial {_L}"),
    ("non-commercial", "commercial", f"non commercial (?:use|{_L})"),
    ("non-commercial", "research", "for research (?:use|purposes) only"),
    ("eula", "end user", f"end user {_L} agreement"),
    ("copyright", "copyright", r"copyright (?:c )?(?:19|20)\d\d"),
]

#: One of these stands in whatever a rule matches.
GATE = ("licen[sc]", "spdx", "copyright", "rights reserved", "public domain", "creative commons", "cc by", "cc0", "0bsd",
        "permission", "redistribut", "unencumbered", "altered source", "font software", "you just do what", "research",
        "non commercial", "(?:ed|available) (?:under|subject to)")


class Rule(NamedTuple):
    rule: str
    label: str
    priority: int
    keyword: str
    pattern: str


def rules() -> list[Rule]:
    """All rules in order: for every license its identifier, grants, references and bare name; then the notices.

    Grants by short name are under or subject to it: what is "published by MIT" names no license.
    """
    out = []
    granted = "(?:licensed|released|distributed|available|published|provided|covered|offered|redistributed|made available)"
    terms = "(?:the )?(?:terms (?:and conditions )?(?:of|in) )?(?:the |an? )?(?:gnu )?"
    for label, (keyword, name, short) in NAMES.items():
        worded = name if "licen[sc]e" in name or label == "unlicense" else None
        out.append(Rule(f"{label}:spdx", label, 3, "spdx", f"spdx {_L} identifier {short}(?: only| or later)?"))
        out.append(Rule(f"{label}:grant", label, 2, keyword,
                        f"{granted} (?:under|by|with|subject to) {terms}{name}(?: only| or later| or any later version)?"))
        out.append(Rule(f"{label}:granted", label, 2, " " + re.match("[a-z0-9 ]+", short)[0],
                        f"{granted} (?:under|subject to) {terms}{short}{_N}(?: {_L})?(?: only| or later| or any later version)?"))
        out.append(Rule(f"{label}:short", label, 2, "licen",
                        f"{_L}d? (?:is |under |type |id )*(?:the |an? )?(?:gnu )?{short}{_N}(?! {_L})"))
        if worded:
            out.append(Rule(f"{label}:refer", label, 2, keyword, f"(?:see|copy of|conditions of|text of) (?:the )?(?:gnu )?{name}"))
            out.append(Rule(f"{label}:name", label, 1, keyword, name))
        elif label.startswith("cc"):
            out.append(Rule(f"{label}:name", label, 1, keyword, name))
    out += [Rule(f"{label}:notice{i}", label, 3 if label not in ("copyright", "commercial", "proprietary") else 1, keyword,
                 pattern) for i, (label, keyword, pattern) in enumerate(NOTICES)]
    return out


def _matches(norm: Column, r: Column) -> Column:
    """Intervals (start, minus end, minus priority, order, label) of one rule's matches in a text."""
    pattern = F.concat(F.lit("(?<= )(?:"), r["pattern"], F.lit(")(?= )"))
    pairs = F.arrays_zip(F.split(norm, pattern).alias("gap"), F.regexp_extract_all(norm, pattern, F.lit(0)).alias("hit"))
    one = lambda at, z: F.struct(
        (at + F.length(z["gap"])).alias("start"), (-at - F.length(z["gap"]) - F.length(z["hit"])).alias("minus_end"),
        (-r["priority"]).alias("minus_priority"), r["order"].alias("order"))
    kind = "array<struct<start:int,minus_end:int,minus_priority:int,order:int>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
    return F.aggregate(
        F.filter(pairs, lambda z: z["hit"].isNotNull()), start,
        lambda a, z: F.struct((a["at"] + F.length(z["gap"]) + F.length(z["hit"])).alias("at"),
                              F.concat(a["out"], F.array(one(a["at"], z))).alias("out")),
        lambda a: a["out"])


def _running_ends(found: Column) -> Column:
    """Per interval, the largest end up to it among those of priority at least 1, 2 and 3 (prefix maximum by doubling)."""
    ends = F.transform(found, lambda d: F.struct(*[
        F.when(-d["minus_priority"] >= p, -d["minus_end"]).otherwise(-1).alias(f"p{p}") for p in (1, 2, 3)]))
    both = lambda x, y: F.struct(*[F.greatest(x[f"p{p}"], y[f"p{p}"]).alias(f"p{p}") for p in (1, 2, 3)])
    return F.aggregate(
        F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: F.pow(F.lit(2), k).cast("int")), ends,
        lambda acc, step: F.when(step >= F.size(acc), acc).otherwise(
            F.transform(acc, lambda x, i: F.when(i >= step, both(x, F.get(acc, i - step))).otherwise(x))))


def _uncovered(d: Column, ends: Column) -> Column:
    """No earlier interval of the same or a higher priority reaches the end of ``d``."""
    p = -d["minus_priority"]
    return F.when(p == 3, ends["p3"]).when(p == 2, ends["p2"]).otherwise(ends["p1"]) < -d["minus_end"]


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` as struct ``row``, with n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    ``detections``: (rule, label, priority, start, end), character positions in
    the text's words joined by single spaces, the first word at 1. labels are
    those of the detections and the base labels, sorted and comma-joined. score:
    0.4, 0.7 or 1 for the highest priority detected, 0.4 for a base phrase
    alone, 0 for nothing. Null texts have no words. Nothing moves between tasks.
    """
    table = rules()
    known = F.array(*[F.struct(F.lit(r.keyword).alias("keyword"), F.lit(r.pattern).alias("pattern"),
                               F.lit(r.priority).alias("priority"), F.lit(i).alias("order")) for i, r in enumerate(table)])
    names = F.array(*[F.lit(r.rule) for r in table])
    labels = F.array(*[F.lit(r.label) for r in table])
    norm, upper, lower = F.col("norm"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    spaces = lambda c: (F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))).cast("long")
    words = F.trim(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " "))
    rows = docs.select(F.struct("*").alias("row"), words.alias("words"))
    rows = rows.select("row", F.when(F.col("words") == "", 0).otherwise(spaces(F.col("words")) + 1).alias("n_words"),
                       F.when(F.col("words").rlike("(?i)" + "|".join(GATE)),
                              F.concat(F.lit(" "), F.translate("words", upper, lower), F.lit(" "))).alias("norm"))
    found = F.array_sort(F.flatten(F.transform(
        F.filter(known, lambda r: norm.contains(r["keyword"])), lambda r: _matches(norm, r))))
    rows = rows.select("row", "n_words", found.alias("found"),
                       *[F.split(norm, f"(?<= ){phrase}(?= )").alias(f"around{i}") for i, phrase in enumerate(BASE)])
    times = [F.coalesce(F.size(F.col(f"around{i}")) - 1, F.lit(0)) for i in range(len(BASE))]
    first = [F.when(n > 0, spaces(F.element_at(f"around{i}", 1)) - 1) for i, n in enumerate(times)]
    last = [F.when(n > 0, F.col("n_words") + 1 - spaces(F.element_at(f"around{i}", -1)) - len(phrase.split()))
            for i, (n, phrase) in enumerate(zip(times, BASE))]
    base = F.array_compact(F.array(*[F.when(n > 0, F.lit(label)) for n, label in zip(times, BASE.values())]))
    rows = rows.select("row", "n_words", "found", _running_ends(F.col("found")).alias("ends"),
                       sum(times[1:], times[0]).cast("long").alias("n_base"), F.least(*first).alias("first_word"),
                       F.greatest(*last).alias("last_word"), base.alias("base"))
    free = F.filter("found", lambda d, i: (i == 0) | _uncovered(d, F.get(F.col("ends"), i - 1)))
    detections = F.coalesce(F.transform(free, lambda d: F.struct(
        F.get(names, d["order"]).alias("rule"), F.get(labels, d["order"]).alias("label"),
        (-d["minus_priority"]).alias("priority"), d["start"].alias("start"), (-d["minus_end"]).alias("end"))),
        F.array().cast("array<struct<rule:string,label:string,priority:int,start:int,end:int>>"))
    rows = rows.select("row", "n_words", "n_base", "first_word", "last_word", "base", detections.alias("detections"))
    top = F.array_max(F.transform("detections", lambda d: d["priority"]))
    return rows.select(
        "row", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.transform("detections", lambda d: d["label"]))), ",").alias("labels"),
        F.when(top == 3, 1.0).when(top == 2, 0.7).when((top == 1) | (F.col("n_base") > 0), 0.4).otherwise(0.0).alias("score"),
        "detections")
