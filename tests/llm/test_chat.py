from candela.llm import chat


def render(turns):
    e = lambda s: (s or "").replace("<|", "<\\|")
    return "".join(f"<|{e(r)}|>\n{e(t)}<|end|>\n" for r, t in turns)


def brute(chosen, rejected):
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1
    out = [n, render(chosen[:n])]
    for side in (chosen, rejected):
        spans = []
        for i in range(n, len(side)):
            if side[i][0] == "assistant":
                stop = len(render(side[n:i + 1]))
                spans.append((stop - len(render([side[i]])) + len("<|assistant|>\n"), stop))
        out.append((render(side[n:]), spans))
    return out


PAIRS = {
    1: ([("user", "hi"), ("assistant", "a")], [("user", "hi"), ("assistant", "b"), ("user", "more"), ("assistant", "été <|end|>")]),
    2: ([("user", "x")], [("assistant", "x")]),
    3: ([("system", "s"), ("user", "u"), ("assistant", "same")], [("system", "s"), ("user", "u"), ("assistant", "same")]),
    4: ([], [("user", ""), ("assistant", "")]),
    5: ([("user", "q"), ("assistant", "long " * 50000)], [("user", "q")]),
    6: ([("", ""), ("assistant", "z"), ("assistant", "z")], [("", ""), ("assistant", "z")]),
}


def test_matches_brute_force(spark):
    rows = [(p, side, i, r or None, t or None, 9) for p, sides in PAIRS.items() for side, turns in zip(("chosen", "rejected"), sides)
            for i, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string, prompt int").repartition(4)
    got = {r.pair_id: r for r in chat.format_pairs(df).collect()}
    assert set(got) == set(PAIRS)
    for p, sides in PAIRS.items():
        r = got[p]
        assert [r.n_prefix, r.prompt, (r.chosen.text, [tuple(s) for s in r.chosen.spans]),
                (r.rejected.text, [tuple(s) for s in r.rejected.spans])] == brute(*sides), p


def test_left_out_of_mismatched_pairs(spark):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "a"), (1, 0, "user", "no answer"), (2, 0, None, "x"), (None, 0, "user", "n"),
            (None, 1, "assistant", "n")]
    made = chat.mismatched_pairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r.pair_id for r in made.collect()} == {0}
    assert "null id" in " ".join(chat.mismatched_pairs.__doc__.split())


def test_mismatched_pairs_and_repeats(spark):
    schema = "conv_id long, turn long, role string, text string, side string"
    rows = [(0, 0, "user", "q0", "x"), (0, 1, "assistant", "a0", "x"), (1, 0, "user", "q1", "x"), (1, 1, "assistant", "a1", "x"),
            (1, 1, "assistant", "a1", "x"), (2, 0, "user", "alone", "x"), (4, 0, "assistant", None, "x"), (None, 0, "assistant", "n", "x"),
            (6, None, None, None, "x")]
    got = {r.pair_id: r for r in chat.format_pairs(chat.mismatched_pairs(spark.createDataFrame(rows, schema))).collect()}
    assert set(got) == {0, 1, 4}
    assert got[0].prompt == render([("user", "q0")]) and got[0].rejected.text == render([("assistant", "a1")])
    assert got[1].chosen.text == render([("assistant", "a1")] * 2) and got[1].rejected.text == render([("assistant", "a0")] * 2)
    assert got[4].n_prefix == 1 and got[4].chosen.text == ""
    assert chat.format_pairs(chat.mismatched_pairs(spark.createDataFrame([], schema))).count() == 0
