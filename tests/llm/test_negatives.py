import math
import random

import numpy as np
import pytest

from candela.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, rid string, g int, low long"


def brute(rows, every, positives=5, k=10, window=(30, 90)):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v], c) for i, v, c in rows
          if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, q, label) in enumerate(ok):
        if i % every:
            continue
        score = [(-sum(a * b for a, b in zip(q, v)), j, c) for n, (j, v, c) in enumerate(ok) if n != at]
        for p, j, c in sorted(s for s in score if s[2] == label)[:positives]:
            inside = sorted((s, x) for s, x, y in score if y != label and window[0] * -p <= 100 * -s <= window[1] * -p)
            out += [(i, j, r + 1, x, -p, -s) for r, (s, x) in enumerate(inside[:k])]
    return sorted(out)


def run(spark, rows, every, **how):
    df = spark.createDataFrame([(i, v, c, "x", 1, 2) for i, v, c in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, negatives.hard_negatives(df, f"id % {every} = 0", **how).collect()))


def clustered(n=400, seed=3):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(6)]
    return [(i, [x + rng.gauss(0, 0.3) for x in centres[i % 6]], (i * 7 + (i % 5 == 0)) % 4) for i in range(n)]


@pytest.mark.parametrize("group, block", [(5, 16), (64, 4096)])
def test_matches_brute_force(spark, group, block):
    rows = clustered()
    rows += [(1000 + i, rows[i][1], rows[i][2]) for i in range(40)]                       # ties
    rows += [(2000 + i, rows[0][1], 1) for i in range(150)]                               # one vector a quarter of the rows
    assert run(spark, rows, 10, group=group, block=block) == brute(rows, 10)


def test_special_rows(spark):
    rows = clustered(60)
    rows += [(0, rows[0][1], rows[0][2]), (10, rows[3][1], 2), (20, None, 1), (30, rows[1][1], None), (None, rows[1][1], 0),
             (40, [1.0, None], 0), (50, [float("nan")], 0), (70, [], 9), (80, [0.5], 0), (90, [-1.0] * 20, 3), (100, [0.0] * 12, 2)]
    assert run(spark, rows, 10, group=3, block=8) == brute(rows, 10)


def test_huge_components(spark):
    rows = [(0, [3e38, 1.0], 0), (1, [1.0, 2.0], 0), (2, [0.5, 0.5], 1), (3, [0.0, 2.0], 1), (4, [0.0, 3.0], 0), (100, [0.0, 1.0], 0)]
    got, want = run(spark, rows, 100), brute(rows, 100)
    small = lambda r: r[0] == 100 and r[1] != 0
    assert [r for r in got if small(r)] == [r for r in want if small(r)] != []


def test_empty_and_lonely(spark):
    assert run(spark, [], 10) == []
    assert run(spark, [(1, [1.0], 0)], 10) == [] and run(spark, [(0, [1.0], 0), (1, [1.0], 1)], 10) == []
    assert run(spark, [(0, [1.0], 0), (1, [1.0], 0), (2, [0.5], 1)], 10) == [(0, 1, 1, 2, 65536, 32768)]


def test_spanning_tree_is_minimal():
    x = np.random.default_rng(1).integers(-9, 9, (40, 5))
    order, parent, edge, radius = negatives.spanning_tree(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert sorted(order) == list(range(40)) and all(p < i for i, p in enumerate(parent))
    assert np.allclose(edge[1:], [d[order[i], order[p]] for i, p in enumerate(parent)][1:])
    inside, total = {0}, 0.0                                                              # Prim from another root
    while len(inside) < 40:
        w, j = min((d[i, j], j) for i in inside for j in range(40) if j not in inside)
        total += w
        inside.add(j)
    assert math.isclose(sum(edge), total, rel_tol=1e-6) and radius >= d[order[0]].max()


def test_bounds_spare_scores_on_clustered_rows():
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 300, (8, 16))
    rows = np.concatenate([c + rng.normal(0, 6, (200, 16)) for c in centres]).astype(np.int64)
    labels = np.repeat(np.arange(8) % 4, 200)
    anchors = rows[:40]
    order, parent, edge, _ = negatives.spanning_tree(anchors)
    group = {"ids": np.arange(40)[order], "rids": np.arange(40)[order], "labels": labels[:40][order], "m": negatives.packed(anchors[order]),
             "width": 16, "parent": parent, "edge": edge}
    lists = negatives.Lists(group, None, 5, True)
    for at in range(0, len(rows), 200):
        name = np.arange(at, at + 200)
        lists.meet(name, name, labels[at:at + 200], rows[at:at + 200])
    assert lists.rescored < 0.4 * lists.seen
    found = lists.found()
    i = int(order[0])
    best = sorted((-int(rows[i] @ rows[j]), j) for j in range(len(rows)) if labels[j] == labels[i] and j != i)[:5]
    assert [(-s, j) for s, j, a in zip(found["score"], found["id"], found["i"]) if a == 0] == best
