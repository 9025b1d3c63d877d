import math
import random

import numpy as np

from candela.llm import topk

SCHEMA = "vec_id long, embedding array<float>, ids string, g int"


def brute(rows, k, every):
    ok = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, q) in enumerate(ok):
        if i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v)), j) for n, (j, v) in enumerate(ok) if n != at)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return sorted(out)


def run(spark, rows, k, every, **how):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, topk.top_k(df, f"id % {every} = 0", k, **how).collect()))


def test_matches_brute_force_over_many_blocks(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1 + (i % 9 == 0)) for _ in range(8)]) for i in range(400)]
    rows += [(1000 + i, rows[i][1]) for i in range(40)]                                # ties
    assert run(spark, rows, 7, 5, range_rows=40, block=8, group=16) == brute(rows, 7, 5)


def test_special_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, -2.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]), (6, []),
            (7, [0.5]), (8, [3e38, 3e38]), (10, [-1.0, 0.3, 9.0]), (None, [1.0, 1.0])]
    got, want = run(spark, rows, 20, 2), brute(rows, 20, 2)
    low, high = np.iinfo(np.int64).min + 2, np.iinfo(np.int64).max
    big = lambda s: min(max(s, low), high)
    small = [r for r in want if 8 not in (r[0], r[2])]
    assert [(q, c, s) for q, _, c, s in got if 8 not in (q, c)] == [(q, c, s) for q, _, c, s in small]
    assert {(q, c) for q, _, c, _ in got} == {(q, c) for q, _, c, _ in want} and all(low <= big(r[3]) <= high for r in got)


def test_empty_and_single(spark):
    assert run(spark, [], 5, 1) == [] and run(spark, [(0, [1.0])], 5, 1) == []
    assert run(spark, [(0, [1.0]), (1, [2.0])], 5, 1) == [(0, 1, 1, 64 * 128), (1, 1, 0, 64 * 128)]


def test_bounds_hold():
    rng = np.random.default_rng(0)
    q, rows = rng.integers(-50, 50, (20, 6)), rng.integers(-50, 50, (64, 6))
    b = topk.bounds(q, [rows[:32], rows[32:]])
    assert (b[:, 0] >= (q @ rows[:32].T).max(1)).all() and (b[:, 1] >= (q @ rows[32:].T).max(1)).all()


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(0, [1.0, 2.0]), (0, [2.0, 1.0]), (1, [1.0, 1.0]), (2, [3.0, 0.0]), (3, [0.0, 1.0]), (2, [3.0, 0.0])]
    got = run(spark, rows, 3, 2)
    assert got == brute(rows, 3, 2) and len(got) == 12 and (0, 0) in {(q, c) for q, _, c, _ in got}


def test_a_hot_vector(spark):
    rng = random.Random(7)
    rows = [(i, [1.0, -0.5, 2.0] if i % 3 == 0 else [rng.gauss(0, 1) for _ in range(3)]) for i in range(300)]
    assert run(spark, rows, 5, 10, range_rows=16, block=4, group=4) == brute(rows, 5, 10)


def test_pruning_before_shipping_on_clustered_vectors(spark):
    """Ranges of other clusters are not fetched, and of what is fetched most is not scored."""
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 3, (12, 16))
    rows = [(i, (centres[i % 12] + rng.normal(0, 0.15, 16)).tolist()) for i in range(2400)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA).repartition(3)
    shipped = []
    real = topk._found

    def spy(groups, ranges, pairs, k, block):
        shipped.append((pairs.count(), groups.count() * ranges.count()))
        return real(groups, ranges, pairs, k, block)

    topk._found = spy
    try:
        got = sorted(map(tuple, topk.top_k(df, "id % 20 = 0", 5, range_rows=50, block=10, group=10).collect()))
    finally:
        topk._found = real
    assert got == brute(rows, 5, 20)
    assert shipped[1][0] < 0.4 * shipped[1][1]
