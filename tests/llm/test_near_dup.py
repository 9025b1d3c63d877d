import xxhash
from pyspark.sql import functions as F

from candela.llm import graph, simhash

from .helpers import SCHEMA, corpus, documents, fold, words


def brute_fp(text, k=4):
    w = words(fold(text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, max_bits):
    u = sorted(set(fps))
    root = {x: x for x in u}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(u):
        for b in u[i + 1:]:
            if (a ^ b).bit_count() <= max_bits:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in u}


def test_matches_brute_force(spark):
    rows = corpus()
    got = simhash.near_duplicates(documents(spark)).select("doc_id", simhash.hex_fingerprint(F.col("fp")), "component_id").collect()
    fps = [brute_fp(r[1]) for r in rows]
    comp = brute_components(fps, 4)
    low = {}
    for r, f in zip(rows, fps):
        if r[0] is not None:
            low[comp[f]] = min(low.get(comp[f], r[0]), r[0])
    want = [(r[0], f"{f:016x}", low.get(comp[f])) for r, f in zip(rows, fps)]
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_links_random_and_hot_cells(spark):
    """Every distance from 0 to 6, with cells split into blocks (max_cell of 3)."""
    import random
    rng = random.Random(1)
    fps = set()
    for _ in range(40):
        a = rng.getrandbits(64)
        fps.add(a)
        for d in range(1, 7):
            b = a
            for bit in rng.sample(range(64), d):
                b ^= 1 << bit
            fps.add(b)
    fps |= {(1 << i) | (1 << j) for i in range(6) for j in range(6)}
    for max_bits in (0, 1, 3, 4, 6):
        want = brute_components(fps, max_bits)
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
        got = {r.node: r.root for r in graph.components(simhash.links(df, max_bits, max_cell=3)).collect()}
        groups = {}
        for x in fps:
            groups.setdefault(got.get(signed(x), signed(x)), set()).add(x)
        expected = {}
        for x in fps:
            expected.setdefault(want[x], set()).add(x)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values())), max_bits


def test_drop_keeps_one_of_each_class(spark):
    docs = documents(spark)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.schema == docs.schema
    classes = simhash.near_duplicates(docs).select("root", "component_id").distinct().collect()
    rows = kept.collect()
    assert len(rows) == len(classes)
    assert {r.doc_id for r in rows if r.doc_id is not None} == {c.component_id for c in classes if c.component_id is not None}


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(docs).count() == 0 and simhash.drop_near_duplicates(docs).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(20)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{100 + i: 100 for i in range(20)}, 200: 200, 201: 200}
