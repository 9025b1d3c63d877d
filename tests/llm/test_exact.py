import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from candela.llm import exact
from candela.session import shared_path
from tests.llm.helpers import SCHEMA, corpus, documents


def brute(rows, normalise=lambda t: t):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[normalise(text or "")].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, left = max(known, default=None), 1
        for i in ids:
            out.append((i, keep, len(ids), i == keep and left == 1, hashlib.sha256(text.encode()).hexdigest()))
            left -= i == keep
    return sorted(out, key=str)


def run(df, path, **how):
    done = exact.exact_duplicates(df, path, **how)
    return sorted((tuple(r) for r in done.select("doc_id", "keep_id", "group_size", "kept", exact.hex_digest(F.col("digest"))).collect()), key=str)


@pytest.fixture()
def path(spark, request):
    import uuid
    return shared_path(spark, f"test_index_{uuid.uuid4().hex[:8]}")


@pytest.mark.parametrize("batches", [1, 3])
def test_matches_brute_force(spark, path, batches):
    assert run(documents(spark), path, batches=batches) == brute(corpus())


def test_normalised_texts_and_extreme_ids(spark, path):
    rows = [(2 ** 63 - 1, "A"), (-2 ** 63, "a"), (5, "a "), (None, "b"), (None, "B")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(df, path, normalise=F.lower, batches=4) == brute(rows, str.lower)


def test_empty_table(spark, path):
    assert run(documents(spark, []), path) == []


def test_only_null_ids(spark, path):
    rows = [(None, "x"), (None, "x"), (None, None), (None, "")]
    assert run(spark.createDataFrame(rows, "doc_id long, text string"), path) == brute(rows)


def test_batches_meet_the_index_and_a_retry_counts_once(spark, path):
    rows = [(i, f"t{i % 7}") for i in range(20)]
    index = exact.DigestIndex(spark, path, 4)
    new = spark.createDataFrame([(100, "t1"), (101, "new"), (102, "new"), (103, None)], "doc_id long, text string")
    first = exact.add_batch(exact.digests(spark.createDataFrame(rows, "doc_id long, text string")), index, "one")
    assert sorted(r.doc_id for r in first.filter("kept").collect()) == list(range(13, 20))
    for again in range(2):
        index = exact.DigestIndex(spark, path)                     # opened anew, as another job would
        assert index.buckets == 4
        told = exact.add_batch(exact.digests(new), index, "two")
        assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in told.collect()) == [
            (100, 15, 1, False), (101, 102, 2, False), (102, 102, 2, True), (103, 103, 1, True)]
        assert index.table().count() == 9
    index.compact(2)
    index = exact.DigestIndex(spark, path)
    assert index.buckets == 2 and index.table().count() == 9
    assert exact.add_batch(exact.digests(new), index, "three").filter("kept").count() == 0


def test_the_index_is_read_by_bucket(spark, path):
    index = exact.DigestIndex(spark, path, 4)
    index.add(exact.survivors(exact.digests(documents(spark))), "a")
    index.compact()
    found = exact.survivors(exact.digests(documents(spark)))
    plan = found.join(index.table().hint("merge"), "digest", "left_anti")._jdf.queryExecution().toString()
    right = plan.split("== Physical Plan ==")[1].split("FileScan parquet spark_catalog")
    assert "SortMergeJoin" in right[0] and "Bucketed: true" in right[1]
    assert right[0].count("Exchange") == 1                          # the batch's digests only


def test_drop_known_keeps_all_columns(spark, path):
    index = exact.DigestIndex(spark, path, 2)
    kept = exact.drop_known(documents(spark), index, "a")
    assert kept.schema == SCHEMA
    want = sorted((r[0], r[4]) for r in brute(corpus()) if r[3] and r[0] is not None)
    got = sorted((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in kept.filter("doc_id is not null").collect())
    assert got == want
    assert exact.drop_known(documents(spark), index, "b").count() == 0
    with pytest.raises(ValueError):
        index.add(exact.survivors(exact.digests(documents(spark))), "no/folder")
