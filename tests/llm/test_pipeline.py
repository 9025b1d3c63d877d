"""The stages against brute-force versions, each on its own input, and the whole run."""

import hashlib
import sys
from collections import Counter
from pathlib import Path

import public_tokenizers
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from candela.llm import langid, mixing  # noqa: E402

from .test_near_dup import brute_components, brute_fp  # noqa: E402
from .test_substring import brute  # noqa: E402


def test_stages_one_by_one(spark, sf):
    from tokenizers import Tokenizer
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    key = sorted(docs.columns)
    rows = lambda df: Counter(map(tuple, df.select(*key).collect()))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "substring_dedup", "source_mixing", "bpe_encoding"]
    stages = dict(corpus_pipeline.STAGES)

    one = stages["language_id"](spark, docs, sf)
    verdict = langid.predict(docs, langid.fit_on_fold(docs)).filter("lang_pred <> 'und' and not ambiguous").select("row.*")
    assert one.schema == docs.schema and rows(one) == rows(verdict) and one.count() >= 0.98 * docs.count()

    two = stages["simhash_near_dedup"](spark, one, sf)
    fps = {r.doc_id: brute_fp(r.text) for r in one.collect()}
    comp = brute_components(fps.values(), 4)
    keep = Counter()
    low = {}
    for i, f in fps.items():
        low[comp[f]] = min(low.get(comp[f], i), i)
    keep = set(low.values())
    assert rows(two) == Counter(tuple(r) for r in one.select(*key).collect() if r.doc_id in keep)

    three = stages["substring_dedup"](spark, two, sf)
    before = two.collect()
    want = Counter()
    for r, (n, gone, left) in zip(before, brute([r.text for r in before], 35)):
        if not gone or gone < n:
            text = left if gone else r.text
            want[tuple((r.asDict() | {"text": text, "n_chars": len(text)})[c] for c in key)] += 1
    assert set(three.columns) == set(docs.columns) and rows(three) == want

    four = stages["source_mixing"](spark, three, sf)
    mixed = mixing.mix(three).select("row.*", "copies").filter("copies > 0").collect()
    assert rows(four) == Counter({tuple(r[c] for c in key): r.copies for r in mixed})

    five = stages["bpe_encoding"](spark, four, sf).collect()
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    want = Counter((r.doc_id, tuple(library.encode(r.text, add_special_tokens=False).ids), hashlib.sha256(r.text.encode()).hexdigest())
                   for r in four.collect())
    assert Counter((r.doc_id, tuple(r.ids), r.decoded_sha256) for r in five) == want and all(r.n_tokens == len(r.ids) for r in five)


def test_run_equals_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    names = ["doc_id", "n_tokens", "decoded_sha256"]
    assert sorted(map(tuple, docs.select(names).collect())) == sorted(map(tuple, corpus_pipeline.run(spark, sf).select(names).collect()))


def test_empty_documents(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").filter(F.lit(False)).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
