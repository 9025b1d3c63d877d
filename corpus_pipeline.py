"""Corpus pipeline: from raw documents to token ids, stage by stage.

Each stage is one operator of ``candela.llm``, takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
stage's documents. Stages up to the last keep the columns of ``documents``:

1. language_id: rows whose language is undetermined or ambiguous go.
2. simhash_near_dedup: one document of each near-duplicate class stays.
3. substring_dedup: words of repeated 35-word windows are taken out of the
   texts; a document left without a word goes, unless it had none before.
4. source_mixing: every document is repeated as often as the mix takes it.
5. bpe_encoding: token ids of every row, with the decoded text's digest.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm import bpe, langid, mixing, simhash, substring
from candela.llm.common import prepare
from candela.session import shared_path

TOKENIZER = "byte_bpe_50k.json"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return langid.keep_identified(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return simhash.drop_near_duplicates(docs, shingle=4, max_bits=4)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    left = substring.drop_repeats(docs, window=35)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return mixing.take_copies(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    path = public_tokenizers.path(TOKENIZER)
    return (bpe.encode_documents(docs, path, decode=True)
            .select("row.doc_id", "row.source", "row.lang", F.size("ids").cast("long").alias("n_tokens"), "ids",
                    F.sha2("decoded", 256).alias("decoded_sha256")))


STAGES = [("language_id", language_id), ("simhash_near_dedup", simhash_near_dedup), ("substring_dedup", substring_dedup),
          ("source_mixing", source_mixing), ("bpe_encoding", bpe_encoding)]

#: SQL cannot express the classifier, the fingerprints or the encoder; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the table lies in the shared checkpoint folder."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"pipeline_{name}_{uuid.uuid4().hex[:12]}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
