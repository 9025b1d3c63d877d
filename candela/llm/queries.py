"""Registered queries of the training-data operators and their DuckDB SQL.

Every query applies its operator to the whole table; the digest columns are
derived here from the operator's own output.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm import bpe, chat, exact, infill, langid, licenses, mixing, negatives, quality, simhash, substring, topk
from candela.llm.common import cut, prepare
from candela.session import shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


@_query
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    done = substring.remove_repeats(docs, window=35)
    return done.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_removed",
                       F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLES["op6_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, unnest(range(1, len(w) - 33)) AS s, w FROM d WHERE len(w) >= 35),
txt AS (SELECT r, s, array_to_string(w[s:s + 34], ' ') AS t FROM win),
rep AS (SELECT r, s FROM txt WHERE t IN (SELECT t FROM txt GROUP BY t HAVING count(*) > 1)),
gone AS (SELECT DISTINCT r, unnest(range(s, s + 35)) AS p FROM rep),
word AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS k, count(*) AS n
         FROM word ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""


@_query
def op1_bpe_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe.encode_documents(docs, path, decode=True)
    return done.select("row.doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@_query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return done.select(F.col("row.doc_id").alias("doc_id"), "n_bytes", "n_tokens",
                       (F.col("n_tokens") > 1024).alias("over_limit"))


@_query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit_on_fold(docs.select("doc_id", "text", "lang"))
    found = langid.predict(docs.select("doc_id", "text"), model).select("row.doc_id", "lang_pred", "score", "ambiguous")
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


@_query
def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    done = mixing.mix(docs)
    return done.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target",
                       (F.col("copies") * F.col("size")).cast("long").alias("taken"))


@_query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    measured = cut(quality.measures(docs).withColumn("doc_id", F.col("row.doc_id")), "quality")
    # A document with contradicting labels counts as unlabelled.
    labels = (_table(spark, sf_dir, "labels").filter("quality is not null").groupBy("doc_id")
              .agg(F.min("quality").alias("lo"), F.max("quality").alias("hi")).filter("lo = hi")
              .select("doc_id", (F.col("lo") == 1).alias("good")))
    stratum = F.coalesce(F.col("row.lang"), F.lit(""))
    cutoffs = quality.thresholds(measured, measured.join(labels, "doc_id"), stratum)
    done = quality.judge(measured, cutoffs, stratum)
    return done.select("doc_id", *quality.COUNTS, "base_failed", "kept", F.concat_ws(",", "failed_rules").alias("failed_rules"))


@_query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs).select("row.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels",
                                      "score")


@_query
def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, "id % 20 = 0", k=20)


ORACLES["op9_exact_topk"] = """
WITH v AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
           FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r AS qr, c.r AS cr, q.vec_id AS query_id, c.vec_id,
             CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id, cr) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@_query
def op8_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = chat.format_pairs(chat.mismatched_pairs(_table(spark, sf_dir, "conversations")))
    spans = lambda c: F.array_join(F.transform(F.col(c)["spans"], lambda s: F.concat_ws("-", s["start"], s["end"])), ";")
    return done.select(F.col("pair_id").alias("conv_id"), "n_prefix", "prompt", F.col("chosen.text").alias("chosen"),
                       spans("chosen").alias("chosen_mask"), F.col("rejected.text").alias("rejected"),
                       spans("rejected").alias("rejected_mask"))


ORACLES["op8_preference_format"] = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, max(turn) AS last FROM t WHERE role = 'assistant' GROUP BY conv_id),
r AS (SELECT t.conv_id, last, max(text) AS reply FROM t JOIN l USING (conv_id)
      WHERE role = 'assistant' AND turn = last GROUP BY ALL),
p AS (SELECT t.conv_id, t.turn, t.role, t.text AS c, CASE WHEN t.role = 'assistant' AND t.turn = r.last
             THEN coalesce(o.reply, '') ELSE t.text END AS j
      FROM t JOIN r USING (conv_id) LEFT JOIN r o ON o.conv_id = xor(t.conv_id, CAST(1 AS BIGINT))),
s AS (SELECT conv_id, 'c' AS side, turn, role, c AS text FROM p UNION ALL SELECT conv_id, 'j', turn, role, j FROM p),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, side ORDER BY turn, role, text) AS i,
             '<|' || replace(role, '<|', '<\|') || '|>' || chr(10) || replace(text, '<|', '<\|') || '<|end|>' || chr(10) AS x,
             length(replace(role, '<|', '<\|')) + 5 AS h FROM s),
d AS (SELECT a.conv_id, CAST(coalesce(min(a.i) FILTER (a.role <> b.role OR a.text <> b.text) - 1, count(*)) AS INTEGER) AS n_prefix
      FROM n a JOIN n b ON a.conv_id = b.conv_id AND a.i = b.i AND a.side = 'c' AND b.side = 'j' GROUP BY a.conv_id),
e AS (SELECT n.*, n_prefix, i > n_prefix AS after,
             sum(CASE WHEN i > n_prefix THEN length(x) ELSE 0 END) OVER (PARTITION BY conv_id, side ORDER BY i) AS stop
      FROM n JOIN d USING (conv_id))
SELECT conv_id, n_prefix,
       coalesce(string_agg(x, '' ORDER BY i) FILTER (side = 'c' AND NOT after), '') AS prompt,
       coalesce(string_agg(x, '' ORDER BY i) FILTER (side = 'c' AND after), '') AS chosen,
       coalesce(string_agg((stop - length(x) + h)::BIGINT || '-' || stop::BIGINT, ';' ORDER BY i)
                FILTER (side = 'c' AND after AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg(x, '' ORDER BY i) FILTER (side = 'j' AND after), '') AS rejected,
       coalesce(string_agg((stop - length(x) + h)::BIGINT || '-' || stop::BIGINT, ';' ORDER BY i)
                FILTER (side = 'j' AND after AND role = 'assistant'), '') AS rejected_mask
FROM e GROUP BY conv_id, n_prefix
"""


@_query
def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    done = exact.exact_duplicates(docs, shared_path(spark, f"digest_index_{uuid.uuid4().hex[:12]}"))
    return done.select("doc_id", "keep_id", "group_size", "kept", exact.hex_digest(F.col("digest")).alias("text_sha256"))


ORACLES["op12_exact_dedup"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST, r) = 1 AS kept, sha256(t) AS text_sha256
FROM d
"""


@_query
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return infill.fill_in_middle(docs).select(
        "row.doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(infill.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLES["op13_fill_in_middle"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
x AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
             CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j,
             CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM x),
p AS (SELECT *, substring(t, 1, i) AS a, substring(t, i + 1, j - i) AS b, substring(t, j + 1) AS c FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN i END AS prefix_chars, CASE WHEN form <> 'plain' THEN j - i END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b
              ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""

@_query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.withColumn("label", moved), "id % 100 = 0")


ORACLES["op11_hard_negatives"] = """
WITH v AS (SELECT vec_id, row_number() OVER () AS r, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS ar, c.r AS cr, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
             CAST(list_sum(list_transform(list_zip(a.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v a JOIN v c ON a.r <> c.r WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id, cr) AS k FROM s WHERE same),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             CAST(row_number() OVER (PARTITION BY p.ar, p.k ORDER BY s.score DESC, s.vec_id, s.cr) AS INTEGER) AS rank
      FROM p JOIN s ON p.ar = s.ar AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score WHERE p.k <= 5)
SELECT * FROM n WHERE rank <= 10
"""
