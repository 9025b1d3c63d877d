"""Exact deduplication against a persistent digest index.

The index is a Parquet table in a shared folder: one row per distinct text
(SHA-256 digest, the id that stays), bucketed and sorted by the digest, one
partition per batch that was added. A batch is deduplicated in three steps:

1. Texts become digests, counted per digest with a partial aggregate, so a text
   that makes up a third of the batch is one row a task before it is shuffled.
2. A sort-merge anti-join with the index leaves the digests it does not know.
   The index is read by bucket, so only the batch's digests move.
3. What is left is written as the batch's partition of the index, again by
   bucket. A retried batch ignores and overwrites its own partition, so a batch
   counts once however often it is run.

Texts never move: only digests, ids and counts are shuffled. ``compact`` merges
the batches into one sorted file per bucket and may change the number of buckets.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm.common import cut

#: Digests per bucket aimed at: about 64 MB of index.
BUCKET_ROWS = 1 << 20


class DigestIndex:
    """Digests of texts seen so far: (digest binary, keep_id long, batch string) under ``path``.

    ``path`` lies in storage that all executors share. An index that exists is
    opened with the buckets it was made with; ``buckets`` counts for a new one only.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.root = spark, path.rstrip("/")
        try:
            state = spark.read.schema("version string, buckets int, serial long").json(f"{self.root}/state").orderBy(F.desc("serial")).head()
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            state = None
        if state:
            self.version, self.buckets, self.serial = state
            self._open()
            self.spark.sql(f"MSCK REPAIR TABLE {self.name}")
        else:
            self.serial = -1
            self._create(buckets)
            self._publish()

    def _create(self, buckets: int) -> None:
        self.version, self.buckets = f"v{uuid.uuid4().hex[:12]}", max(1, buckets)
        self._open()
        # An empty batch, so that the folder is there to be read and listed.
        self.spark.sql(f"""INSERT OVERWRITE TABLE {self.name} PARTITION (batch = 'none')
                           SELECT CAST(NULL AS BINARY), CAST(NULL AS BIGINT) WHERE false""")

    def _open(self) -> None:
        """Name the files as a table, so that Spark knows their buckets."""
        self.name = f"candela_digests_{self.version}"
        self.spark.sql(f"""CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet
                           PARTITIONED BY (batch) CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS
                           LOCATION '{self.root}/{self.version}'""")

    def _publish(self) -> None:
        """Make the current files the ones that the next opening finds."""
        self.serial += 1
        (self.spark.createDataFrame([(self.version, self.buckets, self.serial)], "version string, buckets int, serial long")
         .coalesce(1).write.mode("append").json(f"{self.root}/state"))

    def table(self) -> DataFrame:
        """(digest, keep_id, batch), read by bucket."""
        return self.spark.table(self.name)

    def files(self) -> DataFrame:
        """The same rows as plain files, for joins whose other side holds hot keys: both sides are exchanged, and skew is split."""
        return self.spark.read.schema("digest binary, keep_id long, batch string").parquet(f"{self.root}/{self.version}")

    def add(self, found: DataFrame, batch: str) -> DataFrame:
        """Append the digests of ``found`` (digest unique, keep_id) that no other batch holds; returns what was appended."""
        if not batch or not batch.replace("_", "").isalnum():
            raise ValueError("a batch is named by letters, digits and underscores")
        others = self.table().filter(F.col("batch") != batch).select("digest")
        self._insert(found.select("digest", "keep_id").join(others.hint("merge"), "digest", "left_anti"), batch)
        return self.table().filter(F.col("batch") == batch).select("digest", "keep_id")

    def _insert(self, rows: DataFrame, batch: str) -> None:
        """Overwrite the partition ``batch``, and no other, while the others may be read."""
        view, mode = f"candela_{uuid.uuid4().hex[:12]}", "spark.sql.sources.partitionOverwriteMode"
        was = self.spark.conf.get(mode)
        rows.createOrReplaceTempView(view)
        self.spark.conf.set(mode, "dynamic")
        try:
            self.spark.sql(f"INSERT OVERWRITE TABLE {self.name} PARTITION (batch) SELECT digest, keep_id, '{batch}' FROM {view}")
        finally:
            self.spark.conf.set(mode, was)
            self.spark.catalog.dropTempView(view)

    def compact(self, buckets: int | None = None) -> None:
        """Rewrite all batches as one, a sorted file a bucket; the old files stay until the caller deletes them."""
        old = self.files().select("digest", "keep_id")
        self._create(buckets or self.buckets)
        self._insert(old.repartition(self.buckets, "digest"), f"compact_{self.version}")
        self._publish()


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=None) -> DataFrame:
    """(doc_id, digest, rid) per row, written: rid tells rows apart. ``normalise`` maps the text column (default: no change)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return cut(docs.select(F.col(id_col).cast("long").alias("doc_id"),
                           F.unhex(F.sha2(normalise(text) if normalise else text, 256)).alias("digest"),
                           F.monotonically_increasing_id().alias("rid")), "exact_digests")


def survivors(rows: DataFrame) -> DataFrame:
    """(digest, keep_id, keep_rid, n): the row with the largest id of each digest; null ids only if there is no other."""
    return rows.groupBy("digest").agg(
        F.max("doc_id").alias("keep_id"), F.coalesce(F.max_by("rid", "doc_id"), F.min("rid")).alias("keep_rid"),
        F.count(F.lit(1)).alias("n"))


def add_batch(rows: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """Deduplicate ``rows`` (of ``digests``) against ``index`` and append what is new.

    Returns (doc_id, rid, digest, keep_id, group_size, kept) per row. keep_id is the id
    that stays, from this batch or an earlier one; group_size counts the batch's rows of
    that text; kept marks the one row that stays, none if an earlier batch has the text.
    """
    best = cut(survivors(rows), "exact_survivors")
    index.add(best, batch)
    # The index is asked again: it answers with the id of whichever batch came first.
    held = best.join(index.files().select("digest", F.col("keep_id").alias("held"), F.col("batch").alias("_batch")), "digest")
    told = cut(held.select("digest", F.col("held").alias("keep_id"), F.col("n").alias("group_size"),
                           F.when(F.col("_batch") == batch, F.col("keep_rid")).alias("keep_rid")), "exact_decisions")
    return rows.join(told, "digest").select("doc_id", "rid", "digest", "keep_id", "group_size",
                                            F.coalesce(F.col("rid") == F.col("keep_rid"), F.lit(False)).alias("kept"))


def exact_duplicates(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", normalise=None,
                     batches: int = 2) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest. Of equal texts the largest id stays.

    The documents go into a new index at ``path`` in ``batches`` ranges of falling
    ids, so that what the index knows always has the larger id. Null texts are
    empty texts. Null ids come last: one stays only in a text without any id, with
    keep_id null. Of rows sharing the largest id and the text one stays. Empty
    tables give no rows; other columns take no part.
    """
    rows = digests(docs, id_col, text_col, normalise)
    low, high, n = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
    index = DigestIndex(docs.sparkSession, path, -(-n // BUCKET_ROWS))
    step = max(1.0, (float(high) - float(low) + 1) / batches) if high is not None else 1.0
    fall = F.floor((F.lit(float(high or 0)) - F.col("doc_id").cast("double")) / step)      # never falls as ids fall
    number = F.coalesce(F.least(fall, F.lit(batches - 1)), F.lit(batches - 1))
    for b in range(batches):
        index.add(survivors(rows.filter(number == b)), f"b{b}")
    best = survivors(rows)
    held = index.files().select("digest", F.col("keep_id").alias("held"))
    told = cut(best.join(held, "digest").select("digest", F.col("held").alias("keep_id"), "keep_rid", F.col("n").alias("group_size")),
               "exact_decisions")
    return rows.join(told, "digest").select("doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), "digest")


def drop_known(docs: DataFrame, index: DigestIndex, batch: str, id_col: str = "doc_id", text_col: str = "text",
               normalise=None) -> DataFrame:
    """Rows of ``docs``, all columns, whose text neither ``index`` nor another kept row of the batch holds."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut(docs.select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("rid"),
                           F.unhex(F.sha2(normalise(text) if normalise else text, 256)).alias("digest")), "exact_rows")
    kept = add_batch(rows.select("doc_id", "digest", "rid"), index, batch).filter("kept").select("rid")
    return rows.join(kept, "rid", "left_semi").select("_row.*")


def hex_digest(digest: Column) -> Column:
    return F.lower(F.hex(digest))
