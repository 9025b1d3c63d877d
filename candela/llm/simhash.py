"""SimHash near-duplicates by a segment-popcount embedding.

Every fingerprint is mapped to the bit counts of short segments. The Manhattan
distance of two count vectors never exceeds the Hamming distance of the
fingerprints, so a grid range join on the count vectors finds every link:

* The 64 bits are split into G = max_bits // 3 + 1 groups of segments. If two
  fingerprints differ in at most ``max_bits`` bits, the vectors of at least
  one group lie within max_bits // G <= 2.
* Two lattice vectors within distance 2 share a grid point within distance 1
  of both. Every fingerprint is put into the cells of its vector and of the
  direct neighbours; fingerprints that meet in a cell are candidates.
* Candidates are verified by the exact bit distance. A cell returns the star
  edges of its own connected parts, at most one per member, so a large group
  of near copies never becomes all its pairs.

Equal fingerprints are one class from the start. A cell above ``max_cell``
fingerprints is split into blocks whose pairs go to separate tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.llm.common import U64, batch, cut, frugal, text_hash, texts
from candela.llm.graph import components

SEGMENT = 2
_CHUNK = 1 << 16      # hashes, or grid rows, looked at together
_ROWS = 1 << 13       # fingerprints placed on the grid together


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """64-bit SimHash of one text; no word gives zero."""
    words = text.lower().split()
    if not words:
        return 0
    k = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1][:len(words) - k + 1].tolist()
    ends = ends[k - 1:].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), _CHUNK):
        h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[at:at + _CHUNK], ends[at:at + _CHUNK])), U64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(starts), bitorder="little").view(U64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, text_hash, fp) per row; fp is the fingerprint as a signed long, null texts count as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in texts(b.column(2))], U64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))],
                                             ["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(F.col(text_col)).alias("text_hash"),
                       F.col(text_col).alias("text"))
    return rows.mapInArrow(frugal(run), "doc_id long, text_hash long, fp long")


def group_cells(fp: np.ndarray, groups: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Grid cells (row index, cell id) of uint64 fingerprints: their count vectors and, for radius > 0, the neighbours."""
    counts = np.bitwise_count((fp[:, None] >> np.arange(0, 64, SEGMENT, dtype=U64)) & U64((1 << SEGMENT) - 1))
    rows, cells = [], []
    for g, part in enumerate(np.array_split(np.arange(counts.shape[1]), groups)):
        c = counts[:, part].astype(np.int64)
        power = (SEGMENT + 1) ** np.arange(len(part), dtype=np.int64)
        base = (c * power).sum(1)
        at = [(np.arange(len(fp)), base)]
        if radius:
            for j in range(len(part)):
                for step, ok in ((1, c[:, j] < SEGMENT), (-1, c[:, j] > 0)):
                    at.append((np.flatnonzero(ok), base[ok] + step * power[j]))
        rows += [x for x, _ in at]
        cells += [x * groups + g for _, x in at]
    return np.concatenate(rows), np.concatenate(cells)


def _stars(group: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges of the connected parts of every group; ``group`` is sorted."""
    label = np.arange(len(fp))
    left, right = [], []
    i, step = np.flatnonzero(group[:-1] == group[1:]), 1
    while len(i):
        near = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= max_bits]
        left.append(near)
        right.append(near + step)
        step += 1
        i = i[i + step < len(fp)]
        i = i[group[i] == group[i + step]]
    if not left:
        return fp[:0], fp[:0]
    a, b = np.concatenate(left), np.concatenate(right)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    linked = np.flatnonzero(label != np.arange(len(fp)))
    return fp[linked], fp[label[linked]]


def links(fps: DataFrame, max_bits: int = 4, max_cell: int = 2048) -> DataFrame:
    """Edges (u, v) between distinct fingerprints ``fp`` that connect exactly what links within ``max_bits`` connect."""
    groups = max_bits // 3 + 1
    radius = 1 if max_bits // groups else 0

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy().view(U64)
            for at in range(0, len(fp), _ROWS):
                part = fp[at:at + _ROWS]
                row, cell = group_cells(part, groups, radius)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(part[row].view(np.int64))], ["cell", "fp"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge = {"u": pa.int64(), "v": pa.int64()}
        held: list[np.ndarray] = [np.empty((4, 0), np.int64)]
        n = 0

        def done(rows: np.ndarray) -> pa.RecordBatch:
            new = np.r_[True, (rows[:3, 1:] != rows[:3, :-1]).any(0)]
            u, v = _stars(np.cumsum(new), rows[3].view(U64), max_bits)
            pairs = np.unique(np.stack([u, v]), axis=1)
            return batch(edge, {"u": pairs[0].view(np.int64), "v": pairs[1].view(np.int64)})

        for b in batches:
            held.append(np.stack([b.column(i).to_numpy() for i in range(4)]))
            n += b.num_rows
            if n >= _CHUNK:
                rows = np.concatenate(held, axis=1)
                last = (rows[:3] != rows[:3, -1:]).any(0)
                keep = np.flatnonzero(last)[-1] + 1 if last.any() else 0
                if keep:
                    yield done(rows[:, :keep])
                held, n = [rows[:, keep:]], rows.shape[1] - keep
        rows = np.concatenate(held, axis=1)
        if rows.shape[1]:
            yield done(rows)

    placed = fps.select("fp").mapInArrow(frugal(cells), "cell long, fp long")
    large = (placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_cell)
             .select("cell", F.ceil(F.col("n") / max_cell).cast("int").alias("k")))
    own = F.expr("cast(pmod(xxhash64(fp), coalesce(k, 1)) as int)")
    blocks = (placed.join(large, "cell", "left").withColumn("own", own)
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("k", F.lit(1)) - 1)))
              .select("cell", F.least("own", "other").cast("long").alias("lo"),
                      F.greatest("own", "other").cast("long").alias("hi"), "fp"))
    return (blocks.repartition("cell", "lo", "hi").sortWithinPartitions("cell", "lo", "hi", "fp")
            .mapInArrow(frugal(verify), "u long, v long").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                    max_bits: int = 4, max_cell: int = 2048) -> DataFrame:
    """One row per document: doc_id, text_hash, fp (signed long), root (smallest fp of its class), component_id.

    component_id is the smallest doc_id reachable over links of at most
    ``max_bits`` differing bits, the document's own included; null ids are
    passed over (null if all are null). Texts that are null or without a word
    have fingerprint zero. Repeated rows stay repeated; an empty table gives
    an empty result.
    """
    rows = cut(fingerprints(docs, id_col, text_col, shingle), "simhash")
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash_classes")
    found = components(links(classes, max_bits, max_cell), "simhash_links")
    named = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    member = cut(named.join(lowest, "root").select("fp", "root", "component_id"), "simhash_member")
    return rows.join(member, "fp")


def hex_fingerprint(fp: Column) -> Column:
    """16 lowercase hex digits of a fingerprint held as a signed long."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                         max_bits: int = 4) -> DataFrame:
    """Keep one document of each near-duplicate class, with all its columns: that of the smallest doc_id.

    Among rows that share this doc_id the smallest (text hash, fingerprint)
    decides; rows that share id and text are kept once (the smallest, by all
    columns). A class without any doc_id keeps one row.
    """
    found = near_duplicates(docs, id_col, text_col, shingle, max_bits)
    best = (found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("b"))
            .select(F.col("b.doc_id").alias("_id"), F.col("b.text_hash").alias("_th")).distinct())
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("_doc"),
                       text_hash(F.col(text_col)).alias("_hash"))
    kept = rows.join(best, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_th")), "left_semi")
    pick = F.first if "map<" in docs.schema.simpleString() else F.min
    return kept.groupBy("_doc", "_hash").agg(pick("_row").alias("_row")).select("_row.*")
