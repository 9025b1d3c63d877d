"""Exact removal of passages that repeat anywhere in a corpus.

A window is ``window`` consecutive words. A window that starts at two or more
places is repeated, and every word that a repeated window covers is removed.
Work is cut down in steps, none of which can lose a repeated window:

1. Every window is represented by an anchor: the ``gram``-word sequence with
   the smallest hash inside it. Equal windows have equal anchors at the same
   offset, and neighbouring windows mostly share one, so there are about ten
   times fewer anchors than windows.
2. Every partition counts its anchors in a count-min sketch (two rows of
   2^bits saturating counters); the sketches are merged segment by segment.
   The merged counts never underestimate how often a window occurs.
3. Only anchors estimated repeated are grouped exactly: the span of all
   windows of an anchor is one class (128 bits: hashes of anchor and span). A
   class met twice is repeated as a whole.
4. What remains are spans met once whose anchor also stands elsewhere, the
   ends of copied passages. Their single windows are grouped exactly (128-bit
   hashes), together with those of one place of every other class of that anchor.
5. Spans and windows found repeated meet the texts by document, once.

Only the merged sketch and a fixed-size bit set (sizes are parameters) reach the
driver and the executors. Equality is that of 128-bit word-sequence hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candela.llm.common import (U64, batch, cut, frugal, in_bits, key_bits, mix, powers, rolling, slices, text_hash, texts,
                                with_row, word_hashes)

_ROWS = (U64(0x9FB21C651E98DF25), U64(0xD6E8FEB86659FD93))   # odd: one hash per sketch row
_SEGMENT = 17                                              # a sketch segment has 2^17 counters
_BLOCK = 1 << 22                                           # words looked at together
_SLICE = 1 << 20


class Anchors:
    """Anchors of all windows of a block of texts, given their word hashes one after the other.

    Per anchor: ``doc`` (index of the text), ``lo`` and ``hi`` (first and last
    start of its windows, in the block), ``gram`` (hash of the anchor's words).
    """

    def __init__(self, w: np.ndarray, sizes: np.ndarray, window: int, gram: int):
        self.window, self.w, self.first = window, w, np.cumsum(sizes) - sizes
        n = len(w) - window + 1
        if n <= 0:
            self.doc = self.lo = self.hi = self.at = np.empty(0, np.int64)
            self.gram = np.empty(0, U64)
            return
        grams = rolling(w, gram)
        # Smallest hash first, then the leftmost place: equal windows choose the same word.
        order = ((grams >> U64(24)) << U64(24)) | np.arange(len(grams), dtype=U64)
        at = (_min(order, window - gram + 1) & U64(0xFFFFFF)).astype(np.int64)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        starts = np.flatnonzero(doc[:n] == doc[window - 1:])
        at, doc = at[starts], doc[starts]
        new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])]) if len(starts) else starts
        self.doc, self.at, self.gram = doc[new], at[new], grams[at[new]]
        self.lo = starts[new]
        self.hi = starts[np.r_[new[1:] - 1, len(starts) - 1]] if len(starts) else starts

    def pick(self, mask: np.ndarray) -> None:
        self.doc, self.at, self.gram, self.lo, self.hi = (x[mask] for x in
                                                          (self.doc, self.at, self.gram, self.lo, self.hi))

    def spans(self) -> np.ndarray:
        """64-bit hash of the words from the first to the last window of each anchor, and of its offset."""
        up, down = powers(len(self.w) + 1)
        end, shape = self.hi + self.window, ((self.hi - self.lo) * self.window + self.at - self.lo).astype(U64)
        total = np.r_[U64(0), np.cumsum(mix(self.w + U64(1)) * up[:len(self.w)])]
        return mix((total[end] - total[self.lo]) * down[self.lo] + mix(shape))


def _min(x: np.ndarray, k: int) -> np.ndarray:
    have = 1
    while have * 2 <= k:
        x, have = np.minimum(x[:-have], x[have:]), have * 2
    return np.minimum(x[:len(x) - (k - have)], x[k - have:]) if k > have else x


def _blocks(column: pa.Array, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Word hashes, sizes, row numbers and word offsets of pieces of the texts of a slice.

    Almost always one block; a text beyond _BLOCK words is cut into pieces that overlap by window - 1 words.
    """
    w, sizes = word_hashes(column)
    if len(w) <= 2 * _BLOCK:
        yield w, sizes, np.arange(len(sizes)), np.zeros(len(sizes), np.int64)
        return
    for row, (end, size) in enumerate(zip(np.cumsum(sizes), sizes)):
        for at in range(0, max(size - window + 1, 0), _BLOCK):
            piece = w[end - size + at:min(end, end - size + at + _BLOCK + window - 1)]
            yield piece, np.array([len(piece)]), np.array([row]), np.array([at])


def _cells(gram: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(mix(gram * m) >> U64(64 - bits)).astype(np.int64) for m in _ROWS]


def sketch(rows: DataFrame, window: int, gram: int, bits: int) -> list[np.ndarray]:
    """Merged count-min sketch of the anchors of ``rows.text``: per row, a bit per counter that has reached two."""
    seg_bytes, per_row = (1 << _SEGMENT) // 8, 1 << max(0, bits - _SEGMENT)
    out = {"seg": pa.int32(), "payload": pa.binary()}

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [[] for _ in _ROWS]
        for b in slices(batches, _SLICE, lambda x: x.column(0)):
            for w, sizes, _, _ in _blocks(b.column(0), window):
                for held, cell in zip(seen, _cells(Anchors(w, sizes, window, gram).gram, bits)):
                    held.append(cell.astype(np.uint32))
        squeeze, segs, payloads = zstandard.ZstdCompressor(level=1), [], []
        for r, held in enumerate(seen):
            cell, count = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint32), None)
            edges = np.searchsorted(cell >> _SEGMENT, np.arange(per_row + 1))
            for s, (lo, hi) in enumerate(zip(edges, edges[1:])):
                if hi > lo:
                    flags = np.zeros((2, 1 << _SEGMENT), bool)
                    at = cell[lo:hi] & ((1 << _SEGMENT) - 1)
                    flags[0, at], flags[1, at] = True, count[lo:hi] > 1
                    segs.append(r * per_row + s)
                    payloads.append(squeeze.compress(np.packbits(flags).tobytes()))
        yield batch(out, {"seg": segs, "payload": payloads})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand, once, twice = zstandard.ZstdDecompressor(), {}, {}
        for b in batches:
            for seg, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                one, two = np.frombuffer(expand.decompress(payload), np.uint8).reshape(2, seg_bytes)
                twice[seg] = twice.get(seg, 0) | two | (once.get(seg, 0) & one)
                once[seg] = once.get(seg, 0) | one
        yield batch(out, {"seg": list(twice), "payload": [x.tobytes() for x in twice.values()]})

    merged = (rows.select("text").mapInArrow(frugal(part), "seg int, payload binary")
              .repartition("seg").mapInArrow(frugal(merge), "seg int, payload binary").toArrow())
    bitmap = np.zeros((len(_ROWS) * per_row, seg_bytes), np.uint8)
    for seg, payload in zip(merged.column("seg").to_pylist(), merged.column("payload").to_pylist()):
        bitmap[seg] = np.frombuffer(payload, np.uint8)
    return list(bitmap.reshape(len(_ROWS), -1))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, gram: int = 12,
                   bits: int = 26, place_bits: int = 24) -> DataFrame:
    """(doc_id, text_hash, lo, hi): ranges of window starts, lo to hi, whose windows also start elsewhere.

    Ranges may repeat and overlap. Rows that share id and text share their ranges.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("doc_id"),
                       text_hash(F.col(text_col)).alias("text_hash"))
    bits = max(bits, _SEGMENT)
    twice = spark.sparkContext.broadcast(sketch(rows, window, gram, bits))
    span = {"gram": pa.int64(), "span": pa.int64(), "doc_id": pa.int64(), "text_hash": pa.int64(),
            "lo": pa.int32(), "hi": pa.int32()}
    start = {"h1": pa.int64(), "h2": pa.int64(), "doc_id": pa.int64(), "text_hash": pa.int64(), "lo": pa.int32()}

    def estimated(gram_hash: np.ndarray) -> np.ndarray:
        ok = np.ones(len(gram_hash), bool)
        for bitmap, cell in zip(twice.value, _cells(gram_hash, bits)):
            ok &= (bitmap[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
        return ok

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, _SLICE, lambda x: x.column(0)):
            for w, sizes, row, offset in _blocks(b.column(0), window):
                a = Anchors(w, sizes, window, gram)
                a.pick(estimated(a.gram))
                at, shift = row[a.doc], offset[a.doc] - a.first[a.doc]
                yield batch(span, {"gram": a.gram.view(np.int64), "span": a.spans().view(np.int64),
                                   "doc_id": b.column(1).take(pa.array(at)), "text_hash": b.column(2).take(pa.array(at)),
                                   "lo": (a.lo + shift).astype(np.int32), "hi": (a.hi + shift).astype(np.int32)})

    found = cut(rows.mapInArrow(frugal(spans), "gram long, span long, doc_id long, text_hash long, lo int, hi int"),
                "substring_spans")
    # A place is known by the top bits of text_hash xor (lo << 40); one place stands for its class.
    place = F.expr("text_hash ^ shiftleft(cast(lo as bigint), 40)")
    # Written, so that the joins below exchange both sides and a class of very many places can be split.
    classes = cut(found.groupBy("gram", "span").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("place")),
                  "substring_classes")
    whole = (found.join(classes.filter("n > 1"), ["gram", "span"], "left_semi")
             .select("doc_id", "text_hash", "lo", "hi"))
    mixed = cut(classes.groupBy("gram").agg(F.count(F.lit(1)).alias("spans"), F.min("n").alias("least"))
                .filter("spans > 1 and least = 1").select("gram"), "substring_mixed")
    needed = spark.sparkContext.broadcast(key_bits(classes.join(mixed, "gram", "left_semi"), "place", place_bits))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, _SLICE, lambda x: x.column(0)):
            hashes = b.column(2).to_numpy().view(U64)
            for w, sizes, row, offset in _blocks(b.column(0), window):
                a = Anchors(w, sizes, window, gram)
                lo = (a.lo + offset[a.doc] - a.first[a.doc]).astype(U64)
                a.pick(in_bits(needed.value, hashes[row[a.doc]] ^ (lo << U64(40))) & estimated(a.gram))
                size = a.hi - a.lo + 1
                begin = np.repeat(a.lo - np.cumsum(size) + size, size) + np.arange(size.sum())
                doc = np.repeat(a.doc, size)
                h1, h2 = rolling(w, window), rolling(mix(w + U64(1)), window)
                at = pa.array(row[doc])
                yield batch(start, {"h1": h1[begin].view(np.int64), "h2": h2[begin].view(np.int64),
                                    "doc_id": b.column(1).take(at), "text_hash": b.column(2).take(at),
                                    "lo": (begin + offset[doc] - a.first[doc]).astype(np.int32)})

    single = cut(rows.mapInArrow(frugal(windows), "h1 long, h2 long, doc_id long, text_hash long, lo int"), "substring_windows")
    twice_met = cut(single.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1", "h2"),
                    "substring_repeated")
    for shared in (twice, needed):                     # every pass that reads them is written
        shared.destroy()
    marks = (single.join(twice_met, ["h1", "h2"], "left_semi")
             .select("doc_id", "text_hash", "lo", F.col("lo").alias("hi")))
    return whole.unionAll(marks)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, gram: int = 12,
                   bits: int = 26) -> DataFrame:
    """Rows of ``docs`` as struct ``row``, with n_words, n_removed (long) and kept_text.

    Words are maximal runs of anything but ASCII white space; kept_text is the
    kept words joined by one space. Null texts have no words; texts shorter than a
    window lose nothing; repeated rows repeat each other's windows. Row order is not kept.
    """
    spans = repeated_spans(docs, id_col, text_col, window, gram, bits)
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"),
                       text_hash(F.col(text_col)).alias("text_hash"))
    both = (rows.withColumns({"lo": F.lit(None).cast("int"), "hi": F.lit(None).cast("int"), "is_row": F.lit(True)})
            .unionByName(spans.withColumns({"row": F.lit(None).cast(rows.schema["row"].dataType),
                                                       "is_row": F.lit(False)})))
    keyed = (both.select("is_row", "lo", "hi", "doc_id", "text_hash", "row")
             .repartition("doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash", "is_row"))

    def text_of(b: pa.RecordBatch) -> pa.Array:
        return pc.struct_field(b.column(5), text_col)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ranges = None, []
        for b in slices(batches, _SLICE, text_of):
            is_row, lo, hi, ids, hashes = (b.column(i).to_pylist() for i in range(5))
            at, n_words, n_removed, kept = [], [], [], []
            text = texts(text_of(b))
            for i, row in enumerate(is_row):
                if key != (ids[i], hashes[i]):
                    key, ranges = (ids[i], hashes[i]), []
                if not row:
                    ranges.append((lo[i], hi[i]))
                    continue
                words = text[i].split()
                gone = np.zeros(len(words) + 1, np.int64)
                if ranges:
                    spans_ = np.array(ranges)
                    np.add.at(gone, spans_[:, 0], 1)
                    np.subtract.at(gone, spans_[:, 1] + window, 1)
                    stay = np.cumsum(gone)[:-1] == 0
                    left = [w for w, s in zip(words, stay.tolist()) if s]
                else:
                    left = words
                at.append(i)
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode())
            if at:
                yield pa.RecordBatch.from_arrays(
                    [b.column(5).take(pa.array(at)), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                     pa.array(kept, pa.string())], ["row", "n_words", "n_removed", "kept_text"])

    return keyed.mapInArrow(frugal(apply), with_row(rows, "n_words long, n_removed long, kept_text string"))


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """``docs`` without the words of repeated windows; a text that loses nothing stays as it is.

    A document whose every word is removed goes.
    """
    done = remove_repeats(docs, id_col, text_col, window).filter("n_removed = 0 or n_removed < n_words")
    return done.select(*[F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("row")[c]).alias(c)
                         if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
