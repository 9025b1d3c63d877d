"""Byte-level BPE over a corpus: encoding with chunk reuse, decoding, token counts.

Encoding reuses work between documents:

1. Texts are cut where a rolling hash of the last 16 bytes ends in zeros, so
   equal passages are cut into equal chunks wherever they stand.
2. Chunk digests are counted; chunks met twice or more are encoded once, by
   distributed grouping, into a table of token ids.
3. Documents with a repeated chunk take its ids from that table; everything
   else is encoded in place. Documents without one never move.
4. Chunks were encoded without their neighbours, so every join is repaired:
   a stretch around it is encoded again and widened until its first and last
   words agree with the ids on either side.

A stretch begins and ends where a printable ASCII character is followed by
a space or line feed. No token crosses such a place, and what follows it never
depends on what stands before, so agreement there makes the ids those of
the whole text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candela.llm.common import U64, batch, frugal, in_bits, key_bits, rolling, slices, text_hash, texts, with_row

#: The pattern and the byte alphabet of the public byte-level BPE format.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]

SAFE = re.compile(rb"[!-~](?=[ \n])")
#: White space as the pattern's ``\s`` has it. The engine's regular expressions give up on runs of about a million.
RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{100000,}")
_SLICE = 1 << 20
_MIN_CHUNK = 64


class Codec:
    """Encoder and decoder for a byte-level BPE vocabulary file of the tokenizers library.

    Special tokens are recognised inside texts, as that library does by default.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        plain = all(t["special"] and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"])
                    for t in spec["added_tokens"])
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or not plain:
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        alphabet = {chr(b): b for b in PRINTED}
        for i, b in enumerate(b for b in range(256) if b not in set(PRINTED)):
            alphabet[chr(256 + i)] = b
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
        self.engine = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.size = np.zeros(self.engine.n_vocab, np.int64)
        for word, i in ranks.items():
            self.size[i] = len(word)
        for word, i in special.items():
            self.size[i] = len(word.encode())
        self.special = tuple(special)
        self.store = np.uint16 if self.engine.n_vocab <= 1 << 16 else np.uint32

    def encode(self, text: bytes) -> np.ndarray:
        try:
            return self.engine.encode_to_numpy(text.decode(), allowed_special="all").astype(self.store)
        except ValueError:
            return self.encode_runs(text.decode())

    def count(self, text: bytes) -> int:
        try:
            return len(self.engine.encode(text.decode(), allowed_special="all"))
        except ValueError:
            return len(self.encode_runs(text.decode()))

    def encode_runs(self, text: str) -> np.ndarray:
        """Token ids of a text whose white-space runs are too long for the engine's regular expressions.

        The pattern makes one word of such a run, without its last character if a word follows; that word is
        encoded by itself, what lies between as usual.
        """
        out, at = [], 0
        for m in RUN.finditer(text):
            end = m.end() - (m.end() < len(text) and not text.startswith(self.special, m.end()))
            out.append(self.engine.encode_to_numpy(text[at:m.start()], allowed_special="all").astype(self.store))
            out.append(np.array(self.engine._encode_single_piece(text[m.start():end]), self.store))
            at = end
        return np.concatenate([*out, self.engine.encode_to_numpy(text[at:], allowed_special="all").astype(self.store)])

    def decode(self, ids: list[int]) -> str:
        return self.engine.decode_bytes(ids).decode("utf-8", errors="replace")


@cache
def codec(path: str) -> Codec:
    """The codec of a file, made once per Python worker."""
    return Codec(path)


# ------------------------------------------------------------------ chunks

def cuts(text: bytes, chunk_bits: int) -> list[int]:
    """Chunk ends of a text, its own end included; about 2^chunk_bits bytes apart, at character boundaries."""
    b = np.frombuffer(text, np.uint8)
    ends = []
    if len(b) > 16:
        hit = np.flatnonzero(rolling(b.astype(U64), 16) & U64((1 << chunk_bits) - 1) == 0) + 16
        last = 0
        for at in hit.tolist():
            while at < len(text) and text[at] & 0xC0 == 0x80:
                at += 1
            if at - last >= _MIN_CHUNK and at < len(text):
                ends.append(at)
                last = at
    return [*ends, len(text)] if text else []


def chunks(column: pa.Array, chunk_bits: int) -> Iterator[tuple[int, bytes, list[int], np.ndarray]]:
    """Per text: row, text, chunk ends and the 128-bit chunk digests as (n, 2) signed longs."""
    for i, text in enumerate(texts(column)):
        ends = cuts(text, chunk_bits)
        digest = b"".join(xxhash.xxh3_128_digest(text[a:b]) for a, b in zip([0, *ends], ends))
        yield i, text, ends, np.frombuffer(digest, "<i8").reshape(-1, 2)


# ------------------------------------------------------------------ joins

def encode_with(bpe: Codec, text: bytes, known: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
    """Token ids of ``text``, taking those of the chunks ``known`` (start, end, ids), in order, from there.

    What lies between the safe places of two chunks is encoded as one stretch. It
    must repeat the ids of the last safe word of the chunk before and of the
    first one of the chunk after; if not, it is widened, at last to the whole text.
    """
    out, at, overlap = [], 0, np.empty(0, bpe.store)
    for lo, hi, ids in known:
        ends = np.cumsum(bpe.size[ids]) + lo
        if not len(ids) or ends[-1] != hi:
            continue
        safe = np.array([lo] * (lo == 0) + [m.end() for m in SAFE.finditer(text, lo, hi)] + [hi] * (hi == len(text)))
        index = np.where(safe > lo, np.searchsorted(ends, safe) + 1, 0)
        skip = 1
        while 2 * skip + 1 < len(safe):
            head = (0, 0) if lo == at == 0 else (skip - 1, skip)
            tail = (-1, -1) if hi == len(text) else (-skip - 1, -skip)
            new = bpe.encode(text[at:safe[head[1]]])
            same = ids[index[head[0]]:index[head[1]]]
            if not np.array_equal(new[:len(overlap)], overlap):
                return bpe.encode(text)
            if np.array_equal(new[len(new) - len(same):], same):
                out += [new, ids[index[head[1]]:index[tail[0]]]]
                at, overlap = int(safe[tail[0]]), ids[index[tail[0]]:index[tail[1]]]
                break
            skip *= 2
    new = bpe.encode(text[at:])
    if not np.array_equal(new[:len(overlap)], overlap):
        return bpe.encode(text)
    return np.concatenate([*out, new])


# ------------------------------------------------------------------ operators

def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                     chunk_bits: int = 9, key_bits_: int = 24, decode: bool = False) -> DataFrame:
    """Rows of ``docs`` as struct ``row``, with ``ids`` (array of int): the token ids of the whole text.

    ``decode`` adds ``decoded``, the text that the ids spell, in the same pass over the ids.
    ``path`` names the vocabulary file, present on every executor. Null and empty
    texts have no ids; repeated rows stay repeated; row order is not kept.
    """
    spark = docs.sparkSession
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"),
                       text_hash(F.col(text_col)).alias("text_hash"))
    text_only = docs.select(F.col(text_col).alias("text"))
    first = lambda b: b.column(0)
    of_row = lambda b: pc.struct_field(b.column(0), text_col)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, _SLICE, first):
            digests = np.concatenate([np.empty((0, 2), np.int64), *(d for *_, d in chunks(first(b), chunk_bits))])
            yield batch({"h1": pa.int64(), "h2": pa.int64()}, {"h1": digests[:, 0], "h2": digests[:, 1]})

    shared = (text_only.mapInArrow(frugal(keys), "h1 long, h2 long").groupBy("h1", "h2")
              .agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    needed = spark.sparkContext.broadcast(key_bits(shared, "h1", key_bits_))

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple[int, int]] = set()
        for b in slices(batches, _SLICE, first):
            out = {"h1": [], "h2": [], "chunk": []}
            for _, text, ends, digest in chunks(first(b), chunk_bits):
                for c in np.flatnonzero(in_bits(needed.value, digest[:, 0].view(U64))).tolist():
                    key = tuple(digest[c].tolist())
                    if key not in met:
                        if len(met) >= 100_000:
                            met.clear()
                        met.add(key)
                        out["h1"].append(key[0])
                        out["h2"].append(key[1])
                        out["chunk"].append(text[ends[c - 1] if c else 0:ends[c]])
            yield batch({"h1": pa.int64(), "h2": pa.int64(), "chunk": pa.binary()}, out)

    def encode_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for b in slices(batches, _SLICE, lambda x: x.column(2)):
            ids = [bpe.encode(c).tobytes() for c in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.binary())], ["h1", "h2", "ids"])

    table = (text_only.mapInArrow(frugal(repeated), "h1 long, h2 long, chunk binary")
             .groupBy("h1", "h2").agg(F.first("chunk").alias("chunk"))
             .mapInArrow(frugal(encode_chunks), "h1 long, h2 long, ids binary"))

    def answer(row: pa.Array, ids: list[np.ndarray]) -> pa.RecordBatch:
        offsets = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
        values = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
        out = [row, pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))]
        if decode:
            bpe = codec(path)
            out.append(pa.array([bpe.decode(x.tolist()) for x in ids], pa.string()))
        return pa.RecordBatch.from_arrays(out, ["row", "ids", "decoded"][:len(out)])

    def light(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for b in slices(batches, _SLICE, of_row):
            at, ids = [], []
            for i, text, _, digest in chunks(of_row(b), chunk_bits):
                if not in_bits(needed.value, digest[:, 0].view(U64)).any():
                    at.append(i)
                    ids.append(bpe.encode(text))
            yield answer(b.column(0).take(pa.array(at, pa.int64())), ids)

    def heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, _SLICE, of_row):
            yield b.take(pa.array([i for i, *_, digest in chunks(of_row(b), chunk_bits)
                                   if in_bits(needed.value, digest[:, 0].view(U64)).any()], pa.int64()))

    def uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, _SLICE, first):
            at, out = [], {"seq": [], "h1": [], "h2": []}
            for i, _, _, digest in chunks(first(b), chunk_bits):
                hit = np.flatnonzero(in_bits(needed.value, digest[:, 0].view(U64)))
                at += [i] * len(hit)
                out["seq"].append(hit)
                out["h1"].append(digest[hit, 0])
                out["h2"].append(digest[hit, 1])
            out = {k: np.concatenate([np.empty(0, np.int64), *v]) for k, v in out.items()}
            yield batch({"doc_id": pa.int64(), "text_hash": pa.int64(), "seq": pa.int32(), "h1": pa.int64(), "h2": pa.int64()},
                        out | {"doc_id": b.column(1).take(pa.array(at, pa.int64())),
                               "text_hash": b.column(2).take(pa.array(at, pa.int64()))})

    used = (docs.select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("doc_id"),
                        text_hash(F.col(text_col)).alias("text_hash"))
            .mapInArrow(frugal(uses), "doc_id long, text_hash long, seq int, h1 long, h2 long")
            .join(table, ["h1", "h2"]).select("doc_id", "text_hash", "seq", "ids"))
    whole = (rows.mapInArrow(frugal(heavy), with_row(rows, "doc_id long, text_hash long"))
             .withColumns({"seq": F.lit(None).cast("int"), "ids": F.lit(None).cast("binary"), "is_row": F.lit(True)}))
    keyed = (whole.unionByName(used.withColumns({"row": F.lit(None).cast(rows.schema["row"].dataType),
                                                 "is_row": F.lit(False)}))
             .select("row", "doc_id", "text_hash", "seq", "ids", "is_row")
             .repartition("doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash", "is_row"))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, key, known = codec(path), None, {}
        for b in slices(batches, _SLICE, of_row):
            doc, hashed, seq, ids, is_row = (b.column(i).to_pylist() for i in range(1, 6))
            at, out = [], []
            text = texts(of_row(b))
            for i, row in enumerate(is_row):
                if key != (doc[i], hashed[i]):
                    key, known = (doc[i], hashed[i]), {}
                if not row:
                    known[seq[i]] = ids[i]
                    continue
                ends = cuts(text[i], chunk_bits)
                have = [(ends[c - 1] if c else 0, ends[c], np.frombuffer(known[c], bpe.store)) for c in sorted(known)]
                at.append(i)
                out.append(encode_with(bpe, text[i], have))
            yield answer(b.column(0).take(pa.array(at, pa.int64())), out)

    schema = with_row(rows, "ids array<int>" + ", decoded string" * decode)
    return rows.select("row").mapInArrow(frugal(light), schema).unionByName(keyed.mapInArrow(frugal(assemble), schema))


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``decoded`` (string) added: the text that the column ``ids`` spells, special tokens included."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for b in batches:
            ids = b.column(b.schema.get_field_index("ids"))
            flat, edges = ids.values.to_numpy(), ids.offsets.to_numpy()
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                at = edges[lo:lo + 513].tolist()
                out = [bpe.decode(flat[i:j].tolist()) for i, j in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string())], [*b.schema.names, "decoded"])

    return encoded.mapInArrow(frugal(run), T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))


def split_text(text: bytes, limit: int) -> Iterator[bytes]:
    """Parts of a text that encode on their own: cut at the first safe place beyond every ``limit`` bytes."""
    lo = 0
    while len(text) - lo > limit:
        m = SAFE.search(text, lo + limit)
        if not m or m.end() >= len(text):
            break
        yield text[lo:m.end()]
        lo = m.end()
    yield text[lo:]


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", batch_bytes: int = 4 << 20,
                 part_bytes: int = 1 << 16) -> DataFrame:
    """Rows of ``docs`` as struct ``row``, with n_bytes (UTF-8) and n_tokens (long); null texts count as empty.

    Only lengths leave the Arrow function. Batches hold about ``batch_bytes``
    of text whatever their number of rows; texts above ``part_bytes`` are
    encoded in parts cut at safe places, so one long text never is one call.
    """
    def text_of(b: pa.RecordBatch) -> pa.Array:
        return pc.struct_field(b.column(0), text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for b in slices(batches, batch_bytes, text_of):
            found = texts(text_of(b))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(list(map(len, found)), pa.int64()),
                 pa.array([sum(map(bpe.count, split_text(t, part_bytes))) for t in found], pa.int64())],
                ["row", "n_bytes", "n_tokens"])

    rows = docs.select(F.struct("*").alias("row"))
    return rows.mapInArrow(frugal(run), with_row(rows, "n_bytes long, n_tokens long"))
