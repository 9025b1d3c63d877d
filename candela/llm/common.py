"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candela.session import checkpoint_dir, shared_path, ship_package

U64 = np.uint64
#: Odd multiplier of the rolling hashes (any odd constant would do).
MULT = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
#: Rows of whole texts in one Arrow batch, held by the JVM and the Python worker at once.
ARROW_ROWS = 1000
ARROW_BYTES = 4 << 20
#: Bytes hashed together in word_hashes; every temporary array is eight times as large.
HASH_BYTES = 1 << 19


def prepare(spark: SparkSession) -> None:
    """Checkpoint folder, package files and Arrow batches of bounded size for a job of these operators."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    checkpoint_dir(spark)
    ship_package(spark)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    Cuts the lineage and survives lost executors. Column names must be unique.
    """
    spark = df.sparkSession
    path = shared_path(spark, f"{name}_{uuid.uuid4().hex[:12]}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def frugal(run):
    """An Arrow function that gives its memory back when its task ends: Python workers stay for later tasks."""
    @wraps(run)
    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()
    return held


def release() -> None:
    """Return to the system what the pools of this Python worker keep: power tables, Arrow's pool, free heap."""
    if len(_POWERS[0]) > _POWERS_KEPT:
        _POWERS[:] = [p[:_POWERS_KEPT].copy() for p in _POWERS]
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):     # a C library without it
        pass


def text_hash(text: Column) -> Column:
    """64-bit hash of a text (null: of the empty text)."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [b"" if v is None else v for v in column.cast(pa.large_binary()).to_pylist()]


def with_row(rows: DataFrame, ddl: str) -> T.StructType:
    """Schema of the struct column ``row`` of ``rows``, whatever its field names, followed by ``ddl``."""
    return T.StructType([rows.schema["row"], *T.StructType.fromDDL(ddl).fields])


def batch(schema: dict[str, pa.DataType], columns: dict[str, object]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[k] if isinstance(columns[k], (pa.Array, pa.ChunkedArray))
                                       else pa.array(columns[k], t) for k, t in schema.items()], list(schema))


class WordHash(dict):
    """word (bytes) -> XXH64; forgets everything beyond ``limit`` words, so memory is bounded."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_POWERS = [np.ones(1, U64), np.ones(1, U64)]
_POWERS_KEPT = (1 << 19) + 1
_TABLE = np.random.default_rng(1).integers(0, 1 << 64, 256, U64)       # a random value per byte
_IS_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\f"))


def powers(n: int) -> list[np.ndarray]:
    """MULT^i and MULT^-i mod 2^64 for i < n (at least), kept for the next call."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((MULT, pow(MULT, -1, 1 << 64))):
            steps = np.full(n, U64(base))
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs of anything but ASCII white space) of all texts, and words per text."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    edges = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[edges[0]:edges[-1]]
    edges = edges - edges[0]
    solid = ~_IS_SPACE[data]
    begins, stops = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    stops[:-1] &= ~solid[1:]
    inner = edges[1:-1][(edges[1:-1] > 0) & (edges[1:-1] < len(data))]
    begins[inner] = solid[inner]                       # a text's first word never joins the one before
    stops[inner - 1] = solid[inner - 1]
    lo, hi = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    counts = np.diff(np.searchsorted(lo, edges))
    out, at = np.empty(len(lo), U64), 0
    while at < len(lo):                                # whole words
        end = max(at + 1, int(np.searchsorted(hi, lo[at] + HASH_BYTES, "right")))
        a, b = int(lo[at]), int(hi[end - 1])
        up, down = powers(b - a + 1)
        total = np.empty(b - a + 1, U64)
        total[0] = 0
        np.cumsum(_TABLE[data[a:b]] * up[:b - a], out=total[1:])
        s, e = lo[at:end] - a, hi[at:end] - a
        out[at:end] = mix((total[e] - total[s]) * down[s] + (e - s).astype(U64))
        at = end
    return out, counts


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (a bijection)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def rolling(w: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash mod 2^64 of every ``k`` consecutive values, by doubling."""
    n = len(w) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    out, done, power, span, step = None, 0, w, 1, MULT
    bits = k
    while True:
        if bits & 1:
            part = power[done:done + n]
            out = part.copy() if out is None else out * U64(step) + part
            done += span
        bits >>= 1
        if not bits:
            return mix(out)
        m = U64(step)
        power = power[:len(power) - span] * m + power[span:]
        span, step = span * 2, step * step & MASK


def key_bits(keys: DataFrame, column: str, bits: int = 24) -> np.ndarray:
    """Fixed-size bit set (2^bits bits) of the 64-bit keys of ``column``, by their top bits.

    A superset test: keys of the table are always in; others rarely are. What
    reaches the driver is at most 2^(bits-6) (word, bits) pairs at any input size.
    """
    slot = F.shiftrightunsigned(F.col(column), 64 - bits)
    got = (keys.select(slot.alias("b")).groupBy(F.expr("b div 64").alias("w"))
           .agg(F.expr("bit_or(shiftleft(1L, cast(b % 64 as int)))").alias("v")).toArrow())
    words = np.zeros(1 << (bits - 6), np.int64)
    words[got.column("w").to_numpy()] = got.column("v").to_numpy()
    return words.view(U64)


def in_bits(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Membership of uint64 ``keys`` in a ``key_bits`` set."""
    bits = int(len(words) * 64).bit_length() - 1
    slot = keys >> U64(64 - bits)
    return (words[(slot >> U64(6)).astype(np.int64)] >> (slot & U64(63))) & U64(1) == 1


def slices(batches: Iterable[pa.RecordBatch], max_bytes: int,
           text: Callable[[pa.RecordBatch], pa.Array]) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of each slice hold about ``max_bytes``."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(text(b)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = (np.cumsum(sizes) - sizes) // max_bytes
        edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]).tolist() if len(group) else []
        for lo, hi in zip(edges, [*edges[1:], len(sizes)]):
            yield b.slice(lo, hi - lo)
