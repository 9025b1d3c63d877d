"""Exact top-k by inner product, block at a time.

Rows are sorted by the signs of fixed random projections, so that neighbours
are alike, and cut into ranges of a few thousand rows. A range has
the largest and smallest value of every dimension, and so has each small block
inside it, kept as a forward index (row-major integer matrix). For a query the sum over
dimensions of the better of q * largest and q * smallest bounds every score there.

1. Queries, sorted alike, are packed into groups. Each group first meets the one
   range that promises most, which gives its queries a floor: a score that k candidates reach.
2. Only the ranges' maxima and minima are compared with the queries. A range
   is fetched for a group, by an equi-join, if its bound reaches the floor of one of the queries.
3. In a task a group visits its ranges by falling bound, and their blocks too; a
   query stops when the bound no longer reaches its k-th score so far.

A group's ranges are dealt to ``LANES`` tasks, so the lists that are merged at the
end are a fixed number per query. They are merged by (score, id): ties and results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candela.llm.common import batch, cut, frugal

LANES = 16
_PAGE = 1024                           # range summaries compared in one task
_PART = 8                              # ranges or groups written by one task
_CODE = 16                             # projections in the sort key
_NONE = np.iinfo(np.int64).min + 1     # below every score


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * x) per component, as longs, x as double.

    Rows whose id or vector is null, or whose vector holds a null, NaN or infinite component, go.
    """
    finite = F.forall("x", lambda e: F.coalesce(F.abs(e) < float("inf"), F.lit(False)))   # NaN is above infinity
    return (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
            .filter(F.col("id").isNotNull() & F.col("x").isNotNull() & finite)
            .select("id", F.transform("x", lambda e: F.floor(e * scale)).alias("v")))


def matrix(vectors: list[np.ndarray]) -> np.ndarray:
    """Rows of equal width; shorter vectors end in zeros."""
    out = np.zeros((len(vectors), max(map(len, vectors), default=0)), np.int64)
    for row, v in zip(out, vectors):
        row[:len(v)] = v
    return out


def packed(m: np.ndarray) -> bytes:
    """The matrix in the narrowest integers that hold it."""
    low, high = int(m.min(initial=0)), int(m.max(initial=0))
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return m.astype(kind).tobytes()


def unpacked(data, rows: int, width: int) -> np.ndarray:
    if not rows * width:
        return np.zeros((rows, width), np.int64)
    return np.frombuffer(data, f"i{len(data) // (rows * width)}").reshape(rows, width).astype(np.int64)


def _vectors(column: pa.Array) -> list[np.ndarray]:
    flat, edges = column.values.to_numpy(), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(edges, edges[1:])]


def _widen(a: np.ndarray, width: int) -> np.ndarray:
    return np.pad(a, ((0, 0), (0, width - a.shape[1]))) if a.shape[1] < width else a


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in exact integers; scores beyond 64 bits are held at the limit."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if most < 2 ** 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most < 2 ** 62:
        return a @ b.T
    limit = np.iinfo(np.int64)
    return np.clip(a.astype(object) @ b.T.astype(object), limit.min + 2, limit.max).astype(np.int64)


def bounds(q: np.ndarray, blocks: list[np.ndarray]) -> np.ndarray:
    """(queries, blocks): no row of a block scores above this."""
    high = np.array([b.max(0) for b in blocks])
    low = np.array([b.min(0) for b in blocks])
    return product(np.maximum(q, 0), high) + product(np.minimum(q, 0), low)


class Best:
    """The ``k`` best candidates so far of every query of a group."""

    def __init__(self, rids: np.ndarray, ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int, block: int):
        self.rids, self.ids, self.q, self.k, self.block = rids, ids, q, k, block
        self.least = floor.copy()
        self.score = np.full((len(q), k), _NONE)
        self.name = np.full((len(q), k), np.iinfo(np.int64).max)
        self.seen = self.scored = 0

    def meet(self, rids: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Visit the blocks of a range by falling bound. Scores below the floor, and a query's own row, are not wanted."""
        width = max(self.q.shape[1], rows.shape[1])
        q, rows = _widen(self.q, width), _widen(rows, width)
        parts = [slice(a, a + self.block) for a in range(0, len(rows), self.block)]
        bound = bounds(q, [rows[p] for p in parts])
        order = np.argsort(-bound, axis=1, kind="stable")
        self.seen += len(q) * len(rows)
        for turn in range(len(parts)):
            at = order[:, turn]
            live = np.flatnonzero(bound[np.arange(len(q)), at] >= self.least)
            if not len(live):
                break
            for p in np.unique(at[live]):
                mine = live[at[live] == p]
                score = product(q[mine], rows[parts[p]])
                self.scored += score.size
                name = np.broadcast_to(ids[parts[p]], score.shape)
                score = np.where((rids[parts[p]] == self.rids[mine, None]) | (score < self.least[mine, None]), _NONE, score)
                score = np.concatenate([self.score[mine], score], axis=1)
                name = np.concatenate([self.name[mine], name], axis=1)
                top = np.lexsort((name, -score), axis=1)[:, :self.k]
                self.score[mine] = np.take_along_axis(score, top, 1)
                self.name[mine] = np.take_along_axis(name, top, 1)
                self.least[mine] = np.maximum(self.least[mine], self.score[mine, -1])


def _ready(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(rid, id, code, v), written: rid tells rows apart, code sorts like with like."""
    rows = quantised(vectors, id_col, vector_col, scale).select(F.monotonically_increasing_id().alias("rid"), "id", "v")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = matrix(_vectors(b.column(2))).astype(np.float64)
            axes = np.random.default_rng(7).standard_normal((_CODE, max(m.shape[1], 1)))[:, :m.shape[1]]
            code = ((m @ axes.T) > 0) @ (1 << np.arange(_CODE)[::-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code.astype(np.int32))], [*b.schema.names, "code"])

    return cut(rows.mapInArrow(frugal(coded), "rid long, id long, v array<long>, code int"), "topk_rows")


_PACKED = "key long, rids array<long>, ids array<long>, m binary, width int, high array<long>, low array<long>"
_PACK_KIND = {"key": pa.int64(), "rids": pa.list_(pa.int64()), "ids": pa.list_(pa.int64()), "m": pa.binary(), "width": pa.int32(),
              "high": pa.list_(pa.int64()), "low": pa.list_(pa.int64())}


def _packs(rows: DataFrame, n: int, most: int, name: str) -> DataFrame:
    """Sorted rows in packs of at most ``most``, with their largest and smallest values."""
    def made(rids: list, ids: list, vectors: list) -> pa.RecordBatch:
        m = matrix(vectors)
        return batch(_PACK_KIND, {"key": [rids[0]], "rids": [rids], "ids": [ids], "m": [packed(m)], "width": [m.shape[1]],
                                  "high": [m.max(0)], "low": [m.min(0)]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], []]
        for b in batches:
            held[0] += b.column(0).to_pylist()
            held[1] += b.column(1).to_pylist()
            held[2] += [v.copy() for v in _vectors(b.column(2))]
            while len(held[0]) >= most:
                yield made(*(h[:most] for h in held))
                held = [h[most:] for h in held]
        if held[0]:
            yield made(*held)

    spread = rows.select("rid", "id", "v", "code").repartitionByRange(max(1, -(-n // (most * _PART))), "code", "rid")
    return cut(spread.sortWithinPartitions("code", "rid").mapInArrow(frugal(run), _PACKED), name)


def _promising(groups: DataFrame, ranges: DataFrame, n_ranges: int, best: bool) -> DataFrame:
    """(g, r, u): ranges whose bound reaches the floor of a query of the group, u the largest bound; ``best``: of each page the one
    whose bounds add up to most."""
    n_pages = max(1, -(-n_ranges // _PAGE))
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    told = groups.select(F.explode(F.sequence(F.lit(0), F.lit(n_pages - 1))).alias("p"), F.lit(True).alias("is_group"), F.col("key").alias("g"),
                         "m", "width", "floors", none("high", "array<long>"), none("low", "array<long>"))
    shown = ranges.select(F.pmod(F.xxhash64("key"), F.lit(n_pages)).cast("int").alias("p"), F.lit(False).alias("is_group"), F.col("key").alias("g"),
                          none("m", "binary"), none("width", "int"), none("floors", "array<long>"), "high", "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, held, edges = None, [], None
        for b in batches:
            for r in b.to_pylist():
                if r["p"] != page:
                    page, held, edges = r["p"], [], None
                if not r["is_group"]:
                    held.append(r)
                    continue
                if not held:
                    continue
                if edges is None:
                    edges = matrix([np.array(h["high"]) for h in held]), matrix([np.array(h["low"]) for h in held]), np.array([h["g"] for h in held])
                floor = np.array(r["floors"])
                q = unpacked(r["m"], len(floor), r["width"])
                width = max(q.shape[1], edges[0].shape[1])
                q, high, low = (_widen(x, width) for x in (q, edges[0], edges[1]))
                bound = product(np.maximum(q, 0), high) + product(np.minimum(q, 0), low)
                ok = (bound >= floor[:, None]).any(0)
                if best:
                    ok = np.arange(len(held)) == bound.astype(np.float64).sum(0).argmax()
                j = np.flatnonzero(ok)
                yield batch({"g": pa.int64(), "r": pa.int64(), "u": pa.float64()},
                            {"g": np.full(len(j), r["g"]), "r": edges[2][j], "u": bound.astype(np.float64).max(0)[j]})

    return (told.unionByName(shown).repartition("p").sortWithinPartitions("p", "is_group").mapInArrow(frugal(run), "g long, r long, u double"))


def _found(groups: DataFrame, ranges: DataFrame, pairs: DataFrame, k: int, block: int) -> DataFrame:
    """(query_rid, query_id, vec_id, score): the k best of each query from each lane's ranges."""
    shared = ["rids", "ids", "m", "width"]
    first = groups.select(F.col("key").alias("g"), F.explode(F.sequence(F.lit(0), F.lit(LANES - 1))).alias("lane"), F.lit(False).alias("is_range"),
                          F.lit(0.0).alias("u"), *shared, "floors")
    met = (pairs.join(ranges.withColumnRenamed("key", "r").select("r", *shared), "r")
           .select("g", F.pmod(F.xxhash64("r"), F.lit(LANES)).cast("int").alias("lane"), F.lit(True).alias("is_range"), "u", *shared,
                   F.lit(None).cast("array<long>").alias("floors")))
    kind = {"query_rid": pa.int64(), "query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Best | None = None

        def out() -> pa.RecordBatch:
            i, j = np.nonzero(held.score != _NONE)
            return batch(kind, {"query_rid": held.rids[i], "query_id": held.ids[i], "vec_id": held.name[i, j], "score": held.score[i, j]})

        for b in batches:
            for at in range(b.num_rows):
                row = {n: b.column(c)[at] for c, n in enumerate(b.schema.names)}
                rids, ids = (row[n].values.to_numpy() for n in ("rids", "ids"))
                m = unpacked(row["m"].as_py(), len(ids), row["width"].as_py())
                if row["is_range"].as_py():
                    held.meet(rids, ids, m)
                    continue
                if held:
                    yield out()
                held = Best(rids.copy(), ids.copy(), m, row["floors"].values.to_numpy(), k, block)
        if held:
            yield out()

    return (first.unionByName(met).repartition("g", "lane").sortWithinPartitions("g", "lane", "is_range", F.desc("u"))
            .mapInArrow(frugal(run), "query_rid long, query_id long, vec_id long, score long"))


def top_k(vectors: DataFrame, asked: str, k: int, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: int = 64, range_rows: int = 2048, block: int = 128, group: int = 512) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of every query, ties to smaller ids.

    Queries are the rows for which the SQL condition ``asked`` on ``id`` holds; a query's own row takes no part, other rows of its id
    do. Vectors of different lengths are compared as if the shorter ended in zeros. Repeated rows are rows of their own, as
    queries and as candidates. Rows with a null id or vector, or a null or non-finite component, take no part. Empty
    tables give an empty result.
    """
    rows = _ready(vectors, id_col, vector_col, scale)
    n_rows, n_asked = rows.agg(F.count(F.lit(1)), F.count_if(F.expr(asked))).first()
    ranges = _packs(rows, n_rows, range_rows, "topk_ranges")
    groups = _packs(rows.filter(asked), n_asked, group, "topk_queries")
    n_ranges = ranges.select("key").count()
    open_ = groups.withColumn("floors", F.transform("ids", lambda _: F.lit(_NONE)))
    seeds = _promising(open_, ranges, n_ranges, True).groupBy("g").agg(F.max("u").alias("u"), F.max_by("r", "u").alias("r"))
    floors = (_found(open_, ranges, seeds, k, block).groupBy("query_rid").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n"))
              .filter(F.col("n") == k).select(F.col("query_rid").alias("rid"), "floor"))
    at = groups.select("key", F.posexplode("rids").alias("i", "rid")).join(floors, "rid", "left")
    listed = at.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("floor", F.lit(_NONE)).alias("f")))),
                                               lambda x: x["f"]).alias("floors"))                # at most ``group``
    started = cut(groups.join(listed, "key"), "topk_floors")
    met = _found(started, ranges, _promising(started, ranges, n_ranges, False), k, block)
    best = Window.partitionBy("query_rid").orderBy(F.col("score").desc(), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
