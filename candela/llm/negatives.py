"""Hard negatives by anchor spanning-tree bounds, exact.

Every anchor wants its best rows of its own label (positives) and, per positive, the
best rows of other labels whose score lies in a window below the positive's.
Scores are integer inner products.

1. Anchors are sorted by label and by the signs of fixed random projections and cut
   into groups. A group is linked to a minimum spanning tree of Euclidean
   distances, its root the anchor nearest to the group's mean.
2. All rows, sorted alike, are cut into blocks with the largest and smallest value of
   every dimension and the largest norm. A block meets a group only if the root's bounds
   on the block, widened by the group's radius times that norm, overlap what any
   anchor of the group still wants. Only these summaries are compared; the vectors of the
   pairs that remain are fetched afterwards, by an equi-join.
3. In a task a group meets its blocks one after the other. The root scores all rows of
   a block. Down the tree, <child, c> lies within <parent, c> plus or minus
   edge length times the norm of c (Cauchy-Schwarz); where the parent is known only as an
   interval, so is the child. Rows whose interval overlaps a window are scored again, others
   never. Windows narrow as better rows are found.

Positives are searched twice: in the most promising block of each group, for a floor, and
then in all blocks that can reach it. Each group's blocks are dealt to ``LANES`` tasks, so the
lists that are merged at the end are a fixed number per anchor at any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candela.llm.common import batch, cut, frugal
from candela.llm.topk import matrix, packed, product, unpacked

LANES = 16
_PAGE = 1024                               # block summaries compared in one task
_PART = 8                                  # blocks or groups written by one task
_LOW, _HIGH = -(1 << 62), 1 << 62           # beyond every score that is not held at the 64-bit limit
_SLACK = 1 + 1e-9
_CODE = 16                                 # projections in the sort key


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(rid, id, label, code, v), written: floor(scale * x) per component, rid tells rows apart, code sorts like with like.

    Rows with a null id, label or vector, or a null or non-finite component, go.
    """
    finite = F.forall("x", lambda e: F.coalesce(F.abs(e) < float("inf"), F.lit(False)))   # NaN is above infinity
    rows = (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                           F.col(vector_col).cast("array<double>").alias("x"))
            .filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & finite)
            .select(F.monotonically_increasing_id().alias("rid"), "id", "label", F.transform("x", lambda e: F.floor(e * scale)).alias("v")))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = matrix(_rows(b.column(3))).astype(np.float64)
            axes = np.random.default_rng(7).standard_normal((_CODE, max(m.shape[1], 1)))[:, :m.shape[1]]
            code = ((m @ axes.T) > 0) @ (1 << np.arange(_CODE)[::-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code.astype(np.int32))], [*b.schema.names, "code"])

    return cut(rows.mapInArrow(coded, "rid long, id long, label long, v array<long>, code int"), "negatives_rows")


def _rows(column: pa.Array) -> list[np.ndarray]:
    flat, edges = column.values.to_numpy(), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(edges, edges[1:])]


def _mask(labels: np.ndarray) -> int:
    """A bit per label modulo 64, as a signed long."""
    return int(np.bitwise_or.reduce(np.uint64(1) << (labels % 64).astype(np.uint64), initial=np.uint64(0)).astype(np.int64))


def spanning_tree(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(order, parent, edge, radius) of a minimum spanning tree over the rows of ``m``.

    ``order`` lists rows, parents before children; ``parent`` and ``edge`` are given in that order, the root's
    parent -1. Lengths are rounded up; radius is the largest distance from the root.
    """
    x = m.astype(np.float64)
    apart = lambda i: np.sqrt(((x - x[i]) ** 2).sum(1)) * _SLACK
    root = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    near = apart(root)
    radius, via, left = float(near.max()), np.zeros(len(x), np.int64), np.ones(len(x), bool)
    left[root] = False
    order, parent, edge = [root], [-1], [0.0]
    for at in range(1, len(x)):
        i = int(np.where(left, near, np.inf).argmin())
        order.append(i)
        parent.append(int(via[i]))
        edge.append(float(near[i]))
        left[i] = False
        d = apart(i)
        closer = d < near
        near, via = np.where(closer, d, near), np.where(closer, at, via)
    return np.array(order), np.array(parent), np.array(edge), radius


def _pack(most: int, tree: bool):
    """Sorted rows to groups (with their tree) or blocks (with their summary) of at most ``most`` rows."""
    kind = {"key": pa.int64(), "rids": pa.list_(pa.int64()), "ids": pa.list_(pa.int64()), "labels": pa.list_(pa.int64()),
            "m": pa.binary(), "width": pa.int32(), "mask": pa.int64()}
    more = ({"parent": pa.list_(pa.int32()), "edge": pa.list_(pa.float64()), "radius": pa.float64(), "root": pa.list_(pa.int64())} if tree else
            {"high": pa.list_(pa.int64()), "low": pa.list_(pa.int64()), "norm": pa.float64()})

    def made(rids, ids, labels, vectors) -> pa.RecordBatch:
        rids, ids, labels, m = np.array(rids), np.array(ids), np.array(labels), matrix(vectors)
        if tree:
            order, parent, edge, radius = spanning_tree(m)
            rids, ids, labels, m = rids[order], ids[order], labels[order], m[order]
            rest = {"parent": [parent], "edge": [edge], "radius": [radius], "root": [m[0]]}
        else:
            rest = {"high": [m.max(0)], "low": [m.min(0)], "norm": [float(np.sqrt((m.astype(np.float64) ** 2).sum(1)).max()) * _SLACK]}
        return batch(kind | more, {"key": [int(rids[0])], "rids": [rids], "ids": [ids], "labels": [labels], "m": [packed(m)],
                                   "width": [m.shape[1]], "mask": [_mask(labels)]} | rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], []]
        for b in batches:
            for have, c in zip(held, range(3)):
                have += b.column(c).to_pylist()
            held[3] += [v.copy() for v in _rows(b.column(3))]
            while len(held[0]) >= most:
                yield made(*(h[:most] for h in held))
                held = [h[most:] for h in held]
        if held[0]:
            yield made(*held)

    ddl = "key long, rids array<long>, ids array<long>, labels array<long>, m binary, width int, mask long, "
    return run, ddl + ("parent array<int>, edge array<double>, radius double, root array<long>" if tree else
                       "high array<long>, low array<long>, norm double")


def _cut_up(rows: DataFrame, n: int, most: int, tree: bool, name: str) -> DataFrame:
    run, ddl = _pack(most, tree)
    spread = rows.select("rid", "id", "label", "v", "code").repartitionByRange(max(1, -(-n // (most * _PART))), "label", "code", "rid")
    return cut(spread.sortWithinPartitions("label", "code", "rid").mapInArrow(frugal(run), ddl), name)


# ------------------------------------------------------------------ which blocks meet which groups

def _wide(rows: list[list[int]], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for to, r in zip(out, rows):
        to[:len(r)] = r
    return out


def meetings(groups: DataFrame, blocks: DataFrame, n_blocks: int, needs: DataFrame | None, same: bool, best: bool) -> DataFrame:
    """(g, b, u): blocks that may hold what a group needs, u the largest score any anchor may have there.

    ``needs``: (g, need_low, need_high); groups without a row need nothing. None: all scores. ``same``: only blocks
    that may share a label. ``best``: only the most promising block of every page.
    """
    n_pages = max(1, -(-n_blocks // _PAGE))
    asked = groups.select(F.col("key").alias("g"), "root", "radius", "mask")
    asked = asked.withColumns({"need_low": F.lit(_LOW), "need_high": F.lit(_HIGH)}) if needs is None else asked.join(needs, "g")
    nothing = {"high": F.lit(None).cast("array<long>"), "low": F.lit(None).cast("array<long>"), "norm": F.lit(None).cast("double")}
    told = (asked.withColumns(nothing).withColumns({"p": F.explode(F.sequence(F.lit(0), F.lit(n_pages - 1))), "is_group": F.lit(True)}))
    shown = blocks.select(F.col("key").alias("g"), F.lit(None).cast("array<long>").alias("root"), F.lit(None).cast("double").alias("radius"),
                          "mask", F.lit(None).cast("long").alias("need_low"), F.lit(None).cast("long").alias("need_high"), "high", "low",
                          "norm", F.pmod(F.xxhash64("key"), F.lit(n_pages)).cast("int").alias("p"), F.lit(False).alias("is_group"))
    columns = ["p", "is_group", "g", "root", "radius", "mask", "need_low", "need_high", "high", "low", "norm"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, held = None, []

        def answer(rows: list[dict]) -> pa.RecordBatch:
            out = {"g": [], "b": [], "u": []}
            if rows and held:
                width = max(max(len(r["root"]) for r in rows), max(len(h["high"]) for h in held))
                high, low = (_wide([h[c] for h in held], width) for c in ("high", "low"))
                q = _wide([r["root"] for r in rows], width)
                plus, minus = np.maximum(q, 0), np.minimum(q, 0)
                norm, keys = np.array([h["norm"] for h in held]), np.array([h["g"] for h in held])
                reach = np.array([r["radius"] for r in rows])[:, None] * norm
                top, bottom = plus @ high.T + minus @ low.T + reach, plus @ low.T + minus @ high.T - reach
                loose = 1 + 1e-9 * (np.abs(plus) @ np.abs(high).T + np.abs(minus) @ np.abs(low).T + np.abs(plus) @ np.abs(low).T
                                    + np.abs(minus) @ np.abs(high).T)
                need_low, need_high = (np.array([r[c] for r in rows], np.float64)[:, None] for c in ("need_low", "need_high"))
                ok = (top + loose >= need_low) & (bottom - loose <= need_high)
                if same:
                    ok &= (np.array([r["mask"] for r in rows])[:, None] & np.array([h["mask"] for h in held])) != 0
                if best:
                    first = np.where(ok, top, -np.inf)
                    ok &= np.arange(len(held)) == first.argmax(1)[:, None]
                i, j = np.nonzero(ok)
                out = {"g": np.array([r["g"] for r in rows])[i], "b": keys[j], "u": top[i, j]}
            return batch({"g": pa.int64(), "b": pa.int64(), "u": pa.float64()}, out)

        for b in batches:
            for lo in range(0, b.num_rows, 64):
                rows = []
                for r in b.slice(lo, 64).to_pylist():
                    if r["p"] != page:
                        if rows:
                            yield answer(rows)
                        page, held, rows = r["p"], [], []
                    (rows if r["is_group"] else held).append(r)
                if rows:
                    yield answer(rows)

    return (told.select(*columns).unionByName(shown.select(*columns)).repartition("p").sortWithinPartitions("p", "is_group")
            .mapInArrow(frugal(run), "g long, b long, u double"))


# ------------------------------------------------------------------ a group and its blocks

class Lists:
    """The best rows found so far for every anchor of a group; an anchor has one list per window."""

    def __init__(self, group: dict, wants: list[dict] | None, k: int, same: bool):
        self.same, self.k = same, k
        n = len(group["ids"])
        self.ids, self.rids, self.labels = (np.array(group[c], np.int64) for c in ("ids", "rids", "labels"))
        self.m = unpacked(group["m"], n, group["width"])
        self.parent, self.edge = group["parent"], group["edge"]
        self.want: list[list[dict]] = [[] for _ in range(n)]
        for w in [{"i": i, "j": 0, "low": _LOW, "high": _HIGH, "positive_id": None, "positive_score": None} for i in range(n)] if wants is None else wants:
            self.want[w["i"]].append(w | {"score": np.empty(0, np.int64), "id": np.empty(0, np.int64)})
        self.rescored = self.seen = 0

    def meet(self, ids: np.ndarray, rids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> None:
        """Take what the anchors want of a block."""
        width = max(rows.shape[1], self.m.shape[1])
        c, a = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (rows, self.m))
        # Sums stay exact in doubles below 2^53.
        if float(np.abs(c).max(initial=0)) * float(np.abs(a).max(initial=0)) * max(width, 1) < 2 ** 53:
            c, a = c.astype(np.float64), a.astype(np.float64)
            scored = lambda i, at: (c[at] @ a[i]).astype(np.int64)
        else:
            scored = lambda i, at: product(c[at], a[i:i + 1])[:, 0]
        norm = np.sqrt((c.astype(np.float64) ** 2).sum(1)) * _SLACK
        size = norm * np.sqrt((a.astype(np.float64) ** 2).sum(1).max(initial=0)) * 1e-9 + 1
        low, high = np.empty((len(a), len(c))), np.empty((len(a), len(c)))
        for i, want in enumerate(self.want):
            if i == 0:
                every = scored(0, slice(None))
                low[0], high[0] = every - size, every + size
            else:
                reach = self.edge[i] * norm
                low[i], high[i] = low[self.parent[i]] - reach, high[self.parent[i]] + reach
            if not want:
                continue
            mine = (labels == self.labels[i]) & (rids != self.rids[i]) if self.same else labels != self.labels[i]
            at = np.flatnonzero(mine & (high[i] >= min(w["low"] for w in want)) & (low[i] <= max(w["high"] for w in want)))
            self.seen += len(c)
            self.rescored += len(at)
            if not len(at):
                continue
            score = scored(i, at)
            low[i, at], high[i, at] = score - size[at], score + size[at]
            for w in want:
                ok = (score >= w["low"]) & (score <= w["high"])
                if ok.any():
                    s, name = np.r_[w["score"], score[ok]], np.r_[w["id"], ids[at[ok]]]
                    top = np.lexsort((name, -s))[:self.k]
                    w["score"], w["id"] = s[top], name[top]
                    if len(top) == self.k:
                        w["low"] = max(w["low"], int(s[top[-1]]))

    def found(self) -> dict:
        out = {"i": [], "j": [], "anchor_id": [], "positive_id": [], "positive_score": [], "id": [], "score": []}
        for i, want in enumerate(self.want):
            for w in want:
                n = len(w["id"])
                for c, v in (("i", i), ("j", w["j"]), ("anchor_id", int(self.ids[i])), ("positive_id", w["positive_id"]),
                             ("positive_score", w["positive_score"])):
                    out[c] += [v] * n
                out["id"] += w["id"].tolist()
                out["score"] += w["score"].tolist()
        return out


_FOUND = {"g": pa.int64(), "i": pa.int32(), "j": pa.int32(), "anchor_id": pa.int64(), "positive_id": pa.int64(),
          "positive_score": pa.int64(), "id": pa.int64(), "score": pa.int64()}
_WANT = "array<struct<i: int, j: int, low: bigint, high: bigint, positive_id: bigint, positive_score: bigint>>"


def search(groups: DataFrame, blocks: DataFrame, pairs: DataFrame, wants: DataFrame | None, k: int, same: bool) -> DataFrame:
    """The ``k`` best rows per list of every anchor, from each lane: (g, i, j, anchor_id, positive_id, positive_score, id, score).

    ``pairs`` (g, b, u) names the blocks that each group meets; ``wants`` (g, wants) the lists of its anchors.
    """
    header = groups.withColumnRenamed("key", "g")
    header = header.withColumn("wants", F.lit(None).cast(_WANT)) if wants is None else header.join(wants, "g")
    shared = ["rids", "ids", "labels", "m", "width"]
    first = header.select("g", F.explode(F.sequence(F.lit(0), F.lit(LANES - 1))).alias("lane"), F.lit(False).alias("is_block"),
                          F.lit(0.0).alias("u"), *shared, "parent", "edge", "wants")
    lane = F.pmod(F.xxhash64("b"), F.lit(LANES)).cast("int")
    met = (pairs.join(blocks.withColumnRenamed("key", "b").select("b", *shared), "b")
           .select("g", lane.alias("lane"), F.lit(True).alias("is_block"), "u", *shared, F.lit(None).cast("array<int>").alias("parent"),
                   F.lit(None).cast("array<double>").alias("edge"), F.lit(None).cast(_WANT).alias("wants")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lists = None, None

        def out() -> pa.RecordBatch:
            got = lists.found()
            return batch(_FOUND, {"g": [key[0]] * len(got["i"])} | got)

        for b in batches:
            for at in range(b.num_rows):
                row = {n: b.column(c)[at] for c, n in enumerate(b.schema.names)}
                if not row["is_block"].as_py():
                    if lists:
                        yield out()
                    key = (row["g"].as_py(), row["lane"].as_py())
                    lists = Lists({n: row[n].as_py() for n in (*shared, "parent", "edge")}, row["wants"].as_py(), k, same)
                    continue
                ids, rids, labels = (row[n].values.to_numpy() for n in ("ids", "rids", "labels"))
                lists.meet(ids, rids, labels, unpacked(row["m"].as_py(), len(ids), row["width"].as_py()))
        if lists:
            yield out()

    ddl = "g long, i int, j int, anchor_id long, positive_id long, positive_score long, id long, score long"
    return (first.unionByName(met).repartition("g", "lane").sortWithinPartitions("g", "lane", "is_block", F.desc("u"))
            .mapInArrow(frugal(run), ddl))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("g", "i", "j").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _collected(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(g, wants) and (g, need_low, need_high) of lists (g, i, j, low, high, positive_id, positive_score)."""
    per = lists.groupBy("g").agg(F.collect_list(F.struct("i", "j", "low", "high", "positive_id", "positive_score")).alias("wants"),
                                 F.min("low").alias("need_low"), F.max("high").alias("need_high"))
    per = cut(per, "negatives_wants")
    return per.select("g", "wants"), per.select("g", "need_low", "need_high")


def hard_negatives(vectors: DataFrame, anchor: str, positives: int = 5, k: int = 10, window: tuple[int, int] = (30, 90),
                   id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256,
                   group: int = 256, block: int = 2048) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows for which the SQL condition ``anchor`` on ``id`` holds. An anchor's positives are its
    best other rows of its label. Per positive of score p, the best ``k`` rows of other labels whose
    score s satisfies window[0] * p <= 100 * s <= window[1] * p follow, ties by smaller id. Rows with a null id, label, vector,
    or null or non-finite component take no part; vectors of different lengths compare as if the shorter
    ended in zeros; repeated rows are rows of their own, so an anchor may have its own copy as a positive.
    Anchors without positives, and positives without negatives, give no rows. Empty tables give no rows.
    """
    rows = usable(vectors, id_col, vector_col, label_col, scale)
    n, m = rows.agg(F.count(F.lit(1)), F.count_if(F.expr(anchor))).first()
    groups = _cut_up(rows.filter(anchor), m, group, True, "negatives_groups")
    blocks = _cut_up(rows, n, block, False, "negatives_blocks")
    n_blocks = blocks.select("key").count()

    # A floor for the positives, from the block that promises most to each group.
    seeds = (meetings(groups, blocks, n_blocks, None, True, True).groupBy("g").agg(F.max("u").alias("u"), F.max_by("b", "u").alias("b")))
    begun = _ranked(search(groups, blocks, seeds, None, positives, True), positives)
    floors = begun.groupBy("g", "i").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == positives)
    every = groups.select(F.col("key").alias("g"), F.posexplode("ids").alias("i", "_id"))
    lists = every.join(floors, ["g", "i"], "left").select(
        "g", "i", F.lit(0).alias("j"), F.coalesce("floor", F.lit(_LOW)).alias("low"), F.lit(_HIGH).alias("high"),
        F.lit(None).cast("long").alias("positive_id"), F.lit(None).cast("long").alias("positive_score"))
    wants, needs = _collected(lists)
    pairs = meetings(groups, blocks, n_blocks, needs, True, False)
    found = cut(_ranked(search(groups, blocks, pairs, wants, positives, True), positives), "negatives_positives")

    # The windows of all positives; a window without an integer in it is left out.
    exact = F.col("score").cast("decimal(20,0)")
    lists = found.select("g", "i", F.col("rank").alias("j"), F.ceil(exact * window[0] / 100).cast("long").alias("low"),
                         F.floor(exact * window[1] / 100).cast("long").alias("high"), F.col("id").alias("positive_id"),
                         F.col("score").alias("positive_score")).filter("low <= high")
    wants, needs = _collected(lists)
    pairs = meetings(groups, blocks, n_blocks, needs, False, False)
    return _ranked(search(groups, blocks, pairs, wants, k, False), k).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
