"""Regression trees per symbol, all symbols in one job (family F).

``fit`` grows forests, extremely randomised trees and boosted trees for every symbol
at once. Rows are cut into blocks of ``BLOCK`` per symbol; sums over the rows of
a block decide nothing alone and are only ever added, so a level is one aggregate by (symbol,
tree, node, feature, bin):

* A symbol of at most ``small`` rows is grown inside tasks, a share of its trees
  in each, all levels one after the other, from the histogram cells that are not empty; one job for any number of such symbols.
* A larger symbol is grown level by level: tasks add up the histograms of a
  run of blocks for a few trees, the sums meet by (symbol, tree), and the splits found go back
  to the blocks with the next level. Both ways give the same trees.

Splits send x <= cut to the left. Histogram cuts are the column's values at ``bins`` equal
ranks, all values of short columns, so small data give the trees of plain CART. Extremely
randomised trees have no bins: a first aggregate takes each node's range per
feature, the cut is drawn by hash inside it, a second one weighs the two sides.
Row and column samples are drawn by hash of (symbol, row, tree) too, and targets are summed
as multiples of 2^-26, exactly in any order, so reruns agree.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 4096           # rows of a symbol kept together
SMALL = 1 << 16        # rows of a symbol grown inside one task
GROUP = 64             # blocks whose sums are added up in one task
CHUNKS = 8             # parts that the trees of an ensemble are dealt to
MOST_TASKS = 10_000
_U = np.uint64
SCALE = float(1 << 26)  # targets are log returns: sums of 10^7 rows stay exact in doubles


@dataclass(frozen=True)
class Growth:
    """Size and sampling of an ensemble. ``rows``: share of rows per tree, 0 for a bootstrap sample of all."""

    trees: int = 100
    depth: int = 8
    min_leaf: int = 5
    rows: float = 1.0
    columns: float = 1.0
    l2: float = 0.0
    boosted: bool = False
    rate: float = 1.0
    random_cuts: bool = False
    bins: int = 256
    seed: int = 42


# Sizes of the offered ensembles.
KINDS = {
    "forest": Growth(trees=100, depth=8, min_leaf=5, rows=0.0),
    "extra_trees": Growth(trees=100, depth=8, min_leaf=5, random_cuts=True),
    "gbt": Growth(trees=150, depth=4, min_leaf=5, rows=0.8, boosted=True, rate=0.05),
    "gbt_xgb": Growth(trees=200, depth=5, min_leaf=1, rows=0.8, columns=0.8, l2=2.0, boosted=True, rate=0.05),
    "gbt_lgb": Growth(trees=200, depth=5, min_leaf=20, l2=2.0, boosted=True, rate=0.05),
}


# ------------------------------------------------------------------ draws

def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def draw(symbol: str, *parts) -> np.ndarray:
    """Uniform numbers in [0, 1) from the hash of a symbol and integers (arrays broadcast)."""
    h = np.asarray(zlib.crc32(symbol.encode()), _U)
    with np.errstate(over="ignore"):
        for p in parts:
            h = _mixed(h * _U(0x9E3779B97F4A7C15) + np.asarray(p).astype(np.int64).astype(_U) + _U(1))
    return (h >> _U(11)).astype(np.float64) * 2.0 ** -53


_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])


def row_weights(g: Growth, symbol: str, pos: np.ndarray, tree: int) -> np.ndarray:
    if g.rows == 0:
        return np.searchsorted(_POISSON, draw(symbol, g.seed, 1, tree, pos), "right").astype(float)
    if g.rows < 1:
        return (draw(symbol, g.seed, 1, tree, pos) < g.rows).astype(float)
    return np.ones(len(pos))


def column_mask(g: Growth, symbol: str, n: int, tree: int) -> np.ndarray:
    """The tree's columns: the ``columns`` share with the smallest draws, one at least."""
    if g.columns >= 1:
        return np.ones(n, bool)
    order = np.argsort(draw(symbol, g.seed, 2, tree, np.arange(n)), kind="stable")
    out = np.zeros(n, bool)
    out[order[:max(1, int(g.columns * n))]] = True
    return out


# ------------------------------------------------------------------ one tree

class Tree:
    """Heap of nodes from 1: ``feature`` (-1: none yet or a leaf), ``cut`` and ``value``."""

    def __init__(self, depth: int):
        self.feature = np.full(2 << depth, -1, np.int32)
        self.cut, self.value = np.zeros(2 << depth), np.zeros(2 << depth)

    def place(self, x: np.ndarray) -> np.ndarray:
        """Node of every row."""
        at = np.ones(len(x), np.int64)
        while True:
            f = self.feature[at]
            live = np.flatnonzero(f >= 0)
            if not len(live):
                return at
            a = at[live]
            at[live] = 2 * a + (x[live, f[live]] > self.cut[a])


def fixed(y: np.ndarray) -> np.ndarray:
    """Targets as whole multiples of 1 / SCALE."""
    return np.rint(y * SCALE)


def rank_cuts(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Per column the distinct values at ranks ceil(i n / bins), without the largest value."""
    s = np.sort(x, axis=0)
    at = np.ceil(np.arange(1, bins) * len(x) / bins).astype(int) - 1
    return [np.unique(c[at][c[at] < c[-1]]) for c in s.T]


def histogram(x: np.ndarray, y: np.ndarray, w: np.ndarray, slot: np.ndarray, n_slots: int, cuts: list[np.ndarray]) -> np.ndarray:
    """(3, slots, columns, bins): rows, weight and weighted y per node, column and bin. slot -1 is left out."""
    keep = np.flatnonzero((slot >= 0) & (w > 0))
    bins = max(map(len, cuts)) + 1
    out = np.empty((3, n_slots, x.shape[1], bins))
    wy = w[keep] * y[keep]
    for f, c in enumerate(cuts):
        at = slot[keep] * bins + np.searchsorted(c, x[keep, f], "left")
        for k, v in enumerate((None, w[keep], wy)):
            out[k, :, f] = np.bincount(at, v, n_slots * bins).reshape(n_slots, bins)
    return out


def ranges(x: np.ndarray, w: np.ndarray, slot: np.ndarray, n_slots: int) -> np.ndarray:
    """(2, slots, columns): smallest value and smallest negative value per node and column."""
    out = np.full((2, n_slots, x.shape[1]), np.inf)
    keep = np.flatnonzero((slot >= 0) & (w > 0))
    order = keep[np.argsort(slot[keep], kind="stable")]
    if len(order):
        first = np.flatnonzero(np.r_[True, slot[order][1:] != slot[order][:-1]])
        out[0, slot[order[first]]] = np.minimum.reduceat(x[order], first, axis=0)
        out[1, slot[order[first]]] = np.minimum.reduceat(-x[order], first, axis=0)
    return out


def random_cuts(g: Growth, symbol: str, tree: int, nodes: np.ndarray, span: np.ndarray) -> np.ndarray:
    """(nodes, columns): a cut between each node's smallest and largest value; the smallest if the draw is the largest."""
    lo, hi = span[0], -span[1]
    u = draw(symbol, g.seed, 3, tree, nodes[:, None], np.arange(lo.shape[1])[None, :])
    with np.errstate(invalid="ignore"):
        cut = lo + u * (hi - lo)
    return np.where(cut < hi, cut, lo)


def sides(x: np.ndarray, y: np.ndarray, w: np.ndarray, slot: np.ndarray, n_slots: int, cut: np.ndarray) -> np.ndarray:
    """(3, slots, columns, 2): rows, weight and weighted y left and right of each node's cut per column."""
    keep = np.flatnonzero((slot >= 0) & (w > 0))
    out = np.empty((3, n_slots, x.shape[1], 2))
    wy = w[keep] * y[keep]
    right = x[keep] > cut[slot[keep]]
    for f in range(x.shape[1]):
        at = slot[keep] * 2 + right[:, f]
        for k, v in enumerate((None, w[keep], wy)):
            out[k, :, f] = np.bincount(at, v, n_slots * 2).reshape(n_slots, 2)
    return out


def choose(g: Growth, stats: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(column or -1, bin, value) per node from (3, nodes, columns, bins): the split of largest gain, the first of equals."""
    left = stats.cumsum(3)
    total = left[:, :, :1, -1:]
    n, w, s = left[..., :-1]
    rest_n, rest_w, rest_s = total[0] - n, total[1] - w, total[2] - s
    with np.errstate(all="ignore"):
        gain = s ** 2 / (w + g.l2) + rest_s ** 2 / (rest_w + g.l2) - total[2] ** 2 / (total[1] + g.l2)
    scale = np.maximum(total[2] ** 2 / np.maximum(total[1], 1e-300), 1e-300)
    ok = (n >= g.min_leaf) & (rest_n >= g.min_leaf) & (gain > 1e-12 * scale) & allowed[None, :, None]
    gain = np.where(ok, gain, -np.inf).reshape(len(stats[0]), -1)
    best = gain.argmax(1) if gain.shape[1] else np.zeros(len(gain), int)
    found = gain[np.arange(len(gain)), best] > -np.inf if gain.shape[1] else np.zeros(len(gain), bool)
    bins = max(stats.shape[3] - 1, 1)
    value = total[2, :, 0, 0] / np.maximum(total[1, :, 0, 0] + g.l2, 1e-300) / SCALE
    return np.where(found, best // bins, -1), best % bins, value


def choose_cells(g: Growth, codes: np.ndarray, bins: int, y: np.ndarray, w: np.ndarray, slot: np.ndarray, n_slots: int,
                 allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``choose`` gives for the histogram of these rows (``codes``: their bins), from the cells that are not empty."""
    keep = np.flatnonzero((slot >= 0) & (w > 0))
    k = codes.shape[1]
    at = ((slot[keep, None] * k + np.arange(k)) * bins + codes[keep]).ravel()
    size = n_slots * k * bins
    rows = np.bincount(at, None, size)
    cell = np.flatnonzero(rows)
    column, value = np.full(n_slots, -1), np.zeros(n_slots)
    bin_ = np.zeros(n_slots, np.int64)
    if not len(cell):
        return column, bin_, value
    sums = [np.cumsum(x) for x in (rows[cell].astype(float), np.bincount(at, np.repeat(w[keep], k), size)[cell],
                                   np.bincount(at, np.repeat(w[keep] * y[keep], k), size)[cell])]
    group = cell // bins
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    stop = np.r_[start[1:], len(cell)] - 1
    of = np.repeat(np.arange(len(start)), stop - start + 1)
    base = [np.r_[0.0, x[stop[:-1]]] for x in sums]
    n, weight, s = (x - b[of] for x, b in zip(sums, base))
    total = [(x[stop] - b)[of] for x, b in zip(sums, base)]
    with np.errstate(all="ignore"):
        gain = s ** 2 / (weight + g.l2) + (total[2] - s) ** 2 / (total[1] - weight + g.l2) - total[2] ** 2 / (total[1] + g.l2)
    scale = np.maximum(total[2] ** 2 / np.maximum(total[1], 1e-300), 1e-300)
    f, where = group % k, group // k
    ok = (n >= g.min_leaf) & (total[0] - n >= g.min_leaf) & (gain > 1e-12 * scale) & allowed[f]
    gain = np.where(ok, gain, -np.inf)
    first = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
    most = np.maximum.reduceat(gain, first)
    value[where[first]] = total[2][first] / np.maximum(total[1][first] + g.l2, 1e-300) / SCALE
    best = np.flatnonzero((gain == most[np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(cell)]))]) & ok)
    best = best[np.r_[True, where[best][1:] != where[best][:-1]]] if len(best) else best
    column[where[best]], bin_[where[best]] = f[best], cell[best] % bins
    return column, bin_, value


def _at(nodes: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Index of every row's node among the sorted ``nodes``, -1 if it is none of them."""
    i = np.searchsorted(nodes, place)
    return np.where((i < len(nodes)) & (nodes[np.minimum(i, len(nodes) - 1)] == place), i, -1)


def grow(g: Growth, symbol: str, number: int, x: np.ndarray, y: np.ndarray, pos: np.ndarray, cuts: list[np.ndarray],
         codes: np.ndarray | None) -> Tree:
    """One tree from all rows of a symbol; ``codes``: their bins."""
    tree, w, allowed = Tree(g.depth), row_weights(g, symbol, pos, number), column_mask(g, symbol, x.shape[1], number)
    nodes, place, y = np.array([1]), np.ones(len(x), np.int64), fixed(y)
    for level in range(g.depth + 1):
        slot = _at(nodes, place)
        if g.random_cuts:
            cut = random_cuts(g, symbol, number, nodes, ranges(x, w, slot, len(nodes)))
            column, bin_, value = choose(g, sides(x, y, w, slot, len(nodes), cut), allowed)
            used = lambda i, f, b: cut[i, f]
        else:
            column, bin_, value = choose_cells(g, codes, max(map(len, cuts)) + 1, y, w, slot, len(nodes), allowed)
            used = lambda i, f, b: cuts[f][b]
        tree.value[nodes] = value
        if level == g.depth:
            break
        split = np.flatnonzero(column >= 0)
        if not len(split):
            break
        for i in split:
            tree.feature[nodes[i]], tree.cut[nodes[i]] = column[i], used(i, column[i], bin_[i])
        at = np.flatnonzero(np.isin(place, nodes[split]))
        f = tree.feature[place[at]]
        place[at] = 2 * place[at] + (x[at, f] > tree.cut[place[at]])
        nodes = np.sort(np.r_[2 * nodes[split], 2 * nodes[split] + 1])
    return tree


def grow_all(g: Growth, symbol: str, numbers: range, x: np.ndarray, y: np.ndarray, pos: np.ndarray) -> Iterator[Tree]:
    """The trees ``numbers`` of a symbol; boosted trees are all grown, in order."""
    cuts = [] if g.random_cuts else rank_cuts(x, g.bins)
    codes = None if g.random_cuts else np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])
    if not g.boosted:
        for t in numbers:
            yield grow(g, symbol, t, x, y, pos, cuts, codes)
        return
    left = y - y.mean()
    for t in numbers:
        tree = grow(g, symbol, t, x, left, pos, cuts, codes)
        left = left - g.rate * tree.value[tree.place(x)]
        yield tree


def predict_trees(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, value: np.ndarray) -> np.ndarray:
    """(rows, trees): each tree's value; the arrays are (trees, nodes)."""
    t = np.arange(len(feature))[None, :]
    at = np.ones((len(x), len(feature)), np.int64)
    rows = np.arange(len(x))[:, None]
    while True:
        f = feature[t, at]
        if (f < 0).all():
            return value[t, at]
        at = np.where(f >= 0, 2 * at + (x[rows, np.maximum(f, 0)] > cut[t, at]), at)


# ------------------------------------------------------------------ blocks of rows

_ROW = ["pos", "d", "split", "target_lr", "close"]


def blocks_of(scaled: DataFrame, cols: list[str], block: int = BLOCK) -> DataFrame:
    """(symbol, block, rows): at most ``block`` rows (pos, d, split, target_lr, close, x) of a symbol, written."""
    row = F.struct(*_ROW, F.array(*[F.col(c).cast("double") for c in cols]).alias("x"))
    return (scaled.filter(F.col("symbol").isNotNull()).groupBy("symbol", F.floor(F.col("pos") / block).alias("block"))
            .agg(F.array_sort(F.collect_list(row)).alias("rows")).checkpoint())


def _train(rows: pa.ListArray, i: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, pos) of the training rows of block ``i`` of a batch."""
    row = rows[i].values
    x = row.field("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
    y, pos = (row.field(c).to_numpy(zero_copy_only=False) for c in ("target_lr", "pos"))
    keep = np.array(row.field("split").to_pylist()) == "train"
    return x[keep], y[keep], pos[keep]


_TREE = "symbol string, tree int, feature array<int>, cut array<double>, value array<double>"


def _tree_batch(symbol: list[str], number: list[int], trees: list[Tree]) -> pa.RecordBatch:
    lists = lambda c, t: pa.array([getattr(x, c) for x in trees], pa.list_(t))
    return pa.RecordBatch.from_arrays([pa.array(symbol, pa.string()), pa.array(number, pa.int32()), lists("feature", pa.int32()),
                                       lists("cut", pa.float64()), lists("value", pa.float64())], ["symbol", "tree", "feature", "cut", "value"])


def _fit_small(blocks: DataFrame, g: Growth, k: int, symbols: int) -> DataFrame:
    """Trees of symbols that fit into a task; each task grows a share of a symbol's trees.

    The rows are few and the work on them long, so the number of tasks is set by the trees, not by bytes.
    """
    chunks = 1 if g.boosted else min(CHUNKS, g.trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def out() -> Iterator[pa.RecordBatch]:
            x, y, pos = (np.concatenate(p) for p in zip(*held))
            numbers = range(key[1], g.trees, chunks)
            if len(y):
                for t, tree in zip(numbers, grow_all(g, key[0], numbers, x, y, pos)):
                    yield _tree_batch([key[0]], [t], [tree])

        for b in batches:
            for i, now in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                if now != key:
                    if held:
                        yield from out()
                    key, held = now, []
                held.append(_train(b.column(2), i, k))
        if held:
            yield from out()

    dealt = blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    return (dealt.repartition(max(1, min(symbols * chunks, MOST_TASKS)), "symbol", "chunk").sortWithinPartitions("symbol", "chunk", "block")
            .select("symbol", "chunk", "rows").mapInArrow(run, _TREE))


# ------------------------------------------------------------------ level by level

def _open_nodes(tree: Tree, level: int) -> np.ndarray:
    """Nodes of a level that may be split: the root, or children of split nodes."""
    nodes = np.arange(1 << level, 2 << level)
    return nodes if level == 0 else nodes[tree.feature[nodes // 2] >= 0]


def _unpacked(state, g: Growth) -> dict[int, Tree]:
    out = {}
    for s in state or []:
        t = out.setdefault(s["tree"], Tree(g.depth))
        t.feature[s["node"]], t.cut[s["node"]], t.value[s["node"]] = s["feature"], s["cut"], s["value"]
    return out


_SPLIT = "symbol string, tree int, node int, feature int, cut double, value double"
_STATE = "array<struct<tree: int, node: int, feature: int, cut: double, value: double>>"


def _level(blocks: DataFrame, g: Growth, k: int, level: int, rounds: range, done: DataFrame | None, cuts: DataFrame, means: DataFrame) -> DataFrame:
    """Splits of all nodes of one level, for the trees ``rounds``: rows of ``_SPLIT``."""
    state = (blocks.sparkSession.createDataFrame([], f"symbol string, state {_STATE}") if done is None else
             done.groupBy("symbol").agg(F.collect_list(F.struct("tree", "node", "feature", "cut", "value")).alias("state")))
    chunks = min(CHUNKS, len(rounds))
    work = (blocks.join(cuts, "symbol").join(means, "symbol").join(state, "symbol", "left")
            .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).withColumn("part", F.floor(F.col("block") / GROUP)))
    work = work.select("symbol", "chunk", "part", "rows", "cuts", "mean", "state")
    dealt = lambda df: df.repartition("symbol", "chunk", "part").sortWithinPartitions("symbol", "chunk", "part")

    def partial(second: bool):
        """Sums of a run of blocks per tree. ``second``: both sides of the cuts drawn in the spans of ``rows``."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, held, trees, spans, base, mean = None, {}, {}, {}, None, 0.0

            def out() -> Iterator[pa.RecordBatch]:
                for t, stats in held.items():
                    yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([t], pa.int32()), pa.array([list(stats.shape)], pa.list_(pa.int32())),
                                                      pa.array([stats.tobytes()], pa.binary())], ["symbol", "tree", "shape", "stats"])

            for b in batches:
                names = b.schema.names
                for i in range(b.num_rows):
                    row = lambda c: b.column(names.index(c))[i].as_py()  # noqa: B023,E731
                    now = (row("symbol"), row("chunk"), row("part"))
                    if now != key:
                        yield from out()
                        key, held, mean = now, {}, row("mean")
                        trees, base = _unpacked(row("state"), g), [np.array(c) for c in row("cuts")]
                        if second:
                            spans = {s["tree"]: np.frombuffer(s["stats"]).reshape(s["shape"]) for s in row("spans")}
                    x, y, pos = _train(b.column(names.index("rows")), i, k)
                    if g.boosted:
                        y = y - mean
                        for t in range(rounds.start):
                            if t in trees:
                                y = y - g.rate * trees[t].value[trees[t].place(x)]
                    for t in rounds[key[1]::chunks]:
                        tree = trees.get(t) or Tree(g.depth)
                        nodes = _open_nodes(tree, level)
                        if not len(nodes):
                            continue
                        slot, w, yt = _at(nodes, tree.place(x)), row_weights(g, key[0], pos, t), fixed(y)
                        if not g.random_cuts:
                            stats = histogram(x, yt, w, slot, len(nodes), base)
                        elif second:
                            stats = sides(x, yt, w, slot, len(nodes), random_cuts(g, key[0], t, nodes, spans[t]))
                        else:
                            stats = ranges(x, w, slot, len(nodes))
                        merge = np.add if second or not g.random_cuts else np.minimum
                        held[t] = merge(held[t], stats) if t in held else stats
            yield from out()
        return run

    def merged(batches: Iterator[pa.RecordBatch], merge) -> Iterator[tuple[str, int, np.ndarray]]:
        key, total = None, None
        for b in batches:
            for s, t, shape, stats in zip(*(c.to_pylist() for c in b.columns)):
                x = np.frombuffer(stats).reshape(shape)
                if (s, t) != key:
                    if key:
                        yield *key, total
                    key, total = (s, t), x
                else:
                    total = merge(total, x)
        if key:
            yield *key, total

    together = lambda df: df.repartition("symbol", "tree").sortWithinPartitions("symbol", "tree")
    sums = "symbol string, tree int, shape array<int>, stats binary"
    spans = None
    first = together(dealt(work).mapInArrow(partial(False), sums))
    if g.random_cuts:
        def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for s, t, x in merged(batches, np.minimum):
                yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([t], pa.int32()), pa.array([list(x.shape)], pa.list_(pa.int32())),
                                                  pa.array([x.tobytes()], pa.binary())], ["symbol", "tree", "shape", "stats"])

        spans = (first.mapInArrow(joined, sums).groupBy("symbol").agg(F.collect_list(F.struct("tree", "shape", "stats")).alias("spans")).checkpoint())
        first = together(dealt(work.join(spans, "symbol")).mapInArrow(partial(True), sums))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, t, stats in merged(batches, np.add):
            column, bin_, value = choose(g, stats, column_mask(g, s, k, t))
            n = len(column)
            yield pa.RecordBatch.from_arrays([pa.array([s] * n, pa.string()), pa.array([t] * n, pa.int32()), pa.array(np.arange(n, dtype=np.int32)),
                                              pa.array(column.astype(np.int32)), pa.array(bin_.astype(np.float64)), pa.array(value)],
                                             ["symbol", "tree", "node", "feature", "cut", "value"])

    found = first.mapInArrow(pick, _SPLIT)
    # Places among the open nodes and bins become heap numbers and cuts, where the state is at hand again.
    side = cuts.join(state, "symbol", "left") if spans is None else cuts.join(state, "symbol", "left").join(spans, "symbol")
    told = found.groupBy("symbol").agg(F.collect_list(F.struct("tree", "node", "feature", "cut", "value")).alias("found")).join(side, "symbol")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                trees, out = _unpacked(r["state"], g), []
                ranges_ = {s["tree"]: np.frombuffer(s["stats"]).reshape(s["shape"]) for s in r.get("spans") or []}
                drawn = {}
                for f in r["found"]:
                    t = f["tree"]
                    nodes = _open_nodes(trees.get(t) or Tree(g.depth), level)
                    if g.random_cuts and t not in drawn:
                        drawn[t] = random_cuts(g, r["symbol"], t, nodes, ranges_[t])
                    split = f["feature"] >= 0 and level < g.depth
                    at = (drawn[t][f["node"], f["feature"]] if g.random_cuts else r["cuts"][f["feature"]][int(f["cut"])]) if split else 0.0
                    out.append((r["symbol"], t, int(nodes[f["node"]]), f["feature"] if split else -1, float(at), f["value"]))
                c = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(c, (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()))],
                                                 ["symbol", "tree", "node", "feature", "cut", "value"])

    return told.mapInArrow(named, _SPLIT)


def _fit_large(blocks: DataFrame, g: Growth, k: int, means: DataFrame) -> DataFrame:
    """Trees of symbols of any size, an aggregate a level; boosted trees one after the other."""
    spark = blocks.sparkSession
    train = blocks.select("symbol", F.explode("rows").alias("r")).filter("r.split = 'train'")
    share = [i / g.bins for i in range(1, g.bins)]
    value = lambda i: F.percentile_approx(F.col("r.x")[i], share, 100_000)
    cut = lambda i: F.filter(F.array_distinct(F.col(f"q{i}")), lambda v: v < F.col(f"m{i}"))
    if g.random_cuts:
        cuts = train.select("symbol").distinct().withColumn("cuts", F.array().cast("array<array<double>>"))
    else:
        cuts = (train.groupBy("symbol").agg(*[value(i).alias(f"q{i}") for i in range(k)], *[F.max(F.col("r.x")[i]).alias(f"m{i}") for i in range(k)])
                .select("symbol", F.array(*[cut(i) for i in range(k)]).alias("cuts")))
    cuts = cuts.checkpoint()
    done: DataFrame | None = None
    for rounds in ([range(t, t + 1) for t in range(g.trees)] if g.boosted else [range(g.trees)]):
        for level in range(g.depth + 1):
            new = _level(blocks, g, k, level, rounds, done, cuts, means).checkpoint()
            done = new if done is None else done.unionAll(new).checkpoint()
            if not new.filter("feature >= 0").limit(1).count():
                break
    grown = done if done is not None else spark.createDataFrame([], _SPLIT)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                (number, tree), = _unpacked(r["s"], g).items()
                yield _tree_batch([r["symbol"]], [number], [tree])

    return (grown.groupBy("symbol", F.col("tree").alias("t")).agg(F.collect_list(F.struct("tree", "node", "feature", "cut", "value")).alias("s"))
            .select("symbol", "s").mapInArrow(whole, _TREE))


# ------------------------------------------------------------------ operators

def fit(blocks: DataFrame, n_cols: int, kind: str | Growth, small: int = SMALL) -> DataFrame:
    """A model per symbol from the training rows of ``blocks_of``: (symbol, base, rate, feature, cut, value).

    The arrays hold all trees, one after the other; symbols without training rows have no model.
    """
    g = KINDS[kind] if isinstance(kind, str) else kind
    counted = (blocks.select("symbol", F.explode("rows").alias("r")).filter("r.split = 'train'").groupBy("symbol")
               .agg(F.count(F.lit(1)).alias("n"), F.avg("r.target_lr").alias("mean")).checkpoint())
    means = counted.select("symbol", "mean")
    n_small, n_large = counted.agg(F.count_if(F.col("n") <= small), F.count_if(F.col("n") > small)).first()
    trees = _fit_small(blocks.join(counted.filter(F.col("n") <= small).select("symbol"), "symbol", "left_semi"), g, n_cols, n_small)
    if n_large:
        large = blocks.join(counted.filter(F.col("n") > small).select("symbol"), "symbol", "left_semi")
        trees = trees.unionAll(_fit_large(large, g, n_cols, means))
    packed = trees.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("tree", "feature", "cut", "value"))).alias("t"))
    base, rate = (F.col("mean"), g.rate) if g.boosted else (F.lit(0.0), 1.0 / g.trees)
    return packed.join(means, "symbol").select("symbol", base.alias("base"), F.lit(rate).alias("rate"),
                                               *[F.flatten(F.col("t")[c]).alias(c) for c in ("feature", "cut", "value")],
                                               F.size("t").alias("trees"))


def ensemble(x: np.ndarray, base: float, rate: float, trees: int, feature, cut, value) -> np.ndarray:
    shape = lambda a, t: np.asarray(a, t).reshape(trees, -1)
    return base + rate * predict_trees(x, shape(feature, np.int64), shape(cut, float), shape(value, float)).sum(1)


def predict(blocks: DataFrame, models: DataFrame, n_cols: int) -> DataFrame:
    """Every row of ``blocks`` with its symbol's ``prediction``: (symbol, pos, d, split, target_lr, close, prediction)."""
    names = ["base", "rate", "trees", "feature", "cut", "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.column(1)[i].values
                x = row.field("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, n_cols)
                told = ensemble(x, *(b.column(2 + c)[i].as_py() if c < 3 else b.column(2 + c)[i].values.to_numpy() for c in range(len(names))))
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[i].as_py()] * len(x), pa.string()), *[row.field(c) for c in _ROW], pa.array(told)],
                                                 ["symbol", *_ROW, "prediction"])

    fields = {f.name: f.dataType.simpleString() for f in blocks.schema["rows"].dataType.elementType.fields}
    schema = "symbol string, " + ", ".join(f"{c} {fields[c]}" for c in _ROW) + ", prediction double"
    return blocks.select("symbol", "rows").join(models, "symbol").select("symbol", "rows", *names).mapInArrow(run, schema)


def step_predict(features: np.ndarray, model: dict[str, list]) -> np.ndarray:
    """``forecast_rolling``'s model: features are scaled by centre and width first."""
    x = (features - np.array(model["centre"], float)) / np.array(model["width"], float)
    return np.array([ensemble(x[i:i + 1], *(model[c][i] for c in ("base", "rate", "trees", "feature", "cut", "value")))[0] for i in range(len(x))])
