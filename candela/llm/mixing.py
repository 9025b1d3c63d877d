"""Mixing sources to target token weights by entropy balancing.

Every document gets a rate r = min(cap, exp(lambda * x)), x its size over the
mean size of its source: of all rates with the source's target number of words
and none above the cap, those closest to 1 in relative entropy. The dual in
lambda is solved by Newton steps, one distributed sum for all sources each,
over counts of documents per (source, size). Rates become copies by
systematic rounding along the sizes, with the phase that comes nearest to the
target. Sums are decimal, so reruns agree to the last document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.llm.common import cut, text_hash

WORD = r"[^\x20\x09-\x0D]+"
PHASES = 64


def source_targets(sources: DataFrame, cap: float = 3.0) -> DataFrame:
    """``sources`` (source, source_size) with ``target``: weights 1, 2, 3 repeating by code point, null last,
    share all sizes; no target exceeds cap times its source's size, the excess goes to the others by weight."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    s = cut(sources.withColumn("w", (F.row_number().over(order) - 1) % 3 + 1), "mixing_sources")
    total = s.agg(F.sum("source_size")).first()[0]
    full = F.col("source_size") * F.lit(cap)
    level, held = 0.0, -1
    while True:
        capped = full < F.lit(level) * F.col("w")
        n, used, weight = s.agg(F.count_if(capped), F.sum(F.when(capped, F.col("source_size"))),
                                F.sum(F.when(~capped, F.col("w")))).first()
        if n == held or not weight:
            break
        held, level = n, float(total or 0) - cap * float(used or 0)
        level /= float(weight)
    capped = full < F.lit(level) * F.col("w")
    return s.select("source", "source_size", F.when(capped, full).otherwise(F.lit(level) * F.col("w")).alias("target"))


def _offset(phase: Column) -> Column:
    return (phase / F.lit(PHASES)).cast("decimal(10,9)")


def _rates(cells: DataFrame, sources: DataFrame, cap: float, rounds: int, tolerance: float) -> DataFrame:
    """``lam`` per source, by safeguarded Newton steps on the dual."""
    x, same = F.col("size") / F.col("mean"), F.col("c.source").eqNullSafe(F.col("s.source"))
    rate = F.exp(F.least(F.col("lam") * x, F.lit(50.0)))
    tokens = (F.col("n") * F.col("size")).cast("double")
    exact = lambda v: F.sum(v.cast("decimal(30,6)")).cast("double")
    state = sources.select("source", "target", "mean", F.lit(0.0).alias("lam"), F.lit(-1e4).alias("lo"),
                           F.lit(1e4).alias("hi"))
    for _ in range(rounds):
        for _ in range(4):
            sums = (cells.alias("c").join(state.alias("s"), same)
                    .groupBy("s.source", "target", "mean", "lam", "lo", "hi")
                    .agg(exact(tokens * F.least(rate, F.lit(cap))).alias("g"),
                         exact(F.when(rate < cap, tokens * x * rate).otherwise(0.0)).alias("slope")))
            low = F.col("g") < F.col("target")
            sums = sums.withColumns({"lo": F.when(low, F.col("lam")).otherwise(F.col("lo")),
                                     "hi": F.when(low, F.col("hi")).otherwise(F.col("lam"))})
            step = F.col("lam") + (F.col("target") - F.col("g")) / F.nullif(F.col("slope"), F.lit(0.0))
            inside = (step > F.col("lo")) & (step < F.col("hi"))
            state = sums.select("source", "target", "mean", "lo", "hi",
                                F.when(inside, step).otherwise((F.col("lo") + F.col("hi")) / 2).alias("lam"),
                                (F.abs(F.col("g") - F.col("target")) / F.greatest("target", F.lit(1.0))).alias("off"))
        state = cut(state, "mixing_newton")
        if (state.agg(F.max("off")).first()[0] or 0.0) <= tolerance:
            break
        state = state.drop("off")
    return state.select("source", "lam")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: int = 3,
        rounds: int = 15, tolerance: float = 1e-7, bucket_rows: int = 100_000) -> DataFrame:
    """Rows of ``docs`` as struct ``row``, with size, source_size, target and copies (0 to ``cap``).

    A null text has size 0; documents without a word have rate 1. Null sources
    form a source of their own. Ties are broken by hashes of id and text;
    identical rows are interchangeable. An empty table gives an empty result.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(source_col).cast("string").alias("source"),
                       F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                       F.xxhash64(F.col(id_col), text_hash(F.col(text_col))).alias("h"))
    cells = cut(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mixing_cells")
    sources = (cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"),
                                           F.sum("n").alias("docs")))
    targets = source_targets(sources.select("source", "source_size"), float(cap))
    known = cut(targets.alias("t").join(sources.alias("s"), F.col("t.source").eqNullSafe(F.col("s.source")))
                .select("t.source", "t.source_size", "t.target",
                        F.greatest(F.col("t.source_size") / F.col("docs"), F.lit(1e-9)).alias("mean")), "mixing_targets")
    open_ = known.filter((F.col("target") > 0) & (F.col("target") < F.col("source_size") * cap))
    lam = _rates(cells, open_, float(cap), rounds, tolerance)
    solved = (known.alias("k").join(lam.alias("l"), F.col("k.source").eqNullSafe(F.col("l.source")), "left")
              .select("k.source", "source_size", "target", "mean", "lam"))
    raw = (F.when(F.col("size") == 0, 1.0).when(F.col("lam").isNotNull(), F.exp(F.col("lam") * F.col("size") / F.col("mean")))
           .when(F.col("target") > 0, float(cap)).otherwise(0.0))
    rated = (cells.alias("c").join(solved.alias("k"), F.col("c.source").eqNullSafe(F.col("k.source")))
             .select("c.source", "size", "n", "source_size", "target",
                     F.least(raw, F.lit(float(cap))).cast("decimal(11,9)").alias("r")))
    before = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut(rated.withColumn("base", F.coalesce(F.sum(F.col("n") * F.col("r")).over(before), F.lit(0))
                                  .cast("decimal(38,9)")), "mixing_rates")
    u = _offset(F.col("phase"))
    taken = F.col("size") * (F.floor(F.col("base") + F.col("n") * F.col("r") + u) - F.floor(F.col("base") + u))
    phase = (placed.withColumn("phase", F.explode(F.sequence(F.lit(0), F.lit(PHASES - 1))))
             .groupBy("source", "target", "phase").agg(F.sum(taken.cast("long")).alias("taken"))
             .groupBy("source").agg(F.min(F.struct(F.abs(F.col("taken") - F.col("target")), "phase")).alias("best"))
             .select("source", _offset(F.col("best.phase")).alias("u")))
    total = cells.agg(F.sum("n")).first()[0] or 0
    buckets = max(16, -(-total // bucket_rows))
    tagged = rows.withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(buckets)))
    counted = tagged.groupBy("source", "size", "bucket").agg(F.count(F.lit(1)).alias("m"))
    earlier = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.withColumn("offset", F.coalesce(F.sum("m").over(earlier), F.lit(0))).drop("m")
    plan = (offsets.alias("o").join(placed.alias("p"), F.col("o.source").eqNullSafe(F.col("p.source"))
                                    & (F.col("o.size") == F.col("p.size")))
            .join(phase.alias("f"), F.col("o.source").eqNullSafe(F.col("f.source")))
            .select(F.col("o.source").alias("source"), F.col("o.size").alias("size"), "bucket", "offset", "source_size",
                    "target", "r", (F.col("base") + F.col("u")).alias("base")))
    ranked = tagged.withColumn("k", F.row_number().over(
        Window.partitionBy("source", "size", "bucket").orderBy("h")) - 1)
    at = F.col("base") + (F.col("k") + F.col("offset")).cast("decimal(20,0)") * F.col("r")
    copies = F.floor(at + F.col("r")) - F.floor(at)
    return (ranked.alias("d").join(plan.alias("q"), F.col("d.source").eqNullSafe(F.col("q.source"))
                                   & (F.col("d.size") == F.col("q.size")) & (F.col("d.bucket") == F.col("q.bucket")))
            .select("row", F.col("d.size").alias("size"), "source_size", "target", copies.cast("int").alias("copies")))


def take_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with every row as often as the mix takes it; columns are unchanged."""
    return (mix(docs, id_col, text_col, source_col).filter("copies > 0")
            .select(F.explode(F.sequence(F.lit(1), F.col("copies"))), "row").select("row.*"))
