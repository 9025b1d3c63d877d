"""Exact order statistics per key by repeated histogram refinement.

A wanted rank lies in a known interval of values, at first the column's smallest to
largest. A round counts the values of every open interval in equal bins, with a partial
aggregate, and moves each rank into the smallest and largest value met in its bin; an interval
that holds one value is done. Every round separates at least the two ends of an
interval, in practice about ``bins`` times closer, so a handful of rounds finds ranks among any
number of rows, and no buffer ever holds a key's values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_quantiles(rows: DataFrame, key: str, cols: list[str], probs: list[float], bins: int = 256, keep: int = 4096) -> DataFrame:
    """(key, q): q[i][j] is the exact quantile ``probs[j]`` of column ``cols[i]``, linearly interpolated.

    Null and NaN values are left out; a column without values has null quantiles. Rows with a null key are left out.
    ``rows`` is read once a round: pass a written or persisted table.
    """
    value = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    wide = rows.filter(F.col(key).isNotNull()).select(key, F.array(*[value(c) for c in cols]).alias("_x"))
    at = [F.col("_x")[i] for i in range(len(cols))]
    ends = wide.groupBy(key).agg(F.array(*[F.count(x) for x in at]).alias("_n"), F.array(*[F.min(x) for x in at]).alias("_lo"),
                                 F.array(*[F.max(x) for x in at]).alias("_hi"))
    place = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(float(p)).alias("p")) for j, p in enumerate(probs)])
    spot = (F.col("_n")[F.col("c")] - 1) * F.col("t.p")
    targets = (ends.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(len(cols) - 1)))).withColumn("t", F.explode(place))
               .select(key, "c", F.col("t.j").alias("j"), spot.alias("spot"), F.col("_lo")[F.col("c")].alias("lo"), F.col("_hi")[F.col("c")].alias("hi"),
                       F.col("_n")[F.col("c")].alias("m"))
               .filter(F.col("lo").isNotNull())
               .withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("spot"), F.ceil("spot")))))
               .withColumn("skip", F.lit(0).cast("long")).checkpoint())
    while targets.filter((F.col("lo") < F.col("hi")) & (F.col("m") > keep)).limit(1).count():
        targets = _refined(wide, targets, key, bins, keep).checkpoint()
    targets = _listed(wide, targets, key).checkpoint()
    frac = F.col("spot") - F.floor("spot")
    low, high = F.max(F.when(F.col("rank") == F.floor("spot"), F.col("lo"))), F.max(F.when(F.col("rank") == F.ceil("spot"), F.col("lo")))
    found = (targets.withColumn("_f", frac).groupBy(key, "c", "j").agg(low.alias("a"), high.alias("b"), F.max("_f").alias("_f"))
             .withColumn("v", F.when(F.col("_f") == 0, F.col("a")).otherwise((1 - F.col("_f")) * F.col("a") + F.col("_f") * F.col("b"))))
    known = found.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.struct("c", "j"), "v"))).alias("_v"))   # len(cols) * len(probs)
    q = F.array(*[F.array(*[F.try_element_at("_v", F.struct(F.lit(i).alias("c"), F.lit(j).alias("j"))) for j in range(len(probs))])
                  for i in range(len(cols))])
    return ends.select(key).join(known, key, "left").select(key, q.alias("q"))


def _members(wide: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """(key, c, lo, hi, v): every value of the intervals of ``targets``."""
    spans = targets.select(key, "c", "lo", "hi").distinct()
    per_key = spans.groupBy(key).agg(F.collect_list(F.struct("c", "lo", "hi")).alias("_s"))                     # a few per column
    met = F.filter(F.transform("_s", lambda s: F.struct(s["c"].alias("c"), s["lo"].alias("lo"), s["hi"].alias("hi"), F.get("_x", s["c"]).alias("v"))),
                   lambda s: (s["v"] >= s["lo"]) & (s["v"] <= s["hi"]))
    return wide.join(per_key, key).select(key, F.explode(met).alias("m")).select(key, "m.*")


def _refined(wide: DataFrame, targets: DataFrame, key: str, bins: int, keep: int) -> DataFrame:
    """``targets`` with every interval of more than ``keep`` values narrowed to the values of one bin."""
    large = (F.col("lo") < F.col("hi")) & (F.col("m") > keep)
    # Halves, so that the width of an interval never overflows.
    share = F.expr(f"floor((v / 2 - lo / 2) / nullif(hi / 2 - lo / 2, 0D) * {bins})")
    slot = (F.when(F.col("v") == F.col("lo"), 0).when(F.col("v") == F.col("hi"), bins - 1)
            .otherwise(F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.coalesce(share, F.lit(0))))))
    counts = (_members(wide, targets.filter(large), key).withColumn("bin", slot)
              .groupBy(key, "c", "lo", "hi", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("v0"), F.max("v").alias("v1")))
    run = Window.partitionBy(key, "c", "lo", "hi").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)         # at most ``bins`` rows
    counts = counts.withColumn("upto", F.sum("n").over(run))
    seen = targets.filter(large).join(counts, [key, "c", "lo", "hi"]).filter(
        (F.col("rank") - F.col("skip") >= F.col("upto") - F.col("n")) & (F.col("rank") - F.col("skip") < F.col("upto")))
    seen = seen.select(key, "c", "j", "spot", F.col("v0").alias("lo"), F.col("v1").alias("hi"), F.col("n").alias("m"), "rank",
                       (F.col("skip") + F.col("upto") - F.col("n")).alias("skip"))
    return targets.filter(~large).unionByName(seen)


def _listed(wide: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """``targets`` with every open interval, now of bounded size, replaced by the value at its rank."""
    listed = (_members(wide, targets.filter("lo < hi"), key).groupBy(key, "c", "lo", "hi")
              .agg(F.array_sort(F.collect_list("v")).alias("_l")))
    value = F.col("_l")[(F.col("rank") - F.col("skip")).cast("int")]
    found = targets.filter("lo < hi").join(listed, [key, "c", "lo", "hi"]).withColumns({"lo": value, "hi": value})
    return targets.filter("lo = hi").unionByName(found.select(*targets.columns))
