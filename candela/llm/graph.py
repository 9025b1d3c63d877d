"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candela.llm.common import cut


# The smallest neighbours are written before they meet the edges again, so that both sides of that join are
# exchanged and the edges of a hub, all with one key, are split over tasks.

def _large_star(e: DataFrame, name: str) -> DataFrame:
    both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}_low")
    return (both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u <> v").distinct())


def _small_star(e: DataFrame, name: str) -> DataFrame:
    low = cut(e.groupBy("u").agg(F.min("v").alias("m")), f"{name}_low")
    return (e.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(low.select("u", F.col("m").alias("v"))).distinct())


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: long); root is the smallest node of its component.

    Alternates large-star and small-star until the edges no longer change, in
    O(log^2 n) rounds; each round is a written table. Only the row count and a
    checksum reach the driver. Empty edges give no rows; self edges and
    repeated edges are allowed.
    """
    def state(df):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    e = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            .filter("u <> v").distinct(), name)
    was = state(e)
    while was[0]:
        e = cut(_small_star(cut(_large_star(e, name), f"{name}_large"), name), name)
        now = state(e)
        if now == was:
            break
        was = now
    return (e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
