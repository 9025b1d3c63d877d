"""Sequential state per key without collecting a key (accounts, key rings).

Some rules read the state that all earlier events of a key have left and are no
prefix scan. ``fold_rounds`` numbers the events per key with a two-level count, cuts
every key's events into blocks, and applies block r of all keys at once in
round r, as one SQL aggregate over the block's array starting from the state the round before left.
Blocks are bounded, so memory does not grow with a key; the work stays in the JVM;
each round is a checkpoint, so a lost executor costs one round. There are as many rounds as
the longest key has blocks, almost always one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.functions.windows import with_position

BLOCK = 512            # events of a key applied in one round


def let(name: str, value: str, body: str) -> str:
    """SQL ``body`` with ``name`` bound to ``value``, evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def fold_rounds(rows: DataFrame, key: Column, order: list[str], bucket: Column, fields: list[str], state: dict[str, str],
                step: str, out_type: str, block: int = BLOCK) -> DataFrame:
    """The rows that ``step`` puts out, one struct of ``out_type`` each, as columns.

    ``key`` may be null: those events share one state. ``order`` is unique per key; ``bucket`` is non-decreasing in it
    and never null. ``state`` maps the state's names to SQL of their start values. ``step`` is SQL of the next
    state, a struct of these names and ``out`` in that order, from state ``s`` and event ``o`` (its ``fields``).
    """
    rows = rows.withColumn("_key", F.coalesce(key.cast("string"), F.lit("")))
    numbered = with_position(rows, order=order, key="_key", bucket=bucket)
    blocks = (numbered.groupBy("_key", F.floor(F.col("pos") / block).alias("_block"))
              .agg(F.array_sort(F.collect_list(F.struct("pos", *fields))).alias("events")).checkpoint())
    begin = ", ".join(f"'{c}', {c}" for c in state)
    applied = f"aggregate(events, named_struct({begin}, 'out', CAST(array() AS ARRAY<{out_type}>)), (s, o) -> {step})"
    rounds = (blocks.agg(F.max("_block")).first()[0] or 0) + 1
    done, held = [], None
    for r in range(rounds):
        now = blocks.filter(F.col("_block") == r)
        now = now.withColumns({c: F.expr(x) for c, x in state.items()}) if held is None else now.join(held, "_key")
        after = now.select("_key", F.expr(applied).alias("s")).checkpoint()
        done.append(after.select(F.explode("s.out").alias("r")))
        held = after.select("_key", *[f"s.{c}" for c in state])
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    return out.select("r.*")
