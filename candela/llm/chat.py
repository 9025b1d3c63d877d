"""Preference formatting of chat conversations.

A pair holds a chosen and a rejected conversation. Their longest common prefix
of turns is rendered once, as the prompt; what follows is rendered twice, as
the chosen and the rejected completion, each with the character spans that a
loss may count: the assistant's text with its closing mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<|end|>\n"


def _escaped(text: Column) -> Column:
    """Template marks inside a text lose their force."""
    return F.replace(text, F.lit("<|"), F.lit("<\\|"))


def _rendered(t: Column) -> Column:
    return F.concat(F.lit("<|"), _escaped(t["role"]), F.lit("|>\n"), _escaped(t["text"]), F.lit(END))


def _side(side: str) -> Column:
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return F.array_sort(F.collect_list(F.when(F.col("side") == side, turn))).alias(side)


def _completion(turns: Column, assistant: str) -> Column:
    """(text, spans): rendered turns, and the (start, end) of what the assistant says in them."""
    kind = "struct<at:int,spans:array<struct<start:int,end:int>>>"
    start = F.struct(F.lit(0).alias("at"), F.array().alias("spans")).cast(kind)

    def step(acc: Column, t: Column) -> Column:
        end = (acc["at"] + F.length(_rendered(t))).alias("at")
        span = F.struct((acc["at"] + F.length(_escaped(t["role"])) + 5).alias("start"),      # 5: the marks around the role
                        (acc["at"] + F.length(_rendered(t))).alias("end"))
        return F.struct(end, F.when(t["role"] == assistant, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
                        .alias("spans")).cast(kind)

    return F.struct(F.array_join(F.transform(turns, _rendered), "").alias("text"),
                    F.aggregate(turns, start, step, lambda acc: acc["spans"]).alias("spans"))


def format_pairs(turns: DataFrame, pair_col: str = "pair_id", assistant: str = "assistant") -> DataFrame:
    """One row per pair: pair id, n_prefix (turns), prompt, chosen, rejected (text, spans).

    ``turns``: pair id, side ('chosen' or 'rejected'), turn, role, text; other
    columns are not used. Turns are ordered by (turn, role, text), null role and text
    count as empty, repeated rows are turns of their own. A side without turns is
    an empty conversation; equal sides leave empty completions. Rows of a
    null pair id form one pair; an empty table gives an empty result.
    """
    sides = turns.groupBy(F.col(pair_col)).agg(_side("chosen"), _side("rejected"))
    equal = F.zip_with("chosen", "rejected", lambda a, b: F.coalesce(
        (a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    differs = F.array_position(equal, F.lit(False))
    n = F.when(differs == 0, F.size("chosen")).otherwise(differs - 1).cast("int")
    rest = lambda c: F.slice(c, F.col("n_prefix") + 1, F.size(c))
    cut = sides.withColumn("n_prefix", n)
    return cut.select(pair_col, "n_prefix",
                      F.array_join(F.transform(F.slice("chosen", 1, F.col("n_prefix")), _rendered), "").alias("prompt"),
                      _completion(rest("chosen"), assistant).alias("chosen"),
                      _completion(rest("rejected"), assistant).alias("rejected"))


def mismatched_pairs(conversations: DataFrame, id_col: str = "conv_id", assistant: str = "assistant") -> DataFrame:
    """Turns of preference pairs made from plain conversations, one pair for each with an assistant turn.

    Chosen is the conversation itself. Rejected is the same with its last
    assistant turn replaced by that of its neighbour, the conversation whose id
    differs in the last bit (empty if that has none). Conversations without an
    assistant turn, and all turns with a null id, are left out.
    """
    t = conversations.select(F.col(id_col).cast("long").alias("pair_id"), "turn", "role", "text")
    said = t.filter(F.col("role") == assistant)
    reply = (said.groupBy("pair_id").agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("m"))
             .select("pair_id", F.col("m.turn").alias("last"), F.col("m.text").alias("reply")))
    other = reply.select(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"), F.col("reply").alias("swap"))
    rows = t.join(reply.select("pair_id", "last").join(other, "pair_id", "left"), "pair_id")
    swapped = F.when((F.col("role") == assistant) & (F.col("turn") == F.col("last")), F.coalesce("swap", F.lit("")))
    sides = F.explode(F.array(F.struct(F.lit("chosen").alias("side"), F.col("text").alias("text")),
                              F.struct(F.lit("rejected").alias("side"), F.coalesce(swapped, F.col("text")).alias("text"))))
    return rows.select("pair_id", "turn", "role", sides.alias("s")).select("pair_id", "s.side", "turn", "role", "s.text")
