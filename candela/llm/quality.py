"""Quality rules with risk-controlled thresholds.

Rules are numbers per text for which larger means worse; every rule has a grid of
cutoffs from the loosest to the strictest. The verdicts form one ordered family:
level t rejects a text that is beyond cutoff t of any rule (the last one, where
a grid is shorter), so each level rejects whatever the level before it rejects. Labelled rows are a
holdout: per stratum they count the good and bad texts that each level rejects. From the
loosest level on, an exact binomial test asks whether the joint verdict rejects at most
``risk`` of the stratum's good texts (P(Bin(n, risk) <= k) <= level); testing stops at
the first level that fails (fixed sequence), so all levels certified in a stratum
share one error level, and the error levels of all strata add up to ``error`` (Bonferroni). Of
the certified levels the one that best separates bad from good is used, none
if no level does. So with confidence 1 - error, no stratum loses more than ``risk`` of its good
texts to the rules.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.llm.common import U64, WordHash, rolling, slices, texts, with_row

SPAN = 8
_SLICE = 2 << 20
_SYMBOL = bytes(set(range(256)) - set(b"#*$%&|<>"))
_UPPER = bytes(set(range(256)) - set(range(65, 91)))
_LETTER = bytes(set(range(256)) - set(range(65, 91)) - set(range(97, 123)))
_MARK = bytes(set(range(256)) - set(b"!?|#*$%&<>=+~^_@{}[]\\/"))
_CONTINUATION = bytes(range(128, 192))
_SPACE = b" \t\n\r\x0b\f"
_ENDED = re.compile(rb"[.!?:;\"')\]]$")

#: Rule -> cutoffs from the loosest to the strictest; a text fails a rule if its value is above the cutoff.
GRID = {
    "symbol_share": [0.5, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02, 0.01],       # symbols per word
    "mark_share": [0.5, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02, 0.01],         # marks per word character
    "upper_share": [0.95, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1],                  # capitals among ASCII letters
    "dup_line_share": [0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05],               # repeated among worded lines
    "repeat_share": [0.29, 0.25, 0.2, 0.15, 0.1, 0.05],                              # words in repeated 8-word spans
    "open_line_share": [0.99, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3],                    # lines that end without a stop
    "letterless_share": [0.8, 0.6, 0.45, 0.35, 0.25, 0.15, 0.1, 0.05],               # words without letter
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeat_words(words: list[bytes], hashed: WordHash) -> int:
    """Words inside ``SPAN``-word windows that stand at two or more places of the list."""
    if len(words) <= SPAN:
        return 0
    spans = rolling(np.fromiter(map(hashed.__getitem__, words), U64, len(words)), SPAN)
    order = np.argsort(spans, kind="stable")
    same = spans[order[1:]] == spans[order[:-1]]
    if not same.any():
        return 0
    hit = np.unique(np.r_[order[1:][same], order[:-1][same]])
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.subtract.at(edge, hit + SPAN, 1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: bytes, hashed: WordHash) -> list[float]:
    """The five counts and the rule values of one text, in the order of COUNTS and GRID."""
    words = text.split()
    n = len(words)
    word_bytes = text.translate(None, _SPACE)
    chars = len(word_bytes.translate(None, _CONTINUATION))
    symbols = len(text.translate(None, _SYMBOL))
    letters, upper = len(text.translate(None, _LETTER)), len(text.translate(None, _UPPER))
    lines = [x for x in text.split(b"\n") if x.strip(_SPACE)]
    dup = len(lines) - len(set(lines))
    repeat = repeat_words(words, hashed)
    bare = sum(1 for w in words if len(w) < 8 and w.isascii() and not any(65 <= c & 0xDF <= 90 for c in w))
    return [n, chars, symbols, dup, repeat,
            symbols / max(n, 1), len(text.translate(None, _MARK)) / max(chars, 1), upper / max(letters, 1),
            dup / max(len(lines), 1), repeat / max(n, 1),
            sum(not _ENDED.search(x.rstrip(_SPACE)) for x in lines) / max(len(lines), 1), bare / max(n, 1)]


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` without the text, as struct ``row``, with COUNTS (long), a double per rule and base_failed.

    Null texts have no words. base_failed: under 20 words, or over 30 % of them in repeated spans.
    """
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != text_col]).alias("row"),
                       F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = WordHash()
        for b in slices(batches, _SLICE, lambda x: x.column(1)):
            found = np.array([measure(t, hashed) for t in texts(b.column(1))]).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(found[:, i].astype(np.int64)) for i in range(len(COUNTS))),
                 *(pa.array(found[:, i]) for i in range(len(COUNTS), found.shape[1]))], ["row", *COUNTS, *GRID])

    fields = [f"{c} long" for c in COUNTS] + [f"{r} double" for r in GRID]
    return (rows.mapInArrow(run, with_row(rows, ", ".join(fields)))
            .withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), exactly summed."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
            for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def choose(good: list[int], bad: list[int], n_good: int, n_bad: int, risk: float, level: float) -> int | None:
    """Index of the level to use, given good and bad texts rejected by each level, loosest first; None: no level.

    The best certified level has the largest share of bad minus share of good rejected.
    """
    best, at = 0.0, None
    for i, (g, b) in enumerate(zip(good, bad)):
        if not n_good or binomial_tail(g, n_good, risk) > level:
            break
        gain = b / max(n_bad, 1) - g / n_good
        if gain > best:
            best, at = gain, i
    return at


LEVELS = max(map(len, GRID.values()))


def cutoff_at(rule: str, level: int) -> float:
    return GRID[rule][min(level, len(GRID[rule]) - 1)]


def rejected_from(values) -> Column:
    """The loosest level that rejects a text, LEVELS if none does; ``values`` maps a rule to its column."""
    first = [F.array_position(F.array(*[values(r) > cutoff_at(r, t) for t in range(LEVELS)]), True) for r in GRID]
    return F.least(*[F.when(p > 0, p - 1).otherwise(LEVELS) for p in first])


def thresholds(measured: DataFrame, labelled: DataFrame, stratum, risk: float = 0.05, error: float = 0.05) -> DataFrame:
    """(stratum, rule, cutoff) certified on ``labelled`` (good: boolean, and the columns of ``measured``).

    Only texts that pass the base rules are counted. What reaches the driver
    are the counts per stratum and level. Strata without enough good texts get no cutoff: four strata
    need about 86 good texts each.
    """
    counts = (labelled.filter(~F.col("base_failed")).select(stratum.alias("stratum"), "good", rejected_from(F.col).alias("t"))
              .groupBy("stratum", "t").agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b")).toArrow().to_pylist())
    table: dict = {}
    for c in counts:
        table.setdefault(c["stratum"], np.zeros((2, LEVELS + 1), np.int64))[:, c["t"]] += (c["g"], c["b"])
    out = []
    for name, held in table.items():
        (good, bad), (n_good, n_bad) = held.cumsum(1).tolist(), held.sum(1).tolist()
        at = choose(good[:-1], bad[:-1], n_good, n_bad, risk, error / len(table))
        if at is not None:
            out += [(name, rule, cutoff_at(rule, at)) for rule in GRID]
    return measured.sparkSession.createDataFrame(out, "stratum string, rule string, cutoff double")


def judge(measured: DataFrame, cutoffs: DataFrame, stratum) -> DataFrame:
    """``measured`` with failed_rules (array) and kept: false if base_failed or any rule's value is above its cutoff."""
    wide = cutoffs.groupBy("stratum").pivot("rule", list(GRID)).agg(F.first("cutoff"))
    wide = wide.select(F.col("stratum").alias("_stratum"), *[F.col(r).alias(f"_cut_{r}") for r in GRID])
    failed = F.array_compact(F.array(*[F.when(F.col(r) > F.col(f"_cut_{r}"), F.lit(r)) for r in GRID]))
    return (measured.join(wide, stratum.eqNullSafe(F.col("_stratum")), "left").withColumn("failed_rules", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
            .drop("_stratum", *[f"_cut_{r}" for r in GRID]))
