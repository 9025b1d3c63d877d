"""Language identification with error-correcting output codes.

Every language has a codeword; every bit of it is predicted by a binary
classifier over hashed byte trigrams (log-odds of the languages whose bit is
one against the others, each language weighing the same). The classifiers come
from trigram counts summed over all training rows. Those of four fifths of the
rows, tried on the other fifth, give each classifier's accuracy per language,
the weight of its loss. A text gets the language whose codeword has the smallest
weighted logistic loss; a text whose best and second codeword lie close is
flagged as ambiguous.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candela.llm.common import batch, frugal, slices, text_hash, texts, with_row

UNDETERMINED = "und"
BUCKET_BITS = 12
_SLICE = 4 << 20
_PIECE = 1 << 20
_ASCII_LETTER = re.compile(rb"[A-Za-z]")
#: ASCII bytes that are no letters become spaces.
_FOLD = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def features(text: bytes) -> np.ndarray:
    """Counts of the hashed byte trigrams of a whole text, case folded, white space aside."""
    out = np.zeros(1 << BUCKET_BITS, np.int64)
    folded = text.decode().lower().encode().translate(_FOLD) if text else b""
    padded = b" " + folded + b" "
    for at in range(0, len(folded), _PIECE):
        b = np.frombuffer(padded[at:at + _PIECE + 2], np.uint8).astype(np.uint32)
        code = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
        code = code[b[1:-1] != 32]
        out += np.bincount((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS), minlength=1 << BUCKET_BITS)
    return out


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or (not text.isascii() and any(c.isalpha() for c in text.decode()))


def codewords(n: int) -> np.ndarray:
    """(n, bits) matrix of +1 and -1: all splits for up to 7 languages, else random balanced ones (fixed seed)."""
    if n < 2:
        splits = []
    elif n <= 7:
        splits = [[1 if (s >> i) & 1 or i == 0 else -1 for i in range(n)] for s in range(0, (1 << n) - 2, 2)]
    else:
        rng = np.random.default_rng(n)
        splits = [np.where(rng.permutation(n) < n // 2, 1, -1) for _ in range(int(np.ceil(10 * np.log2(n))))]
    return np.array(splits, np.int64).reshape(len(splits), n).T


@dataclass
class Model:
    """languages (sorted), their codewords, classifier weights (bits, buckets) and loss weights (languages, bits)."""

    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def margins(self, counts: np.ndarray) -> np.ndarray:
        """Mean log-odds of each bit per trigram, scaled by the evidence (at most 40 trigrams' worth)."""
        n = counts.sum()
        return self.weights @ counts * (min(n, 40) / max(n, 1))

    def decode(self, counts: np.ndarray) -> tuple[str, float, float]:
        """Language, its probability and that of the second."""
        if len(self.languages) == 1:
            return self.languages[0], 1.0, 0.0
        loss = (self.trust * np.logaddexp(0, -self.codes * self.margins(counts))).sum(1)
        p = np.exp(loss.min() - loss)
        p /= p.sum()
        first, second = np.argsort(-p, kind="stable")[:2]
        return self.languages[first], float(p[first]), float(p[second])


def log_odds(counts: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Classifier weights (bits, buckets) from trigram counts per language."""
    share = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)
    ones, zeros = (codes.T > 0).astype(float), (codes.T < 0).astype(float)
    return np.log(ones @ share / np.maximum(ones.sum(1, keepdims=True), 1)) \
        - np.log(zeros @ share / np.maximum(zeros.sum(1, keepdims=True), 1))


def fit(rows: DataFrame, label_col: str = "lang", text_col: str = "text") -> Model:
    """Model from all ``rows`` with a label and a text; no such row gives a model without languages.

    What reaches the driver are sums per language: trigram buckets and, from the
    fifth of the rows kept for the trial, hits of every classifier. A language that
    stands in that fifth alone has equal loss weights.
    """
    known = rows.select(F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label")).dropna()
    known = known.withColumn("kept", F.pmod(text_hash(F.col("text")), F.lit(5)) == 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[bool, str], np.ndarray] = {}

        def out() -> pa.RecordBatch:
            at = [np.flatnonzero(c) for c in held.values()]
            keys = [key for key, x in zip(held, at) for _ in x]
            return batch({"kept": pa.bool_(), "label": pa.string(), "bucket": pa.int32(), "n": pa.int64()},
                         {"kept": [k for k, _ in keys], "label": [label for _, label in keys], "bucket": np.concatenate([np.empty(0, np.int64), *at]).astype(np.int32),
                          "n": np.concatenate([np.empty(0, np.int64), *(c[x] for c, x in zip(held.values(), at))])})

        for b in slices(batches, _SLICE, lambda x: x.column(0)):
            for text, label, kept in zip(texts(b.column(0)), b.column(1).to_pylist(), b.column(2).to_pylist()):
                held[kept, label] = held.get((kept, label), 0) + features(text)
            if len(held) > 256:
                yield out()
                held.clear()
        yield out()

    sums = (known.mapInArrow(frugal(count), "kept boolean, label string, bucket int, n long")
            .groupBy("kept", "label", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pydict())
    languages = sorted(set(sums["label"]))
    codes = codewords(len(languages))
    counts = np.zeros((2, len(languages), 1 << BUCKET_BITS))
    counts[np.array(sums["kept"], int), np.array([languages.index(x) for x in sums["label"]], int), sums["bucket"]] = sums["n"]
    if len(languages) < 2:
        return Model(languages, codes, np.zeros((0, 1 << BUCKET_BITS)), np.ones(codes.shape))
    model = Model(languages, codes, log_odds(counts[0], codes), np.ones(codes.shape))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {x: i for i, x in enumerate(languages)}
        seen, good = np.zeros(len(languages), np.int64), np.zeros(codes.shape, np.int64)
        for b in slices(batches, _SLICE, lambda x: x.column(0)):
            for text, label in zip(texts(b.column(0)), b.column(1).to_pylist()):
                if label in place:
                    i = place[label]
                    seen[i] += 1
                    good[i] += np.sign(model.margins(features(text))) == codes[i]
        bits = codes.shape[1]
        yield batch({"i": pa.int32(), "bit": pa.int32(), "seen": pa.int64(), "good": pa.int64()},
                    {"i": np.repeat(np.arange(len(languages), dtype=np.int32), bits),
                     "bit": np.tile(np.arange(bits, dtype=np.int32), len(languages)),
                     "seen": np.repeat(seen, bits), "good": good.ravel()})

    tested = (known.filter("kept").mapInArrow(frugal(hits), "i int, bit int, seen long, good long")
              .groupBy("i", "bit").agg(F.sum("seen").alias("seen"), F.sum("good").alias("good")).toArrow().to_pydict())
    accuracy = np.full(codes.shape, 0.5)
    accuracy[tested["i"], tested["bit"]] = (np.array(tested["good"]) + 1) / (np.array(tested["seen"]) + 2)
    accuracy[counts[0].sum(1) == 0] = 0.5
    trust = np.clip(accuracy - 0.5, 0.05, None)
    return Model(languages, codes, log_odds(counts.sum(0), codes), trust / trust.mean(1, keepdims=True))


def predict(docs: DataFrame, model: Model, text_col: str = "text", ambiguous_above: float = 0.4) -> DataFrame:
    """Rows of ``docs`` as struct ``row``, with lang_pred, score, lang_second_score and ambiguous.

    A text that is null or has no letter, and any text under a model without
    languages, gets ``und`` and score 0. ``ambiguous``: the second language's
    probability is above ``ambiguous_above``. Repeated rows stay repeated.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct("*").alias("row"))

    def text_of(b: pa.RecordBatch) -> pa.Array:
        return pc.struct_field(b.column(0), text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches, _SLICE, text_of):
            found = [m.decode(features(t)) if m.languages and has_letter(t) else (UNDETERMINED, 0.0, 0.0)
                     for t in texts(text_of(b))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()),
                 pa.array([x[2] for x in found], pa.float64()),
                 pa.array([x[2] > ambiguous_above for x in found], pa.bool_())],
                ["row", "lang_pred", "score", "lang_second_score", "ambiguous"])

    return rows.mapInArrow(frugal(run), with_row(rows, "lang_pred string, score double, lang_second_score double, ambiguous boolean"))


def held_out(id_col: str = "doc_id"):
    """Rows whose crc32 of the id, as text, leaves remainder 1 by 3 (a null id is never held out)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_on_fold(docs: DataFrame, id_col: str = "doc_id", label_col: str = "lang", text_col: str = "text") -> Model:
    """``fit`` on the rows that are not held out and have an id."""
    return fit(docs.filter(~held_out(id_col) & F.col(id_col).isNotNull()), label_col, text_col)


def keep_identified(docs: DataFrame, id_col: str = "doc_id", label_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose language is undetermined or ambiguous; columns are unchanged."""
    found = predict(docs, fit_on_fold(docs, id_col, label_col, text_col), text_col)
    return found.filter((F.col("lang_pred") != UNDETERMINED) & ~F.col("ambiguous")).select("row.*")
