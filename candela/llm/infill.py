"""Fill-in-the-middle documents, cut by a Roaring-style boundary set.

The places where a unit of a text ends form a set of byte offsets. The set is
kept by blocks of 2^16 offsets, each in the smallest of three containers:

* array: the sorted low halves (few boundaries),
* bitmap: one bit per offset, with the running count of every 64-bit word,
* run: first offset and length of each run (plain ASCII text is a single run).

Cumulative cardinalities over the containers answer "where does the k-th
boundary lie": a binary search finds the container, a local select (an index, a
search in the running counts, a search in the run lengths) the offset. The
text is cut at the offsets of both cuts; nothing is decoded or indexed by character.

Two numbers per document, drawn from the SHA-256 of its id, are the cuts;
two more choose the form. The text is rebuilt from output and form by SQL functions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.llm.common import U64, batch, frugal, slices, texts, with_row

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_SLICE = 2 << 20
BLOCK = 1 << 16
#: Bytes of a bitmap container, and of one entry of the two others.
_BITMAP_BYTES, _ARRAY_BYTES, _RUN_BYTES = BLOCK // 8, 2, 4
_LINE = re.compile(rb"\n")
_WORD = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+")


class Container:
    """The low halves of one block of a boundary set: ``kind`` array, bitmap or run, and ``card`` members."""

    __slots__ = ("kind", "card", "a", "b")

    def __init__(self, low: np.ndarray):
        """``low``: sorted distinct offsets below 2^16, at least one."""
        self.card = len(low)
        new = np.flatnonzero(np.diff(low) != 1) + 1
        runs = len(new) + 1
        sizes = {"run": runs * _RUN_BYTES, "array": self.card * _ARRAY_BYTES, "bitmap": _BITMAP_BYTES}
        self.kind = min(sizes, key=sizes.get)
        if self.kind == "run":
            first = np.r_[0, new]
            self.a, self.b = low[first].astype(np.uint16), first.astype(np.int32)    # start of a run, members before it
        elif self.kind == "array":
            self.a, self.b = low.astype(np.uint16), None
        else:
            bits = np.zeros(BLOCK, np.uint8)
            bits[low] = 1
            self.a = np.packbits(bits, bitorder="little").view(U64)
            self.b = np.r_[0, np.cumsum(np.bitwise_count(self.a), dtype=np.int32)]   # members before each word

    def select(self, k: int) -> int:
        """The k-th member, from 0."""
        if self.kind == "array":
            return int(self.a[k])
        if self.kind == "run":
            r = int(np.searchsorted(self.b, k, "right")) - 1
            return int(self.a[r]) + k - int(self.b[r])
        word = int(np.searchsorted(self.b, k, "right")) - 1
        bits = np.unpackbits(self.a[word:word + 1].view(np.uint8), bitorder="little")
        return word * 64 + int(np.flatnonzero(bits)[k - int(self.b[word])])


class Boundaries:
    """Byte offsets of a text's unit boundaries: 0, every end of a unit."""

    def __init__(self, text: bytes, unit: str = "char"):
        self.keys: list[int] = []
        self.held: list[Container] = []
        self.cum = [0]                       # members before each container
        for key, low in _blocks(text, unit):
            self.keys.append(key)
            self.held.append(Container(low))
            self.cum.append(self.cum[-1] + self.held[-1].card)

    def __len__(self) -> int:
        return self.cum[-1]

    def select(self, k: int) -> int:
        """Byte offset of the k-th boundary, 0 <= k <= number of units."""
        c = int(np.searchsorted(self.cum, k, "right")) - 1
        return self.keys[c] * BLOCK + self.held[c].select(k - self.cum[c])


def _blocks(text: bytes, unit: str) -> Iterator[tuple[int, np.ndarray]]:
    """(block, offsets inside it) of the boundaries of ``text``, a block at a time."""
    if unit == "char":
        data = np.frombuffer(text, np.uint8)
        for lo in range(0, len(text) + 1, BLOCK):
            low = np.flatnonzero((data[lo:lo + BLOCK] & 0xC0) != 0x80)
            if lo + BLOCK > len(text):                                   # the end of the text is a boundary
                low = np.r_[low, len(text) - lo]
            if len(low):
                yield lo // BLOCK, low
        return
    ends = (m.end() for m in {"word": _WORD, "line": _LINE}[unit].finditer(text))
    key, held = 0, [0]
    for end in (*ends, len(text)):
        if end // BLOCK != key:
            if held:
                yield key, np.array(held)
            key, held = end // BLOCK, []
        if not held or held[-1] != end % BLOCK:
            held.append(end % BLOCK)
    yield key, np.array(held)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "char",
                   plain_percent: int = 10, spm_percent: int = 20, salt: str = "1:") -> DataFrame:
    """Rows of ``docs`` as struct ``row``, with n (units, long), form, prefix_units, middle_units (long) and output.

    Units are code points ("char"), words with the white space after them
    ("word") or lines ("line"). The prefix ends after the smaller of two units drawn from the
    digest of salt and id, the middle after the larger. Forms: plain (the text as it is, counts null) if the
    text is empty, holds a marker, or is drawn; spm (suffix first) or psm
    (prefix first) otherwise. Null texts are empty, a null id counts as an empty string;
    repeated rows give equal outputs. Empty tables give no rows.
    """
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draw = lambda i: F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")
    rows = docs.select(F.struct("*").alias("row"), *[draw(i).alias(f"h{i + 1}") for i in range(4)])
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    p, s, m = marks

    def text_of(b: pa.RecordBatch) -> pa.Array:
        return pc.struct_field(b.column(0), text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = {"n": pa.int64(), "form": pa.string(), "prefix_units": pa.int64(), "middle_units": pa.int64(), "output": pa.string()}
        for b in slices(batches, _SLICE, text_of):
            h = np.stack([b.column(i).to_numpy() for i in range(1, 5)], axis=1).tolist()
            out = {k: [] for k in kind}
            for text, (h1, h2, h3, h4) in zip(texts(text_of(b)), h):
                edges = Boundaries(text, unit)
                n = len(edges) - 1
                form, k1, k2, made = "plain", None, None, text
                if text and h3 % 100 >= 100 - plain_percent or any(x in text for x in marks):
                    pass
                elif text:
                    k1, k2 = sorted((h1 % (n + 1), h2 % (n + 1)))
                    i, j = edges.select(k1), edges.select(k2)
                    form = "spm" if h4 % 100 < spm_percent else "psm"
                    made = b"".join((s, text[j:], p, text[:i], m, text[i:j]) if form == "spm" else (p, text[:i], s, text[j:], m, text[i:j]))
                for k, v in zip(kind, (n, form, k1, None if k1 is None else k2 - k1, made.decode())):
                    out[k].append(v)
            yield batch({"row": None} | kind, {"row": b.column(0)} | out)

    return rows.mapInArrow(frugal(run), with_row(rows, "n long, form string, prefix_units long, middle_units long, output string"))


def restored(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` made ``output`` of: markers stand nowhere else, so pieces lie between them."""
    last = F.substring_index(output, MIDDLE, -1)
    head = F.substring_index(output, MIDDLE, 1)
    after_p = lambda x: F.substring_index(x, PREFIX, -1)
    after_s = lambda x: F.substring_index(x, SUFFIX, -1)
    psm = F.concat(after_p(F.substring_index(head, SUFFIX, 1)), last, after_s(head))
    spm = F.concat(after_p(head), last, after_s(F.substring_index(head, PREFIX, 1)))
    return F.when(form == "plain", output).when(form == "psm", psm).when(form == "spm", spm)
