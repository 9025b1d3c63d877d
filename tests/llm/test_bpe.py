import os
import random

import public_tokenizers
import pytest

from candela.llm import bpe

from .helpers import SCHEMA, corpus, documents

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


def test_engine_equals_library_on_all_kinds_of_characters(library):
    c = bpe.codec(PATH)
    for lo in range(0, 0x30000, 64):
        text = "".join(f"a{chr(i)} {chr(i)}1{chr(i)}{chr(i)}  " for i in range(lo, lo + 64) if not 0xD800 <= i < 0xE000)
        assert c.encode(text.encode()).tolist() == library.encode(text, add_special_tokens=False).ids, hex(lo)


def test_chunk_joins_equal_whole_encoding(library):
    c, rng = bpe.codec(PATH), random.Random(3)
    parts = ["the ", " and", "'re ", "don't", "  ", "\n", "\n\n", "<|endoftext|>", "é", "été ", "12", "!?", "日本", " ", "a", "\t", "　", "'"]
    for _ in range(600):
        text = "".join(rng.choices(parts, k=rng.randint(0, 150))).encode()
        ends = sorted({0, len(text), *(i for i in rng.choices(range(len(text) + 1), k=4) if i == len(text) or text[i] & 0xC0 != 0x80)})
        known = [(a, b, c.encode(text[a:b])) for a, b in zip(ends, ends[1:]) if rng.random() < 0.7]
        want = library.encode(text.decode(), add_special_tokens=False).ids
        assert bpe.encode_with(c, text, known).tolist() == want
        assert sum(map(c.count, bpe.split_text(text, 40))) == len(want)
        assert c.decode(want) == library.decode(want, skip_special_tokens=False) == text.decode()


def test_wrong_chunk_ids_are_not_used(library):
    """Ids that do not spell the chunk, as under a digest collision, fall back to encoding."""
    c = bpe.codec(PATH)
    text = ("some words here and there " * 20).encode()
    known = [(10, 200, c.encode(b"x" * 190)), (200, 300, c.encode(b"short"))]
    assert bpe.encode_with(c, text, known).tolist() == library.encode(text.decode(), add_special_tokens=False).ids


def test_cuts_are_content_defined():
    rng = random.Random(2)
    body = " ".join(f"w{rng.random()}" for _ in range(600)).encode()
    a, b = bpe.cuts(body, 7), bpe.cuts(b"another start \xc3\xa9 " + body, 7)
    shift = len(b"another start \xc3\xa9 ")
    assert len(a) > 20 and len({x + shift for x in a} & set(b)) > 0.9 * len(a)
    assert bpe.cuts(b"", 7) == [] and bpe.cuts(b"ab", 7) == [2]
    text = "é".encode() * 4000
    assert all(x == len(text) or text[x] & 0xC0 != 0x80 for x in bpe.cuts(text, 2))


def test_documents_equal_library(spark, library):
    rows = corpus()
    done = bpe.decode_ids(bpe.encode_documents(documents(spark), PATH, chunk_bits=6), PATH)
    got = done.select("row.doc_id", "row.`odd name.x`", "row.text", "ids", "decoded").collect()
    want = [(r[0], 7, r[1], library.encode(r[1] or "", add_special_tokens=False).ids, r[1] or "") for r in rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[2] or "")
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_counts_equal_library(spark, library):
    got = bpe.count_tokens(documents(spark), PATH, batch_bytes=1 << 14, part_bytes=1 << 10).select("row.text", "n_bytes", "n_tokens").collect()
    assert len(got) == len(corpus())
    for r in got:
        assert (r.n_bytes, r.n_tokens) == (len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids))


@pytest.mark.parametrize("run", [" " * 1_200_000, "\n" * 1_200_000, "\u3000" * 1_100_000, " \n\t\xa0" * 300_000])
def test_white_space_runs_beyond_the_engine(library, run):
    c = bpe.codec(PATH)
    for text in (f"some text {run}and more 'll {run}", f"a{run}<|endoftext|>{run}é", f"{run}\x1c1{run[:-1]}\n!", f"<|endoftext|>{run}\u200bx"):
        want = library.encode(text, add_special_tokens=False).ids
        body = text.encode()
        assert c.encode(body).tolist() == want and c.count(body) == len(want) and c.decode(want) == text
        assert sum(map(c.count, bpe.split_text(body, 1 << 16))) == len(want)


def test_long_white_space_in_documents(spark, library):
    texts = ["word " * 40 + " " * 1_200_000 + "end of it", "word " * 40 + "\n" * 1_200_000 + "end of it", "word " * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert {r.doc_id: r.ids for r in bpe.encode_documents(docs, PATH).select("row.doc_id", "ids").collect()} == want
    assert {r.doc_id: r.n_tokens for r in bpe.count_tokens(docs, PATH).select("row.doc_id", "n_tokens").collect()} == {i: len(x) for i, x in want.items()}


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert bpe.encode_documents(docs, PATH).count() == 0 and bpe.count_tokens(docs, PATH).count() == 0
