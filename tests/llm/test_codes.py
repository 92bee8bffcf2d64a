"""Byte-level BPE against its library, and vector codes against a plain computation."""

import hashlib
import math
import random

import numpy as np
import pytest
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import rows
from rotorwatch.llm import byte_bpe, vector_codes

LONG = ["x" * 20000, " " * 3000 + "a", "é" * 5000, "12" * 4000, "\n" * 999]
TEXTS = [None, "", " ", "  ", "it's  a\n\n test", "Ünïcode日本語 😀'll", "a\u001ca\u0085b   c", "⳪7՘x 1\U0001fbf5", "a b " * 50, "a b " * 50, "<|endoftext|>"]


@pytest.fixture(scope="module")
def library(spark):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(spark), special_tokens={})


def test_documents_equal_library(spark, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "BLOCK_CHARACTERS", 300)  # many blocks
    data = [(i % 7 or None, t) for i, t in enumerate(TEXTS + LONG)]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumns({"words": F.lit("w"), "block": F.lit(1), "ids": F.lit(3)}).repartition(3)
    got = byte_bpe.decode_documents(byte_bpe.encode_documents(docs)).collect()
    want = [(d, library.encode_ordinary(t or ""), (t or "").encode()) for d, t in data]
    assert sorted(((r.doc_id, r.ids, bytes(r.decoded)) for r in got), key=repr) == sorted(want, key=repr)
    assert byte_bpe.encode_documents(docs.limit(0)).isEmpty()


def test_each_word_is_encoded_once(spark, library, monkeypatch):
    ranks, calls = spark.sparkContext.broadcast(byte_bpe.read_ranks(spark)), spark.sparkContext.accumulator(0)

    class Counted(byte_bpe.WordEncoder):
        def ids(self, word):
            calls.add(1)
            return super().ids(word)

    monkeypatch.setattr(byte_bpe, "WordEncoder", Counted)
    texts = [" the", "thing", "x" * 400]
    words = spark.createDataFrame([(w, b, 10 * b + n) for b in range(50) for n, w in enumerate(texts)], "word string, block long, number int")
    got = {}
    for r in byte_bpe.encode_words(words, ranks).collect():
        numbers, counts, ids = (byte_bpe.unpack(r[c]).tolist() for c in ("numbers", "counts", "ids"))
        for n, size in zip(numbers, counts):
            got[r.block, n], ids = ids[:size], ids[size:]
    assert got == {(b, 10 * b + n): library.encode_ordinary(w) for b in range(50) for n, w in enumerate(texts)}
    assert calls.value in (0, 3)  # 0 where the task does not see the counting class


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="aehtinrs .,\n ñéß日😀0123_'\t⳪7", max_size=120))
def test_words_equal_library(spark, library, text):
    find, encoder = SPLIT.finder(), byte_bpe.WordEncoder(byte_bpe.read_ranks(spark))
    text = text.encode("utf-8", "replace").decode()
    assert [i for w in find(text) for i in encoder.ids(w.encode())] == library.encode_ordinary(text)


SPLIT = byte_bpe.Splitter.of()


def test_classes_follow_the_library(library):
    """Characters that are a letter or number in one edition of Unicode only."""
    find, encoder = SPLIT.finder(), byte_bpe.WordEncoder(library._mergeable_ranks)
    odd = [c for c in map(chr, (*range(0x500, 0xD800), *range(0x10000, 0x20000))) if byte_bpe.regex.match(SPLIT.odd, c)]
    assert odd
    for c in odd:
        text = f"a{c}a 1{c}1 !{c}! {c}{c}"
        assert [i for w in find(text) for i in encoder.ids(w.encode())] == library.encode_ordinary(text)


def plain_codes(data, parts, entries, rounds):
    """The contract, one value at a time."""
    kept = [(v, [math.floor(4096 * x) for x in e], label) for v, e, label in data if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], []
    width = -(-max(len(e) for _, e, _ in kept) // parts) * parts
    kept = [(v, e + [0] * (width - len(e)), label) for v, e, label in kept]
    w = width // parts
    cut = lambda e, p: e[p * w:(p + 1) * w]
    books = [[cut(e, p) for _, e, _ in kept[:entries]] for p in range(parts)]

    def nearest(p, part):
        far = [sum((a - b) ** 2 for a, b in zip(part, entry)) for entry in books[p]]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, e, _ in kept:
                groups.setdefault(nearest(p, cut(e, p))[0], []).append(cut(e, p))
            for n, members in groups.items():
                books[p][n] = [sum(c) // len(members) for c in zip(*members)]
    found = [(v, label, [nearest(p, cut(e, p)) for p in range(parts)]) for v, e, label in kept]
    return [(v, label, [n for n, _ in near], sum(d for _, d in near)) for v, label, near in found], books


@pytest.mark.parametrize("case", ["random", "few", "ties", "huge", "ragged"])
def test_codes_equal_plain(spark, case, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK_VALUES", 100)  # many blocks
    rng = random.Random(case)
    n, dim, size = {"few": (5, 4, 1), "huge": (40, 8, 1e12)}.get(case, (150, 8, 1))
    value = (lambda: rng.choice([0.0, 0.25, -0.25])) if case == "ties" else (lambda: float(np.float32(rng.gauss(0, size))) if rng.random() < 0.9 else 0.5)
    data = [(rng.choice([None, i, i, i, i // 3]), [value() for _ in range(dim - (rng.randrange(5) if case == "ragged" else 0))], rng.choice([None, 1, 2])) for i in range(n)]
    data += [(1, None, 1), (2, [None] * dim, 1), (3, [float("nan")] * dim, 1), (4, [float("inf")] + [0.0] * (dim - 1), None)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").withColumn("codes", F.lit("x")).repartition(3)
    want, want_books = plain_codes(data, 4, 6, 3)
    if case == "huge":
        assert max(e for *_, e in want) > 2**63
        with pytest.raises(Exception, match="too large|int too big|Overflow"):
            vector_codes.compress(frame, 4, 6, 3)
        return
    coded, books = vector_codes.compress(frame, 4, 6, 3)
    assert books.tolist() == want_books
    assert rows(coded) == sorted(want, key=repr)
    got = vector_codes.with_label_error(coded)
    sums = {k: sum(e for _, label, _, e in want if label == k) for k in (None, 1, 2)}
    assert got.count() == len(want) and all(r.label_error == sums[r.label] for r in got.collect())


def test_codes_of_large_integers_are_exact(spark):
    data = [(i, [3e5 + (i % 3) / 4096, float(i)], 1) for i in range(40)]
    coded, books = vector_codes.compress(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int"), 2, 4, 2)
    want, want_books = plain_codes(data, 2, 4, 2)
    assert rows(coded) == sorted(want, key=repr) and books.tolist() == want_books


def test_codes_of_nothing(spark):
    empty = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")
    coded, books = vector_codes.compress(empty)
    assert coded.isEmpty() and vector_codes.codebooks_sha256(books) == hashlib.sha256(b"").hexdigest()
    blank = spark.createDataFrame([(1, [], 1)], "vec_id long, embedding array<float>, label int")
    assert [tuple(r) for r in vector_codes.compress(blank)[0].collect()] == [(1, 1, [0] * 8, 0)]
    assert vector_codes.compress(empty.limit(0))[0].isEmpty()


def test_hex_code(spark):
    assert spark.range(1).select(vector_codes.hex_code(F.array(F.lit(0), F.lit(15), F.lit(16)))).first()[0] == "000f10"
