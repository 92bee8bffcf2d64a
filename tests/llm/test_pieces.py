"""The codec and the counter against the library, which reads the same pieces as a unigram model."""

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
from tokenizers.models import Unigram

from rotorwatch.llm import piece_codec, token_counts, unigram

MODEL = unigram.load()
COUNTER = token_counts.PieceCounter(MODEL)
TEXTS = [None, "", " ", "  ", "a", " a  b ", "The than thhasted attionen thesat ed in oran.\nIs eroresly", "\n\n\t\n", "é😀é 日本語 ñ",
         "x" * 5000, " " * 900, "ab" * 2000 + "\n" + "é" * 40, "1" * 300 + " +1 (875) 555-8822"]


@pytest.fixture(scope="module")
def library():
    """The same pieces and scores in a library's unigram model, which adds scores in double precision."""
    file = sentencepiece.SentencePieceProcessor(model_file=unigram.default_path())
    return Tokenizer(Unigram([(file.id_to_piece(i), file.get_score(i)) for i in range(file.get_piece_size())], 0, True))


def wanted(library, text):
    return library.encode(unigram.marked(text), add_special_tokens=False).ids if text else []


@pytest.mark.parametrize("text", TEXTS)
def test_equals_library(library, text):
    ids = wanted(library, text)
    assert piece_codec.encode(MODEL, text, 7) == ids
    assert COUNTER.text(text) == len(ids)
    assert piece_codec.decode(MODEL, ids) == (text or "")


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aehtinrs .,\n ñéß日😀0123_", max_size=120))
def test_random_texts_equal_library(library, text):
    ids = wanted(library, text)
    assert piece_codec.encode(MODEL, text, 11) == ids
    assert COUNTER.text(text) == len(ids)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abc ", max_size=60), st.dictionaries(st.text(alphabet="abc▁", min_size=1, max_size=6), st.integers(-4, 0), min_size=1, max_size=20))
def test_ties_and_any_vocabulary(text, scores):
    """Any vocabulary, also with pieces across spaces, and many equal sums: against a plain table over all starts."""
    model = unigram.build({p: (i + 300, float(s)) for i, (p, s) in enumerate(sorted(scores.items()))}, range(256), ())
    form = unigram.marked(text)
    best = [(0.0, [])] + [(float("-inf"), None)] * len(form)
    for start in range(len(form)):
        found = [e for e in range(start + 1, len(form) + 1) if form[start:e] in model.pieces]
        for end in found + ([] if start + 1 in found else [start + 1]):
            piece = model.pieces.get(form[start:end])
            ids = [piece[0]] if piece else list(form[start:end].encode())
            score = best[start][0] + (piece[1] if piece else model.unknown_score)
            if score > best[end][0]:
                best[end] = (score, best[start][1] + ids)
    assert piece_codec.encode(model, text, 3) == best[-1][1]
    assert token_counts.PieceCounter(model).text(text) == len(best[-1][1])


def test_window_stays_small():
    stream, largest = piece_codec.StreamingViterbi(MODEL), 0
    for _ in range(3000):
        list(stream.feed("ab▁the"))
        largest = max(largest, len(stream.text))
    assert largest < 20 * MODEL.longest


def test_window_stays_small_in_one_long_word(monkeypatch):
    """A word fed as a whole needs no more than one fed in bits, and time in proportion to its length."""
    largest, extend = [0], piece_codec.StreamingViterbi._extend

    def watched(self, upto):
        extend(self, upto)
        largest[0] = max(largest[0], len(self.text), len(self.best))

    monkeypatch.setattr(piece_codec.StreamingViterbi, "_extend", watched)
    assert len(piece_codec.PartCache(MODEL).ids("abthe" * 60_000)) > 0
    assert largest[0] < 20 * MODEL.longest


def test_documents(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "a b", "y"), (3, "  ", "z")], "doc_id long, text string, ids string")
    rows = piece_codec.encode_documents(docs).collect()
    assert len(rows) == len(TEXTS) + 2 and all(r.round_trip for r in rows)
    counts = token_counts.count_tokens(docs).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in counts) == sorted((r.doc_id or 0, r.n_ids) for r in rows)
    assert piece_codec.encode_documents(docs.limit(0)).count() == token_counts.count_tokens(docs.limit(0)).count() == 0
