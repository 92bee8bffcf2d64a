"""SentencePiece ids by a streaming Viterbi, and texts from ids.

The encoder keeps scores for the last ``longest`` positions and back pointers for the positions that are
not settled. Whenever all paths that can still go on run through one boundary, the ids up to it are
given out and forgotten, so a text of any length needs a window of a few pieces. Parts between
boundaries that no piece can cross (words, mostly) are settled on their own; their ids are remembered in a
bounded cache, for words repeat.

Null and empty texts have no ids; decoding gives back the text (null: empty). Texts that hold U+2581
decode to spaces there, as with the library; ``round_trip`` is then false.
"""

import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rotorwatch.llm import unigram
from rotorwatch.llm.common import use_python

CACHED_PARTS = 800_000


class StreamingViterbi:
    """``feed`` takes characters and yields settled ids; ``finish`` yields the rest."""

    def __init__(self, model: unigram.Unigram):
        self.model, self.text = model, ""  # positions count from the window's start
        self.best, self.back = [0.0], [None]  # back: where the last piece starts, and its id

    def feed(self, more: str) -> Iterator[int]:
        """``more`` is taken in by small blocks, so that the window stays small."""
        block = 4 * self.model.longest
        for at in range(0, len(more), block):
            self._extend(more[at:at + block])
            if len(self.text) >= block:
                yield from self._settle()

    def finish(self) -> Iterator[int]:
        yield from self._give(len(self.text))

    def _extend(self, more: str) -> None:
        """Best score and last piece of every new position, from the pieces that end there; of equal scores the longest piece stays."""
        best, back, unknown = self.best, self.back, self.model.unknown_score
        overlap = min(len(self.text), self.model.longest - 1)  # a piece may start so far back
        base = overlap - len(self.text) - 1  # a match that ends with the i-th character searched ends at position i - base
        open_end, alone = len(best), False  # alone: the character before open_end is a piece
        best += [float("-inf")] * len(more)
        back += [None] * len(more)
        searched = self.text[len(self.text) - overlap:] + more if overlap else more
        self.text += more
        for last, (length, score, number) in self.model.matches.iter(searched):
            end = last - base
            if end < open_end:
                continue  # ends in the block before
            while open_end < end:
                if not alone and best[open_end - 1] + unknown > best[open_end]:
                    best[open_end], back[open_end] = best[open_end - 1] + unknown, (open_end - 1, None)
                open_end, alone = open_end + 1, False
            offered = best[end - length] + score
            if offered > best[end]:
                best[end], back[end] = offered, (end - length, number)
            if length == 1:
                alone = True
        while open_end < len(best):
            if not alone and best[open_end - 1] + unknown > best[open_end]:
                best[open_end], back[open_end] = best[open_end - 1] + unknown, (open_end - 1, None)
            open_end, alone = open_end + 1, False

    def _settle(self) -> Iterator[int]:
        """Give out what lies before the boundary where the paths to all positions that a later piece may start at meet."""
        open_ends = set(range(len(self.text) - self.model.longest + 1, len(self.text) + 1))
        while len(open_ends) > 1:
            last = max(open_ends)
            open_ends.remove(last)
            open_ends.add(self.back[last][0])
        if meeting := open_ends.pop():
            yield from self._give(meeting)

    def _give(self, end: int) -> Iterator[int]:
        """Ids up to a settled boundary; the window then starts there."""
        path, at = [], end
        while at:
            start, piece = self.back[at]
            path.append([piece] if piece is not None else [self.model.byte_ids[b] for b in self.text[start].encode()])
            at = start
        for ids in reversed(path):
            yield from ids
        self.text, self.best = self.text[end:], self.best[end:]
        self.back = [None, *(b and (b[0] - end, b[1]) for b in self.back[end + 1:])]


def encode(model: unigram.Unigram, text: str | None, block: int = 4096) -> list[int]:
    """Ids of one text, fed in blocks."""
    stream, form, out = StreamingViterbi(model), unigram.marked(text), []
    for at in range(0, len(form), block):
        out.extend(stream.feed(form[at:at + block]))
    out.extend(stream.finish())
    return out


def decode(model: unigram.Unigram, ids) -> str:
    """The text of ids; bytes that form no character become U+FFFD. The space put in front goes."""
    return b"".join(map(model.surface.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")


class PartCache:
    """Ids of a text as bytes, with the ids of its parts remembered."""

    def __init__(self, model: unigram.Unigram):
        self.model, self.parts, self.cache = model, re.compile(model.segments), {}

    def ids(self, text: str | None) -> bytes:
        out, cache = [], self.cache
        for part in self.parts.findall(unigram.marked(text)):
            known = cache.get(part)
            if known is None:
                stream = StreamingViterbi(self.model)
                known = array("i", chain(stream.feed(part), stream.finish())).tobytes()
                if len(part) <= 64:
                    if len(cache) >= CACHED_PARTS:
                        cache.clear()
                    cache[part] = known
            out.append(known)
        return b"".join(out)


_caches: dict[str, PartCache] = {}  # per worker, kept over tasks


def encode_batches(key: str, shared, batches):
    if key not in _caches:
        _caches[key] = PartCache(shared.value)
    cache = _caches[key]
    for batch in batches:
        texts = batch.column("text").to_pylist()
        raw = [cache.ids(t) for t in texts]
        lengths = np.fromiter((len(r) // 4 for r in raw), np.int32, len(raw))
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        values = np.frombuffer(b"".join(raw), "<i4")
        plain = values.tolist()
        back = [decode(cache.model, plain[a:b]) for a, b in zip(offsets, offsets[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.array(lengths),
             pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), pa.array(back, pa.string()),
             pa.array([b == (t or "") for b, t in zip(back, texts)], pa.bool_())],
            ["doc_id", "n_ids", "ids", "decoded", "round_trip"],
        )


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_ids, ids, decoded, round_trip of every text (columns doc_id and text are read)."""
    spark = docs.sparkSession
    use_python(spark)
    shared, key = unigram.shared(spark, path)
    return docs.select("doc_id", "text").mapInArrow(
        lambda batches: encode_batches(key, shared, batches),
        "doc_id long, n_ids int, ids array<int>, decoded string, round_trip boolean",
    )
