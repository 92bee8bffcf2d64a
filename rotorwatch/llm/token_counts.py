"""Token counts without tokens: vocabulary matches from an Aho-Corasick automaton, best score and piece count by
dynamic programming.

The automaton lists, for each end position, the matching pieces from the longest to the shortest. A later
candidate replaces an earlier one only if its score is higher, so of equal scores the longest last piece wins,
and the piece for an unknown character comes last: the exact rule of the tokenizer. Only one score
and one count are kept per position of a part; parts are the stretches between boundaries that no piece crosses.
Null and empty texts have no tokens.
"""

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rotorwatch.llm import unigram
from rotorwatch.llm.common import use_python

CACHED_PARTS = 1_000_000


class PieceCounter:
    def __init__(self, model: unigram.Unigram):
        self.unknown, self.parts, self.cache = model.unknown_score, re.compile(model.segments), {}
        self.matches = ahocorasick.Automaton()
        for piece, (_, score) in model.pieces.items():
            self.matches.add_word(piece, (len(piece), score))
        self.matches.make_automaton()

    def part(self, part: str) -> int:
        """Pieces of the best segmentation of one part."""
        n, lowest = len(part), float("-inf")
        best, count = [0.0] + [lowest] * n, [0] * (n + 1)
        open_end, alone = 1, False  # alone: the character before open_end is a piece
        for last, (length, score) in self.matches.iter(part):
            end = last + 1
            while open_end < end:
                if not alone:
                    self._unknown(part, best, count, open_end)
                open_end, alone = open_end + 1, False
            offered = best[end - length] + score
            if offered > best[end]:
                best[end], count[end] = offered, count[end - length] + 1
            alone |= length == 1
        while open_end <= n:
            if not alone:
                self._unknown(part, best, count, open_end)
            open_end, alone = open_end + 1, False
        return count[n]

    def _unknown(self, part, best, count, end) -> None:
        offered = best[end - 1] + self.unknown
        if offered > best[end]:
            best[end], count[end] = offered, count[end - 1] + len(part[end - 1].encode())

    def text(self, text: str | None) -> int:
        total, cache = 0, self.cache
        for part in self.parts.findall(unigram.marked(text)):
            n = cache.get(part)
            if n is None:
                n = self.part(part)
                if len(part) <= 64:
                    if len(cache) >= CACHED_PARTS:
                        cache.clear()
                    cache[part] = n
            total += n
        return total


_counters: dict[str, PieceCounter] = {}  # per worker, kept over tasks


def count_batches(key: str, shared, batches):
    if key not in _counters:
        _counters[key] = PieceCounter(shared.value)
    counter = _counters[key]
    for batch in batches:
        counts = np.fromiter((counter.text(t.as_py()) for t in batch.column("text")), np.int64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(counts)], ["doc_id", "n_tokens"])


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and n_tokens of every text (columns doc_id and text are read)."""
    spark = docs.sparkSession
    use_python(spark)
    shared, key = unigram.shared(spark, path)
    return docs.select("doc_id", "text").mapInArrow(lambda batches: count_batches(key, shared, batches), "doc_id long, n_tokens long")
