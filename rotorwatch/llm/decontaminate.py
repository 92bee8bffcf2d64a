"""Benchmark decontamination by latent semantic retrieval.

Documents become numbers of benchmark terms, once. Document frequencies of the terms over blocks of words give TF-IDF; a
randomised SVD whose one pass over all blocks sums (terms x rank) sketches gives the latent space. Passages are runs of
blocks just long enough to hold an item at any offset; those with a high cosine to an item are candidates.
A candidate is contaminated if the longest common subsequence of words, inside a stretch little longer than
the item, covers nearly all of it, or most of it and its answer (the item's last sentence) too.

Only benchmark terms are columns: other words change neither a common subsequence nor the sign of a cosine. The
benchmark is a table of stated queries; it is collected behind a size check. All sums over documents are made on
executors and combined by aggregation. Null and empty texts hold nothing; items without words match nothing.
"""

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotorwatch.llm.common import landed, use_python

# Words of a block, rank of the latent space with oversampling, cosine of a candidate.
BLOCK, RANK, CANDIDATE_FROM = 16, 64, 0.4
# Share of an item that a common subsequence must cover; with the answer, and of the answer; stretch per item length.
COPIED, PARAPHRASED, ANSWERED, STRETCH = 0.8, 0.6, 0.8, 1.3
# Benchmark terms that are held in memory at most.
MOST_TERMS = 1_000_000
ENDINGS = ("", ".", ",", ";", ":", "!", "?")
SEED = 11
# Longer runs are added one by one; most frequent terms that are counted no more often than the item holds them.
LONG_RUN, EVERYDAY = 64, 128


@dataclass
class Items:
    ids: list  # item_id
    words: list  # term numbers of each item, in order
    answers: list  # where the answer starts in words
    terms: dict  # word as written, lower case, with or without a stop behind it: number
    size: int

    @property
    def kind(self) -> str:
        """Type in which term numbers are written."""
        return "<i2" if self.size < 1 << 15 else "<i4"

    @staticmethod
    def of(rows) -> "Items":
        terms, ids, words, answers = {}, [], [], []
        for item_id, text in rows:
            sentences = re.split(r"(?<=[.!?])\s+", (text or "").strip())
            parts = [[w.rstrip(".,;:!?") or w for w in s.lower().split()] for s in sentences]
            numbers = [terms.setdefault(w, len(terms)) for p in parts for w in p]
            if numbers:
                ids.append(item_id)
                words.append(np.array(numbers, np.int32))
                # one sentence only: its last third
                answers.append(len(numbers) - (len(parts[-1]) if len(parts) > 1 else -(-len(numbers) // 3)))
        return Items(ids, words, answers, {w + e: n for e in reversed(ENDINGS) for w, n in terms.items()}, len(terms))


def term_numbers(items: Items, text: str | None) -> np.ndarray:
    """Number of each word of a text; -1 for words of no item."""
    found = (text or "").lower().split()
    return np.fromiter(map(items.terms.get, found, repeat(-1)), items.kind, len(found))


def run_sums(keys: np.ndarray, rows: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """For each of ``size`` numbers the sum of ``rows[at]`` where ``keys``, which are sorted, hold that number.

    The first elements of all runs are added at once, then the second ones, and so on; a long run is added by itself.
    """
    out = np.zeros((size, rows.shape[1]), rows.dtype)
    begins = np.flatnonzero(np.diff(keys, prepend=-1))
    lengths = np.diff(begins, append=len(keys))
    order = np.argsort(-lengths, kind="stable")
    n_long = int((lengths > LONG_RUN).sum())
    for b, n in zip(begins[order[:n_long]], lengths[order[:n_long]]):
        out[keys[b]] = rows[at[b:b + n]].sum(0)
    order = order[n_long:]
    if len(order):
        begins, lengths = begins[order], lengths[order]
        sums = rows[at[begins]]
        for j in range(1, lengths[0]):
            k = np.searchsorted(-lengths, -j)  # runs with more than j elements
            sums[:k] += rows[at[begins[:k] + j]]
        out[keys[begins]] = sums
    return out


class Blocks:
    """The weighted words of many texts, in blocks that never span two texts."""

    def __init__(self, texts: list[np.ndarray], weights: np.ndarray):
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        words = np.concatenate(texts) if len(texts) else np.empty(0, np.int16)
        per_text = -(-lengths // BLOCK)
        starts = np.cumsum(lengths) - lengths
        self.first = np.concatenate([[0], np.cumsum(per_text)])  # first block of each text
        self.owner = np.repeat(np.arange(len(texts)), per_text)
        # a last element for the words of no item, which have number -1
        known = np.flatnonzero(np.append(weights, 0)[words])
        text_of = np.searchsorted(starts, known, "right") - 1
        self.block = self.first[text_of] + (known - starts[text_of]) // BLOCK  # block of each weighted word
        self.term = words[known]
        self.place = (known - starts[text_of]) % BLOCK  # of each weighted word in its block

    def project(self, rows: np.ndarray) -> np.ndarray:
        """Sum of the ``rows`` of the words of each block."""
        return run_sums(self.block, rows, self.term, self.first[-1])

    def windows(self, counts: np.ndarray, length: int) -> np.ndarray:
        """Sums of ``counts`` (a row per block, at most BLOCK each) over ``length`` blocks from each block on, those of the next text included."""
        out = counts.astype(np.min_scalar_type(length * BLOCK))
        for j in range(1, min(length, len(counts))):
            out[:-j] += counts[j:]
        return out


def number_arrays(column: pa.Array, kind: str) -> list[np.ndarray]:
    """Rows of a binary column as term numbers."""
    return [np.frombuffer(b, kind) for b in column.to_pylist()]


def in_groups(arrays: list[np.ndarray], words: int = 1 << 17):
    """(offset, arrays) of at most about ``words`` words together, so that matrices stay small."""
    at, size, group = 0, 0, []
    for i, a in enumerate(arrays):
        group.append(a)
        size += len(a)
        if size >= words:
            yield at, group
            at, size, group = i + 1, 0, []
    if group:
        yield at, group


def numbered(docs: DataFrame, items) -> DataFrame:
    """doc_id, text_id (a hash of the text) and the term numbers of every document, written once."""

    def run(batches):
        for batch in batches:
            found = [term_numbers(items.value, t.as_py()).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("text_id").cast(pa.string()), pa.array(found, pa.binary())], ["doc_id", "text_id", "words"])

    texts = docs.select("doc_id", F.sha2("text", 256).alias("text_id"), "text")
    return landed(texts.mapInArrow(run, "doc_id long, text_id string, words binary"), "term-numbers")


def occurrences(texts: DataFrame, size: int, kind: str) -> tuple[np.ndarray, int]:
    """How often each term occurs, and how many words there are."""

    def run(batches):
        counts = np.zeros(size + 1, np.int64)
        for batch in batches:
            for words in number_arrays(batch.column("words"), kind):
                counts += np.bincount(words + 1, minlength=size + 1)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used - 1, pa.int64()), pa.array(counts[used], pa.int64())], ["term", "n"])

    counts = np.zeros(size + 1, np.int64)
    for r in texts.select("words").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        counts[r["term"]] = r["n"]
    return counts[:-1], int(counts.sum())


def term_weights(counts: np.ndarray, total: int) -> np.ndarray:
    """Inverse frequency over blocks; every term has a weight, so a passage of common words is found too."""
    return np.log1p(max(total, 1) / (BLOCK * np.maximum(counts, 1))).astype(np.float32)


def latent_space(texts: DataFrame, weights: np.ndarray, kind: str, rank: int = RANK) -> np.ndarray:
    """Right singular vectors (terms x rank) of the weighted block matrix A.

    Executors sum A'(A omega) over their blocks for a fixed random omega; the sums of tasks are added up by term.
    The driver then has the Nystrom factor of A'A, of a size that depends on the benchmark only.
    """
    size = len(weights)
    omega = np.random.default_rng(SEED).normal(size=(size, min(rank, size))).astype(np.float32)
    shared = texts.sparkSession.sparkContext.broadcast((omega, weights))

    def run(batches):
        omega, weights = shared.value
        scaled = omega * weights[:, None]
        sketch = np.zeros(omega.shape)
        for batch in batches:
            for _, group in in_groups(number_arrays(batch.column("words"), kind)):
                b = Blocks(group, weights)
                if not len(b.term):
                    continue
                y = b.project(scaled)
                order = np.argsort(b.term, kind="stable")
                sketch += run_sums(b.term[order], y, b.block[order], len(sketch))
        used = np.flatnonzero(np.abs(sketch).sum(1))
        for k in range(sketch.shape[1]):
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([k] * len(used), pa.int32()), pa.array(sketch[used, k])], ["term", "k", "v"])

    summed = texts.select("words").mapInArrow(run, "term long, k int, v double").groupBy("term", "k").agg(F.sum("v").alias("v")).toPandas()
    z = np.zeros(omega.shape)
    z[summed["term"], summed["k"]] = summed["v"]
    z *= weights[:, None]
    core = omega.T.astype(np.float64) @ z
    shift = 1e-7 * np.abs(core).max() + 1e-12
    values, vectors = np.linalg.eigh((core + core.T) / 2 + shift * np.eye(len(core)))
    factor = z @ (vectors / np.sqrt(np.maximum(values, shift)))
    u, s, _ = np.linalg.svd(factor, full_matrices=False)
    return u[:, s > 1e-9 * max(s.max(initial=0), 1e-12)].astype(np.float32)


class Matcher:
    """Longest common subsequences with one item: a big integer holds a bit per word of the item, one step per word of the text."""

    def __init__(self, item: np.ndarray, answer: int):
        self.n, self.answer, self.masks = len(item), answer, {}
        for i, w in enumerate(item.tolist()):
            self.masks[w] = self.masks.get(w, 0) | 1 << i

    def common(self, words: list, first: int = 0) -> int:
        """Length of the longest common subsequence of ``words`` and the item from its word ``first`` on."""
        n, masks = self.n - first, self.masks
        row = full = (1 << n) - 1
        for w in words:
            match = masks.get(w, 0) >> first
            if match:
                hit = row & match
                row = ((row + hit) | (row - hit)) & full
        return n - row.bit_count()

    @property
    def stretch(self) -> tuple[int, int]:
        """Words of a stretch and between the starts of stretches."""
        return int(np.ceil(STRETCH * self.n)) + self.n // 4 + 1, max(1, self.n // 4)

    def verdict(self, words: list) -> tuple[float, bool]:
        """(largest share of the item that a stretch covers, contaminated). Stretches start at every fourth of the item's length.

        Stretches with too few words of the item to cover PARAPHRASED of it are passed over.
        """
        n, masks, least = self.n, self.masks, PARAPHRASED * self.n
        there = [w for w in words if w in masks]
        most = min(len(there), self.common(there)) if len(there) >= least else 0
        if most < least:  # bounds what any stretch can cover
            return most / n, False
        before = [0, *accumulate(w in masks for w in words)]  # words of the item in front of each word
        size, step = self.stretch
        best, found = 0.0, False
        for start in range(0, max(1, len(words) - size + step), step):
            first, last = before[start], before[min(start + size, len(words))]
            if last - first < least:
                continue
            part = there[first:last]
            covered = self.common(part) / n
            best = max(best, covered)
            answered = covered >= PARAPHRASED and self.common(part, self.answer) >= ANSWERED * (n - self.answer)
            found |= covered >= COPIED or answered
        return best, found


class Search:
    """Cosine search of items over texts, with the check of each candidate.

    Before the check of a candidate, words are counted: a stretch must hold PARAPHRASED of the item's words, each as often as the item does.
    """

    def __init__(self, items: Items, weights: np.ndarray, space: np.ndarray):
        self.items, self.weights, self.rows = items, weights, space * weights[:, None]
        self.matchers = [Matcher(w, a) for w, a in zip(items.words, items.answers)]
        # by blocks of a passage, and blocks that a stretch of the check lies in at most
        shape = [(-(-x.n // BLOCK) + 1, -(-(x.stretch[0] - 1) // BLOCK) + 1) for x in self.matchers]
        order = sorted(range(len(shape)), key=shape.__getitem__)
        self.parts = []
        for at in range(0, len(order), 512):
            numbers, cut = order[at:at + 512], [shape[i] for i in order[at:at + 512]]
            self.parts.append((np.array(numbers), [(*key, bisect_left(cut, key), bisect_right(cut, key)) for key in sorted(set(cut))]))
        queries = np.stack([self.rows[w].sum(0) for w in items.words])
        self.queries = queries / np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-12)
        self.everyday = np.argsort(weights, kind="stable")[:EVERYDAY]

    def wanted(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each term among those of the items ``numbers`` (else -1), and how often each item (a column) holds them.

        Both have a last element for the words of no item.
        """
        words = [self.items.words[i] for i in numbers]
        terms, row = np.unique(np.concatenate(words), return_inverse=True)
        counts = np.zeros((len(terms) + 1, len(words)), np.int16)
        np.add.at(counts, (row, np.repeat(np.arange(len(words)), [len(w) for w in words])), 1)
        place = np.full(len(self.weights) + 1, -1)
        place[terms] = np.arange(len(terms))
        return place, counts

    def countable(self, blocks: Blocks, length: int, numbers: np.ndarray, counts: np.ndarray, held: np.ndarray, everyday: tuple, grid: np.ndarray) -> list:
        """(text, place in ``numbers``) where some stretch of the check holds enough words of the item.

        By block: ``held`` words of each item, ``everyday`` terms (their places, counts), ``grid`` of places of all words.
        """
        n, own = len(held), counts > 0
        ends = blocks.first[blocks.owner + 1]
        least = np.ceil(PARAPHRASED * counts.sum(0)).astype(np.int64)
        sizes = np.array([self.matchers[i].stretch[0] for i in numbers])
        sums = blocks.windows(held, length)
        row, col = np.nonzero(sums >= least.astype(sums.dtype))
        # everyday words count no more often than the item holds them
        spare = np.where(own[everyday[0]], counts[everyday[0]], np.iinfo(np.int16).max).T
        often, pairs = blocks.windows(everyday[1], length), set()
        batch = max(1, (1 << 20) // (length * BLOCK))
        for at in range(0, len(row), batch):
            r, c = row[at:at + batch], col[at:at + batch]
            over = np.maximum(often[r].astype(np.int32) - spare[c], 0).sum(1)
            left = sums[r, c] >= least[c] + over
            r, c = r[left], c[left]
            # then word by word, in stretches as long as those of the check
            inside = r[:, None] + np.arange(length)
            there = own[grid[np.minimum(inside, n - 1)], c[:, None, None]] & (inside < ends[r][:, None])[:, :, None]
            before = np.zeros((len(r), length * BLOCK + 1), np.int32)
            np.cumsum(there.reshape(len(r), length * BLOCK), axis=1, out=before[:, 1:])
            for size in np.unique(sizes[c]).tolist():
                k = np.flatnonzero(sizes[c] == size)
                k = k[(before[k, size:] - before[k, :-size]).max(1) >= least[c[k]]]
                pairs.update(zip(blocks.owner[r[k]].tolist(), c[k].tolist()))
        return sorted(pairs)

    def spans(self, blocks: Blocks):
        """(item, text, first block, block behind the last), inside the text, of passages whose cosine reaches the bound; overlapping ones are one."""
        own = blocks.project(self.rows)
        n = len(own)
        sums = np.zeros((n + 1, own.shape[1]), np.float32)
        np.cumsum(own, axis=0, out=sums[1:])
        begins, ends = blocks.first[blocks.owner], blocks.first[blocks.owner + 1]
        column = np.full(len(self.weights), -1)
        column[self.everyday] = np.arange(len(self.everyday))
        used = np.flatnonzero(column[blocks.term] >= 0)
        at = blocks.block[used] * len(self.everyday) + column[blocks.term[used]]
        everyday = np.bincount(at, minlength=n * len(self.everyday)).reshape(n, len(self.everyday)).astype(np.uint8)
        for numbers, groups in self.parts:
            place, counts = self.wanted(numbers)
            held = run_sums(blocks.block, (counts > 0).astype(np.uint8), place[blocks.term], n)
            grid = np.full((n, BLOCK), -1)
            grid[blocks.block, blocks.place] = place[blocks.term]
            known = np.flatnonzero(place[self.everyday] >= 0)
            often = place[self.everyday[known]], everyday[:, known]
            for m, length, a, b in groups:
                pairs = self.countable(blocks, length, numbers[a:b], counts[:, a:b], held[:, a:b], often, grid)
                if not pairs:
                    continue
                # a window that would pass the end of its text is needed only if it starts the text
                asked = np.zeros(len(blocks.first), bool)
                asked[[text for text, _ in pairs]] = True
                start = np.flatnonzero(((np.arange(n) + m <= ends) | (np.arange(n) == begins)) & asked[blocks.owner])
                stop = np.minimum(start + m, ends[start])
                passages = sums[stop] - sums[start]
                bound = CANDIDATE_FROM * np.maximum(np.linalg.norm(passages, axis=1, keepdims=True), 1e-6)
                near = passages @ self.queries[numbers[a:b]].T >= bound
                first = np.searchsorted(start, blocks.first)
                for text, k in pairs:
                    rows = np.flatnonzero(near[first[text]:first[text + 1], k]) + first[text]
                    if len(rows):
                        cuts = np.flatnonzero(start[rows[1:]] > stop[rows[:-1]])
                        for x, y in zip(rows[[0, *(cuts + 1)]], rows[[*cuts, -1]]):
                            yield int(numbers[a + k]), text, int(start[x] - blocks.first[text]), int(stop[y] - blocks.first[text])

    def hits(self, texts: list[np.ndarray]) -> dict:
        """(text, item number): share covered, of contaminated texts. Overlapping candidates are checked as one stretch."""
        out = {}
        for i, text, first, last in self.spans(Blocks(texts, self.weights)):
            covered, found = self.matchers[i].verdict(texts[text][max(0, first - 1) * BLOCK:(last + 1) * BLOCK].tolist())
            if found:
                out[text, i] = max(out.get((text, i), 0.0), covered)
        return out


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, covered): documents (doc_id, text) that hold an item of ``benchmark`` (item_id, text), or its paraphrase."""
    return hits(docs, benchmark).groupBy("doc_id", "item_id").agg(F.max("covered").alias("covered"))


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_id, item_id, covered) of every text that holds an item; text_id is the text's SHA-256."""
    spark = docs.sparkSession
    use_python(spark)
    rows = benchmark.select("item_id", "text").distinct()
    n_words = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    if n_words > 40 * MOST_TERMS:
        raise ValueError("this benchmark is too large for one broadcast; run it in parts")
    items = Items.of(sorted(map(tuple, rows.collect()), key=repr))
    shape = "doc_id long, text_id string, item_id long, covered double"
    if not items.words:
        return spark.createDataFrame([], shape)
    shared = spark.sparkContext.broadcast(items)
    texts = numbered(docs, shared)
    weights = term_weights(*occurrences(texts, items.size, items.kind))
    search = spark.sparkContext.broadcast(Search(items, weights, latent_space(texts, weights, items.kind)))

    def run(batches):
        ids_of, kind = search.value.items.ids, search.value.items.kind
        for batch in batches:
            ids, text_ids, found = batch.column("doc_id"), batch.column("text_id"), []
            for at, group in in_groups(number_arrays(batch.column("words"), kind)):
                found += [(ids[at + t].as_py(), text_ids[at + t].as_py(), ids_of[i], c) for (t, i), c in search.value.hits(group).items()]
            columns = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_id", "item_id", "covered"])

    return texts.mapInArrow(run, shape)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs``, with all columns, without the documents that hold a benchmark item.

    A document is a doc_id with a text: texts that share a number, or have none, are judged each by its own.
    """
    bad = hits(docs, benchmark).select(F.col("doc_id").alias("_doc_id"), F.col("text_id").alias("_text_id")).distinct()
    same = docs["doc_id"].eqNullSafe(bad["_doc_id"]) & F.sha2(docs["text"], 256).eqNullSafe(bad["_text_id"])
    return docs.join(bad, same, "left_anti")
