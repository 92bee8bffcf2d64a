"""Byte-level BPE ids by a global shuffle of distinct words, and bytes from ids.

``word_blocks`` splits texts into pre-tokens and numbers the distinct ones inside a block of documents; a pre-token's position is
its place in the list of those numbers, so the rows that are shuffled are the (word, block, number) of a block's distinct words,
not every occurrence. ``encode_words`` takes them dealt and sorted by word, encodes each distinct word once, and sends its ids
back to the blocks that hold it. ``encode_documents`` puts them into the positions of the blocks' texts: the blocks lie in a table bucketed by
block, so only ids move to them. A word has one row per block at most, whatever its share of a corpus, and no group is larger than
the distinct words of one block.

``decode_documents`` joins each id with the table of token bytes. That table has one row per token of the vocabulary, so it is sent to
the tasks and the join is a gather of its rows.

Null and empty texts have no ids and decode to no bytes. Rows are texts: repeated documents, null ids and other columns change
nothing. A text longer than a block is a block of its own. Ids of a token that the table lacks do not occur, for every byte has one.
"""

import base64
import heapq
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rotorwatch.llm.common import use_python
from rotorwatch.session import scratch_dir

BLOCK_CHARACTERS = 32_000_000  # characters of a block, unless one text alone has more
PACKED_WORDS = 200_000  # words whose ids a task holds before it sends them on
BLOCKS = "block long, words array<string>, rows array<long>, sizes array<int>, codes binary"


def default_path() -> str:
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def read_ranks(spark: SparkSession, path: str | None = None) -> dict[bytes, int]:
    """Bytes and rank, which is the id, of every token of a vocabulary file (some MB at most)."""
    lines = open(path or default_path(), "rb").read().split(b"\n") if not path or "://" not in path else [
        r.value.encode() for r in spark.read.text(path).collect()]
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def ranges(characters: set[str]) -> str:
    """The characters as ranges of a regex set."""
    points, out = sorted(map(ord, characters)), []
    for p in points:
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


@dataclass(frozen=True)
class Splitter:
    r"""``plain`` for texts without any of the characters ``odd``, else ``exact``.

    Python's regex and the tokenizer's own follow different editions of Unicode, so some characters are a letter or number (\p{L}, \p{N})
    to one of them only. ``exact`` is the pattern with the tokenizer's classes; it is slow, and such characters are rare.
    """

    plain: str
    odd: str
    exact: str

    @classmethod
    def of(cls, pattern: str = public_tokenizers.PATTERN) -> "Splitter":
        every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
        single, odd, exact = {bytes([i]): i for i in range(256)}, set(), pattern
        for name in (r"\p{L}", r"\p{N}", r"\s"):
            probe = tiktoken.Encoding("probe", pat_str=name, mergeable_ranks=single, special_tokens={})
            theirs = set(bytes(probe.encode_ordinary(every)).decode())
            ours = set(regex.findall(name, every))
            for sign, characters in (("||", theirs - ours), ("--", ours - theirs)):
                if characters:
                    odd |= characters
                    exact = exact.replace(name, f"[{name}{sign}[{ranges(characters)}]]")
        return cls(pattern, f"[{ranges(odd)}]" if odd else "", "(?V1)" + exact)

    def finder(self):
        """A function from a text to its pre-tokens."""
        plain, exact = regex.compile(self.plain).findall, regex.compile(self.exact).findall
        odd = regex.compile(self.odd).search if self.odd else lambda text: False
        return lambda text: plain(text) if text.isascii() or not odd(text) else exact(text)


class WordEncoder:
    """Ids of one pre-token: the pair of the lowest rank merges first, the leftmost of equal ones."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def ids(self, word: bytes) -> list[int]:
        ranks = self.ranks
        if word in ranks:
            return [ranks[word]]
        n = len(word)
        # a part is word[start:end[start]]; before[start] is where the part in front of it starts
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = [(ranks[word[i:i + 2]], i, i + 2) for i in range(n - 1) if word[i:i + 2] in ranks]
        heapq.heapify(pairs)
        while pairs:
            _, start, stop = heapq.heappop(pairs)
            middle = end[start]
            if middle is None or middle >= n or end[middle] != stop:
                continue  # one of its parts has merged since
            end[start], end[middle] = stop, None
            if stop < n:
                before[stop] = start
                if (rank := ranks.get(word[start:end[stop]])) is not None:
                    heapq.heappush(pairs, (rank, start, end[stop]))
            if start and (rank := ranks.get(word[before[start]:stop])) is not None:
                heapq.heappush(pairs, (rank, before[start], stop))
        out, at = [], 0
        while at < n:
            out.append(ranks[word[at:end[at]]])
            at = end[at]
        return out


def _blocks(texts: Iterator[tuple[int, str]], find, most: int) -> Iterator[tuple]:
    """(words, rows, sizes, codes) per block: distinct words in order of appearance, and the number of each text's words."""
    numbers, rows, sizes, codes, characters = {}, [], [], [], 0
    for row, text in texts:
        if rows and characters + len(text) > most:
            yield list(numbers), rows, sizes, codes
            numbers, rows, sizes, codes, characters = {}, [], [], [], 0
        own = np.fromiter((numbers.setdefault(w, len(numbers)) for w in find(text)), np.uint32)
        rows.append(row)
        sizes.append(len(own))
        codes.append(own)
        characters += len(text)
    if rows:
        yield list(numbers), rows, sizes, codes


def word_blocks(docs: DataFrame, splitter: Splitter) -> DataFrame:
    """One row per block of documents (doc_id, text): its distinct pre-tokens, its doc_ids, and each text's word numbers, compressed."""
    most = BLOCK_CHARACTERS

    def run(batches):
        find, part, count = splitter.finder(), TaskContext.get().partitionId(), 0
        texts = ((r, t or "") for batch in batches for r, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        for words, rows, sizes, codes in _blocks(texts, find, most):
            packed = pack(np.concatenate(codes))
            yield pa.RecordBatch.from_arrays(
                [pa.array([part << 33 | count]), pa.array([words], pa.list_(pa.string())), pa.array([rows], pa.list_(pa.int64())),
                 pa.array([sizes], pa.list_(pa.int32())), pa.array([packed], pa.binary())],
                ["block", "words", "rows", "sizes", "codes"])
            count += 1

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, BLOCKS)


def pack(numbers: np.ndarray) -> bytes:
    return zstandard.compress(numbers.astype("<u4").tobytes())


def unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(raw), "<u4").astype(np.int32)


def encode_words(places: DataFrame, ranks) -> DataFrame:
    """Rows (word, block, number) to rows (block, numbers, counts, ids): ids of all words behind each other, packed.

    Each distinct word is encoded once, for its rows lie together. ``ranks``: the vocabulary, broadcast.
    """
    most = PACKED_WORDS

    def sent(held):
        names = ["block", "numbers", "counts", "ids"]
        columns = [[np.array(c) for c in zip(*((n, len(i)) for n, i in own))] + [np.concatenate([i for _, i in own])] for own in held.values()]
        return pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int64()), *(pa.array([pack(c[i]) for c in columns], pa.binary()) for i in range(3))], names)

    def run(batches):
        encoder, last, ids, held, n = WordEncoder(ranks.value), None, None, {}, 0
        for batch in batches:
            for word, block, number in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if word != last:
                    last, ids = word, np.array(encoder.ids(word.encode()), np.uint32)
                held.setdefault(block, []).append((number, ids))
            n += batch.num_rows
            if n >= most:
                yield sent(held)
                held, n = {}, 0
        if held:
            yield sent(held)

    dealt = places.select("word", "block", "number").repartition("word").sortWithinPartitions("word")
    return dealt.mapInArrow(run, "block long, numbers binary, counts binary, ids binary")


def spread(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists ``values[starts[c]:starts[c] + sizes[c]]`` of all codes behind each other, and the length of each."""
    own = sizes[codes]
    behind = np.cumsum(own)
    return values[np.repeat(starts[codes] - behind + own, own) + np.arange(behind[-1] if len(behind) else 0)], own


def _reassemble(batches):
    for batch in batches:
        for block in range(batch.num_rows):
            rows, sizes = batch.column("rows")[block].values, np.asarray(batch.column("sizes")[block].values)
            pieces = batch.column("found")[block].as_py() or []
            numbers, counts, ids = (np.concatenate([np.zeros(0, np.int32), *(unpack(p[c]) for p in pieces)]) for c in ("numbers", "counts", "ids"))
            starts, lengths = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
            starts[numbers], lengths[numbers] = np.cumsum(counts) - counts, counts
            codes = np.frombuffer(zstandard.decompress(batch.column("codes")[block].as_py()), "<u4")
            edges = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
            for at in range(0, len(rows), 200):  # part by part: a block has many rows
                cut = edges[at:at + 201]
                values, own = spread(ids, starts, lengths, codes[cut[0]:cut[-1]])
                ends = np.concatenate([[0], np.cumsum(own)])[cut - cut[0]]
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays([rows.slice(at, 200), lists], ["doc_id", "ids"])


def bucketed(df: DataFrame, name: str, column: str) -> DataFrame:
    """``df`` written once to the shared scratch folder in buckets by ``column``, so that a join by it does not shuffle it again."""
    spark, path = df.sparkSession, scratch_dir(df.sparkSession, name)
    n, named = int(spark.conf.get("spark.sql.shuffle.partitions")), f"{name}_{uuid.uuid4().hex}"
    df.write.option("path", path).option("compression", "zstd").bucketBy(n, column).saveAsTable(named)
    return spark.table(named)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids of every text (columns doc_id and text are read)."""
    spark = docs.sparkSession
    use_python(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(spark, path))
    blocks = bucketed(word_blocks(docs, Splitter.of()), "word_blocks", "block")
    places = blocks.select("block", F.posexplode("words").alias("number", "word"))
    found = encode_words(places, ranks).groupBy("block").agg(F.collect_list(F.struct("numbers", "counts", "ids")).alias("found"))
    whole = blocks.select("block", "rows", "sizes", "codes").join(found, "block", "left")
    return whole.mapInArrow(_reassemble, "doc_id long, ids array<int>")


def decode_documents(coded: DataFrame, path: str | None = None) -> DataFrame:
    """The columns of ``coded`` (one of them ids) and ``decoded``, the bytes of its ids."""
    spark = coded.sparkSession
    use_python(spark)
    ranks = read_ranks(spark, path)
    by_id = sorted((i, token) for token, i in ranks.items())
    shared = spark.sparkContext.broadcast((np.array([i for i, _ in by_id]), [t for _, t in by_id]))

    def run(batches):
        numbers, tokens = shared.value
        table = pa.array(tokens, pa.large_binary())
        for batch in batches:
            lists = batch.column("ids")
            own = lists.flatten()
            row = np.searchsorted(numbers, own.to_numpy(zero_copy_only=False))
            offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
            parts = pa.LargeListArray.from_arrays(pa.array(offsets.astype(np.int64)), table.take(pa.array(row)))
            decoded = pc.binary_join(parts, pa.scalar(b"", pa.large_binary())).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded], [*batch.schema.names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema) + ", decoded binary"
    return coded.mapInArrow(run, schema)
