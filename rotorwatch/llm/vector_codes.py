"""Vector code compression: product codes of integer vectors, with distances looked up per distinct value.

Each component x is the integer floor(4096 x). ``coded_blocks`` keeps, for every dimension of a block of vectors, the dictionary of its
distinct integers and each vector's place in it; this is written once. In every round a task tabulates the squared differences of all
dictionary values to all entries of the codebook; a part's distances are then sums of gathered table rows, one gather per dimension.
Rounds send back the sum and count of each entry and dimension only.

Rows whose vector is null or holds a null, infinite or NaN component are dropped; others are kept, with repeated and null vec_ids. The
first codebook is that of the smallest vec_ids (null last; of one vec_id, by vector); with fewer vectors than entries it is smaller. Vectors
shorter than the longest, or whose length the number of parts does not divide, are filled up with zeros behind. An empty table gives no rows.
Sums are exact; integers of 64 bits and more, and distances that do not fit 64 bits, fail with a message.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotorwatch.llm.common import landed, use_python

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
BLOCK_VALUES = 1 << 20  # components of a block
NARROW = 1 << 27  # integers below it have squared differences whose sums fit 64 bits


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def integers(values: np.ndarray) -> np.ndarray:
    scaled = np.floor(values.astype(np.float64) * SCALE)
    if len(scaled) and np.abs(scaled).max() >= 2.0**63:
        raise ValueError("a component is too large for 64-bit integers")
    return scaled.astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], width: int, most: int) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """(vec_ids, labels, integers of shape vectors x width), batches joined up to blocks of about ``most`` rows."""
    held, rows = [], 0
    for batch in batches:
        if held and rows + batch.num_rows > most:
            yield _block(held, width)
            held, rows = [], 0
        held.append(batch)
        rows += batch.num_rows
    if rows:
        yield _block(held, width)


def _block(batches: list[pa.RecordBatch], width: int):
    table = pa.Table.from_batches(batches).combine_chunks()
    lists = table.column(2).combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    out = np.zeros((len(lists), width), np.int64)
    inside = np.arange(width)[None, :] < sizes[:, None]
    out[inside] = integers(lists.flatten().to_numpy(zero_copy_only=False))
    return table.column(0), table.column(1), out


def coded_blocks(kept: DataFrame, width: int) -> DataFrame:
    """One row per block of vectors (vec_id, label, embedding): owners, and per dimension the distinct integers and each vector's place in them."""
    most = max(BLOCK_VALUES // max(width, 1), 1)

    def run(batches):
        for vec_ids, labels, block in _blocks(batches, width, most):
            found = [np.unique(column, return_inverse=True) for column in block.T]
            codes = np.array([place for _, place in found], "<u4").reshape(width, len(block))
            values = np.concatenate([v for v, _ in found]) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([vec_ids.to_pylist()], pa.list_(vec_ids.type)), pa.array([labels.to_pylist()], pa.list_(labels.type)),
                 pa.array([values.tolist()], pa.list_(pa.int64())), pa.array([[len(v) for v, _ in found]], pa.list_(pa.int32())),
                 pa.array([codes.astype("<u2").tobytes() if codes.max(initial=0) < 1 << 16 else codes.tobytes()], pa.binary())],
                ["vec_ids", "labels", "values", "sizes", "codes"])

    types = {f.name: f.dataType for f in kept.schema}
    schema = T.StructType([
        T.StructField("vec_ids", T.ArrayType(types["vec_id"])), T.StructField("labels", T.ArrayType(types["label"])),
        T.StructField("values", T.ArrayType(T.LongType())), T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("codes", T.BinaryType())])
    return kept.select("vec_id", "label", "embedding").mapInArrow(run, schema)


class Block:
    """Dictionaries and codes of one block."""

    def __init__(self, values: np.ndarray, sizes: np.ndarray, codes: bytes, rows: int):
        self.rows, edges = rows, np.concatenate([[0], np.cumsum(sizes)]).astype(int)
        if len(values) and max(-int(values.min()), int(values.max())) >= NARROW:
            values = values.astype(object)  # whole numbers of any size
        self.dictionaries = [values[a:b] for a, b in zip(edges, edges[1:])]
        wide = len(codes) == 4 * rows * len(sizes)
        self.codes = np.frombuffer(codes, "<u4" if wide else "<u2").reshape(len(sizes), rows)

    def nearest(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry numbers and squared distances, parts x rows. ``books``: parts x entries x dimensions of a part."""
        parts, entries, wide = books.shape
        chosen, least = np.zeros((parts, self.rows), np.int64), []
        for p in range(parts):
            total = np.zeros((self.rows, entries), np.int64)
            for k in range(wide):
                values = self.dictionaries[p * wide + k]
                table = (values[:, None] - books[p, :, k][None, :]) ** 2  # every distinct integer to all entries
                total = total + table[self.codes[p * wide + k]]
            chosen[p] = np.argmin(total, axis=1)
            least.append(total[np.arange(self.rows), chosen[p]])
        return chosen, np.array(least)

    def add_sums(self, chosen: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> None:
        """Add this block's vectors to the sums (parts x entries x dimensions) and counts (parts x entries) of their entries."""
        parts, entries, wide = sums.shape
        for p in range(parts):
            counts[p] += np.bincount(chosen[p], minlength=entries)
            for k in range(wide):
                own = self.dictionaries[p * wide + k]
                pairs = np.bincount(chosen[p] * len(own) + self.codes[p * wide + k], minlength=entries * len(own)).reshape(entries, len(own))
                sums[p, :, k] += (pairs.astype(object) * own.astype(object)).sum(1) if own.dtype == object else pairs @ own


def _read(batches) -> Iterator[tuple[pa.RecordBatch, int, Block]]:
    for batch in batches:
        columns = {n: batch.column(n) for n in batch.schema.names}
        for i in range(batch.num_rows):
            values, sizes = columns["values"][i].values.to_numpy(), columns["sizes"][i].values.to_numpy()
            yield batch, i, Block(values, sizes, columns["codes"][i].as_py(), len(columns["vec_ids"][i]))


def next_books(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: all parts go to their nearest entries, and each entry that is used becomes the floor of its parts' mean."""
    parts, entries, wide = books.shape

    def run(batches):
        sums, counts = np.zeros(books.shape, object), np.zeros((parts, entries), np.int64)
        for _, _, block in _read(batches):
            block.add_sums(block.nearest(books)[0], sums, counts)
        used = [(p, e, k) for p, e in zip(*np.nonzero(counts)) for k in range(wide)]
        columns = [[int(u[i]) for u in used] for i in range(3)]
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(c, pa.int32()) for c in columns), pa.array([int(sums[u]) for u in used], pa.decimal128(38, 0)), pa.array([int(counts[u[:2]]) for u in used], pa.int64())],
            ["part", "entry", "k", "total", "n"])

    sums = blocks.mapInArrow(run, "part int, entry int, k int, total decimal(38,0), n long").groupBy("part", "entry", "k").agg(
        F.sum("total").alias("total"), F.sum("n").alias("n"))
    after = books.copy()
    for row in sums.collect():  # one row per part, entry and dimension of a part
        after[row.part, row.entry, row.k] = int(row.total) // row.n
    return after


def first_books(kept: DataFrame, parts: int, entries: int, width: int) -> np.ndarray:
    rows = kept.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).collect()
    flat = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        flat[i, :len(row.embedding)] = integers(np.array(row.embedding, np.float64))
    return np.ascontiguousarray(flat.reshape(len(rows), parts, width // parts).transpose(1, 0, 2))


def codebooks_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, codes, error) of every usable row of ``vectors`` (vec_id, embedding, label), written once, and the codebooks.

    codes has one entry number per part; error is the sum of the squared distances. Codebooks: parts x entries x dimensions.
    """
    spark = vectors.sparkSession
    use_python(spark)
    kept = vectors.select("vec_id", "label", "embedding").filter(usable(F.col("embedding")))
    longest = kept.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = -(-longest // parts) * parts
    books = first_books(kept, parts, entries, width)
    types = {f.name: f.dataType for f in kept.schema}
    schema = T.StructType([T.StructField(n, types[n]) for n in ("vec_id", "label")]).add("codes", T.ArrayType(T.IntegerType())).add("error", T.LongType())
    if not books.shape[1]:
        return spark.createDataFrame([], schema), books
    blocks = landed(coded_blocks(kept, width), "vector_blocks")
    for _ in range(rounds):
        books = next_books(blocks, books)

    def run(batches):
        for batch, i, block in _read(batches):
            chosen, least = block.nearest(books)
            codes = pa.ListArray.from_arrays(pa.array(np.arange(block.rows + 1, dtype=np.int32) * parts), pa.array(chosen.T.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_ids")[i].values, batch.column("labels")[i].values, codes, pa.array([int(e) for e in least.sum(0)], pa.int64())],
                ["vec_id", "label", "codes", "error"])

    return landed(blocks.mapInArrow(run, schema), "vector_codes"), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` and label_error, the error summed over rows of an equal label (null is one label)."""
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, coded["label"].eqNullSafe(sums["_label"]), "left").drop("_label")


def hex_code(codes: Column) -> Column:
    """Entry numbers in part order, two hex digits each."""
    return F.array_join(F.transform(codes, lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
