"""The k nearest stored vectors, by cosine, for a table of query vectors."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rotorwatch.operators.search import top_per_query
from rotorwatch.session import python_on_workers

QUERY_BLOCK = 4096  # queries that a scan of the vectors answers; their vectors are sent to the tasks
PAIRS = 1 << 20  # similarities that a task holds at once
DIGITS = 9  # similarities that agree so far are equal, and the smaller id comes first


class Best:
    """The k best (similarity, id) so far of each query."""

    def __init__(self, queries: np.ndarray, k: int):
        self.k, self.unit = k, unit(queries)
        self.query = np.zeros(0, np.int64)
        self.similarity, self.ids = np.zeros(0), np.zeros(0, np.int64)
        self.least = np.full(len(queries), -np.inf)  # of the k-th best

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        step = max(PAIRS // max(len(self.unit), 1), 1)
        for at in range(0, len(ids), step):
            found = np.round(unit(vectors[at:at + step]) @ self.unit.T, DIGITS)
            row, query = np.nonzero(found >= self.least)  # a NaN, of a vector without a direction, is no candidate
            if len(row):
                self._merge(query, found[row, query], ids[at + row])

    def _merge(self, query: np.ndarray, similarity: np.ndarray, ids: np.ndarray) -> None:
        query, similarity, ids = (np.concatenate(p) for p in ((self.query, query), (self.similarity, similarity), (self.ids, ids)))
        order = np.lexsort((ids, -similarity, query))
        query, similarity, ids = query[order], similarity[order], ids[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = place < self.k
        self.query, self.similarity, self.ids = query[kept], similarity[kept], ids[kept]
        last = place[kept] == self.k - 1
        self.least[self.query[last]] = self.similarity[last]


def unit(vectors: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of a list column; rows that are null, of another length or hold a null become NaN."""
    out = np.full((len(column), width), np.nan)
    for i, v in enumerate(column.to_pylist()):
        if v is not None and len(v) == width and None not in v:
            out[i] = v
    return out


def vector_top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(query, id, similarity, rank): the k nearest stored vectors of each row of ``queries`` (query, vector).

    Queries go in blocks of ``QUERY_BLOCK``; each block is one scan, in which a task multiplies batches of vectors with all queries and keeps
    k per query. Only those are shuffled. Vectors without a direction, or of another length than the queries, are near to none.
    """
    spark = vectors.sparkSession
    python_on_workers(spark)
    asked = queries.select(F.col("query").cast("string").alias("query"), F.col("vector").cast("array<double>").alias("vector"))
    asked = asked.filter("query IS NOT NULL AND vector IS NOT NULL").distinct()
    blocks = -(-asked.count() // QUERY_BLOCK)
    shape, parts = "query string, id long, similarity double", []
    for block in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).collect()  # one block, about QUERY_BLOCK rows
        for width in sorted({len(r.vector) for r in rows}):
            own = [r for r in rows if len(r.vector) == width]
            names, values = [r.query for r in own], np.array([r.vector for r in own], np.float64)
            parts.append(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(
                _scan(spark.sparkContext.broadcast((names, values)), k, width), shape))
    if not parts:
        return spark.createDataFrame([], f"query string, {id_col} long, similarity double, rank int")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionAll(part)
    best = top_per_query(found, k, F.desc("similarity"), "id")
    return best.select("query", F.col("id").alias(id_col), "similarity", "rank")


def _scan(shared, k: int, width: int):
    def run(batches):
        names, values = shared.value
        best = Best(values, k)
        for batch in batches:
            known = batch.column("id").is_valid()
            own = pa.RecordBatch.from_arrays(batch.columns, batch.schema.names).filter(known)
            best.add(own.column("id").to_numpy(), matrix(own.column("v"), width))
        yield pa.RecordBatch.from_arrays(
            [pa.array([names[q] for q in best.query], pa.string()), pa.array(best.ids, pa.int64()), pa.array(best.similarity)],
            ["query", "id", "similarity"])

    return run
