"""Near copies by SimHash: fingerprints that differ in at most three bits are linked, classes are their components.

A fingerprint is embedded as the bit counts of its 32 two-bit segments. The Manhattan distance of two such
vectors is at most the number of differing bits, and a difference of three bits touches at most three of six
blocks of coordinates. So the grid has one cell per choice of three blocks and their coordinates, points that
share a cell are joined under Manhattan distance, and the exact bit difference decides.

Text: A-Z lower-cased, words between white space, 3-word shingles with repeats (fewer words: all of them as one);
null, empty and blank texts have fingerprint zero and are linked like any other. Equal fingerprints are one point, so
copies are never paired. A class is named by its smallest doc_id; null doc_ids count only if there is no other.
"""

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotorwatch.llm.common import landed, use_python
from rotorwatch.llm.components import linked

WIDTH, SEED = 3, 42
DISTANCE, BLOCKS = 3, 6
FIELDS = 0x5555555555555555  # the low bit of each two-bit field


def fingerprint(text: str | None) -> int:
    """Signed 64-bit SimHash of one text. bytes.lower and bytes.split treat exactly A-Z and the six blanks."""
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    shingles = map(b" ".join, zip(*(found[i:] for i in range(WIDTH)))) if len(found) >= WIDTH else [b" ".join(found)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at:at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def counts(point: Column) -> Column:
    """Bit counts of the two-bit segments, each in its own two bits."""
    low, high = point.bitwiseAND(F.lit(FIELDS)), F.shiftrightunsigned(point, 1).bitwiseAND(F.lit(FIELDS))
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def manhattan(a: Column, b: Column) -> Column:
    """Distance of two count vectors: fields differ by one if their low bits differ, else by two if they differ."""
    differ = a.bitwiseXOR(b)
    low, high = differ.bitwiseAND(F.lit(FIELDS)), F.shiftrightunsigned(differ, 1).bitwiseAND(F.lit(FIELDS))
    return F.bit_count(low) + 2 * F.bit_count(high.bitwiseAND(F.bitwise_not(low)))


def cells(points: DataFrame) -> DataFrame:
    """(cell, id): every point in its cell of each choice of blocks."""
    edges = [64 * i // BLOCKS // 2 * 2 for i in range(BLOCKS + 1)]
    blocks = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(BLOCKS)]
    masks = [sum(c) for c in combinations(blocks, BLOCKS - DISTANCE)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    choices = F.array(*[
        F.struct(F.lit(i).alias("choice"), counts(F.col("id")).bitwiseAND(F.lit(m)).alias("at")) for i, m in enumerate(signed)
    ])
    return points.select("id", F.explode(choices).alias("cell")).select("cell", "id")


def close(a, b) -> Column:
    lower_bound = manhattan(counts(a("id")), counts(b("id")))
    return (lower_bound <= DISTANCE) & (F.bit_count(a("id").bitwiseXOR(b("id"))) <= DISTANCE)


def fingerprint_classes(points: DataFrame) -> DataFrame:
    """(id, root) of the distinct fingerprints ``id`` that are linked to another one."""
    return linked(cells(points), close)


def point_classes(marked: DataFrame) -> DataFrame:
    """(id, component_id) of each distinct fingerprint of ``marked`` (doc_id, id)."""
    points = landed(marked.groupBy("id").agg(F.min("doc_id").alias("least")), "points")
    named = points.join(fingerprint_classes(points.select("id")), "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return landed(named.join(least, "root").select("id", "component_id"), "classes")


def mark(docs: DataFrame) -> DataFrame:
    use_python(docs.sparkSession)
    return landed(docs.select("doc_id", F.pandas_udf(fingerprints, "long")("text").alias("id")), "fingerprints")


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex), component_id of every document (columns doc_id and text are read)."""
    marked = mark(docs)
    return marked.join(point_classes(marked), "id").select(
        "doc_id", F.lower(F.lpad(F.hex("id"), 16, "0")).alias("fingerprint"), "component_id"
    )


def first_of_class(docs: DataFrame) -> DataFrame:
    """``docs``, with all columns: of each class the document of the smallest doc_id.

    Rows of one doc_id are one document: it stays if any of them is the first of a class. Rows without a doc_id are the
    last of their class, and all stay if it has no others.
    """
    marked = mark(docs)
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    seen = marked.join(point_classes(marked), "id").groupBy("doc_id").agg(F.max(first).alias("first"))
    gone = seen.filter(~F.col("first")).select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone"]), "left_anti")
