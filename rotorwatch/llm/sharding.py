"""Range shards of near equal bytes by sampled splitters.

A size-weighted sample of (key, tie) pairs gives quantile boundaries that cut the rows into many small
ranges. The bytes of each range are counted exactly, ranges that came out overfull are cut again from
a denser sample of their own, and a running sum inside each range (never over all rows in one task)
places every row on the byte line. Its shard follows from that place, so shards differ by about one
document at most, whatever the sample was: the sample only decides how the work is spread.

Rows: null text has no bytes and the lowest key; a null tie sorts first; rows equal in key and tie are
interchangeable; an empty table gives an empty result. Copies of one text share a key and so lie side by
side; a group larger than a range is cut by the tie.
"""

import bisect
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rotorwatch.llm.common import landed, longs

LOWEST = -(2**63)
# Ranges per shard at least, rows per range at most (one sort in one task), sampled rows per range.
RANGES_PER_SHARD, ROWS_PER_RANGE, SAMPLES_PER_RANGE = 32, 2_000_000, 24
OVERFULL, ROUNDS = 2.0, 3


def sample_rows(rows: DataFrame, wanted: int, total: int, seed: int) -> list[tuple[int, int, float]]:
    """About ``wanted`` rows as (key, tie, bytes they stand for), each drawn in proportion to its size.

    The draw hashes the row, so a repeated task draws the same rows. ``wanted`` bounds what is collected.
    """
    step = total / wanted
    draw = (F.pmod(F.xxhash64("_key", "_tie", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52))
    drawn = rows.filter(draw < F.col("_size") / step).select("_key", "_tie", F.greatest("_size", F.lit(step)).alias("w"))
    return sorted((r[0], r[1], float(r[2])) for r in drawn.collect())


def quantile_cuts(sample: list[tuple[int, int, float]], ranges: int) -> list[tuple[int, int]]:
    """Boundaries that cut the sample into ``ranges`` parts of near equal weight; a boundary starts its range."""
    if not sample:
        return []
    sums = list(accumulate(w for *_, w in sample))
    at = (bisect.bisect_left(sums, sums[-1] * i / ranges) for i in range(1, ranges))
    return sorted({sample[min(i, len(sample) - 1)][:2] for i in at})


def range_of(cuts: list[tuple[int, int]]) -> Column:
    """Number of the range that holds (_key, _tie): a binary search in the boundaries."""
    keys, ties = longs([k for k, _ in cuts]), longs([t for _, t in cuts])
    steps = [1 << b for b in reversed(range(len(cuts).bit_length()))]
    if not cuts:
        return F.lit(0)

    def step(low, jump):
        at = low + jump - 1
        key, tie = F.get(keys, at), F.get(ties, at)
        passed = (F.col("_key") > key) | ((F.col("_key") == key) & (F.col("_tie") >= tie))
        return F.when(passed, low + jump).otherwise(low)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def cut_rows(rows: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their range, and (range, rows, bytes) of each range."""
    total, count = rows.agg(F.sum("_size"), F.count("*")).first()
    if not count:
        return rows.withColumn("_range", F.lit(0)), None
    ranges = shards * max(RANGES_PER_SHARD, -(-count // (shards * ROWS_PER_RANGE)))
    cuts = quantile_cuts(sample_rows(rows, ranges * SAMPLES_PER_RANGE, total, 1), ranges)
    for turn in range(ROUNDS):
        placed = rows.withColumn("_range", range_of(cuts))
        filled = placed.groupBy("_range").agg(F.count("*").alias("n"), F.sum("_size").alias("b")).collect()
        over = {r["_range"]: r["b"] for r in filled if r["n"] > 1 and r["b"] > OVERFULL * total / ranges}
        if not over or turn == ROUNDS - 1:
            break
        parts = {k: int(-(-b * ranges // total)) for k, b in over.items()}
        inside = placed.filter(F.col("_range").isin(*over))
        more = sample_rows(inside, 2 * SAMPLES_PER_RANGE * sum(parts.values()), sum(over.values()), 2 + turn)
        edges, extra = [*cuts, (2**63, 0)], {}
        for row in more:
            extra.setdefault(bisect.bisect_right(edges, row[:2]), []).append(row)
        cuts = sorted({*cuts, *(c for k, own in extra.items() if k in parts for c in quantile_cuts(own, parts[k]))})
    spark = rows.sparkSession
    before, start = [], (0, 0)
    for r in sorted(filled, key=lambda r: r["_range"]):
        before.append((r["_range"], *start))
        start = (start[0] + r["n"], start[1] + r["b"])
    return placed, spark.createDataFrame(before, "_range int, _rows_before long, _bytes_before long")


def byte_shards(rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` needs _key, _tie and _size (longs, no nulls); adds shard (int) and slot (long, gapless from 0).

    ``rows`` is read several times: pass a written table. The table of ranges has a few thousand rows
    (``shards`` times the ranges per shard), so it is broadcast.
    """
    placed, starts = cut_rows(rows, shards)
    if starts is None:
        return rows.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    total = rows.agg(F.sum("_size")).first()[0]
    order = Window.partitionBy("_range").orderBy("_key", "_tie", "_size")
    middle = F.col("_bytes_before") + F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size") / 2
    lined = landed(
        placed.join(F.broadcast(starts), "_range")
        .withColumn("_rank", F.col("_rows_before") + F.row_number().over(order) - 1)
        .withColumn("shard", F.least(F.floor(middle * shards / F.lit(total)), F.lit(shards - 1)).cast("int"))
        .drop("_range", "_rows_before", "_bytes_before"),
        "shards",
    )
    first = lined.groupBy("shard").agg(F.min("_rank").alias("_first"))
    return lined.join(F.broadcast(first), "shard").withColumn("slot", F.col("_rank") - F.col("_first")).drop("_rank", "_first")


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Documents (doc_id, text) in shards of near equal bytes: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Size: UTF-8 bytes of the text plus 16. The text is read once; all later steps work on the narrow table.
    """
    text = F.col("text")
    narrow = landed(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("_size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.when(text.isNull(), F.lit(LOWEST)).otherwise(F.xxhash64(text)).alias("_key"),
            F.coalesce("doc_id", F.lit(LOWEST)).alias("_tie"),
        ),
        "sizes",
    )
    return byte_shards(narrow, shards).select(
        "doc_id", F.col("_size").alias("size"), "text_crc32", F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
