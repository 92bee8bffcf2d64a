"""Manual chunks, text search and vector search.

A search takes a short list of queries from the caller. All of them are answered in one scan:
each row is matched against every query by plain expressions and comes out once per match.
There is no join between rows and queries.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from rotorwatch import schemas as S

HEADING_BOUNDARY = r"\n(?=## )"
LINE_BOUNDARY = r"\n"


def chunk(docs: DataFrame, boundary: str = HEADING_BOUNDARY) -> DataFrame:
    """Cut documents (manual_name, text) into sections.

    A section is named by the heading it starts with, or by its number. Deeper headings stay
    inside their section.
    """
    title = F.regexp_extract("content", r"^#{1,2}\s+(.*\S)", 1)
    parts = docs.select(
        "manual_name", F.posexplode(F.split("text", boundary)).alias("_i", "content")
    )
    number = F.col("_i").cast("string")
    return parts.select(
        F.concat("manual_name", F.lit("_"), number).alias("chunk_id"),
        "manual_name",
        F.when(title == "", F.concat(F.lit("section_"), number)).otherwise(title).alias("section"),
        "content",
        F.lit(S.CHUNK_SCORE).alias("score"),
    )


def contains(text: Column, query: str) -> Column:
    """Case-insensitive substring test; ``%`` and ``_`` in the query act as wildcards."""
    return F.ilike(text, F.lit(f"%{query}%"))


def _per_query(df: DataFrame, matches: dict[str, Column]) -> DataFrame:
    """Each row once for every query whose condition it meets."""
    hits = F.array_compact(
        F.array(*[F.when(condition, F.lit(query)) for query, condition in matches.items()])
    )
    return df.withColumn("query", F.explode(hits))


def top_per_query(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    best_first = Window.partitionBy("query").orderBy(*order)
    return df.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k)


def search_manuals(chunks: DataFrame, queries: list[str], k: int = 5) -> DataFrame:
    """For each query the k best chunks that hold it in their text or section name.

    The text is put into lower case once, not once per query.
    """
    lowered = chunks.withColumns({"_content": F.lower("content"), "_section": F.lower("section")})
    matches = {}
    for q in queries:
        pattern = F.lower(F.lit(f"%{q}%"))
        matches[q] = F.like(F.col("_content"), pattern) | F.like(F.col("_section"), pattern)
    hits = _per_query(lowered, matches).drop("_content", "_section")
    return top_per_query(hits, k, F.desc("score"), "chunk_id")


def top_chunks(chunks: DataFrame, k: int = 5) -> DataFrame:
    return chunks.orderBy(F.desc("score"), "chunk_id").limit(k)


def is_always_relevant(fault: Column) -> Column:
    first, *others = (contains(fault, word) for word in S.ALWAYS_RELEVANT_FAULTS)
    for other in others:
        first = first | other
    return first


def describe_pattern(logs: DataFrame, *extra: str) -> DataFrame:
    """A work order in the words of the pattern search; NULL parts make the text NULL."""
    fault, downtime = F.col("fault_type"), F.round("downtime_hours", 1).cast("string")
    related = F.when(is_always_relevant(fault), "YES").otherwise("NO")
    return logs.select(
        F.col("work_order_id").alias("pattern_id"),
        "asset_id",
        "fault_type",
        F.concat(
            fault, F.lit(" on "), "asset_id", F.lit(" — vibration-related: "), related,
            F.lit(", downtime: "), downtime, F.lit("h"),
        ).alias("symptom_description"),
        F.concat(
            F.lit("Part replaced: "), F.coalesce("part_replaced", F.lit("unspecified")),
            F.lit(". Cost: $"), F.round("cost_to_fix", 0).cast("string"),
            F.lit(". First-time fix: "), F.col("first_time_fix").cast("string"),
            F.lit(". Downtime: "), downtime, F.lit("h"),
        ).alias("resolution"),
        F.lit(S.PATTERN_SCORE).alias("score"),
        *extra,
    )


def search_failure_patterns(logs: DataFrame, queries: list[str], k: int = 5) -> DataFrame:
    """For each query the k costliest orders whose fault holds it, or is a bearing or vibration fault.

    The cut to k runs on the raw orders; only those few are put into words.
    """
    fault = F.col("fault_type")
    matches = {q: contains(fault, q) | is_always_relevant(fault) for q in queries}
    best = top_per_query(_per_query(logs, matches), k, F.desc("cost_to_fix"), "work_order_id")
    return describe_pattern(best, "query", "rank")


def top_patterns(logs: DataFrame, k: int = 5) -> DataFrame:
    """The k costliest bearing or vibration orders."""
    best = logs.filter(is_always_relevant(F.col("fault_type")))
    return describe_pattern(best.orderBy(F.desc("cost_to_fix"), "work_order_id").limit(k))


def vector_top_k(
    vectors: DataFrame, queries: dict[str, list[float]], k: int = 5,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """Cosine similarity search: the k nearest vectors of each query vector."""

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    stored = F.transform(vector_col, lambda x: x.cast("double"))
    scored = []
    for name, values in queries.items():
        norm = sum(v * v for v in values) ** 0.5
        unit = F.array(*[F.lit(v / norm) for v in values])
        similarity = F.try_divide(dot(F.col("_v"), unit), F.col("_norm"))
        scored.append(F.struct(F.lit(name).alias("query"), similarity.alias("similarity")))
    rows = (
        vectors.select(id_col, stored.alias("_v"))
        .withColumn("_norm", F.sqrt(dot(F.col("_v"), F.col("_v"))))
        .select(id_col, F.inline(F.array(*scored)))
    )
    return top_per_query(rows, k, F.desc_nulls_last("similarity"), id_col)


def provenance(recs: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per chunk that a recommendation cites, with the text; NULL if it is unknown."""
    cited = recs.select(
        "rec_id", "asset_id", F.explode("vector_search_sources").alias("chunk_id")
    )
    return cited.join(
        chunks.select("chunk_id", "manual_name", "section", "content"), "chunk_id", "left"
    )
