"""Everything needed to decide on the at-risk assets, one row per asset, in one job."""

from pyspark.sql import DataFrame, functions as F

from rotorwatch.operators import history, search, text_index
from rotorwatch.operators.enrich import at_risk
from rotorwatch.session import written


def _ids(column: str, place: str):
    """Ids of a group in rank order; the group was cut to k rows before."""
    ranked = F.sort_array(F.collect_list(F.struct(place, column)))
    return F.array_join(F.transform(ranked, lambda r: r[column]), ",")


FEW_TERMS = 50  # up to so many terms are tested against every chunk; more go through the index, with the same result


def asset_dossier(
    cost: DataFrame, logs: DataFrame, chunks: DataFrame, k: int = 5,
    manual_terms: dict[str, str] | None = None, order: list[str] = history.ORDER,
) -> DataFrame:
    """Health, cost, recent orders, similar failures and manual chunks of every at-risk asset.

    Similar failures and manuals are searched once per fault, for the faults of the newest orders of at-risk assets,
    however many there are. ``manual_terms`` maps a fault to the words to look for in the manuals.
    """
    risky = at_risk(cost).select(
        "asset_id", "production_line_id", "health_score", "risk_level", "estimated_rul_hours",
        "cost_to_fix_now", "cost_of_unplanned_failure", "net_recommendation")
    orders = history.with_recency(logs, order).filter(F.col("recency") <= k).groupBy("asset_id").agg(
        _ids("work_order_id", "recency").alias("recent_orders"),
        F.max(F.when(F.col("recency") == 1, F.col("fault_type"))).alias("last_fault"),
    )
    rows = written(risky.join(orders, "asset_id", "left"), "at-risk")  # one row per asset at risk
    term = F.col("last_fault")
    if manual_terms:
        named = F.create_map(*[F.lit(x) for pair in manual_terms.items() for x in pair])
        term = F.coalesce(F.try_element_at(named, term), term)
    faults = written(rows.select("last_fault", term.alias("_term")).filter("last_fault IS NOT NULL").distinct(), "faults")
    patterns = text_index.search_failure_patterns(logs, faults.withColumnRenamed("last_fault", "query"), k)
    similar = patterns.groupBy(F.col("query").alias("last_fault")).agg(_ids("pattern_id", "rank").alias("similar_failures"))
    terms = [r._term for r in faults.select("_term").distinct().limit(FEW_TERMS + 1).collect()]
    if len(terms) <= FEW_TERMS:  # one scan tests them all
        hits = search.search_manuals(chunks, terms, k) if terms else chunks.limit(0).withColumns({"query": F.lit(""), "rank": F.lit(1)})
    else:
        hits = text_index.search_manuals(chunks, faults.withColumnRenamed("_term", "query"), k)
    manuals = hits.groupBy(F.col("query").alias("_term")).agg(_ids("chunk_id", "rank").alias("manual_chunks"))
    return (
        rows.withColumn("_term", term)
        .join(similar, "last_fault", "left").join(manuals, "_term", "left").drop("_term")
    )


def chat_requests(turns: DataFrame) -> DataFrame:
    """Per conversation its messages in order as role/content objects, and the last reply.

    For dialogues of a bounded length: all messages of a conversation end up in one row.
    """
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    messages = F.transform(
        ordered, lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))
    )
    return turns.groupBy("conv_id").agg(messages.alias("messages")).withColumn(
        "last_reply", F.element_at("messages", -1)["content"]
    )


def last_replies(turns: DataFrame) -> DataFrame:
    """Message count and last message per conversation of any length, by partial aggregation."""
    last = F.max_by(F.struct("role", "text"), "turn")
    return (
        turns.groupBy("conv_id")
        .agg(F.count(F.lit(1)).alias("message_count"), last.alias("_last"))
        .select(
            "conv_id", "message_count", F.col("_last.role").alias("last_role"),
            F.col("_last.text").alias("last_reply"),
        )
    )
