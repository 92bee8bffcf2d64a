"""Serving tables as pure transforms: keyed upsert, alerts, recommendations, ids.

Writers for these results are in `rotorwatch.sources.serving_log`.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from rotorwatch import schemas as S
from rotorwatch.functions import costs, scores
from rotorwatch.operators.history_slices import trailing

ID_BUCKETS = 1024


def newest_by_key(updates: DataFrame, keys: list[str], version: str | None = None) -> DataFrame:
    """One row per key: the one of the newest version.

    Equal versions are settled by a hash of the row, so that a repeated task picks the same one.
    """
    row = F.struct(*updates.columns)
    rank = F.struct(*([version] if version else []), F.xxhash64(*updates.columns).alias("_hash"))
    newest = F.max_by(row, rank).alias("_row")
    return updates.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(newest).select("_row.*")


def upsert(
    target: DataFrame, updates: DataFrame, keys: list[str], version: str | None = None,
    now: Column | None = None, stamp: str = "last_updated",
) -> DataFrame:
    """Target with the updates put in: an update replaces every column of its key's row.

    The target is only anti-joined, so with few updates Spark broadcasts their keys and the
    target is not shuffled. ``version`` picks the newest of several updates of one key.
    """
    fresh = newest_by_key(updates, keys, version)
    if stamp in target.columns:
        fresh = fresh.withColumn(stamp, F.current_timestamp() if now is None else now)
    kept = target.join(fresh.select(*keys), keys, "left_anti")
    return kept.unionByName(fresh.select(*target.columns))


def live_health(health: DataFrame, now: Column | None = None) -> DataFrame:
    """Health scores in the columns of the live serving table."""
    stamped = health.withColumn("last_updated", F.current_timestamp() if now is None else now)
    return stamped.select(*S.ASSET_HEALTH_LIVE.names)


def without_recent_alert(
    alarms: DataFrame, existing: DataFrame, now: Column, gap_hours: float = 1
) -> DataFrame:
    """Alarms of assets that have no ACTIVE alert younger than the gap."""
    since = now - F.make_dt_interval(secs=F.lit(gap_hours * 3600.0))
    recent = existing.filter(
        (F.col("status") == S.ALERT_ACTIVE) & (F.col("detection_timestamp") > since)
    )
    # distinct first: an asset with very many alerts becomes one row per task before the shuffle
    return alarms.join(recent.select("asset_id").distinct(), "asset_id", "left_anti")


def new_disruptions(
    records: DataFrame, existing: DataFrame, now: Column, gap_hours: float = 1
) -> DataFrame:
    """Alert rows, without ids, for at-risk assets that were not alerted within the gap."""
    alarms = records.filter(scores.is_at_risk(F.col("risk_level")))
    return without_recent_alert(alarms, existing, now, gap_hours).select(
        "asset_id",
        F.col("asset_id").alias("machine_id"),
        "risk_level",
        F.col("production_line_id").alias("impacted_line_id"),
        now.alias("detection_timestamp"),
        "estimated_rul_hours",
        costs.alert_downtime_cost(
            F.col("estimated_rul_hours"), F.col("cost_of_unplanned_failure")
        ).alias("estimated_downtime_cost"),
        F.col("net_recommendation").alias("recommended_action"),
        F.lit(S.ALERT_ACTIVE).alias("status"),
        F.lit(None).cast("timestamp").alias("resolved_at"),
        F.lit(None).cast("string").alias("resolved_by"),
    )


def update_alerts(
    target: DataFrame, changes: DataFrame, now: Column, version: str = "new_status"
) -> DataFrame:
    """Apply status changes (disruption_id, new_status, changed_by) to alerts.

    A change to RESOLVED stamps time and resolver; any other change leaves those alone. Of
    several changes to one alert the greatest ``version`` counts: by default RESOLVED.
    """
    changed = newest_by_key(changes, ["disruption_id"], version).select(
        "disruption_id", "new_status", "changed_by"
    )
    resolves = F.col("new_status") == S.ALERT_RESOLVED
    return (
        target.join(changed, "disruption_id", "left")
        .withColumn("status", F.coalesce("new_status", "status"))
        .withColumn("resolved_at", F.when(resolves, now).otherwise(F.col("resolved_at")))
        .withColumn("resolved_by", F.when(resolves, F.col("changed_by")).otherwise(F.col("resolved_by")))
        .select(*target.columns)
    )


def with_live_health(recs: DataFrame, live: DataFrame) -> DataFrame:
    """Recommendations with the asset's present score; those of unknown assets fall away."""
    score = live.select("asset_id", F.col("health_score").alias("health_score_at_time"))
    return recs.join(score, "asset_id", "inner")


def recommendations_to_append(
    recs: DataFrame, live: DataFrame, now: Column, start: int = 1, session: str | None = None,
    order_by: list[str] | None = None, bucket: Column | None = None,
) -> DataFrame:
    """New rows of the recommendations table, ids included; missing source lists become empty.

    Ids follow ``order_by`` inside ``bucket``, see `with_serial_id`; by default all that was given, in hash buckets.
    """
    empty = F.array().cast("array<string>")
    rows = (
        with_live_health(recs, live)
        .withColumn("vector_search_sources", F.coalesce("vector_search_sources", empty))
        .withColumn("manual_references", F.coalesce("manual_references", empty))
        .withColumn("created_by_session", F.lit(session).cast("string"))
        .withColumn("created_at", now)
    )
    # ordered by all that was given, so that only rows equal in everything can swap their ids
    numbered = with_serial_id(rows, order_by or recs.columns, start, "rec_id", bucket)
    return numbered.select(*S.MAINTENANCE_RECOMMENDATIONS.names)


def confirmation(recs: DataFrame) -> DataFrame:
    """The saved-message of each recommendation, with its zero-padded number."""
    text = F.format_string("Recommendation REC-%05d saved for %s", "rec_id", "asset_id")
    return recs.select("rec_id", "asset_id", text.alias("message"))


def with_serial_id(
    df: DataFrame, order_by: list[str], start: int | Column = 1, id_col: str = "id",
    bucket: Column | None = None,
) -> DataFrame:
    """Number the rows from ``start`` without gaps, without sorting them in one task.

    Rows are numbered inside buckets and each bucket starts where the one before ended; only
    the bucket counts are summed up in one place. By default rows are spread over a fixed number
    of hash buckets, so ids rise but follow no column. Any other ``bucket`` that spreads the
    rows evenly will do: ids follow the bucket first, then the order. The order must be unique,
    so that a lost task computes the same ids again.
    """
    spread = F.pmod(F.xxhash64(*order_by), F.lit(ID_BUCKETS)) if bucket is None else bucket
    rows = df.withColumn("_bucket", spread)
    counts = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(
        Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = counts.select(
        F.col("_bucket").alias("_b"), F.coalesce(before, F.lit(0)).alias("_offset")
    )
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order_by))
    first = start if isinstance(start, Column) else F.lit(start)
    return (
        rows.withColumn("_place", inside)
        .join(offsets, F.col("_bucket").eqNullSafe(F.col("_b")))
        .withColumn(id_col, (first + F.col("_offset") + F.col("_place") - 1).cast("bigint"))
        .drop("_bucket", "_b", "_n", "_place", "_offset")
    )


def point_health(ids: DataFrame, live: DataFrame) -> DataFrame:
    """Live health of each asked asset as a JSON object, or an error object if there is none."""
    fields = [
        "asset_id", "health_score", "risk_level", "current_vibration", "current_temp",
        "rated_max_vibration", "estimated_rul_hours", "production_line_id", "criticality_tier",
        "last_updated",
    ]
    wanted = ids.select(F.col("asset_id").alias("_asked"))
    joined = wanted.join(live.select(*fields), F.col("_asked") == F.col("asset_id"), "left")
    found = F.to_json(
        F.struct(*fields[:-1], F.col("last_updated").cast("string").alias("last_updated")),
        {"ignoreNullFields": "false"},
    )
    message = F.concat(F.lit("Asset '"), "_asked", F.lit("' not found in health database"))
    missing = F.to_json(F.struct(message.alias("error")))
    return joined.select(
        F.col("_asked").alias("asset_id"),
        F.when(F.col("asset_id").isNull(), missing).otherwise(found).alias("health"),
    )


# -- reads of the serving tables ---------------------------------------------


def active_alerts(alerts: DataFrame, k: int = 10, text_order: bool = False) -> DataFrame:
    """The k most severe, then newest, active alerts.

    ``text_order`` sorts the labels as text, descending, which puts HIGH before CRITICAL.
    """
    severity = F.desc("risk_level") if text_order else scores.severity_rank(F.col("risk_level"))
    return (
        alerts.filter(F.col("status") == S.ALERT_ACTIVE)
        .select(
            "disruption_id", "asset_id", "risk_level", "impacted_line_id", "detection_timestamp",
            "estimated_rul_hours", "estimated_downtime_cost", "recommended_action", "status",
        )
        .orderBy(severity, F.desc("detection_timestamp"), "disruption_id")
        .limit(k)
    )


def recent_recs(recs: DataFrame, k: int = 5) -> DataFrame:
    return (
        recs.select(
            "rec_id", "asset_id", "recommendation_text", "cost_to_fix", "cost_of_downtime",
            "urgency_hours", "net_recommendation", "created_at",
        )
        .orderBy(F.desc("created_at"), F.desc("rec_id"))
        .limit(k)
    )


def risk_changes(history: DataFrame, **options) -> DataFrame:
    """Rows of a health history where an asset enters an at-risk level from another level.

    An asset's first row counts as entering. History columns: asset_id, calculated_at, risk_level.
    """
    before = {"previous_risk": lambda w: F.lag("risk_level").over(w)}
    with_before = trailing(
        history, "asset_id", ["calculated_at"], ["calculated_at", "risk_level"], 2, before, **options
    )
    changed = ~F.col("risk_level").eqNullSafe(F.col("previous_risk"))
    return with_before.filter(scores.is_at_risk(F.col("risk_level")) & changed)
