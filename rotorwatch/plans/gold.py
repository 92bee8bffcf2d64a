"""Gold tables: health scores and cost impact."""

from pyspark.sql import DataFrame, functions as F

from rotorwatch import schemas as S
from rotorwatch.functions import costs, scores
from rotorwatch.operators.history import repair_averages
from rotorwatch.operators.trends import latest_with_slope


def gold_health_scores(
    trends: DataFrame, meta: DataFrame, as_of=None, hours: int = S.SLOPE_HOURS,
    strict_compat: bool = False,
) -> DataFrame:
    """One row per asset: score, risk and remaining life at its newest hour.

    ``as_of`` defaults to the newest hour in ``trends``. ``strict_compat`` keeps two habits of
    the rules as first written: an asset without a rating counts as healthy, and the slope
    window starts at midnight.
    """
    latest = latest_with_slope(trends, as_of, hours, whole_days=strict_compat)
    rated = latest.join(meta.select("asset_id", "rated_max_vibration"), "asset_id", "left")
    vibration, rating = F.col("vibration_avg"), F.col("rated_max_vibration")
    score = scores.health_score(vibration, rating, strict_compat)
    life = scores.rul_hours(vibration, rating, F.col("vibration_slope_per_sec"), strict_compat)
    return rated.select(
        "asset_id",
        F.col("hour_window").alias("calculated_at"),
        "production_line_id",
        "criticality_tier",
        vibration.alias("current_vibration"),
        F.col("temp_avg").alias("current_temp"),
        "rated_max_vibration",
        F.round(score, 2).alias("health_score"),
        scores.risk_level(score).alias("risk_level"),
        F.round(life, 1).alias("estimated_rul_hours"),
    )


def join_cost(health: DataFrame, repairs: DataFrame, production: DataFrame) -> DataFrame:
    """Health with the asset's repair averages and the value of its line."""
    lines = production.select(
        F.col("line_id").alias("production_line_id"), "hourly_output_value_usd", "active_hours_per_day"
    )
    return health.join(repairs, "asset_id", "left").join(lines, "production_line_id", "left")


def gold_cost_impact(health: DataFrame, logs: DataFrame, production: DataFrame) -> DataFrame:
    """Repair now against an unplanned failure, per asset; uses the rounded health columns."""
    average = F.col("avg_cost_to_fix")
    return join_cost(health, repair_averages(logs), production).select(
        "asset_id", "calculated_at", "production_line_id", "health_score", "risk_level",
        "estimated_rul_hours", "avg_cost_to_fix", "avg_downtime_hours",
        F.round("first_time_fix_rate", 1).alias("first_time_fix_rate"),
        "hourly_output_value_usd",
        F.round(average, 2).alias("cost_to_fix_now"),
        costs.unplanned_cost(
            F.col("estimated_rul_hours"), F.col("hourly_output_value_usd"), average
        ).alias("cost_of_unplanned_failure"),
        costs.net_recommendation(F.col("risk_level")).alias("net_recommendation"),
    )


def health_with_cost(health: DataFrame, cost: DataFrame) -> DataFrame:
    """What the serving tables need: every health row with its cost figures, if any."""
    figures = cost.select(
        "asset_id", "cost_to_fix_now", "cost_of_unplanned_failure", "net_recommendation"
    )
    return health.join(figures, "asset_id", "left")
