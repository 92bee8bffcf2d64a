"""Named business queries over the gold and serving tables."""

from pyspark.sql import Column, DataFrame, functions as F

from rotorwatch import schemas as S
from rotorwatch.functions import costs, scores
from rotorwatch.operators import history, trends
from rotorwatch.operators.enrich import at_risk


def health_board(health: DataFrame) -> DataFrame:
    """All assets, worst first."""
    return health.select(
        "asset_id", "production_line_id", "criticality_tier",
        F.round("health_score", 1).alias("health_score"), "risk_level",
        F.round("current_vibration", 3).alias("vibration_mm_s"),
        F.round("estimated_rul_hours", 1).alias("rul_hours"), "calculated_at",
    ).orderBy("health_score", "asset_id")


def _costliest_first(cost: DataFrame) -> DataFrame:
    return at_risk(cost).orderBy(F.desc_nulls_last("cost_of_unplanned_failure"), "asset_id")


def cost_summary(cost: DataFrame) -> DataFrame:
    """At-risk assets with the saving of repairing now."""
    planned, unplanned = F.col("cost_to_fix_now"), F.col("cost_of_unplanned_failure")
    return _costliest_first(cost).select(
        "asset_id", "production_line_id", "risk_level",
        F.round("estimated_rul_hours", 1).alias("rul_hours"),
        F.round(planned, 0).alias("cost_to_fix_usd"),
        F.round(unplanned, 0).alias("cost_if_fails_usd"),
        F.round(unplanned - planned, 0).alias("savings_by_fixing_now"),
        "net_recommendation",
    )


def cost_compare(cost: DataFrame) -> DataFrame:
    return _costliest_first(cost).select(
        "asset_id", "production_line_id",
        F.round("cost_to_fix_now", 0).alias("planned_repair_cost"),
        F.round("cost_of_unplanned_failure", 0).alias("unplanned_failure_cost"),
        "net_recommendation",
    )


def cost_impact(cost: DataFrame, hours: float | Column = 4.0, *keep: str) -> DataFrame:
    """Planned repair of the given length against an unplanned failure, per asset.

    ``hours`` may be a column of ``cost``, for requests with their own hours joined on;
    ``keep`` names further columns to give back.
    """
    length = hours if isinstance(hours, Column) else F.lit(float(hours))
    planned = costs.planned_cost(length, F.col("avg_cost_to_fix"))
    unplanned = F.col("cost_of_unplanned_failure")
    return cost.select(
        "asset_id", "production_line_id",
        F.round(planned, 2).alias("cost_to_fix_planned"),
        F.round(unplanned, 2).alias("cost_of_unplanned_failure"),
        F.round(unplanned - planned, 2).alias("savings_by_acting_now"),
        "estimated_rul_hours", "net_recommendation", *keep,
    )


def dash_cost(
    health: DataFrame, production: DataFrame, plan: float = S.PLANNED_REPAIR_COST
) -> DataFrame:
    """Quick cost view of at-risk assets at one flat repair cost."""
    lines = production.select(
        F.col("line_id").alias("production_line_id"), F.col("hourly_output_value_usd").alias("_hourly")
    )
    life = F.coalesce("estimated_rul_hours", F.lit(0.0))
    return at_risk(health).join(lines, "production_line_id", "left").select(
        "asset_id", "production_line_id",
        F.round("health_score", 0).alias("health_score"),
        life.alias("rul_hours"),
        F.lit(plan).alias("plan_now_usd"),
        F.round(life * F.col("_hourly") + plan * S.EMERGENCY_PREMIUM, 0).alias("unplanned_cost_usd"),
        F.col("risk_level").alias("action"),
    )


def fleet_counts(health: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row: assets in all and by risk, and the active alerts."""
    risk = F.col("risk_level")
    active = alerts.agg(F.count_if(F.col("status") == S.ALERT_ACTIVE)).scalar()
    return health.agg(
        F.count(F.lit(1)).alias("total_assets"),
        *[F.count_if(risk == name).alias(f"{name.lower()}_count") for name in ("CRITICAL", "HIGH", "LOW")],
    ).withColumn("active_alerts", active)


def floor_map(health: DataFrame) -> DataFrame:
    """All assets line by line, worst first on each. A line may be of any size: it is a sort
    over line and score, never one group."""
    return health.select(
        "production_line_id", "asset_id", F.round("health_score", 0).alias("health_score"),
        "risk_level", "estimated_rul_hours", F.col("health_score").alias("_exact"),
    ).orderBy("production_line_id", "_exact", "asset_id").drop("_exact")


def floor_map_lines(health: DataFrame) -> DataFrame:
    """One row per line with its assets as a sorted array: for lines of a few thousand assets."""
    assets = F.sort_array(F.collect_list(F.struct("health_score", "asset_id", "risk_level")))
    return health.groupBy("production_line_id").agg(assets.alias("assets"))


# name -> (tables it reads, builder)
REPORTS = {
    "health_status": (("health",), health_board),
    "mtbf_by_asset": (("logs",), history.mtbf_by_asset),
    "vibration_trend": (("trends",), trends.trend_recent),
    "cost_impact_summary": (("cost",), cost_summary),
    "first_time_fix_by_technician": (("logs",), history.ftf_by_technician),
    "mtbf": (("logs",), history.mtbf),
    "first_time_fix_rate": (("logs",), history.ftf_by_asset),
    "cost_comparison": (("cost",), cost_compare),
}


def run_report(name: str, tables: dict[str, DataFrame]) -> DataFrame:
    needs, build = REPORTS[name]
    return build(*[tables[t] for t in needs])
