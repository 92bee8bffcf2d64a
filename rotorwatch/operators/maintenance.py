"""Maintenance planning: stop rules, restart gate, preventive maintenance, outage cost."""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from rotorwatch import schemas as S
from rotorwatch.functions import costs
from rotorwatch.functions.scores import is_at_risk
from rotorwatch.operators.search import contains


def _stop_rules(vibration: Column, rated: Column, temp: Column, rated_temp: Column,
                tier: Column, score: Column) -> dict[str, Column]:
    """When each asset type must be stopped at once; other types have no vibration rule."""
    return {
        "Motor": F.when(tier == 1, (vibration > rated) | (score < 20)).otherwise(
            vibration > rated * 1.05
        ),
        "Pump": (vibration > rated) & (temp > rated_temp * 0.75),
        "Compressor": vibration > rated * 0.9,
        "Turbine": vibration > rated,
    }


def stop_conditions(
    silver: DataFrame, health: DataFrame, type_names: dict[str, str] | None = None
) -> DataFrame:
    """Readings at which their asset must be stopped, by the rule of its type and tier.

    ``type_names`` maps the fleet's own type names to those of the rules.
    """
    names = type_names or {}
    kind = F.col("asset_type")
    if names:
        table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
        kind = F.coalesce(F.try_element_at(table, kind), kind)
    rows = silver.join(health.select("asset_id", "health_score"), "asset_id", "left")
    rules = _stop_rules(
        F.col("vibration_mm_s"), F.col("rated_max_vibration"), F.col("temp_c"),
        F.col("rated_max_temp"), F.col("criticality_tier"), F.col("health_score"),
    )
    stop = F.lit(False)
    for name, rule in rules.items():
        stop = stop | ((kind == name) & rule)
    return rows.withColumn("rule_type", kind).filter(F.coalesce(stop, F.lit(False)))


def restart_gate(health: DataFrame, alerts: DataFrame, min_score: float = 50.0) -> DataFrame:
    """Assets that may be restarted: score above the minimum and no active alert."""
    active = alerts.filter(F.col("status") == S.ALERT_ACTIVE).select("asset_id").distinct()
    return health.filter(F.col("health_score") > min_score).join(active, "asset_id", "left_anti")


def pm_schedule(
    assets: DataFrame, logs: DataFrame, intervals: Iterable[tuple] = S.PM_INTERVALS, own: DataFrame | None = None
) -> DataFrame:
    """Next due date of every task of every asset.

    A task is due one interval after the last order that replaced its part, or after the
    installation where there is none. The short list of intervals goes into the plan as
    literals: the orders are aggregated once for all tasks, with no join per task. ``own`` (asset_id, task, months; one
    row per asset and task) holds intervals of single assets, which go before those of their type and tier.
    """
    intervals = list(intervals)
    parts = list(dict.fromkeys(part for _, _, part, _, _ in intervals))
    last_done = logs.groupBy("asset_id").agg(*[
        F.max(F.when(contains(F.col("part_replaced"), part), F.col("timestamp"))).alias(f"_done_{i}")
        for i, part in enumerate(parts)
    ])
    tasks = F.array(*[
        F.struct(
            F.lit(kind).alias("kind"), F.lit(tier).cast("int").alias("tier"), F.lit(task).alias("task"),
            F.lit(months).alias("months"), F.col(f"_done_{parts.index(part)}").alias("last_done"),
        )
        for kind, task, part, tier, months in intervals
    ])
    fits = F.filter(
        tasks,
        lambda t: (t["kind"] == F.col("asset_type"))
        & (t["tier"].isNull() | (t["tier"] == F.col("criticality_tier"))),
    )
    start = F.to_date(F.coalesce("last_done", F.col("installation_date").cast("timestamp")))
    tasks_of_assets = (
        assets.select("asset_id", "asset_type", "criticality_tier", "installation_date")
        .join(last_done, "asset_id", "left")
        .select("asset_id", "asset_type", "criticality_tier", "installation_date",
                F.explode(fits).alias("_t"))
        .select(
            "asset_id", "asset_type", "criticality_tier", "installation_date", "_t.task", "_t.last_done", "_t.months"
        )
    )
    if own is not None:
        named = own.select("asset_id", "task", F.col("months").alias("_own"))
        tasks_of_assets = tasks_of_assets.join(named, ["asset_id", "task"], "left").withColumn("months", F.coalesce("_own", "months"))
    return tasks_of_assets.select(
        "asset_id", "asset_type", "criticality_tier", "task", F.to_date("last_done").alias("last_done"),
        F.add_months(start, F.col("months")).alias("due_date"),
    )


def pm_due(
    assets: DataFrame, logs: DataFrame, as_of: Column, days: int = 90,
    intervals: Iterable[tuple] = S.PM_INTERVALS, own: DataFrame | None = None,
) -> DataFrame:
    """Tasks due within ``days`` of ``as_of``; overdue tasks count as due."""
    until = F.date_add(F.to_date(as_of), days)
    return pm_schedule(assets, logs, intervals, own).filter(F.col("due_date") <= until)


def pm_combine(due: DataFrame, days: int = 30) -> DataFrame:
    """Tasks of one asset that follow each other within ``days`` as one job.

    An asset has only as many rows here as there are tasks, so its window is small.
    """
    by_date = Window.partitionBy("asset_id").orderBy("due_date", "task")
    gap = F.date_diff("due_date", F.lag("due_date").over(by_date))
    return (
        due.withColumn("_gap", gap)
        .withColumn("job", F.count_if(F.coalesce(F.col("_gap") > days, F.lit(True))).over(by_date))
        .groupBy("asset_id", "job")
        .agg(
            F.min("due_date").alias("first_due"), F.max("due_date").alias("last_due"),
            F.count(F.lit(1)).alias("task_count"),
            F.array_join(F.sort_array(F.collect_list("task")), ", ").alias("tasks"),
        )
    )


def outage_costs(cost: DataFrame, hours_down: float = 8.0, planned_hours: float = 4.0) -> DataFrame:
    """Unplanned against planned stop of each asset, in production hours and off shift."""
    hourly, repair = F.col("hourly_output_value_usd"), F.col("avg_cost_to_fix")

    def planned(off_shift: bool) -> Column:
        return costs.planned_outage_cost(hourly, F.lit(planned_hours), repair, F.lit(off_shift))

    return cost.select(
        "asset_id",
        F.round(costs.outage_cost(hourly, F.lit(hours_down), repair), 2).alias("unplanned_cost"),
        F.round(planned(False), 2).alias("planned_cost"),
        F.round(planned(True), 2).alias("off_shift_cost"),
    )


def expected_shutdown_cost(cost: DataFrame, window_hours: float = 12.0) -> DataFrame:
    """Chance of failing in the window times the output lost over the asset's usual downtime.

    The chance is our choice of model, see `failure_probability`; an asset without repair
    history has no usual downtime and so no figure.
    """
    chance = costs.failure_probability(F.col("estimated_rul_hours"), window_hours)
    loss = chance * F.col("hourly_output_value_usd") * F.col("avg_downtime_hours")
    return cost.select(
        "asset_id", "risk_level",
        F.round(chance, 4).alias("failure_probability"),
        F.round(loss, 2).alias("expected_shutdown_cost"),
    )


def line_exposure(cost: DataFrame) -> DataFrame:
    """Lines with assets at risk: how many, the money exposed, the shortest remaining life."""
    return (
        cost.filter(is_at_risk(F.col("risk_level")))
        .groupBy("production_line_id")
        .agg(
            F.count(F.lit(1)).alias("assets_at_risk"),
            F.round(F.sum("cost_of_unplanned_failure"), 2).alias("exposure_usd"),
            F.min("estimated_rul_hours").alias("shortest_rul_hours"),
        )
    )
