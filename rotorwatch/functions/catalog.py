"""SQL functions over the gold and serving tables, for use from plain SQL.

Each reads a temporary view that holds the operator's DataFrame, so the rules live in one
place and Spark plans function and table together.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from rotorwatch import schemas as S
from rotorwatch.operators import history, search, serving

def _views(live: DataFrame, chunks: DataFrame, logs: DataFrame, cost: DataFrame, order) -> dict:
    patterns = search.describe_pattern(logs, "cost_to_fix").withColumn(
        "always", search.is_always_relevant(F.col("fault_type"))
    )
    return {
        "rw_live": serving.point_health(live.select("asset_id"), live),
        "rw_chunks": chunks,
        "rw_patterns": patterns,
        "rw_cost": cost,
        "rw_history": history.with_recency(logs, order),
    }


def _definitions() -> list[str]:
    planned = f"{S.LABOUR_RATE}D * estimated_repair_hours + {S.PARTS_SHARE}D * c.avg_cost_to_fix"
    return [
        '''get_asset_health(asset_id STRING) RETURNS STRING RETURN coalesce(
            (SELECT max(l.health) FROM rw_live l WHERE l.asset_id = get_asset_health.asset_id),
            to_json(named_struct(
                'error', concat("Asset '", get_asset_health.asset_id, "' not found in health database"))))''',
        """search_manuals(symptom_description STRING)
            RETURNS TABLE (chunk_id STRING, manual_name STRING, section STRING, content STRING, score DOUBLE)
            RETURN SELECT chunk_id, manual_name, section, content, score FROM rw_chunks
            WHERE content ILIKE concat('%', symptom_description, '%')
                OR section ILIKE concat('%', symptom_description, '%')
            ORDER BY score DESC, chunk_id LIMIT 5""",
        """search_failure_patterns(fault_description STRING)
            RETURNS TABLE (pattern_id STRING, asset_id STRING, fault_type STRING,
                symptom_description STRING, resolution STRING, score DOUBLE)
            RETURN SELECT p.pattern_id, p.asset_id, p.fault_type, p.symptom_description, p.resolution, p.score
            FROM rw_patterns p WHERE p.always OR p.fault_type ILIKE concat('%', fault_description, '%')
            ORDER BY p.cost_to_fix DESC, p.pattern_id LIMIT 5""",
        f"""calculate_cost_impact(asset_id STRING, estimated_repair_hours DOUBLE)
            RETURNS TABLE (asset_id STRING, production_line_id STRING, cost_to_fix_planned DOUBLE,
                cost_of_unplanned_failure DOUBLE, savings_by_acting_now DOUBLE,
                estimated_rul_hours DOUBLE, net_recommendation STRING)
            RETURN SELECT c.asset_id, c.production_line_id, round({planned}, 2),
                round(c.cost_of_unplanned_failure, 2), round(c.cost_of_unplanned_failure - ({planned}), 2),
                c.estimated_rul_hours, c.net_recommendation
            FROM rw_cost c WHERE c.asset_id = calculate_cost_impact.asset_id""",
        """get_maintenance_history(asset_id STRING, n_recent INT)
            RETURNS TABLE (work_order_id STRING, timestamp TIMESTAMP, fault_type STRING, part_replaced STRING,
                cost_to_fix DOUBLE, first_time_fix BOOLEAN, downtime_hours DOUBLE, days_since_prev_failure DOUBLE)
            RETURN SELECT g.work_order_id, g.timestamp, g.fault_type, g.part_replaced, g.cost_to_fix,
                g.first_time_fix, g.downtime_hours, CAST(g.days AS DOUBLE)
            FROM (SELECT h.*, datediff(h.timestamp, lag(h.timestamp)
                    OVER (PARTITION BY h.asset_id ORDER BY h.recency DESC)) AS days
                FROM rw_history h
                WHERE h.asset_id = get_maintenance_history.asset_id AND h.recency <= n_recent + 1) g
            WHERE g.recency <= n_recent""",
    ]


def register_functions(
    spark: SparkSession, live: DataFrame, chunks: DataFrame, logs: DataFrame, cost: DataFrame,
    order: list[str] = history.ORDER,
) -> list[str]:
    """Create the temporary functions; returns their names.

    Writing a recommendation is not a function: see `ServingLog.recommend`.
    """
    for name, df in _views(live, chunks, logs, cost, order).items():
        df.createOrReplaceTempView(name)
    names = []
    for definition in _definitions():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {definition}")
        names.append(definition.split("(")[0])
    return names
