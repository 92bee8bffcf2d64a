"""The model's tables read from the star-schema test tables.

customer -> asset register, events -> readings, orders -> work orders, nation -> production
lines, documents -> manual chunks. Alerts and recommendations are derived from those.
"""

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from rotorwatch import schemas as S
from rotorwatch.operators import enrich, search, serving, trends
from rotorwatch.plans import gold


def _once(build):
    """Build a table once per folder: plans that share it then share one frame."""

    @wraps(build)
    def get(self):
        if build.__name__ not in self._built:
            self._built[build.__name__] = build(self)
        return self._built[build.__name__]

    return get


# schemas of the files, so that opening a table reads no footers
FILES = {
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}

LOG_ORDER = ["timestamp", "o_orderkey"]
READING_ORDER = ["timestamp", "event_id"]


class Tables:
    """Lazy access to the bound tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._built = spark, folder, {}

    def raw(self, name: str) -> DataFrame:
        reader = self.spark.read.schema(FILES[name]) if name in FILES else self.spark.read
        return reader.parquet(f"{self.folder}/{name}.parquet")

    # -- landed tables -------------------------------------------------------

    @_once
    def assets_raw(self) -> DataFrame:
        return self.raw("customer").selectExpr(
            "concat('Asset_', c_custkey) AS asset_id",
            "c_mktsegment AS asset_type",
            "date_add(DATE '1992-01-01', CAST(c_custkey % 1000 AS INT)) AS installation_date",
            "concat('Line_', c_nationkey) AS production_line_id",
            "CAST(c_nationkey % 3 + 1 AS INT) AS criticality_tier",
            "c_acctbal / 20 AS rated_max_vibration",
            "CAST(60 + c_nationkey * 2 AS DOUBLE) AS rated_max_temp",
        )

    @_once
    def readings(self) -> DataFrame:
        return bind_readings(self.raw("events"))

    @_once
    def logs_raw(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "concat('WO-', o_orderkey) AS work_order_id",
            "o_orderkey",
            "concat('Asset_', o_custkey) AS asset_id",
            "CAST(o_orderdate AS TIMESTAMP) AS timestamp",
            "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Bearing failure' "
            "WHEN '2' THEN 'Vibration imbalance' WHEN '3' THEN 'Seal leak' WHEN '4' THEN 'Overheating' "
            "ELSE 'Belt wear' END AS fault_type",
            "CASE o_orderkey % 4 WHEN 0 THEN 'Drive bearing' WHEN 1 THEN 'Shaft seal' WHEN 2 THEN 'Belt' END "
            "AS part_replaced",
            "concat('T', o_orderkey % 7) AS technician_id",
            "CAST(o_orderkey % 89 AS DOUBLE) / 8 AS labor_hours",
            "o_totalprice AS cost_to_fix",
            "o_orderstatus = 'F' AS first_time_fix",
            "CAST(o_orderkey % 97 AS DOUBLE) / 8 AS downtime_hours",
        )

    @_once
    def production(self) -> DataFrame:
        return self.raw("nation").selectExpr(
            "concat('Line_', n_nationkey) AS line_id",
            "CAST(30000 + n_nationkey * 1000 AS INT) AS hourly_output_value_usd",
            "CAST(16 + n_nationkey % 8 AS INT) AS active_hours_per_day",
        )

    @_once
    def manuals(self) -> DataFrame:
        return self.raw("documents").selectExpr("concat('doc', doc_id) AS manual_name", "text")

    # -- silver and gold -----------------------------------------------------

    @_once
    def assets(self) -> DataFrame:
        return enrich.silver_asset_metadata(self.assets_raw())

    @_once
    def silver(self) -> DataFrame:
        return enrich.silver_sensor_readings(self.readings(), self.assets())

    @_once
    def logs(self) -> DataFrame:
        return enrich.silver_maintenance_logs(self.logs_raw(), self.assets())

    @_once
    def trends(self) -> DataFrame:
        return trends.hourly_trends(self.silver(), tie_break=("event_id",), rows=self.readings())

    @_once
    def as_of(self):
        """Newest hour, read from the bare readings: same as the newest hour of the trends."""
        return trends.latest_hour(self.readings(), "timestamp")

    @_once
    def health(self) -> DataFrame:
        return gold.gold_health_scores(self.trends(), self.assets(), self.as_of())

    @_once
    def cost(self) -> DataFrame:
        return gold.gold_cost_impact(self.health(), self.logs(), self.production())

    @_once
    def chunks(self) -> DataFrame:
        return search.chunk(self.manuals(), search.LINE_BOUNDARY)

    # -- serving -------------------------------------------------------------

    @_once
    def live(self) -> DataFrame:
        return serving.live_health(self.health(), self.as_of())

    @_once
    def alerts(self) -> DataFrame:
        """Every vibration anomaly as an alert; its source tells how far it was dealt with."""
        resolved = "data_source IN ('purchase', 'signup')"
        return self.silver().filter("vibration_anomaly_flag").selectExpr(
            "event_id AS disruption_id", "asset_id", "asset_id AS machine_id",
            "if(vibration_mm_s > rated_max_vibration, 'CRITICAL', 'HIGH') AS risk_level",
            "production_line_id AS impacted_line_id",
            "timestamp AS detection_timestamp",
            "CAST(NULL AS DOUBLE) AS estimated_rul_hours",
            "round(vibration_mm_s * 100, 2) AS estimated_downtime_cost",
            f"'{S.ACTION_IMMEDIATE}' AS recommended_action",
            f"CASE WHEN {resolved} THEN '{S.ALERT_RESOLVED}' WHEN data_source = 'view' "
            f"THEN '{S.ALERT_ACKNOWLEDGED}' ELSE '{S.ALERT_ACTIVE}' END AS status",
            f"if({resolved}, timestamp, NULL) AS resolved_at",
            f"if({resolved}, 'line lead', NULL) AS resolved_by",
        )

    @_once
    def recommendations(self) -> DataFrame:
        """One recommendation per order that replaced a part, citing two chunks of any of the manuals."""
        orders = self.logs().filter("part_replaced IS NOT NULL")
        manuals = self.raw("documents").agg(F.expr("count(1)")).scalar()
        return orders.withColumn("_manuals", manuals).selectExpr(
            "o_orderkey AS rec_id", "asset_id",
            "concat('Replace ', part_replaced, ' after ', fault_type) AS recommendation_text",
            "cost_to_fix", "downtime_hours * 1000 AS cost_of_downtime", "labor_hours AS urgency_hours",
            f"'{S.ACTION_PLANNED}' AS net_recommendation",
            "array(concat('doc', o_orderkey % _manuals, '_0'), concat('doc', (o_orderkey * 7 + 1) % _manuals, '_1')) "
            "AS vector_search_sources",
            "CAST(array() AS ARRAY<STRING>) AS manual_references",
            "timestamp AS created_at",
        )

    @_once
    def signals(self) -> DataFrame:
        """Error events as outside signals that know their line but not their asset."""
        return self.raw("events").filter("event_type = 'error'").selectExpr(
            "event_id AS signal_id", "value AS severity",
            "concat('Line_', user_id % 25) AS production_line_id",
        )


def bind_readings(events: DataFrame) -> DataFrame:
    """Events, batch or stream, as readings."""
    return events.selectExpr(
        "event_id", "CAST(ts AS TIMESTAMP) AS timestamp", "concat('Asset_', user_id) AS asset_id",
        "value AS vibration_mm_s", "CAST(get_json_object(props, '$.k') AS DOUBLE) AS temp_c",
        "event_type AS data_source",
    )
