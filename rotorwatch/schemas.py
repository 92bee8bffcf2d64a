"""Table schemas and the fixed values that every operator shares."""

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
    "int": T.IntegerType(), "bigint": T.LongType(), "date": T.DateType(),
    "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType()),
}


def _fields(spec: str) -> T.StructType:
    """``"name type, name type"`` as a StructType (all columns nullable)."""
    pairs = (item.split() for item in spec.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


SENSOR_READINGS = _fields(
    "timestamp timestamp, asset_id string, asset_type string, production_line_id string, "
    "vibration_mm_s double, temp_c double, pressure_psi double, rpm double, power_kw double, "
    "data_source string"
)
MAINTENANCE_LOGS = _fields(
    "work_order_id string, asset_id string, timestamp timestamp, fault_type string, "
    "part_replaced string, technician_id string, labor_hours double, cost_to_fix double, "
    "first_time_fix boolean, downtime_hours double"
)
ASSET_METADATA = _fields(
    "asset_id string, asset_type string, model_number string, manufacture_date date, "
    "installation_date date, production_line_id string, criticality_tier int, "
    "rated_max_vibration double, rated_max_temp double, replacement_cost int"
)
PRODUCTION_OUTPUT = _fields(
    "line_id string, hourly_output_value_usd int, active_hours_per_day int"
)
ASSET_HEALTH_LIVE = _fields(
    "asset_id string, health_score double, risk_level string, current_vibration double, "
    "current_temp double, rated_max_vibration double, estimated_rul_hours double, "
    "production_line_id string, criticality_tier int, calculated_at timestamp, "
    "last_updated timestamp"
)
ASSET_DISRUPTION = _fields(
    "disruption_id bigint, asset_id string, machine_id string, risk_level string, "
    "impacted_line_id string, detection_timestamp timestamp, estimated_rul_hours double, "
    "estimated_downtime_cost double, recommended_action string, status string, "
    "resolved_at timestamp, resolved_by string"
)
MAINTENANCE_RECOMMENDATIONS = _fields(
    "rec_id bigint, asset_id string, recommendation_text string, cost_to_fix double, "
    "cost_of_downtime double, urgency_hours double, net_recommendation string, "
    "vector_search_sources array<string>, manual_references array<string>, "
    "health_score_at_time double, created_by_session string, created_at timestamp"
)
MANUAL_CHUNKS = _fields(
    "chunk_id string, manual_name string, section string, content string, score double"
)

# ---------------------------------------------------------------------------
# Fixed values. These must hold exactly for results to be right.
# ---------------------------------------------------------------------------

# upper bound (exclusive) of the health score -> risk level; at or above the last bound: LOW
RISK_BANDS = ((30.0, "CRITICAL"), (60.0, "HIGH"), (80.0, "MEDIUM"))
RISK_ABOVE = "LOW"
RISK_UNKNOWN = "UNKNOWN"
AT_RISK = ("CRITICAL", "HIGH")
SEVERITY_ORDER = ("CRITICAL", "HIGH", "MEDIUM", "LOW")

ANOMALY_SHARE = 0.8
SMOOTHING_POINTS = 5
SLOPE_HOURS = 48

LABOUR_RATE = 85.0
PARTS_SHARE = 0.6
EMERGENCY_PREMIUM = 1.5
PLANNED_REPAIR_COST = 3200.0

ACTION_IMMEDIATE = "SCHEDULE_IMMEDIATE"
ACTION_PLANNED = "SCHEDULE_PLANNED"
ACTION_MONITOR = "MONITOR"

ALERT_ACTIVE = "ACTIVE"
ALERT_ACKNOWLEDGED = "ACKNOWLEDGED"
ALERT_RESOLVED = "RESOLVED"

ALWAYS_RELEVANT_FAULTS = ("bearing", "vibrat")
PATTERN_SCORE = 0.9
CHUNK_SCORE = 1.0

# vibration severity zones, mm/s: A < 2.3 <= B < 4.5 <= C <= 7.1 < D
ISO_ZONES = ((2.3, "A"), (4.5, "B"))
ISO_ZONE_C_LIMIT = 7.1

# alarm levels of one motor: (level, from, to), no end = None. A value on an edge belongs to the level that
# names it as its range first: 2.5 Watch, 4.0 Watch, 8.5 Alarm, 65 and 80 Warning; Normal is below
# its limit, the last level above its own. Between 80 and 85 degrees there is no level.
VIBRATION_ALARMS = (
    ("Normal", None, 2.5), ("Watch", 2.5, 4.0), ("Warning", 4.0, 6.5),
    ("Alarm", 6.5, 8.5), ("Critical", 8.5, None),
)
TEMPERATURE_ALARMS = (
    ("Normal", None, 65.0), ("Warning", 65.0, 80.0), ("Alarm", 85.0, None),
)

# preventive maintenance: asset type, task, text to find in part_replaced, tier (None = all), months
PM_INTERVALS = (
    ("Motor", "Bearing replacement", "bearing", 1, 24),
    ("Motor", "Bearing replacement", "bearing", 2, 36),
    ("Motor", "Bearing replacement", "bearing", 3, 60),
    ("Pump", "Mechanical seal replacement", "mechanical seal", None, 18),
    ("Pump", "Bearing replacement", "bearing", None, 36),
    ("Compressor", "Air filter replacement", "air filter", None, 1),
    ("Compressor", "Full service", "valve kit", None, 24),
    ("Conveyor", "Gearbox oil change", "gearbox oil", None, 12),
    ("Conveyor", "Belt replacement", "belt", None, 36),
    ("Conveyor", "Tensioner spring check", "tensioner", None, 6),
    ("HVAC", "Filter replacement", "filter", None, 1),
    ("HVAC", "Fan motor bearing re-grease", "fan motor", None, 12),
    ("HVAC", "Compressor service", "compressor kit", None, 36),
)
