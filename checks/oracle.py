"""SQL with the same meaning as each registered query, for a second engine."""

BASE = {}  # common table expressions, in the order they may refer to each other

BASE["assets_raw"] = """
SELECT concat('Asset_', CAST(c_custkey AS VARCHAR)) AS asset_id, c_mktsegment AS asset_type,
  CAST(DATE '1992-01-01' + CAST(c_custkey % 1000 AS INT) AS DATE) AS installation_date,
  concat('Line_', CAST(c_nationkey AS VARCHAR)) AS production_line_id,
  CAST(c_nationkey % 3 + 1 AS INT) AS criticality_tier,
  c_acctbal / 20 AS rated_max_vibration, CAST(60 + c_nationkey * 2 AS DOUBLE) AS rated_max_temp
FROM customer"""
BASE["readings"] = """
SELECT event_id, ts AS timestamp, concat('Asset_', CAST(user_id AS VARCHAR)) AS asset_id,
  value AS vibration_mm_s, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS temp_c,
  event_type AS data_source
FROM events"""
BASE["logs_raw"] = """
SELECT concat('WO-', CAST(o_orderkey AS VARCHAR)) AS work_order_id, o_orderkey,
  concat('Asset_', CAST(o_custkey AS VARCHAR)) AS asset_id, o_orderdate AS timestamp,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Bearing failure' WHEN '2' THEN 'Vibration imbalance'
    WHEN '3' THEN 'Seal leak' WHEN '4' THEN 'Overheating' ELSE 'Belt wear' END AS fault_type,
  CASE o_orderkey % 4 WHEN 0 THEN 'Drive bearing' WHEN 1 THEN 'Shaft seal' WHEN 2 THEN 'Belt' END AS part_replaced,
  concat('T', CAST(o_orderkey % 7 AS VARCHAR)) AS technician_id,
  CAST(o_orderkey % 89 AS DOUBLE) / 8 AS labor_hours, o_totalprice AS cost_to_fix,
  o_orderstatus = 'F' AS first_time_fix, CAST(o_orderkey % 97 AS DOUBLE) / 8 AS downtime_hours
FROM orders"""
BASE["production"] = """
SELECT concat('Line_', CAST(n_nationkey AS VARCHAR)) AS line_id,
  CAST(30000 + n_nationkey * 1000 AS INT) AS hourly_output_value_usd,
  CAST(16 + n_nationkey % 8 AS INT) AS active_hours_per_day
FROM nation"""
BASE["assets"] = """
SELECT * FROM assets_raw WHERE asset_id IS NOT NULL AND rated_max_vibration > 0 AND rated_max_temp > 0"""
BASE["silver"] = """
SELECT r.event_id, r.timestamp, r.asset_id, r.vibration_mm_s, r.temp_c, r.data_source,
  a.asset_type, a.production_line_id, a.criticality_tier, a.rated_max_vibration, a.rated_max_temp,
  coalesce(r.vibration_mm_s > a.rated_max_vibration * 8e-1, FALSE) AS vibration_anomaly_flag,
  coalesce(r.temp_c > a.rated_max_temp * 8e-1, FALSE) AS temp_anomaly_flag
FROM readings r LEFT JOIN assets a ON r.asset_id = a.asset_id"""
BASE["logs"] = """
SELECT l.*, a.asset_type, a.production_line_id, a.criticality_tier
FROM logs_raw l LEFT JOIN assets a ON l.asset_id = a.asset_id
WHERE l.work_order_id IS NOT NULL AND l.asset_id IS NOT NULL AND l.timestamp IS NOT NULL"""
# the trailing means are spelled out so that both engines add the five values in the same order
_MEAN5 = "(" + " + ".join(f"coalesce(lag({{c}}, {i}) OVER w, 0e0)" for i in (4, 3, 2, 1)) + " + {c}) / least(row_number() OVER w, 5)"
BASE["smoothed"] = f"""
SELECT *, {_MEAN5.format(c='vibration_mm_s')} AS vib5, {_MEAN5.format(c='temp_c')} AS temp5 FROM silver
WINDOW w AS (PARTITION BY asset_id ORDER BY timestamp, event_id)"""
BASE["trends"] = """
SELECT date_trunc('hour', timestamp) AS hour_window, asset_id, production_line_id, criticality_tier,
  round(avg(vib5), 4) AS vibration_avg, max(vibration_mm_s) AS vibration_max,
  round(stddev_samp(vibration_mm_s), 4) AS vibration_stddev, round(avg(temp5), 2) AS temp_avg,
  max(temp_c) AS temp_max, CAST(sum(CAST(vibration_anomaly_flag AS INT)) AS BIGINT) AS anomaly_count,
  count(*) AS reading_count
FROM smoothed GROUP BY ALL"""
BASE["now_hour"] = "SELECT date_trunc('hour', max(timestamp)) AS as_of FROM readings"
BASE["latest"] = """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY hour_window DESC) AS rn FROM trends) WHERE rn = 1"""
BASE["slopes"] = """
SELECT asset_id, CASE WHEN count(*) > 1 THEN regr_slope(vibration_avg, epoch(hour_window)) END AS slope
FROM trends WHERE hour_window >= (SELECT as_of - INTERVAL 48 HOUR FROM now_hour) GROUP BY asset_id"""
BASE["scored"] = """
SELECT l.asset_id, l.hour_window AS calculated_at, l.production_line_id, l.criticality_tier,
  l.vibration_avg AS current_vibration, l.temp_avg AS current_temp, a.rated_max_vibration, s.slope,
  CASE WHEN a.rated_max_vibration IS NULL THEN NULL
    ELSE greatest(0e0, least(100e0, 100e0 - l.vibration_avg / a.rated_max_vibration * 100e0)) END AS score
FROM latest l LEFT JOIN assets a ON l.asset_id = a.asset_id LEFT JOIN slopes s ON l.asset_id = s.asset_id"""
BASE["health"] = """
SELECT asset_id, calculated_at, production_line_id, criticality_tier, current_vibration, current_temp,
  rated_max_vibration, round(score, 2) AS health_score,
  CASE WHEN score IS NULL THEN 'UNKNOWN' WHEN score < 30 THEN 'CRITICAL' WHEN score < 60 THEN 'HIGH'
    WHEN score < 80 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
  CASE WHEN slope > 0 AND rated_max_vibration IS NOT NULL
    THEN round(greatest(0e0, (rated_max_vibration - current_vibration) / (slope * 3600e0)), 1) END AS estimated_rul_hours
FROM scored"""
BASE["repairs"] = """
SELECT asset_id, avg(cost_to_fix) AS avg_cost_to_fix, avg(downtime_hours) AS avg_downtime_hours,
  avg(labor_hours) AS avg_labor_hours,
  CAST(sum(CASE first_time_fix WHEN true THEN 1 WHEN false THEN 0 END) AS DOUBLE) * 100 / count(*) AS first_time_fix_rate
FROM logs GROUP BY asset_id"""
BASE["cost"] = """
SELECT h.asset_id, h.calculated_at, h.production_line_id, h.health_score, h.risk_level, h.estimated_rul_hours,
  r.avg_cost_to_fix, r.avg_downtime_hours, round(r.first_time_fix_rate, 1) AS first_time_fix_rate,
  p.hourly_output_value_usd, round(r.avg_cost_to_fix, 2) AS cost_to_fix_now,
  round(coalesce(h.estimated_rul_hours, 0) * p.hourly_output_value_usd + 15e-1 * r.avg_cost_to_fix, 2)
    AS cost_of_unplanned_failure,
  CASE WHEN h.risk_level IN ('CRITICAL', 'HIGH') THEN 'SCHEDULE_IMMEDIATE'
    WHEN h.risk_level = 'MEDIUM' THEN 'SCHEDULE_PLANNED' ELSE 'MONITOR' END AS net_recommendation
FROM health h LEFT JOIN repairs r ON h.asset_id = r.asset_id
LEFT JOIN production p ON h.production_line_id = p.line_id"""
BASE["chunks"] = """
SELECT concat('doc', CAST(doc_id AS VARCHAR), '_', CAST(i - 1 AS VARCHAR)) AS chunk_id,
  concat('doc', CAST(doc_id AS VARCHAR)) AS manual_name,
  CASE WHEN regexp_matches(content, '^#{1,2}\\s+.*\\S') THEN regexp_extract(content, '^#{1,2}\\s+(.*\\S)', 1)
    ELSE concat('section_', CAST(i - 1 AS VARCHAR)) END AS section,
  content, 1e0 AS score
FROM (SELECT doc_id, unnest(parts) AS content, generate_subscripts(parts, 1) AS i
      FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))"""
BASE["alerts"] = """
SELECT event_id AS disruption_id, asset_id, asset_id AS machine_id,
  CASE WHEN vibration_mm_s > rated_max_vibration THEN 'CRITICAL' ELSE 'HIGH' END AS risk_level,
  production_line_id AS impacted_line_id, timestamp AS detection_timestamp,
  CAST(NULL AS DOUBLE) AS estimated_rul_hours, round(vibration_mm_s * 100, 2) AS estimated_downtime_cost,
  'SCHEDULE_IMMEDIATE' AS recommended_action,
  CASE WHEN data_source IN ('error', 'click') THEN 'ACTIVE' WHEN data_source = 'view' THEN 'ACKNOWLEDGED'
    ELSE 'RESOLVED' END AS status,
  CASE WHEN data_source IN ('purchase', 'signup') THEN timestamp END AS resolved_at,
  CASE WHEN data_source IN ('purchase', 'signup') THEN 'line lead' END AS resolved_by
FROM silver WHERE vibration_anomaly_flag"""
BASE["recs"] = """
SELECT o_orderkey AS rec_id, asset_id, concat('Replace ', part_replaced, ' after ', fault_type) AS recommendation_text,
  cost_to_fix, downtime_hours * 1000 AS cost_of_downtime, labor_hours AS urgency_hours,
  'SCHEDULE_PLANNED' AS net_recommendation,
  [concat('doc', CAST(o_orderkey % (SELECT count(*) FROM documents) AS VARCHAR), '_0'),
   concat('doc', CAST((o_orderkey * 7 + 1) % (SELECT count(*) FROM documents) AS VARCHAR), '_1')] AS vector_search_sources,
  timestamp AS created_at
FROM logs WHERE part_replaced IS NOT NULL"""
BASE["gaps"] = """
SELECT *, date_diff('day', lag(timestamp) OVER (PARTITION BY asset_id ORDER BY timestamp, o_orderkey), timestamp)
  AS gap FROM logs"""
BASE["mtbf_rows"] = """
SELECT asset_id, asset_type, production_line_id, count(*) AS total_failures, round(avg(gap), 1) AS mtbf_days,
  round(avg(cost_to_fix), 0) AS avg_repair_cost, round(avg(downtime_hours), 1) AS avg_downtime_hours
FROM gaps WHERE gap IS NOT NULL GROUP BY ALL"""

NEEDS = {
    "assets": ["assets_raw"], "silver": ["readings", "assets"], "logs": ["logs_raw", "assets"],
    "smoothed": ["silver"], "trends": ["smoothed"], "now_hour": ["readings"], "latest": ["trends"],
    "slopes": ["trends", "now_hour"], "scored": ["latest", "assets", "slopes"], "health": ["scored"],
    "repairs": ["logs"], "cost": ["health", "repairs", "production"], "alerts": ["silver"],
    "recs": ["logs"], "gaps": ["logs"], "mtbf_rows": ["gaps"],
}


def half_up(sql: str) -> str:
    """Rewrite round(x, n) to round the decimal digits of x half up, as Spark rounds doubles.

    DuckDB scales a double by a power of ten instead, which breaks ties such as 1.005 downward.
    """
    out, at = [], 0
    while (start := sql.find("round(", at)) >= 0:
        out.append(sql[at:start])
        depth, comma, end = 1, 0, start + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            comma = end if sql[end] == "," and depth == 1 else comma
            end += 1
        value, digits = half_up(sql[start + 6:comma]), sql[comma + 1:end - 1].strip()
        out.append(f"CAST(round(TRY_CAST(CAST({value} AS VARCHAR) AS DECIMAL(38, 20)), {digits}) AS DOUBLE)")
        at = end
    return "".join(out) + sql[at:]


def _closure(names):
    wanted, todo = set(), list(names)
    while todo:
        name = todo.pop()
        if name not in wanted:
            wanted.add(name)
            todo += NEEDS.get(name, [])
    return [name for name in BASE if name in wanted]


def _sql(uses: str, body: str) -> str:
    parts = [f"{name} AS ({BASE[name].strip()})" for name in _closure(uses.split())]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body.strip()


ORDERED = "PARTITION BY asset_id ORDER BY timestamp, event_id"


def _runs(source: str, hit: str, value: str, ts: str, order: str) -> str:
    """Maximal runs of consecutive rows of ``source`` with ``hit`` true."""
    return f"""
SELECT asset_id, min({ts}) AS run_start, max({ts}) AS run_end, count(*) AS run_length, max({value}) AS peak_value
FROM (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY asset_id ORDER BY {order}
        ROWS UNBOUNDED PRECEDING) AS island
      FROM (SELECT *, coalesce({hit}, FALSE) AS hit FROM {source})) WHERE hit
GROUP BY asset_id, island"""


def _search_rows(table: str, condition: str, terms, order: str) -> str:
    parts = [
        f"SELECT '{q}' AS query, row_number() OVER (ORDER BY {order}) AS rank, * FROM {table} WHERE "
        + condition.replace("?", f"'%{q}%'")
        for q in terms
    ]
    return " UNION ALL ".join(parts)


_PATTERN = """
  work_order_id AS pattern_id, asset_id, fault_type,
  concat(fault_type, ' on ', asset_id, ' — vibration-related: ',
    CASE WHEN fault_type ILIKE '%bearing%' OR fault_type ILIKE '%vibrat%' THEN 'YES' ELSE 'NO' END,
    ', downtime: ', CAST(round(downtime_hours, 1) AS VARCHAR), 'h') AS symptom_description,
  concat('Part replaced: ', coalesce(part_replaced, 'unspecified'), '. Cost: $', CAST(round(cost_to_fix, 0) AS VARCHAR),
    '. First-time fix: ', CAST(first_time_fix AS VARCHAR), '. Downtime: ',
    CAST(round(downtime_hours, 1) AS VARCHAR), 'h') AS resolution,
  9e-1 AS score"""
_FAULT_MATCH = "(fault_type ILIKE ? OR fault_type ILIKE '%bearing%' OR fault_type ILIKE '%vibrat%')"
_QUERY_LIST = "SELECT unnest(['license', 'the ', 'contact', '100%', 'overheat', 'SEAL', 'belt', 's_al', 'e', 'zq%xj'])"
_CHUNK_MATCH = "(content ILIKE ? OR section ILIKE ?)"
_COST_PARTS = "CASE WHEN risk_level IN ('CRITICAL', 'HIGH')"
_AT_RISK = "risk_level IN ('CRITICAL', 'HIGH')"
_ZONE = """CASE WHEN v IS NULL THEN NULL WHEN v < 23e-1 THEN 'A' WHEN v < 45e-1 THEN 'B'
 WHEN v <= 71e-1 THEN 'C' ELSE 'D' END"""
_SCORE = """CASE WHEN rated_max_vibration IS NULL THEN NULL ELSE
 greatest(0e0, least(100e0, 100e0 - vibration_mm_s / rated_max_vibration * 100e0)) END"""

_DUE = """
tasks(kind, task, part, tier, months) AS (VALUES
  ('MACHINERY', 'Bearing replacement', 'bearing', 1, 18), ('MACHINERY', 'Bearing replacement', 'bearing', 2, 36),
  ('MACHINERY', 'Bearing replacement', 'bearing', 3, 60), ('AUTOMOBILE', 'Seal replacement', 'shaft seal', NULL, 18),
  ('AUTOMOBILE', 'Belt replacement', 'belt', NULL, 19), ('HOUSEHOLD', 'Belt replacement', 'belt', NULL, 36),
  ('BUILDING', 'Seal replacement', 'shaft seal', NULL, 24), ('FURNITURE', 'Bearing replacement', 'bearing', NULL, 24)),
done AS (SELECT l.asset_id, t.part, max(l.timestamp) AS last_done
  FROM logs l JOIN (SELECT DISTINCT part FROM tasks) t ON l.part_replaced ILIKE concat('%', t.part, '%') GROUP BY ALL),
schedule AS (SELECT a.asset_id, a.asset_type, a.criticality_tier, t.task, CAST(d.last_done AS DATE) AS last_done,
    CAST(CAST(coalesce(d.last_done, a.installation_date) AS DATE) + to_months(t.months) AS DATE) AS due_date
  FROM assets a JOIN tasks t ON a.asset_type = t.kind AND (t.tier IS NULL OR t.tier = a.criticality_tier)
  LEFT JOIN done d ON d.asset_id = a.asset_id AND d.part = t.part),
due AS (SELECT * FROM schedule WHERE due_date <= (SELECT CAST(max(timestamp) AS DATE) + {days} FROM logs_raw))"""


def _due(days: int, body: str) -> str:
    head = _sql("logs assets", "")
    return head + ",\n" + _DUE.format(days=days).strip() + "\n" + body.strip()


def _vector_sql() -> str:
    queries = []
    for name, step in (("q1", 1), ("q2", 3), ("q3", 5)):
        values = ", ".join(str(((i * step) % 7 - 3) / 4.0) for i in range(64))
        queries.append(f"SELECT '{name}' AS query, CAST([{values}] AS DOUBLE[]) AS q")
    return f"""WITH qs AS ({' UNION ALL '.join(queries)}),
scored AS (SELECT query, vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS similarity
  FROM embeddings, qs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id) AS rank FROM scored)
SELECT vec_id, query, round(similarity, 6) AS similarity, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 5"""


_SERIAL = "row_number() OVER (ORDER BY o_orderkey % 1024, timestamp, o_orderkey)"

_SQL = {
    # quality gates
    "dq_expect_or_drop": _sql("assets", "SELECT asset_id, rated_max_vibration, rated_max_temp FROM assets"),
    "dq_expect_warn": _sql("readings", "SELECT event_id, temp_c FROM readings"),
    "dq_dropna": _sql("logs_raw", "SELECT work_order_id, part_replaced FROM logs_raw WHERE part_replaced IS NOT NULL"),
    "dq_report": _sql("assets_raw", """
SELECT 'valid_rated_max_vibration' AS expectation, 'drop' AS action,
  count(*) FILTER (WHERE rated_max_vibration > 0) AS passed,
  count(*) - count(*) FILTER (WHERE rated_max_vibration > 0) AS failed, count(*) AS total FROM assets_raw
UNION ALL SELECT 'valid_rated_max_temp', 'drop', count(*) FILTER (WHERE rated_max_temp > 0),
  count(*) - count(*) FILTER (WHERE rated_max_temp > 0), count(*) FROM assets_raw"""),
    "dq_range_sanity": _sql("readings", """
SELECT event_id, concat_ws(',',
  CASE WHEN coalesce(vibration_mm_s BETWEEN 5e-1 AND 200, FALSE) THEN NULL ELSE 'vibration_mm_s' END,
  CASE WHEN coalesce(temp_c BETWEEN 5 AND 95, FALSE) THEN NULL ELSE 'temp_c' END) AS out_of_range FROM readings"""),
    "ingest_typing": _sql("readings", """
SELECT event_id, CASE WHEN temp_c < 50 THEN timestamp END AS timestamp, temp_c FROM readings"""),
    "ingest_audit": "SELECT 'orders.parquet' AS source_file, count(*) AS stamped_rows FROM orders",
    # silver, filters, joins
    "anomaly_flags": _sql("silver", "SELECT event_id, vibration_anomaly_flag, temp_anomaly_flag FROM silver"),
    "silver_sensor": _sql("silver", "SELECT * FROM silver"),
    "silver_logs": _sql("logs", "SELECT * FROM logs"),
    "silver_assets": _sql("assets", "SELECT * FROM assets"),
    "risk_filter": _sql("health", f"SELECT asset_id, risk_level, health_score FROM health WHERE {_AT_RISK}"),
    "health_below": _sql("health", "SELECT asset_id, risk_level, health_score FROM health WHERE health_score < 60"),
    "critical_tier": _sql("assets", "SELECT asset_id, criticality_tier FROM assets WHERE criticality_tier = 1"),
    "by_source": _sql("readings", "SELECT * FROM readings WHERE data_source = 'error'"),
    "near_rating": _sql("health", """
SELECT asset_id, current_vibration, rated_max_vibration FROM health WHERE current_vibration > rated_max_vibration * 5e-1"""),
    "anomalous_assets": _sql("silver", """
SELECT asset_id, count(*) AS anomaly_count FROM silver WHERE vibration_anomaly_flag GROUP BY asset_id"""),
    "point_health": _sql("assets_raw health now_hour", """
SELECT a.asset_id, CASE WHEN h.asset_id IS NULL
  THEN CAST(to_json({'error': concat('Asset ''', a.asset_id, ''' not found in health database')}) AS VARCHAR)
  ELSE CAST(to_json({'asset_id': h.asset_id, 'health_score': h.health_score, 'risk_level': h.risk_level,
    'current_vibration': h.current_vibration, 'current_temp': h.current_temp,
    'rated_max_vibration': h.rated_max_vibration, 'estimated_rul_hours': h.estimated_rul_hours,
    'production_line_id': h.production_line_id, 'criticality_tier': h.criticality_tier,
    'last_updated': strftime(n.as_of, '%Y-%m-%d %H:%M:%S')}) AS VARCHAR) END AS health
FROM assets_raw a LEFT JOIN health h ON a.asset_id = h.asset_id, now_hour n"""),
    "join_sensor_meta": _sql("silver", """
SELECT event_id, timestamp, asset_id, vibration_mm_s, temp_c, rated_max_vibration, rated_max_temp, criticality_tier,
  production_line_id FROM silver"""),
    "join_logs_meta": _sql("logs", """
SELECT work_order_id, asset_id, asset_type, production_line_id, criticality_tier FROM logs"""),
    "join_latest_meta_trend": _sql("latest assets slopes", """
SELECT l.asset_id, l.hour_window, l.vibration_avg, l.temp_avg, a.rated_max_vibration, a.rated_max_temp,
  round(s.slope, 9) AS vibration_slope_per_sec
FROM latest l LEFT JOIN assets a ON l.asset_id = a.asset_id LEFT JOIN slopes s ON l.asset_id = s.asset_id"""),
    "join_cost": _sql("health repairs production", """
SELECT h.*, round(r.avg_cost_to_fix, 6) AS avg_cost_to_fix, round(r.avg_downtime_hours, 6) AS avg_downtime_hours,
  round(r.avg_labor_hours, 6) AS avg_labor_hours, round(r.first_time_fix_rate, 6) AS first_time_fix_rate,
  p.hourly_output_value_usd, p.active_hours_per_day
FROM health h LEFT JOIN repairs r ON h.asset_id = r.asset_id LEFT JOIN production p ON h.production_line_id = p.line_id"""),
    "join_sync": _sql("health cost", """
SELECT h.*, c.cost_to_fix_now, c.cost_of_unplanned_failure, c.net_recommendation
FROM health h LEFT JOIN cost c ON h.asset_id = c.asset_id"""),
    "anti_recent_alert": _sql("health alerts now_hour", f"""
SELECT asset_id, risk_level FROM health h WHERE {_AT_RISK} AND NOT EXISTS (
  SELECT 1 FROM alerts a WHERE a.asset_id = h.asset_id AND a.status = 'ACTIVE'
    AND a.detection_timestamp > (SELECT as_of - INTERVAL 72 HOUR FROM now_hour))"""),
    "lookup_insert": _sql("recs health", """
SELECT r.rec_id, r.asset_id, r.recommendation_text, h.health_score AS health_score_at_time
FROM recs r JOIN health h ON r.asset_id = h.asset_id"""),
    "band_lookup": _sql("readings", """
SELECT event_id,
  CASE WHEN vibration_mm_s > 85e-1 THEN 'Critical' WHEN vibration_mm_s > 65e-1 THEN 'Alarm'
    WHEN vibration_mm_s > 4e0 THEN 'Warning' WHEN vibration_mm_s >= 25e-1 THEN 'Watch'
    WHEN vibration_mm_s < 25e-1 THEN 'Normal' END AS alarm_level,
  CASE WHEN temp_c < 65e0 THEN 'Normal' WHEN temp_c <= 80e0 THEN 'Warning' WHEN temp_c > 85e0 THEN 'Alarm' END AS temp_alarm
FROM readings"""),
    "band_lookup_by_asset": _sql("readings", """
SELECT event_id, CASE WHEN v < a + (b - a) * 25e-2 THEN 'Quiet'
  WHEN v BETWEEN a + (b - a) * 25e-2 AND a + (b - a) * 5e-1 THEN 'Normal'
  WHEN v BETWEEN a + (b - a) * 625e-3 AND a + (b - a) * 75e-2 THEN 'Raised'
  WHEN v > a + (b - a) * 75e-2 THEN 'Extreme' END AS alarm_level
FROM (SELECT event_id, vibration_mm_s AS v, min(vibration_mm_s) OVER (PARTITION BY asset_id) AS a,
  max(vibration_mm_s) OVER (PARTITION BY asset_id) AS b FROM readings)"""),
    "signal_to_asset": _sql("assets", """
SELECT s.signal_id, s.severity, s.production_line_id, m.asset_id AS mapped_asset_id
FROM (SELECT event_id AS signal_id, value AS severity, concat('Line_', CAST(user_id % 25 AS VARCHAR)) AS production_line_id
      FROM events WHERE event_type = 'error') s
LEFT JOIN (SELECT production_line_id, asset_id, row_number() OVER (PARTITION BY production_line_id
      ORDER BY criticality_tier, asset_id) AS rn FROM assets) m
  ON m.production_line_id = s.production_line_id AND m.rn = 1"""),
    # aggregations
    "hourly_trends": _sql("trends", "SELECT * FROM trends"),
    "slope_by_type_line": _sql("trends assets now_hour", """
SELECT t.asset_id, CASE WHEN count(*) > 1 THEN round(regr_slope(vibration_avg, epoch(hour_window)), 9) END
  AS vibration_slope_per_sec
FROM trends t JOIN assets a ON t.asset_id = a.asset_id
WHERE a.asset_type = 'MACHINERY' AND a.production_line_id = 'Line_1'
  AND hour_window >= (SELECT as_of - INTERVAL 720 HOUR FROM now_hour) GROUP BY t.asset_id"""),
    "trend_slope": _sql("slopes", "SELECT asset_id, round(slope, 9) AS vibration_slope_per_sec FROM slopes"),
    "repair_averages": _sql("repairs", """
SELECT asset_id, round(avg_cost_to_fix, 6) AS avg_cost_to_fix, round(avg_downtime_hours, 6) AS avg_downtime_hours,
  round(avg_labor_hours, 6) AS avg_labor_hours, round(first_time_fix_rate, 6) AS first_time_fix_rate FROM repairs"""),
    "mtbf_simple": _sql("gaps", """
SELECT asset_id, round(avg(gap), 1) AS mtbf_days FROM gaps WHERE gap IS NOT NULL GROUP BY asset_id"""),
    "mtbf_by_asset": _sql("mtbf_rows", "SELECT * FROM mtbf_rows"),
    "ftf_by_asset": _sql("repairs", """
SELECT asset_id, round(coalesce(first_time_fix_rate, 0), 1) AS first_time_fix_rate_pct FROM repairs"""),
    "ftf_by_technician": _sql("logs", """
SELECT technician_id, count(*) AS total_jobs,
  round(CAST(sum(CASE WHEN first_time_fix THEN 1 ELSE 0 END) AS DOUBLE) * 100 / count(*), 1) AS first_time_fix_rate_pct,
  round(avg(labor_hours), 1) AS avg_labor_hours, round(avg(cost_to_fix), 0) AS avg_repair_cost
FROM logs GROUP BY technician_id"""),
    "ftf_by_technician_year": _sql("logs", """
SELECT technician_id, count(*) AS total_jobs,
  round(CAST(sum(CASE WHEN first_time_fix THEN 1 ELSE 0 END) AS DOUBLE) * 100 / count(*), 1) AS first_time_fix_rate_pct,
  round(avg(labor_hours), 1) AS avg_labor_hours, round(avg(cost_to_fix), 0) AS avg_repair_cost
FROM logs WHERE timestamp >= (SELECT CAST(max(timestamp) AS DATE) - INTERVAL 12 MONTH FROM logs_raw) GROUP BY technician_id"""),
    "ftf_14d": _sql("logs", """
SELECT asset_id, count(*) AS total_jobs,
  round(CAST(sum(CASE WHEN next_gap <= 14 THEN 0 ELSE 1 END) AS DOUBLE) * 100 / count(*), 1) AS ftf_rate_pct
FROM (SELECT *, date_diff('day', timestamp, lead(timestamp) OVER (PARTITION BY asset_id ORDER BY timestamp, o_orderkey))
  AS next_gap FROM logs) GROUP BY asset_id"""),
    "spend_by_asset": _sql("logs", """
SELECT asset_id, round(sum(cost_to_fix), 2) AS total_cost, count(*) AS work_orders FROM logs
WHERE timestamp >= (SELECT CAST(max(timestamp) AS DATE) - INTERVAL 24 MONTH FROM logs_raw) GROUP BY asset_id"""),
    "fleet_counts": _sql("health alerts", """
SELECT count(*) AS total_assets, count(*) FILTER (WHERE risk_level = 'CRITICAL') AS critical_count,
  count(*) FILTER (WHERE risk_level = 'HIGH') AS high_count, count(*) FILTER (WHERE risk_level = 'LOW') AS low_count,
  (SELECT count(*) FROM alerts WHERE status = 'ACTIVE') AS active_alerts FROM health"""),
    "line_exposure": _sql("cost", f"""
SELECT production_line_id, count(*) AS assets_at_risk, round(sum(cost_of_unplanned_failure), 2) AS exposure_usd,
  min(estimated_rul_hours) AS shortest_rul_hours FROM cost WHERE {_AT_RISK} GROUP BY production_line_id"""),
    "floor_map": _sql("health", """
SELECT production_line_id, asset_id, round(health_score, 0) AS health_score, risk_level, estimated_rul_hours FROM health"""),
    "cost_by_asset_avg": _sql("logs", """
SELECT asset_id, round(avg(cost_to_fix), 2) AS avg_repair_cost, count(*) AS work_orders FROM logs GROUP BY asset_id"""),
    "fleet_compare": _sql("gaps repairs", """
, figures AS (SELECT r.asset_id, g.n, g.m, r.avg_cost_to_fix AS c, r.first_time_fix_rate AS f FROM repairs r
  JOIN (SELECT asset_id, count(*) AS n, avg(gap) AS m FROM gaps GROUP BY asset_id) g ON r.asset_id = g.asset_id)
SELECT asset_id, n AS work_orders, round(m, 6) AS mtbf_days, round(c, 6) AS avg_cost, round(f, 6) AS ftf_pct,
  round(avg(n) OVER (), 6) AS fleet_work_orders, round(avg(m) OVER (), 6) AS fleet_mtbf_days,
  round(avg(c) OVER (), 6) AS fleet_avg_cost, round(avg(f) OVER (), 6) AS fleet_ftf_pct
FROM figures""").replace(")\n, figures", "),\nfigures"),
    "lookback_profile": _sql("trends now_hour", "SELECT asset_id, " + ", ".join(
        f"""round(avg(vibration_avg) FILTER (WHERE hour_window > as_of - INTERVAL {back + 24} HOUR
  AND hour_window <= as_of - INTERVAL {back} HOUR), 6) AS vibration_{name}"""
        for name, back in (("d7", 168), ("d3", 72), ("h48", 48), ("h24", 24), ("now", 0))
    ) + """ FROM trends, now_hour WHERE hour_window > as_of - INTERVAL 192 HOUR GROUP BY asset_id"""),
    "vib_rpm_corr": _sql("readings", """
SELECT asset_id, round(corr(vibration_mm_s, temp_c), 6) AS vibration_temp_c_corr, count(*) AS reading_count
FROM readings GROUP BY asset_id"""),
    "increase_48h": _sql("trends now_hour", """
SELECT asset_id, round(arg_max(vibration_avg, hour_window) - arg_min(vibration_avg, hour_window), 4) AS vibration_increase
FROM trends WHERE hour_window >= (SELECT as_of - INTERVAL 48 HOUR FROM now_hour) GROUP BY asset_id
ORDER BY vibration_increase DESC, asset_id LIMIT 10"""),
    # windows
    "rolling_vibration": _sql("smoothed", "SELECT event_id, round(vib5, 6) AS vibration_smoothed FROM smoothed"),
    "rolling_temp": _sql("smoothed", "SELECT event_id, round(temp5, 6) AS temp_smoothed FROM smoothed"),
    "latest_per_asset": _sql("latest", "SELECT * FROM latest"),
    "days_since_prev": _sql("gaps", "SELECT work_order_id, asset_id, CAST(gap AS INT) AS days_since_prev_failure FROM gaps"),
    "recent_n": _sql("logs", """
SELECT asset_id, work_order_id, timestamp FROM (SELECT *, row_number() OVER (PARTITION BY asset_id
  ORDER BY timestamp DESC, o_orderkey DESC) AS rn FROM logs) WHERE rn <= 5"""),
    "maintenance_history": _sql("gaps", """
SELECT asset_id, work_order_id, timestamp, fault_type, part_replaced, cost_to_fix, first_time_fix, downtime_hours,
  CAST(gap AS DOUBLE) AS days_since_prev_failure
FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY timestamp DESC, o_orderkey DESC) AS rn FROM gaps)
WHERE rn <= 5"""),
    "ewma": _sql("readings", "SELECT event_id, round((" + " + ".join(
        f"coalesce(lag(vibration_mm_s, {i}) OVER w * {0.7 ** i!r}e0, 0e0)" for i in range(5)
    ) + ") / (" + " + ".join(
        f"CASE WHEN lag(vibration_mm_s, {i}) OVER w IS NULL THEN 0e0 ELSE {0.7 ** i!r}e0 END" for i in range(5)
    ) + f"), 6) AS ewma FROM readings WINDOW w AS ({ORDERED})"),
    "rolling_median": _sql("readings", f"""
SELECT event_id, round(median(vibration_mm_s) OVER ({ORDERED} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6)
  AS rolling_median FROM readings"""),
    "rolling_median_long": _sql("readings", f"""
SELECT event_id, round(median(vibration_mm_s) OVER ({ORDERED} ROWS BETWEEN 1000 PRECEDING AND CURRENT ROW), 6)
  AS rolling_median FROM readings"""),
    "rolling_median_long_sliced": _sql("readings", f"""
SELECT event_id, round(median(vibration_mm_s) OVER ({ORDERED} ROWS BETWEEN 100 PRECEDING AND CURRENT ROW), 6)
  AS rolling_median FROM readings"""),
    "clip_outliers": _sql("readings", f"""
SELECT event_id, round(CASE WHEN v > m + 2 * s THEN m + 2 * s WHEN v < m - 2 * s THEN m - 2 * s ELSE v END, 6) AS clipped
FROM (SELECT event_id, vibration_mm_s AS v, avg(vibration_mm_s) OVER w AS m, stddev_samp(vibration_mm_s) OVER w AS s
  FROM readings WINDOW w AS ({ORDERED} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))"""),
    "sustained_over": _sql("readings", "SELECT * FROM (" + _runs(
        "readings", "temp_c > 50", "temp_c", "timestamp", "timestamp, event_id"
    ) + ") WHERE date_trunc('second', run_end) - date_trunc('second', run_start) > INTERVAL 30 MINUTE"),
    "consecutive_over": _sql("silver", "SELECT * FROM (" + _runs(
        "silver", "temp_c > rated_max_temp * 8e-1", "temp_c", "timestamp", "timestamp, event_id"
    ) + ") WHERE run_length > 2"),
    "rising_pct": _sql("trends", "SELECT * REPLACE (round(peak_value, 6) AS peak_value) FROM (" + _runs(
        """(SELECT *, (vibration_avg - lag(vibration_avg) OVER w) / nullif(lag(vibration_avg) OVER w, 0) * 100 AS growth
 FROM trends WINDOW w AS (PARTITION BY asset_id ORDER BY hour_window))""",
        "growth > 5", "growth", "hour_window", "hour_window",
    ) + ") WHERE run_length >= 3"),
    "thermal_spike": _sql("silver", "SELECT * FROM (" + _runs(
        f"""(SELECT *, median(temp_c) OVER ({ORDERED} ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS base FROM silver)""",
        "temp_c - base > 15 AND temp_c - base <= 25 AND NOT vibration_anomaly_flag", "temp_c", "timestamp", "timestamp, event_id",
    ) + ") WHERE run_length BETWEEN 2 AND 3"),
    "rising_2pct": _sql("trends", "SELECT * REPLACE (round(peak_value, 6) AS peak_value) FROM (" + _runs(
        """(SELECT *, (vibration_avg - lag(vibration_avg) OVER w) / nullif(lag(vibration_avg) OVER w, 0) * 100 AS growth
 FROM trends WINDOW w AS (PARTITION BY asset_id ORDER BY hour_window))""",
        "growth > 2", "growth", "hour_window", "hour_window",
    ) + ") WHERE run_length >= 2"),
    "thermal_rate": _sql("silver", "SELECT * FROM (" + _runs(
        f"""(SELECT *, median(temp_c) OVER ({ORDERED} ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS base,
    (temp_c - lag(temp_c) OVER ({ORDERED})) * 3600 / nullif(floor(epoch(timestamp)) - floor(epoch(lag(timestamp) OVER ({ORDERED}))), 0) AS rate FROM silver)""",
        "temp_c - base > 15 AND temp_c - base <= 25 AND NOT vibration_anomaly_flag AND rate > 10", "temp_c", "timestamp", "timestamp, event_id",
    ) + ") WHERE run_length BETWEEN 1 AND 3"),
    # sorts and limits
    "health_board": _sql("health", """
SELECT asset_id, production_line_id, criticality_tier, round(health_score, 1) AS health_score, risk_level,
  round(current_vibration, 3) AS vibration_mm_s, round(estimated_rul_hours, 1) AS rul_hours, calculated_at FROM health"""),
    "trend_recent": _sql("trends now_hour", """
SELECT asset_id, hour_window, round(vibration_avg, 3) AS vibration_avg, round(vibration_max, 3) AS vibration_max,
  anomaly_count, production_line_id FROM trends
WHERE hour_window >= (SELECT as_of - INTERVAL 48 HOUR FROM now_hour)"""),
    "trend_recent_7d": _sql("trends now_hour", """
SELECT asset_id, hour_window, round(vibration_avg, 3) AS vibration_avg, round(vibration_max, 3) AS vibration_max,
  anomaly_count, production_line_id FROM trends
WHERE hour_window >= (SELECT as_of - INTERVAL 168 HOUR FROM now_hour)"""),
    "cost_summary": _sql("cost", f"""
SELECT asset_id, production_line_id, risk_level, round(estimated_rul_hours, 1) AS rul_hours,
  round(cost_to_fix_now, 0) AS cost_to_fix_usd, round(cost_of_unplanned_failure, 0) AS cost_if_fails_usd,
  round(cost_of_unplanned_failure - cost_to_fix_now, 0) AS savings_by_fixing_now, net_recommendation
FROM cost WHERE {_AT_RISK}"""),
    "cost_compare_inline": _sql("cost", f"""
SELECT asset_id, production_line_id, round(cost_to_fix_now, 0) AS planned_repair_cost,
  round(cost_of_unplanned_failure, 0) AS unplanned_failure_cost, net_recommendation FROM cost WHERE {_AT_RISK}"""),
    "top_patterns": _sql("logs", f"""
SELECT {_PATTERN} FROM logs WHERE fault_type ILIKE '%bearing%' OR fault_type ILIKE '%vibrat%'
ORDER BY cost_to_fix DESC, work_order_id LIMIT 5"""),
    "top_chunks": _sql("chunks", "SELECT * FROM chunks ORDER BY score DESC, chunk_id LIMIT 5"),
    "active_alerts": _sql("alerts", """
SELECT disruption_id, asset_id, risk_level, impacted_line_id, detection_timestamp, estimated_rul_hours,
  estimated_downtime_cost, recommended_action, status FROM alerts WHERE status = 'ACTIVE'
ORDER BY CASE risk_level WHEN 'CRITICAL' THEN 1 ELSE 2 END, detection_timestamp DESC, disruption_id LIMIT 10"""),
    "recent_recs": _sql("recs", """
SELECT rec_id, asset_id, recommendation_text, cost_to_fix, cost_of_downtime, urgency_hours, net_recommendation, created_at
FROM recs ORDER BY created_at DESC, rec_id DESC LIMIT 5"""),
    # formulas
    "health_score": _sql("silver", f"SELECT event_id, round({_SCORE}, 2) AS health_score FROM silver"),
    "risk_level": _sql("silver", f"""
SELECT event_id, CASE WHEN s IS NULL THEN 'UNKNOWN' WHEN s < 30 THEN 'CRITICAL' WHEN s < 60 THEN 'HIGH'
  WHEN s < 80 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM (SELECT event_id, {_SCORE} AS s FROM silver)"""),
    "rul_hours": _sql("silver", """
SELECT event_id, CASE WHEN temp_c > 50 AND rated_max_vibration IS NOT NULL THEN round(greatest(0e0,
  (rated_max_vibration - vibration_mm_s) / ((temp_c - 50) / 1e6 * 3600e0)), 1) END AS estimated_rul_hours FROM silver"""),
    "gold_health": _sql("health", "SELECT * FROM health"),
    "gold_health_compat": _sql("latest assets trends now_hour", """
SELECT l.asset_id, l.hour_window AS calculated_at, l.production_line_id, l.criticality_tier,
  l.vibration_avg AS current_vibration, l.temp_avg AS current_temp, a.rated_max_vibration,
  round(greatest(0e0, least(100e0, 100e0 - l.vibration_avg / a.rated_max_vibration * 100e0)), 2) AS health_score,
  CASE WHEN greatest(0e0, least(100e0, 100e0 - l.vibration_avg / a.rated_max_vibration * 100e0)) < 30 THEN 'CRITICAL'
    WHEN greatest(0e0, least(100e0, 100e0 - l.vibration_avg / a.rated_max_vibration * 100e0)) < 60 THEN 'HIGH'
    WHEN greatest(0e0, least(100e0, 100e0 - l.vibration_avg / a.rated_max_vibration * 100e0)) < 80 THEN 'MEDIUM'
    ELSE 'LOW' END AS risk_level,
  CASE WHEN s.slope > 0 THEN round(greatest(0e0, (a.rated_max_vibration - l.vibration_avg) / (s.slope * 3600e0)), 1)
    END AS estimated_rul_hours
FROM latest l LEFT JOIN assets a ON l.asset_id = a.asset_id LEFT JOIN (
  SELECT asset_id, CASE WHEN count(*) > 1 THEN regr_slope(vibration_avg, epoch(hour_window)) END AS slope FROM trends
  WHERE hour_window >= (SELECT date_trunc('day', as_of - INTERVAL 48 HOUR) FROM now_hour) GROUP BY asset_id) s
  ON l.asset_id = s.asset_id"""),
    "unplanned_cost": _sql("cost", "SELECT asset_id, cost_of_unplanned_failure FROM cost"),
    "net_recommendation": _sql("cost", "SELECT asset_id, net_recommendation FROM cost"),
    "gold_cost": _sql("cost", """
SELECT * REPLACE (round(avg_cost_to_fix, 6) AS avg_cost_to_fix, round(avg_downtime_hours, 6) AS avg_downtime_hours) FROM cost"""),
    "planned_vs_unplanned": _sql("cost", """
SELECT asset_id, production_line_id, round(85 * 4e0 + 6e-1 * avg_cost_to_fix, 2) AS cost_to_fix_planned,
  round(cost_of_unplanned_failure, 2) AS cost_of_unplanned_failure,
  round(cost_of_unplanned_failure - (85 * 4e0 + 6e-1 * avg_cost_to_fix), 2) AS savings_by_acting_now,
  estimated_rul_hours, net_recommendation FROM cost"""),
    "cost_requests": _sql("cost logs", """
SELECT asset_id, hours, production_line_id, round(85 * hours + 6e-1 * avg_cost_to_fix, 2) AS cost_to_fix_planned,
  round(cost_of_unplanned_failure, 2) AS cost_of_unplanned_failure,
  round(cost_of_unplanned_failure - (85 * hours + 6e-1 * avg_cost_to_fix), 2) AS savings_by_acting_now,
  estimated_rul_hours, net_recommendation
FROM cost JOIN (SELECT DISTINCT asset_id, unnest([25e-1, 12e0]) AS hours FROM logs) USING (asset_id)"""),
    "alert_downtime_cost": _sql("cost", """
SELECT asset_id, round(coalesce(estimated_rul_hours, 0) * coalesce(cost_of_unplanned_failure, 0), 2)
  AS estimated_downtime_cost FROM cost"""),
    "dash_cost_table": _sql("health production", f"""
SELECT asset_id, production_line_id, round(health_score, 0) AS health_score, coalesce(estimated_rul_hours, 0e0) AS rul_hours,
  3200e0 AS plan_now_usd,
  round(coalesce(estimated_rul_hours, 0e0) * hourly_output_value_usd + 4800e0, 0) AS unplanned_cost_usd,
  risk_level AS action FROM health h LEFT JOIN production p ON h.production_line_id = p.line_id WHERE {_AT_RISK}"""),
    "outage_cost_manual": _sql("cost", """
SELECT asset_id, round(hourly_output_value_usd * 8e0 + avg_cost_to_fix * 15e-1, 2) AS unplanned_cost,
  round(hourly_output_value_usd * 4e0 + avg_cost_to_fix, 2) AS planned_cost, round(avg_cost_to_fix, 2) AS off_shift_cost
FROM cost"""),
    "expected_shutdown_cost": _sql("cost", """
SELECT asset_id, risk_level, round(p, 4) AS failure_probability,
  round(p * hourly_output_value_usd * avg_downtime_hours, 2) AS expected_shutdown_cost
FROM (SELECT *, CASE WHEN estimated_rul_hours IS NULL THEN 0e0 WHEN estimated_rul_hours <= 72 THEN 1e0
  ELSE 72e0 / estimated_rul_hours END AS p FROM cost)"""),
    "iso_zone": _sql("readings", f"SELECT event_id, {_ZONE} AS iso_zone FROM (SELECT event_id, vibration_mm_s AS v FROM readings)"),
    "stop_conditions": _sql("silver health", """
SELECT event_id, asset_id, rule_type, vibration_mm_s, rated_max_vibration FROM (
  SELECT s.*, h.health_score, CASE s.asset_type WHEN 'MACHINERY' THEN 'Motor' WHEN 'AUTOMOBILE' THEN 'Pump'
    WHEN 'BUILDING' THEN 'Compressor' WHEN 'FURNITURE' THEN 'Turbine' ELSE s.asset_type END AS rule_type
  FROM silver s LEFT JOIN health h ON s.asset_id = h.asset_id)
WHERE (rule_type = 'Motor' AND criticality_tier = 1 AND (vibration_mm_s > rated_max_vibration OR health_score < 20))
  OR (rule_type = 'Motor' AND criticality_tier > 1 AND vibration_mm_s > rated_max_vibration * 105e-2)
  OR (rule_type = 'Pump' AND vibration_mm_s > rated_max_vibration AND temp_c > rated_max_temp * 75e-2)
  OR (rule_type = 'Compressor' AND vibration_mm_s > rated_max_vibration * 9e-1)
  OR (rule_type = 'Turbine' AND vibration_mm_s > rated_max_vibration)"""),
    "restart_gate": _sql("health alerts", """
SELECT asset_id, health_score FROM health h WHERE health_score > 50
  AND NOT EXISTS (SELECT 1 FROM alerts a WHERE a.asset_id = h.asset_id AND a.status = 'ACTIVE')"""),
    "pm_due": _due(90, "SELECT * FROM due"),
    "pm_combine": _due(365, """
SELECT asset_id, job, min(due_date) AS first_due, max(due_date) AS last_due, count(*) AS task_count,
  string_agg(task, ', ' ORDER BY task) AS tasks
FROM (SELECT *, sum(CASE WHEN gap <= 30 THEN 0 ELSE 1 END) OVER (PARTITION BY asset_id ORDER BY due_date, task
    ROWS UNBOUNDED PRECEDING)::BIGINT AS job
  FROM (SELECT *, date_diff('day', lag(due_date) OVER (PARTITION BY asset_id ORDER BY due_date, task), due_date) AS gap
    FROM due)) GROUP BY asset_id, job"""),
    "mtbf_target": _sql("mtbf_rows", """
SELECT asset_id, asset_type, mtbf_days, target_days FROM mtbf_rows JOIN (VALUES ('MACHINERY', 250e0),
  ('AUTOMOBILE', 200e0), ('BUILDING', 300e0)) t(kind, target_days) ON asset_type = kind WHERE mtbf_days < target_days"""),
    # search and text
    "chunk_markdown": _sql("chunks", "SELECT * FROM chunks"),
    "chunk_headings": """
WITH marked AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x:
    CASE WHEN length(x) BETWEEN 1 AND 60 THEN concat('## ', x) ELSE x END) AS rows FROM documents),
cut AS (SELECT doc_id, string_split(array_to_string(list_transform(rows, lambda x, i:
    CASE WHEN i > 1 AND x LIKE '## %' THEN concat(chr(1), x) WHEN i > 1 THEN concat(chr(10), x) ELSE x END), ''), chr(1)) AS parts FROM marked)
SELECT concat('doc', CAST(doc_id AS VARCHAR), '_', CAST(i - 1 AS VARCHAR)) AS chunk_id,
  concat('doc', CAST(doc_id AS VARCHAR)) AS manual_name,
  CASE WHEN regexp_matches(content, '^#{1,2}\\s+.*\\S') THEN regexp_extract(content, '^#{1,2}\\s+(.*\\S)', 1)
    ELSE concat('section_', CAST(i - 1 AS VARCHAR)) END AS section,
  content, 1e0 AS score
FROM (SELECT doc_id, unnest(parts) AS content, generate_subscripts(parts, 1) AS i FROM cut)""",
    "search_manuals": _sql("chunks", "SELECT * REPLACE (CAST(rank AS INT) AS rank) FROM (" + _search_rows(
        "chunks", _CHUNK_MATCH, ["license", "the ", "contact", "100%"], "score DESC, chunk_id") + ") WHERE rank <= 5"),
    "search_failure_patterns": _sql("logs", f"SELECT query, CAST(rank AS INT) AS rank, {_PATTERN} FROM (" + _search_rows(
        "logs", _FAULT_MATCH, ["overheat", "SEAL", "belt"], "cost_to_fix DESC, work_order_id") + ") WHERE rank <= 5"),
    "vector_top_k": _vector_sql(),
    "vector_top_k_table": """
SELECT query, vec_id, round(similarity, 6) AS similarity, CAST(n AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id) AS n FROM (
    SELECT CAST(q.vec_id AS VARCHAR) AS query, v.vec_id,
      round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 9) AS similarity
    FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0)) WHERE n <= 5""",
    "provenance_explode": _sql("recs chunks", """
SELECT r.rec_id, r.asset_id, r.chunk_id, c.manual_name, c.section, c.content
FROM (SELECT rec_id, asset_id, unnest(vector_search_sources) AS chunk_id FROM recs) r
LEFT JOIN chunks c ON r.chunk_id = c.chunk_id"""),
    "search_manuals_table": _sql("chunks", f"""
, q AS (SELECT DISTINCT query FROM (SELECT substring(text, 5, 9) AS query FROM documents WHERE doc_id % 50 = 0 UNION ALL {_QUERY_LIST}) WHERE query <> '')
SELECT * EXCLUDE (n), CAST(n AS INT) AS rank FROM (SELECT chunks.*, query, row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk_id) AS n
  FROM q JOIN chunks ON {_CHUNK_MATCH.replace("?", "concat('%', query, '%')")}) WHERE n <= 5""").replace(")\n, q AS", "),\nq AS"),
    "search_failure_patterns_table": _sql("logs", f"""
, q AS (SELECT DISTINCT query FROM (SELECT substring(text, 5, 2) AS query FROM documents WHERE doc_id % 50 = 0 UNION ALL {_QUERY_LIST}) WHERE query <> '')
SELECT query, CAST(n AS INT) AS rank, {_PATTERN} FROM (SELECT logs.*, query, row_number() OVER (PARTITION BY query ORDER BY cost_to_fix DESC, work_order_id) AS n
  FROM q JOIN logs ON {_FAULT_MATCH.replace("?", "concat('%', query, '%')")}) WHERE n <= 5""").replace(")\n, q AS", "),\nq AS"),
    "pm_due_own_intervals": _due(90, "SELECT * FROM due").replace("to_months(t.months)", """to_months(CASE WHEN t.task = 'Bearing replacement' AND a.asset_type = 'MACHINERY'
      AND CAST(split_part(a.asset_id, '_', 2) AS INT) % 5 = 0 THEN CAST(split_part(a.asset_id, '_', 2) AS INT) % 7 + 6 ELSE t.months END)"""),
    "chat_requests": """
SELECT conv_id, count(*) AS message_count, string_agg(concat(coalesce(role, ''), ': ', coalesce(text, '')), chr(10) ORDER BY turn) AS messages,
  arg_max(text, turn) AS last_reply FROM conversations GROUP BY conv_id""",
    "chat_last_replies": """
SELECT conv_id, count(*) AS message_count, arg_max(role, turn) AS last_role, arg_max(text, turn) AS last_reply
FROM conversations GROUP BY conv_id""",
    "asset_dossier": _sql("cost logs chunks", f"""
, rec AS (SELECT asset_id, string_agg(work_order_id, ',' ORDER BY rn) AS recent_orders,
    max(CASE WHEN rn = 1 THEN fault_type END) AS last_fault
  FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY timestamp DESC, o_orderkey DESC) AS rn FROM logs)
  WHERE rn <= 3 GROUP BY asset_id),
q AS (SELECT DISTINCT last_fault AS query, CASE last_fault WHEN 'Seal leak' THEN 'license' WHEN 'Overheating' THEN 'the '
  ELSE last_fault END AS term FROM rec),
pats AS (SELECT query, work_order_id, row_number() OVER (PARTITION BY query ORDER BY cost_to_fix DESC, work_order_id) AS rank
  FROM q JOIN logs ON {_FAULT_MATCH.replace("?", "concat('%', query, '%')")}),
similar_rows AS (SELECT query, string_agg(work_order_id, ',' ORDER BY rank) AS similar_failures FROM pats
  WHERE rank <= 3 GROUP BY query),
hits AS (SELECT query, chunk_id, row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk_id) AS rank
  FROM q JOIN chunks ON {_CHUNK_MATCH.replace("?", "concat('%', term, '%')")}),
mans AS (SELECT query, string_agg(chunk_id, ',' ORDER BY rank) AS manual_chunks FROM hits WHERE rank <= 3 GROUP BY query)
SELECT c.asset_id, c.production_line_id, c.health_score, c.risk_level, c.estimated_rul_hours, c.cost_to_fix_now,
  c.cost_of_unplanned_failure, c.net_recommendation, r.recent_orders, r.last_fault, s.similar_failures, m.manual_chunks
FROM cost c LEFT JOIN rec r ON c.asset_id = r.asset_id LEFT JOIN similar_rows s ON s.query = r.last_fault
LEFT JOIN mans m ON m.query = r.last_fault
WHERE {_AT_RISK}""").replace(")\n, rec", "),\nrec"),
    # serving
    "sink_upsert_health": _sql("assets health now_hour", """
SELECT asset_id, health_score, risk_level, current_vibration, current_temp, rated_max_vibration, estimated_rul_hours,
  production_line_id, criticality_tier, calculated_at, as_of AS last_updated FROM health, now_hour
UNION ALL
SELECT asset_id, 100e0, 'LOW', 0e0, 0e0, rated_max_vibration, NULL, production_line_id, criticality_tier, as_of, as_of
FROM assets, now_hour WHERE asset_id NOT IN (SELECT asset_id FROM health)"""),
    "sink_insert_disruption": _sql("cost alerts now_hour", f"""
SELECT asset_id, asset_id AS machine_id, risk_level, production_line_id AS impacted_line_id,
  as_of AS detection_timestamp, estimated_rul_hours,
  round(coalesce(estimated_rul_hours, 0) * coalesce(cost_of_unplanned_failure, 0), 2) AS estimated_downtime_cost,
  net_recommendation AS recommended_action, 'ACTIVE' AS status, CAST(NULL AS TIMESTAMP) AS resolved_at,
  CAST(NULL AS VARCHAR) AS resolved_by
FROM cost c, now_hour WHERE {_AT_RISK} AND NOT EXISTS (SELECT 1 FROM alerts a WHERE a.asset_id = c.asset_id
  AND a.status = 'ACTIVE' AND a.detection_timestamp > as_of - INTERVAL 72 HOUR)"""),
    "alert_status": _sql("alerts health now_hour", f"""
SELECT disruption_id, a.asset_id,
  CASE WHEN status <> 'ACTIVE' THEN status WHEN {_AT_RISK.replace('risk_level', 'h.risk_level')} THEN 'ACKNOWLEDGED'
    ELSE 'RESOLVED' END AS status,
  CASE WHEN status = 'ACTIVE' AND h.risk_level NOT IN ('CRITICAL', 'HIGH') THEN as_of ELSE resolved_at END AS resolved_at,
  CASE WHEN status = 'ACTIVE' AND h.risk_level NOT IN ('CRITICAL', 'HIGH') THEN 'auto' ELSE resolved_by END AS resolved_by
FROM alerts a JOIN health h ON a.asset_id = h.asset_id, now_hour"""),
    "serial_ids": _sql("logs_raw", f"""
SELECT {_SERIAL} AS rec_id, work_order_id, printf('REC-%05d', {_SERIAL}) AS label FROM logs_raw"""),
    "sink_recommendation": _sql("recs health", """
SELECT id AS rec_id, asset_id, recommendation_text, cost_to_fix, cost_of_downtime, urgency_hours, net_recommendation,
  array_to_string(vector_search_sources, ',') AS sources, health_score AS health_score_at_time, 's1' AS created_by_session,
  concat('Recommendation REC-', lpad(CAST(id AS VARCHAR), CAST(greatest(5, length(CAST(id AS VARCHAR))) AS INT), '0'), ' saved for ', asset_id) AS message
FROM (SELECT r.*, h.health_score, row_number() OVER (ORDER BY r.rec_id % 1024, r.rec_id) AS id
  FROM recs r JOIN health h ON r.asset_id = h.asset_id)"""),
    "risk_entries": _sql("trends assets", """
SELECT asset_id, calculated_at, risk_level, previous_risk FROM (
  SELECT *, lag(risk_level) OVER (PARTITION BY asset_id ORDER BY calculated_at) AS previous_risk FROM (
    SELECT asset_id, calculated_at, CASE WHEN s IS NULL THEN 'UNKNOWN' WHEN s < 30 THEN 'CRITICAL' WHEN s < 60 THEN 'HIGH'
      WHEN s < 80 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level
    FROM (SELECT t.asset_id, t.hour_window AS calculated_at, CASE WHEN a.rated_max_vibration IS NULL THEN NULL ELSE
        greatest(0e0, least(100e0, 100e0 - t.vibration_avg / a.rated_max_vibration * 100e0)) END AS s
      FROM trends t LEFT JOIN assets a ON t.asset_id = a.asset_id)))
WHERE risk_level IN ('CRITICAL', 'HIGH') AND previous_risk IS DISTINCT FROM risk_level"""),
}

_SQL |= {
    # sources
    "src_sensor_stream": _sql("readings", """
SELECT timestamp, asset_id, vibration_mm_s, temp_c, data_source FROM readings"""),
    "src_logs_stream": _sql("logs_raw", "SELECT * EXCLUDE (o_orderkey) FROM logs_raw"),
    "src_asset_metadata": _sql("assets_raw", "SELECT * FROM assets_raw"),
    "src_production_output": _sql("production", "SELECT * FROM production"),
    # streams and written tables
    "stream_bronze_silver": _SQL["silver_sensor"],
    "stream_silver_logs": _SQL["silver_logs"],
    "sink_stream_append": _sql("readings", "SELECT * FROM readings"),
    "stream_watermark_dedup": _sql("readings", "SELECT * FROM readings"),
    "stream_hourly": _sql("silver", """
SELECT date_trunc('hour', timestamp) AS hour_window, asset_id, count(*) AS reading_count,
  max(vibration_mm_s) AS vibration_max,
  CAST(sum(CASE WHEN vibration_anomaly_flag THEN 1 ELSE 0 END) AS BIGINT) AS anomaly_count FROM silver
GROUP BY ALL"""),
    "sync_acknowledge_sync": _sql("health", f"""
SELECT asset_id, s.status, s.detection_timestamp FROM health, (VALUES
  ('ACKNOWLEDGED', TIMESTAMP '2024-02-01 00:00:00'), ('ACTIVE', TIMESTAMP '2024-02-02 00:00:00')) s(status, detection_timestamp)
WHERE {_AT_RISK}"""),
    "sync_reset_sync": _sql("health", f"""
SELECT asset_id, 'ACTIVE' AS status, TIMESTAMP '2024-02-02 00:00:00' AS detection_timestamp FROM health WHERE {_AT_RISK}"""),
    "hourly_trends_sliced": _SQL["hourly_trends"],
    "rolling_vibration_sliced": _SQL["rolling_vibration"],
    "consecutive_over_sliced": _SQL["consecutive_over"],
    "thermal_spike_sliced": _SQL["thermal_spike"],
    "days_since_prev_sliced": _SQL["days_since_prev"],
    "stream_rolling5": _SQL["rolling_vibration"],
    "stream_sync": _sql("health", f"""
SELECT asset_id, health_score, risk_level, estimated_rul_hours, TIMESTAMP '2024-02-01 00:00:00' AS last_updated,
  CASE WHEN {_AT_RISK} THEN 'ACTIVE' END AS status, {_AT_RISK} AS alerted FROM health"""),
    "reset_serving": _sql("health recs", f"""
SELECT *, CASE WHEN table_name = 'live' THEN rows_before ELSE 0 END AS rows_after FROM (
  SELECT table_name, asset_id, what, count(*) AS rows_before FROM (
    SELECT 'live' AS table_name, asset_id, CAST(NULL AS VARCHAR) AS what FROM health
    UNION ALL SELECT 'alerts', asset_id, risk_level FROM health WHERE {_AT_RISK}
    UNION ALL SELECT 'recommendations', recs.asset_id, recommendation_text FROM recs JOIN health ON recs.asset_id = health.asset_id)
  GROUP BY ALL)"""),
    "hourly_trends_incremental": _SQL["hourly_trends"],
    "stream_transitions": _SQL["risk_entries"],
    "sink_upsert_keyed": _SQL["sink_upsert_health"],
    "sink_upsert_keyed_1pct": _sql("assets health now_hour", """
SELECT asset_id, health_score, risk_level, current_vibration, current_temp, rated_max_vibration, estimated_rul_hours,
  production_line_id, criticality_tier, calculated_at, as_of AS last_updated FROM health, now_hour
WHERE CAST(split_part(asset_id, '_', 2) AS BIGINT) % 100 = 0
UNION ALL
SELECT asset_id, 100e0, 'LOW', 0e0, 0e0, rated_max_vibration, NULL, production_line_id, criticality_tier, as_of, as_of
FROM assets, now_hour WHERE asset_id NOT IN (SELECT asset_id FROM health WHERE CAST(split_part(asset_id, '_', 2) AS BIGINT) % 100 = 0)"""),
    "hourly_trends_since": _sql("trends now_hour", """
SELECT * FROM trends WHERE hour_window >= (SELECT as_of - INTERVAL 7 DAY FROM now_hour)"""),
    "sink_materialize": _SQL["hourly_trends"],
    # SQL functions
    "fn_get_asset_health": _SQL["point_health"],
    "fn_calculate_cost_impact": _SQL["planned_vs_unplanned"],
    "fn_get_maintenance_history": _SQL["maintenance_history"],
    "fn_search_failure_patterns": _sql("logs", f"""
SELECT {_PATTERN} FROM logs WHERE {_FAULT_MATCH.replace("?", "'%overheat%'")}
ORDER BY cost_to_fix DESC, work_order_id LIMIT 5"""),
    "fn_search_manuals": _sql("chunks", f"""
SELECT * FROM chunks WHERE {_CHUNK_MATCH.replace("?", "'%license%'")} ORDER BY score DESC, chunk_id LIMIT 5"""),
}

ORACLE_SQL = {key: half_up(sql) for key, sql in _SQL.items()}
