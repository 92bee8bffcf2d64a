"""Every operator as a query over the bound test tables: key -> (spark, folder) -> DataFrame."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rotorwatch import schemas as S
from rotorwatch.functions import costs, scores
from rotorwatch.operators import (
    enrich, history, ingest, maintenance, quality, runs, search, serving, smoothing, text_index, trends, vector_search,
)
from rotorwatch.functions.catalog import register_functions
from rotorwatch.plans import dossier, gold, reports
from rotorwatch.session import scratch_dir, written
from rotorwatch.sources import files
from rotorwatch.sources.bindings import LOG_ORDER, READING_ORDER, Tables, bind_readings
from rotorwatch.sources.hourly_table import HourlyTable
from rotorwatch.sources.serving_log import KeyedTable, ServingLog
from rotorwatch.sources.snapshots import materialize
from rotorwatch.streaming import jobs, state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

SEARCH_TERMS = ["license", "the ", "contact", "100%"]
FAULT_TERMS = ["overheat", "SEAL", "belt"]
# interval rules for the asset types of the test tables
TEST_INTERVALS = (
    ("MACHINERY", "Bearing replacement", "bearing", 1, 18),
    ("MACHINERY", "Bearing replacement", "bearing", 2, 36),
    ("MACHINERY", "Bearing replacement", "bearing", 3, 60),
    ("AUTOMOBILE", "Seal replacement", "shaft seal", None, 18),
    ("AUTOMOBILE", "Belt replacement", "belt", None, 19),
    ("HOUSEHOLD", "Belt replacement", "belt", None, 36),
    ("BUILDING", "Seal replacement", "shaft seal", None, 24),
    ("FURNITURE", "Bearing replacement", "bearing", None, 24),
)
# which stop rule each asset type of the test tables follows
TEST_RULE_TYPES = {"MACHINERY": "Motor", "AUTOMOBILE": "Pump", "BUILDING": "Compressor",
                   "FURNITURE": "Turbine"}
QUERY_VECTORS = {
    name: [((i * step) % 7 - 3) / 4.0 for i in range(64)] for name, step in (("q1", 1), ("q2", 3), ("q3", 5))
}


def query(build):
    """Register ``build(tables)`` under its name."""
    QUERIES[build.__name__] = lambda spark, folder: build(Tables(spark, folder))
    return build


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _last_order(t: Tables) -> Column:
    return t.logs_raw().agg(F.max("timestamp")).scalar()


_BARE_SILVER = ["event_id", "timestamp", "asset_id", "vibration_mm_s", "temp_c"]
_SMOOTH = {"order": READING_ORDER}


# -- quality gates -------------------------------------------------------------


@query
def dq_expect_or_drop(t):
    gates = t.assets_raw()
    for name, (predicate, _) in quality.ASSET_RULES.items():
        gates = quality.expect_or_drop(gates, name, predicate)
    return gates.select("asset_id", "rated_max_vibration", "rated_max_temp")


@query
def dq_expect_warn(t):
    return quality.expect(t.readings(), "warm_enough", "temp_c > 0").select("event_id", "temp_c")


@query
def dq_dropna(t):
    return quality.drop_missing(t.logs_raw(), "part_replaced").select("work_order_id", "part_replaced")


@query
def dq_report(t):
    return quality.quality_report(t.assets_raw(), quality.ASSET_RULES)


@query
def dq_range_sanity(t):
    bounds = {"vibration_mm_s": (0.5, 200.0), "temp_c": (5.0, 95.0)}
    return quality.range_check(t.readings(), bounds).select("event_id", "out_of_range")


@query
def ingest_typing(t):
    text = t.readings().select(
        "event_id",
        F.when(F.col("temp_c") < 50, F.col("timestamp").cast("string")).otherwise("not a time").alias("timestamp"),
        F.col("temp_c").cast("string").alias("temp_c"),
    )
    return ingest.coerce(text, {"timestamp": "timestamp", "temp_c": "double"})


@query
def ingest_audit(t):
    stamped = ingest.with_ingest_audit(t.raw("orders"))
    name = F.regexp_extract("source_file", "([^/]+)$", 1)
    return stamped.groupBy(name.alias("source_file")).agg(
        F.count("ingestion_time").alias("stamped_rows")
    )


# -- silver, filters, joins ------------------------------------------------------


@query
def anomaly_flags(t):
    return t.silver().select("event_id", "vibration_anomaly_flag", "temp_anomaly_flag")


@query
def silver_sensor(t):
    return t.silver()


@query
def silver_logs(t):
    return t.logs()


@query
def silver_assets(t):
    return t.assets()


@query
def risk_filter(t):
    return enrich.at_risk(t.health()).select("asset_id", "risk_level", "health_score")


@query
def health_below(t):
    return enrich.health_below(t.health(), 60.0).select("asset_id", "risk_level", "health_score")


@query
def critical_tier(t):
    return enrich.critical_assets(t.assets()).select("asset_id", "criticality_tier")


@query
def by_source(t):
    return enrich.by_source(t.readings(), "error")


@query
def near_rating(t):
    return enrich.near_rating(t.health(), 0.5).select("asset_id", "current_vibration", "rated_max_vibration")


@query
def anomalous_assets(t):
    return enrich.anomalous_assets(t.silver())


@query
def point_health(t):
    return serving.point_health(t.assets_raw().select("asset_id"), t.live())


@query
def join_sensor_meta(t):
    return enrich.join_sensor_meta(t.readings(), t.assets()).select(
        *_BARE_SILVER, "rated_max_vibration", "rated_max_temp", "criticality_tier", "production_line_id"
    )


@query
def join_logs_meta(t):
    return enrich.join_logs_meta(t.logs_raw(), t.assets()).select(
        "work_order_id", "asset_id", "asset_type", "production_line_id", "criticality_tier"
    )


@query
def join_latest_meta_trend(t):
    latest = trends.latest_per(t.trends(), "asset_id", "hour_window")
    joined = trends.join_latest(latest, t.assets(), trends.trend_slope(t.trends(), t.as_of()))
    return joined.select(
        "asset_id", "hour_window", "vibration_avg", "temp_avg", "rated_max_vibration", "rated_max_temp",
        F.round("vibration_slope_per_sec", 9).alias("vibration_slope_per_sec"),
    )


@query
def join_cost(t):
    joined = gold.join_cost(t.health(), history.repair_averages(t.logs()), t.production())
    return _rounded(joined, 6, "avg_cost_to_fix", "avg_downtime_hours", "avg_labor_hours", "first_time_fix_rate")


def _records(t: Tables) -> DataFrame:
    """Health with cost, as the serving tables take it. Both sides of that join need health, so it is written once."""
    health = written(t.health(), "health")
    return gold.health_with_cost(health, gold.gold_cost_impact(health, t.logs(), t.production()))


@query
def join_sync(t):
    return _records(t)


@query
def anti_recent_alert(t):
    return serving.without_recent_alert(enrich.at_risk(t.health()), t.alerts(), t.as_of(), 72).select(
        "asset_id", "risk_level"
    )


@query
def lookup_insert(t):
    return serving.with_live_health(t.recommendations(), t.live()).select(
        "rec_id", "asset_id", "recommendation_text", "health_score_at_time"
    )


@query
def band_lookup(t):
    labelled = enrich.band_lookup(t.readings(), "vibration_mm_s", S.VIBRATION_ALARMS)
    labelled = enrich.band_lookup(labelled, "temp_c", S.TEMPERATURE_ALARMS, "temp_alarm")
    return labelled.select("event_id", "alarm_level", "temp_alarm")


@query
def band_lookup_by_asset(t):
    """Readings by the bands of their own asset: quarters of the way from its least to its greatest value."""
    span = t.readings().groupBy("asset_id").agg(F.min("vibration_mm_s").alias("a"), F.max("vibration_mm_s").alias("b"))
    bands = span.selectExpr("asset_id", """inline(array(
        struct('Quiet' AS band, CAST(NULL AS DOUBLE) AS low, a + (b - a) * 0.25D AS high),
        struct('Normal' AS band, a + (b - a) * 0.25D AS low, a + (b - a) * 0.5D AS high),
        struct('Raised' AS band, a + (b - a) * 0.625D AS low, a + (b - a) * 0.75D AS high),
        struct('Extreme' AS band, a + (b - a) * 0.75D AS low, CAST(NULL AS DOUBLE) AS high)))""")
    return enrich.band_table_lookup(t.readings(), "vibration_mm_s", bands).select("event_id", "alarm_level")


@query
def signal_to_asset(t):
    return enrich.map_signals(t.signals(), t.assets(), ["production_line_id"])


# -- aggregations -----------------------------------------------------------------


@query
def hourly_trends(t):
    return t.trends()


@query
def hourly_trends_since(t):
    """The last week of the hourly table, from the readings of that week and a few before."""
    since = t.as_of() - F.make_dt_interval(days=F.lit(7))
    return trends.hourly_trends_since(t.silver(), since, tie_break=("event_id",), rows=t.readings())


@query
def hourly_trends_incremental(t):
    """The hourly table from two deliveries of readings, shuffled over all times, the second one given twice."""
    silver = t.silver()
    table = HourlyTable(t.spark, scratch_dir(t.spark, "hourly"), silver.schema, tie_break=("event_id",))
    for batch in (0, 1, 1):
        table.append(silver.filter(F.pmod(F.xxhash64("event_id"), F.lit(2)) == batch), batch)
    return table.trends()


@query
def slope_by_type_line(t):
    return _rounded(
        trends.slopes_for(t.trends(), t.assets(), "MACHINERY", "Line_1", t.as_of(), 720),
        9, "vibration_slope_per_sec",
    )


@query
def trend_slope(t):
    return _rounded(trends.trend_slope(t.trends(), t.as_of()), 9, "vibration_slope_per_sec")


@query
def repair_averages(t):
    return _rounded(
        history.repair_averages(t.logs()), 6,
        "avg_cost_to_fix", "avg_downtime_hours", "avg_labor_hours", "first_time_fix_rate",
    )


@query
def mtbf_simple(t):
    return history.mtbf(t.logs())


@query
def mtbf_by_asset(t):
    return history.mtbf_by_asset(t.logs(), order=LOG_ORDER)


@query
def ftf_by_asset(t):
    return history.ftf_by_asset(t.logs())


@query
def ftf_by_technician(t):
    return history.ftf_by_technician(t.logs())


@query
def ftf_by_technician_year(t):
    return history.ftf_by_technician(t.logs(), F.add_months(F.to_date(_last_order(t)), -12))


@query
def ftf_14d(t):
    return history.ftf_derived(t.logs(), order=LOG_ORDER, rows=t.logs_raw())


@query
def spend_by_asset(t):
    return history.spend(t.logs(), F.add_months(F.to_date(_last_order(t)), -24))


@query
def fleet_counts(t):
    return reports.fleet_counts(t.health(), t.alerts())


@query
def line_exposure(t):
    return maintenance.line_exposure(t.cost())


@query
def floor_map(t):
    return reports.floor_map(t.health())


@query
def cost_by_asset_avg(t):
    return history.avg_cost_rank(t.logs())


@query
def fleet_compare(t):
    table = history.fleet_compare(t.logs())
    return _rounded(table, 6, *[c for c in table.columns if c not in ("asset_id", "work_orders")])


@query
def lookback_profile(t):
    table = trends.lookback_profile(t.trends(), t.as_of())
    return _rounded(table, 6, *table.columns[1:])


@query
def vib_rpm_corr(t):
    return _rounded(trends.vib_corr(t.readings(), "temp_c"), 6, "vibration_temp_c_corr")


@query
def increase_48h(t):
    return trends.top_increase(t.trends(), t.as_of(), 48, 10)


# -- windows ------------------------------------------------------------------------


@query
def rolling_vibration(t):
    smooth = smoothing.rolling_mean(t.readings(), {"vibration_mm_s": "vibration_smoothed"}, **_SMOOTH)
    return _rounded(smooth, 6, "vibration_smoothed").select("event_id", "vibration_smoothed")


@query
def rolling_temp(t):
    smooth = smoothing.rolling_mean(t.readings(), {"temp_c": "temp_smoothed"}, **_SMOOTH)
    return _rounded(smooth, 6, "temp_smoothed").select("event_id", "temp_smoothed")


@query
def latest_per_asset(t):
    return trends.latest_per(t.trends(), "asset_id", "hour_window")


@query
def days_since_prev(t):
    return history.with_days_since_prev(t.logs(), LOG_ORDER, rows=t.logs_raw()).select(
        "work_order_id", "asset_id", "days_since_prev_failure"
    )


@query
def recent_n(t):
    return history.recent_n(t.logs(), 5, order=LOG_ORDER).select("asset_id", "work_order_id", "timestamp")


@query
def maintenance_history(t):
    return history.maintenance_history(t.logs(), 5, order=LOG_ORDER)


@query
def ewma(t):
    smooth = smoothing.ewma(t.readings(), "vibration_mm_s", 0.3, 5, **_SMOOTH)
    return _rounded(smooth, 6, "ewma").select("event_id", "ewma")


@query
def rolling_median(t):
    return smoothing.rolling_median(t.readings(), "vibration_mm_s", 5, **_SMOOTH).select(
        "event_id", F.round("rolling_median", 6).alias("rolling_median")
    )


@query
def rolling_median_long(t):
    """The trailing median over 1,001 readings."""
    return smoothing.rolling_median(t.readings(), "vibration_mm_s", 1001, **_SMOOTH).select(
        "event_id", F.round("rolling_median", 6).alias("rolling_median")
    )


@query
def clip_outliers(t):
    smooth = smoothing.clip_outliers(t.readings(), "vibration_mm_s", 10, 2.0, **_SMOOTH)
    return _rounded(smooth, 6, "clipped").select("event_id", "clipped")


@query
def sustained_over(t):
    found = runs.sustained_over(t.readings(), "temp_c", 50.0, 30, order=tuple(READING_ORDER))
    return found


@query
def consecutive_over(t):
    over = F.col("rated_max_temp") * 0.8
    return runs.consecutive_over(t.silver(), "temp_c", over, 2, order=tuple(READING_ORDER), rows=t.readings())


@query
def rising_pct(t):
    hours = t.readings().withColumnRenamed("timestamp", "hour_window")
    return _rounded(runs.rising_pct(t.trends(), 5.0, 3, None, rows=hours), 6, "peak_value")


@query
def rising_2pct(t):
    """Sustained growth above two percent."""
    hours = t.readings().withColumnRenamed("timestamp", "hour_window")
    return _rounded(runs.rising_pct(t.trends(), 2.0, 2, None, rows=hours), 6, "peak_value")


@query
def thermal_rate(t):
    """Thermal spikes that rose by more than 10 degrees an hour."""
    return runs.thermal_spikes(t.silver(), order=tuple(READING_ORDER), rows=t.readings(), rate_per_hour=10.0, min_len=1)


@query
def thermal_spike(t):
    return runs.thermal_spikes(t.silver(), order=tuple(READING_ORDER), rows=t.readings())


# -- the same with every asset cut into slices, as very busy ones are ------------------

_SLICED = {"min_hot_rows": 50}


@query
def hourly_trends_sliced(t):
    return trends.hourly_trends(t.silver(), tie_break=("event_id",), rows=t.readings(), **_SLICED)


@query
def rolling_vibration_sliced(t):
    smooth = smoothing.rolling_mean(t.readings(), {"vibration_mm_s": "vibration_smoothed"}, **_SMOOTH, **_SLICED)
    return _rounded(smooth, 6, "vibration_smoothed").select("event_id", "vibration_smoothed")


@query
def consecutive_over_sliced(t):
    over = F.col("rated_max_temp") * 0.8
    return runs.consecutive_over(t.silver(), "temp_c", over, 2, order=tuple(READING_ORDER), rows=t.readings(), **_SLICED)


@query
def rolling_median_long_sliced(t):
    smooth = smoothing.rolling_median(t.readings(), "vibration_mm_s", 101, **_SMOOTH, **_SLICED)
    return _rounded(smooth, 6, "rolling_median").select("event_id", "rolling_median")


@query
def thermal_spike_sliced(t):
    return runs.thermal_spikes(t.silver(), order=tuple(READING_ORDER), rows=t.readings(), **_SLICED)


@query
def days_since_prev_sliced(t):
    return history.with_days_since_prev(t.logs(), LOG_ORDER, rows=t.logs_raw(), min_hot_rows=10).select(
        "work_order_id", "asset_id", "days_since_prev_failure"
    )


# -- sorts and limits ----------------------------------------------------------------


@query
def health_board(t):
    return reports.health_board(t.health())


@query
def trend_recent(t):
    return trends.trend_recent(t.trends(), t.as_of())


@query
def trend_recent_7d(t):
    return trends.trend_recent(t.trends(), t.as_of(), 168)


@query
def cost_summary(t):
    return reports.cost_summary(t.cost())


@query
def cost_compare_inline(t):
    return reports.cost_compare(t.cost())


@query
def top_patterns(t):
    return search.top_patterns(t.logs())


@query
def top_chunks(t):
    return search.top_chunks(t.chunks())


@query
def active_alerts(t):
    return serving.active_alerts(t.alerts())


@query
def recent_recs(t):
    return serving.recent_recs(t.recommendations())


# -- formulas --------------------------------------------------------------------------


@query
def health_score(t):
    score = scores.health_score(F.col("vibration_mm_s"), F.col("rated_max_vibration"))
    return t.silver().select("event_id", F.round(score, 2).alias("health_score"))


@query
def risk_level(t):
    score = scores.health_score(F.col("vibration_mm_s"), F.col("rated_max_vibration"))
    return t.silver().select("event_id", scores.risk_level(score).alias("risk_level"))


@query
def rul_hours(t):
    life = scores.rul_hours(
        F.col("vibration_mm_s"), F.col("rated_max_vibration"), (F.col("temp_c") - 50) / 1e6
    )
    return t.silver().select("event_id", F.round(life, 1).alias("estimated_rul_hours"))


@query
def gold_health(t):
    return t.health()


@query
def gold_health_compat(t):
    return gold.gold_health_scores(t.trends(), t.assets(), t.as_of(), strict_compat=True)


@query
def unplanned_cost(t):
    return t.cost().select("asset_id", "cost_of_unplanned_failure")


@query
def net_recommendation(t):
    return t.health().select(
        "asset_id", costs.net_recommendation(F.col("risk_level")).alias("net_recommendation")
    )


@query
def gold_cost(t):
    return _rounded(t.cost(), 6, "avg_cost_to_fix", "avg_downtime_hours")


@query
def planned_vs_unplanned(t):
    return reports.cost_impact(t.cost(), 4.0)


@query
def cost_requests(t):
    """The comparison for many (asset, hours) requests: two plans for each asset that has an order."""
    asked = t.logs().select("asset_id", F.explode(F.array(F.lit(2.5), F.lit(12.0))).alias("hours")).distinct()
    return reports.cost_impact(t.cost().join(asked, "asset_id"), F.col("hours"), "hours")


@query
def alert_downtime_cost(t):
    cost = costs.alert_downtime_cost(F.col("estimated_rul_hours"), F.col("cost_of_unplanned_failure"))
    return t.cost().select("asset_id", cost.alias("estimated_downtime_cost"))


@query
def dash_cost_table(t):
    return reports.dash_cost(t.health(), t.production())


@query
def outage_cost_manual(t):
    return maintenance.outage_costs(t.cost())


@query
def expected_shutdown_cost(t):
    return maintenance.expected_shutdown_cost(t.cost(), 72.0)


@query
def iso_zone(t):
    return t.readings().select("event_id", scores.iso_zone(F.col("vibration_mm_s")).alias("iso_zone"))


@query
def stop_conditions(t):
    return maintenance.stop_conditions(t.silver(), t.health(), TEST_RULE_TYPES).select(
        "event_id", "asset_id", "rule_type", "vibration_mm_s", "rated_max_vibration"
    )


@query
def restart_gate(t):
    return maintenance.restart_gate(t.health(), t.alerts()).select("asset_id", "health_score")


def _due(t: Tables, days: int) -> DataFrame:
    return maintenance.pm_due(t.assets(), t.logs(), _last_order(t), days, TEST_INTERVALS)


@query
def pm_due(t):
    return _due(t, 90)


@query
def pm_due_own_intervals(t):
    """Tasks due where every fifth machine has a shorter interval of its own."""
    number = F.substring_index("asset_id", "_", -1).cast("int")
    own = t.assets().filter((number % 5 == 0) & (F.col("asset_type") == "MACHINERY")).select(
        "asset_id", F.lit("Bearing replacement").alias("task"), (number % 7 + 6).alias("months"))
    return maintenance.pm_due(t.assets(), t.logs(), _last_order(t), 90, TEST_INTERVALS, own)


@query
def pm_combine(t):
    return maintenance.pm_combine(_due(t, 365))


@query
def mtbf_target(t):
    targets = {"MACHINERY": 250.0, "AUTOMOBILE": 200.0, "BUILDING": 300.0}
    return history.mtbf_below(history.mtbf_by_asset(t.logs(), order=LOG_ORDER), targets).select(
        "asset_id", "asset_type", "mtbf_days", "target_days"
    )


# -- search and text ---------------------------------------------------------------------


@query
def chunk_markdown(t):
    return t.chunks()


@query
def chunk_headings(t):
    """Manuals whose lines of up to 60 characters are headings, cut before each heading."""
    marked = F.regexp_replace("text", "(?m)^(.{1,60})$", "## $1")
    return search.chunk(t.manuals().withColumn("text", marked))


@query
def search_manuals(t):
    return search.search_manuals(t.chunks(), SEARCH_TERMS)


def _texts_as_queries(t: Tables, column: str) -> DataFrame:
    """A table of queries: a few characters out of every fiftieth document, and the short list."""
    own = t.raw("documents").filter("doc_id % 50 = 0").select(F.expr(f"{column} AS query"))
    return own.unionAll(t.spark.createDataFrame([(q,) for q in (*SEARCH_TERMS, *FAULT_TERMS, "s_al", "e", "zq%xj")], "query string")).filter("query <> ''")


@query
def search_manuals_table(t):
    return text_index.search_manuals(t.chunks(), _texts_as_queries(t, "substring(text, 5, 9)"))


@query
def search_failure_patterns_table(t):
    return text_index.search_failure_patterns(t.logs(), _texts_as_queries(t, "substring(text, 5, 2)"))


@query
def search_failure_patterns(t):
    return search.search_failure_patterns(t.logs(), FAULT_TERMS)


@query
def vector_top_k_table(t):
    """Every fiftieth vector as a query against all vectors."""
    vectors = t.raw("embeddings")
    queries = vectors.filter("vec_id % 50 = 0").selectExpr("CAST(vec_id AS STRING) AS query", "embedding AS vector")
    return _rounded(vector_search.vector_top_k(vectors, queries, 5), 6, "similarity")


@query
def vector_top_k(t):
    return _rounded(search.vector_top_k(t.raw("embeddings"), QUERY_VECTORS, 5), 6, "similarity")


@query
def provenance_explode(t):
    return search.provenance(t.recommendations(), t.chunks())


@query
def asset_dossier(t):
    return dossier.asset_dossier(
        t.cost(), t.logs(), t.chunks(), 3, manual_terms={"Seal leak": "license", "Overheating": "the "}, order=LOG_ORDER,
    )


@query
def chat_requests(t):
    """The message list of each conversation, as text, and its last reply."""
    content = F.transform("messages", lambda m: F.concat(F.coalesce(m["role"], F.lit("")), F.lit(": "), F.coalesce(m["content"], F.lit(""))))
    return dossier.chat_requests(t.raw("conversations")).select(
        "conv_id", F.size("messages").cast("long").alias("message_count"), F.array_join(content, "\n").alias("messages"), "last_reply")


@query
def chat_last_replies(t):
    return dossier.last_replies(t.raw("conversations"))


# -- serving -----------------------------------------------------------------------------


def _as_registered(t: Tables) -> DataFrame:
    """A live table of all assets, each in perfect health."""
    return t.assets().select(
        "asset_id", F.lit(100.0).alias("health_score"), F.lit("LOW").alias("risk_level"),
        F.lit(0.0).alias("current_vibration"), F.lit(0.0).alias("current_temp"), "rated_max_vibration",
        F.lit(None).cast("double").alias("estimated_rul_hours"), "production_line_id",
        "criticality_tier", t.as_of().alias("calculated_at"), t.as_of().alias("last_updated"),
    )


@query
def sink_upsert_health(t):
    """Live table of all assets as of the register, overwritten by the computed health."""
    return serving.upsert(_as_registered(t), t.live(), ["asset_id"], "calculated_at", t.as_of())


@query
def sink_insert_disruption(t):
    return serving.new_disruptions(t.cost(), t.alerts(), t.as_of(), 72)


@query
def alert_status(t):
    """Active alerts of assets that are no longer at risk become resolved, the others acknowledged."""
    active = t.alerts().filter(F.col("status") == S.ALERT_ACTIVE).select("disruption_id", "asset_id")
    risk = t.health().select("asset_id", scores.is_at_risk(F.col("risk_level")).alias("_risky"))
    changes = active.join(risk, "asset_id").select(
        "disruption_id",
        F.when(F.col("_risky"), S.ALERT_ACKNOWLEDGED).otherwise(S.ALERT_RESOLVED).alias("new_status"),
        F.lit("auto").alias("changed_by"),
    )
    return serving.update_alerts(t.alerts(), changes, t.as_of()).select(
        "disruption_id", "asset_id", "status", "resolved_at", "resolved_by"
    )


@query
def serial_ids(t):
    spread = F.col("o_orderkey") % serving.ID_BUCKETS
    numbered = serving.with_serial_id(t.logs_raw(), LOG_ORDER, 1, "rec_id", spread)
    return numbered.select("rec_id", "work_order_id", F.format_string("REC-%05d", "rec_id").alias("label"))


@query
def sink_recommendation(t):
    """Every recommendation as it would be appended, with its id and the message that confirms it."""
    recs = t.recommendations().withColumnRenamed("rec_id", "source_order").drop("created_at")
    stored = serving.recommendations_to_append(
        recs, t.live(), t.as_of(), 1, "s1", ["source_order"], F.col("source_order") % serving.ID_BUCKETS)
    messages = serving.confirmation(stored).select(F.col("rec_id").alias("_rec_id"), "message")
    return stored.join(messages, F.col("rec_id") == F.col("_rec_id")).select(
        "rec_id", "asset_id", "recommendation_text", "cost_to_fix", "cost_of_downtime", "urgency_hours", "net_recommendation",
        F.array_join("vector_search_sources", ",").alias("sources"), "health_score_at_time", "created_by_session", "message")


def _risk_history(t: Tables) -> DataFrame:
    score = scores.health_score(F.col("vibration_avg"), F.col("rated_max_vibration"))
    rated = t.trends().join(t.assets().select("asset_id", "rated_max_vibration"), "asset_id", "left")
    return rated.select("asset_id", F.col("hour_window").alias("calculated_at"), scores.risk_level(score).alias("risk_level"))


@query
def risk_entries(t):
    """Entries into an at-risk level along the hourly history of every asset."""
    return serving.risk_changes(_risk_history(t), rows=t.readings().withColumnRenamed("timestamp", "calculated_at"))


@query
def stream_transitions(t):
    """The same entries from a stream whose rows come out of order; a row far ahead ends the wait of the last ones."""
    history = _risk_history(t)
    end = history.agg(F.max("calculated_at").alias("calculated_at")).select(
        F.lit(None).cast("string").alias("asset_id"), F.col("calculated_at") + F.expr("INTERVAL '2' DAY"), F.lit("LOW").alias("risk_level"))
    end = end.toDF(*history.columns)
    path = scratch_dir(t.spark, "history")
    history.write.parquet(path)
    folder = _in_deliveries(t, t.spark.read.parquet(path), "calculated_at", "asset_id",
                            lambda stream: state.risk_entries_stream(stream, "12 hours"), end)
    return t.spark.read.parquet(f"{folder}/out")


# -- sources: the bound tables written as CSV, then read back --------------------------------


def _landed(t: Tables, name: str, df: DataFrame, schema) -> str:
    """The table as CSV files in a new folder, with the columns a landed file has."""
    folder = scratch_dir(t.spark, name)
    columns = [
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema
    ]
    writer = df.select(*columns).write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    writer.option("header", True).csv(f"{folder}/in")
    return folder


def _drained(t: Tables, query, path: str) -> DataFrame:
    query.awaitTermination()
    return t.spark.read.parquet(path)


@query
def src_sensor_stream(t):
    folder = _landed(t, "sensors", t.readings(), S.SENSOR_READINGS)
    stream = files.stream_sensor_readings(t.spark, f"{folder}/in")
    run = jobs.write_stream(stream, f"{folder}/bronze", f"{folder}/checkpoint")
    return _drained(t, run, f"{folder}/bronze").select(
        "timestamp", "asset_id", "vibration_mm_s", "temp_c", "data_source"
    )


@query
def src_logs_stream(t):
    folder = _landed(t, "orders", t.logs_raw(), S.MAINTENANCE_LOGS)
    stream = files.stream_maintenance_logs(t.spark, f"{folder}/in")
    run = jobs.write_stream(stream, f"{folder}/bronze", f"{folder}/checkpoint")
    return _drained(t, run, f"{folder}/bronze").select(*S.MAINTENANCE_LOGS.names)


@query
def src_asset_metadata(t):
    folder = _landed(t, "assets", t.assets_raw(), S.ASSET_METADATA)
    return files.read_asset_metadata(t.spark, f"{folder}/in").select(*t.assets_raw().columns)


@query
def src_production_output(t):
    folder = _landed(t, "production", t.production(), S.PRODUCTION_OUTPUT)
    return files.read_production_output(t.spark, f"{folder}/in")


# -- streams and written tables ---------------------------------------------------------------


def _event_stream(t: Tables) -> DataFrame:
    schema = t.raw("events").schema
    files_ = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
    return bind_readings(files_.parquet(t.folder))


@query
def stream_bronze_silver(t):
    folder = scratch_dir(t.spark, "silver")
    run = jobs.run_silver_stream(_event_stream(t), t.assets(), f"{folder}/silver", f"{folder}/checkpoint")
    return _drained(t, run, f"{folder}/silver")


@query
def stream_silver_logs(t):
    """Work orders as a file stream, checked and joined to the register."""
    folder, orders = scratch_dir(t.spark, "silver-logs"), t.logs_raw()
    orders.write.parquet(f"{folder}/in")
    stream = t.spark.readStream.schema(orders.schema).parquet(f"{folder}/in")
    run = jobs.run_silver_logs_stream(stream, t.assets(), f"{folder}/silver", f"{folder}/checkpoint")
    return _drained(t, run, f"{folder}/silver")


@query
def sink_stream_append(t):
    folder = scratch_dir(t.spark, "append")
    run = jobs.write_stream(_event_stream(t), f"{folder}/bronze", f"{folder}/checkpoint")
    return _drained(t, run, f"{folder}/bronze")


@query
def stream_watermark_dedup(t):
    """Every event delivered twice comes out once."""
    folder = scratch_dir(t.spark, "dedup")
    twice = _event_stream(t).withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    run = jobs.write_stream(
        jobs.dedup(twice, ["event_id"], "2 hours"), f"{folder}/out", f"{folder}/checkpoint"
    )
    return _drained(t, run, f"{folder}/out")


@query
def stream_hourly(t):
    folder = scratch_dir(t.spark, "hourly")
    silver = enrich.silver_sensor_readings(_event_stream(t), t.assets())
    run = jobs.write_stream(jobs.hourly_stream(silver, "1 hour"), f"{folder}/out", f"{folder}/checkpoint")
    written = _drained(t, run, f"{folder}/out")
    return written.unionByName(jobs.open_hours(t.silver(), written))


def _in_deliveries(t: Tables, rows: DataFrame, time: str, key: str, start, last: DataFrame | None = None) -> str:
    """``rows`` as a folder of files that comes in three deliveries, some rows up to six hours late; the stream that ``start`` gives runs after each.

    ``last`` comes in a delivery of its own behind them. Each run goes on from the checkpoint of the one before. Gives the folder.
    """
    folder = scratch_dir(t.spark, "deliveries")
    low, high = (rows.agg(F.unix_seconds(f(time))).scalar() for f in (F.min, F.max))
    late = F.pmod(F.xxhash64(key, time), F.lit(6 * 3600))
    delivery = F.least(F.floor((F.unix_seconds(time) + late - low) * 3 / (high - low + 1)), F.lit(2))
    parts = rows.withColumn("_part", delivery)
    for part in [parts.filter(F.coalesce("_part", F.lit(0)) == i).drop("_part") for i in range(3)] + ([last] if last else []):
        part.select(*rows.columns).write.mode("append").parquet(f"{folder}/in")
        stream = t.spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        jobs.write_stream(start(stream), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return folder


@query
def stream_rolling5(t):
    """Readings that come in deliveries, some of them late: the newest mean issued for each."""
    order = tuple(READING_ORDER)
    readings = t.readings().select("event_id", "timestamp", "asset_id", "vibration_mm_s")
    folder = _in_deliveries(t, readings, "timestamp", "event_id", lambda stream: state.rolling_stream(
        stream, {"vibration_mm_s": "vibration_smoothed"}, "12 hours", order=order))
    newest = state.newest_issue(t.spark.read.parquet(f"{folder}/out"), order)
    return newest.select("event_id", F.round("vibration_smoothed", 6).alias("vibration_smoothed"))


@query
def stream_sync(t):
    """Gold records as a file stream into the serving tables; the live table that results."""
    folder = scratch_dir(t.spark, "sync")
    records = _records(t)
    records.write.parquet(f"{folder}/gold")
    stream = t.spark.readStream.schema(records.schema).parquet(f"{folder}/gold")
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    jobs.run_sync_stream(stream, f"{folder}/serving", f"{folder}/checkpoint", now=now).awaitTermination()
    tables = ServingLog(t.spark, f"{folder}/serving")
    raised = tables.alerts().select("asset_id", "disruption_id", "status")
    return tables.live.read().join(raised, "asset_id", "left").select(
        "asset_id", "health_score", "risk_level", "estimated_rul_hours", "last_updated", "status",
        F.col("disruption_id").isNotNull().alias("alerted"),
    )


def _twice_synced(t, between) -> ServingLog:
    """Sync, a change by ``between``, and the same records again a day later, as batches 0 and 1."""
    tables = ServingLog(t.spark, scratch_dir(t.spark, "serving"))
    records = written(_records(t), "records")  # every sync reads them twice
    tables.sync(records, F.lit("2024-02-01 00:00:00").cast("timestamp"), 0)
    between(tables)
    tables.sync(records, F.lit("2024-02-02 00:00:00").cast("timestamp"), 1)
    tables.sync(records, F.lit("2024-02-03 00:00:00").cast("timestamp"), 1)  # a batch that is run again
    return tables


@query
def sync_acknowledge_sync(t):
    """Alerts after a sync, an acknowledgement of all of them, and another sync."""
    def acknowledge(tables):
        changes = tables.alerts().select(
            "disruption_id", F.lit("ACKNOWLEDGED").alias("new_status"), F.lit("kim").alias("changed_by"))
        tables.set_alert_status(changes, F.lit("2024-02-01 12:00:00").cast("timestamp"))

    return _twice_synced(t, acknowledge).alerts().select("asset_id", "status", "detection_timestamp")


@query
def sync_reset_sync(t):
    """Alerts after a sync, two resets and another sync."""
    def reset(tables):
        tables.reset()
        tables.reset()

    return _twice_synced(t, reset).alerts().select("asset_id", "status", "detection_timestamp")


@query
def reset_serving(t):
    """The rows of all three serving tables as written, and whether a reset leaves them."""
    tables = ServingLog(t.spark, scratch_dir(t.spark, "reset"))
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    tables.sync(written(_records(t), "records"), now)
    tables.recommend(t.recommendations().drop("rec_id", "created_at"), now)

    def contents():
        return (
            tables.live.read().select(F.lit("live").alias("table_name"), "asset_id", F.lit(None).cast("string").alias("what"))
            .unionAll(tables.alerts().select(F.lit("alerts"), "asset_id", "risk_level"))
            .unionAll(tables.recommendations().select(F.lit("recommendations"), "asset_id", "recommendation_text"))
            .groupBy("table_name", "asset_id", "what").count()
        )

    before = contents().write.parquet(path := scratch_dir(t.spark, "before"))
    tables.reset()
    before, after = t.spark.read.parquet(path), contents().select("table_name", "asset_id", "what", F.col("count").alias("left"))
    same = before["table_name"].eqNullSafe(after["table_name"]) & before["asset_id"].eqNullSafe(after["asset_id"]) & before["what"].eqNullSafe(after["what"])
    return before.join(after, same, "left").select(
        before["table_name"], before["asset_id"], before["what"], F.col("count").alias("rows_before"), F.coalesce("left", F.lit(0)).alias("rows_after"))


def _keyed_upsert(t: Tables, share: int) -> DataFrame:
    """Health written over a live table of all assets, for one in ``share`` assets."""
    table = KeyedTable(t.spark, scratch_dir(t.spark, "keyed"), S.ASSET_HEALTH_LIVE, ["asset_id"])
    table.upsert(_as_registered(t))
    table.upsert(t.live().filter(F.substring_index("asset_id", "_", -1).cast("long") % share == 0))
    return table.read()


@query
def sink_upsert_keyed(t):
    return _keyed_upsert(t, 1)


@query
def sink_upsert_keyed_1pct(t):
    return _keyed_upsert(t, 100)


@query
def sink_materialize(t):
    return materialize(t.trends(), scratch_dir(t.spark, "trends")).read()


# -- SQL functions ----------------------------------------------------------------------------


def _with_functions(t: Tables) -> SparkSession:
    register_functions(t.spark, t.live(), t.chunks(), t.logs(), t.cost(), LOG_ORDER)
    t.assets_raw().select("asset_id").createOrReplaceTempView("rw_asset_ids")
    return t.spark


@query
def fn_get_asset_health(t):
    return _with_functions(t).sql("SELECT asset_id, get_asset_health(asset_id) AS health FROM rw_asset_ids")


@query
def fn_calculate_cost_impact(t):
    return _with_functions(t).sql(
        "SELECT c.* FROM rw_asset_ids a, LATERAL calculate_cost_impact(a.asset_id, 4.0D) c"
    )


@query
def fn_get_maintenance_history(t):
    return _with_functions(t).sql(
        "SELECT a.asset_id, h.* FROM rw_asset_ids a, LATERAL get_maintenance_history(a.asset_id, 5) h"
    )


@query
def fn_search_failure_patterns(t):
    return _with_functions(t).sql("SELECT * FROM search_failure_patterns('overheat')")


@query
def fn_search_manuals(t):
    return _with_functions(t).sql("SELECT * FROM search_manuals('license')")
