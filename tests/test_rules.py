"""Hand-worked values of the formulas, gates, rules and searches."""

import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from conftest import rows
from rotorwatch import schemas as S
from rotorwatch.functions import costs, scores
from rotorwatch.operators import enrich, history, ingest, maintenance, quality, runs, search, smoothing, text_index, trends
from rotorwatch.plans import dossier, gold, reports

AT = datetime(2024, 1, 1)


@pytest.mark.parametrize("rated, vib, slope, health, risk, rul", [
    (8.5, 8.925, 0.0001, 0.0, "CRITICAL", 0.0),
    (8.0, 2.0, 0.0, 75.0, "MEDIUM", None),
    (10.0, 2.0, -0.1, 80.0, "LOW", None),
    (10.0, 4.0, 0.001, 60.0, "MEDIUM", 1.7),
    (10.0, 7.0, 0.0005, 30.0, "HIGH", 1.7),
    (8.5, 5.0, None, 41.18, "HIGH", None),
    (None, 5.0, 0.1, None, "UNKNOWN", None),
])
def test_score_risk_and_life(spark, rated, vib, slope, health, risk, rul):
    df = spark.createDataFrame([(rated, vib, slope)], "rated double, vib double, slope double")
    score = scores.health_score(F.col("vib"), F.col("rated"))
    got = df.select(
        F.round(score, 2), scores.risk_level(score),
        F.round(scores.rul_hours(F.col("vib"), F.col("rated"), F.col("slope")), 1),
    ).first()
    assert tuple(got) == (health, risk, rul)


def test_unrated_asset_in_compat_mode(spark):
    df = spark.createDataFrame([(None, 5.0, 0.1)], "rated double, vib double, slope double")
    score = scores.health_score(F.col("vib"), F.col("rated"), strict_compat=True)
    life = scores.rul_hours(F.col("vib"), F.col("rated"), F.col("slope"), strict_compat=True)
    assert tuple(df.select(score, scores.risk_level(score), life).first()) == (100.0, "LOW", 0.0)


def test_money(spark):
    df = spark.createDataFrame([(2886.17625, 52000, 3200.0)], "avg double, hourly int, repair double")
    avg, hourly, repair = F.col("avg"), F.col("hourly"), F.col("repair")
    none = F.lit(None).cast("double")
    got = df.select(
        costs.unplanned_cost(none, hourly, avg),
        F.round(costs.planned_cost(F.lit(4.0), avg), 2),
        costs.outage_cost(hourly, F.lit(8.0), repair),
        costs.planned_outage_cost(hourly, F.lit(4.0), repair, F.lit(False)),
        costs.planned_outage_cost(hourly, F.lit(4.0), repair, F.lit(True)),
        costs.alert_downtime_cost(none, avg),
    ).first()
    assert tuple(got) == (4329.26, 2071.71, 420800.0, 211200.0, 3200.0, 0.0)


def test_zones_and_severity(spark):
    df = spark.createDataFrame([(v,) for v in (2.2, 2.3, 4.5, 7.1, 7.2)], "v double")
    assert [r[0] for r in df.select(scores.iso_zone(F.col("v"))).collect()] == ["A", "B", "C", "C", "D"]
    risks = spark.createDataFrame([("HIGH",), ("CRITICAL",), ("UNKNOWN",), ("LOW",)], "r string")
    ordered = risks.orderBy(scores.severity_rank(F.col("r"))).collect()
    assert [r[0] for r in ordered] == ["CRITICAL", "HIGH", "LOW", "UNKNOWN"]


def _readings(spark, values, asset="A", step=600, column="vibration_mm_s"):
    data = [(i, asset, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(data, f"event_id long, asset_id string, {column} double")
    return df.withColumn("timestamp", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("event_id") * step))


def test_rolling_mean_warms_up(spark):
    got = smoothing.rolling_mean(_readings(spark, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]), {"vibration_mm_s": "m"})
    assert [r.m for r in got.orderBy("event_id").collect()] == [1, 1.5, 2, 2.5, 3, 4]


def test_equal_times_are_ordered_by_the_tie_break(spark):
    df = _readings(spark, [1.0, 3.0, 8.0], step=0)
    got = smoothing.rolling_mean(df, {"vibration_mm_s": "m"}, 2, order=["timestamp", "event_id"])
    assert [r.m for r in got.orderBy("event_id").collect()] == [1.0, 2.0, 5.5]


@pytest.mark.parametrize("temps, found", [
    ([90, 90], []), ([90, 90, 90], [3]), ([90, 90, 70, 90], []), ([90, None, 90, 90, 90], [3]),
])
def test_consecutive_over(spark, temps, found):
    df = _readings(spark, [None if t is None else float(t) for t in temps], column="temp_c")
    got = runs.consecutive_over(df, "temp_c", 85.0, 2)
    assert [r.run_length for r in got.collect()] == found


def test_sustained_over_counts_time(spark):
    df = _readings(spark, [7.5] * 4)
    assert runs.sustained_over(df, "vibration_mm_s", 7.0, 30).isEmpty()
    assert runs.sustained_over(df, "vibration_mm_s", 7.0, 29).count() == 1


def test_rising_needs_neighbouring_hours(spark):
    hours = [(f"A", datetime(2024, 1, 1, h), 1.06 ** h) for h in range(10) if h != 4]
    df = spark.createDataFrame(hours, "asset_id string, hour_window timestamp, vibration_avg double")
    assert runs.rising_pct(df, 5.0, 8).isEmpty()
    assert [r.run_length for r in runs.rising_pct(df, 5.0, 8, None).collect()] == [8]


def test_thermal_spike(spark):
    df = _readings(spark, [50.0] * 8 + [70.0, 71.0] + [50.0] * 3, column="temp_c").withColumn(
        "vibration_anomaly_flag", F.lit(False)
    )
    got = runs.thermal_spikes(df).collect()
    assert [(r.run_length, r.peak_value) for r in got] == [(2, 71.0)]
    assert runs.thermal_spikes(df.withColumn("vibration_anomaly_flag", F.lit(True))).isEmpty()


def test_flags_and_unknown_asset(spark):
    raw = spark.createDataFrame(
        [("A", 8.0, 10.0), ("A", 8.01, 90.0), ("X", 99.0, 99.0)], "asset_id string, vibration_mm_s double, temp_c double"
    ).withColumn("timestamp", F.lit(AT))
    meta = spark.createDataFrame(
        [("A", "Motor", "L1", 1, 10.0, 100.0)],
        "asset_id string, asset_type string, production_line_id string, criticality_tier int, "
        "rated_max_vibration double, rated_max_temp double",
    )
    got = enrich.silver_sensor_readings(raw, meta)
    flags = rows(got.select("asset_id", "vibration_mm_s", "vibration_anomaly_flag", "temp_anomaly_flag", "rated_max_temp"))
    assert flags == [("A", 8.0, False, False, 100.0), ("A", 8.01, True, True, 100.0), ("X", 99.0, False, False, None)]


def test_gates_drop_and_count(spark):
    raw = spark.createDataFrame(
        [("A", 1.0, 1.0), ("B", 0.0, 1.0), ("C", -1.0, 1.0), ("D", None, 1.0), (None, 1.0, 1.0)],
        "asset_id string, rated_max_vibration double, rated_max_temp double",
    )
    assert rows(enrich.silver_asset_metadata(raw).select("asset_id")) == [("A",)]
    report = quality.quality_report(raw, quality.ASSET_RULES).filter("expectation = 'valid_rated_max_vibration'")
    assert report.select("passed", "failed", "total").first() == (2, 3, 5)


def test_observed_counts(spark):
    from pyspark.sql import Observation

    seen = Observation("gate")
    kept = quality.expect_or_drop(spark.range(10), "small", "id < 4", seen)
    assert kept.count() == 4 and seen.get == {"passed": 4, "failed": 6}


def test_bad_text_becomes_null(spark):
    raw = spark.createDataFrame([("2024-01-02T03:04:05", "True", "2024-02-03"), ("soon", "maybe", "later")],
                                "timestamp string, first_time_fix string, day string")
    got = ingest.coerce(raw, {"timestamp": "timestamp", "first_time_fix": "boolean", "day": "date"})
    assert rows(got) == [(None, None, None), (datetime(2024, 1, 2, 3, 4, 5), True, date(2024, 2, 3))]


def test_bad_time_stays_in_readings_but_not_in_orders(spark):
    meta = spark.createDataFrame([], S.ASSET_METADATA)
    reading = spark.createDataFrame([(None, "A", 1.0, 1.0)], "timestamp timestamp, asset_id string, vibration_mm_s double, temp_c double")
    order = spark.createDataFrame([(None, "A", "WO-1")], "timestamp timestamp, asset_id string, work_order_id string")
    assert enrich.silver_sensor_readings(reading, meta).count() == 1
    assert enrich.silver_maintenance_logs(order, meta).count() == 0


def test_silver_has_the_standard_columns(spark):
    raw = spark.createDataFrame([], S.SENSOR_READINGS).withColumns(
        {"ingestion_time": F.current_timestamp(), "source_file": F.lit("f")}
    )
    got = enrich.silver_sensor_readings(raw, spark.createDataFrame([], S.ASSET_METADATA))
    assert len(got.columns) == 17


def _trends(spark, points):
    data = [("A", datetime(2024, 1, d, h), "L1", 1, v, 50.0) for d, h, v in points]
    return spark.createDataFrame(
        data, "asset_id string, hour_window timestamp, production_line_id string, criticality_tier int, "
        "vibration_avg double, temp_avg double")


def test_slope_window(spark):
    df = _trends(spark, [(1, 0, 9.0), (3, 0, 1.0), (3, 1, 2.0)])
    exact = trends.trend_slope(df, as_of=datetime(2024, 1, 3, 1)).first()
    assert exact.vibration_slope_per_sec == pytest.approx(1 / 3600)
    days = trends.trend_slope(df, as_of=datetime(2024, 1, 3, 1), whole_days=True).first()
    assert days.vibration_slope_per_sec < 0
    single = trends.trend_slope(_trends(spark, [(3, 0, 1.0)])).first()
    assert single.vibration_slope_per_sec is None


def test_gold_health_from_trends(spark):
    meta = spark.createDataFrame([("A", 10.0)], "asset_id string, rated_max_vibration double")
    got = gold.gold_health_scores(_trends(spark, [(3, 0, 1.0), (3, 1, 2.0)]), meta).first()
    assert (got.health_score, got.risk_level, got.estimated_rul_hours) == (80.0, "LOW", 8.0)


def _logs(spark, data):
    cols = ("work_order_id string, asset_id string, asset_type string, production_line_id string, timestamp timestamp, "
            "fault_type string, part_replaced string, technician_id string, labor_hours double, cost_to_fix double, "
            "first_time_fix boolean, downtime_hours double")
    return spark.createDataFrame(data, cols)


def _order(i, day, asset="A", fault="Bearing failure", part="Drive bearing", cost=100.0, fixed=True):
    return (f"WO-{i}", asset, "Motor", "L1", day, fault, part, "T1", 2.0, cost, fixed, 3.0)


def test_mtbf_forms_agree(spark):
    logs = _logs(spark, [
        _order(1, datetime(2024, 1, 1, 23), cost=999.0), _order(2, datetime(2024, 1, 11, 1), cost=100.0),
        _order(3, datetime(2024, 2, 1), cost=200.0), _order(4, datetime(2024, 2, 1), asset="B"),
    ])
    gaps = history.with_days_since_prev(logs)
    assert rows(gaps.select("work_order_id", "days_since_prev_failure")) == [
        ("WO-1", None), ("WO-2", 10), ("WO-3", 21), ("WO-4", None)]
    assert rows(history.mtbf(logs)) == [("A", 15.5)]
    assert rows(history.mtbf_by_asset(logs)) == [("A", "Motor", "L1", 2, 15.5, 150.0, 3.0)]
    recent = history.maintenance_history(logs, 1)
    assert rows(recent.select("work_order_id", "days_since_prev_failure")) == [("WO-3", 21.0), ("WO-4", None)]


def test_fix_rates(spark):
    logs = _logs(spark, [_order(1, datetime(2024, 1, 1)), _order(2, datetime(2024, 1, 15), fixed=None),
                         _order(3, datetime(2024, 3, 1), fixed=False)])
    assert history.ftf_by_asset(logs).first().first_time_fix_rate_pct == 33.3
    assert history.ftf_derived(logs).first().ftf_rate_pct == 66.7


@pytest.mark.parametrize("months_ago, due", [(17, False), (19, True)])
def test_bearing_due_after_18_months(spark, months_ago, due):
    assets = spark.createDataFrame([("A", "Motor", 1, date(2015, 1, 1))],
                                   "asset_id string, asset_type string, criticality_tier int, installation_date date")
    now = F.lit(datetime(2024, 6, 1)).cast("timestamp")
    done = spark.range(1).select(F.add_months(F.to_date(now), -months_ago).cast("timestamp")).first()[0]
    logs = _logs(spark, [_order(1, done)])
    rule = [("Motor", "Bearing replacement", "bearing", 1, 18)]
    assert (maintenance.pm_due(assets, logs, now, 0, rule).count() == 1) is due


def test_jobs_within_30_days_are_combined(spark):
    due = spark.createDataFrame(
        [("A", "x", date(2024, 1, 1)), ("A", "y", date(2024, 1, 31)), ("A", "z", date(2024, 3, 2))],
        "asset_id string, task string, due_date date")
    assert rows(maintenance.pm_combine(due).select("task_count", "tasks")) == [(1, "z"), (2, "x, y")]


def test_stop_rules(spark):
    silver = spark.createDataFrame([
        ("A", "Motor", 1, 5.0, 10.0, 50.0, 100.0), ("B", "Motor", 2, 10.2, 10.0, 50.0, 100.0),
        ("C", "Compressor", 2, 9.1, 10.0, 50.0, 100.0), ("D", "Pump", 2, 10.1, 10.0, 70.0, 100.0),
        ("E", "Turbine", 1, 10.1, 10.0, 50.0, 100.0), ("F", "HVAC", 3, 99.0, 10.0, 50.0, 100.0),
    ], "asset_id string, asset_type string, criticality_tier int, vibration_mm_s double, rated_max_vibration double, "
       "temp_c double, rated_max_temp double")
    health = spark.createDataFrame([("A", 15.0)], "asset_id string, health_score double")
    assert rows(maintenance.stop_conditions(silver, health).select("asset_id")) == [("A",), ("C",), ("E",)]


def test_chunks(spark):
    text = "# Pump Seal\nIntro.\n\n## 1. Purpose\nDon't skip.\n### Detail\nx\n## 2. Steps\nDo it.\n"
    docs = spark.createDataFrame([("pump_seal", text), ("plain", "no heading\n## Last ")], "manual_name string, text string")
    got = {r.chunk_id: r for r in search.chunk(docs).collect()}
    assert {k: r.section for k, r in got.items()} == {
        "pump_seal_0": "Pump Seal", "pump_seal_1": "1. Purpose", "pump_seal_2": "2. Steps",
        "plain_0": "section_0", "plain_1": "Last"}
    assert "### Detail" in got["pump_seal_1"].content and got["pump_seal_2"].score == 1.0


def test_text_search(spark):
    chunks = spark.createDataFrame(
        [(f"c{i}", "m", "s", text, 1.0) for i, text in enumerate(
            ["Don't skip the SEAL", "a 50 percent load", "seal twice: seal", "other"])], S.MANUAL_CHUNKS)
    got = search.search_manuals(chunks, ["seal", "don't", "5%load", "nothing"], 5).select("query", "chunk_id", "rank")
    assert {tuple(r) for r in got.collect()} == {
        ("5%load", "c1", 1), ("don't", "c0", 1), ("seal", "c0", 1), ("seal", "c2", 2)}


def test_pattern_search_always_adds_bearing_faults(spark):
    logs = _logs(spark, [
        _order(1, AT, fault="Overheating", part=None, cost=500.0), _order(2, AT, fault="Seal leak", cost=900.0),
        _order(3, AT, cost=100.0, fixed=False)])
    got = search.search_failure_patterns(logs, ["overheat"], 5).orderBy("rank").collect()
    assert [r.pattern_id for r in got] == ["WO-1", "WO-3"]
    assert got[0].symptom_description == "Overheating on A — vibration-related: NO, downtime: 3.0h"
    assert got[1].resolution == "Part replaced: Drive bearing. Cost: $100.0. First-time fix: false. Downtime: 3.0h"
    assert got[0].resolution.startswith("Part replaced: unspecified")


def test_vector_search_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    data, q = rng.normal(size=(200, 8)), rng.normal(size=8)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "vec_id long, embedding array<float>")
    best = np.argsort(-(data @ q) / np.linalg.norm(data, axis=1))[:5]
    got = search.vector_top_k(df, {"q": [float(x) for x in q]}, 5).orderBy("rank")
    assert [r.vec_id for r in got.collect()] == list(best)


def test_signals_map_to_one_asset(spark):
    signals = spark.createDataFrame([(1, "L1"), (1, "L1"), (2, "L9")], "signal_id int, production_line_id string")
    assets = spark.createDataFrame([("A", "L1", 2), ("B", "L1", 1)], "asset_id string, production_line_id string, criticality_tier int")
    got = enrich.map_signals(signals, assets, ["production_line_id"])
    assert rows(got.select("signal_id", "mapped_asset_id")) == [(1, "B"), (2, None)]


def test_chat_requests(spark):
    turns = spark.createDataFrame([(1, 1, "assistant", "hello"), (1, 0, "user", "hi")],
                                  "conv_id int, turn int, role string, text string")
    got = dossier.chat_requests(turns).first()
    assert [m.content for m in got.messages] == ["hi", "hello"] and got.last_reply == "hello"
    assert tuple(dossier.last_replies(turns).first()) == (1, 2, "assistant", "hello")


def test_floor_map_per_line(spark):
    health = spark.createDataFrame([("L1", "A", 50.0, "HIGH"), ("L1", "B", 20.0, "CRITICAL")],
                                   "production_line_id string, asset_id string, health_score double, risk_level string")
    assert [a.asset_id for a in reports.floor_map_lines(health).first().assets] == ["B", "A"]


def test_reports_are_named(spark):
    logs = _logs(spark, [_order(1, datetime(2024, 1, 1)), _order(2, datetime(2024, 1, 15))])
    assert reports.run_report("mtbf", {"logs": logs}).first().mtbf_days == 14.0
    assert len(reports.REPORTS) == 8


@pytest.mark.parametrize("value, vibration, heat", [
    (-1.0, "Normal", "Normal"), (2.5, "Watch", "Normal"), (4.0, "Watch", "Normal"), (6.5, "Warning", "Normal"), (8.5, "Alarm", "Normal"),
    (8.6, "Critical", "Normal"), (65.0, "Critical", "Warning"), (80.0, "Critical", "Warning"), (85.0, "Critical", None), (85.1, "Critical", "Alarm"),
])
def test_alarm_bands(spark, value, vibration, heat):
    df = enrich.band_lookup(spark.createDataFrame([(value,)], "x double"), "x", S.VIBRATION_ALARMS)
    got = enrich.band_lookup(df, "x", S.TEMPERATURE_ALARMS, "heat").first()
    assert (got.alarm_level, got.heat) == (vibration, heat)


BANDS = [("Low", None, 1.0), ("Fair", 1.0, 2.0), ("Good", 2.0, 3.0), ("High", 5.0, 8.0), ("Top", 8.0, None)]


def test_bands_from_a_table(spark):
    labels = [
        (None, None), (-1e300, "Low"), (0.9, "Low"), (1.0, "Fair"), (2.0, "Fair"), (2.1, "Good"), (3.0, "Good"), (4.0, None), (5.0, "High"),
        (8.0, "High"), (8.1, "Top"), (float("inf"), "Top"), (float("nan"), "Top"),
    ]
    schema = "asset_id string, band string, low double, high double"
    bands = spark.createDataFrame([(key, *band) for key in ("A", None) for band in reversed(BANDS)] + [("Z", "all", None, None)], schema)
    df = spark.createDataFrame([(key, value, i, "x") for key in ("A", None, "B", "Z") for i, (value, _) in enumerate(labels)],
                               "asset_id string, value double, passed int, band string")
    got = {(r.asset_id, r.passed): r.alarm_level for r in enrich.band_table_lookup(df, "value", bands).collect()}
    for i, (value, label) in enumerate(labels):
        assert [got[key, i] for key in ("A", None, "B", "Z")] == [label, label, None, None if value is None else "all"]
    assert {r.passed: r.alarm_level for r in enrich.band_lookup(df, "value", BANDS).collect()} == {i: label for i, (_, label) in enumerate(labels)}
    assert enrich.band_table_lookup(df, "value", bands.limit(0)).filter("alarm_level IS NULL").count() == df.count()


def test_many_classes_of_bands(spark):
    """100,000 classes of three bands, and one class of 50,000; no range join."""
    bands = spark.range(100_000).selectExpr("id AS asset_id", """inline(array(
        struct('low' AS band, CAST(NULL AS DOUBLE) AS low, CAST(id AS DOUBLE) AS high),
        struct('mid' AS band, CAST(id AS DOUBLE) AS low, id + 1D AS high), struct('top' AS band, id + 1D AS low, CAST(NULL AS DOUBLE) AS high)))""")
    fine = spark.range(50_000).selectExpr("-1L AS asset_id", "CAST(id AS STRING) AS band", "id * 2D AS low", "id * 2 + 1D AS high")
    df = spark.range(100_000).selectExpr("id AS asset_id", "id + (id % 3 - 1) * 2D AS v").union(
        spark.range(100_000).selectExpr("-1L AS asset_id", "id + 0.5D AS v"))
    got = enrich.band_table_lookup(df, "v", bands.union(fine))
    wrong = got.filter(
        "NOT alarm_level <=> if(asset_id >= 0, element_at(array('low', 'mid', 'top'), CAST(asset_id % 3 + 1 AS INT)),"
        " if(floor(v) % 2 = 0, CAST(CAST(floor(v) / 2 AS BIGINT) AS STRING), NULL))")
    assert got.count() == 200_000 and wrong.isEmpty()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_no_fix_rate_without_flags(spark):
    logs = spark.createDataFrame([("A", None), ("B", True), ("B", None)], "asset_id string, first_time_fix boolean").selectExpr(
        "*", "1.0D AS cost_to_fix", "1.0D AS downtime_hours", "1.0D AS labor_hours")
    assert rows(history.repair_averages(logs).select("asset_id", "first_time_fix_rate")) == [("A", None), ("B", 50.0)]


@pytest.mark.parametrize("heat, found", [([20.0, 21.0], 1), ([50.0, 50.0], 0), ([20.0], 0), ([20.0] * 4, 0), ([10.0, 10.0], 0)])
def test_thermal_spikes_have_limits(spark, heat, found):
    temps = [50.0] * 14 + [50.0 + h for h in heat] + [50.0] * 3
    df = spark.createDataFrame([(i, "A", t, False) for i, t in enumerate(temps)], "s long, asset_id string, temp_c double, vibration_anomaly_flag boolean")
    assert runs.thermal_spikes(df.withColumn("timestamp", F.timestamp_seconds("s"))).count() == found


def test_search_of_a_table_of_queries_equals_the_scan(spark):
    """Every kind of query: wildcards, short ones, other case, none, one that nothing holds."""
    words = ["Seal", "license", "Über", "a_b", "100%", "bearing", "x", "日本語", "the the", "tab\tend"]
    rng = random.Random(3)
    data = [(f"c{i}", "m", rng.choice(words) if i % 3 else None, " ".join(rng.choices(words, k=rng.randrange(6))), float(i % 4)) for i in range(300)]
    chunks = spark.createDataFrame(data, S.MANUAL_CHUNKS)
    queries = ["seal", "LICENSE", "über", "a_b", "a%b", "0%", "x", "日本", "e t", "%", "", "nothing here", "s_al l", "b\te"]
    table = spark.createDataFrame([(q,) for q in [*queries, "seal", None]], "query string")
    got = text_index.search_manuals(chunks, table, 4)
    want = search.search_manuals(chunks, queries, 4)
    assert rows(got.select("query", "rank", "chunk_id")) == rows(want.select("query", "rank", "chunk_id"))
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert text_index.search_manuals(chunks, table.limit(0)).isEmpty() and text_index.search_manuals(chunks.limit(0), table).isEmpty()


@pytest.mark.parametrize("few", [500, 2])
def test_table_search_makes_no_row_per_run_of_a_text(spark, monkeypatch, few):
    """Probes at every place of a text, short ones one by one or by runs; what leaves the scan is near the hits."""
    monkeypatch.setattr(text_index, "FEW", few)
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcÄ 日", k=rng.randrange(400))) for _ in range(60)] + ["abcabcabc", "abcabcab", "\U0001f600bcabcabc"]
    chunks = spark.createDataFrame([(f"c{i}", "m", rng.choice(["ab", None]), t, float(i % 3)) for i, t in enumerate(texts)], S.MANUAL_CHUNKS)
    cut = [t[i:i + n] for t in texts[:25] for n in (1, 2, 3, 4, 5, 8, 9, 10, 13, 20) if (i := rng.randrange(len(t) + 1)) + n <= len(t)]
    queries = sorted({*cut, *texts[-3:], "abcabc_bc", "a%c 日a", "\uffffabcabcab", "\uffff\uffffabc"})
    table = spark.createDataFrame([(q,) for q in queries], "query string")
    got, want = text_index.search_manuals(chunks, table, 4), search.search_manuals(chunks, queries, 4)
    assert rows(got.select("query", "rank", "chunk_id")) == rows(want.select("query", "rank", "chunk_id"))
    long = table.filter("length(query) = 9 AND query NOT LIKE '%\\_%'")
    found = text_index._hits(chunks, "chunk_id", ["content", "section"], long).count()
    assert found <= 2 * text_index.gram_pairs(chunks, "chunk_id", ["content", "section"], long).count()


def test_table_search_keeps_the_best_only(spark):
    """Of thousands of texts that hold a query, k of each task leave the scan; a text that holds it twice, or twice in the table, has one place."""
    chunks = spark.createDataFrame([(f"c{i % 900}", "m", None if i % 2 else "pump seal", f"pump seal no {i % 900} is a pump seal", float(i % 900 % 3)) for i in range(1800)], S.MANUAL_CHUNKS)
    queries = ["pump seal", "seal", "p%seal", "%", "pump seal no 17 is", "nothing"]
    table = spark.createDataFrame([(q,) for q in queries], "query string")
    best = text_index.gram_pairs(chunks, "chunk_id", ["content", "section"], table, (4, "score"))
    assert sorted(c for c, in rows(best.filter("query = 'seal'").select("chunk_id"))) == ["c101", "c104", "c107", "c11"]
    assert best.count() == 17
    got, want = text_index.search_manuals(chunks, table, 4), search.search_manuals(chunks.distinct(), queries, 4)
    assert {(r.query, r.chunk_id) for r in got.collect()} <= {(r.query, r.chunk_id) for r in want.collect()}


def test_table_search_of_texts_that_are_null(spark):
    chunks = spark.createDataFrame([("c0", "m", None, None, 1.0), ("c1", "m", None, "", 1.0), ("c2", "m", "a", None, 1.0)], S.MANUAL_CHUNKS)
    got = text_index.gram_pairs(chunks, "chunk_id", ["content", "section"], spark.createDataFrame([("%",), ("a",)], "query string"))
    assert rows(got) == [("%", "c1"), ("%", "c2"), ("a", "c2")]


def test_wildcards_of_a_table_of_queries_end_on_long_texts(spark):
    """LIKE would try every place of a part with every place of the others."""
    texts = ["or, x_y\\ " * 6000, "or, " * 3000 + "or,a fr", "fr or,", "5% off"]
    chunks = spark.createDataFrame([(f"c{i}", "m", None, t, 1.0) for i, t in enumerate(texts)], S.MANUAL_CHUNKS)
    want = {"or,%%% fr": [1], "o%r%o%r%_%a": [1], "%_%_%zz%": [], "fr%or": [2], "5\\%": [3], "x\\_y\\\\": [0], "or,_ fr": [1], ",_ fr": [1], ",a_fr": [1], "r,%[a-z]": []}
    got = text_index.gram_pairs(chunks, "chunk_id", ["content", "section"], spark.createDataFrame([(q,) for q in want], "query string"))
    assert rows(got) == sorted((q, f"c{i}") for q, found in want.items() for i in found)


def test_failure_patterns_of_a_table_of_queries(spark):
    rng = random.Random(4)
    faults = ["Bearing failure", "Overheating", "Seal leak", "belt wear", "VIBRATION", None, "gear belt"]
    logs = spark.createDataFrame(
        [(f"WO-{i}", "A", datetime(2024, 1, 1), rng.choice(faults), None, float(rng.randrange(50)), True, 1.0) for i in range(200)],
        "work_order_id string, asset_id string, timestamp timestamp, fault_type string, part_replaced string, cost_to_fix double, "
        "first_time_fix boolean, downtime_hours double")
    queries = ["belt", "seal", "heat", "nothing", "e%r", "bearing"]
    got = text_index.search_failure_patterns(logs, spark.createDataFrame([(q,) for q in queries], "query string"), 6)
    assert rows(got) == rows(search.search_failure_patterns(logs, queries, 6).select(*got.columns))
