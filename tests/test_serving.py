"""Serving tables: upsert, alerts, recommendations, ids, files, SQL functions."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import rows
from rotorwatch import schemas as S
from rotorwatch.functions.catalog import register_functions
from rotorwatch.operators import search, serving
from rotorwatch.plans import gold, registry
from rotorwatch.sources import files
from rotorwatch.sources.serving_log import KeyedTable, ServingLog
from rotorwatch.sources.snapshots import Snapshot, materialize, replace_days

NOW = datetime(2024, 1, 1, 12)
RECORDS = ("asset_id string, health_score double, risk_level string, current_vibration double, current_temp double, "
           "rated_max_vibration double, estimated_rul_hours double, production_line_id string, criticality_tier int, "
           "calculated_at timestamp, cost_of_unplanned_failure double, net_recommendation string")


def _now(hours=0):
    return F.lit(NOW + timedelta(hours=hours)).cast("timestamp")


def _records(spark, *levels, at=NOW):
    data = [(a, s, r, 1.0, 2.0, 3.0, 2.0, "L1", 1, at, 100.0, "SCHEDULE_IMMEDIATE") for a, s, r in levels]
    return spark.createDataFrame(data, RECORDS)


def test_upsert_new_changed_unchanged_replayed(spark):
    target = spark.createDataFrame([(1, "old"), (2, "same")], "k int, v string")
    updates = spark.createDataFrame([(1, "new", 2), (1, "stale", 1), (3, "added", 1)], "k int, v string, version int")
    once = serving.upsert(target, updates, ["k"], "version")
    assert rows(once) == [(1, "new"), (2, "same"), (3, "added")]
    assert rows(serving.upsert(once, updates, ["k"], "version")) == rows(once)


@pytest.mark.parametrize("age_minutes, status, raised", [
    (59, "ACTIVE", False), (60, "ACTIVE", True), (61, "ACTIVE", True), (5, "RESOLVED", True),
])
def test_alert_suppression(spark, age_minutes, status, raised):
    existing = spark.createDataFrame(
        [("A", status, NOW - timedelta(minutes=age_minutes))], "asset_id string, status string, detection_timestamp timestamp")
    new = serving.new_disruptions(_records(spark, ("A", 10.0, "CRITICAL"), ("B", 90.0, "LOW")), existing, _now())
    got = new.collect()
    assert bool(got) is raised
    if raised:
        assert (got[0].asset_id, got[0].estimated_downtime_cost, got[0].status) == ("A", 200.0, "ACTIVE")


def test_severity_order(spark):
    alerts = spark.createDataFrame(
        [(1, "A", "CRITICAL", NOW), (2, "B", "HIGH", NOW + timedelta(hours=1))],
        "disruption_id int, asset_id string, risk_level string, detection_timestamp timestamp",
    ).withColumns({c: F.lit(None) for c in (
        "impacted_line_id", "estimated_rul_hours", "estimated_downtime_cost", "recommended_action")}
    ).withColumn("status", F.lit("ACTIVE"))
    assert [r.disruption_id for r in serving.active_alerts(alerts).collect()] == [1, 2]
    assert [r.disruption_id for r in serving.active_alerts(alerts, text_order=True).collect()] == [2, 1]


def test_serial_ids_have_no_gaps(spark):
    df = spark.range(5000).repartition(7)
    ids = [r.n for r in serving.with_serial_id(df, ["id"], 11, "n").collect()]
    assert sorted(ids) == list(range(11, 5011))
    again = rows(serving.with_serial_id(df.repartition(3), ["id"], 11, "n"))
    assert again == rows(serving.with_serial_id(df, ["id"], 11, "n"))


def test_sync_is_idempotent_and_counts_ids_on(spark, folder):
    tables = ServingLog(spark, folder)
    tables.sync(_records(spark, ("A", 10.0, "CRITICAL"), ("B", 90.0, "LOW")), _now(), 1)
    tables.sync(_records(spark, ("B", 40.0, "HIGH"), ("C", 20.0, "CRITICAL")), _now(1), 2)
    first = rows(tables.alerts().select("disruption_id", "asset_id"))
    live = rows(tables.live.read())
    assert sorted(i for i, _ in first) == [1, 2, 3]
    tables.sync(_records(spark, ("B", 40.0, "HIGH"), ("C", 20.0, "CRITICAL")), _now(1), 2)
    assert rows(tables.alerts().select("disruption_id", "asset_id")) == first
    assert rows(tables.live.read()) == live and len(live) == 3


def test_nothing_is_lost_between_batches(spark, folder):
    """Status changes, additions and resets between batches all stay, whoever writes last."""
    tables = ServingLog(spark, folder)
    tables.sync(_records(spark, ("A", 10.0, "CRITICAL")), _now(), 0)
    changes = spark.createDataFrame([(1, "RESOLVED", "kim")], "disruption_id int, new_status string, changed_by string")
    tables.set_alert_status(changes, _now(1))
    tables.sync(_records(spark, ("B", 20.0, "CRITICAL"), at=NOW + timedelta(hours=2)), _now(2), 1)
    assert rows(tables.alerts().select("disruption_id", "status")) == [(1, "RESOLVED"), (2, "ACTIVE")]
    tables.reset()
    tables.reset()
    tables.sync(_records(spark, ("B", 20.0, "CRITICAL"), at=NOW + timedelta(hours=2)), _now(2), 1)  # applied before
    assert tables.alerts().isEmpty()
    tables.sync(_records(spark, ("C", 20.0, "CRITICAL"), at=NOW + timedelta(hours=9)), _now(9), 2)
    assert rows(tables.alerts().select("asset_id")) == [("C",)]
    assert sorted(r.asset_id for r in tables.live.read().collect()) == ["A", "B", "C"]


def test_alerts_are_written_once(spark, folder):
    """Status changes and resets add rows of their own; files of alerts stay as they are."""
    tables = ServingLog(spark, folder, 4)
    tables.sync(_records(spark, ("A", 10.0, "CRITICAL"), ("B", 10.0, "HIGH")), _now(), 0)
    files_before = set(spark.read.parquet(f"{folder}/alerts/batch=0").inputFiles())
    for status, hour in (("ACKNOWLEDGED", 1), ("RESOLVED", 2), ("ACKNOWLEDGED", 3)):
        tables.set_alert_status(spark.createDataFrame([(1, status, f"by{hour}")], "disruption_id int, new_status string, changed_by string"), _now(hour))
    tables.set_alert_status(spark.createDataFrame([(2, s, "x") for s in ("RESOLVED", "ACTIVE")], "disruption_id int, new_status string, changed_by string"), _now(1))
    got = rows(tables.alerts().select("disruption_id", "status", "resolved_by", "resolved_at"))
    assert got == [(1, "ACKNOWLEDGED", "by2", NOW + timedelta(hours=2)), (2, "RESOLVED", "x", NOW + timedelta(hours=1))]
    assert set(spark.read.parquet(f"{folder}/alerts/batch=0").inputFiles()) == files_before


def test_broken_batch_goes_on(spark, folder, monkeypatch):
    """A batch that fails between alerts and live health raises its transitions once, when it is run again."""
    tables, kw = ServingLog(spark, folder, 4), {"only_transitions": True, "gap_hours": 0}
    records = _records(spark, ("A", 10.0, "CRITICAL"))
    real = KeyedTable.upsert

    def fails_after(self, *args, **kwargs):
        real(self, *args, **kwargs)
        raise RuntimeError("lost")

    monkeypatch.setattr(KeyedTable, "upsert", fails_after)
    with pytest.raises(RuntimeError, match="lost"):
        tables.sync(records, _now(), 0, **kw)
    monkeypatch.setattr(KeyedTable, "upsert", real)
    tables.sync(records, _now(5), 0, **kw)
    assert rows(tables.alerts().select("asset_id", "detection_timestamp")) == [("A", NOW)]
    assert tables.live.read().count() == 1


def test_reset_of_an_empty_store(spark, folder):
    tables = ServingLog(spark, folder, 4)
    tables.reset()
    tables.sync(_records(spark, ("A", 10.0, "CRITICAL")), _now())
    assert tables.alerts().count() == 1


def test_keyed_table_replaces_touched_folders_only(spark, folder):
    schema = spark.createDataFrame([], "k long, v string").schema
    table = KeyedTable(spark, folder, schema, ["k"], 16)
    table.upsert(spark.range(1000).selectExpr("id AS k", "'old' AS v"))
    before = set(spark.read.parquet(f"{folder}/rows").inputFiles())
    table.upsert(spark.createDataFrame([(7, "new"), (7, "new"), (5000, "new")], "k long, v string"))
    after = set(spark.read.parquet(f"{folder}/rows").inputFiles())
    assert rows(table.read().groupBy("v").count()) == [("new", 2), ("old", 999)]
    assert 14 <= len({f.split("bucket=")[1].split("/")[0] for f in before & after}) < 16
    assert "PartitionFilters: [isnotnull(bucket" in table.touched(spark.read.schema(table.stored).parquet(f"{folder}/staged"))._jdf.queryExecution().toString() or (
        "PartitionFilters: [bucket" in table.touched(spark.read.schema(table.stored).parquet(f"{folder}/staged"))._jdf.queryExecution().toString())
    table.upsert(spark.createDataFrame([(7, "new"), (5000, "new")], "k long, v string"))
    assert rows(table.read().groupBy("v").count()) == [("new", 2), ("old", 999)]
    table.upsert(spark.createDataFrame([], schema))
    assert table.read().count() == 1001


def test_short_gap(spark, folder):
    """An alert a quarter of an hour old holds back another for half an hour."""
    tables = ServingLog(spark, folder)
    tables.sync(_records(spark, ("A", 10.0, "CRITICAL")), _now(), 0, 0.5)
    quarter = NOW + timedelta(minutes=15)
    tables.sync(_records(spark, ("A", 10.0, "CRITICAL"), at=quarter), F.lit(quarter), 1, 0.5)
    assert tables.alerts().count() == 1
    later = NOW + timedelta(minutes=31)
    tables.sync(_records(spark, ("A", 10.0, "CRITICAL"), at=later), F.lit(later), 2, 0.5)
    assert tables.alerts().count() == 2


def test_alert_only_on_transition(spark, folder):
    tables = ServingLog(spark, folder)
    kw = {"only_transitions": True, "gap_hours": 0}
    tables.sync(_records(spark, ("A", 10.0, "CRITICAL")), _now(), 1, **kw)
    later = NOW + timedelta(hours=5)
    tables.sync(_records(spark, ("A", 9.0, "CRITICAL"), ("B", 50.0, "HIGH"), at=later), _now(5), 2, **kw)
    assert rows(tables.alerts().select("asset_id")) == [("A",), ("B",)]


def test_status_recommendations_and_reset(spark, folder):
    tables = ServingLog(spark, folder)
    tables.sync(_records(spark, ("A", 10.0, "CRITICAL")), _now())
    changes = spark.createDataFrame([(1, "RESOLVED", "kim")], "disruption_id int, new_status string, changed_by string")
    tables.set_alert_status(changes, _now(1))
    alert = tables.alerts().first()
    assert (alert.status, alert.resolved_by, alert.resolved_at) == ("RESOLVED", "kim", NOW + timedelta(hours=1))
    recs = spark.createDataFrame(
        [("A", "swap bearing", 1.0, 2.0, 3.0, "MONITOR", ["c1"], None), ("Z", "x", 1.0, 2.0, 3.0, "MONITOR", None, None)],
        "asset_id string, recommendation_text string, cost_to_fix double, cost_of_downtime double, urgency_hours double, "
        "net_recommendation string, vector_search_sources array<string>, manual_references array<string>")
    tables.recommend(recs, _now())
    tables.recommend(recs, _now(1))
    saved = tables.recommendations()
    assert rows(saved.select("rec_id", "asset_id", "health_score_at_time", "manual_references")) == [
        (1, "A", 10.0, []), (2, "A", 10.0, [])]
    assert serving.confirmation(saved).filter("rec_id = 2").first().message == "Recommendation REC-00002 saved for A"
    chunks = spark.createDataFrame([("c1", "m", "s", "text", 1.0)], S.MANUAL_CHUNKS)
    assert search.provenance(saved, chunks).filter("content = 'text'").count() == 2
    assert rows(serving.recent_recs(saved, 1).select("rec_id")) == [(2,)]
    tables.reset()
    assert tables.alerts().isEmpty() and tables.recommendations().isEmpty()
    assert tables.live.read().count() == 1


def test_snapshot_ignores_unfinished_versions(spark, folder):
    table = materialize(spark.range(3).withColumn("x", F.lit(1)), f"{folder}/t")
    (spark.range(9).withColumn("x", F.lit(1)).write
     .option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{folder}/t/v000000000002"))
    assert table.read().count() == 3
    table.publish(table.read().filter("id > 0"))
    assert table.versions() == [1, 2] and table.read().count() == 2
    assert Snapshot(spark, f"{folder}/none", table.schema).read().isEmpty()


def test_point_health(spark):
    live = serving.live_health(_records(spark, ("A", 75.0, "MEDIUM")), _now())
    ids = spark.createDataFrame([("A",), ("Z",)], "asset_id string")
    got = dict(rows(serving.point_health(ids, live)))
    assert '"health_score":75.0' in got["A"] and '"last_updated":"2024-01-01 12:00:00"' in got["A"]
    assert got["Z"] == '{"error":"Asset \'Z\' not found in health database"}'


def test_sql_functions(spark):
    live = serving.live_health(_records(spark, ("A", 75.0, "MEDIUM")), _now())
    cost = _records(spark, ("A", 75.0, "MEDIUM")).withColumn("avg_cost_to_fix", F.lit(50.0))
    logs = spark.createDataFrame(
        [(f"WO-{i}", "A", NOW + timedelta(days=i * i), "Overheating", None, 10.0 * i, True, 1.0) for i in range(4)],
        "work_order_id string, asset_id string, timestamp timestamp, fault_type string, part_replaced string, "
        "cost_to_fix double, first_time_fix boolean, downtime_hours double")
    chunks = spark.createDataFrame([("c1", "m", "Seals", "text", 1.0)], S.MANUAL_CHUNKS)
    names = register_functions(spark, live, chunks, logs, cost)
    assert len(names) == 5
    assert '"risk_level":"MEDIUM"' in spark.sql("SELECT get_asset_health('A') AS h").first().h
    assert "not found" in spark.sql("SELECT get_asset_health(asset_id => 'Q') AS h").first().h
    assert spark.sql("SELECT * FROM search_manuals('seal')").first().chunk_id == "c1"
    assert [r.pattern_id for r in spark.sql("SELECT * FROM search_failure_patterns('HEAT')").collect()] == [
        "WO-3", "WO-2", "WO-1", "WO-0"]
    impact = spark.sql("SELECT * FROM calculate_cost_impact('A', 1.0D)").first()
    assert (impact.cost_to_fix_planned, impact.savings_by_acting_now) == (115.0, -15.0)
    recent = spark.sql("SELECT work_order_id, days_since_prev_failure FROM get_maintenance_history('A', 2)")
    assert rows(recent) == [("WO-2", 3.0), ("WO-3", 5.0)]


def test_readers(spark, folder):
    (spark.createDataFrame([("A,Motor,M,2020-03-06,2021-03-06,Line_1,2,9.0,85.0,45000",)], "v string").coalesce(1)
     .write.text(f"{folder}/assets"))
    got = files.read_asset_metadata(spark.newSession(), f"{folder}/assets")
    assert got.schema == S.ASSET_METADATA
    open(f"{folder}/pump.md", "w").write("# Pump\nx")
    open(f"{folder}/note.txt", "w").write("not a manual")
    assert rows(files.read_manuals(spark, folder)) == [("pump", "# Pump\nx")]
    assert "pump.md" in [r.file_name for r in files.landing_manifest(spark, folder).collect()]


def test_tags(spark):
    for name, tags in (("gold_scores", {"critical_path": "true"}), ("bronze_rows", {"pii": "false"})):
        spark.range(1).write.mode("overwrite").saveAsTable(name)
        files.set_tags(spark, name, **tags)
    assert files.tables_with_tag(spark, "critical_path", "true") == ["gold_scores"]
    files.require_tables(spark, ["gold_scores"])


def test_only_touched_days_are_replaced(spark, folder):
    hours = spark.range(72).selectExpr("timestamp_seconds(1704067200 + id * 3600) AS hour_window", "id", "1 AS v")
    replace_days(hours, f"{folder}/t")
    replace_days(hours.filter("id >= 48").withColumn("v", F.lit(2)), f"{folder}/t")
    assert rows(spark.read.parquet(f"{folder}/t").groupBy("v").count()) == [(1, 48), (2, 24)]


def test_missing_tables(spark):
    with pytest.raises(LookupError, match="no_such_table"):
        files.require_tables(spark, ["no_such_table"])


def test_records_for_serving_make_health_once(spark, folder):
    """Health is a file to both sides of its join with cost; assets without orders keep empty figures."""
    spark.sql("SELECT id AS c_custkey, 'n' AS c_name, CAST(id % 2 AS INT) AS c_nationkey, 90.0D AS c_acctbal, 'MACHINERY' AS c_mktsegment FROM range(4)").write.parquet(f"{folder}/customer.parquet")
    spark.sql("SELECT id AS event_id, timestamp_seconds(1700000000 + id * 600)::timestamp_ntz AS ts, id % 4 AS user_id, 'view' AS event_type, 2.0D + id % 3 AS value, '{\"k\": 7}' AS props FROM range(40)").write.parquet(f"{folder}/events.parquet")
    spark.sql("SELECT id AS o_orderkey, id % 3 AS o_custkey, 'F' AS o_orderstatus, 100.0D AS o_totalprice, timestamp_ntz'2023-01-01' AS o_orderdate, '1-URGENT' AS o_orderpriority FROM range(9)").write.parquet(f"{folder}/orders.parquet")
    spark.sql("SELECT CAST(id AS INT) AS n_nationkey FROM range(2)").write.parquet(f"{folder}/nation.parquet")
    tables = registry.Tables(spark, folder)
    records = registry._records(tables)
    want = rows(gold.health_with_cost(tables.health(), tables.cost()))
    assert rows(records) == want and len(want) == 4
    plan = records._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "hour_window" not in plan
