"""Streams over small files give what the batch operators give."""

import random
import time

import pytest
from pyspark.sql import functions as F

from conftest import rows
from rotorwatch import schemas as S
from rotorwatch.operators import enrich, serving, smoothing
from rotorwatch.sources import files
from rotorwatch.streaming import jobs, state

SCHEMA = "event_id long, timestamp timestamp, asset_id string, vibration_mm_s double, temp_c double"


def _readings(spark, n, seed=1):
    rng = random.Random(seed)
    data = [(i, rng.choice("AAABC"), round(rng.uniform(0, 9), 2), 50.0) for i in range(n)]
    df = spark.createDataFrame(data, "event_id long, asset_id string, vibration_mm_s double, temp_c double")
    times = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("event_id") * 300)
    return df.withColumn("timestamp", times).select("event_id", "timestamp", "asset_id", "vibration_mm_s", "temp_c")


def _land(df, folder, parts):
    """One file per time range, in order."""
    for low, high in parts:
        df.filter((F.col("event_id") >= low) & (F.col("event_id") < high)).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.02)


def _stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def _rolled(spark, folder, delay):
    stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
    rolled = state.rolling_stream(stream, {"vibration_mm_s": "m"}, delay, order=("timestamp", "event_id"))
    jobs.write_stream(rolled, f"{folder}/out", f"{folder}/cp").awaitTermination()
    return state.newest_issue(spark.read.parquet(f"{folder}/out"), ("timestamp", "event_id"))


def test_rolling_of_shuffled_deliveries_equals_batch(spark, folder):
    """Readings up to 100 minutes late, over runs that go on from the checkpoint; null values and times included."""
    df = _readings(spark, 300).withColumn("vibration_mm_s", F.when(F.col("event_id") % 17 > 0, F.col("vibration_mm_s")))
    df = df.withColumn("timestamp", F.when(F.col("event_id") != 3, F.col("timestamp")))
    part = F.floor((F.col("event_id") + F.pmod(F.xxhash64("event_id"), F.lit(20))) / 100)
    for i in range(4):
        df.filter(part == i).write.mode("append").parquet(f"{folder}/in")
        got = _rolled(spark, folder, "2 hours")
    batch = smoothing.rolling_mean(df, {"vibration_mm_s": "m"}, order=["timestamp", "event_id"])
    assert rows(got.select("event_id", F.round("m", 9))) == rows(batch.select("event_id", F.round("m", 9)))
    assert got.filter("late").isEmpty() and spark.read.parquet(f"{folder}/out").count() > 300


def test_rolling_keeps_rows_that_are_too_late(spark, folder):
    df = _readings(spark, 120).withColumn("asset_id", F.lit("A"))
    for low, high in ((60, 120), (0, 60)):
        df.filter((F.col("event_id") >= low) & (F.col("event_id") < high)).write.mode("append").parquet(f"{folder}/in")
        got = _rolled(spark, folder, "10 minutes")
    assert rows(got.filter("late").select("event_id")) == rows(df.filter("event_id < 60").select("event_id")) and got.filter("late AND m IS NOT NULL").isEmpty()
    alone = smoothing.rolling_mean(df.filter("event_id >= 60"), {"vibration_mm_s": "m"}, order=["timestamp", "event_id"])
    assert rows(got.filter("NOT late").select("event_id", F.round("m", 9))) == rows(alone.select("event_id", F.round("m", 9)))


@pytest.mark.parametrize("forget_after", [None, "20 hours"])
def test_risk_entries_of_shuffled_deliveries_equal_batch(spark, folder, forget_after):
    rng = random.Random(4)
    data = [(i, rng.choice("AAB") if i < 150 else "A", rng.choice(["LOW", "HIGH", "CRITICAL", "UNKNOWN", None])) for i in range(200)] + [(199, "C", "HIGH")]
    times = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("i") * 3600)
    df = spark.createDataFrame(data, "i long, asset_id string, risk_level string").withColumn("calculated_at", times)
    end = spark.createDataFrame([(None, 1_800_000_000, "LOW")], "asset_id string, s long, risk_level string").withColumn("calculated_at", F.timestamp_seconds("s"))
    part = F.floor((F.col("i") + F.pmod(F.xxhash64("i"), F.lit(8))) / 70)
    columns = ["asset_id", "calculated_at", "risk_level"]
    for piece in [df.filter(part == i) for i in range(3)] + [end]:
        piece.select(*columns).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(df.select(*columns).schema).parquet(f"{folder}/in")
        jobs.write_stream(state.risk_entries_stream(stream, "9 hours", forget_after), f"{folder}/out", f"{folder}/cp").awaitTermination()
    got = spark.read.parquet(f"{folder}/out")
    assert rows(got.select("asset_id", "calculated_at", "risk_level", "previous_risk")) == rows(
        serving.risk_changes(df.select(*columns)).select("asset_id", "calculated_at", "risk_level", "previous_risk"))


def test_csv_to_silver(spark, folder):
    columns = [(F.col(f.name) if f.name in ("timestamp", "asset_id", "vibration_mm_s", "temp_c") else F.lit(None))
               .cast(f.dataType).alias(f.name) for f in S.SENSOR_READINGS]
    df = _readings(spark, 50)
    df.select(*columns).write.option("header", True).csv(f"{folder}/in")
    meta = spark.createDataFrame([("A", "Motor", "L1", 1, 5.0, 60.0)],
                                 "asset_id string, asset_type string, production_line_id string, criticality_tier int, "
                                 "rated_max_vibration double, rated_max_temp double")
    stream = files.stream_sensor_readings(spark, f"{folder}/in", "*.csv")
    query = jobs.run_silver_stream(stream, meta, f"{folder}/silver", f"{folder}/cp")
    query.awaitTermination()
    counts = query.recentProgress[0].observedMetrics["valid_asset_id"]
    assert (counts.passed, counts.failed) == (50, 0)
    got = spark.read.parquet(f"{folder}/silver")
    batch = enrich.silver_sensor_readings(df, meta)
    pick = ["timestamp", "asset_id", "vibration_mm_s", "vibration_anomaly_flag", "rated_max_vibration"]
    assert rows(got.select(*pick)) == rows(batch.select(*pick)) and len(got.columns) == 17
    assert got.filter("source_file IS NULL OR ingestion_time IS NULL").isEmpty()


def test_dedup_and_hourly_with_late_rows(spark, folder):
    df = _readings(spark, 200)
    _land(df, f"{folder}/in", [(0, 100), (100, 200), (150, 200), (0, 1)])
    once, late = jobs.dedup(_stream(spark, f"{folder}/in"), ["event_id"], "1 hour"), jobs.LateRows()
    spark.streams.addListener(late)
    query = jobs.write_stream(once, f"{folder}/once", f"{folder}/cp1")
    query.awaitTermination()
    assert spark.read.parquet(f"{folder}/once").count() == 200
    for _ in range(100):  # progress is reported a little later
        if late.dropped[str(query.id)]:
            break
        time.sleep(0.1)
    assert late.dropped[str(query.id)] == 1
    spark.streams.removeListener(late)
    flagged = _stream(spark, f"{folder}/in").withColumn("vibration_anomaly_flag", F.col("vibration_mm_s") > 5)
    query = jobs.write_stream(jobs.hourly_stream(flagged, "1 minute"), f"{folder}/hourly", f"{folder}/cp2")
    query.awaitTermination()
    got = spark.read.parquet(f"{folder}/hourly")
    assert got.groupBy("hour_window", "asset_id").count().filter("count > 1").isEmpty()
    assert got.filter("vibration_max > 5 AND anomaly_count = 0").isEmpty()
    whole = jobs.hourly_counts(df.withColumn("vibration_anomaly_flag", F.col("vibration_mm_s") > 5))
    closed = got.unionByName(jobs.open_hours(df.withColumn("vibration_anomaly_flag", F.col("vibration_mm_s") > 5), got))
    keys = ["hour_window", "asset_id"]
    assert not jobs.open_hours(df.withColumn("vibration_anomaly_flag", F.lit(True)), got).isEmpty()
    assert rows(closed.select(keys)) == rows(whole.select(keys))
