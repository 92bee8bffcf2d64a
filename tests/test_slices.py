"""Operators cut into slices must give what they give over whole histories."""

import random
import statistics
import time

import pytest
from pyspark.sql import Window, functions as F

from conftest import rows
from rotorwatch.operators import history, history_slices, runs, serving, smoothing, trends

HOT = {"min_hot_rows": 20}
PLAIN = {"min_hot_rows": 10**9}
ORDER = ["timestamp", "event_id"]


@pytest.fixture(scope="module")
def readings(spark):
    """Two busy assets with bursts, long gaps, repeated times and hours of a single reading,
    and several quiet ones."""
    rng, data, clock = random.Random(7), [], 1_700_000_000
    for i in range(900):
        clock += rng.choice([0, 5, 40, 600, 600, 3600, 9000, 90000])
        asset = rng.choice(["A", "A", "A", "B", "B", f"Q{i % 30}"])
        data.append((i, clock, asset, round(rng.uniform(0, 10), 2), float(rng.randint(40, 100)), rng.random() < 0.3))
    # a key without value and a time without value
    data.append((900, clock + 5, None, 1.0, 50.0, False))
    data.append((901, None, "A", 2.0, 51.0, False))
    schema = "event_id long, s long, asset_id string, vibration_mm_s double, temp_c double, vibration_anomaly_flag boolean"
    return spark.createDataFrame(data, schema).withColumn("timestamp", F.timestamp_seconds("s")).drop("s").cache()


def test_hot_keys_are_cut(readings):
    sliced = history_slices.with_slices(readings, "asset_id", ORDER, **HOT)
    per_key = {r[0]: r[1] for r in sliced.groupBy("asset_id").agg(F.count_distinct("_slice")).collect()}
    assert per_key["A"] > 10 and per_key["B"] > 10
    assert all(n == 1 for key, n in per_key.items() if key not in ("A", "B"))
    assert sliced.count() == readings.count()


@pytest.mark.parametrize("seconds", [
    "IF(id < 300, id * 400000, 40000000 + id)",  # a burst after a long quiet time
    "IF(id = 0, -1600000000, id)",  # one reading of a clock set to 1920
    "id % 3600",  # all in one full hour
    "CAST(NULL AS BIGINT)",  # no times at all
    "7",  # all at one moment
])
def test_slices_are_even_whatever_the_times(spark, seconds):
    df = spark.range(20000).selectExpr(
        "'A' AS asset_id", "id AS event_id", f"timestamp_seconds({seconds}) AS timestamp", "CAST(id * 7919 % 101 AS DOUBLE) AS temp_c")
    share = 1000
    sizes = [r["count"] for r in history_slices.with_slices(df, "asset_id", ORDER, min_hot_rows=share).groupBy("_slice").count().collect()]
    assert sum(sizes) == 20000 and len(sizes) > 20 and max(sizes) < 2 * share
    w = Window.partitionBy("asset_id").orderBy(*ORDER).rowsBetween(-4, 0)
    plain = df.select("event_id", F.avg("temp_c").over(w).alias("m"))
    sliced = smoothing.rolling_mean(df, {"temp_c": "m"}, 5, order=ORDER, min_hot_rows=share).select("event_id", "m")
    assert plain.exceptAll(sliced).isEmpty() and sliced.count() == 20000


@pytest.mark.parametrize("points", [2, 5, 12])
def test_rolling_mean_equals_plain_window(readings, points):
    w = Window.partitionBy("asset_id").orderBy(*ORDER).rowsBetween(1 - points, 0)
    plain = readings.select("event_id", F.avg("vibration_mm_s").over(w))
    sliced = smoothing.rolling_mean(readings, {"vibration_mm_s": "m"}, points, order=ORDER, **HOT)
    assert rows(sliced.select("event_id", "m")) == rows(plain)


@pytest.mark.parametrize("make", [
    lambda df, o: smoothing.ewma(df, "vibration_mm_s", 0.4, 6, order=ORDER, **o).select("event_id", F.round("ewma", 9)),
    lambda df, o: smoothing.rolling_median(df, "vibration_mm_s", 7, order=ORDER, **o).select("event_id", "rolling_median"),
    lambda df, o: smoothing.clip_outliers(df, "vibration_mm_s", 6, 1.0, order=ORDER, **o).select("event_id", F.round("clipped", 9)),
    lambda df, o: runs.consecutive_over(df, "temp_c", 55.0, 2, order=tuple(ORDER), **o),
    lambda df, o: runs.sustained_over(df, "temp_c", 45.0, 30, order=tuple(ORDER), **o),
    lambda df, o: runs.thermal_spikes(df, 10.0, 3, 5, tuple(ORDER), **o),
])
def test_sliced_equals_whole(readings, make):
    expected = rows(make(readings, PLAIN))
    assert expected and rows(make(readings, HOT)) == expected


def test_hourly_trends_and_rising_equal_whole(readings):
    silver = readings.withColumns({"production_line_id": F.lit("L"), "criticality_tier": F.lit(1)})
    plain = trends.hourly_trends(silver, tie_break=("event_id",), **PLAIN)
    sliced = trends.hourly_trends(silver, tie_break=("event_id",), **HOT)
    assert rows(sliced) == rows(plain)
    rising = [runs.rising_pct(plain, 1.0, 2, None, **o) for o in (PLAIN, HOT)]
    assert rows(rising[0]) and rows(rising[0]) == rows(rising[1])


@pytest.mark.parametrize("options", [PLAIN, HOT])
def test_hours_since_equal_the_whole_table(readings, options):
    silver = readings.filter("timestamp IS NOT NULL").withColumns(
        {"production_line_id": F.lit("L"), "criticality_tier": F.lit(1)})
    since = silver.agg(F.percentile_approx("timestamp", 0.7)).scalar()
    whole = trends.hourly_trends(silver, tie_break=("event_id",), **PLAIN)
    fresh = trends.hourly_trends_since(silver, since, tie_break=("event_id",), **options)
    assert rows(fresh) == rows(whole.filter(F.col("hour_window") >= F.date_trunc("hour", since)))


def test_long_runs_over_many_slices(spark):
    data = [(i, "A", 60.0 if i % 50 else 10.0) for i in range(400)]
    df = spark.createDataFrame(data, "event_id long, asset_id string, temp_c double").withColumn(
        "timestamp", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("event_id") * 600)
    )
    found = runs.consecutive_over(df, "temp_c", 50.0, 2, min_hot_rows=10)
    assert [r.run_length for r in found.collect()] == [49] * 8


def test_runs_read_and_shuffle_the_rows_once(spark, readings, folder):
    """One scan and one exchange of the rows, though inner runs, edges and heads of slices go apart."""
    readings.write.parquet(f"{folder}/all")
    readings.select("asset_id", *ORDER).write.parquet(f"{folder}/cuts")
    whole, cuts = spark.read.parquet(f"{folder}/all"), spark.read.parquet(f"{folder}/cuts")
    for make in (lambda o: runs.consecutive_over(whole, "temp_c", 55.0, 2, order=tuple(ORDER), rows=cuts, **o),
                 lambda o: runs.thermal_spikes(whole, 10.0, 3, 5, tuple(ORDER), rows=cuts, **o)):
        for options in (HOT, PLAIN):
            found = make(options)
            assert found.collect()
            plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
            assert sum("FileScan" in line and "/all" in line for line in plan.splitlines()) == 1
            assert ("ReusedExchange" in plan) == (options is HOT)


@pytest.mark.parametrize("reach, share", [(1, 3), (4, 20), (30, 3), (30, 200)])
def test_heads_of_slices_look_back(readings, reach, share):
    """Slices shorter than the look-back too."""
    mean = {"m": lambda w: F.avg("temp_c").over(w.rowsBetween(-reach, -1))}
    found = [rows(runs.runs(readings, F.col("temp_c") > F.col("m"), "temp_c", order=tuple(ORDER), derive=mean, reach=reach,
                            needs=("temp_c",), min_hot_rows=n)) for n in (share, 10**9)]
    assert found[0] == found[1] and len(found[1]) > 100


@pytest.mark.parametrize("points", [26, 101, 2000])
def test_long_medians_equal_the_window(readings, points):
    value = F.when(F.col("event_id") % 7 == 0, F.lit(None)).when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("temp_c"))
    df = readings.withColumns({"v": value, "_median": F.lit("kept")})
    w = Window.partitionBy("asset_id").orderBy(*ORDER).rowsBetween(1 - points, 0)
    plain = rows(df.select("event_id", "_median", F.percentile("v", F.lit(0.5)).over(w)))
    for options in (PLAIN, HOT):
        got = smoothing.rolling_median(df, "v", points, order=ORDER, **options)
        assert got.columns == [*df.columns, "rolling_median"]
        assert repr(rows(got.select("event_id", "_median", "rolling_median"))) == repr(plain)
    assert rows(smoothing.rolling_median(df.limit(0), "v", points, order=ORDER)) == []


def test_a_long_median_costs_little_per_row():
    frame, values = smoothing.SortedFrame(1001), [float(i * 7919 % 100_003) for i in range(200_000)]
    start = time.process_time()
    got = [frame.push(v) for v in values]
    assert time.process_time() - start < 10
    assert all(got[i] == statistics.median(values[max(0, i - 1000):i + 1]) for i in range(0, 200_000, 9973))


def test_history_and_transitions_equal_whole(readings):
    logs = readings.filter("timestamp IS NOT NULL").select(
        "asset_id", "timestamp", F.col("event_id").cast("string").alias("work_order_id"),
        F.when(F.col("temp_c") > 70, "HIGH").otherwise("LOW").alias("risk_level"),
    )
    gaps = [history.with_days_since_prev(logs, **o) for o in (PLAIN, HOT)]
    assert rows(gaps[0]) == rows(gaps[1])
    past = logs.groupBy("asset_id", F.col("timestamp").alias("calculated_at")).agg(F.max("risk_level").alias("risk_level"))
    changes = [serving.risk_changes(past, **o) for o in (PLAIN, HOT)]
    assert rows(changes[0]) and rows(changes[0]) == rows(changes[1])


def test_no_extra_shuffle_of_the_readings(readings):
    """Smoothing runs on one exchange of the readings, on asset and slice; above it only hourly sums move."""
    silver = readings.withColumns({"production_line_id": F.lit("L"), "criticality_tier": F.lit(1)})
    plan = trends.hourly_trends(silver, tie_break=("event_id",))._jdf.queryExecution().executedPlan().toString()
    top = plan[:plan.index("Exchange hashpartitioning(asset_id")]
    assert top.count("Exchange") == 1 and "partial_" in top[top.index("Exchange"):] and "Window" in top
    assert "_slice" in plan[plan.index("Exchange hashpartitioning(asset_id"):].split("\n")[0]
