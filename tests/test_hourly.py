"""The hourly table from deliveries of readings equals the roll-up of all of them."""

import random

from pyspark.sql import functions as F

from conftest import rows
from rotorwatch.operators import hour_parts, trends
from rotorwatch.sources.hourly_table import HourlyTable

START = 1_700_000_000


def _silver(spark, n, seed):
    rng = random.Random(seed)
    data = [(i, rng.choice(["A", "A", "A", "B", "C", None]), START + rng.randrange(400) * 900, rng.choice([None, *[round(rng.uniform(0, 9), 2)] * 6]),
             rng.choice([None, 50.0, 61.5]), rng.choice(["L1", "L1", "L2"]), rng.choice([1, None])) for i in range(n)]
    df = spark.createDataFrame(data, "event_id long, asset_id string, s long, vibration_mm_s double, temp_c double, production_line_id string, criticality_tier int")
    return df.select(F.timestamp_seconds("s").alias("timestamp"), "*").drop("s").withColumn("vibration_anomaly_flag", F.col("vibration_mm_s") > 5)


def _same(a, b):
    wide = lambda df: {tuple(r)[:4]: tuple(r)[4:] for r in df.collect()}
    a, b = wide(a), wide(b)
    assert a.keys() == b.keys()
    for key, want in b.items():
        assert all((x is None) == (y is None) and (x is None or abs(x - y) < 2e-2 if i == 3 else x is None or abs(x - y) < 2e-4)
                   for i, (x, y) in enumerate(zip(a[key], want))), (key, a[key], want)


def test_parts_put_together_equal_roll_up(spark):
    silver = _silver(spark, 600, 1)
    got = hour_parts.trends_of_parts(hour_parts.hour_parts(silver, tie_break=("event_id",)))
    _same(got, trends.hourly_trends(silver, tie_break=("event_id",)))


def test_deliveries_in_any_order(spark, folder):
    """Shuffled deliveries, one of them twice: the table equals the roll-up after each."""
    silver = _silver(spark, 400, 2)
    table = HourlyTable(spark, folder, silver.schema, tie_break=("event_id",))
    assert table.trends().isEmpty()
    for i in (0, 1, 1, 2):
        table.append(silver.filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) == i), i)
    _same(table.trends(), trends.hourly_trends(silver, tie_break=("event_id",)))


def test_only_touched_days_are_read_and_written(spark, folder):
    silver = _silver(spark, 300, 3).filter("asset_id IS NOT NULL")
    table = HourlyTable(spark, folder, silver.schema, tie_break=("event_id",))
    table.append(silver, 0)
    before = set(table.parts().inputFiles())
    day = silver.agg(F.min(F.to_date("timestamp"))).first()[0]
    late = silver.filter(F.to_date("timestamp") == F.lit(day)).limit(3).withColumn("event_id", F.col("event_id") + 1000)
    late.write.parquet(f"{folder}/late")
    late = spark.read.parquet(f"{folder}/late")
    table.append(late, 1)
    after = set(table.parts().inputFiles())
    assert {f.split("day=")[1][:10] for f in before ^ after} == {str(day)}
    plan = table.changed_parts(1)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert len(scans) >= 3 and all("PartitionFilters: [" in s and "PartitionFilters: []" not in s for s in scans)
    _same(table.trends(), trends.hourly_trends(silver.unionByName(late), tie_break=("event_id",)))
    assert rows(table.readings().groupBy("batch").count()) == [(0, silver.count()), (1, 3)]


def test_mean_of_a_frame_reads_it_once(spark):
    """An argument of a lambda is made anew wherever it stands, so the frame must stand in one place."""
    mean = hour_parts._mean(F.col("frame"), "v")
    df = spark.sql("SELECT * FROM VALUES (array(named_struct('v', 1.0D), named_struct('v', CAST(NULL AS DOUBLE)), named_struct('v', 4.0D))), "
                   "(array(named_struct('v', CAST(NULL AS DOUBLE)))), (CAST(array() AS ARRAY<STRUCT<v: DOUBLE>>)) AS t(frame)")
    assert rows(df.select(mean)) == [(2.5,), (None,), (None,)]
    assert str(mean).count("frame") == 1
