"""Rolling mean when one asset holds most readings: plain window against slices.

python -m checks.skew [folder] [copies]

Readings are the events, copied with a shift in time; two thirds of them are given to one asset.
Reports seconds and the share of all rows that the largest shuffle partition gets.
"""

import sys
import time

from pyspark.sql import Window, functions as F

from rotorwatch.operators import smoothing
from rotorwatch.operators.history_slices import SLICE
from rotorwatch.session import build_session
from rotorwatch.sources.bindings import READING_ORDER, Tables


def skewed_readings(spark, folder, copies):
    shift = F.make_interval(days=F.col("_copy") * 40)
    return (
        Tables(spark, folder).readings()
        .withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        .withColumn("timestamp", F.col("timestamp") + shift)
        .withColumn("event_id", F.col("event_id") * copies + F.col("_copy"))
        .withColumn("asset_id", F.when(F.col("event_id") % 3 < 2, "Asset_hot").otherwise(F.col("asset_id")))
        .select("event_id", "timestamp", "asset_id", "vibration_mm_s")
    )


def main():
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    copies = int(sys.argv[2]) if len(sys.argv) > 2 else 20
    spark = build_session("skew", "local[8]", **{
        "spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.python.sql.dataFrameDebugging.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    readings = skewed_readings(spark, folder, copies).repartition(32, "event_id").persist()
    total = readings.count()
    w = Window.partitionBy("asset_id").orderBy(*READING_ORDER).rowsBetween(-4, 0)
    plain = readings.withColumn("m", F.avg("vibration_mm_s").over(w))
    sliced = smoothing.rolling_mean(
        readings, {"vibration_mm_s": "m"}, order=READING_ORDER, min_hot_rows=total // 32, keep_slice=True
    )

    def timed(df):
        start = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    for name, df in (("plain", plain), ("sliced", sliced)):
        timed(df)
        seconds = sorted(timed(df) for _ in range(3))[1]
        per_task = df.groupBy(F.spark_partition_id()).agg(F.count("m").alias("n"))
        largest = per_task.agg(F.max("n")).first()[0]
        print(f"{name}: {seconds:.2f} s, largest partition {largest / total:.1%} of {total} rows")
    print("slices of the hot asset:", sliced.filter("asset_id = 'Asset_hot'").select(SLICE).distinct().count())
    digest = [F.count(F.lit(1)), F.sum(F.round("m", 6)), F.sum(F.xxhash64("event_id", F.round("m", 6)) % 1000003)]
    print("equal:", plain.agg(*digest).first()[0] == sliced.agg(*digest).first()[0]
          and plain.agg(digest[2]).first() == sliced.agg(digest[2]).first())


if __name__ == "__main__":
    main()
