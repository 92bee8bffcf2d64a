"""The hourly roll-up as a table that takes new and late readings in without reading its history."""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rotorwatch import schemas as S
from rotorwatch.operators.hour_parts import HOUR, hour_parts, trends_of_parts


class HourlyTable:
    """Readings in folders by day and batch, and summaries of hours in folders by day, under one folder.

    A batch writes its readings, reads back the days that occur in them, and replaces the summaries of the hours it touches. All
    else stays unread. A batch that is run again gives the same table. One writer.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, points: int = S.SMOOTHING_POINTS, tie_break: tuple[str, ...] = ()):
        self.spark, self.root, self.points, self.tie_break = spark, root.rstrip("/"), points, tie_break
        self.readings_schema = T.StructType([*schema.fields, T.StructField("day", T.DateType()), T.StructField("batch", T.LongType())])
        empty = spark.createDataFrame([], schema)
        parts = hour_parts(empty, points, tie_break).schema
        self.parts_schema = T.StructType([*parts.fields, T.StructField("day", T.DateType())])
        spark.createDataFrame([], self.readings_schema).write.mode("ignore").partitionBy("day", "batch").parquet(f"{self.root}/readings")
        spark.createDataFrame([], self.parts_schema).write.mode("ignore").partitionBy("day").parquet(f"{self.root}/hours")

    def readings(self) -> DataFrame:
        return self.spark.read.schema(self.readings_schema).parquet(f"{self.root}/readings")

    def parts(self) -> DataFrame:
        return self.spark.read.schema(self.parts_schema).parquet(f"{self.root}/hours")

    def append(self, silver: DataFrame, batch: int) -> None:
        days = F.to_date("timestamp")
        rows = silver.withColumns({"day": days, "batch": F.lit(batch).cast("long")}).select(*self.readings_schema.names)
        self._replace(rows.repartitionByRange("day", "timestamp", "asset_id"), "readings", "day", "batch")
        changed = self.changed_parts(batch)
        self._replace(changed.repartitionByRange("day", *HOUR), "hours", "day")

    def changed_parts(self, batch: int) -> DataFrame:
        """All summaries of the days that a written batch touches, those of its hours made anew."""
        own = self.readings().filter(F.col("batch") == batch)
        touched = own.select("asset_id", F.date_trunc("hour", "timestamp").alias("hour_window"), "day").distinct()
        days = [r.day for r in touched.select("day").distinct().collect()]  # one date per folder, as a filter on folders
        inside = F.col("day").isin(days) if None not in days else F.col("day").isin([d for d in days if d]) | F.col("day").isNull()
        marked = touched.select(*[F.col(c).alias(f"_{c}") for c in HOUR])
        same = F.col("_asset_id").eqNullSafe(F.col("asset_id")) & F.col("_hour_window").eqNullSafe(F.col("hour_window"))
        readings = self.readings().filter(inside).withColumn("hour_window", F.date_trunc("hour", "timestamp"))
        fresh = hour_parts(readings.join(marked, same, "left_semi").drop("hour_window", "day", "batch"), self.points, self.tie_break)
        kept = self.parts().filter(inside).join(marked, same, "left_anti")
        return kept.unionByName(fresh.withColumn("day", F.to_date("hour_window")))

    def _replace(self, df: DataFrame, name: str, *folders: str) -> None:
        writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(*folders).parquet(f"{self.root}/{name}")

    def trends(self) -> DataFrame:
        """`trends.hourly_trends` of all readings so far."""
        return trends_of_parts(self.parts().drop("day"), self.points)
