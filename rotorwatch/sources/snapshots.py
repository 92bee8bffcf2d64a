"""Tables that are replaced as a whole, as numbered parquet folders.

A version is complete once Spark has written its _SUCCESS file; readers take the newest
complete one. So a table can be recomputed from itself, a failed job leaves the old version in
place, and a batch that is run twice writes the same version twice.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


class Snapshot:
    def __init__(self, spark: SparkSession, root: str, schema: T.StructType):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    def _folder(self, version: int) -> str:
        return f"{self.root}/v{version:012d}"

    def _filesystem(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Complete versions, oldest first."""
        path, fs = self._filesystem()
        if not fs.exists(path):
            return []
        done = fs.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/v*/_SUCCESS"))
        return sorted(int(status.getPath().getParent().getName()[1:]) for status in done)

    def read(self, before: int | None = None) -> DataFrame:
        """The newest complete version (older than ``before``), or an empty table."""
        found = [v for v in self.versions() if before is None or v < before]
        if not found:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self._folder(found[-1]))

    def publish(self, df: DataFrame, version: int | None = None) -> int:
        """Write the next version, or the given one again. For tables with one writer."""
        if version is None:
            version = max(self.versions(), default=0) + 1
        columns = [F.col(f.name).cast(f.dataType) for f in self.schema]
        df.select(*columns).write.mode("overwrite").parquet(self._folder(version))
        return version

    def drop_old(self, keep: int = 2) -> None:
        """Remove all but the newest versions, once no reader uses them any more."""
        _, fs = self._filesystem()
        for version in self.versions()[:-keep]:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self._folder(version)), True)


def materialize(df: DataFrame, root: str) -> Snapshot:
    """Recompute and replace a gold table."""
    table = Snapshot(df.sparkSession, root, df.schema)
    table.publish(df)
    return table


def replace_days(df: DataFrame, path: str, ts: str = "hour_window") -> None:
    """Write rows into a table of daily folders, replacing just the days that occur in ``df``.

    With `hourly_trends_since` the start of a day, a refresh of the hourly table touches new
    days only. Rows are ranged by day and time first, so that a day becomes a few files of
    even size however many rows it has.
    """
    daily = df.withColumn("day", F.to_date(ts)).repartitionByRange("day", ts, *df.columns[:2])
    (
        daily.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("day").parquet(path)
    )
