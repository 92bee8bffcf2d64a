"""Serving tables as plain parquet folders: a keyed table, and append logs by batch that are resolved on reading.

One job writes them (a streaming query is one); any number read. Nothing here takes part in a commit of its own: every write is one
Spark write of whole folders, and a batch that is run again writes the same folders again.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from rotorwatch import schemas as S
from rotorwatch.operators import serving


class KeyedTable:
    """A table with one row per key, laid out in folders by a hash of the key.

    An upsert writes the updates once, then reads and replaces just the folders whose hash occurs among them: with few
    updates most files stay as they are. A repeated upsert gives the same table.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, keys: list[str], buckets: int = 64):
        self.spark, self.root, self.keys, self.buckets = spark, root.rstrip("/"), keys, buckets
        self.schema, self.path = schema, f"{self.root}/rows"
        self.stored = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])
        spark.createDataFrame([], self.stored).write.mode("ignore").partitionBy("bucket").parquet(self.path)

    def read(self) -> DataFrame:
        return self._stored().drop("bucket")

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(self.stored).parquet(self.path)

    def _bucketed(self, df: DataFrame) -> DataFrame:
        rows = df.select(*[F.col(f.name).cast(f.dataType) for f in self.schema])
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def touched(self, staged: DataFrame) -> DataFrame:
        """The rows of the folders that ``staged`` (with bucket) changes, the changes put in."""
        # at most one number per folder; as a filter on the folder they keep all others unread
        numbers = [r.bucket for r in staged.select("bucket").distinct().collect()]
        kept = self._stored().filter(F.col("bucket").isin(numbers)).join(staged.select(*self.keys), self.keys, "left_anti")
        return kept.select(*self.stored.names).unionByName(staged)

    def upsert(self, updates: DataFrame, version: str | None = None) -> None:
        """Put updates in; of several for one key the one of the newest ``version`` counts."""
        fresh = serving.newest_by_key(updates, self.keys, version)
        self._bucketed(fresh).write.mode("overwrite").parquet(f"{self.root}/staged")
        staged = self.spark.read.schema(self.stored).parquet(f"{self.root}/staged")
        (  # ranged by folder and key: a folder is written by one task, or by a few if it is large
            self.touched(staged).repartitionByRange("bucket", *self.keys)
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        )


class Log:
    """Rows in one folder per batch; a batch that is written again replaces its own folder."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path, schema
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/batch=-1")

    def read(self) -> DataFrame:
        """All rows, with their batch; a filter on batch leaves other folders unread."""
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("batch", T.LongType())])).parquet(self.path)

    def write(self, df: DataFrame, batch: int) -> None:
        columns = [F.col(f.name).cast(f.dataType) for f in self.schema]
        df.select(*columns).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def newest(self) -> int:
        """The last batch that has rows, or -1."""
        found = self.read().agg(F.max("batch")).first()[0]
        return -1 if found is None else found


class ServingLog:
    """Live health (keyed), alerts, their status changes, and recommendations (logs) under one folder.

    Alerts are written once and never rewritten. The status of an alert is its newest change, found by one aggregation when alerts are
    read; a reset is a row that says up to which batch alerts and recommendations are cleared.
    """

    CHANGES = (
        T.StructType().add("disruption_id", T.LongType()).add("new_status", T.StringType())
        .add("changed_by", T.StringType()).add("changed_at", T.TimestampType())
    )
    RESETS = T.StructType().add("alerts_upto", T.LongType()).add("recommendations_upto", T.LongType())
    DONE = T.StructType().add("done", T.BooleanType())

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, root = spark, root.rstrip("/")
        self.live = KeyedTable(spark, f"{root}/live", S.ASSET_HEALTH_LIVE, ["asset_id"], buckets)
        self._alerts = Log(spark, f"{root}/alerts", S.ASSET_DISRUPTION)
        self._recommendations = Log(spark, f"{root}/recommendations", S.MAINTENANCE_RECOMMENDATIONS)
        self._changes = Log(spark, f"{root}/changes", self.CHANGES)
        self._resets = Log(spark, f"{root}/resets", self.RESETS)
        self._done = {step: Log(spark, f"{root}/done/{step}", self.DONE) for step in ("alerts", "live")}

    def _left(self, log: Log, mark: str, before: int | None = None) -> DataFrame:
        """The rows behind the last reset."""
        upto = F.coalesce(self._resets.read().agg(F.max(mark)).scalar(), F.lit(-1))
        rows = log.read() if before is None else log.read().filter(F.col("batch") < before)
        return rows.filter(F.col("batch") > upto).drop("batch")

    def alerts(self, before: int | None = None) -> DataFrame:
        """Alerts with their present status (those of batches before ``before``)."""
        rows = self._left(self._alerts, "alerts_upto", before)
        change = F.struct("changed_at", (F.col("new_status") == S.ALERT_RESOLVED).alias("resolves"), "new_status")
        resolved = F.when(F.col("new_status") == S.ALERT_RESOLVED, F.struct("changed_at", "changed_by"))
        newest = self._changes.read().groupBy(F.col("disruption_id").alias("_id")).agg(
            F.max(change).alias("_change"), F.max(resolved).alias("_resolved"))
        joined = rows.join(newest, F.col("disruption_id") == F.col("_id"), "left")
        return joined.withColumns({
            "status": F.coalesce("_change.new_status", "status"), "resolved_at": F.coalesce("_resolved.changed_at", "resolved_at"),
            "resolved_by": F.coalesce("_resolved.changed_by", "resolved_by"),
        }).select(*S.ASSET_DISRUPTION.names)

    def recommendations(self) -> DataFrame:
        return self._left(self._recommendations, "recommendations_upto").select(*S.MAINTENANCE_RECOMMENDATIONS.names)

    @staticmethod
    def _next_id(log: Log, column: str, batch: int) -> Column:
        """Ids go on from all earlier batches, cleared ones included."""
        return F.coalesce(log.read().filter(F.col("batch") < batch).agg(F.max(column)).scalar(), F.lit(0)) + 1

    def sync(self, records: DataFrame, now: Column, batch: int | None = None, gap_hours: float = 1, only_transitions: bool = False) -> None:
        """Raise alerts for assets at risk, then put health-with-cost records into the live table.

        A batch that was done has no second effect; one that broke off goes on where it stopped. ``only_transitions`` alerts when an asset
        enters an at-risk level, instead of whenever it is at risk and was not alerted within the gap.
        """
        batch = self._done["live"].newest() + 1 if batch is None else batch
        fresh = serving.newest_by_key(records, ["asset_id"], "calculated_at")

        def alerts():
            alarms = self._entering(records, self.live.read()) if only_transitions else fresh
            new = serving.new_disruptions(alarms, self.alerts(batch), now, gap_hours)
            numbered = serving.with_serial_id(new, ["asset_id"], self._next_id(self._alerts, "disruption_id", batch), "disruption_id")
            self._alerts.write(numbered, batch)

        for step, run in (("alerts", alerts), ("live", lambda: self.live.upsert(serving.live_health(fresh, now)))):
            if self._done[step].read().filter(F.col("batch") == batch).isEmpty():
                run()
                self._done[step].write(self.spark.createDataFrame([(True,)], self.DONE), batch)

    @staticmethod
    def _entering(records: DataFrame, live: DataFrame) -> DataFrame:
        """The newest entry of each asset into an at-risk level, seen from the live table on."""
        before = live.select("asset_id", "calculated_at", "risk_level", F.lit(True).alias("_before"))
        history = records.withColumn("_before", F.lit(False)).unionByName(before, allowMissingColumns=True)
        entered = serving.risk_changes(history).filter(~F.col("_before"))
        return serving.newest_by_key(entered, ["asset_id"], "calculated_at")

    def set_alert_status(self, changes: DataFrame, now: Column) -> None:
        """Append status changes (disruption_id, new_status, changed_by); of equal times RESOLVED counts."""
        self._changes.write(changes.withColumn("changed_at", now), self._changes.newest() + 1)

    def recommend(self, recs: DataFrame, now: Column, session: str | None = None, batch: int | None = None) -> DataFrame:
        """Append recommendations of known assets, numbered on from the last one; gives back the rows as stored."""
        log = self._recommendations
        batch = log.newest() + 1 if batch is None else batch
        log.write(serving.recommendations_to_append(recs, self.live.read(), now, self._next_id(log, "rec_id", batch), session), batch)
        return log.read().filter(F.col("batch") == batch).select(*S.MAINTENANCE_RECOMMENDATIONS.names)

    def reset(self) -> None:
        """Clear alerts and recommendations; live health stays."""
        upto = [log.newest() for log in (self._alerts, self._recommendations)]
        self._resets.write(self.spark.createDataFrame([tuple(upto)], self.RESETS), self._resets.newest() + 1)
