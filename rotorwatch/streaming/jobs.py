"""Structured Streaming jobs: bronze to silver, hourly counts, serving sync."""

from collections import Counter

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from rotorwatch.operators import enrich, quality
from rotorwatch.sources.serving_log import ServingLog


def _started(writer, every: str | None) -> StreamingQuery:
    """Run on all data there is and stop, or keep running at an interval."""
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return writer.trigger(**trigger).start()


def write_stream(df: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append a stream to a parquet table."""
    writer = df.writeStream.outputMode("append").format("parquet")
    return _started(writer.option("path", path).option("checkpointLocation", checkpoint), every)


def run_silver_stream(
    readings: DataFrame, meta: DataFrame, path: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Readings stream joined to the static register and flagged, row by row.

    Each micro-batch sees the register as it is then; rows written before are not revised. The
    counts of the quality gates are in the observed metrics of the query's progress.
    """
    checked = _counted(enrich.silver_sensor_readings(readings, meta), quality.READING_RULES)
    return write_stream(checked, path, checkpoint, every)


def run_silver_logs_stream(
    logs: DataFrame, meta: DataFrame, path: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    checked = _counted(logs, quality.LOG_RULES)
    return write_stream(enrich.silver_maintenance_logs(checked, meta), path, checkpoint, every)


def _counted(df: DataFrame, rules: dict[str, tuple[str, bool]]) -> DataFrame:
    for name, (predicate, _) in rules.items():
        df = quality.expect(df, name, predicate)
    return df


def dedup(stream: DataFrame, keys: list[str], delay: str, ts: str = "timestamp") -> DataFrame:
    """Drop repeats of a key that arrive within the delay; state older than that is forgotten."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def hourly_stream(stream: DataFrame, delay: str, ts: str = "timestamp") -> DataFrame:
    """Hourly counts, maximum and anomalies per asset, each hour once it is past the delay.

    Rows are summed up per task before the shuffle, so a busy asset is no burden.
    """
    return hourly_counts(stream.withWatermark(ts, delay), ts)


def hourly_counts(rows: DataFrame, ts: str = "timestamp") -> DataFrame:
    return (
        rows.groupBy(F.window(ts, "1 hour").alias("_hour"), "asset_id")
        .agg(
            F.count(F.lit(1)).alias("reading_count"),
            F.max("vibration_mm_s").alias("vibration_max"),
            F.count_if("vibration_anomaly_flag").alias("anomaly_count"),
        )
        .select(F.col("_hour.start").alias("hour_window"), "asset_id", "reading_count",
                "vibration_max", "anomaly_count")
    )


def open_hours(rows: DataFrame, written: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Counts of the hours that a stopped `hourly_stream` over ``rows`` has not written yet.

    A stream gives out an hour once the watermark has passed it, so its last hours stay in its state when it
    stops. All hours up to the newest one written are closed; the later ones are counted here.
    """
    newest = F.coalesce(written.agg(F.max("hour_window")).scalar(), F.lit(0).cast("timestamp"))
    return hourly_counts(rows.filter(F.date_trunc("hour", ts) > newest), ts)


class LateRows(StreamingQueryListener):
    """Rows that came after the watermark, by query id, over all batches since it was added to ``spark.streams``."""

    def __init__(self):
        self.dropped: Counter = Counter()

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        self.dropped[str(event.progress.id)] += sum(s.numRowsDroppedByWatermark for s in event.progress.stateOperators)

    def onQueryTerminated(self, event):
        pass


def run_sync_stream(
    records: DataFrame, root: str, checkpoint: str, every: str | None = None, now=None, **options
) -> StreamingQuery:
    """After each run of the gold tables: update live health and raise alerts.

    The serving log keeps which batches were done, so a repeated batch has no second effect. ``now``
    defaults to the clock.
    """
    tables = ServingLog(records.sparkSession, root)

    def sync(batch: DataFrame, batch_id: int) -> None:
        clock = F.current_timestamp() if now is None else now
        batch.persist()
        tables.sync(batch, clock, batch_id, **options)
        batch.unpersist()

    return _started(records.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sync), every)
