"""Hourly roll-up of readings and what is read off it."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from rotorwatch import schemas as S
from rotorwatch.operators.smoothing import rolling_mean

_GROUP = ["hour_window", "asset_id", "production_line_id", "criticality_tier"]


def hourly_trends(
    silver: DataFrame, points: int = S.SMOOTHING_POINTS, tie_break: tuple[str, ...] = (), **options
) -> DataFrame:
    """Per asset and hour: smoothed means, extremes, spread, anomaly and reading counts.

    The readings are shuffled once, by asset and slice. Each task then sums up its hours, and only
    those sums are shuffled again, so an hour may be cut between slices too.
    """
    return _roll_up(_smooth(silver, points, tie_break, **options))


def last_before(
    silver: DataFrame, since: Column, rows: int, tie_break: tuple[str, ...] = ()
) -> DataFrame:
    """The last ``rows`` readings of each asset before a moment."""
    newest_first = Window.partitionBy("asset_id").orderBy(
        *[F.desc(c) for c in ("timestamp", *tie_break)]
    )
    older = silver.filter(F.col("timestamp") < since).withColumn("_back", F.row_number().over(newest_first))
    return older.filter(F.col("_back") <= rows).drop("_back")


def hourly_trends_since(
    silver: DataFrame, since: Column, points: int = S.SMOOTHING_POINTS,
    tie_break: tuple[str, ...] = (), before: DataFrame | None = None, **options,
) -> DataFrame:
    """The hours from ``since`` on, equal to those of the whole table, from the new readings only.

    The trailing frame needs the last few readings of each asset before that. Pass them as
    ``before`` where they are kept, as the smoothing stream does; else older readings are read.
    """
    start = F.date_trunc("hour", since)
    if before is None:
        before = last_before(silver, start, points - 1, tie_break)
    recent = silver.filter(F.col("timestamp") >= start).withColumn("_past", F.lit(False))
    both = recent.unionByName(before.withColumn("_past", F.lit(True)), allowMissingColumns=True)
    return _roll_up(_smooth(both, points, tie_break, **options).filter("NOT _past"))


def _smooth(silver: DataFrame, points: int, tie_break: tuple[str, ...], **options) -> DataFrame:
    return rolling_mean(
        silver, {"vibration_mm_s": "_vib", "temp_c": "_temp"}, points,
        order=["timestamp", *tie_break], **options,
    )


def _roll_up(smoothed: DataFrame) -> DataFrame:
    return (
        smoothed.withColumn("hour_window", F.date_trunc("hour", "timestamp"))
        .groupBy(*_GROUP)
        .agg(
            F.round(F.avg("_vib"), 4).alias("vibration_avg"),
            F.max("vibration_mm_s").alias("vibration_max"),
            F.round(F.stddev_samp("vibration_mm_s"), 4).alias("vibration_stddev"),
            F.round(F.avg("_temp"), 2).alias("temp_avg"),
            F.max("temp_c").alias("temp_max"),
            F.count_if("vibration_anomaly_flag").alias("anomaly_count"),
            F.count(F.lit(1)).alias("reading_count"),
        )
    )


def latest_hour(df: DataFrame, ts: str = "hour_window") -> Column:
    """The newest hour in the data as a scalar subquery: the default "now" of every report."""
    return df.agg(F.date_trunc("hour", F.max(ts))).scalar()


def _now(trends: DataFrame, as_of) -> Column:
    if as_of is None:
        return latest_hour(trends)
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def _since(now: Column, hours: float) -> Column:
    return now - F.make_dt_interval(secs=F.lit(hours * 3600.0))


def _seconds() -> Column:
    return F.unix_timestamp("hour_window").cast("double")


def window_start(trends: DataFrame, as_of, hours: int, whole_days: bool = False) -> Column:
    """Start of the look-back window; ``whole_days`` cuts it at midnight, so it is longer."""
    start = _since(_now(trends, as_of), hours)
    return F.date_trunc("day", start) if whole_days else start


def trend_slope(
    trends: DataFrame, as_of=None, hours: int = S.SLOPE_HOURS, whole_days: bool = False
) -> DataFrame:
    """Slope of the hourly mean vibration against time, per second; NULL for a single hour."""
    recent = trends.filter(F.col("hour_window") >= window_start(trends, as_of, hours, whole_days))
    return recent.groupBy("asset_id").agg(
        F.regr_slope("vibration_avg", _seconds()).alias("vibration_slope_per_sec")
    )


def latest_per(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Newest row per key as one partial aggregation: no sort of each key's whole history."""
    newest = F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_row")
    return df.groupBy(F.col(key).alias("_key")).agg(newest).select("_row.*")


def latest_with_slope(
    trends: DataFrame, as_of=None, hours: int = S.SLOPE_HOURS, whole_days: bool = False
) -> DataFrame:
    """Newest hour per asset together with its slope, from one aggregation of the trends."""
    recent = F.col("hour_window") >= window_start(trends, as_of, hours, whole_days)
    newest = F.max_by(
        F.struct("hour_window", "production_line_id", "criticality_tier", "vibration_avg", "temp_avg"),
        F.struct("hour_window", "production_line_id", "criticality_tier"),
    )
    return (
        trends.groupBy("asset_id")
        .agg(
            newest.alias("_row"),
            F.regr_slope(F.when(recent, F.col("vibration_avg")), _seconds()).alias(
                "vibration_slope_per_sec"
            ),
        )
        .select("asset_id", "_row.*", "vibration_slope_per_sec")
    )


def join_latest(latest: DataFrame, meta: DataFrame, slopes: DataFrame) -> DataFrame:
    """Newest hour with ratings and slope, for callers that hold the three apart."""
    ratings = meta.select("asset_id", "rated_max_vibration", "rated_max_temp")
    return latest.join(ratings, "asset_id", "left").join(slopes, "asset_id", "left")


def slopes_for(
    trends: DataFrame, meta: DataFrame, asset_type: str, line: str, as_of=None,
    hours: int = S.SLOPE_HOURS,
) -> DataFrame:
    """Slopes of one asset type on one line, steepest first."""
    wanted = meta.filter((F.col("asset_type") == asset_type) & (F.col("production_line_id") == line))
    now = _now(trends, as_of)
    chosen = trends.join(wanted.select("asset_id"), "asset_id", "left_semi")
    return trend_slope(chosen, now, hours).orderBy(
        F.desc_nulls_last("vibration_slope_per_sec"), "asset_id"
    )


def trend_recent(trends: DataFrame, as_of=None, hours: int = S.SLOPE_HOURS) -> DataFrame:
    return (
        trends.filter(F.col("hour_window") >= window_start(trends, as_of, hours))
        .select(
            "asset_id", "hour_window",
            F.round("vibration_avg", 3).alias("vibration_avg"),
            F.round("vibration_max", 3).alias("vibration_max"),
            "anomaly_count", "production_line_id",
        )
        .orderBy("asset_id", "hour_window")
    )


def lookback_profile(
    trends: DataFrame, as_of=None,
    points: tuple[tuple[str, int], ...] = (("d7", 168), ("d3", 72), ("h48", 48), ("h24", 24), ("now", 0)),
    span_hours: int = 24,
) -> DataFrame:
    """Mean vibration in the ``span_hours`` that end at each point back in time."""
    now, hour = _now(trends, as_of), F.col("hour_window")
    oldest = max(back for _, back in points) + span_hours
    return (
        trends.filter((hour > _since(now, oldest)) & (hour <= now))
        .groupBy("asset_id")
        .agg(*[
            F.avg(F.when(
                (hour > _since(now, back + span_hours)) & (hour <= _since(now, back)),
                F.col("vibration_avg"),
            )).alias(f"vibration_{name}")
            for name, back in points
        ])
    )


def vib_corr(readings: DataFrame, other: str = "rpm") -> DataFrame:
    """Correlation of vibration with another channel; high with rpm hints at misalignment."""
    return readings.groupBy("asset_id").agg(
        F.corr("vibration_mm_s", other).alias(f"vibration_{other}_corr"),
        F.count(F.lit(1)).alias("reading_count"),
    )


def top_increase(
    trends: DataFrame, as_of=None, hours: int = S.SLOPE_HOURS, k: int = 10
) -> DataFrame:
    """The k assets whose vibration rose most from the first to the last hour of the window."""
    first, last = F.min_by("vibration_avg", "hour_window"), F.max_by("vibration_avg", "hour_window")
    return (
        trends.filter(F.col("hour_window") >= window_start(trends, as_of, hours))
        .groupBy("asset_id")
        .agg(F.round(last - first, 4).alias("vibration_increase"))
        .orderBy(F.desc_nulls_last("vibration_increase"), "asset_id")
        .limit(k)
    )
