"""Silver tables: joins to the asset register, anomaly flags, filters.

No join here carries a broadcast hint: the register may be large, and Spark broadcasts it by
itself while its size stays under the threshold and splits skewed partitions beyond that.
"""

from pyspark.sql import Column, DataFrame, functions as F

from rotorwatch import schemas as S
from rotorwatch.functions.scores import is_at_risk
from rotorwatch.operators import quality

_READING_CONTEXT = ("asset_type", "production_line_id", "criticality_tier",
                    "rated_max_vibration", "rated_max_temp")
_SILVER_READINGS = [
    *S.SENSOR_READINGS.names, "vibration_anomaly_flag", "temp_anomaly_flag", "rated_max_vibration",
    "rated_max_temp", "criticality_tier", "ingestion_time", "source_file",
]
_LOG_CONTEXT = ("asset_type", "production_line_id", "criticality_tier")


def _with_context(facts: DataFrame, meta: DataFrame, columns) -> DataFrame:
    """Left join of register columns; a column the facts already have keeps the facts' value."""
    wanted = [c for c in columns if c not in facts.columns]
    return facts.join(meta.select("asset_id", *wanted), "asset_id", "left")


def silver_asset_metadata(raw: DataFrame) -> DataFrame:
    return quality.apply_rules(quality.drop_missing(raw, "asset_id"), quality.ASSET_RULES)


def join_sensor_meta(readings: DataFrame, meta: DataFrame) -> DataFrame:
    return _with_context(readings, meta, _READING_CONTEXT)


def join_logs_meta(logs: DataFrame, meta: DataFrame) -> DataFrame:
    return _with_context(logs, meta, _LOG_CONTEXT)


def over_share(value: Column, rating: Column, share: float = S.ANOMALY_SHARE) -> Column:
    """True above the share of the rating; false where either is unknown."""
    return F.coalesce(value > rating * F.lit(share), F.lit(False))


def with_anomaly_flags(df: DataFrame, share: float = S.ANOMALY_SHARE) -> DataFrame:
    return df.withColumns({
        "vibration_anomaly_flag": over_share(F.col("vibration_mm_s"), F.col("rated_max_vibration"), share),
        "temp_anomaly_flag": over_share(F.col("temp_c"), F.col("rated_max_temp"), share),
    })


def silver_sensor_readings(raw: DataFrame, meta: DataFrame) -> DataFrame:
    """Readings with ratings and flags; extra columns of ``raw`` (such as an id) come last."""
    flagged = with_anomaly_flags(join_sensor_meta(raw, meta))
    kept = quality.apply_rules(flagged, quality.READING_RULES)
    standard = [c for c in _SILVER_READINGS if c in kept.columns]
    return kept.select(*standard, *[c for c in kept.columns if c not in standard])


def silver_maintenance_logs(raw: DataFrame, meta: DataFrame) -> DataFrame:
    """Work orders with asset context; those without id, asset or time are dropped first."""
    valid = quality.apply_rules(quality.drop_missing(raw, "asset_id", "timestamp"), quality.LOG_RULES)
    return join_logs_meta(valid, meta)


# -- filters ----------------------------------------------------------------


def at_risk(df: DataFrame) -> DataFrame:
    return df.filter(is_at_risk(F.col("risk_level")))


def health_below(health: DataFrame, limit: float = 60.0) -> DataFrame:
    return health.filter(F.col("health_score") < limit)


def critical_assets(df: DataFrame) -> DataFrame:
    return df.filter(F.col("criticality_tier") == 1)


def by_source(readings: DataFrame, source: str) -> DataFrame:
    return readings.filter(F.col("data_source") == source)


def near_rating(health: DataFrame, share: float = S.ANOMALY_SHARE) -> DataFrame:
    return health.filter(F.col("current_vibration") > F.col("rated_max_vibration") * F.lit(share))


def anomalous_assets(silver: DataFrame) -> DataFrame:
    """Assets with at least one vibration anomaly, and how many they have."""
    return (
        silver.filter("vibration_anomaly_flag")
        .groupBy("asset_id")
        .agg(F.count(F.lit(1)).alias("anomaly_count"))
    )


def band_lookup(df: DataFrame, column: str, bands, label: str = "alarm_level") -> DataFrame:
    """Label a value from (name, from, to) bands in rising order; None is an open end.

    A band with two ends holds both; of two bands that share an edge the first has it. A band without
    an end holds only what lies beyond its limit. The bands are a short fixed list, so this is one
    expression on each row, not a join. A value outside all bands gets NULL.
    """
    value, result = F.col(column), None
    for name, low, high in bands:
        inside = value < high if low is None else value > low if high is None else value.between(low, high)
        result = F.when(inside, name) if result is None else result.when(inside, name)
    return df.withColumn(label, result)


# Halvings of a list of bands: enough for 2 ** BAND_HALVINGS bands of one class.
BAND_HALVINGS = 17


def band_table_lookup(
    df: DataFrame, column: str, bands: DataFrame, key: str = "asset_id", label: str = "alarm_level",
) -> DataFrame:
    """Label a value from the bands of its class: ``bands`` holds ``key``, band, low and high; a null low or high is an open end.

    The edges are as in ``band_lookup``: a band with two ends holds both, an open one only what lies beyond its limit, and of two
    bands that share an edge the lower one has it. The bands of a class must not overlap otherwise; there may be gaps between them.
    A value in a gap, a null value and a class without bands get NULL. A null class is a class like any other.

    The bands of a class become one sorted list, joined once on the class; the place of a value is a binary search inside
    its row. So rows never multiply, and no range is joined, however many classes and bands there are.
    """
    once = bands.select(F.col(key).alias("_class"), F.struct(
        F.col("low").cast("double").alias("low"), F.col("high").isNull().alias("top"), F.col("high").cast("double").alias("high"),
        F.col("band").alias("band"),
    ).alias("_band"))
    # an open low end sorts first, as null; an open high end last among bands of one low end
    lists = once.groupBy("_class").agg(F.sort_array(F.collect_list("_band")).alias("_bands"))
    value = f"CAST(`{column}` AS DOUBLE)"
    steps = ", ".join(str(1 << b) for b in reversed(range(BAND_HALVINGS)))
    at = "get(_bands, passed + jump - 1)"
    beyond = f"NOT {at}.top AND (value > {at}.high OR (value = {at}.high AND {at}.low IS NULL))"
    search = f"aggregate(array({steps}), 0, (passed, jump) -> if(passed + jump <= size(_bands) AND {beyond}, passed + jump, passed))"
    # names inside the lambda must not clash with columns of df, so the value travels in a struct of its own
    search = f"transform(array({value}), value -> get(_bands, {search}))[0]"
    joined = df.join(lists, F.col(key).eqNullSafe(F.col("_class")), "left").withColumn("_found", F.expr(search))
    over = f"(_found.low IS NULL OR {value} > _found.low OR ({value} = _found.low AND NOT _found.top))"
    # a band without any end holds all values
    return joined.withColumn("_label", F.expr(f"if({value} IS NOT NULL AND {over}, _found.band, NULL)")).select(
        *[F.col(f"`{c}`") for c in df.columns if c != label], F.col("_label").alias(label)
    )


def map_signals(signals: DataFrame, assets: DataFrame, on: list[str]) -> DataFrame:
    """Assign each outside signal to one asset: the most critical one of its line or zone.

    The assets are cut to one per zone before the join, so a signal never multiplies. A signal
    that was delivered twice counts once; one from an unknown zone keeps a NULL asset.
    """
    once = signals.dropDuplicates(["signal_id"])
    lead = assets.groupBy(*on).agg(
        F.min_by("asset_id", F.struct("criticality_tier", "asset_id")).alias("mapped_asset_id")
    )
    return once.join(lead, on, "left")
