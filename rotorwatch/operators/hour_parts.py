"""Hours of an asset as summaries that can be put together: the hourly roll-up without its readings.

Only the first ``points - 1`` readings of an hour have trailing means that reach into earlier hours. So an hour is
kept as the sums over all its other means, those first readings, and its last ones; what the first means are is worked out
when hours are put in a row. New or late readings change the summaries of their own hours only.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from rotorwatch import schemas as S
from rotorwatch.operators.trends import _GROUP

HOUR = ["asset_id", "hour_window"]
VALUES = {"vibration_mm_s": "vib", "temp_c": "temp"}


def hour_parts(silver: DataFrame, points: int = S.SMOOTHING_POINTS, tie_break: tuple[str, ...] = ()) -> DataFrame:
    """One row per hour, asset, line and tier of all readings of those hours. One shuffle, by asset and hour."""
    order = ["timestamp", *tie_break]
    inside = Window.partitionBy(*HOUR).orderBy(*order)
    reading = F.struct(*order, *VALUES, "production_line_id", "criticality_tier")
    rows = silver.withColumn("hour_window", F.date_trunc("hour", "timestamp")).withColumns({
        "_at": F.row_number().over(inside), "_n": F.count(F.lit(1)).over(Window.partitionBy(*HOUR)),
        **{f"_{name}": F.avg(value).over(inside.rowsBetween(1 - points, 0)) for value, name in VALUES.items()},
    })
    whole = F.col("_at") >= points
    return rows.groupBy(*HOUR, "production_line_id", "criticality_tier").agg(
        F.max("vibration_mm_s").alias("vibration_max"), F.round(F.stddev_samp("vibration_mm_s"), 4).alias("vibration_stddev"),
        F.max("temp_c").alias("temp_max"), F.count_if("vibration_anomaly_flag").alias("anomaly_count"),
        F.count(F.lit(1)).alias("reading_count"),
        *[x for name in VALUES.values() for x in (
            F.coalesce(F.sum(F.when(whole, F.col(f"_{name}"))), F.lit(0.0)).alias(f"{name}_sum"),
            F.count(F.when(whole, F.col(f"_{name}"))).alias(f"{name}_count"))],
        # readings of an hour under another line or tier are in the rows of those
        F.collect_list(F.when(F.col("_at") < points, reading)).alias("first"),
        F.collect_list(F.when(F.col("_n") - F.col("_at") < points - 1, reading)).alias("last"),
    )


def _mean(readings: Column, value: str) -> Column:
    """One pass over the readings: a lambda makes an argument anew wherever it stands."""
    start = F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("known"))
    return F.aggregate(
        readings, start,
        lambda a, r: F.when(r[value].isNull(), a).otherwise(F.struct((a["total"] + r[value]).alias("total"), (a["known"] + 1).alias("known"))),
        lambda a: F.try_divide(a["total"], a["known"]))


def trends_of_parts(parts: DataFrame, points: int = S.SMOOTHING_POINTS) -> DataFrame:
    """`trends.hourly_trends` from summaries. An asset's hours meet in one task, a few readings each."""
    back = points - 1
    ends = parts.groupBy(*HOUR).agg(*[F.sort_array(F.flatten(F.collect_list(c))).alias(c) for c in ("first", "last")])
    before = F.flatten(F.collect_list("last").over(Window.partitionBy("asset_id").orderBy("hour_window").rowsBetween(-back, -1)))
    carried = ends.withColumn("_before", before).withColumn("_before", F.slice("_before", F.greatest(F.size("_before") - back, F.lit(0)) + 1, back))

    carried = carried.withColumns({"_rows": F.concat("_before", "first"), "_past": F.size("_before")})

    def frame(i: Column) -> Column:
        start = F.greatest(F.col("_past") + i + 1 - points, F.lit(0))
        return F.slice("_rows", start + 1, F.col("_past") + i + 1 - start)

    first = F.transform("first", lambda r, i: F.struct(
        r["production_line_id"].alias("production_line_id"), r["criticality_tier"].alias("criticality_tier"),
        *[_mean(frame(i), value).alias(name) for value, name in VALUES.items()]))
    heads = carried.select(*HOUR, F.inline(first)).groupBy(*HOUR, "production_line_id", "criticality_tier").agg(
        *[x for name in VALUES.values() for x in (F.sum(name).alias(f"_{name}_sum"), F.count(name).alias(f"_{name}_count"))])
    heads = heads.select(*[F.col(c).alias(f"_{c}") for c in _GROUP], *[f"_{n}_{x}" for n in VALUES.values() for x in ("sum", "count")])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in _GROUP]

    def average(name: str, digits: int) -> Column:
        total = F.col(f"{name}_sum") + F.coalesce(f"_{name}_sum", F.lit(0.0))
        return F.round(F.try_divide(total, F.col(f"{name}_count") + F.coalesce(f"_{name}_count", F.lit(0))), digits)

    return parts.join(heads, same, "left").select(
        *_GROUP, average("vib", 4).alias("vibration_avg"), "vibration_max", "vibration_stddev", average("temp", 2).alias("temp_avg"),
        "temp_max", "anomaly_count", "reading_count")
