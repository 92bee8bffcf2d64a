"""Persistence rules: how long or how often in a row a condition holds."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from rotorwatch.operators.history_slices import SLICE, by_slice, cut_table, numbered_slices, of_hot_keys


_RUN = ["run_start", "run_end", "run_length", "peak_value"]


def _pieces(rows: DataFrame, key: str, order: list[str], part: int) -> DataFrame:
    """The runs inside each slice, and its number of misses: the ``_island`` of its ``_last`` piece."""
    in_order = f"PARTITION BY {key}, {SLICE} ORDER BY {', '.join(order)}"
    # all hits between two misses share the count of misses before them
    return (
        rows.selectExpr(
            "*", f"count_if(NOT _hit) OVER ({in_order}) AS _island", f"lead(true) OVER ({in_order}) IS NULL AS _end"
        )
        .filter("_hit OR _end")
        .groupBy(key, SLICE, "_island")
        .agg(
            F.expr(f"min({order[0]}) FILTER (WHERE _hit) AS run_start"),
            F.expr(f"max({order[0]}) FILTER (WHERE _hit) AS run_end"),
            F.expr("count_if(_hit) AS run_length"),
            F.expr("max(_value) FILTER (WHERE _hit) AS peak_value"),
            F.expr("bool_or(_end) AS _last"),
            F.expr(f"max({SLICE}) AS _number"),
        )
        .withColumn("_part", F.lit(part))
    )


def runs(
    df: DataFrame, condition: Column, value: str, key: str = "asset_id",
    order: tuple[str, ...] = ("timestamp",), derive: dict[str, Callable[[WindowSpec], Column]] | None = None,
    reach: int = 0, needs: tuple[str, ...] = (), rows: DataFrame | None = None, **options,
) -> DataFrame:
    """One row per unbroken run of consecutive rows that meet the condition.

    Gives the first and last time, the number of rows and the greatest value. The rows are read and shuffled once, by
    key and slice. A slice is summed up by the run it begins with, the run it ends with and its number of misses; these
    summaries are merged in order, and all other runs are done inside their slice.

    The condition and value may use ``derive`` columns: functions of the ordered window that
    look back over ``reach`` rows. ``needs`` names the columns those and the condition read. The first ``reach`` rows
    of a slice (its head) look back into the slice before, so they are judged beside that slice's last ``reach`` rows and
    take part as a slice of their own.
    """
    order = list(order)
    hit = F.coalesce(condition, F.lit(False)).alias("_hit")
    if derive:
        lean = df.select(*dict.fromkeys([key, *order, *needs]))
    else:
        lean = df.select(key, *order, F.col(value).alias("_value"), hit)
    hot = cut_table(lean, key, order, rows, **options)
    sliced, heads = numbered_slices(lean, key, order, hot), None
    if derive:
        judged = [key, *order, SLICE, F.col(value).alias("_value"), hit]
        window = by_slice(key, order)
        placed = sliced.withColumns({"_at": F.row_number().over(window), "_tail": F.lead(F.lit(True), reach).over(window).isNull()})
        head = f"{SLICE} > 1 AND _at <= {reach}"
        # the rows around the cuts: at most 2 * reach per slice, and none between those that a head row looks back on
        around = of_hot_keys(placed.filter(f"_tail OR ({head})"), key, hot, SLICE)
        over_cuts = Window.partitionBy(key).orderBy(SLICE, *order)
        heads = around.withColumns({name: make(over_cuts) for name, make in derive.items()}).filter(head).select(*judged)
        sliced = placed.withColumns({name: make(window) for name, make in derive.items()}).filter(f"NOT ({head})").select(*judged)

    pieces = _pieces(sliced, key, order, 1)
    at_edge = "_island = 0 OR _last"
    inside = pieces.filter(f"run_length > 0 AND (_number = 0 OR NOT ({at_edge}))").select(key, *_RUN)
    edges = of_hot_keys(pieces.filter(at_edge), key, hot, "_number")
    if heads is not None:
        edges = edges.unionByName(_pieces(heads, key, order, 0))
    # a run goes on over a cut if no miss lies between: count the misses of all slices before
    before = f"PARTITION BY {key} ORDER BY {SLICE}, _part, _island ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    joined = (
        edges.selectExpr("*", f"_island + coalesce(sum(if(_last, _island, 0)) OVER ({before}), 0) AS _run")
        .groupBy(key, "_run")
        .agg(
            F.expr("min(run_start) AS run_start"), F.expr("max(run_end) AS run_end"),
            F.expr("sum(run_length) AS run_length"), F.expr("max(peak_value) AS peak_value"),
        )
        .filter("run_length > 0")
        .select(key, *_RUN)
    )
    return inside.union(joined)


def sustained_over(
    readings: DataFrame, column: str, limit: float | Column, minutes: float, **options
) -> DataFrame:
    """Runs above the limit that last longer than ``minutes``."""
    found = runs(readings, F.col(column) > limit, column, **options)
    return found.filter(f"unix_timestamp(run_end) - unix_timestamp(run_start) > {minutes} * 60")


def consecutive_over(
    readings: DataFrame, column: str, limit: float | Column, count: int = 2, **options
) -> DataFrame:
    """Runs above the limit of more than ``count`` readings."""
    found = runs(readings, F.col(column) > limit, column, **options)
    return found.filter(F.col("run_length") > count)


def rising_pct(
    trends: DataFrame, pct: float = 5.0, hours: int = 8, max_gap_hours: int | None = 1,
    column: str = "vibration_avg", **options,
) -> DataFrame:
    """Runs of at least ``hours`` hourly rows that each grew by more than ``pct`` percent.

    By default the row before must be the hour before; ``max_gap_hours=None`` takes the last
    known hour instead.
    """

    def growth(w) -> Column:
        before = F.lag(column).over(w)
        rate = F.try_divide(F.col(column) - before, before) * 100
        if max_gap_hours is None:
            return rate
        gap = F.unix_timestamp("hour_window") - F.unix_timestamp(F.lag("hour_window").over(w))
        return F.when(gap <= max_gap_hours * 3600, rate)

    found = runs(
        trends, F.col("growth_pct") > pct, "growth_pct", order=("hour_window",),
        derive={"growth_pct": growth}, reach=1, needs=("hour_window", column), **options,
    )
    return found.filter(F.col("run_length") >= hours)


def thermal_spikes(
    silver: DataFrame, delta: float = 15.0, max_len: int = 3, baseline_points: int = 12,
    order: tuple[str, ...] = ("timestamp",), rate_per_hour: float | None = None,
    max_delta: float | None = 25.0, min_len: int = 2, **options,
) -> DataFrame:
    """Short runs of heat over the trailing median while the vibration stays normal.

    A reading counts if it is more than ``delta`` and at most ``max_delta`` above the baseline; a run has
    ``min_len`` to ``max_len`` readings.
    ``rate_per_hour`` also asks that the rise since the reading before was faster than that.
    The baseline is the median of the ``baseline_points`` readings before the one at hand.
    """

    def baseline(w) -> Column:
        return F.percentile("temp_c", F.lit(0.5)).over(w.rowsBetween(-baseline_points, -1))

    def rate(w) -> Column:
        seconds = F.unix_timestamp("timestamp") - F.unix_timestamp(F.lag("timestamp").over(w))
        return F.try_divide((F.col("temp_c") - F.lag("temp_c").over(w)) * 3600, seconds)

    outputs = {"_baseline": baseline}
    if rate_per_hour is not None:
        outputs["_rate"] = rate
    rise = F.col("temp_c") - F.col("_baseline")
    hot = (rise > delta) & ~F.col("vibration_anomaly_flag")
    if max_delta is not None:
        hot &= rise <= max_delta
    if rate_per_hour is not None:
        hot &= F.col("_rate") > rate_per_hour
    found = runs(
        silver, hot, "temp_c", order=order, derive=outputs, reach=baseline_points,
        needs=("timestamp", "temp_c", "vibration_anomaly_flag"), **options,
    )
    return found.filter(F.col("run_length").between(min_len, max_len))
