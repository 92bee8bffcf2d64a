"""Trailing statistics over the last readings of each asset."""

from bisect import bisect_left, insort
from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from rotorwatch import schemas as S
from rotorwatch.operators.history_slices import by_slice, own_rows, trailing, with_lookback
from rotorwatch.session import python_on_workers

KEY = "asset_id"
ORDER = ["timestamp"]
# A window sorts a median's frame again for every row. Longer frames than this are kept sorted instead.
LONG_FRAME = 25


def _mean(column: str, points: int):
    return lambda w: F.avg(column).over(w.rowsBetween(1 - points, 0))


def rolling_mean(
    df: DataFrame, columns: dict[str, str], points: int = S.SMOOTHING_POINTS,
    key: str = KEY, order: list[str] = ORDER, **options,
) -> DataFrame:
    """Trailing mean of several columns (source -> new name) in one sorted pass."""
    outputs = {name: _mean(column, points) for column, name in columns.items()}
    return trailing(df, key, order, list(columns), points, outputs, **options)


def ewma(
    df: DataFrame, column: str, alpha: float, points: int, name: str = "ewma",
    key: str = KEY, order: list[str] = ORDER, **options,
) -> DataFrame:
    """Exponentially weighted mean of the last ``points`` values; weights add up to one."""

    def weighted(w) -> Column:
        total, weights = F.lit(0.0), F.lit(0.0)
        for back in range(points):
            value = F.lag(column, back).over(w)
            weight = (1.0 - alpha) ** back
            total += F.coalesce(value * weight, F.lit(0.0))
            weights += F.when(value.isNotNull(), weight).otherwise(0.0)
        return F.try_divide(total, weights)

    return trailing(df, key, order, [column], points, {name: weighted}, **options)


def rolling_median(
    df: DataFrame, column: str, points: int, name: str = "rolling_median",
    key: str = KEY, order: list[str] = ORDER, **options,
) -> DataFrame:
    """Median of the last ``points`` values; nulls are left out, NaN is the greatest value, a frame without values has none.

    Short frames are a window. Long ones slide over the rows in Arrow batches: the frame stays sorted, so a row costs
    one insertion and one removal. A task holds one frame and one batch, however long the history is.
    """

    def median(w) -> Column:
        return F.percentile(column, F.lit(0.5)).over(w.rowsBetween(1 - points, 0))

    if points <= LONG_FRAME:
        return trailing(df, key, order, [column], points, {name: median}, **options)
    python_on_workers(df.sparkSession)
    history = with_lookback(df, key, order, [column], points - 1, **options)
    # the window leaves its rows in order, slice after slice; the first of each has place 1
    placed = history.withColumns({"_place": F.row_number().over(by_slice(key, order)), "_median_of": F.col(column).cast("double")})
    slid = placed.mapInArrow(_sliding(points, name), StructType([*placed.schema, StructField(name, DoubleType())]))
    return own_rows(slid).drop("_place", "_median_of")


class SortedFrame:
    """The last ``points`` values, also in sorted order."""

    def __init__(self, points: int):
        self.points, self.held, self.sorted, self.nans = points, deque(), [], 0

    def push(self, value: float | None) -> float | None:
        """Take a value in, let the oldest go, and give the median."""
        self.held.append(value)
        if value is not None:
            if value != value:
                self.nans += 1
            else:
                insort(self.sorted, value)
        if len(self.held) > self.points:
            oldest = self.held.popleft()
            if oldest is not None:
                if oldest != oldest:
                    self.nans -= 1
                else:
                    del self.sorted[bisect_left(self.sorted, oldest)]
        count = len(self.sorted) + self.nans
        if not count:
            return None
        low, high = self._at((count - 1) // 2), self._at(count // 2)
        return low if low == high else low * 0.5 + high * 0.5

    def _at(self, place: int) -> float:
        return self.sorted[place] if place < len(self.sorted) else float("nan")


def _sliding(points: int, name: str):
    def run(batches):
        frame = SortedFrame(points)
        for batch in batches:
            medians = []
            for place, value in zip(batch.column("_place").to_pylist(), batch.column("_median_of").to_pylist()):
                if place == 1:
                    frame = SortedFrame(points)
                medians.append(frame.push(value))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(medians, pa.float64())], [*batch.schema.names, name])

    return run


def clip_outliers(
    df: DataFrame, column: str, points: int, k: float = 3.0, name: str = "clipped",
    key: str = KEY, order: list[str] = ORDER, **options,
) -> DataFrame:
    """Clip to mean ± k·stddev of the ``points`` readings before this one.

    The reading itself is left out of its own limits; with fewer than two earlier readings
    nothing is clipped.
    """

    def clipped(w) -> Column:
        frame = w.rowsBetween(-points, -1)
        mean, spread = F.avg(column).over(frame), F.stddev_samp(column).over(frame)
        value = F.col(column)
        return (
            F.when(value > mean + k * spread, mean + k * spread)
            .when(value < mean - k * spread, mean - k * spread)
            .otherwise(value)
        )

    return trailing(df, key, order, [column], points + 1, {name: clipped}, **options)
