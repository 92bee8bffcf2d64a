"""Operators with state per asset on live streams: trailing means with late readings, and entries into a risk level.

Both keep their state in Spark's state store, by asset, so it is checkpointed with the query and moves with it. An
asset's readings of one micro-batch meet in one task, as any keyed state asks for; what is held per asset is
bounded by the delay, not by its history.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rotorwatch import schemas as S
from rotorwatch.session import python_on_workers

KEY = "asset_id"
NO_TIME = -(2**63)  # rows without a time come first, as in a sort
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state(stream: DataFrame, processor: StatefulProcessor, schema: T.StructType, time_mode: str) -> DataFrame:
    """``processor`` over the rows of each asset. Sets the session's state store to the one such processors need."""
    python_on_workers(stream.sparkSession)
    stream.sparkSession.conf.set(PROVIDER, STORE)
    return stream.groupBy(KEY).transformWithStateInPandas(processor, schema, "Append", time_mode)


def _micros(seconds: str) -> int:
    """Microseconds of an interval such as ``2 hours``."""
    return int(pd.Timedelta(seconds) / pd.Timedelta(microseconds=1))


class TrailingMeans(StatefulProcessor):
    """Trailing means over the last ``points`` readings; a late reading issues the rows behind it anew.

    Held per asset, sorted: the readings of the last ``delay`` before its newest one, and the ``points - 1`` before
    those. A reading at or before the last of the latter has lost its neighbours: it comes out marked late, without means.
    Rows of the micro-batch and of the state: order columns, then value and null mark of each column.
    """

    def __init__(self, points: int, delay: int, order_types: list[T.DataType], columns: list[str], names: list[str]):
        self.points, self.delay, self.columns, self.names = points, delay, columns, names
        self.order = [f"order{i}" for i in range(len(order_types))]
        self.schema = T.StructType([T.StructField(o, t) for o, t in zip(self.order, order_types)])
        for i in range(len(columns)):
            self.schema = self.schema.add(f"value{i}", T.DoubleType()).add(f"null{i}", T.BooleanType())

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", self.schema)
        # how often the asset was seen, and how many of the first held readings only serve as neighbours
        self.seen = handle.getValueState("seen", "issue long, closed int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names, width, last = self.schema.names, len(self.order), self.points - 1
        issue, closed = self.seen.get() if self.seen.exists() else (0, 0)
        held = [tuple(r) for r in self.held.get()] if issue else []
        edge = held[closed - 1][:width] if closed else None
        fresh, late = [], []
        for frame in rows:
            for row in zip(*(frame[n].tolist() for n in names)):
                (late if edge is not None and row[:width] <= edge else fresh).append(row)
        both = sorted([(r, False) for r in held] + [(r, True) for r in fresh], key=lambda r: r[0][:width])
        held, again, left = [r for r, _ in both], [], 0
        for i, (_, is_fresh) in enumerate(both):  # a fresh reading changes its own mean and those of the next ones
            left = self.points if is_fresh else left - 1
            if left > 0:
                again.append(i)
        out = [held[i][:width] + tuple(self._mean(held, i, c) for c in range(len(self.columns))) + (False, issue) for i in again]
        out += [r[:width] + (None,) * len(self.columns) + (True, issue) for r in late]
        if held:
            floor = max(held[-1][0] - self.delay, NO_TIME)
            first_open = max(closed, next(i for i, r in enumerate(held) if r[0] >= floor))
            cut = max(first_open - last, 0)
            closed = first_open - cut if cut or closed else 0
            held = held[cut:]
            self.held.put(held)
        self.seen.update((issue + 1, closed))
        if out:
            frame = pd.DataFrame(out, columns=[*self.order, *self.names, "late", "issue"])
            frame.insert(0, KEY, key[0])
            yield frame.astype({n: "float64" for n in self.names})

    def _mean(self, held: list[tuple], i: int, column: int) -> float | None:
        at = len(self.order) + 2 * column
        values = [r[at] for r in held[max(i - self.points + 1, 0):i + 1] if not r[at + 1]]
        return sum(values) / len(values) if values else None

    def close(self) -> None:
        pass


def rolling_stream(
    stream: DataFrame, columns: dict[str, str], delay: str, points: int = S.SMOOTHING_POINTS, order: tuple[str, ...] = ("timestamp",)
) -> DataFrame:
    """Trailing means (source -> new name) on a live stream: asset_id, order columns, means, late, issue.

    The order starts with the event time and identifies a reading of an asset. A row is issued when its reading comes, and
    again whenever a reading up to ``delay`` late changes its mean: `newest_issue` of what was written so far equals the
    batch form. Readings that are later still keep their row, marked late and without means.
    """
    types = [stream.schema[c].dataType for c in order]
    processor = TrailingMeans(points, _micros(delay), [T.LongType(), *types[1:]], list(columns), list(columns.values()))
    slim = stream.select(
        KEY, F.coalesce(F.unix_micros(order[0]), F.lit(NO_TIME)).alias("order0"), *[F.col(c).alias(f"order{i}") for i, c in enumerate(order) if i],
        *[x for i, c in enumerate(columns) for x in (F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"value{i}"), F.col(c).isNull().alias(f"null{i}"))])
    schema = T.StructType([T.StructField(KEY, stream.schema[KEY].dataType), *processor.schema.fields[:len(order)]])
    for name in columns.values():
        schema = schema.add(name, T.DoubleType())
    issued = with_state(slim, processor, schema.add("late", T.BooleanType()).add("issue", T.LongType()), "None")
    time = F.when(F.col("order0") > NO_TIME, F.timestamp_micros("order0"))
    return issued.select(KEY, time.alias(order[0]), *[F.col(f"order{i}").alias(c) for i, c in enumerate(order) if i], *columns.values(), "late", "issue")


def newest_issue(issued: DataFrame, order: tuple[str, ...] = ("timestamp",)) -> DataFrame:
    """The last row issued for each reading. One aggregation, combined before it is shuffled."""
    rest = [c for c in issued.columns if c not in (KEY, *order, "issue")]
    newest = F.max_by(F.struct(*rest), "issue").alias("_row")
    return issued.groupBy(KEY, *order).agg(newest).select(KEY, *order, "_row.*")


class Entries(StatefulProcessor):
    """Rows of a health history wait until the watermark has passed them; then, in order of time, those that enter an at-risk level come out."""

    def __init__(self, forget_after: int | None):
        self.forget_after = forget_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, risk_level string")
        self.last = handle.getValueState("last", "at long, risk_level string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            levels = [None if pd.isna(r) else r for r in frame["risk_level"]]
            found = list(zip(frame["at"].tolist(), levels))
            first = min([first, *(a for a, _ in found)] if first is not None else [a for a, _ in found])
            self.waiting.appendList(found)
        self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: (r[0], r[1] or "")) if self.waiting.exists() else []
        due, later = [r for r in waiting if r[0] < passed], [r for r in waiting if r[0] >= passed]
        before = tuple(self.last.get()) if self.last.exists() else None
        out = []
        for at, level in due:
            previous = before[1] if before else None
            if level in S.AT_RISK and level != previous:
                out.append((key[0], at, level, previous))
            before = (at, level)
        if due:
            self.last.update(before)
            self.waiting.put(later) if later else self.waiting.clear()
        if later:
            self._wake(later[0][0])
        elif before and self.forget_after is not None:
            if before[0] + self.forget_after < passed:
                self.last.clear()
            else:
                self._wake(before[0] + self.forget_after)
        if out:
            yield pd.DataFrame(out, columns=[KEY, "at", "risk_level", "previous_risk"])

    def _wake(self, micros: int | None) -> None:
        """Call again once the watermark has passed a time."""
        if micros is not None:
            self.handle.registerTimer(max(micros // 1000 + 1, 0))

    def close(self) -> None:
        pass


def risk_entries_stream(history: DataFrame, delay: str, forget_after: str | None = None) -> DataFrame:
    """`serving.risk_changes` on a live stream of (asset_id, calculated_at, risk_level), for rows up to ``delay`` late.

    A row is judged once the watermark has passed it, against the asset's row before it in time, whichever
    came first. Of rows of equal time the order is that of their levels. Rows without a time or behind the watermark are dropped
    by Spark and counted in its progress. ``forget_after`` ends the memory of an asset without rows for so long; its next row then counts
    as its first.
    """
    schema = T.StructType([T.StructField(KEY, history.schema[KEY].dataType), T.StructField("at", T.LongType())])
    schema = schema.add("risk_level", T.StringType()).add("previous_risk", T.StringType())
    slim = history.filter("calculated_at IS NOT NULL").withWatermark("calculated_at", delay).select(
        KEY, "calculated_at", F.unix_micros("calculated_at").alias("at"), "risk_level")
    entries = with_state(slim, Entries(None if forget_after is None else _micros(forget_after)), schema, "EventTime")
    return entries.select(KEY, F.timestamp_micros("at").alias("calculated_at"), "risk_level", "previous_risk")
