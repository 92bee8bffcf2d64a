"""Named data-quality expectations."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F

# The gates of the standard tables, name -> (predicate, drops the row?)
ASSET_RULES = {
    "valid_rated_max_vibration": ("rated_max_vibration > 0", True),
    "valid_rated_max_temp": ("rated_max_temp > 0", True),
}
READING_RULES = {
    "valid_asset_id": ("asset_id IS NOT NULL", False),
    "valid_timestamp": ("timestamp IS NOT NULL", False),
}
LOG_RULES = {"valid_work_order": ("work_order_id IS NOT NULL", True)}


def _holds(predicate: str | Column) -> Column:
    """The predicate as true or false: unknown counts as failed."""
    column = F.expr(predicate) if isinstance(predicate, str) else predicate
    return F.coalesce(column, F.lit(False))


def _observed(df: DataFrame, name: str, predicate, observation: Observation | None) -> DataFrame:
    # streams are observed by name and reported in the query progress
    return df.observe(
        observation or name,
        F.count_if(_holds(predicate)).alias("passed"),
        F.count_if(~_holds(predicate)).alias("failed"),
    )


def expect(df: DataFrame, name: str, predicate, observation: Observation | None = None) -> DataFrame:
    """Keep every row; count those that fail, as a by-product of whatever job reads the result."""
    return _observed(df, name, predicate, observation)


def expect_or_drop(
    df: DataFrame, name: str, predicate, observation: Observation | None = None
) -> DataFrame:
    """Drop the rows that fail and count them."""
    return _observed(df, name, predicate, observation).filter(_holds(predicate))


def apply_rules(df: DataFrame, rules: dict[str, tuple[str, bool]]) -> DataFrame:
    """Apply gates without counting (see `quality_report` for the counts)."""
    dropping = [_holds(predicate) for predicate, drops in rules.values() if drops]
    return df.filter(reduce(lambda a, b: a & b, dropping)) if dropping else df


def quality_report(df: DataFrame, rules: dict[str, tuple[str, bool]]) -> DataFrame:
    """One row per expectation with passed, failed and total, from one pass over the data."""
    counts = df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(_holds(predicate)).alias(f"_p_{name}") for name, (predicate, _) in rules.items()],
    )
    lines = F.array(
        *[
            F.struct(
                F.lit(name).alias("expectation"),
                F.lit("drop" if drops else "warn").alias("action"),
                F.col(f"_p_{name}").alias("passed"),
                (F.col("total") - F.col(f"_p_{name}")).alias("failed"),
                F.col("total"),
            )
            for name, (_, drops) in rules.items()
        ]
    )
    return counts.select(F.inline(lines))


def drop_missing(df: DataFrame, *keys: str) -> DataFrame:
    return df.dropna(subset=list(keys))


def range_check(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Add ``out_of_range``: names of the columns that are missing or outside their bounds."""
    marks = []
    for name, (low, high) in bounds.items():
        value = F.col(name)
        inside = value.isNotNull()
        if low is not None:
            inside &= value >= low
        if high is not None:
            inside &= value <= high
        marks.append(F.when(~_holds(inside), F.lit(name)))
    # concat_ws skips the columns that are fine
    return df.withColumn("out_of_range", F.concat_ws(",", *marks))
