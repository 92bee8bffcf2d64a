"""Ordered history per key that stays even when one key holds a large share of all rows.

Row windows (trailing means, LAG, runs) shuffle on the key, so one busy asset would be one
huge task. Here the few keys that hold more than an even share are cut into slices of near
equal row count.
Each slice is given the rows that come just before it, marked as carried, so a trailing
frame of bounded length gives the same values as over the whole history.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

SLICE = "_slice"
CARRIED = "_carried"

# A key is hot if it has more rows than this, and more than 1 / MAX_HOT_KEYS of all rows.
# So there are never MAX_HOT_KEYS of them, nor more than twice as many slices times
# CUTS_PER_SHARE: the table of hot keys and cuts is safe to broadcast.
MIN_HOT_ROWS = 1_000_000
MAX_HOT_KEYS = 10_000
CUTS_PER_SHARE = 2
# Rows of a hot key that are drawn for each of its slices to find where to cut.
SAMPLES_PER_SLICE = 32
# Halvings of a list of cuts: enough for 2 ** HALVINGS slices of one key.
HALVINGS = 17


def _place(order: list[str]) -> str:
    return f"struct({', '.join(f'{c} AS o{i}' for i, c in enumerate(order))})"


def hot_keys(rows: DataFrame, key: str, order: list[str], min_hot_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """Fewer than MAX_HOT_KEYS rows: key and the places in its order where its slices start.

    Slices are of near equal row count whatever the times are: the cuts are quantiles of a sample
    of the rows, drawn by a hash of their order columns, so a repeated task draws the same. Only
    rows that are equal in all of them cannot be told apart and stay together. Rows are counted
    once; the sample is a second scan, which an empty list of hot keys takes out of the plan.
    """
    per_key = rows.groupBy(F.expr(key).alias("_hot_key")).agg(F.expr("count(1) AS _n"))
    total = per_key.agg(F.expr("coalesce(sum(_n), 0)")).scalar()
    hot = (
        per_key.withColumn("_total", total)
        .selectExpr("*", f"greatest({min_hot_rows}, _total / {MAX_HOT_KEYS}) AS _share")
        .filter("_n > _share")
        .selectExpr("_hot_key", "_n", f"CAST(ceil(_n * {CUTS_PER_SHARE} / _share) AS BIGINT) AS _slices")
    )
    draw = f"pmod(xxhash64({', '.join([key, *order])}), 1048576) / 1048576"
    in_order = "PARTITION BY _hot_key ORDER BY _place"
    return (
        rows.join(F.broadcast(hot), F.expr(f"{key} <=> _hot_key"))
        .filter(f"{draw} < {SAMPLES_PER_SLICE} * _slices / _n")
        .selectExpr("_hot_key", "_slices", f"{_place(order)} AS _place")
        .selectExpr(
            "_hot_key", "_slices", "_place", f"row_number() OVER ({in_order}) AS _at",
            "count(1) OVER (PARTITION BY _hot_key) AS _drawn",
        )
        .filter("floor(_at * _slices / _drawn) > floor((_at - 1) * _slices / _drawn)")
        .groupBy("_hot_key")
        .agg(F.expr("sort_array(collect_set(_place)) AS _cuts"))
    )


def cut_table(
    df: DataFrame, key: str, order: list[str], rows: DataFrame | None = None, min_hot_rows: int = MIN_HOT_ROWS,
) -> DataFrame:
    """Hot keys of ``df`` and their cuts; ``rows`` may name a cheaper frame with the same keys and order columns."""
    cheaper = rows is not None and {key, *order} <= set(rows.columns)
    return hot_keys(rows if cheaper else df, key, order, min_hot_rows)


def numbered_slices(df: DataFrame, key: str, order: list[str], hot: DataFrame) -> DataFrame:
    """Add the slice number: 0 for an ordinary key, 1 and up in order for a hot one."""
    # how many cuts are at or before the row: a binary search, comparing all order columns
    steps = ", ".join(str(1 << b) for b in reversed(range(HALVINGS)))
    passed = f"get(_cuts, low + jump - 1) <= {_place(order)}"
    number = f"1 + aggregate(array({steps}), 0, (low, jump) -> if({passed}, low + jump, low))"
    return (
        df.join(F.broadcast(hot), F.expr(f"{key} <=> _hot_key"), "left")
        .selectExpr(*df.columns, f"CAST(if(_cuts IS NULL, 0, {number}) AS BIGINT) AS {SLICE}")
    )


def with_slices(
    df: DataFrame, key: str, order: list[str], rows: DataFrame | None = None, min_hot_rows: int = MIN_HOT_ROWS,
) -> DataFrame:
    """Add the slice number; the cuts are found from ``rows`` if it is given (see cut_table)."""
    return numbered_slices(df, key, order, cut_table(df, key, order, rows, min_hot_rows))


def of_hot_keys(df: DataFrame, key: str, hot: DataFrame, number: str) -> DataFrame:
    """The rows of hot keys, by a join and not by a filter on the slice.

    A filter would be pushed below the shuffle, which then could not be shared with the other rows. The join
    also takes the whole branch out at run time if no key is hot. That ``number`` is one of the key's slices always holds; it
    keeps the broadcast table equal to that of ``numbered_slices``, so it is built once.
    """
    same = F.expr(f"{key} <=> _hot_key AND {number} <= size(_cuts) + 1")
    return df.join(F.broadcast(hot), same).select(*df.columns)


def carried_rows(
    sliced: DataFrame, key: str, order: list[str], values: list[str], depth: int
) -> DataFrame:
    """For each slice of a hot key the ``depth`` rows just before it, marked as carried."""
    fields = list(dict.fromkeys([*order, *values]))
    # the last rows of every slice; the rank filter cuts each group before the shuffle
    newest_first = ", ".join(f"{c} DESC" for c in order)
    tails = (
        sliced.filter(f"{SLICE} > 0")
        .selectExpr(
            key, SLICE, *fields,
            f"row_number() OVER (PARTITION BY {key}, {SLICE} ORDER BY {newest_first}) AS _back",
        )
        .filter(f"_back <= {depth}")
        .groupBy(key, SLICE)
        .agg(F.expr(f"sort_array(collect_list(struct({', '.join(fields)}))) AS _tail"))
    )
    # a slice may hold fewer than `depth` rows, so look back over that many slices
    earlier = f"PARTITION BY {key} ORDER BY {SLICE} ROWS BETWEEN {depth} PRECEDING AND 1 PRECEDING"
    return (
        tails.selectExpr(key, SLICE, f"flatten(collect_list(_tail) OVER ({earlier})) AS _before")
        .selectExpr(
            key, SLICE,
            f"inline(slice(_before, greatest(size(_before) - {depth}, 0) + 1, {depth}))",
        )
        .selectExpr("*", f"true AS {CARRIED}")
    )


def with_lookback(
    df: DataFrame, key: str, order: list[str], values: list[str], depth: int,
    rows: DataFrame | None = None, min_hot_rows: int = MIN_HOT_ROWS,
) -> DataFrame:
    """All rows with their slice, plus up to ``depth`` carried rows before each hot slice.

    Carried rows hold only key, order and ``values``.
    """
    sliced = with_slices(df, key, order, rows, min_hot_rows)
    carried = carried_rows(sliced, key, order, values, depth)
    return sliced.selectExpr("*", f"false AS {CARRIED}").unionByName(carried, allowMissingColumns=True)


def by_slice(key: str, order: list[str]) -> WindowSpec:
    return Window.partitionBy(key, SLICE).orderBy(*order)


def own_rows(df: DataFrame, keep_slice: bool = False) -> DataFrame:
    """Drop the carried rows again."""
    return df.filter(f"NOT {CARRIED}").drop(*([CARRIED] if keep_slice else [CARRIED, SLICE]))


def trailing(
    df: DataFrame, key: str, order: list[str], values: list[str], points: int,
    outputs: dict[str, Callable[[WindowSpec], Column]], rows: DataFrame | None = None, keep_slice: bool = False,
    min_hot_rows: int = MIN_HOT_ROWS,
) -> DataFrame:
    """Add columns computed over the last ``points`` rows of each key.

    ``outputs`` maps a new column name to a function from the ordered window (no frame set)
    to a Column.
    """
    history = with_lookback(df, key, order, values, points - 1, rows, min_hot_rows)
    window = by_slice(key, order)
    return own_rows(
        history.withColumns({name: make(window) for name, make in outputs.items()}), keep_slice
    )
