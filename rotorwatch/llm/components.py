"""Connected components and link search inside shared cells, as plain joins and aggregations.

No step lists all pairs of a cell: in a few rounds, members are compared with one hub per cell, another in each cell and
round, and only members that this leaves in different components are compared with each other. A hub has then met all members of its cell
and leaves it. So a cell full of mutual neighbours costs a few comparisons per member, and still no link between two components is missed.
"""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotorwatch.llm.common import dropped, landed


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every node of ``edges`` (a, b): root is the smallest id that can be reached.

    Each round hooks every node to its smallest neighbour, follows that pointer once more and contracts the edges;
    at least one end of each edge goes, so the rounds are logarithmic. The pointers of all rounds are
    then followed backwards. Every round is a written table.
    """
    edges = landed(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    rounds = []
    while not edges.isEmpty():
        held = edges
        both = edges.union(edges.select("b", "a"))
        first = both.groupBy("a").agg(F.min("b").alias("to")).select(F.col("a").alias("id"), F.least("a", "to").alias("to"))
        further = first.select(F.col("id").alias("to"), F.col("to").alias("_further"))
        hooks = landed(first.join(further, "to").select("id", F.col("_further").alias("to")), "hooks")
        rounds.append(hooks)
        for end in ("a", "b"):
            moved = hooks.select(F.col("id").alias(end), F.col("to").alias("_to"))
            edges = edges.join(moved, end).drop(end).withColumnRenamed("_to", end)
        edges = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        done, edges = held, landed(edges.distinct(), "edges")
        dropped(done)
    if not rounds:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
    found = rounds[0]
    for hooks in rounds[1:]:
        later = hooks.select(F.col("id").alias("to"), F.col("to").alias("_further"))
        found = found.join(later, "to", "left").select("id", F.coalesce("_further", "to").alias("to"))
    found = landed(found.select("id", F.col("to").alias("root")), "roots")
    dropped(edges, *rounds)
    return found


# Rounds of comparisons with a hub per cell before members of different components are compared.
HUB_ROUNDS = 2
# Rows that meet their marks at once, a few hundred bytes each. More are taken in slices, so that shuffled marks stay small beside the input
# where many members share cells by chance.
SLICE_ROWS = 2_000_000


def linked(
    members: DataFrame,
    close: Callable[[Callable[[str], Column], Callable[[str], Column]], Column],
    marks_of: Callable[[DataFrame], DataFrame] | None = None,
    confirm: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(id, root) of all ids that some link ties to another one.

    ``members`` (cell, id): ids (longs) that share a cell are candidates. ``close`` is a test of two members by id and the further
    columns that ``marks_of`` gives, as a written table, for ids (with ``confirm`` only; it is asked once, for the ids that share a cell at all). ``close`` is the
    exact test, unless ``confirm`` is given: then it may pass pairs that are no links, and ``confirm`` keeps the links among pairs (a, b).

    Without ``confirm`` the test is made while members are joined, so pairs that are no links never leave the join. With it, marks do
    not travel with every member of every cell: a round has one target for all cells, so that cells of nearly the same
    members have the same hub and give the same pairs of ids. Each pair is tested once in all rounds, and a cell of two members is
    one pair and takes no part in them. Only members that are compared in pairs at the end carry their marks.
    """

    def ends(x: Column, y: Column) -> list[Column]:
        return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    def tested(found: DataFrame) -> DataFrame:
        """The distinct pairs (a, b) that pass ``close``."""
        if marks is not None:
            for end in ("a", "b"):
                found = found.join(marks.select(*[F.col(c).alias(end if c == "id" else f"{end}_{c}") for c in marks.columns]), end)
        near = found.filter(close(lambda c: F.col("a" if c == "id" else f"a_{c}"), lambda c: F.col("b" if c == "id" else f"b_{c}")))
        return near.select("a", "b")

    def in_slices(rows: DataFrame, by: list[str], made: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``made`` of the rows of a written table, a slice at a time, written."""
        n = max(1, -(-rows.count() // SLICE_ROWS))
        parts = [landed(made(rows.filter(F.pmod(F.xxhash64(F.lit(n), *by), F.lit(n)) == i) if n > 1 else rows), "near") for i in range(n)]
        return parts[0] if n == 1 else landed(reduce(DataFrame.union, parts).distinct(), "near")

    def unseen(found: DataFrame) -> DataFrame:
        return found if seen is None else found.join(seen, ["a", "b"], "left_anti")

    def held(rows: DataFrame) -> DataFrame:
        return rows.groupBy("cell").agg(F.min("id").alias("_first"), F.max("id").alias("_last"), F.count("*").alias("_n")).filter("_first < _last")

    seen = twos = marks = None
    if confirm:
        # members are shuffled once: their cells are counted where they lie, and most are alone
        dealt = members.repartition("cell")
        shared = landed(dealt.join(held(dealt).hint("shuffle_hash"), "cell"), "cells")
        if marks_of:
            ids = landed(shared.select("id").distinct(), "ids")
            marks = marks_of(ids)
            dropped(ids)
        twos = shared.filter("_n = 2 AND id = _first").select(F.col("_first").alias("a"), F.col("_last").alias("b"))
        inside = shared.filter("_n > 2").select("cell", "id")
    else:
        inside = shared = landed(members.join(held(members).select("cell"), "cell"), "cells")
    open_cells, links, roots = inside.withColumn("label", F.col("id")), None, None
    for turn in range(HUB_ROUNDS):
        target = F.xxhash64(F.lit(turn)) if confirm else F.xxhash64("cell", F.lit(turn))
        # the hub is the member next to the target, by the bits of the ids
        off = F.col("id").bitwiseXOR(target)
        hubs = open_cells.groupBy("cell").agg(F.min(off).bitwiseXOR(target).alias("_hub"), F.min_by("label", off).alias("_hub_label"))
        met = landed(open_cells.join(hubs, "cell").filter("id <> _hub"), "met")
        dropped(shared if turn == 0 and twos is None else None, open_cells if turn else None)
        found = met.filter("label <> _hub_label")
        if not confirm:
            found = found.filter(close(lambda c: F.col(c), lambda c: F.col("_hub")))
        found = found.select(*ends(F.col("id"), F.col("_hub"))).distinct()
        if confirm:
            fresh = landed(found.union(twos).distinct() if seen is None else unseen(found), "pairs")
            seen = fresh if seen is None else seen.union(fresh)
            found = confirm(in_slices(fresh, ["a", "b"], tested))
            dropped(shared if turn == 0 else None)
        known = links
        links = landed(found if links is None else links.union(found), "links")
        dropped(known, roots)
        roots = components(links)
        # cells whose other members are all tied together need no more comparisons
        named = met.select("cell", "id").join(roots, "id", "left").withColumn("label", F.coalesce("root", "id")).drop("root")
        named = landed(named, "labelled")
        mixed = named.groupBy("cell").agg(F.min("label").alias("_first"), F.max("label").alias("_last")).filter("_first < _last").select("cell")
        open_cells = landed(named.join(mixed, "cell"), "open-cells")
        dropped(met, named)
        if open_cells.isEmpty():
            return roots

    def compared(some: DataFrame) -> DataFrame:
        """Distinct pairs (a, b) of members of one cell and different labels that pass ``close``: none of two members of the main label."""
        sizes = some.groupBy("cell", "label").agg(F.count("*").alias("n"))
        mains = sizes.groupBy("cell").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
        mixed = some.join(mains, "cell")
        left, right = mixed.filter("label <> main"), mixed
        if marks is not None:
            left, right = left.join(marks, "id"), right.join(marks, "id")
        x = left.select("cell", *[F.col(c).alias(f"x_{c}") for c in left.columns if c != "cell"])
        y = right.select("cell", *[F.col(c).alias(f"y_{c}") for c in right.columns if c != "cell"])
        once = (F.col("y_label") == F.col("y_main")) | (F.col("x_id") < F.col("y_id"))
        near = close(lambda c: F.col(f"x_{c}"), lambda c: F.col(f"y_{c}"))
        found = x.join(y, (x["cell"] == y["cell"]) & (F.col("x_label") != F.col("y_label")) & once & near)
        return unseen(found.select(*ends(F.col("x_id"), F.col("y_id"))).distinct())

    rest = in_slices(open_cells, ["cell"], compared)
    if confirm:
        rest = landed(confirm(rest), "links")
    return components(links.union(rest))
