"""Conversation structure repair: the cheapest edits that make the roles of a conversation (system)? (user assistant)+, or nothing.

Rows are taken by turn (null first), then role, then a hash of the text. A row is blank (no character but white space), else a
duplicate (role and text seen earlier), else truncated (its last character is no end of a sentence), else sound. Edits and their costs: Keep 0,
Rerole to user or assistant 1, Delete 2 (the only one for blank and duplicate rows), Insert an empty user or assistant row 5; a truncated
row that is not deleted costs 5 more. Of the cheapest sequences of edits the ASCII-least sequence of initials counts.

Steps. (1) Rows shrink to conversation, turn, role, text hash and a letter for role initial and fault; equal rows are counted before they are
shuffled, first occurrences are a minimum per (conversation, role, hash). (2) The letters are sorted over all tasks by range, so a
conversation with a third of all rows is sorted by many tasks, each of which hands on one string of letters. (3) ``edits``: a
conversation's letters, one byte a row, go through the dynamic program. Costs of the rest are computed backward, and kept only at
every square-root-th row; walking forward, one block of costs at a time is computed again from its checkpoint. (4) ``repaired_rows``:
texts and edits meet sorted, row by row; no task holds a conversation's texts.

Null roles and texts count as one space; a null conversation id is a conversation. The string of edits of a conversation is one value,
and whatever reads all its repaired rows in order (a hash of them) is one task's stream, as such a result asks for.
"""

import hashlib
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotorwatch.llm.common import landed, use_python

WHITE = " \t\n\v\f\r"
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
INITIALS, FAULTS = " sua", ("sound", "truncated", "blank", "duplicate")
# States: nothing yet, after the system row, after a user row, after an assistant row; what a user or assistant row leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEPT = {(START, "s"): SYSTEM, **{(q, "ua"[n == ASSISTANT]): n for q, n in NEXT.items()}}
END = (0, 2 * INSERT, INSERT, 0)  # what a conversation that ends in a state still costs


def letter(initial: Column, fault: Column) -> Column:
    """One letter for the role's initial (s, u, a or another) and the fault's number."""
    return F.char(F.lit(65) + F.greatest(F.instr(F.lit(INITIALS), initial) - 1, F.lit(0)) * 4 + fault)


def meaning(code: str) -> tuple[str, int]:
    return INITIALS[(ord(code) - 65) // 4], (ord(code) - 65) % 4


def damaged(rows: DataFrame) -> DataFrame:
    """The rows of conversations with faults put in by crc32 of ``conv_id:turn``, and ``left``: false for a row that is dropped.

    Of twenty remainders, 0 drops the row, 1 empties its text, 2 takes out its sentence ends, 3 repeats it, 4 makes it the user's.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind, text = F.crc32(key.cast("binary")) % 20, F.coalesce("text", space)
    return rows.select(
        "conv_id", "turn", (kind != 0).alias("left"), F.when(kind == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")


def marked(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, h (a hash of the text), blank, cut of every row. Equal hashes and roles are equal rows."""
    text = F.coalesce("text", F.lit(" "))
    last = F.right(F.rtrim(text, F.lit(WHITE)), F.lit(1))
    return rows.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("h"),
        (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))


def letters(rows: DataFrame) -> DataFrame:
    """conv_id and letters: one letter per row of a conversation, in order."""
    counted = marked(rows).groupBy("conv_id", "turn", "role", "h", "blank", "cut").agg(F.count(F.lit(1)).alias("n"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    own = [F.col(c).alias(f"_{c}") for c in ("conv_id", "role", "h")]
    first = counted.groupBy(*own).agg(F.min(place).alias("first"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("role") == F.col("_role")) & (F.col("h") == F.col("_h"))
    joined = counted.withColumn("place", place).join(first, same)
    initial = F.left("role", F.lit(1))
    again = F.when(F.col("blank"), 2).otherwise(3)
    alone = F.when(F.col("blank"), 2).when(F.col("place") > F.col("first"), 3).when(F.col("cut"), 1).otherwise(0)
    lettered = joined.select("conv_id", "turn", "role", "h", letter(initial, alone).alias("one"), letter(initial, again).alias("more"), "n")
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "h"]
    ranged = lettered.repartitionByRange(*order).sortWithinPartitions(*order).drop("role", "h")

    schema = T.StructType([rows.schema["conv_id"], T.StructField("task", T.LongType()), T.StructField("part", T.StringType())])
    parts = ranged.withColumn("task", F.spark_partition_id().cast("long")).mapInArrow(_strings, schema)
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("task", "part"))), lambda x: x["part"])
    return parts.groupBy("conv_id").agg(F.array_join(in_order, "").alias("letters"))


def _strings(batches) -> Iterator[pa.RecordBatch]:
    """Runs of equal (conv_id, task) of sorted rows, their letters joined."""
    key, own, done, names, types = None, [], [], ["conv_id", "task", "part"], None

    def batch_of(found):
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], types[i]) for i in range(3)], names)

    for batch in batches:
        types = [batch.column("conv_id").type, pa.int64(), pa.string()]
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "task", "one", "more", "n")]
        for conv, task, one, more, n in zip(*columns):
            if (conv, task) != key:
                if own:
                    done.append((*key, "".join(own)))
                key, own = (conv, task), []
            own.append(one + more * (n - 1))
        if len(done) >= 1000:
            yield batch_of(done)
            done = []
    if own:
        yield batch_of([*done, (*key, "".join(own))])


def before(code: str, after: list[int] | tuple[int, ...]) -> list[int]:
    """Least costs per state in front of a row, from those behind it."""
    initial, fault = meaning(code)
    costs = [DELETE + c for c in after]
    if fault < 2:
        extra = TRUNCATED if fault else 0
        for q, n in NEXT.items():
            costs[q] = min(costs[q], REROLE + extra + after[n])
        for (q, i), n in KEPT.items():
            if i == initial:
                costs[q] = min(costs[q], extra + after[n])
    user, assistant = costs[USER], costs[ASSISTANT]
    costs[USER], costs[ASSISTANT] = min(user, INSERT + assistant), min(assistant, INSERT + user)
    for q in (START, SYSTEM):
        costs[q] = min(costs[q], INSERT + costs[USER])
    return costs


def edits(codes: str) -> tuple[int, str]:
    """The least cost and the ASCII-least initials of edits of that cost."""
    n = len(codes)
    step = isqrt(n) + 1
    checkpoints, costs = {n: END}, END
    for i in range(n - 1, -1, -1):
        costs = before(codes[i], costs)
        if i % step == 0:
            checkpoints[i] = costs
    total, state, out = costs[START], START, []
    for low in range(0, n, step):
        high = min(low + step, n)
        block = [checkpoints[high]]  # the costs behind each row of the block, last row first
        for i in range(high - 1, low, -1):
            block.append(before(codes[i], block[-1]))
        here = checkpoints[low]
        for i in range(low, high):
            after = block.pop()
            state, here = _walk(codes[i], state, here, after, out)
    while END[state]:
        state = NEXT[state]
        out.append("I")
    return total, "".join(out)


def _walk(code: str, state: int, here, after, out: list[str]):
    """Append the edits of one row, inserts in front of it included; the ASCII-least tight one each time. Gives state and costs behind it."""
    initial, fault = meaning(code)
    extra = TRUNCATED if fault else 0
    while True:
        if DELETE + after[state] == here[state]:
            out.append("D")
            return state, after
        if INSERT + here[NEXT[state]] == here[state]:
            state = NEXT[state]
            out.append("I")
            continue
        kept = KEPT.get((state, initial))
        if kept is not None and extra + after[kept] == here[state]:
            out.append("K")
            return kept, after
        out.append("R")
        return NEXT[state], after


def report(codes: str | None) -> tuple[int, int, int, int, int, str]:
    """blank, duplicate, truncated, illegal, cost and audit of one conversation's letters."""
    codes = codes or ""
    known = [meaning(chr(c)) for c in range(65, 81)]
    counts = [sum(codes.count(chr(65 + c)) for c, (_, f) in enumerate(known) if f == fault) for fault in range(4)]
    roles = codes.translate({65 + c: i for c, (i, _) in enumerate(known)})
    illegal = max(len(roles) - 1, 0) - sum(pair in ("su", "ua", "au") for pair in map("".join, zip(roles, roles[1:])))
    cost, audit = edits(codes)
    return counts[2], counts[3], counts[1], illegal, cost, audit


def repair_plan(rows: DataFrame) -> DataFrame:
    """conv_id, blank, duplicate, truncated, illegal, cost, audit of every conversation that has rows."""
    use_python(rows.sparkSession)

    def run(batches):
        for batch in batches:
            found = [report(c) for c in batch.column("letters").to_pylist()]
            columns = [pa.array([f[i] for f in found], pa.string() if i == 5 else pa.int64()) for i in range(6)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *columns], ["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    numbers = "blank", "duplicate", "truncated", "illegal", "cost"
    schema = T.StructType([rows.schema["conv_id"], *(T.StructField(c, T.LongType()) for c in numbers), T.StructField("audit", T.StringType())])
    return landed(letters(rows).mapInArrow(run, schema), "repair_plan")


def repaired_rows(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """conv_id, place, edit, role, text of every row after repair, a conversation's rows together and in order."""
    conv = rows.schema["conv_id"].dataType
    texts = rows.select("conv_id", F.lit(1).alias("kind"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    texts = texts.withColumn("h", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    plans = plan.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"),
                        F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(None).cast("binary").alias("h"))
    sorted_rows = plans.unionByName(texts).repartition("conv_id").sortWithinPartitions(
        F.asc_nulls_first("conv_id"), "kind", F.asc_nulls_first("turn"), "role", "h").select("conv_id", "kind", "role", "text")
    schema = T.StructType([T.StructField("conv_id", conv), T.StructField("place", T.LongType())])
    for name in ("edit", "role", "text"):
        schema = schema.add(name, T.StringType())
    return sorted_rows.mapInArrow(_apply, schema)


def _apply(batches) -> Iterator[pa.RecordBatch]:
    """Follow each conversation's edits while its rows go by."""
    conv, audit, at, place, state = None, "", 0, 0, START
    kind_of_batch = None

    def put(out, edit, role, text):
        nonlocal place, state
        out.append((conv, place, edit, role, text))
        place, state = place + 1, KEPT.get((state, role[:1]), state)

    def added(out, until_end):
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            put(out, "I", "assistant" if state == USER else "user", "")
            at += 1
        assert not until_end or at == len(audit)

    def batch_of(out):
        columns = [pa.array([o[0] for o in out], kind_of_batch), pa.array([o[1] for o in out], pa.int64())]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array([o[i] for o in out], pa.string()) for i in (2, 3, 4))], ["conv_id", "place", "edit", "role", "text"])

    for batch in batches:
        kind_of_batch, out = batch.column("conv_id").type, []
        for own, kind, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if kind == 0:
                added(out, True)
                conv, audit, at, place, state = own, text, 0, 0, START
                continue
            added(out, False)
            edit, at = audit[at], at + 1
            if edit == "K":
                put(out, edit, role, text)
            elif edit == "R":
                put(out, edit, "assistant" if state == USER else "user", text)
        if out:
            yield batch_of(out)
    last = []
    added(last, True)
    if last:
        yield batch_of(last)


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256, the hash of ``role:text`` of the rows of ``repaired_rows``, joined by newlines."""
    def run(batches):
        key, own, done, kind = None, None, [], None

        def batch_of(found):
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], kind), pa.array([f[1] for f in found])], ["conv_id", "repaired_sha256"])

        for batch in batches:
            kind = batch.column("conv_id").type
            for conv, place, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text"))):
                if place == 0:
                    if own:
                        done.append((key, own.hexdigest()))
                    key, own = conv, hashlib.sha256()
                else:
                    own.update(b"\n")
                own.update(f"{role}:{text}".encode())
            if len(done) >= 1000:
                yield batch_of(done)
                done = []
        if own:
            yield batch_of([*done, (key, own.hexdigest())])

    return repaired.mapInArrow(run, T.StructType([repaired.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())]))


def gaps(rows: DataFrame) -> DataFrame:
    """conv_id and gaps of every conversation of ``rows`` (conv_id, turn, left): turns missing between the first and the last one."""
    turn = F.when(F.col("left"), F.col("turn"))
    return rows.groupBy("conv_id").agg(F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn), F.lit(0)).alias("gaps"))


def repair_summary(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text, left; rows not left count for conv_id only)."""
    left = rows.filter(F.col("left"))
    plan = repair_plan(left)
    whole = gaps(rows)
    hashes = digests(repaired_rows(left, plan)).withColumnRenamed("conv_id", "_hashed")
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    planned = plan.withColumnRenamed("conv_id", "_planned")
    return (
        whole.join(planned, F.col("conv_id").eqNullSafe(F.col("_planned")), "left")
        .join(hashes, F.col("conv_id").eqNullSafe(F.col("_hashed")), "left")
        .select("conv_id", "gaps", *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
                F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")))
