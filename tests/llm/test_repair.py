"""Conversation repair against every sequence of edits, and the tables against a plain computation."""

import hashlib
import random
import re
import zlib
from math import isqrt

from hypothesis import given, settings
from hypothesis import strategies as st

from rotorwatch.llm import conversation_repair as repair

LETTERS = "".join(chr(c) for c in range(65, 81))
WHITE = " \t\n\v\f\r"


def every_sequence(codes, most):
    """The least (cost, audit) of all sequences of edits that cost at most ``most``, and its role initials."""
    found = []

    def go(i, cost, audit, roles):
        if cost > most:
            return
        if i == len(codes) and re.fullmatch("(s?(ua)+)?", roles):
            found.append((cost, audit, roles))
        for role in "ua":
            go(i, cost + 5, audit + "I", roles + role)
        if i < len(codes):
            initial, fault = repair.meaning(codes[i])
            go(i + 1, cost + 2, audit + "D", roles)
            if fault < 2:
                extra = 5 * (fault == 1)
                go(i + 1, cost + extra, audit + "K", roles + initial)
                for role in "ua":
                    go(i + 1, cost + 1 + extra, audit + "R", roles + role)

    go(0, 0, "", "")
    return min(found)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=LETTERS + "AEIMEIMEIM", max_size=6))
def test_edits_are_the_least_of_all(codes):
    cost, audit = repair.edits(codes)
    assert (cost, audit) == every_sequence(codes, cost)[:2]


def whole_table(codes):
    """The dynamic program with all costs kept and whole strings compared."""
    best = [(0, ""), (10, "II"), (5, "I"), (0, "")]
    for code in reversed(codes):
        initial, fault = repair.meaning(code)
        options = [[(c + 2, "D" + a)] for c, a in best]
        if fault < 2:
            for q, n in repair.NEXT.items():
                options[q].append((best[n][0] + 1 + 5 * fault, "R" + best[n][1]))
            for (q, i), n in repair.KEPT.items():
                if i == initial:
                    options[q].append((best[n][0] + 5 * fault, "K" + best[n][1]))
        here = [min(o) for o in options]
        for _ in range(4):
            here = [min(here[q], (here[repair.NEXT[q]][0] + 5, "I" + here[repair.NEXT[q]][1])) for q in range(4)]
        best = here
    return best[0]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 300))
def test_checkpoints_equal_whole_table(seed, n):
    codes = "".join(random.Random(seed).choices(LETTERS, k=n))
    assert repair.edits(codes) == whole_table(codes)


def test_few_costs_are_kept(monkeypatch):
    """The walk holds about the square root of the rows, twice."""
    live, most, plain = [0], [0], repair.before

    class Counted(list):
        def __init__(self, costs):
            super().__init__(costs)
            live[0] += 1
            most[0] = max(most[0], live[0])

        def __del__(self):
            live[0] -= 1

    monkeypatch.setattr(repair, "before", lambda code, after: Counted(plain(code, after)))
    repair.edits("IM" * 5000)
    assert most[0] <= 2 * (isqrt(10000) + 4)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain_summary(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = [r[1:] for r in damage(r for r in rows if r[0] == conv)]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        turns = [t for t, _, _ in own if t is not None]
        codes, seen = "", set()
        for _, role, text in own:
            solid = text.strip(WHITE)
            fault = 2 if not solid else 3 if (role, text) in seen else int(solid[-1] not in ".!?")
            seen.add((role, text))
            codes += chr(65 + 4 * max(" sua".find(role[:1]), 0) + fault)
        roles = [r[:1] if r[:1] in ("s", "u", "a") else " " for _, r, _ in own]
        cost, audit = whole_table(codes)
        kept, at, state = [], 0, ""
        for edit in audit:
            need = "assistant" if state == "u" else "user"
            role, text = own[at][1:] if edit != "I" else ("", "")
            at += edit != "I"
            if edit != "D":
                kept.append((role, text) if edit == "K" else (need, text))
                state = kept[-1][0][:1]
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in kept))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        faults = [sum((ord(c) - 65) % 4 == f for c in codes) for f in (2, 3, 1)]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
        out[conv] = (conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *faults, illegal, cost, audit, digest)
    return out


def test_summary_equals_plain(spark):
    rng = random.Random(5)
    texts = ["Yes.", "No!", "why", "", " \n\t", None, "a b c? ", "Done. \n", "é."]
    rows = [(rng.choice([None, *range(30)]), rng.choice([None, *range(12)]), rng.choice(["user", "assistant", "system", "tool", "User", "", None]), rng.choice(texts))
            for _ in range(500)]
    rows += [(100, t, "user" if t % 2 else "assistant", "Same." if t % 3 else f"Word {t}.") for t in range(300)] + [(200, 3, "user", "Hi.")] * 9
    rows += [(300, 1, "system", "x" * 50_000), (300, 2, "user", "word " * 20_000 + ".")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r.conv_id: tuple(r) for r in repair.repair_summary(repair.damaged(frame)).collect()}
    assert got == plain_summary(rows)
    named = frame.selectExpr("*", "'x' AS h", "1 AS n", "2 AS kind", "'y' AS audit", "3 AS place")
    assert repair.repair_summary(repair.damaged(named)).count() == len(got)


def test_long_conversation_is_sorted_by_many_tasks(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", f"Word {t}.") for t in range(4000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        lettered = repair.letters(frame)
        assert lettered.collect()[0].letters == "MI" * 2000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_all_rows_dropped_and_empty_table(spark):
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    frame = spark.createDataFrame([(lost, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    nothing = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in repair.repair_summary(repair.damaged(frame)).collect()] == [(lost, 0, 0, 0, 0, 0, 0, "", nothing)]
    assert repair.repair_summary(repair.damaged(frame.limit(0))).isEmpty()


def test_repaired_rows(spark):
    frame = spark.createDataFrame([(1, 1, "user", "Hi."), (1, 2, "user", "Hello."), (1, 3, "assistant", "Yes.")], "conv_id long, turn long, role string, text string")
    plan = repair.repair_plan(frame)
    assert [(r.cost, r.audit) for r in plan.collect()] == [(2, "DKK")]
    got = [tuple(r) for r in repair.repaired_rows(frame, plan).collect()]
    assert got == [(1, 0, "K", "user", "Hello."), (1, 1, "K", "assistant", "Yes.")]
