"""Document quality by weak supervision.

Rules vote good or bad on a document, or abstain. Expectation-maximisation over the counts of vote
patterns estimates how often each rule gives each vote on good and on bad documents; the posterior
probability that a document is good then decides, in place of "all rules must pass".

The text is read once; votes and base figures go to a narrow written table. Only pattern counts
(3 to the number of rules at most) reach the driver. Null text counts as empty; an empty table gives an empty result.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotorwatch.llm.common import landed, words

# (rule, bad from, good up to) on a ratio; between the two, and where the ratio is undefined, the rule abstains.
HIGH_IS_BAD = (
    ("symbols", 0.10, 0.01),
    ("symbol_share", 0.05, 0.005),
    ("dup_lines", 0.50, 0.10),
    ("repeats", 0.30, 0.10),
    ("capitals", 0.40, 0.20),
    ("shouts", 0.25, 0.02),
    ("digits", 0.15, 0.03),
)
# (rule, bad below, good from, good up to, bad above)
BANDS = (("length", 50, 100, 1e18, 1e19), ("word_length", 2.5, 3.5, 9.0, 12.0), ("letters", 0.88, 0.92, 1.0, 1.1))
RULES = tuple(r[0] for r in HIGH_IS_BAD + BANDS)
# Rates of the votes (good, bad, abstain) expected before any data, on good and on bad documents: junk mostly shows
# in one or two rules. They count as PRIOR_WEIGHT times the rows of data, so all sizes behave alike.
EXPECTED = {1: {1: 0.895, 0: 0.005, None: 0.10}, 0: {1: 0.70, 0: 0.20, None: 0.10}}
STEPS, PRIOR_GOOD, PRIOR_WEIGHT = 60, 0.8, 1.0
KEEP_FROM = 0.5


def base_figures(docs: DataFrame) -> DataFrame:
    """doc_id with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and counts for the rules.

    n_repeat_words: words inside 3-word windows that occur twice or more. Windows are compared by 64-bit hash.
    """
    text = F.coalesce("text", F.lit(""))
    without = lambda chars: (F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]", ""))).cast("long")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    plain = docs.select("doc_id", text.alias("text")).select(
        "doc_id", words(F.col("text")).alias("w"), lines.alias("lines"),
        without("#*$%&|<>").alias("n_symbols"), without("\\p{Lu}").alias("n_capitals"),
        without("!").alias("n_shouts"), without("0-9").alias("n_digits"), without("\\p{L}").alias("n_letters"),
    )
    w = F.col("w")
    windows = F.transform(
        F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))
    )
    hashed = plain.withColumn("h", windows)
    h, s, at = F.col("h"), F.col("s"), F.col("at")
    twice = F.size(F.array_distinct(h)) < F.size(h)
    ordered = hashed.withColumn("s", F.when(twice, F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    beside = F.filter(s, lambda e, i: (e["x"] == F.get(s, i - 1)["x"]) | (e["x"] == F.get(s, i + 1)["x"]))
    placed = ordered.withColumn("at", F.sort_array(F.transform(beside, lambda e: e["i"])))
    covered = F.aggregate(
        at, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, i: F.struct((a["n"] + i + 3 - F.greatest(i, a["end"])).alias("n"), (i + 3).alias("end")), lambda a: a["n"],
    )
    return placed.select(
        "doc_id", F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"), "n_capitals", "n_shouts", "n_digits", "n_letters",
    )


def votes() -> list[Column]:
    """One column per rule: 1 good, 0 bad, null abstains."""
    ratio = lambda a, b: F.col(a) / F.when(F.col(b) > 0, F.col(b))
    values = {
        "symbols": ratio("n_symbols", "n_words"), "dup_lines": ratio("n_dup_lines", "n_lines"),
        "symbol_share": ratio("n_symbols", "word_chars"), "letters": ratio("n_letters", "word_chars"),
        "repeats": ratio("n_repeat_words", "n_words"), "capitals": ratio("n_capitals", "word_chars"),
        "shouts": ratio("n_shouts", "n_words"), "digits": ratio("n_digits", "word_chars"),
        "length": F.col("n_words"), "word_length": ratio("word_chars", "n_words"),
    }
    high = [F.when(values[r] >= bad, 0).when(values[r] <= good, 1).alias(f"v_{r}") for r, bad, good in HIGH_IS_BAD]
    bands = [
        F.when((values[r] < low) | (values[r] > top), 0).when(values[r].between(good, good_to), 1).alias(f"v_{r}")
        for r, low, good, good_to, top in BANDS
    ]
    return high + bands


def fit(patterns: list[tuple[tuple, int]]) -> tuple[float, list[dict]]:
    """(log odds of good, per rule the log odds that each vote adds), from (votes, count) of every pattern.

    Every vote, abstaining included, is an outcome with its own rate in either class.
    """
    rules, total, good = range(len(RULES)), sum(n for _, n in patterns), PRIOR_GOOD
    rates = {side: [EXPECTED[side]] * len(RULES) for side in (1, 0)}

    def odds(vote):
        return math.log(good / (1 - good)) + sum(math.log(rates[1][r][vote[r]] / rates[0][r][vote[r]]) for r in rules)

    for _ in range(STEPS if total else 0):
        weight = PRIOR_WEIGHT * total
        tally = {side: [{v: weight * p for v, p in EXPECTED[side].items()} for _ in rules] for side in (1, 0)}
        good_rows = weight * PRIOR_GOOD
        for vote, n in patterns:
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds(vote)))))
            good_rows += n * p
            for r in rules:
                tally[1][r][vote[r]] += n * p
                tally[0][r][vote[r]] += n * (1 - p)
        good = good_rows / (total + weight)
        rates = {side: [{v: c / sum(t.values()) for v, c in t.items()} for t in tally[side]] for side in (1, 0)}
    return math.log(good / (1 - good)), [{v: math.log(rates[1][r][v] / rates[0][r][v]) for v in (1, 0, None)} for r in rules]


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, base figures, base_failed, good_probability and kept of every document (columns doc_id and text are read)."""
    figures = landed(base_figures(docs).select("*", *votes()), "quality")
    names = [f"v_{r}" for r in RULES]
    patterns = [(tuple(r[n] for n in names), r["count"]) for r in figures.groupBy(*names).count().collect()]
    start, weights = fit(sorted(patterns, key=repr))
    odds = F.lit(start)
    for name, weight in zip(names, weights):
        odds += F.when(F.col(name) == 1, weight[1]).when(F.col(name) == 0, weight[0]).otherwise(weight[None])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    posterior = 1 / (1 + F.exp(-odds))
    return figures.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (posterior >= KEEP_FROM)).alias("kept"), posterior.alias("good_probability"),
    )
