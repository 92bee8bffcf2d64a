"""URL verdicts: listed rules first, then a tree of path templates with smoothed purity.

Each path is a walk down a tree of its host. Level by level, a segment keeps its own branch only if it
recurs and its labelled pages differ from those of its parent (two-proportion z test); the others
merge into the wildcard branch. Runs of digits are wildcards from the start.
The leaves are templates; one whose smoothed share of bad pages is too high is rejected.

Null urls and urls without ``://`` have empty host and path. Only counts per (host, template, segment)
are shuffled for the tree, combined before the shuffle, so a host with a third of all pages is no single task.
"""


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotorwatch.llm.common import landed

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WILDCARD = "*"
# Levels of the tree (deeper segments share the last level), pages a branch of its own needs, labelled pages the
# test needs, its z, pseudo-pages of the prior, share of bad pages from which a template goes.
LEVELS, LEAST_PAGES, LEAST_LABELS, Z, PRIOR_PAGES, REJECT_FROM = 6, 10, 8, 1.96, 8.0, 0.5


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty if the url is null or has no ``://``."""
    parts = lambda k: F.coalesce(F.regexp_extract(url, "^(?s).*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(parts(1), CAPITALS, CAPITALS.lower()), parts(2)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, else null. A rule is ``host/path``; it fits subdomains too."""
    found = None
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + start)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found


def segments(path: Column) -> Column:
    """Path segments, with every run of digits as a wildcard; other varying parts are rare branches, which merge below."""
    plain = F.regexp_replace(path, "[0-9]+", WILDCARD)
    parts = F.array_remove(F.split(plain, "/"), "")
    deep = F.when(F.size(parts) > LEVELS, F.concat(F.slice(parts, 1, LEVELS - 1), F.array(F.array_join(F.slice(parts, LEVELS, 1 << 30), "/"))))
    return F.coalesce(deep, parts)


def templates(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, host, path, bad: 1, 0 or null) with the template of each page."""
    rows = landed(pages.select("*", segments(F.col("path")).alias("_parts"), F.lit("").alias("template")), "url-tree")
    depth = rows.agg(F.max(F.size("_parts"))).first()[0] or 0
    tally = [F.count("*").alias("n"), F.count("bad").alias("l"), F.coalesce(F.sum("bad"), F.lit(0)).alias("b")]
    for level in range(depth):
        # the segment by its own name, so that joins stay apart; null where the path has ended
        rows = rows.withColumn("_part", F.get("_parts", F.lit(level)))
        branches = rows.groupBy("host", "template", "_part").agg(*tally)
        parents = branches.groupBy("host", "template").agg(F.sum("l").alias("pl"), F.sum("b").alias("pb"))
        rate, own = F.col("pb") / F.col("pl"), F.col("b") / F.col("l")
        error = F.sqrt(rate * (1 - rate) * (1 / F.col("l") + 1 / F.col("pl")))
        kept = (
            branches.filter(F.col("_part").isNotNull() & (F.col("n") >= LEAST_PAGES) & (F.col("l") >= LEAST_LABELS))
            .join(parents, ["host", "template"])
            .filter(F.abs(own - rate) > Z * error)
            .select("host", "template", "_part", F.lit(True).alias("_own"))
        )
        named = F.when(F.col("_own"), F.col("_part")).otherwise(F.lit(WILDCARD))
        rows = landed(
            rows.join(kept, ["host", "template", "_part"], "left")
            .withColumn("template", F.when(F.col("_part").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), named)))
            .drop("_own", "_part"),
            "url-tree",
        )
    return rows.drop("_parts")


def judge_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """``pages`` (page_id, url), ``labels`` (page_id, bad 1 or 0, one row per page).

    Gives page_id, host, path, rule, verdict, template, purity (smoothed share of good labels).
    """
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).join(labels.select("page_id", "bad"), "page_id", "left")
    placed = templates(rows)
    totals = placed.agg(F.count("bad").alias("l"), F.coalesce(F.sum("bad"), F.lit(0)).alias("b")).first()
    prior = (totals["b"] + 1) / (totals["l"] + 4)  # without labels: no reason to reject
    share = (F.coalesce(F.sum("bad"), F.lit(0)) + PRIOR_PAGES * prior) / (F.count("bad") + PRIOR_PAGES)
    judged = placed.groupBy("host", "template").agg(share.alias("bad_share"))
    found = rule_for(F.col("host"), F.col("path"), rules) if rules else F.lit(None).cast("struct<rule:string,verdict:string>")
    return placed.join(judged, ["host", "template"]).withColumn("_rule", found).select(
        "page_id", "host", "path", F.col("_rule")["rule"].alias("rule"),
        F.coalesce(F.col("_rule")["verdict"], F.when(F.col("bad_share") >= REJECT_FROM, "block").otherwise("allow")).alias("verdict"),
        "template", (1 - F.col("bad_share")).alias("purity"),
    )
