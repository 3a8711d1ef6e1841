"""Operator 5: URL filters by link-graph propagation, in DataFrame functions alone.

Rules give verdicts to hosts and paths. Where no rule fits, the verdict is its host's: trust flows from hosts with
allowed pages along links (personalised PageRank), distrust from hosts with blocked pages against them, and a host is
blocked if its distrust exceeds its trust by a factor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import cut, drop

#: Rules as (host and path, verdict).
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
DAMPING, ITERATIONS, FACTOR = 0.85, 12, 2.0
#: Rounds between tables that end the lineage.
CUT_EACH = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""


def host_of(url: Column) -> Column:
    """After the first :// up to /, ? or #, with A-Z lower-cased; empty if there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _ruled(pages: DataFrame, rules: tuple) -> DataFrame:
    """With rule and verdict of the longest rule that fits (ties: the first in order of text), else nulls. The rules are literals of the plan."""
    fits = lambda h, p: ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
    rule, verdict = None, None
    for text, what in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        h, _, p = text.partition("/")
        ok = fits(h, "/" + p)
        rule = F.when(ok, F.lit(text)) if rule is None else rule.when(ok, F.lit(text))
        verdict = F.when(ok, F.lit(what)) if verdict is None else verdict.when(ok, F.lit(what))
    none = F.lit(None).cast("string")
    return pages.select("*", (none if rule is None else rule).alias("rule"), (none if verdict is None else verdict).alias("by_rule"))


def _propagate(edges: DataFrame, seeds: DataFrame, damping: float, iterations: int) -> DataFrame:
    """host, score: personalised PageRank from seeds (host, seed: sums to 1) over edges (a, b, w); what reaches a host without edges ends there."""
    out = edges.groupBy("a").agg(F.sum("w").alias("all"))
    steps = cut(edges.join(out, "a").select("a", "b", (F.col("w") / F.col("all")).alias("share")), "steps")
    base = seeds.select("host", (F.col("seed") * (1 - damping)).alias("score"))
    now, old = base, []
    for k in range(iterations):
        moved = steps.join(now, steps.a == now.host).select(F.col("b").alias("host"), (F.col("score") * F.col("share") * damping).alias("score"))
        now = moved.unionByName(base).groupBy("host").agg(F.sum("score").alias("score"))
        if k % CUT_EACH == CUT_EACH - 1:
            now = cut(now, "ranks")
            drop(*old)
            old = [now]
    return now


def judge(pages: DataFrame, rules: tuple = RULES, damping: float = DAMPING, iterations: int = ITERATIONS, factor: float = FACTOR) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every row of pages (page_id, url, html).

    A null url, or one without ://, has an empty host and path and no rule. Links are absolute ones in href and src of
    the html; a null html has none; links within a host don't count. Hosts that neither trust nor distrust reaches are
    allowed. Repeated rows are kept and count again; extra columns are ignored.
    """
    rows = _ruled(pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html"), rules)
    seen = cut(rows.groupBy("host").agg(F.count_if(F.col("by_rule") == "allow").alias("good"), F.count_if(F.col("by_rule") == "block").alias("bad")).where("host <> ''"), "hosts")
    links = rows.where("host <> ''").select(F.col("host").alias("a"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("b"))
    edges = cut(links.select("a", F.translate("b", UPPER, LOWER).alias("b")).where("a <> b").groupBy("a", "b").agg(F.count("*").cast("double").alias("w")), "links")
    total = seen.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    seed = lambda c: seen.where(F.col(c) > 0).select("host", (F.col(c) / F.lit(float(max(total[c] or 0, 1)))).alias("seed"))
    if edges.isEmpty():
        trust, distrust = (seed(c).withColumnRenamed("seed", "score") for c in ("good", "bad"))
    else:
        trust = _propagate(edges, seed("good"), damping, iterations)
        distrust = _propagate(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"), seed("bad"), damping, iterations)
    both = trust.select("host", F.col("score").alias("trust"), F.lit(0.0).alias("distrust")).unionByName(distrust.select("host", F.lit(0.0).alias("trust"), F.col("score").alias("distrust")))
    hosts = cut(both.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")), "judged")
    of_host = F.when(F.col("distrust") > factor * F.col("trust"), "block").otherwise("allow")
    return rows.drop("html").join(hosts, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("by_rule", of_host).alias("verdict"), "trust", "distrust")
