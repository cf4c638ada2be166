"""URL verdicts from rules and from trust and distrust on the host graph.

Rules decide first: a rule fits its host and all subdomains if the path starts with the rule's path; the longest rule
wins. What no rule decides follows its host. A host with more allowed than blocked pages is a trusted seed, the other way
round a blocked one, as strong as the difference's share of its pages. Trust runs along host links from trusted seeds
(personalised PageRank), distrust against them from blocked seeds: whoever links to blocked hosts becomes suspect. Both
are scaled so that an unlinked seed scores its own strength; a host is blocked where distrust exceeds trust by
``threshold``, and allowed otherwise, so without evidence it is allowed.

Defined cases: a null url or one without ``://`` has empty host and path, fits no rule, takes no part in the graph and
is allowed; an empty path fits no rule, since rule paths start with ``/``; links within a host, null pages and hrefs
without a host are no edges; repeated rows count as pages of their own and get equal verdicts; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.plans.scratch import materialize

#: (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HREF = "(?i)href\\s*+=\\s*+[\"']?((?:[a-z][a-z0-9+.-]*+:)?//[^\\s\"'<>]++)"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """struct(rule, verdict) of the longest fitting rule, else null; of equally long ones the rule named first."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(pages: DataFrame) -> DataFrame:
    """(source, target, weight): links between different hosts, counted; summed per task before they move."""
    hrefs = pages.select(host_of(F.col("url")).alias("source"), F.explode_outer(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(HREF), 1)).alias("href"))
    whole = F.when(F.col("href").startswith("//"), F.concat(F.lit("http:"), F.col("href"))).otherwise(F.col("href"))
    edges = hrefs.select("source", host_of(whole).alias("target")).where("source <> '' and target <> '' and source <> target")
    return edges.groupBy("source", "target").agg(F.count("*").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, most: int = 200) -> DataFrame:
    """(kind, host, score): restarted walks from the seeds (kind, host, strength), trust forwards and distrust backwards.

    A step adds the mass that moved to the score and moves it on; the mass shrinks by ``damping`` a step, and the walk
    ends once less than ``tolerance`` of the seeds' mass is left to move. A step is a join on the source host and a sum
    per target, split or pre-aggregated where a host is hot. The graph is one row per pair of hosts.
    """
    ways = edges.select(F.lit("trust").alias("kind"), F.col("source").alias("host"), F.col("target").alias("to"), "weight").union(
        edges.select(F.lit("distrust").alias("kind"), F.col("target").alias("host"), F.col("source").alias("to"), "weight")
    )
    totals = ways.groupBy("kind", "host").agg(F.sum("weight").alias("total"))
    ways = materialize(ways.join(totals, ["kind", "host"]).select("kind", "host", "to", (F.col("weight") / F.col("total")).alias("share")), "host-ways")
    first = materialize(seeds.select("kind", "host", F.col("strength").alias("mass"), F.col("strength").alias("score")), "host-scores")
    if ways.isEmpty():
        return first.select("kind", "host", "score")
    start = first.agg(F.sum("mass")).first()[0] or 0.0
    score = first
    for _ in range(most):
        moved = score.where("mass > 0").join(ways, ["kind", "host"]).select("kind", F.col("to").alias("host"), (damping * F.col("mass") * F.col("share")).alias("mass"), F.lit(0.0).alias("score"))
        both = moved.union(score.select("kind", "host", F.lit(0.0), "score")).groupBy("kind", "host").agg(F.sum("mass").alias("mass"), F.sum("score").alias("score"))
        score = materialize(both.select("kind", "host", "mass", (F.col("score") + F.col("mass")).alias("score")), "host-scores")
        if (score.agg(F.sum("mass")).first()[0] or 0.0) <= tolerance * start * (1 - damping):
            break
    return score.select("kind", "host", "score")


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict of every row."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = materialize(rows.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules)), "url-rows")
    sign = F.when(F.col("fit.verdict") == "allow", 1).when(F.col("fit.verdict") == "block", -1).otherwise(0)
    per_host = rows.where("host <> ''").groupBy("host").agg((F.sum(sign) / F.count("*")).alias("balance"))
    seeds = per_host.where("balance <> 0").select(
        F.when(F.col("balance") > 0, "trust").otherwise("distrust").alias("kind"), "host", F.abs("balance").alias("strength")
    )
    seeds = materialize(seeds, "host-seeds")
    score = propagate(materialize(host_edges(pages), "host-edges"), seeds)
    signed = F.when(F.col("kind") == "distrust", F.col("score")).otherwise(-F.col("score"))
    blocked = score.groupBy("host").agg(F.sum(signed).alias("excess")).where(F.col("excess") > threshold).select(F.col("host").alias("_host"))
    judged = rows.join(blocked, F.col("host") == F.col("_host"), "left")
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("_host").isNotNull(), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"))
