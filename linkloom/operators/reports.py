"""Reports of stages, one row each, and questions about stored tables that end at the first answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.terms import term_key
from linkloom.operators.percentiles import quantiles

#: Fixable shares of links below and above which the audit is a feature, or the product.
FEATURE, PRODUCT = 0.10, 0.30


def work_selection(pages: DataFrame) -> DataFrame:
    """``pages`` with state: placeholder, non_2xx, up_to_date (a vector of the text as it is now) or target, what is left to embed.

    ``pages`` has placeholder, status, body_hash, embedded_hash and vector.
    """
    current = F.col("embedded_hash").isNotNull() & (F.col("embedded_hash") == F.col("body_hash")) & F.col("vector").isNotNull()
    outside = F.col("status").isNull() | (F.col("status") < 200) | (F.col("status") > 299)
    state = F.when(F.coalesce("placeholder", F.lit(False)), "placeholder").when(outside, "non_2xx").when(F.coalesce(current, F.lit(False)), "up_to_date").otherwise("target")
    return pages.withColumn("state", state)


def state_counts(selected: DataFrame) -> DataFrame:
    """One row: pages of each state."""
    return selected.agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("placeholder", "non_2xx", "up_to_date", "target")])


def candidate_report(pages: DataFrame, targets: DataFrame, candidates: DataFrame, facts: DataFrame, pillar_pairs: DataFrame, per_target: int) -> DataFrame:
    """One row about a retrieval: pool, targets, pairs by channel, how full targets are, and the share of near pages that link already.

    ``facts`` are :func:`retrieval.target_facts`; targets without any candidate count as empty.
    """
    counts = targets.select(F.col("page").alias("target")).join(candidates.groupBy("target").agg(F.count("*").alias("n")), "target", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    own = counts.agg(
        F.count("*").alias("targets"), F.coalesce(F.sum("n"), F.lit(0)).alias("nearest"), F.count_if(F.col("n") >= per_target).alias("full_targets"),
        F.count_if((F.col("n") > 0) & (F.col("n") < per_target)).alias("short_targets"), F.count_if(F.col("n") == 0).alias("empty_targets"),
        F.min("n").alias("min_per_target"), F.expr("percentile(n, 0.5)").alias("median_per_target"), F.max("n").alias("max_per_target"),
    )
    linked = facts.agg(F.coalesce(F.sum("linked"), F.lit(0)).alias("linked_pairs"), F.coalesce(F.sum("linked_nearer"), F.lit(0)).alias("linked_nearer"))
    extra, pool = pillar_pairs.agg(F.count("*").alias("pillar_pairs")), pages.agg(F.count("*").alias("source_pages"))
    row = own.crossJoin(linked).crossJoin(extra).crossJoin(pool)  # one row each
    near = F.col("nearest") + F.col("linked_nearer")
    return row.withColumn("candidates", F.col("nearest") + F.col("pillar_pairs")).withColumn("drop_rate", F.when(near > 0, F.col("linked_nearer") / near)).drop("nearest")


def unique_share(resolved: DataFrame) -> DataFrame:
    """One row: keywords, and the share of distinct (key, language) that one page alone resolved; null without any."""
    per = resolved.groupBy(term_key(F.col("keyword")).alias("k"), "language").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("keywords"), F.avg((F.col("n") == 1).cast("double")).alias("share"))


def fixable_band(rate: Column) -> Column:
    """feature, both or product, by the share of links that can be fixed."""
    return F.when(rate < FEATURE, "feature").when(rate > PRODUCT, "product").when(rate.isNotNull(), "both")


def any_row(rows: DataFrame, condition: Column | None = None) -> bool:
    """Whether there is a row, or one for which ``condition`` holds: a limit that ends the scan at the first."""
    return not (rows if condition is None else rows.where(condition)).limit(1).isEmpty()


def linking_sources(pages: DataFrame, links: DataFrame) -> DataFrame:
    """page: pages with at least one link."""
    return pages.select("page").join(links.select(F.col("source").alias("page")), "page", "left_semi")


def sentence_key(text: Column) -> Column:
    """SHA-256 of a sentence with its blanks made one."""
    return F.sha2(F.trim(F.regexp_replace(text, "\\s+", " ")), 256)


def vectors_by_sentence(links: DataFrame) -> DataFrame:
    """key, vector: one vector of every sentence (around, vector) that has any, whichever link it came from; equal sentences have equal vectors."""
    known = links.where("around is not null and vector is not null")
    return known.groupBy(sentence_key(F.col("around")).alias("key")).agg(F.min_by("vector", F.xxhash64("vector")).alias("vector"))


def score_summary(scored: DataFrame) -> DataFrame:
    """One row: pairs, pairs of each tier, and the 10th, 50th and 90th percentile of the score, null without pairs."""
    middle = quantiles(scored, "score", (0.1, 0.5, 0.9)).select(*[F.col(f"q{i}").alias(n) for i, n in enumerate(("score_p10", "score_p50", "score_p90"))])
    counts = scored.agg(F.count("*").alias("pairs"), *[F.count_if(F.col("tier") == t).alias(f"tier_{t}") for t in (1, 2, 3)])
    return counts.join(middle, F.lit(True), "left")  # one row at most on the right


def leaders(scored: DataFrame) -> DataFrame:
    """feature, pairs: how often a feature gives the greatest part of a score."""
    return scored.where("top1_feature is not null").groupBy(F.col("top1_feature").alias("feature")).agg(F.count("*").alias("pairs"))


def missing_shares(rows: DataFrame, columns: list[str]) -> DataFrame:
    """feature, share: rows in which a column is null or NaN; one pass over all columns, nothing without rows."""
    lost = [F.avg((F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("double")).alias(c) for c in columns]
    listed = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("share")) for c in columns])
    return rows.agg(*lost).select(F.explode(listed).alias("x")).select("x.*").where("share is not null")


def is_home(key: Column, prefixes: list[str]) -> Column:
    """Whether a url key is a bare host or the home of a language: host/en for the prefix /en/. Keys with a query are none."""
    homes = ["/".join(s.lower() for s in p.split("/") if s) for p in prefixes]
    bare = F.instr(key, "/") == 0
    path = F.regexp_extract(key, "^[^/]*/(.*)$", 1)
    return (F.instr(key, "?") == 0) & (bare | (path.isin(homes) if homes else F.lit(False)))
