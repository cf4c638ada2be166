"""The audit of existing links: cut-offs from the tenant's own links, flags and findings per link, verdicts.

An edge has source, position, target, anchor_key (null: the anchor is no text), generic, exact_match, keyword_jaccard,
keyword_cosine, is_follow, context_relevance, anchor_target_fit, source_percentile, target_percentile, source_words,
target_placeholder, target_status, target_indexable, target_hub and target_canonical (null: it is no copy). All rules are
column expressions over the edge, its source's counts and one row of cut-offs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.url import is_pagination, is_sitemap
from linkloom.operators.percentiles import quantiles
from linkloom.plans.scratch import materialize

#: Fixed values of the rules.
JACCARD_SHARE, COSINE_SHARE = 0.7, 0.3
ALIGNMENT, FIT, CONTEXT, GENERIC_CAP = 0.35, 0.35, 0.30, 20.0
BLOCK_LEAST, BLOCK_SHARE = 5, 0.5
FENCE, LEAST_SPREAD = 3.0, 1.0
TECHNICAL = ("BROKEN", "REDIRECTED", "NOINDEX_TARGET", "NOFOLLOW")
REANCHOR = ("GENERIC", "MISALIGNED", "OVER_OPTIMISED")


def scope(edges: DataFrame, source_url: str = "source_url", target_url: str = "target_url") -> tuple[DataFrame, DataFrame]:
    """The edges to audit; and (kind, links) of what is left out: links that touch sitemaps, then those that touch paginated pages."""
    either = lambda test: test(F.col(source_url)) | test(F.col(target_url))
    marked = edges.withColumn("_kind", F.when(either(is_sitemap), "sitemap").when(either(is_pagination), "paginated"))
    return marked.where("_kind is null").drop("_kind"), marked.where("_kind is not null").groupBy(F.col("_kind").alias("kind")).agg(F.count("*").alias("links"))


def alignment(jaccard: Column, cosine: Column) -> Column:
    """The Jaccard of the stems, blended with the cosine where there is one."""
    return F.when(cosine.isNull(), jaccard).otherwise(F.least(F.lit(1.0), JACCARD_SHARE * jaccard + COSINE_SHARE * cosine))


def quality(aligned: Column, fit: Column, context: Column, generic: Column) -> Column:
    """0 to 100 over the parts that are there; a generic anchor is capped."""
    parts = ((ALIGNMENT, aligned), (FIT, fit), (CONTEXT, context))
    top = sum((w * F.coalesce(x, F.lit(0.0)) for w, x in parts), F.lit(0.0))
    low = sum((F.when(x.isNotNull(), w).otherwise(0.0) for w, x in parts), F.lit(0.0))
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * top / low))
    return F.when(low > 0, F.when(generic, F.least(score, F.lit(GENERIC_CAP))).otherwise(score))


def equity(source: Column, rank: Column, links: Column, target: Column) -> Column:
    """The source's percentile, by how early the link stands (rank from 0) and by the target's need; null without both percentiles."""
    return source * (1 - rank / links) * (1 - target)


def sources(edges: DataFrame) -> DataFrame:
    """source, outbound, density (links per 100 words; null without words) per linking page."""
    per = edges.groupBy("source").agg(F.count("*").alias("outbound"), F.max("source_words").alias("words"))
    return per.select("source", "outbound", F.when(F.col("words") > 0, 100 * F.col("outbound") / F.col("words")).alias("density"))


def cutoffs(per_source: DataFrame, equities: DataFrame, context_split: float | None, fit_split: float | None) -> DataFrame:
    """One row: saturation, outbound_fence, density_fence, equity_top, context_split, fit_split; null where nothing gives one.

    A fence lies three interquartile ranges above the upper quartile, a range of less than one counting as one.
    """
    fence = lambda q1, q3: q3 + FENCE * F.greatest(q3 - q1, F.lit(LEAST_SPREAD))
    out = quantiles(per_source, "outbound", (0.25, 0.75)).select(F.col("q1").alias("saturation"), fence(F.col("q0"), F.col("q1")).alias("outbound_fence"))
    thick = quantiles(per_source, "density", (0.25, 0.75)).select(fence(F.col("q0"), F.col("q1")).alias("density_fence"))
    top = quantiles(equities, "equity", (0.75,)).select(F.col("q0").alias("equity_top"))
    one = out.crossJoin(thick).crossJoin(top)  # each side is one row
    return one.select("*", F.lit(context_split).cast("double").alias("context_split"), F.lit(fit_split).cast("double").alias("fit_split"))


def blocks(edges: DataFrame) -> DataFrame:
    """(target, anchor_key, block): identical exact-match anchors, five or more and half or more of the target's descriptive ones."""
    told = edges.where(F.col("anchor_key").isNotNull() & ~F.col("generic"))
    per = told.groupBy("target", "anchor_key").agg(F.count("*").alias("all_"), F.count_if("exact_match").alias("block"))
    total = per.groupBy("target").agg(F.sum("all_").alias("descriptive"))
    wide = per.join(total, "target").where((F.col("block") >= BLOCK_LEAST) & (F.col("block") >= BLOCK_SHARE * F.col("descriptive")))
    return wide.select("target", "anchor_key", "block", "descriptive")


def assess(edges: DataFrame, context_split: float | None, fit_split: float | None) -> DataFrame:
    """Every edge with flags, reasons, alignment, fit, equity, quality, fix, fix_target, remove, weak_fit and reanchor.

    Edges to pages that were never crawled are unverified: no flags, one reason. Cut-offs count all edges in scope.
    """
    ranked = edges.withColumn("links", F.count("*").over(Window.partitionBy("source"))).withColumn("_rank", F.row_number().over(Window.partitionBy("source").orderBy("position")) - 1)
    crawled = ~F.col("target_placeholder")
    ranked = ranked.withColumn("equity", F.when(crawled, equity(F.col("source_percentile"), F.col("_rank"), F.col("links"), F.col("target_percentile"))))
    ranked = materialize(ranked.drop("_rank", "links"), "audit-edges")
    per_source = materialize(sources(ranked), "audit-sources")
    cuts = materialize(cutoffs(per_source, ranked, context_split, fit_split), "audit-cutoffs")
    cut = {c: cuts.select(c).scalar() for c in cuts.columns}
    listed = per_source.withColumn("listing", F.coalesce(F.col("density") > cut["density_fence"], F.lit(False))).drop("density")
    rows = ranked.join(listed, "source")
    found = blocks(rows.where(crawled & ~F.col("listing"))).select("target", "anchor_key", F.lit(True).alias("in_block"))
    rows = rows.join(found, ["target", "anchor_key"], "left")

    status = F.col("target_status")
    fit = F.when(~F.col("generic"), F.col("anchor_target_fit"))
    weak = F.coalesce(fit < cut["fit_split"], F.lit(False))
    misaligned = ~F.col("generic") & F.coalesce(F.col("keyword_jaccard") == 0, F.lit(False)) & (weak | fit.isNull() | cut["fit_split"].isNull())
    over = F.coalesce(F.col("in_block"), F.lit(False)) & ~F.col("listing")
    off_topic = weak & F.coalesce(F.col("context_relevance") < cut["context_split"], F.lit(False))
    no_index = F.coalesce(~F.col("target_indexable"), F.lit(False))
    closed = no_index | F.coalesce(~status.between(200, 299), F.lit(False))
    noise = F.coalesce(F.col("target_hub") == -1, F.lit(False))
    wasted = F.coalesce(F.col("equity") > cut["equity_top"], F.lit(False)) & (off_topic | closed | noise)
    broken, moved = F.coalesce(status >= 400, F.lit(False)), F.coalesce(status.between(300, 399), F.lit(False))
    copy = F.col("target_canonical").isNotNull()
    flag = {
        "BROKEN": broken, "REDIRECTED": moved, "NOINDEX_TARGET": ~broken & ~moved & no_index, "NOFOLLOW": ~F.col("is_follow"),
        "GENERIC": F.col("generic"), "MISALIGNED": misaligned, "OVER_OPTIMISED": over, "OFF_TOPIC": off_topic, "WASTED_EQUITY": wasted,
    }
    rows = rows.select("*", *[(crawled & v).alias(f"is_{k}") for k, v in flag.items()], fit.alias("fit"), weak.alias("weak"))
    any_of = lambda names: sum((F.col(f"is_{n}").cast("int") for n in names), F.lit(0)) > 0
    fix = crawled & (any_of(TECHNICAL) | copy)
    keeps = F.col("listing") & ~fix & any_of(("GENERIC", "MISALIGNED", "OFF_TOPIC", "WASTED_EQUITY"))
    goes = crawled & ~fix & ~F.col("listing") & F.col("is_OFF_TOPIC") & F.col("is_MISALIGNED") & (F.col("is_WASTED_EQUITY") | F.coalesce(F.col("outbound") > cut["saturation"], F.lit(False)))
    index_like = F.coalesce(F.col("outbound") > cut["outbound_fence"], F.lit(False))
    remove = goes & ~index_like
    names = {
        "BROKEN": "BROKEN_TARGET", "REDIRECTED": "REDIRECTED_TARGET", "NOINDEX_TARGET": "NOINDEX_TARGET", "NOFOLLOW": "NOFOLLOW", "_copy": "NON_CANONICAL_TARGET",
        "GENERIC": "GENERIC_ANCHOR", "MISALIGNED": "MISALIGNED_ANCHOR", "OVER_OPTIMISED": "OVER_OPTIMISED_ANCHOR", "OFF_TOPIC": "OFF_TOPIC", "WASTED_EQUITY": "WASTED_EQUITY",
    }
    told = [F.when((crawled & copy) if k == "_copy" else F.col(f"is_{k}"), name) for k, name in names.items()]
    told += [F.when(keeps, "LISTING_SOURCE"), F.when(goes & index_like, "INDEX_LIKE_SOURCE_KEPT"), F.when(remove, "REMOVE_OFF_TOPIC"), F.when(~crawled, "UNVERIFIED_TARGET")]
    aligned = F.when(crawled, alignment(F.col("keyword_jaccard"), F.col("keyword_cosine")))
    out = rows.select(
        "source", "position", "target", "anchor_key", "equity",
        F.array_compact(F.array(*[F.when(F.col(f"is_{k}"), k) for k in flag])).alias("flags"), F.array_compact(F.array(*told)).alias("reasons"),
        aligned.alias("alignment"), F.when(crawled, F.col("fit")).alias("fit"),
        F.when(crawled, quality(aligned, F.col("fit"), F.col("context_relevance"), F.col("generic"))).alias("quality"),
        fix.alias("fix"), F.when(crawled & (F.col("target_canonical") != F.col("source")), F.col("target_canonical")).alias("fix_target"),
        remove.alias("remove"), (crawled & F.col("weak")).alias("weak_fit"),
        (crawled & ~fix & ~remove & ~F.col("listing") & (any_of(REANCHOR) | F.col("weak"))).alias("reanchor"),
    )
    return out


def ladder_pairs(assessed: DataFrame) -> DataFrame:
    """(source, target) of the links that want a better anchor."""
    return assessed.where(F.col("reanchor") & (F.col("source") != F.col("target"))).select("source", "target").distinct()


def decide(assessed: DataFrame, proposals: DataFrame) -> DataFrame:
    """Every edge with verdict FIX, REMOVE or REANCHOR (or null) and the proposed phrase.

    ``proposals`` has source, target, place, phrase, phrase_key, keyword_jaccard, keyword_cosine and phrase_fit. The first one
    in order that is not the anchor itself wins: any for a generic or over-optimised anchor, else one that aligns better with
    the target's keywords or fits the target better.
    """
    defect = F.array_contains("flags", "GENERIC") | F.array_contains("flags", "OVER_OPTIMISED")
    flagged = defect | F.array_contains("flags", "MISALIGNED")
    wanted = assessed.where("reanchor and not fix and not remove").select("source", "position", "target", "anchor_key", "alignment", "fit", defect.alias("defect"))
    tried = wanted.join(proposals, ["source", "target"]).where(~F.col("phrase_key").eqNullSafe(F.col("anchor_key")))
    better = F.coalesce(alignment(F.col("keyword_jaccard"), F.col("keyword_cosine")) > F.col("alignment"), F.lit(False)) | F.coalesce(F.col("phrase_fit") > F.col("fit"), F.lit(False))
    first = tried.where(F.col("defect") | better).groupBy("source", "position").agg(F.min_by("phrase", "place").alias("proposed"))
    rows = assessed.join(first, ["source", "position"], "left")
    has = F.col("proposed").isNotNull()
    asked = F.col("reanchor") & ~F.col("fix") & ~F.col("remove")
    verdict = F.when(F.col("fix"), "FIX").when(F.col("remove"), "REMOVE").when(asked & (has | defect), "REANCHOR")
    more = F.array_compact(
        F.array(F.when(asked & has & F.col("weak_fit") & ~flagged, "WEAK_FIT"), F.when(asked & has, "BETTER_PHRASE"), F.when(asked & ~has & flagged, "NO_BETTER_PHRASE"))
    )
    return rows.withColumn("verdict", verdict).withColumn("reasons", F.concat("reasons", more))


def report(decided: DataFrame) -> DataFrame:
    """(kind, name, links): how many links carry each flag, reason and verdict; links without a verdict are healthy unless unverified."""
    listed = F.concat(
        F.transform("flags", lambda x: F.struct(F.lit("flag").alias("kind"), x.alias("name"))),
        F.transform("reasons", lambda x: F.struct(F.lit("reason").alias("kind"), x.alias("name"))),
        F.array(F.struct(F.lit("verdict").alias("kind"), F.coalesce("verdict", F.when(F.array_contains("reasons", "UNVERIFIED_TARGET"), "UNVERIFIED").otherwise("HEALTHY")).alias("name"))),
    )
    return decided.select(F.explode(listed).alias("x")).groupBy("x.kind", "x.name").agg(F.count("*").alias("links"))
