"""Page contexts and the feature matrix of candidate pairs.

Pages carry page, language, hub (-1: noise, null: none), words, inbound, outbound, depth, rank_percentile, is_orphan,
is_pillar and the communities link_community, keyword_community, content_community. Every other input is keyed by page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.terms import term_keys
from linkloom.operators.scoring import rounded_position

#: Upper ends of the position bands, and the classes of topic and link agreement.
BANDS = (3, 10, 20, 50)
AGREEMENT = ("same_topic_same_links", "same_topic_other_links", "other_topic_same_links", "other_topic_other_links", "unknown_topic")
NOISE = -1
#: The columns of the matrix.
MATRIX = (
    "source_impressions_log", "target_impressions_log", *[f"target_position_band_{b}" for b in range(len(BANDS) + 1)], "target_position_band_null", "target_ctr_gap", "target_query_count",
    "has_gsc_data", "pair_query_overlap", "pair_kw_overlap", "target_kw_count", "target_max_priority", "target_keyword_gap", "target_inbound_count", "target_is_orphan", "target_crawl_depth",
    "target_page_rank_percentile", "target_saturation_ratio", "source_outbound_count", "source_outbound_density", "source_link_equity_share", "source_page_rank_percentile", "same_hub",
    "source_is_hub_pillar", "target_is_hub_pillar", "source_hub_size", "target_hub_size", "target_hub_coverage", "same_link_community", "same_keyword_community", "same_content_community",
    *[f"cluster_agreement_{a}" for a in AGREEMENT], *[f"content_agreement_{a}" for a in AGREEMENT], "content_cosine", "context_relevance", "anchor_target_fit",
)


def position_band(position: Column) -> Column:
    """0 to 4 by the rounded position; null stays null."""
    at = F.floor(position + 0.5)
    band = F.lit(len(BANDS))
    for i, top in reversed(list(enumerate(BANDS))):
        band = F.when(at <= top, i).otherwise(band)
    return F.when(position.isNotNull(), band)


def jaccard(a: Column, b: Column, both: Column | None = None) -> Column:
    """Share of common elements of two sets given as arrays; 0 where both are empty. ``both`` is their number where it is a column."""
    both = F.size(F.array_intersect(a, b)) if both is None else both
    union = F.size(a) + F.size(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def same_cluster(a: Column, b: Column, noise: int | None = None) -> Column:
    """Null where either is null; noise is in no cluster, not even with noise."""
    same = a == b
    return same if noise is None else F.when(a.isNotNull() & b.isNotNull(), same & (a != noise))


def agreement(topic_a: Column, topic_b: Column, link_a: Column, link_b: Column) -> Column:
    links = F.coalesce(link_a == link_b, F.lit(False))
    same = F.when(links, AGREEMENT[0]).otherwise(AGREEMENT[1])
    other = F.when(links, AGREEMENT[2]).otherwise(AGREEMENT[3])
    return F.when(topic_a.isNull() | topic_b.isNull(), AGREEMENT[4]).when(topic_a == topic_b, same).otherwise(other)


def in_hub(hub: Column) -> Column:
    return hub.isNotNull() & (hub != NOISE)


def page_signals(pages: DataFrame, queries: DataFrame, keywords: DataFrame) -> DataFrame:
    """page, queries, keywords, keyword_gap. Terms are compared by key; rows of other pages and blank terms are left out.

    Without a single row of ``queries`` the gap is unknown. ``queries`` has page and query, ``keywords`` page and keyword.
    Texts are collected per page as they are; keys are taken of the distinct ones, for the pages of ``pages`` only.
    """
    sets = lambda rows, text, name: rows.groupBy("page").agg(F.collect_set(text).alias(name))
    joined = pages.select("page").join(sets(queries, "query", "queries"), "page", "left").join(sets(keywords, "keyword", "keywords"), "page", "left")
    joined = joined.select("page", *[term_keys(F.col(c)).alias(c) for c in ("queries", "keywords")])
    any_query = queries.select(F.lit(1).alias("x")).limit(1).agg(F.count("*")).scalar() > 0
    return joined.withColumn("keyword_gap", F.when(any_query, F.size(F.array_except("keywords", "queries"))))


def page_contexts(pages: DataFrame, signals: DataFrame, links: DataFrame, metrics: DataFrame, priorities: DataFrame, curve: list[float] | None) -> DataFrame:
    """What one page brings to each of its pairs: one row per page, by left joins on page, hub and decile.

    ``metrics`` has page, impressions, clicks, avg_position and query_count; ``priorities`` page and priority. A median is
    taken over one inbound count per page of a decile; hub sizes and coverage are grouped counts.
    """
    decile = F.least(F.floor(F.col("rank_percentile") * 10), F.lit(9)).cast("int")
    pages = pages.withColumn("decile", decile)
    medians = pages.groupBy("decile").agg(F.expr("percentile(inbound, 0.5)").alias("median"))
    medians = medians.select(F.col("decile").alias("_d"), "median")
    sizes = pages.where(in_hub(F.col("hub"))).groupBy("hub").agg(F.count("*").alias("hub_size"))
    hubs = pages.where(in_hub(F.col("hub"))).select("page", "hub")
    inside = links.where("source <> target").select("source", "target").distinct()
    inside = inside.join(hubs.select(F.col("page").alias("source"), "hub"), "source").join(hubs.select(F.col("page").alias("target"), F.col("hub").alias("h")), "target").where("hub = h")
    within = inside.groupBy(F.col("target").alias("page")).agg(F.count("*").alias("within"))
    known = metrics.select("page", "impressions", "clicks", "avg_position", "query_count", F.lit(True).alias("has_gsc"))
    best = priorities.where("priority is not null").groupBy("page").agg(F.max("priority").alias("max_priority"))
    rows = pages.join(medians, F.col("decile").eqNullSafe(F.col("_d")), "left").drop("_d").join(sizes, "hub", "left")
    for other in (within, known, best, signals):
        rows = rows.join(other, "page", "left")
    expected = F.lit(None).cast("double")
    if curve:
        values = F.array(*[F.lit(c) for c in curve])
        expected = F.element_at(values, F.least(rounded_position(F.col("avg_position")), F.size(values)))
    gap = F.when(F.col("impressions") > 0, F.least(F.col("clicks") / F.col("impressions"), F.lit(1.0)) - expected)
    size = F.when(in_hub(F.col("hub")), F.col("hub_size"))
    return rows.select(
        "page", "language", "hub", "words", "inbound", "outbound", "depth", "rank_percentile", "is_pillar", "link_community", "keyword_community", "content_community",
        "queries", "keywords", "keyword_gap", "query_count", "max_priority",
        F.coalesce("has_gsc", F.lit(False)).alias("has_gsc"),
        F.log1p("impressions").alias("impressions_log"), position_band(F.col("avg_position")).alias("band"), gap.alias("ctr_gap"),
        F.coalesce("is_orphan", F.col("inbound") == 0).alias("is_orphan"),
        F.when(F.col("median") > 0, F.col("inbound") / F.col("median")).otherwise(F.col("inbound").cast("double")).alias("saturation"),
        (F.col("outbound") * 1000 / F.greatest(F.col("words"), F.lit(1))).alias("density"), (1 / (F.col("outbound") + 1)).alias("share"),
        size.alias("hub_size"), F.when(size > 1, F.coalesce("within", F.lit(0)) / (size - 1)).when(size == 1, 0.0).alias("coverage"),
    )


def pair_features(pairs: DataFrame, contexts: DataFrame, placements: DataFrame | None = None) -> DataFrame:
    """source, target and 47 doubles per row of ``pairs`` (source, target, similarity): two joins of the pair table with the page table.

    ``placements`` gives context_relevance and anchor_target_fit of (source, target); pairs without stay null. Pairs of
    pages without a context are left out; :func:`missing_pages` names them.
    """
    s = contexts.select(F.struct(*contexts.columns).alias("s"), F.col("page").alias("source"))
    t = contexts.select(F.struct(*contexts.columns).alias("t"), F.col("page").alias("target"))
    rows = pairs.select("source", "target", "similarity").join(s, "source").join(t, "target")
    if placements is None:
        rows = rows.withColumn("context_relevance", F.lit(None).cast("double")).withColumn("anchor_target_fit", F.lit(None).cast("double"))
    else:
        rows = rows.join(placements.select("source", "target", "context_relevance", "anchor_target_fit"), ["source", "target"], "left")
    both = lambda f: (F.col(f"s.{f}"), F.col(f"t.{f}"))
    # Common terms are columns of their own: inside the quotient Spark would look for them three times.
    rows = rows.withColumns({f"_{f}": F.size(F.array_intersect(*both(f))) for f in ("queries", "keywords")})
    cluster = agreement(*both("keyword_community"), *both("link_community"))
    content = agreement(*both("content_community"), *both("link_community"))
    columns = {
        "source_impressions_log": F.col("s.impressions_log"), "target_impressions_log": F.col("t.impressions_log"),
        **{f"target_position_band_{b}": F.col("t.band").eqNullSafe(F.lit(b)) for b in range(len(BANDS) + 1)}, "target_position_band_null": F.col("t.band").isNull(),
        "target_ctr_gap": F.col("t.ctr_gap"), "target_query_count": F.col("t.query_count"), "has_gsc_data": F.col("t.has_gsc"),
        "pair_query_overlap": jaccard(*both("queries"), F.col("_queries")), "pair_kw_overlap": jaccard(*both("keywords"), F.col("_keywords")), "target_kw_count": F.size("t.keywords"),
        "target_max_priority": F.col("t.max_priority"), "target_keyword_gap": F.col("t.keyword_gap"), "target_inbound_count": F.col("t.inbound"),
        "target_is_orphan": F.col("t.is_orphan"), "target_crawl_depth": F.col("t.depth"), "target_page_rank_percentile": F.col("t.rank_percentile"),
        "target_saturation_ratio": F.col("t.saturation"), "source_outbound_count": F.col("s.outbound"), "source_outbound_density": F.col("s.density"),
        "source_link_equity_share": F.col("s.share"), "source_page_rank_percentile": F.col("s.rank_percentile"),
        "same_hub": same_cluster(*both("hub"), NOISE), "source_is_hub_pillar": F.col("s.is_pillar"), "target_is_hub_pillar": F.col("t.is_pillar"),
        "source_hub_size": F.col("s.hub_size"), "target_hub_size": F.col("t.hub_size"), "target_hub_coverage": F.col("t.coverage"),
        **{f"same_{k}_community": same_cluster(*both(f"{k}_community")) for k in ("link", "keyword", "content")},
        **{f"cluster_agreement_{a}": cluster == a for a in AGREEMENT}, **{f"content_agreement_{a}": content == a for a in AGREEMENT},
        "content_cosine": F.col("similarity"), "context_relevance": F.col("context_relevance"), "anchor_target_fit": F.col("anchor_target_fit"),
    }
    return rows.select("source", "target", *[columns[n].cast("double").alias(n) for n in MATRIX])


def missing_pages(pairs: DataFrame, contexts: DataFrame) -> DataFrame:
    """Pages of candidate pairs that have no context."""
    ends = pairs.select(F.explode(F.array("source", "target")).alias("page")).distinct()
    return ends.join(contexts.select("page"), "page", "left_anti")


def feature_report(features: DataFrame) -> DataFrame:
    """column, missing, low, high, constant per feature: one pass of aggregates, then one row per column."""
    names = [c for c in features.columns if c not in ("source", "target")]
    one = features.agg(*[F.struct(F.count_if(F.col(c).isNull()).alias("missing"), F.min(c).alias("low"), F.max(c).alias("high")).alias(c) for c in names])
    listed = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("x")) for c in names])).alias("r")).select("r.column", "r.x.*")
    return listed.withColumn("constant", F.coalesce(F.col("low") == F.col("high"), F.lit(True)))


def signal_report(pairs: DataFrame, contexts: DataFrame) -> DataFrame:
    """One row over all pairs: overlaps, shared hubs, noise and the classes of agreement."""
    rows = pair_features(pairs, contexts)
    return rows.agg(
        F.count("*").alias("pairs"), F.count_if(F.col("pair_query_overlap") > 0).alias("query_overlap_pairs"), F.round(F.avg("pair_query_overlap"), 6).alias("query_overlap_mean"),
        F.count_if(F.col("pair_kw_overlap") > 0).alias("keyword_overlap_pairs"), F.round(F.avg("pair_kw_overlap"), 6).alias("keyword_overlap_mean"), F.count_if(F.col("same_hub") == 1).alias("same_hub_pairs"),
        *[F.sum(f"{k}_agreement_{a}").cast("long").alias(f"{k}_{a}") for k in ("cluster", "content") for a in AGREEMENT],
    )
