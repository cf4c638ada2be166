"""Listings that are served: page profiles, hubs, duplicates, the site in one row, scored links, and pages of a listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.vector import cosine
from linkloom.operators.features import in_hub
from linkloom.operators.graph import orphan_label

TYPES = ("EXACT", "PARTIAL", "NATURAL", "BRANDED", "GENERIC")


def relevance(value: Column) -> Column:
    """A cosine as 0 to 1; null stays null."""
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 + value) / 2)))


def link_scores(links: DataFrame, pages: DataFrame, anchors: DataFrame) -> DataFrame:
    """source, position, context_relevance, anchor_target_fit: the sentence against the target, and the anchor against it, null for a generic anchor.

    ``links`` has source, position, target, anchor_key, generic and sentence_vector; ``anchors`` anchor_key and vector.
    """
    rows = links.join(pages.select(F.col("page").alias("target"), F.col("vector").alias("tv")), "target", "left").join(anchors.select("anchor_key", F.col("vector").alias("av")), "anchor_key", "left")
    both = lambda v: F.when(F.col(v).isNotNull() & F.col("tv").isNotNull(), cosine(v, "tv"))
    fit = F.when(~F.col("generic"), relevance(both("av")))
    return rows.select("source", "position", relevance(both("sentence_vector")).alias("context_relevance"), fit.alias("anchor_target_fit"))


def page_profiles(pages: DataFrame, anchors: DataFrame) -> DataFrame:
    """Every page with its facts, its orphan label, and how many of its inbound anchors are of each type.

    ``pages`` has page, language, hub, words, inbound, outbound, rank_percentile, menu and footer; ``anchors`` target and type.
    """
    mix = anchors.groupBy(F.col("target").alias("page")).agg(*[F.count_if(F.col("type") == t).alias(f"anchors_{t.lower()}") for t in TYPES])
    counts = [F.coalesce(f"anchors_{t.lower()}", F.lit(0)).alias(f"anchors_{t.lower()}") for t in TYPES]
    label = orphan_label(F.col("inbound"), F.col("menu") + F.col("footer"))
    return pages.join(mix, "page", "left").select("page", "language", "hub", "words", "inbound", "outbound", "rank_percentile", label.alias("label"), *counts)


def hub_summaries(pages: DataFrame, links: DataFrame, pillars: DataFrame) -> DataFrame:
    """hub, pages, languages, pillar, orphans, mean_percentile, links_inside, links_out; noise and pages without a hub are left out."""
    own = pages.where(in_hub(F.col("hub")))
    per = own.groupBy("hub").agg(
        F.count("*").alias("pages"), F.count_distinct("language").alias("languages"), F.count_if(F.col("inbound") == 0).alias("orphans"), F.avg("rank_percentile").alias("mean_percentile")
    )
    a, b = own.select(F.col("page").alias("source"), "hub"), pages.select(F.col("page").alias("target"), F.col("hub").alias("other"))
    edges = links.where("source <> target").select("source", "target").distinct().join(a, "source").join(b, "target")
    inside = F.col("hub") == F.col("other")
    flows = edges.groupBy("hub").agg(F.count_if(inside).alias("links_inside"), F.count_if(~F.coalesce(inside, F.lit(False))).alias("links_out"))
    rows = per.join(flows, "hub", "left").join(pillars.select("hub", F.col("page").alias("pillar")), "hub", "left")
    return rows.select("hub", "pages", "languages", "pillar", "orphans", "mean_percentile", F.coalesce("links_inside", F.lit(0)).alias("links_inside"), F.coalesce("links_out", F.lit(0)).alias("links_out"))


def duplicate_listing(copies: DataFrame) -> DataFrame:
    """duplicate_group, canonical, copies of (page, duplicate_group, is_canonical); a group without just one canonical page is an error."""
    per = copies.groupBy("duplicate_group").agg(F.max(F.when(F.col("is_canonical"), F.col("page"))).alias("canonical"), F.count_if("is_canonical").alias("n"), F.count("*").alias("copies"))
    fault = F.raise_error(F.concat(F.lit("group "), F.col("duplicate_group").cast("string"), F.lit(" has "), F.col("n").cast("string"), F.lit(" canonical pages")))
    return per.select("duplicate_group", F.when(F.col("n") == 1, F.col("canonical")).otherwise(fault.cast("long")).alias("canonical"), "copies")


def site_summary(pages: DataFrame, links: DataFrame) -> DataFrame:
    """One row: pages, links, orphans, dead ends, hubs, noise pages, languages and words of the site."""
    edges = links.where("source <> target").select("source", "target").distinct()
    return pages.agg(
        F.count("*").alias("pages"), edges.agg(F.count("*")).scalar().alias("links"), F.count_if(F.col("inbound") == 0).alias("orphans"), F.count_if(F.col("outbound") == 0).alias("dead_ends"),
        F.count_distinct(F.when(in_hub(F.col("hub")), F.col("hub"))).alias("hubs"), F.count_if(F.col("hub") == -1).alias("noise"), F.count_distinct("language").alias("languages"), F.sum("words").alias("words"),
    )


def listing(rows: DataFrame, keys: list[str], after: tuple | None, size: int, where: dict[str, object] | None = None) -> tuple[DataFrame, int]:
    """One row more than a page of ``size`` behind ``after`` in key order, which tells whether there is a next one; and all rows that fit.

    ``where`` maps a column to a value, a list of values, None (null) or Ellipsis (not null).
    """
    from linkloom.operators.text_tables import keyset_page

    for name, want in (where or {}).items():
        c = F.col(name)
        rows = rows.where(c.isNull() if want is None else c.isNotNull() if want is ... else c.isin(*want) if isinstance(want, list) else c == want)
    return keyset_page(rows, keys, after, size + 1), rows.count()


def record_order() -> list[Column]:
    """Recommendations of a page: links to add before gaps, then verdicts; suggested ones first, by place, then target."""
    kind = F.when(F.col("action") == "ADD_LINK", 0).when(F.col("action") == "CONTENT_GAP", 1).otherwise(2)
    return [F.col("source"), kind, (~F.col("suggested")).cast("int"), F.col("place"), F.col("target")]
