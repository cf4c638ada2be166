"""What a run serves: new links with their site-wide rank, rescues of orphans, pairs without an anchor, and one page in detail."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators.percentiles import places
from linkloom.operators.recommend import LONGEST

#: Sources that a rescue lists; actions that add a link.
BEST_SOURCES, NEW = 5, ("ADD_LINK", "CONTENT_GAP")


def new_links(emitted: DataFrame, rows: DataFrame, tenant: str) -> DataFrame:
    """``emitted`` of :func:`recommend.walk` with id, score (a percentage), tier, candidates and best_rank.

    ``best_rank`` counts from the best of the site: by percentile, then source, place, action and target. It is a range sort
    with one offset per partition, so no task holds the whole list.
    """
    facts = rows.select("source", "target", "percentile", "tier", "candidates", "reason", "advice")
    whole = emitted.join(facts, ["source", "target"])
    order = [F.col("percentile").desc(), F.col("source"), F.col("place"), F.col("action"), F.col("target")]
    ranked = places(whole, order, "best_rank")
    key = F.concat_ws("\x1f", F.lit(tenant), "action", F.col("source").cast("string"), F.col("target").cast("string"))
    gap = F.col("action") == "CONTENT_GAP"
    return ranked.select(
        F.substring(F.sha2(key, 256), 1, 16).alias("id"), "source", "target", "action", F.round(100 * F.col("percentile"), 1).alias("score"), "tier", "candidates", F.col("place").alias("rank_in_source"),
        F.col("best_rank").cast("bigint").alias("best_rank"), "suggested", "orphan_slot", F.when(gap, F.col("reason")).alias("reason"), F.when(gap, F.col("advice")).alias("advice"),
    )


def best_phrases(choices: DataFrame) -> DataFrame:
    """(source, target, anchor): the first phrase of a pair by rank that is not too long."""
    usable = choices.where(F.length("phrase") <= LONGEST)
    return usable.groupBy("source", "target").agg(F.min(F.struct("rank", "phrase")).alias("b")).select("source", "target", F.col("b.phrase").alias("anchor"))


def orphan_rescues(rows: DataFrame, emitted: DataFrame, choices: DataFrame, pages: DataFrame, wanted: DataFrame, unmet: DataFrame, guarantee: int, best: int = BEST_SOURCES) -> DataFrame:
    """One row per ``wanted`` page (page): guaranteed, suggested_in, unmet_reason, and its ``best`` sources with score, tier, anchor, strength and whether suggested.

    Sources stand in the page's hub, or anywhere if it has none; anchored ones first, then by score, strength and id. Of a page
    with very many sources only ``best`` of every part of them meet in a task.
    """
    here = wanted.select(F.col("page").alias("target")).distinct()
    strength = pages.select(F.col("page").alias("source"), F.col("rank_percentile").alias("strength"))
    into = rows.where("not excluded and hub_ok").join(here, "target", "left_semi").join(strength, "source", "left")
    order = [F.col("anchored").desc(), F.col("percentile").desc(), F.coalesce("strength", F.lit(-1.0)).desc(), F.col("source")]
    part = Window.partitionBy("target", F.pmod(F.xxhash64("source"), F.lit(64))).orderBy(*order)
    some = into.withColumn("at", F.row_number().over(part)).where(F.col("at") <= best)
    top = some.withColumn("at", F.row_number().over(Window.partitionBy("target").orderBy(*order))).where(F.col("at") <= best)
    given = emitted.where("suggested").select("source", "target", F.lit(True).alias("suggested")).distinct()
    named = top.join(best_phrases(choices), ["source", "target"], "left").join(given, ["source", "target"], "left")
    one = F.struct("at", "source", F.round(100 * F.col("percentile"), 1).alias("score"), "tier", "anchor", "strength", F.coalesce("suggested", F.lit(False)).alias("suggested"))
    listed = named.groupBy("target").agg(F.sort_array(F.collect_list(one)).alias("sources"))
    inbound = given.groupBy("target").agg(F.count("*").alias("n"))
    whole = here.join(listed, "target", "left").join(inbound, "target", "left").join(unmet.select(F.col("page").alias("target"), "reason"), "target", "left")
    return whole.select(
        F.col("target").alias("page"), F.lit(guarantee).alias("guaranteed"), F.coalesce("n", F.lit(0)).alias("suggested_in"), F.col("reason").alias("unmet_reason"),
        F.transform(F.coalesce("sources", F.array().cast(listed.schema["sources"].dataType)), lambda s: s.dropFields("at")).alias("sources"),
    )


def unanchored(rows: DataFrame, emitted: DataFrame) -> DataFrame:
    """Every ranked pair without an anchor that is not excluded, with its reason, and whether a content gap was recommended for it."""
    gaps = emitted.where("action = 'CONTENT_GAP'").select("source", "target", F.lit(True).alias("recommended")).distinct()
    found = rows.where("reason is not null and not excluded").join(gaps, ["source", "target"], "left")
    return found.select("source", "target", "reason", "advice", "best_score", "rank_in_source", F.coalesce("recommended", F.lit(False)).alias("recommended"))


def page_detail(profiles: DataFrame, records: DataFrame, page: int) -> tuple[DataFrame, DataFrame, int]:
    """A page's profile, its own records in the order they are served, and how many records add a link to it."""
    own = records.where(F.col("source") == page).orderBy("rank_in_source", "action", "target")
    return profiles.where(F.col("page") == page), own, records.where((F.col("target") == page) & F.col("action").isin(*NEW)).count()
