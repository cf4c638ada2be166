"""Recommendations per source page: links up to its budget, reserves, content gaps, the inbound cap and the orphan guarantee.

Percentiles, tiers, places and budgets are plans over the whole table. The cap and the guarantee are rules that go through
links and pages in order; :mod:`linkloom.operators.allocation` gives the same choices in rounds over all of them at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators.allocation import chosen
from linkloom.operators.percentiles import average_rank
from linkloom.operators.scoring import TIER_SHARES, tiers
from linkloom.plans.scratch import materialize

#: Longest anchor, and the reasons that call for copy first.
LONGEST = 120
GAPS = ("SOURCE_DOES_NOT_MENTION_TOPIC", "TOPIC_MENTIONED_BUT_NO_GOOD_PHRASE")


def link_budget(words: Column, outbound: Column, limit: int, words_per_link: int) -> Column:
    """New links that a page takes: one per ``words_per_link`` words, one to ``limit``, less those it has."""
    room = F.least(F.lit(limit), F.greatest(F.lit(1), F.floor(F.coalesce(words, F.lit(0)) / words_per_link)))
    return F.greatest(F.lit(0), room - F.coalesce(outbound, F.lit(0))).cast("long")


def assessed(ranked: DataFrame, choices: DataFrame, unanchored: DataFrame, pages: DataFrame, excluded: DataFrame, limit: int, words_per_link: int, shares: tuple[float, float] = TIER_SHARES) -> DataFrame:
    """Every ranked pair (source, target, score, rank_in_source) with percentile, tier, candidates, anchored, too_long, excluded, reason, action, hub_ok, budget."""
    rows = tiers(ranked.select("source", "target", "score", "rank_in_source"), "score", ["source", "target"], shares).drop("place")
    rows = average_rank(rows, "score", [], "percentile").withColumn("candidates", F.count("*").over(Window.partitionBy("source")))
    usable = choices.groupBy("source", "target").agg(F.max((F.length("phrase") <= LONGEST).cast("int")).alias("fits"))
    rows = rows.join(usable, ["source", "target"], "left").join(unanchored.select("source", "target", "reason", "advice", "best_score"), ["source", "target"], "left")
    out = excluded.select("page").distinct()
    rows = rows.join(out.select(F.col("page").alias("source"), F.lit(True).alias("xs")), "source", "left").join(out.select(F.col("page").alias("target"), F.lit(True).alias("xt")), "target", "left")
    hub = pages.select("page", F.when(F.col("hub") >= 0, F.col("hub")).alias("hub"))
    rows = rows.join(hub.select(F.col("page").alias("source"), F.col("hub").alias("hs")), "source", "left").join(hub.select(F.col("page").alias("target"), F.col("hub").alias("ht")), "target", "left")
    facts = pages.select(F.col("page").alias("source"), "words", "outbound")
    rows = rows.join(facts, "source", "left").withColumn("budget", link_budget(F.col("words"), F.col("outbound"), limit, words_per_link))
    anchored, gone = F.coalesce(F.col("fits") == 1, F.lit(False)), F.col("xs").isNotNull() | F.col("xt").isNotNull()
    gap = F.coalesce(F.col("reason").isin(*GAPS), F.lit(False)) & ~anchored
    return rows.select(
        "source", "target", "score", "rank_in_source", "percentile", "tier", "candidates", "reason", "advice", "best_score", "budget",
        anchored.alias("anchored"), F.coalesce(F.col("fits") == 0, F.lit(False)).alias("too_long"), gone.alias("excluded"),
        F.when(~gone & anchored, "ADD_LINK").when(~gone & gap, "CONTENT_GAP").alias("action"),
        (F.col("ht").isNull() | F.coalesce(F.col("hs") == F.col("ht"), F.lit(False))).alias("hub_ok"),
    )


def placed(rows: DataFrame, limit: int) -> DataFrame:
    """Each source's first ``limit`` rows in rank order, with their place."""
    at = F.row_number().over(Window.partitionBy("source").orderBy("rank_in_source", "target"))
    return rows.withColumn("place", at).where(F.col("place") <= limit)


def capped(links: DataFrame, cap: int, exempt: DataFrame) -> DataFrame:
    """``links`` (source, target, place, percentile, suggested) once no page but the ``exempt`` ones (page) takes more than ``cap`` suggestions.

    The best link is placed first, by percentile, source, place and target; one that its page has no room for moves to its
    source's first reserve whose page has. A ``cap`` of 0 leaves all as it is.
    """
    if cap == 0:
        return links
    own = materialize(links, "cap-links")
    key = F.struct("source", "place", "target")
    free = exempt.select(F.col("page").alias("_t")).distinct()
    agents = own.where("suggested").select(key.alias("agent"), "source", F.struct((-F.col("percentile")).alias("p"), F.col("source").alias("s"), F.col("place").alias("n"), F.col("target").alias("t")).alias("priority"))
    first = agents.select("agent", "priority", F.lit(0).alias("rank"), F.col("agent").alias("object"))
    reserves = own.where("not suggested").select(F.col("source").alias("_s"), F.col("place").alias("rank"), key.alias("object"))
    options = first.unionByName(agents.join(reserves, F.col("source") == F.col("_s")).select("agent", "priority", "rank", "object"))
    pool = options.join(free, F.col("object.target") == F.col("_t"), "left").withColumn("pool", F.when(F.col("_t").isNull(), F.col("object.target"))).drop("_t")
    taken = chosen(pool.withColumn("demand", F.lit(1)), cap).select(F.col("object.source").alias("source"), F.col("object.place").alias("place"), F.col("object.target").alias("target"), F.lit(True).alias("_taken"))
    return own.join(taken, ["source", "place", "target"], "left").withColumn("suggested", F.coalesce("_taken", F.lit(False))).drop("_taken").select(*links.columns)


def guaranteed(links: DataFrame, pairs: DataFrame, wanted: DataFrame, guarantee: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Links (source, target, rank_in_source, suggested, orphan_slot) with a slot for the ``wanted`` pages (page) short of links, and (page, reason) of those that stay short.

    ``pairs`` are the tier 1 and 2 pairs into wanted pages (source, target, rank_in_source, percentile, strength, anchored).
    Pages with the fewest sources to ask go first. A source gives one slot, taking back its lowest suggestion into a page
    that is not wanted; a slot beyond its ``limit`` links drops its lowest reserve.
    """
    wish = materialize(wanted.select("page").distinct(), "walk-wanted")
    mark = wish.select(F.col("page").alias("target"), F.lit(True).alias("_wish"))
    book = materialize(links.select("source", "target", "rank_in_source", "suggested").join(mark, "target", "left").withColumn("_wish", F.coalesce("_wish", F.lit(False))), "walk-book")
    inbound = book.where("suggested and _wish").groupBy("target").agg(F.count("*").alias("has"))
    gives = book.where("suggested and not _wish").select("source").distinct()
    here = book.where("suggested").select("source", "target", F.lit(True).alias("_has"))
    offers = pairs.where("anchored").join(gives, "source", "left_semi").join(here, ["source", "target"], "left_anti").select("source", "target", "rank_in_source", "percentile", "strength")
    offers = materialize(offers, "walk-offers")
    agents = wish.select(F.col("page").alias("target")).join(inbound, "target", "left").join(offers.groupBy("target").agg(F.count("*").alias("ask")), "target", "left")
    agents = agents.select("target", (F.lit(guarantee) - F.coalesce("has", F.lit(0))).cast("int").alias("demand"), F.struct(F.coalesce("ask", F.lit(0)).alias("n"), F.col("target").alias("t")).alias("priority")).where("demand > 0")
    order = F.struct((-F.col("percentile")).alias("p"), (-F.col("strength")).alias("st"), F.col("source").alias("s"), F.col("rank_in_source").alias("r"))
    options = offers.join(agents, "target").select(F.col("target").alias("agent"), "priority", "demand", order.alias("rank"), F.col("source").alias("object"), F.lit(None).cast("bigint").alias("pool"))
    slots = materialize(chosen(options).select(F.col("agent").alias("target"), F.col("object").alias("source")), "walk-slots")
    ranks = offers.groupBy("source", "target").agg(F.min("rank_in_source").alias("_rank"))
    slots = slots.join(ranks, ["source", "target"])
    # A source gives one slot at most, so its links change once, by themselves.
    giving = slots.select("source", F.col("target").alias("_slot"), "_rank")
    down = Window.partitionBy("source").orderBy(F.col("_losable").desc(), F.col("rank_in_source").desc(), "target")
    changed = book.join(giving, "source").withColumn("_losable", F.col("suggested") & ~F.col("_wish"))
    changed = changed.withColumn("_lost", F.col("_losable") & (F.row_number().over(down) == 1)).withColumn("suggested", F.col("suggested") & ~F.col("_lost"))
    known = changed.withColumn("orphan_slot", F.col("target") == F.col("_slot")).withColumn("suggested", F.col("suggested") | F.col("orphan_slot"))
    held = known.where("orphan_slot").select("source").distinct()
    fresh = giving.join(held, "source", "left_anti").select("source", F.col("_slot").alias("target"), F.col("_rank").alias("rank_in_source"), F.lit(True).alias("suggested"), F.lit(True).alias("orphan_slot"))
    both = known.select("source", "target", "rank_in_source", "suggested", "orphan_slot").unionByName(fresh)
    size, low = Window.partitionBy("source"), Window.partitionBy("source").orderBy(F.col("suggested"), F.col("rank_in_source").desc(), "target")
    both = both.withColumn("_size", F.count("*").over(size)).withColumn("_low", F.row_number().over(low))
    both = both.where(~((F.col("_size") > limit) & (F.col("_low") == 1) & ~F.col("suggested"))).drop("_size", "_low")
    rest = book.join(giving.select("source"), "source", "left_anti").select("source", "target", "rank_in_source", "suggested", F.lit(False).alias("orphan_slot"))
    done = materialize(rest.unionByName(both), "walk-guaranteed")
    got = done.where("suggested").join(wish.withColumnRenamed("page", "target"), "target", "left_semi").groupBy("target").agg(F.count("*").alias("n"))
    into = pairs.groupBy("target").agg(F.max(F.col("anchored").cast("int")).alias("any"))
    short = wish.withColumnRenamed("page", "target").join(got, "target", "left").where(F.coalesce("n", F.lit(0)) < guarantee).join(into, "target", "left")
    reason = F.when(F.col("any").isNull(), "NO_RELEVANT_SOURCE").when(F.col("any") == 0, "NO_ANCHOR").otherwise("SOURCES_FULL")
    return done, short.select(F.col("target").alias("page"), reason.alias("reason"))


def walk(rows: DataFrame, pages: DataFrame, limit: int, gap_limit: int, cap: int = 5, guarantee: int = 2, below: int = 1) -> tuple[DataFrame, DataFrame]:
    """(source, target, action, rank_in_source, place, suggested, orphan_slot) of what is emitted, and (page, reason) of pages left short.

    ``rows`` comes from :func:`assessed`; ``pages`` has page, inbound, is_pillar, rank_percentile and linkable.
    """
    rows = materialize(rows, "walk-pairs")
    links = placed(rows.where("action = 'ADD_LINK'"), limit).withColumn("suggested", F.col("place") <= F.col("budget"))
    short = pages.where((F.col("inbound") < below) & F.col("linkable") & F.lit(guarantee > 0)).select("page")
    short = short.join(rows.where("excluded").select(F.col("target").alias("page")).distinct(), "page", "left_anti")
    into = rows.where("tier <= 2 and hub_ok and not excluded").join(short.select(F.col("page").alias("target")), "target", "left_semi")
    into = into.join(pages.select(F.col("page").alias("source"), F.coalesce("rank_percentile", F.lit(-1.0)).alias("strength")), "source", "left").fillna({"strength": -1.0})
    links = capped(links.select("source", "target", "rank_in_source", "percentile", "place", "suggested"), cap, pages.where("is_pillar"))
    done, lost = guaranteed(links, materialize(into, "walk-into"), short, guarantee, limit)
    kept = placed(done, limit)
    last = kept.where("suggested").groupBy("source").agg(F.max("rank_in_source").alias("last"))
    gaps = rows.where("action = 'CONTENT_GAP' and budget >= 1").join(last, "source", "left").where("last is null or rank_in_source < last")
    gaps = placed(gaps, gap_limit).select("source", "target", "rank_in_source", F.lit(False).alias("suggested"), F.lit(False).alias("orphan_slot"), "place", F.lit("CONTENT_GAP").alias("action"))
    return kept.withColumn("action", F.lit("ADD_LINK")).unionByName(gaps), lost


def target_fixes(emitted: DataFrame, rows: DataFrame, best: int = 5) -> DataFrame:
    """target, waiting, sources: pages without a keyword, how many sources wait for one, and the best of them by score."""
    asked = rows.where("reason = 'TARGET_PAGE_HAS_NO_KEYWORD' and not excluded")
    by = Window.partitionBy("target").orderBy(F.col("score").desc(), "source")
    ranked = asked.withColumn("r", F.row_number().over(by))
    return ranked.groupBy("target").agg(F.count("*").alias("waiting"), F.transform(F.sort_array(F.collect_list(F.when(F.col("r") <= best, F.struct("r", "source")))), lambda x: x["source"]).alias("sources"))
