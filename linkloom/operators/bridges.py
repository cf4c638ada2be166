"""Bridges between topic hubs: hub pairs, the pairs that have to be connected, and page pairs that connect them.

Pages have page, language, hub, outbound, rank_percentile and vector. Tables of hub pairs are small (hubs squared per
language); page pairs are only made between the two hubs of a direction that lacks links.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.vector import cosine
from linkloom.operators.features import in_hub
from linkloom.operators.graph import hub_centroids

#: Fixed values of the rules.
FLOOR, NEAREST, WIDEST, SHARED = 0.05, 2, 3, 10
COSINE, JACCARD, DENSITY = 0.4, 0.6, 50.0
REASONS = ("SPANNING_TREE", "NEAREST_HUB", "BRIDGE_GAP")


def floor_pages(size: Column) -> Column:
    """Pages of a hub of that size that have to link into another hub."""
    return F.greatest(F.lit(1), F.ceil(F.round(FLOOR * size, 9))).cast("long")


def _members(pages: DataFrame) -> DataFrame:
    return pages.where(in_hub(F.col("hub")))


def linked(pages: DataFrame, links: DataFrame) -> DataFrame:
    """(language, hub_from, hub_to, source, target): distinct links between different hubs of one language."""
    a = _members(pages).select(F.col("page").alias("source"), F.col("language").alias("language"), F.col("hub").alias("hub_from"))
    b = _members(pages).select(F.col("page").alias("target"), F.col("language").alias("lb"), F.col("hub").alias("hub_to"))
    both = links.select("source", "target").distinct().join(a, "source").join(b, "target")
    return both.where(F.col("language").eqNullSafe(F.col("lb")) & (F.col("hub_from") != F.col("hub_to"))).drop("lb")


def hub_pairs(pages: DataFrame, links: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """Every pair hub_a < hub_b with pages in one language: sizes, pages that link each way, density, centroid cosine, query overlap, gap.

    ``queries`` has page and query (already as keys). Without it the overlap is null and the cosine takes its weight.
    """
    members = _members(pages)
    sizes = members.groupBy("language", "hub").agg(F.count("*").alias("size")).join(hub_centroids(members), "hub")
    side = lambda s: sizes.select(F.col("language").alias(f"l{s}"), F.col("hub").alias(f"hub_{s}"), F.col("size").alias(f"size_{s}"), F.col("centroid").alias(f"c{s}"))
    pairs = side("a").join(side("b"), F.col("la").eqNullSafe(F.col("lb")) & (F.col("hub_a") < F.col("hub_b"))).withColumnRenamed("la", "language").drop("lb")
    edges = linked(pages, links)
    ways = edges.groupBy("language", F.least("hub_from", "hub_to").alias("a"), F.greatest("hub_from", "hub_to").alias("b")).agg(
        F.count("*").alias("links"),
        F.count_distinct(F.when(F.col("hub_from") < F.col("hub_to"), F.col("source"))).alias("ab"),
        F.count_distinct(F.when(F.col("hub_from") > F.col("hub_to"), F.col("source"))).alias("ba"),
    )
    pairs = _on_pair(pairs, ways)
    pairs = pairs.withColumn("density", F.coalesce("links", F.lit(0)) / (F.col("size_a") * F.col("size_b"))).withColumn("cosine", cosine("ca", "cb"))
    if queries is None:
        pairs = pairs.withColumn("query_jaccard", F.lit(None).cast("double")).withColumn("shared_queries", F.array().cast("array<string>"))
        topic = F.col("cosine")
    else:
        per = members.select("page", "language", "hub").join(queries.select("page", "query").distinct(), "page").groupBy("language", "hub", "query").agg(F.count("*").alias("n"))
        counts = per.groupBy("language", "hub").agg(F.count("*").alias("terms"))
        x = per.select(F.col("language").alias("language"), F.col("hub").alias("a"), "query", F.col("n").alias("na"))
        y = per.select(F.col("language").alias("l2"), F.col("hub").alias("b"), F.col("query").alias("q2"), F.col("n").alias("nb"))
        common = x.join(y, F.col("language").eqNullSafe(F.col("l2")) & (F.col("query") == F.col("q2")) & (F.col("a") < F.col("b")))
        ordered = F.sort_array(F.collect_list(F.struct((-F.col("na") - F.col("nb")).alias("k"), "query")))
        common = common.groupBy("language", "a", "b").agg(F.count("*").alias("common"), F.slice(ordered, 1, SHARED).alias("top"))
        pairs = _on_pair(pairs, common)
        for s in ("a", "b"):
            own = counts.select(F.col("language").alias("l3"), F.col("hub").alias("h3"), F.col("terms").alias(f"terms_{s}"))
            pairs = pairs.join(own, F.col("language").eqNullSafe(F.col("l3")) & (F.col(f"hub_{s}") == F.col("h3")), "left").drop("l3", "h3")
        union = F.coalesce("terms_a", F.lit(0)) + F.coalesce("terms_b", F.lit(0)) - F.coalesce("common", F.lit(0))
        pairs = pairs.withColumn("query_jaccard", F.when(union > 0, F.coalesce("common", F.lit(0)) / union).otherwise(0.0))
        pairs = pairs.withColumn("shared_queries", F.coalesce(F.transform("top", lambda t: t["query"]), F.array().cast("array<string>")))
        topic = COSINE * F.col("cosine") + JACCARD * F.col("query_jaccard")
    return pairs.select(
        "language", "hub_a", "hub_b", "size_a", "size_b", F.coalesce("ab", F.lit(0)).alias("pages_ab"), F.coalesce("ba", F.lit(0)).alias("pages_ba"), "density", "cosine",
        "query_jaccard", "shared_queries", (topic - DENSITY * F.col("density")).alias("gap"),
    )


def _on_pair(pairs: DataFrame, other: DataFrame) -> DataFrame:
    renamed = other.withColumnRenamed("language", "l9")
    return pairs.join(renamed, F.col("language").eqNullSafe(F.col("l9")) & (F.col("hub_a") == F.col("a")) & (F.col("hub_b") == F.col("b")), "left").drop("l9", "a", "b")


def _tree(pdf: pd.DataFrame) -> pd.DataFrame:
    """The maximum spanning tree of one language's hub pairs, the lower hubs first on ties."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    kept = []
    for a, b in pdf.sort_values(["cosine", "hub_a", "hub_b"], ascending=[False, True, True])[["hub_a", "hub_b"]].itertuples(index=False):
        x, y = find(a), find(b)
        if x != y:
            root[y] = x
            kept.append((a, b))
    return pd.DataFrame(kept, columns=["hub_a", "hub_b"]).assign(language=pdf["language"].iloc[0])


def covered_pairs(pairs: DataFrame) -> DataFrame:
    """``pairs`` with reasons, why each has to be connected: spanning tree, one of a hub's two nearest, one of the three widest gaps."""
    tree = pairs.select("language", "hub_a", "hub_b", "cosine").groupBy("language").applyInPandas(_tree, "hub_a int, hub_b int, language string")
    ends = pairs.select("language", "hub_a", "hub_b", "cosine", F.explode(F.array(F.struct(F.col("hub_a").alias("own"), F.col("hub_b").alias("other")), F.struct(F.col("hub_b").alias("own"), F.col("hub_a").alias("other")))).alias("e"))
    near = ends.withColumn("r", F.row_number().over(Window.partitionBy("language", "e.own").orderBy(F.col("cosine").desc(), "e.other"))).where(F.col("r") <= NEAREST)
    wide = pairs.withColumn("r", F.row_number().over(Window.partitionBy("language").orderBy(F.col("gap").desc(), "hub_a", "hub_b"))).where(F.col("r") <= WIDEST)
    said = [x.select("language", "hub_a", "hub_b", F.lit(i).alias("reason")).distinct() for i, x in enumerate((tree, near, wide))]
    why = said[0].unionByName(said[1]).unionByName(said[2]).groupBy("language", F.col("hub_a").alias("a"), F.col("hub_b").alias("b")).agg(F.sort_array(F.collect_set("reason")).alias("why"))
    names = F.array(*[F.lit(r) for r in REASONS])
    return _on_pair(pairs, why).withColumn("reasons", F.coalesce(F.transform("why", lambda i: F.get(names, i)), F.array().cast("array<string>"))).drop("why")


def directions(pairs: DataFrame) -> DataFrame:
    """(language, hub_from, hub_to, size, have, slots, reasons): both ways of every covered pair, with the pages still missing."""
    one = lambda x, y: F.struct(F.col(f"hub_{x}").alias("hub_from"), F.col(f"hub_{y}").alias("hub_to"), F.col(f"size_{x}").alias("size"), F.col(f"pages_{x}{y}").alias("have"))
    both = pairs.where(F.size("reasons") > 0).select("language", "reasons", F.explode(F.array(one("a", "b"), one("b", "a"))).alias("d")).select("language", "reasons", "d.*")
    return both.withColumn("slots", floor_pages(F.col("size")) - F.col("have"))


def bridge_links(pairs: DataFrame, pages: DataFrame, links: DataFrame, targets: DataFrame, copies: DataFrame, alternatives: int = 2) -> DataFrame:
    """language, hub_from, hub_to, slot, rank, source, target, similarity, reasons: for every direction below its floor, one source per missing page.

    Sources are pages of the hub with a vector that are no copy and don't link there yet, by their best cosine to a target
    (two decimals), PageRank percentile, fewer links out and page; targets are those in ``targets`` that are no copy, by cosine.
    """
    lacking = directions(pairs).where("slots > 0")
    members = _members(pages).where(F.col("vector").isNotNull()).join(copies.select("page"), "page", "left_anti")
    s = members.select(F.col("page").alias("source"), F.col("language").alias("ls"), F.col("hub").alias("hs"), F.col("vector").alias("vs"), "rank_percentile", "outbound")
    t = members.join(targets.select("page"), "page", "left_semi").select(F.col("page").alias("target"), F.col("language").alias("lt"), F.col("hub").alias("ht"), F.col("vector").alias("vt"))
    free = lacking.join(s, F.col("language").eqNullSafe(F.col("ls")) & (F.col("hub_from") == F.col("hs")))
    have = linked(pages, links).select(F.col("source").alias("s9"), F.col("hub_to").alias("h9")).distinct()
    free = free.join(have, (F.col("source") == F.col("s9")) & (F.col("hub_to") == F.col("h9")), "left_anti")
    scored = free.join(t, F.col("language").eqNullSafe(F.col("lt")) & (F.col("hub_to") == F.col("ht"))).withColumn("similarity", F.round(cosine("vs", "vt"), 6)).drop("vs", "vt")
    way = ["language", "hub_from", "hub_to"]
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*way, "source").orderBy(F.col("similarity").desc(), "target"))).where(F.col("rank") <= 1 + alternatives)
    order = [F.round("similarity", 2).desc(), F.col("rank_percentile").desc_nulls_last(), F.col("outbound"), F.col("source")]
    slots = best.where("rank = 1").withColumn("slot", F.row_number().over(Window.partitionBy(*way).orderBy(*order))).where("slot <= slots")
    slots = slots.select(*[F.col(c).alias(f"_{c}") for c in way], F.col("source").alias("_source"), "slot")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*way, "source"]]
    return best.join(slots, same).select(*way, "slot", "rank", "source", "target", "similarity", "reasons")


def components(pages: DataFrame, pairs: DataFrame, bridges: DataFrame | None = None) -> DataFrame:
    """(language, hub, component): hubs joined where a pair meets the floor both ways, proposed links counted as made."""
    from linkloom.operators.components import connected_components

    ways = directions(pairs.withColumn("reasons", F.array(F.lit("all"))))
    if bridges is not None:
        made = bridges.where("rank = 1").groupBy("language", "hub_from", "hub_to").agg(F.count("*").alias("made")).select(F.col("language").alias("l9"), F.col("hub_from").alias("f9"), F.col("hub_to").alias("t9"), "made")
        ways = ways.join(made, F.col("language").eqNullSafe(F.col("l9")) & (F.col("hub_from") == F.col("f9")) & (F.col("hub_to") == F.col("t9")), "left")
        ways = ways.withColumn("slots", F.col("slots") - F.coalesce("made", F.lit(0)))
    met = ways.groupBy("language", F.least("hub_from", "hub_to").alias("a"), F.greatest("hub_from", "hub_to").alias("b")).agg(F.max("slots").alias("lack")).where("lack <= 0")
    hubs = _members(pages).select("language", "hub").distinct()
    node = lambda hub: F.xxhash64("language", hub)
    found = connected_components(met.select(node("a").alias("u"), node("b").alias("v")))
    return hubs.join(found, node("hub") == F.col("node"), "left").select("language", "hub", F.coalesce("component", node("hub")).alias("component"))
