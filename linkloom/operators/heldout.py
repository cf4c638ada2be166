"""Held-out rounds: every fold hides some links, and what follows from links is computed again without them, for all folds at once.

A link's fold follows from its hash, so folds never overlap and stay as they are from run to run. Counts are the whole site's less what
a fold hides; PageRank walks all folds as graphs of one loop; nearest sources are searched once, without any link, and a
fold's hidden links, the only pages that it adds to the choice, are merged into them by their own similarities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators import graph, percentiles, retrieval
from linkloom.plans.scratch import materialize

#: The share of links that a fold hides, and the seed of their hashes.
SHARE, SEED = 0.1, 42


def _bound(x: float) -> str:
    """Hex digits of one length compare like the numbers they write."""
    return f"{min(int(x * 2**256), 2**256 - 1):064x}"


def hidden(links: DataFrame, folds: int, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """(fold, source, target): the distinct links that each of the folds from 0 hides.

    Fold 0 takes the link of lowest hash where none falls in its part of the hash range, so it is empty for no links only.
    """
    if not 0 < share < 1 or folds < 1 or folds * share > 1 + 1e-9:
        raise ValueError("a fold hides a share in (0, 1), and all folds together no more than all links")
    h = F.sha2(F.concat_ws("\t", F.lit(str(seed)), F.col("source").cast("string"), F.col("target").cast("string")), 256)
    pairs = links.where("source is not null and target is not null").select("source", "target").distinct().withColumn("h", h)
    lowest = pairs.agg(F.min("h")).scalar()
    fold: Column = F.when((F.col("h") == lowest) & (F.col("h") >= _bound(share)), F.lit(0))
    for i in range(folds):
        fold = fold.when((F.col("h") >= _bound(i * share)) & (F.col("h") < _bound((i + 1) * share)), F.lit(i))
    return pairs.select(fold.alias("fold"), "source", "target").where("fold is not null")


def _folds(rows: DataFrame, folds: int) -> DataFrame:
    return rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))


def counts(links: DataFrame, pages: DataFrame, out: DataFrame, folds: int) -> DataFrame:
    """(fold, page, inbound, outbound) over distinct links between crawled pages that the fold does not hide (``out``)."""
    edges = graph.crawled_edges(links, pages)
    gone = graph.crawled_edges(out.select("source", "target"), pages).join(out, ["source", "target"])
    less = gone.select("fold", F.explode(F.array(F.struct(F.col("source").alias("page"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("target").alias("page"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x"))
    less = less.groupBy("fold", F.col("x.page").alias("page")).agg(F.sum("x.i").alias("i"), F.sum("x.o").alias("o"))
    whole = _folds(graph.structure(edges, pages), folds).join(less, ["fold", "page"], "left")
    return whole.select("fold", "page", (F.col("inbound") - F.coalesce("i", F.lit(0))).alias("inbound"), (F.col("outbound") - F.coalesce("o", F.lit(0))).alias("outbound"))


def visible(links: DataFrame, out: DataFrame, folds: int) -> DataFrame:
    """(fold, source, target): every fold's distinct links; a link meets its own fold only once, as what is left out."""
    pairs = links.select("source", "target").distinct().join(out.withColumnRenamed("fold", "hides"), ["source", "target"], "left")
    return _folds(pairs, folds).where(F.col("hides").isNull() | (F.col("hides") != F.col("fold"))).select("fold", "source", "target")


def views(links: DataFrame, pages: DataFrame, folds: int, share: float = SHARE, seed: int = SEED, steps: int = 100, tolerance: float | None = 1e-10) -> DataFrame:
    """(fold, page, inbound, outbound, is_orphan, rank, rank_percentile, is_pillar) of every page (page, hub, vector) and fold.

    The percentile is the share of the fold's pages strictly below, ties within a billionth of its greatest rank. A hub's pillar
    is the page nearest its centroid, which no link moves, then the one of the fold's higher rank, then the smaller page.
    """
    out = materialize(hidden(links, folds, share, seed), "held-out")
    ranks = graph.pagerank(visible(links, out, folds), _folds(pages.select("page"), folds), steps=steps, tolerance=tolerance, by=("fold",))
    ranks = materialize(ranks.join(pages.select("page"), "page", "left_semi").select("fold", "page", F.round("rank", 9).alias("rank")), "held-out-ranks")
    top = ranks.groupBy("fold").agg(F.max("rank").alias("top"))
    grid = ranks.join(top, "fold").withColumn("grid", F.floor(F.col("rank") / (F.col("top") * percentiles.TIE) + 0.5)).drop("top")
    seen = percentiles.value_counts(grid, "grid", ["fold"]).select("fold", "grid", (F.col("below") / F.col("n")).alias("rank_percentile"))
    placed = grid.join(seen, ["fold", "grid"]).drop("grid")
    near = pages.where("hub >= 0").join(graph.hub_centroids(pages), "hub").select("hub", "page", F.round(graph.dot(graph.unit_vector("vector"), "centroid"), 9).alias("cosine"))
    best = near.join(ranks, "page").groupBy("fold", "hub").agg(F.max(F.struct("cosine", "rank", (-F.col("page")).alias("p"))).alias("b")).select("fold", (-F.col("b.p")).alias("page"), F.lit(True).alias("is_pillar"))
    found = counts(links, pages, out, folds).join(placed, ["fold", "page"]).join(best, ["fold", "page"], "left")
    return found.select("fold", "page", "inbound", "outbound", (F.col("inbound") == 0).alias("is_orphan"), "rank", "rank_percentile", F.coalesce("is_pillar", F.lit(False)).alias("is_pillar"))


def retrieved(links: DataFrame, pages: DataFrame, out: DataFrame, k: int = 10) -> DataFrame:
    """(fold, source, target, similarity, rank): the recoverable hidden links that are among the ``k`` nearest sources of their target.

    A hidden link can be found if both ends are pages (page, language, vector) of one language. ``rank`` counts the pages that
    link to the target nowhere and the fold's other hidden links to it; ties go to the smaller source.
    """
    base = materialize(retrieval.nearest_eligible(pages, links, k), "held-out-candidates").select("target", "source", "similarity")
    mine = retrieval.link_cosines(pages, out).join(out, ["source", "target"]).select("fold", "target", "source", "similarity")
    targets = mine.select("fold", "target").distinct()
    both = base.join(targets, "target").select("fold", "target", "source", "similarity", F.lit(False).alias("own")).unionByName(mine.withColumn("own", F.lit(True)))
    order = Window.partitionBy("fold", "target").orderBy(F.col("similarity").desc(), "source")
    return both.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= k) & F.col("own")).drop("own")


def rounds(links: DataFrame, pages: DataFrame, folds: int, share: float = SHARE, seed: int = SEED, k: int = 10) -> DataFrame:
    """(fold, hidden, recoverable, found): how many links a fold hides, how many of them retrieval could return, and how many it does."""
    out = materialize(hidden(links, folds, share, seed), "held-out")
    able = retrieval.link_cosines(pages, out).join(out, ["source", "target"]).groupBy("fold").agg(F.count("*").alias("recoverable"))
    hits = retrieved(links, pages, out, k).groupBy("fold").agg(F.count("*").alias("found"))
    whole = _folds(links.sparkSession.range(1), folds).select("fold").join(out.groupBy("fold").agg(F.count("*").alias("hidden")), "fold", "left").join(able, "fold", "left").join(hits, "fold", "left")
    return whole.select("fold", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("hidden", "recoverable", "found")])
