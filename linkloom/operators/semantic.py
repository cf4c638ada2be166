"""The semantic rung: phrases that mean a target's keyword without sharing its words, over given vectors.

Phrases have source, target, phrase_id, phrase, sentence, start and vector; keywords target, keyword, rank, language and vector;
vectors come from outside. A phrase meets the keywords of its own target by a join; against the keywords of other targets,
only the best cosine counts, found per block of phrases and keywords of one language as in retrieval.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions import words as W
from linkloom.functions.vector import cosine
from linkloom.operators.percentiles import quantiles

#: Quantile of unrelated cosines, its bounds, the least of them, the value without enough; how close a rival may come.
QUANTILE, BOUNDS, LEAST, DEFAULT, TIE = 0.99, (0.35, 0.9), 300, 0.6, 1e-9
#: Metrics watched by an absolute band; others by a relative one.
ABSOLUTE = dict.fromkeys(
    "score_auc best_feature_auc score_auc_lift score_auc_excl_link_counts best_feature_auc_excl_link_counts score_auc_lift_excl_link_counts keyword_relevance_rank_1_mean context_relevance_mean anchor_target_fit_mean".split(),
    0.05,
) | {"not_applicable_checks": 0.5}
RELATIVE = 0.2


def threshold(negatives: DataFrame, positives: DataFrame, value: str = "cosine", override: float | None = None) -> DataFrame:
    """One row: value, negatives, positives, recall, basis. The 0.99 quantile of unrelated cosines within bounds; a default below 300."""
    seen = quantiles(negatives, value, (QUANTILE,)).select("n", "q0")
    n, q = F.coalesce("n", F.lit(0)), F.col("q0")
    low, high = BOUNDS
    cut = F.lit(override) if override is not None else F.when(n < LEAST, DEFAULT).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), q)))
    basis = F.lit("override") if override is not None else F.when(n < LEAST, "default").when((q < low) | (q > high), "bounded").otherwise("quantile")
    one = seen.select(cut.alias("value"), n.alias("negatives"), basis.alias("basis"))
    hits = positives.where(F.col(value).isNotNull()).crossJoin(one.select(F.col("value").alias("_cut")))  # one row on the right
    counted = hits.agg(F.count("*").alias("positives"), F.avg((F.col(value) >= F.col("_cut")).cast("double")).alias("recall"))
    return one.crossJoin(counted)


def unrelated(hub_a: Column, hub_b: Column, topic_a: Column, topic_b: Column) -> Column:
    """Whether two pages are of different topics: by hubs where both are in one, else by content communities, else not known to be."""
    known = hub_a.isNotNull() & hub_b.isNotNull() & (hub_a >= 0) & (hub_b >= 0)
    return F.when(known, hub_a != hub_b).when(topic_a.isNotNull() & topic_b.isNotNull(), topic_a != topic_b).otherwise(False)


def top_sentences(sentences: DataFrame, keywords: DataFrame, most: int = 3) -> DataFrame:
    """(source, target, sentence): a page's sentences nearest any keyword of a target; the earlier wins. ``sentences`` has source, target, sentence, vector."""
    pairs = sentences.withColumnRenamed("vector", "sv").join(keywords.select("target", F.col("vector").alias("kv")), "target")
    best = pairs.groupBy("source", "target", "sentence").agg(F.max(cosine("sv", "kv")).alias("c"))
    return best.withColumn("r", F.row_number().over(Window.partitionBy("source", "target").orderBy(F.col("c").desc(), "sentence"))).where(F.col("r") <= most).select("source", "target", "sentence")


def _rivals(pdf: pd.DataFrame) -> pd.DataFrame:
    """Best cosine of every phrase of a block to a keyword of the block that belongs to another target."""
    left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
    if not len(left) or not len(right):
        return pd.DataFrame({"phrase_id": [], "target": [], "rival": []}).astype({"phrase_id": "int64", "target": "int64", "rival": "float64"})
    a, b = (np.stack(x["vector"]).astype(float) for x in (left, right))
    a, b = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) for x in (a, b))
    cos = a @ b.T
    cos[left["target"].to_numpy()[:, None] == right["target"].to_numpy()[None, :]] = -np.inf
    return pd.DataFrame({"phrase_id": left["phrase_id"].to_numpy(), "target": left["target"].to_numpy(), "rival": cos.max(axis=1)})


def rival_cosines(phrases: DataFrame, keywords: DataFrame, block: int = 1024) -> DataFrame:
    """(phrase_id, target, rival): the best cosine to a keyword of another target of the language."""
    count = keywords.groupBy("language").agg(F.ceil(F.count("*") / block).cast("int").alias("kb"))
    size = phrases.groupBy("language").agg(F.ceil(F.count("*") / block).cast("int").alias("pb")).withColumnRenamed("language", "l9")
    blocks = count.join(size, F.col("language").eqNullSafe(F.col("l9"))).drop("l9")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    deal = lambda rows, key: rows.withColumnRenamed("language", "l8").join(blocks, F.col("language").eqNullSafe(F.col("l8"))).drop("l8").withColumn("own", F.pmod(F.xxhash64(*key), F.lit(1 << 30)))
    p = deal(phrases, ["phrase_id", "target"]).select("language", F.pmod("own", F.col("pb")).cast("int").alias("i"), F.explode(every("kb")).alias("j"), "phrase_id", "target", "vector", F.lit(0).alias("side"))
    k = deal(keywords, ["target", "keyword"]).select("language", F.explode(every("pb")).alias("i"), F.pmod("own", F.col("kb")).cast("int").alias("j"), F.lit(-1).cast("long").alias("phrase_id"), "target", "vector", F.lit(1).alias("side"))
    found = p.unionByName(k).groupBy("language", "i", "j").applyInPandas(_rivals, "phrase_id bigint, target bigint, rival double")
    return found.groupBy("phrase_id", "target").agg(F.max("rival").alias("rival"))


def matches(phrases: DataFrame, keywords: DataFrame, cut: float, brand: frozenset[str] = frozenset()) -> DataFrame:
    """(source, target, phrase, keyword, keyword_rank, similarity, refused): the best phrase of every pair at ``cut`` or above, or why all were refused.

    The phrase has to hold just the keyword's identifiers, and no other target's keyword may be nearer to it than its own.
    """

    def agree(phrase: pd.Series, keyword: pd.Series, language: pd.Series) -> pd.Series:
        def named(text: str, code: str | None) -> frozenset[str]:
            found = W.words(text)
            return W.identifiers([w.folded for w in found], W.gaps(text, found), code, brand)

        return pd.Series([named(p, x) == named(k, x) for p, k, x in zip(phrase, keyword, language, strict=True)], dtype=bool)

    own = keywords.select("target", "keyword", F.col("rank").alias("keyword_rank"), F.col("language").alias("kl"), F.col("vector").alias("kv"))
    pairs = phrases.join(own, "target").withColumn("similarity", cosine("vector", "kv")).drop("kv", "vector")
    pairs = pairs.withColumn("own_best", F.max("similarity").over(Window.partitionBy("phrase_id", "target"))).where(F.col("similarity") >= cut)
    pairs = pairs.withColumn("agrees", F.pandas_udf(agree, "boolean")("phrase", "keyword", "kl")).join(rival_cosines(phrases, keywords), ["phrase_id", "target"], "left")
    fine = F.col("agrees") & (F.coalesce("rival", F.lit(-2.0)) <= F.col("own_best") + TIE)
    order = F.struct((~fine).alias("x"), (-F.col("similarity")).alias("s"), "keyword_rank", "sentence", "start", "phrase", "keyword")
    best = pairs.groupBy("source", "target").agg(F.min(order).alias("b"), F.max("agrees").alias("some"))
    refused = F.when(~F.col("b.x"), None).when(F.col("some"), "other_target").otherwise("identifier")
    shown = lambda c: F.when(~F.col("b.x"), c)
    return best.select(
        "source", "target", shown(F.col("b.phrase")).alias("phrase"), shown(F.col("b.keyword")).alias("keyword"), shown(F.col("b.keyword_rank")).alias("keyword_rank"), shown(-F.col("b.s")).alias("similarity"), refused.alias("refused")
    )


def drift_alerts(current: DataFrame, previous: DataFrame, names: list[str] | None = None, band: float = RELATIVE) -> DataFrame:
    """(metric, previous, current, change) of metrics that moved beyond their band: absolute where one is set, else relative to the previous value.

    A metric that either run lacks is skipped; one that leaves 0 under a relative band always alerts, without a change.
    """
    rows = current.select("metric", F.col("value").alias("current")).join(previous.select("metric", F.col("value").alias("previous")), "metric")
    rows = rows.where(F.col("metric").isin(names)) if names else rows
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    wide = F.lit(None).cast("double")
    for name, width in ABSOLUTE.items():
        wide = F.when(F.col("metric") == name, width).otherwise(wide)
    rows = rows.where(finite("current") & finite("previous")).withColumn("_w", wide)
    gap = F.col("current") - F.col("previous")
    change = F.when(F.col("_w").isNotNull(), gap).when(F.col("previous") != 0, gap / F.abs("previous"))
    moved = F.when(F.col("_w").isNotNull(), F.abs(gap) > F.col("_w") + 1e-9).when(F.col("previous") == 0, F.col("current") != 0).otherwise(F.abs(change) > band + 1e-9)
    return rows.where(moved).select("metric", "previous", "current", change.alias("change"))
