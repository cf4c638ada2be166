"""Search metrics, scores, ranks and evaluation measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators.percentiles import places, value_counts
from linkloom.plans.scratch import materialize


def rounded_position(position: Column, most: int = 100) -> Column:
    """Half up, clipped at ``most``; null below 1."""
    return F.when(position >= 1, F.floor(F.least(position, F.lit(float(most))) + 0.5).cast("int"))


def observed_ctr(rows: DataFrame) -> DataFrame:
    """at, impressions, clicks, ctr per rounded position: totals weigh, not the means of rows."""
    put = rows.withColumn("at", rounded_position(F.col("position")))
    summed = put.groupBy("at").agg(F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"))
    return summed.withColumn("ctr", F.round(F.col("clicks") / F.col("impressions"), 6))


#: Rows and impressions below which a curve is not fitted.
CURVE_ROWS, CURVE_IMPRESSIONS = 100, 10_000


def fitted_curve(rows: DataFrame) -> list[float] | None:
    """The click curve of search rows (impressions, clicks, position); none where the rows are too few to tell. 100 sums reach the driver."""
    n = rows.where("position >= 1").agg(F.count("*").alias("n"), F.sum("impressions").alias("i")).first()
    if n["n"] < CURVE_ROWS or (n["i"] or 0) < CURVE_IMPRESSIONS:
        return None
    return monotone_curve([(r["at"], r["impressions"], r["clicks"]) for r in observed_ctr(rows).collect()])


def monotone_curve(observed: list[tuple[int, int, int]], size: int = 100) -> list[float]:
    """A non-increasing click curve over positions 1 to ``size``, from (position, impressions, clicks); null positions are left out.

    Clicks count up to the impressions. Neighbours that rise are pooled by their totals until none does; a position
    without data takes the one before it, leading ones the first. At most ``size`` rows exist, so this runs on the driver.
    """
    pools: list[list[float]] = []
    for at, shown, clicked in sorted(x for x in observed if x[0] is not None and x[1]):
        pools.append([min(clicked, shown), shown, 1, at])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] < pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1][0] += last[0]
            pools[-1][1] += last[1]
            pools[-1][2] += 1
    starts = {int(p[3]): (p[0] / p[1] if p[1] else 0.0) for p in pools}
    curve, now = [], starts[min(starts)] if starts else 0.0
    for at in range(1, size + 1):
        now = starts.get(at, now)
        curve.append(now)
    return curve


def opportunity(impressions: Column, position: Column, curve: Column) -> Column:
    """Clicks a page would gain at position 1: max(0, impressions * (first - here))."""
    here = F.element_at(curve, F.least(rounded_position(position), F.size(curve)))
    return F.greatest(F.lit(0.0), impressions * (F.element_at(curve, 1) - here))


#: The hand-set weights of the baseline scorer as (column, weight, lower is better, by percentile), and its tier shares.
WEIGHTS = (
    ("content_cosine", 0.15, False, True), ("same_hub", 0.05, False, False), ("content_agreement_same_topic_other_links", 0.05, False, False),
    ("pair_query_overlap", 0.05, False, False), ("pair_kw_overlap", 0.05, False, False), ("target_is_orphan", 0.1, False, False),
    ("target_saturation_ratio", 0.1, True, True), ("target_impressions_log", 0.05, False, True), ("target_ctr_gap", 0.05, True, True),
    ("target_keyword_gap", 0.05, False, True), ("source_link_equity_share", 0.1, False, False), ("source_page_rank_percentile", 0.1, False, False),
    ("target_hub_coverage", 0.05, True, False), ("target_is_hub_pillar", 0.05, False, False),
)
TIER_SHARES = (0.1, 0.3)
_PARTS = "array<struct<less:double,i:int,feature:string,value:double>>"


def normalised(rows: DataFrame, weights: tuple[tuple[str, float, bool, bool], ...]) -> DataFrame:
    """``rows`` with ``_v0, _v1, ...``: every weighted column in [0, 1], higher better; null and NaN are null.

    Percentiles run over all rows. The values of all columns are counted in one range sort.
    """
    ranked = [(i, c) for i, (c, _, _, by_rank) in enumerate(weights) if by_rank]
    if ranked:
        pieces = F.explode(F.array(*[F.struct(F.lit(i).alias("_f"), F.col(c).cast("double").alias("_x")) for i, c in ranked])).alias("z")
        counts = materialize(value_counts(rows.select(pieces).select("z._f", "z._x"), "_x", ["_f"]), "feature-counts")
    for i, (column, _, lower, by_rank) in enumerate(weights):
        x = F.col(column).cast("double")
        if by_rank:
            place = F.when(F.col("n") < 2, 0.5).otherwise((F.col("below") + (F.col("ties") - 1) / 2) / (F.col("n") - 1))
            own = counts.where(F.col("_f") == i).select(F.col("_x").alias("_w"), (1 - place if lower else place).alias(f"_v{i}"))
            rows = rows.join(own, x == F.col("_w"), "left").drop("_w")
        else:
            value = F.when(x.isNotNull() & ~F.isnan(x), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))
            rows = rows.withColumn(f"_v{i}", 1 - value if lower else value)
    return rows


def weighted_score(rows: DataFrame, keys: list[str], weights: tuple[tuple[str, float, bool, bool], ...] = WEIGHTS, shares: tuple[float, float] = TIER_SHARES, top: int = 3) -> DataFrame:
    """``keys`` with raw_score, score, tier and ``top`` contributions (feature, contribution, value) of every pair.

    The raw score is the weighted mean over the features that a pair has; the score is its place between the least and
    the greatest raw score, 0 to 100, and 50 where all are equal. A pair without any feature scores 0 in tier 3.
    """
    given = F.array(*[F.lit(float(w)) for _, w, _, _ in weights])
    added = lambda x: F.aggregate(x, F.lit(0.0), lambda acc, y: acc + F.coalesce(y, F.lit(0.0)))
    # Values are one array: as columns, their sums and the joins before make one generated method that the JVM does not compile.
    values = F.array(*[F.col(f"_v{i}") for i in range(len(weights))]).alias("_v")
    found = normalised(rows, weights).select(*keys, *([c for c, *_ in weights] if top else []), values)
    found = found.withColumn("_total", added(F.zip_with("_v", given, lambda v, w: F.when(v.isNotNull(), w))))
    raw = F.when(F.col("_total") > 0, F.round(added(F.zip_with("_v", given, lambda v, w: v * w / F.col("_total"))), 9))  # sums in any order rank alike
    named = [
        F.struct((-F.get("_v", F.lit(i)) * w / F.col("_total")).alias("less"), F.lit(i).alias("i"), F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
        for i, (c, w, _, _) in enumerate(weights)
    ]
    held = F.filter(F.array(*named), lambda x: x["less"].isNotNull())
    listed = [F.when(F.col("_total") > 0, F.sort_array(held)).otherwise(F.array().cast(_PARTS)).alias("_parts")] if top else []
    found = materialize(found.select(*keys, *listed, raw.alias("raw_score")), "raw-scores")
    low, high = found.agg(F.min("raw_score")).scalar(), found.agg(F.max("raw_score")).scalar()
    score = F.when(F.col("raw_score").isNull(), 0.0).when(high == low, 50.0).otherwise((F.col("raw_score") - low) / (high - low) * 100)
    best = []
    for i in range(top):
        part = F.get("_parts", F.lit(i))
        best += [part["feature"].alias(f"top{i + 1}_feature"), (-part["less"]).alias(f"top{i + 1}_contribution"), part["value"].alias(f"top{i + 1}_value")]
    scored = found.select(*keys, "raw_score", score.alias("score"), *best)
    return tiers(scored, "raw_score", keys, shares).drop("place")


def tiers(rows: DataFrame, score: str, order: list[str], shares: tuple[float, float] = TIER_SHARES) -> DataFrame:
    """``rows`` with place and tier: the first ``floor(share * n + 0.5)`` are tier 1, then tier 2 by the sum of the shares, then 3.

    Ties go by ``order``; rows without a score come last and are tier 3.
    """
    total = rows.agg(F.count("*")).scalar()
    placed = places(rows, [F.col(score).desc_nulls_last(), *[F.col(c).asc() for c in order]])
    cut = lambda share: F.floor(F.lit(share) * total + 0.5)
    tier = F.when(F.col(score).isNull(), 3).when(F.col("place") <= cut(shares[0]), 1).when(F.col("place") <= cut(sum(shares)), 2).otherwise(3)
    return placed.withColumn("tier", tier)


def auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve by ranks (Mann-Whitney); ties count half. Ranks come from counts per distinct score."""
    known = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(F.col(score).alias("_s"), F.col(label).alias("_l"))
    both = known.groupBy("_s").agg(F.sum((F.col("_l") == 1).cast("long")).alias("p"), F.sum((F.col("_l") == 0).cast("long")).alias("q"))
    return _won(both).agg(F.sum("p").alias("positives"), F.sum("q").alias("negatives"), F.round(F.sum("w") / (F.sum("p") * F.sum("q")), 6).alias("auc"))


def _won(per: DataFrame) -> DataFrame:
    """p, q, w per distinct score: w is what its positives win against the negatives below and beside them."""
    tasks = int(per.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = materialize(per.repartitionByRange(tasks, "_s").withColumn("_p", F.spark_partition_id()), "auc-counts")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = parts.groupBy("_p").agg(F.sum("q").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_p").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    seen = parts.join(starts, "_p").withColumn("_below", F.col("_start") + F.coalesce(F.sum("q").over(inside), F.lit(0)))
    return seen.select("p", "q", (F.col("p") * (F.col("_below") + F.col("q") / 2)).alias("w"))


def ranking_measures(rows: DataFrame, group: str, score: str, label: str, tie: str, k: int = 10) -> DataFrame:
    """Per group: ndcg, precision and recall at k; gain 2**label - 1; hits over k, not over the rows there are. Null and NaN scores come last."""
    by = Window.partitionBy(group)
    sound = F.when(~F.isnan(F.col(score).cast("double")), F.col(score))
    ranked = rows.withColumn("_r", F.row_number().over(by.orderBy(sound.desc_nulls_last(), tie)))
    ranked = ranked.withColumn("_i", F.row_number().over(by.orderBy(F.col(label).desc(), tie)))
    gain = lambda at: F.sum(F.when(F.col(at) <= k, (F.pow(F.lit(2.0), F.col(label)) - 1) / F.log2(F.col(at) + 1)).otherwise(0.0))
    hits = F.sum(F.when((F.col("_r") <= k) & (F.col(label) > 0), 1).otherwise(0))
    all_ = F.sum((F.col(label) > 0).cast("int"))
    return ranked.groupBy(group).agg(
        F.round(F.when(gain("_i") > 0, gain("_r") / gain("_i")).otherwise(0.0), 6).alias("ndcg"),
        F.round(hits / k, 6).alias("precision"),
        F.round(F.when(all_ > 0, hits / all_).otherwise(0.0), 6).alias("recall"),
    )


def gini(rows: DataFrame, value: str) -> DataFrame:
    """Gini coefficient of a non-negative column, from counts per distinct value."""
    per = value_counts(rows, value, [])
    parts = per.withColumn("rank_sum", F.col("ties") * F.col("below") + F.col("ties") * (F.col("ties") + 1) / 2)
    n, total = F.sum("ties"), F.sum(F.col("ties") * F.col(value))
    return parts.agg(F.round(F.when(total > 0, 2 * F.sum(F.col("rank_sum") * F.col(value)) / (n * total) - (n + 1) / n).otherwise(0.0), 6).alias("gini"))


def blend(parts: list[tuple[float, Column]]) -> Column:
    """Weighted mean over the parts that are not null; null where none is."""
    top = sum((w * F.coalesce(c, F.lit(0.0)) for w, c in parts), F.lit(0.0))
    low = sum((w * c.isNotNull().cast("double") for w, c in parts), F.lit(0.0))
    return F.when(low > 0, top / low)
