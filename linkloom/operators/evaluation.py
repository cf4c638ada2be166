"""How well features, rankings and recommendations hold up: AUC per feature, recall, bootstrap intervals, agreement, score modes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators.percentiles import quantiles, value_counts
from linkloom.plans.scratch import materialize


def feature_auc(rows: DataFrame, names: list[str], label: str) -> DataFrame:
    """column, auc (over rows with a value; null if those hold one value or one class), coverage, ranker_auc.

    The last is the AUC of all rows in the feature's best order: either direction, rows without a value first or last. All
    features are counted in one range sort of distinct values; no list of a feature's values is gathered.
    """
    long = rows.select(F.col(label).cast("int").alias("y"), F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.col(n).cast("double").alias("x")) for n in names])).alias("z")).select("y", "z.*")
    long = long.withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    whole = long.groupBy("column").agg(
        F.count("*").alias("n"), F.sum("y").alias("p_all"), F.count("x").alias("known"), F.sum(F.when(F.col("x").isNotNull(), F.col("y"))).alias("p"), F.count_distinct("x").alias("values")
    )
    known = long.where("x is not null")
    counts = materialize(value_counts(known, "x", ["column"]), "auc-ranks")
    per = known.groupBy("column", "x").agg(F.sum("y").alias("p_here"))
    ranks = per.join(counts, ["column", "x"]).groupBy("column").agg(F.sum(F.col("p_here") * (F.col("below") + (F.col("ties") + 1) / 2)).alias("rank_sum"))
    joined = whole.join(ranks, "column", "left").withColumn("rank_sum", F.coalesce("rank_sum", F.lit(0.0))).fillna({"p": 0, "p_all": 0})
    n_known, p_known, miss = F.col("known"), F.col("p"), F.col("n") - F.col("known")
    p_miss = F.col("p_all") - p_known
    auc = lambda total, p, n: F.when((p > 0) & (n - p > 0), (total - p * (p + 1) / 2) / (p * (n - p)))
    # Rows without a value share one rank before all others; the descending order mirrors the known ones.
    up = F.col("rank_sum") + p_known * miss + p_miss * (miss + 1) / 2
    down = p_known * (n_known + 1) - F.col("rank_sum") + p_known * miss + p_miss * (miss + 1) / 2
    best = F.greatest(F.abs(auc(up, F.col("p_all"), F.col("n")) - 0.5), F.abs(auc(down, F.col("p_all"), F.col("n")) - 0.5))
    return joined.select("column", F.when(F.col("values") > 1, auc(F.col("rank_sum"), p_known, n_known)).alias("auc"), (n_known / F.col("n")).alias("coverage"), (0.5 + F.coalesce(best, F.lit(0.0))).alias("ranker_auc"))


def recall_at(rows: DataFrame, rank: str, k: int) -> Column:
    """Share of rows whose rank is ``k`` or less; null ranks were not found. To stand in an aggregation."""
    return F.avg(F.coalesce((F.col(rank) <= k).cast("double"), F.lit(0.0)))


def random_recall(eligible: str, k: int) -> Column:
    """The share a random order would reach: ``k`` over the eligible ones, one at most."""
    return F.avg(F.least(k / F.col(eligible), F.lit(1.0)))


def relevance_groups(rows: DataFrame, group: str, value: str) -> DataFrame:
    """group, keywords, mean, p50."""
    mean = rows.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("keywords"), F.avg(value).alias("mean"))
    middle = quantiles(rows, value, (0.5,), [group]).select(F.col(group).alias("_g"), F.col("q0").alias("p50"))
    return mean.join(middle, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


#: Chances that a Poisson number of mean 1 is no greater than 0, 1, 2, ...
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(19)])


def _weights(hashes: np.ndarray, samples: np.ndarray) -> np.ndarray:
    """How often each cluster is drawn in each sample: Poisson numbers that follow from the cluster's hash and the sample alone."""
    x = hashes.astype(np.uint64)[:, None] + (samples.astype(np.uint64)[None, :] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return np.searchsorted(_POISSON, ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53, side="right").astype(float)


def bootstrap_interval(rows: DataFrame, value: str, cluster: str, seed: int, samples: int = 1000, level: float = 0.95) -> tuple[float, float]:
    """Percentile interval of the mean when whole clusters are drawn again with all their values; the same seed gives the same one.

    A Poisson bootstrap: every cluster comes as often into a sample as a Poisson number of mean 1 says, so clusters need not
    meet. Tasks add up their clusters; two sums a sample reach the driver.
    """
    per = rows.where(F.col(value).isNotNull()).groupBy(F.col(cluster).alias("c")).agg(F.sum(value).cast("double").alias("s"), F.count("*").cast("double").alias("n"))
    hashed = per.select(F.xxhash64("c", F.lit(seed)).alias("h"), "s", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, total = np.arange(samples), np.zeros((samples, 2))
        for batch in batches:
            h, both = batch.column("h").to_numpy(), np.stack([batch.column("s").to_numpy(), batch.column("n").to_numpy()], axis=1)
            step = max(1, 2_000_000 // samples)
            for start in range(0, len(h), step):
                total += _weights(h[start : start + step], every).T @ both[start : start + step]
        yield pa.RecordBatch.from_arrays([pa.array(every), pa.array(total[:, 0]), pa.array(total[:, 1])], names=["sample", "s", "n"])

    found = hashed.mapInArrow(run, "sample bigint, s double, n double").groupBy("sample").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).where("n > 0").toPandas()
    if not len(found):
        raise ValueError("no values")
    low, high = np.quantile(found["s"] / found["n"], [(1 - level) / 2, (1 + level) / 2])
    return float(low), float(high)


def promotes(rows: DataFrame, new: str, old: str, cluster: str, seed: int) -> bool:
    """Whether the paired gain of ``new`` over ``old`` is above 0 with its whole interval."""
    return bootstrap_interval(rows.withColumn("_gain", F.col(new) - F.col(old)), "_gain", cluster, seed)[0] > 0


def agreement(first: DataFrame, second: DataFrame) -> DataFrame:
    """vertices, ari: adjusted Rand index of two labellings (vertex, label) over the vertices both have; null below two.

    From the contingency table: sums of pairs per cell, row and column, all pre-aggregated.
    """
    both = first.select("vertex", F.col("label").alias("a")).join(second.select("vertex", F.col("label").alias("b")), "vertex")
    cells = materialize(both.groupBy("a", "b").agg(F.count("*").alias("n")), "contingency")
    pairs = lambda n: F.col(n) * (F.col(n) - 1) / 2
    side = lambda c: cells.groupBy(c).agg(F.sum("n").alias("m")).agg(F.coalesce(F.sum(pairs("m")), F.lit(0.0))).scalar()
    one = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("vertices"), F.coalesce(F.sum(pairs("n")), F.lit(0.0)).alias("both"))
    one = one.select("vertices", "both", side("a").alias("x"), side("b").alias("y"))
    every = F.col("vertices") * (F.col("vertices") - 1) / 2
    expected = F.col("x") * F.col("y") / every
    top = (F.col("x") + F.col("y")) / 2 - expected
    return one.select("vertices", F.when(F.col("vertices") >= 2, F.when(top == 0, 1.0).otherwise((F.col("both") - expected) / top)).alias("ari"))


def product_measures(pairs: DataFrame, score: str, orphans: DataFrame, pillars: DataFrame, k: int) -> DataFrame:
    """One row over the first ``k`` pairs of every source: mean cosine, shares in the hub and to orphans, orphans reached, pillars shown, Gini of the targets.

    ``pairs`` has source, target, content_cosine, same_hub and the score; ``pillars`` has source and its hub's pillar.
    """
    sound = F.when(~F.isnan(F.col(score)), F.col(score))
    top = pairs.withColumn("_r", F.row_number().over(Window.partitionBy("source").orderBy(sound.desc_nulls_last(), "target"))).where(F.col("_r") <= k)
    lost = orphans.select(F.col("page").alias("target"), F.lit(1).alias("orphan"))
    top = materialize(top.join(lost, "target", "left"), "product-top")
    targets = pairs.select("target").distinct().join(lost, "target", "left")
    shown = targets.join(top.groupBy("target").agg(F.count("*").alias("shown")), "target", "left").fillna({"shown": 0, "orphan": 0})
    shown = materialize(shown, "product-targets")
    asked = pillars.join(orphans.select(F.col("page").alias("source")), "source", "left_semi").join(pairs.select("source").distinct(), "source", "left_semi")
    seen = asked.join(top.select("source", F.col("target").alias("pillar")), ["source", "pillar"], "left_semi")
    spread = value_counts(shown, "shown", [])
    total, n = F.sum(F.col("ties") * F.col("shown")), F.sum("ties")
    rank_sum = F.sum((F.col("ties") * F.col("below") + F.col("ties") * (F.col("ties") + 1) / 2) * F.col("shown"))
    gini = spread.agg(F.when(total > 0, 2 * rank_sum / (n * total) - (n + 1) / n).otherwise(0.0)).scalar()
    return top.agg(
        F.count("*").alias("pairs"), F.avg("content_cosine").alias("mean_cosine"), F.avg(F.coalesce(F.col("same_hub").cast("double"), F.lit(0.0))).alias("hub_share"), F.avg(F.coalesce("orphan", F.lit(0))).alias("orphan_share"),
        shown.agg(F.avg("orphan")).scalar().alias("orphan_target_share"), shown.where("orphan = 1").agg(F.avg((F.col("shown") > 0).cast("double"))).scalar().alias("orphans_reached"),
        (seen.agg(F.count("*")).scalar() / F.nullif(asked.agg(F.count("*")).scalar(), F.lit(0))).alias("pillars_shown"), gini.alias("gini"),
    )


#: Scores, and distance of two modes, below which there is no split.
LEAST_SCORES, MODE_GAP = 50, 0.05


def mixture_split(rows: DataFrame, value: str, bins: int = 4096, rounds: int = 500) -> float | None:
    """Where a mixture of two Gaussians turns from its low to its high mode, between the means; none where scores are few or the modes close.

    Expectation maximisation runs over counts in ``bins`` equal bins between the least and the greatest score, each kept
    with the mean of its scores, so a fixed number of rows reaches the driver for any table.
    """
    seen = rows.where(F.col(value).isNotNull()).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count("*").alias("n")).first()
    if seen["n"] < LEAST_SCORES or seen["hi"] - seen["lo"] < MODE_GAP:
        return None
    width = (seen["hi"] - seen["lo"]) / bins
    per = rows.where(F.col(value).isNotNull()).groupBy(F.least(F.floor((F.col(value) - seen["lo"]) / width), F.lit(bins - 1)).alias("b"))
    table = per.agg(F.avg(value).alias("x"), F.count("*").alias("n")).orderBy("b").toPandas()
    x, n = table["x"].to_numpy(float), table["n"].to_numpy(float)
    return _two_modes(x, n, rounds)


def _two_modes(x: np.ndarray, n: np.ndarray, rounds: int) -> float | None:
    total, below = n.sum(), np.cumsum(n)
    cut = x[np.searchsorted(below, total / 2)]  # starts from the two halves, then moves to the nearer centre
    for _ in range(100):
        low = x <= cut
        if low.all() or not low.any():
            return None
        a, b = np.average(x[low], weights=n[low]), np.average(x[~low], weights=n[~low])
        if (a + b) / 2 == cut:
            break
        cut = (a + b) / 2
    weight = np.array([n[low].sum(), n[~low].sum()]) / total
    mean = np.array([a, b])
    var = np.array([np.average((x[p] - m) ** 2, weights=n[p]) for p, m in ((low, a), (~low, b))]) + 1e-6
    for _ in range(rounds):
        logs = np.log(weight)[:, None] - 0.5 * np.log(2 * math.pi * var)[:, None] - (x[None, :] - mean[:, None]) ** 2 / (2 * var[:, None])
        top = logs.max(axis=0)
        share = np.exp(logs - top)
        share /= share.sum(axis=0)
        held = (share * n).sum(axis=1)
        before, mean = mean, (share * n * x).sum(axis=1) / held
        var = (share * n * (x[None, :] - mean[:, None]) ** 2).sum(axis=1) / held + 1e-6
        weight = held / total
        if np.abs(mean - before).max() < 1e-9:
            break
    lo, hi = int(np.argmin(mean)), int(np.argmax(mean))
    if mean[hi] - mean[lo] < MODE_GAP:
        return None

    def high(v: float) -> bool:
        logs = np.log(weight) - 0.5 * np.log(var) - (v - mean) ** 2 / (2 * var)
        return bool(logs[hi] >= logs[lo])

    a, b = float(mean[lo]), float(mean[hi])
    if high(a) or not high(b):
        return None
    for _ in range(60):
        mid = (a + b) / 2
        a, b = (a, mid) if high(mid) else (mid, b)
    return b


def score_distribution(rows: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """One row: count, mean, p10 to p90, split and low_share of scores in [0, 1]; and a histogram as an array of counts."""
    known = rows.where(F.col(value).isNotNull())
    split = mixture_split(known, value)
    shares = quantiles(known, value, (0.1, 0.25, 0.5, 0.75, 0.9)).select(*[F.col(f"q{i}").alias(p) for i, p in enumerate(("p10", "p25", "p50", "p75", "p90"))])
    inside = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1))
    counted = known.agg(
        F.count("*").alias("count"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.avg(value))).alias("mean"), F.array(*[F.count_if(inside == i) for i in range(bins)]).alias("histogram"),
        F.lit(split).cast("double").alias("split"), (F.avg((F.col(value) < split).cast("double")) if split is not None else F.lit(None).cast("double")).alias("low_share"),
    )
    return counted.crossJoin(shares)  # one row each
