"""Percentiles, the baseline scorer and evaluation measures against the survey's fixed facts and plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from linkloom.operators import percentiles, scoring


def column(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "i int, v double").repartition(3)


def listed(df, name):
    return [r[name] for r in df.orderBy("i").collect()]


def test_share_below(spark):
    assert listed(percentiles.share_below(column(spark, [3.0, 1.0, 3.0, 0.0]), "v"), "percentile") == [0.5, 0.25, 0.5, 0.0]
    assert listed(percentiles.share_below(column(spark, [1.0, 1.0 + 1e-12, 1.0 + 1e-6]), "v"), "percentile") == [0.0, 0.0, pytest.approx(2 / 3)]
    assert listed(percentiles.share_below(column(spark, [7.0]), "v"), "percentile") == [0.0]
    assert listed(percentiles.share_below(column(spark, [0.0, 0.0]), "v"), "percentile") == [0.0, 0.0]


def test_average_rank(spark):
    assert listed(percentiles.average_rank(column(spark, [10.0, 20.0, 20.0, 40.0, 5.0]), "v", []), "percentile") == [0.25, 0.625, 0.625, 1.0, 0.0]
    assert listed(percentiles.average_rank(column(spark, [None, 4.0, math.nan]), "v", []), "percentile") == [None, 0.5, None]
    assert percentiles.average_rank(column(spark, []), "v", []).count() == 0


def test_quantiles(spark):
    rng = random.Random(5)
    values = [float(rng.randrange(30)) for _ in range(101)]
    got = percentiles.quantiles(column(spark, [*values, None]), "v", (0.1, 0.25, 0.5)).first()
    ordered = sorted(values)
    assert [got["q0"], got["q1"], got["q2"]] == [ordered[10], ordered[25], ordered[50]]
    assert percentiles.quantiles(column(spark, [1.0, 2.0]), "v", (0.25,)).first()["q0"] == 1.25


WEIGHTS = (("a", 0.5, False, False), ("b", 0.3, True, False), ("c", 0.2, False, True))


def test_weights_rescale_over_what_a_pair_has(spark):
    rows = spark.createDataFrame([(1, 1, 1.0, 0.25, 5.0), (1, 2, 0.5, None, 7.0), (2, 1, 9.0, math.nan, None), (2, 2, None, None, None)], "source long, target long, a double, b double, c double")
    got = {(r["source"], r["target"]): r for r in scoring.weighted_score(rows, ["source", "target"], WEIGHTS).collect()}
    raw = {(1, 1): 0.5 + 0.3 * 0.75, (1, 2): (0.25 + 0.2) / 0.7, (2, 1): 1.0}
    for key, want in raw.items():
        assert got[key]["raw_score"] == pytest.approx(want, abs=1e-9)
    low, high = min(raw.values()), max(raw.values())
    assert got[1, 1]["score"] == pytest.approx((raw[1, 1] - low) / (high - low) * 100) and got[2, 1]["score"] == 100
    assert got[2, 2]["raw_score"] is None and got[2, 2]["score"] == 0 and got[2, 2]["tier"] == 3
    assert (got[1, 2]["top1_feature"], got[1, 2]["top2_feature"], got[1, 2]["top3_feature"]) == ("a", "c", None) and got[1, 2]["top1_value"] == 0.5


def test_flat_scores_and_tiers(spark):
    flat = spark.createDataFrame([(i, j, 0.5, 0.5, None) for i in range(4) for j in range(5)], "source long, target long, a double, b double, c double")
    got = scoring.weighted_score(flat, ["source", "target"], WEIGHTS).collect()
    assert {r["score"] for r in got} == {50.0}
    assert [r["tier"] for r in sorted(got, key=lambda r: (r["source"], r["target"]))] == [1] * 2 + [2] * 6 + [3] * 12
    fourteen = spark.createDataFrame([(i, float(-i)) for i in range(14)], "t long, s double")
    assert [scoring.tiers(fourteen, "s", ["t"]).where(F.col("tier") == k).count() for k in (1, 2, 3)] == [1, 5, 8]


def test_ndcg(spark):
    nan = math.nan
    rows = [("x", 0, 1, 1.0), ("x", 1, 3, 0.0), ("n", 0, 1, nan), ("n", 1, 0, 0.1), ("t", 0, 0, 1.0), ("t", 1, 1, 1.0), ("z", 0, 0, 1.0)]
    got = {r["g"]: r for r in scoring.ranking_measures(spark.createDataFrame(rows, "g string, i int, label int, score double"), "g", "score", "label", "i", 1).collect()}
    assert got["n"]["ndcg"] == 0.0 and got["t"]["ndcg"] == 0.0 and got["z"]["ndcg"] == 0.0 and got["x"]["precision"] == 1.0
    both = {r["g"]: r for r in scoring.ranking_measures(spark.createDataFrame(rows, "g string, i int, label int, score double"), "g", "score", "label", "i", 2).collect()}
    assert both["x"]["ndcg"] == pytest.approx((1 + 7 / math.log2(3)) / (7 + 1 / math.log2(3)), abs=1e-6)


def test_auc_and_gini(spark):
    rng = random.Random(2)
    rows = [(float(rng.randrange(8)), int(rng.random() < 0.4)) for _ in range(200)]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg))
    assert scoring.auc(spark.createDataFrame(rows, "s double, y int").repartition(5), "s", "y").first()["auc"] == pytest.approx(want, abs=1e-6)
    values = [float(rng.randrange(20)) for _ in range(60)]
    mean = sum(abs(a - b) for a in values for b in values) / (2 * len(values) ** 2 * (sum(values) / len(values)))
    assert scoring.gini(column(spark, values), "v").first()["gini"] == pytest.approx(mean, abs=1e-6)


def test_click_curve(spark):
    curve = scoring.monotone_curve([(None, 5, 5), (2, 1000, 100), (3, 3000, 900), (5, 100, 500), (1, 1000, 300)])
    assert curve[0] == pytest.approx(0.3) or curve[0] > 0.3
    assert all(a >= b for a, b in zip(curve, curve[1:], strict=False)) and len(curve) == 100
    plain = scoring.monotone_curve([(3, 100, 10), (5, 100, 5)])
    assert plain[:6] == [0.1, 0.1, 0.1, 0.1, 0.05, 0.05]
    rows = lambda n, shown: spark.createDataFrame([(shown, 1, 1.0 + i % 9) for i in range(n)], "impressions long, clicks long, position double")
    assert scoring.fitted_curve(rows(99, 1000)) is None and scoring.fitted_curve(rows(100, 99)) is None and scoring.fitted_curve(rows(100, 100)) is not None
    assert scoring.fitted_curve(rows(100, 100).withColumn("position", F.lit(None).cast("double"))) is None
