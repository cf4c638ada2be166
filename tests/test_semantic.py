"""The semantic rung and the watch over quality metrics."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.operators import semantic


def test_threshold(spark):
    frame = lambda x: spark.createDataFrame([(float(v),) for v in x], "cosine double")
    rng = np.random.default_rng(1)
    many = rng.uniform(-0.5, 0.7, 400)
    one = semantic.threshold(frame(many), frame([0.1, 0.95, 0.8])).first()
    assert one["value"] == pytest.approx(np.quantile(many, 0.99)) and one["basis"] == "quantile" and one["recall"] == pytest.approx(2 / 3)
    assert semantic.threshold(frame(many[:299]), frame([0.6])).first()["value"] == 0.6
    assert semantic.threshold(frame(many / 10), frame([])).first()["value"] == 0.35 and semantic.threshold(frame([]), frame([]), override=0.5).first()["basis"] == "override"


def test_unrelated_pages(spark):
    rows = spark.createDataFrame([(1, 2, 5, 5), (1, 1, 5, 6), (-1, 2, 5, 6), (None, 2, 5, 5), (None, None, None, 5)], "a int, b int, x int, y int")
    got = [r["u"] for r in rows.select(semantic.unrelated(F.col("a"), F.col("b"), F.col("x"), F.col("y")).alias("u")).collect()]
    assert got == [True, False, True, False, False]


def test_matches_and_rivals(spark):
    at = lambda d: [math.cos(math.radians(d)), math.sin(math.radians(d))]
    keywords = spark.createDataFrame([(7, "trail shoes", 1, "en", at(0)), (7, "boots", 2, "en", at(30)), (8, "tents", 1, "en", at(60)), (9, "KB5034441", 1, "en", at(200)), (8, "Zelte", 1, "de", at(5))], "target long, keyword string, rank int, language string, vector array<double>")
    phrases = spark.createDataFrame(
        [(1, 7, 0, "footwear for hills", 3, 40, "en", at(2)), (1, 7, 1, "shelter shoe", 1, 5, "en", at(50)), (2, 7, 2, "camp gear", 0, 0, "en", at(52)), (3, 9, 3, "the security update", 0, 0, "en", at(200)), (4, 7, 4, "far off", 0, 0, "en", at(120))],
        "source long, target long, phrase_id long, phrase string, sentence int, start int, language string, vector array<double>",
    )
    for block in (1024, 2):
        rivals = {r["phrase_id"]: round(r["rival"], 6) for r in semantic.rival_cosines(phrases, keywords, block).collect()}
        assert rivals == {0: round(math.cos(math.radians(58)), 6), 1: round(math.cos(math.radians(10)), 6), 2: round(math.cos(math.radians(8)), 6), 3: round(math.cos(math.radians(140)), 6), 4: round(math.cos(math.radians(60)), 6)}
    got = {r["source"]: r for r in semantic.matches(phrases, keywords, 0.6).collect()}
    assert sorted(got) == [1, 2, 3] and got[1]["phrase"] == "footwear for hills" and got[1]["keyword"] == "trail shoes" and got[1]["similarity"] == pytest.approx(math.cos(math.radians(2)))
    assert got[2]["phrase"] is None and got[2]["refused"] == "other_target" and got[3]["refused"] == "identifier"


def test_sentences_near_a_keyword(spark):
    rows = spark.createDataFrame([(1, 7, i, v) for i, v in enumerate(([1.0, 0.0], [0.0, 1.0], [1.0, 0.0], [0.9, 0.1]))], "source long, target long, sentence int, vector array<double>")
    keywords = spark.createDataFrame([(7, [1.0, 0.0]), (7, [-1.0, 0.0])], "target long, vector array<double>")
    assert sorted(r["sentence"] for r in semantic.top_sentences(rows, keywords, 2).collect()) == [0, 2]


def test_drift(spark):
    frame = lambda x: spark.createDataFrame(list(x.items()), "metric string, value double")
    now = {"score_auc": 0.75, "recall": 0.5, "pairs": 3.0, "calm": 1.05, "lost": math.nan, "not_applicable_checks": 1.0, "zero": 0.0}
    before = {"score_auc": 0.81, "recall": 0.7, "pairs": 0.0, "calm": 1.0, "lost": 1.0, "not_applicable_checks": 0.0, "zero": 0.0, "gone": 1.0}
    got = {r["metric"]: r["change"] for r in semantic.drift_alerts(frame(now), frame(before)).collect()}
    assert got == {"score_auc": pytest.approx(-0.06), "recall": pytest.approx(-2 / 7), "pairs": None, "not_applicable_checks": 1.0}
