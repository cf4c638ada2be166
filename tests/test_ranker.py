"""The learned ranker on planted groups."""

import numpy as np
import pandas as pd
import pytest

from linkloom.operators import ranker


def planted(seed, groups=150, size=12):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(groups * size, 3))
    truth = x[:, 0] + 0.8 * np.abs(x[:, 1])
    frame = pd.DataFrame(x, columns=["a", "b", "noise"])
    frame["g"] = np.repeat(np.arange(groups), size)
    frame["y"] = frame.groupby("g")["a"].transform(lambda s: 0)
    frame["y"] = (pd.Series(truth).groupby(frame["g"]).rank(ascending=False) <= 3).astype(int)
    frame.loc[rng.random(len(frame)) < 0.1, "b"] = np.nan
    return frame


def test_learns_what_was_planted():
    train, valid, test = (planted(s) for s in (1, 2, 3))
    model = ranker.fit(train, valid, ["a", "b", "noise"], "g", "y", {"a": 1}, trees=80)
    x, sizes = test[["a", "b", "noise"]].to_numpy(), test.groupby("g").size().to_numpy()
    score = model.predict(x)
    assert ranker.ndcg(test["y"].to_numpy(float), score, sizes) > ranker.ndcg(test["y"].to_numpy(float), test["a"].to_numpy(), sizes) + 0.05
    assert model.contributions(x).sum(axis=1) == pytest.approx(score)
    share = model.importance()
    assert share["noise"] < 0.2 and sum(share.values()) == pytest.approx(1)
    line = np.column_stack([np.linspace(-3, 3, 50), np.full(50, 0.3), np.zeros(50)])
    assert (np.diff(model.predict(line)) >= -1e-9).all()


def test_measures_and_limits():
    assert ranker.ndcg(np.array([1.0, 3.0]), np.array([1.0, 0.0]), np.array([2])) == pytest.approx((1 + 7 / np.log2(3)) / (7 + 1 / np.log2(3)))
    assert ranker.ndcg(np.array([0.0, 0.0]), np.array([1.0, 0.0]), np.array([2])) == 0.0
    assert ranker.too_little(99, 30, 1) and ranker.too_little(100, 29, 1) and ranker.too_little(100, 30, 0) and ranker.too_little(100, 30, 1) is None
    flat = planted(4, 5)
    assert ranker.fit(flat.assign(y=0), flat, ["a"], "g", "y").trees == []


def test_scores_of_a_table(spark):
    train = planted(1, 40)
    model = ranker.fit(train, train, ["a", "b"], "g", "y", trees=10)
    rows = spark.createDataFrame(train[["g", "a", "b", "y"]].assign(i=range(len(train))))
    got = ranker.scores(rows, model, ["i"]).toPandas().sort_values("i")["score"].to_numpy()
    assert got == pytest.approx(model.predict(train[["a", "b"]].to_numpy()))
    assert len(ranker.gathered(rows, ["a"], "g", "y")) == len(train)
