"""Indexed nearest pages against brute force: groups, one hot group, links, languages, ties and zero vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.operators import vector_index as V

PAGES = "page bigint, language string, vector array<double>"


def site(n=600, d=8, seed=2, spread=0.15):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, d))
    at = np.where(np.arange(n) % 3 == 0, 0, rng.integers(12, size=n))  # a third of the pages in one group
    x = centers[at] + rng.normal(size=(n, d)) * spread
    x[5], x[10], x[11] = 0, x[4], x[4]
    pages = [(i, ["en", "de", None][i % 7 % 3], [float(v) for v in x[i]]) for i in range(n)]
    links = [(i, (i * 7 + 3) % n) for i in range(0, n, 2)] + [(i, 100) for i in range(300)] + [(4, 4), (9999, 3), (3, 9999)]
    return pages, links


def by_hand(pages, links, targets, k):
    x = np.array([v for _, _, v in pages])
    size = np.linalg.norm(x, axis=1)
    x = x / np.where(size > 0, size, 1)[:, None]
    cos, out = np.clip(x @ x.T, -1, 1).round(6), []
    linked = set(links)
    for t in targets:
        best = sorted((-cos[t, s], s) for s in range(len(pages)) if s != t and pages[s][1] == pages[t][1] and (s, t) not in linked)[:k]
        out += [(t, s, r, -c) for r, (c, s) in enumerate(best, 1)]
    return out


@pytest.mark.parametrize("piece", [16, 2048])
def test_exact_search_equals_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(V, "PIECE", piece)
    monkeypatch.setattr(V, "QUERIES", 8)
    pages, links = site()
    index = V.build(spark.createDataFrame(pages, PAGES).repartition(3), cells=12)
    assert index.rows.count() == len(pages) and (index.rows.groupBy("language", "cell", "piece").count().agg(F.max("count")).first()[0] <= 4 * piece)
    got = V.nearest(index, F.col("page") % 10 == 0, spark.createDataFrame(links, "source bigint, target bigint"), k=7, probes=2)
    want = by_hand(pages, links, range(0, len(pages), 10), 7)
    got = sorted((r["target"], r["rank"], r["source"], r["similarity"]) for r in got.collect())
    want = sorted((t, r, s, c) for t, s, r, c in want)
    assert [x[:3] for x in got] == [x[:3] for x in want] and [x[3] for x in got] == pytest.approx([x[3] for x in want])


def test_probes_for_a_recall(spark):
    pages, links = site(900, spread=0.3)
    index = V.build(spark.createDataFrame(pages, PAGES), cells=24)
    none = spark.createDataFrame(links, "source bigint, target bigint")
    truth = V.nearest(index, F.col("page") % 10 == 0, none).cache()
    probes = V.needed_probes(index, truth.where("target % 20 = 0"), 0.95)
    found = V.nearest(index, F.col("page") % 20 == 10, none, probes=probes, exact=False)
    measured, pairs = V.recall(found, truth.where("target % 20 = 10")).first(), V.compared(index, F.col("page") % 20 == 10, probes).first()
    assert measured["recall"] >= 0.9 and probes < 12 and pairs["pairs"] < 0.6 * pairs["every"]


def test_far_cells_are_left_alone(spark):
    pages, _ = site(400, spread=0.02)
    index = V.build(spark.createDataFrame(pages, PAGES), cells=12)
    asked = index.rows.where("page % 20 = 7").select("page", "vector").withColumn("kth", F.lit(0.9))
    assert asked.mapInArrow(V._probes(index, None, 1), "page bigint, cell int").count() < 0.3 * asked.count() * 11


def test_nothing_to_find(spark):
    none = spark.createDataFrame([], "source bigint, target bigint")
    for rows in ([], [(0, "en", [1.0])], [(0, "en", [0.0, 0.0]), (1, "de", [1.0, 0.0])]):
        index = V.build(spark.createDataFrame(rows, PAGES))
        assert V.nearest(index, F.col("page") == 0, none).count() == 0
