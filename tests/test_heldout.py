"""Held-out rounds against the same values computed fold by fold."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from linkloom.operators import graph, heldout, retrieval


def site(spark, n=60):
    rng = random.Random(5)
    pages = [(i, ["en", "de"][i % 5 == 0], i % 4 - 1, [rng.gauss(0, 1) for _ in range(4)]) for i in range(n)]
    links = [(rng.randrange(n), rng.randrange(n + 5)) for _ in range(400)] + [(1, 1), (2, 3), (2, 3)]
    return spark.createDataFrame(pages, "page long, language string, hub int, vector array<double>"), spark.createDataFrame(links, "source long, target long"), links


def test_folds_are_disjoint_and_stable(spark):
    _, links, rows = site(spark)
    got = {(r["source"], r["target"]): r["fold"] for r in heldout.hidden(links.repartition(3), 5).collect()}
    part = lambda s, t: int(hashlib.sha256(f"42\t{s}\t{t}".encode()).hexdigest(), 16) * 10 // 2**256
    assert got == {p: part(*p) for p in set(rows) if part(*p) < 5}
    few = heldout.hidden(spark.createDataFrame([(1, 2), (1, 3)], "source long, target long"), 1, 0.0001).collect()
    assert len(few) == 1 and few[0]["fold"] == 0 and heldout.hidden(links.limit(0), 2).count() == 0
    with pytest.raises(ValueError, match="share"):
        heldout.hidden(links, 11)


def test_views_equal_those_of_each_fold(spark):
    pages, links, rows = site(spark)
    got = {(r["fold"], r["page"]): r for r in heldout.views(links, pages, 3, share=0.2, steps=20, tolerance=None).collect()}
    out = heldout.hidden(links, 3, 0.2).cache()
    assert len(got) == 3 * pages.count()
    for fold in range(3):
        left = links.distinct().join(out.where(F.col("fold") == fold), ["source", "target"], "left_anti")
        counts = {r["page"]: (r["inbound"], r["outbound"]) for r in graph.structure(left, pages).collect()}
        ranks = graph.pagerank(left, pages, steps=20, tolerance=None)
        known = {r["page"]: round(r["rank"], 9) for r in ranks.collect() if r["page"] in counts}
        best = {r["page"] for r in graph.hub_pillars(pages, ranks).collect()}
        for page, (i, o) in counts.items():
            r = got[fold, page]
            assert (r["inbound"], r["outbound"], r["is_orphan"], r["is_pillar"]) == (i, o, i == 0, page in best)
            assert r["rank"] == pytest.approx(known[page], abs=2e-9) and r["rank_percentile"] == pytest.approx(sum(x < r["rank"] - 1e-9 for x in known.values()) / len(known), abs=0.02)


def test_hidden_links_are_found_again(spark):
    pages, links, _ = site(spark)
    out = heldout.hidden(links, 3, 0.2).cache()
    got = {(r["fold"], r["source"], r["target"]): r["rank"] for r in heldout.retrieved(links, pages, out, 6).collect()}
    want = {}
    for fold in range(3):
        own = {(r["source"], r["target"]) for r in out.where(F.col("fold") == fold).collect()}
        left = links.distinct().join(out.where(F.col("fold") == fold), ["source", "target"], "left_anti")
        want |= {(fold, r["source"], r["target"]): r["rank"] for r in retrieval.nearest_eligible(pages, left, 6).collect() if (r["source"], r["target"]) in own}
    assert got == want and want
    rounds = {r["fold"]: (r["hidden"], r["recoverable"], r["found"]) for r in heldout.rounds(links, pages, 3, 0.2, k=6).collect()}
    language = {r["page"]: r["language"] for r in pages.collect()}
    rows = [tuple(r) for r in out.collect()]
    for fold in range(3):
        mine = [(s, t) for f, s, t in rows if f == fold]
        able = sum(s != t and s in language and t in language and language[s] == language[t] for s, t in mine)
        assert rounds[fold] == (len(mine), able, sum(f == fold for f, _, _ in want))
