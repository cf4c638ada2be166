"""What the scores read and compute: stored site tables, columns with a weight, contributions where they are asked for."""

import pytest

from linkloom import catalog
from linkloom.operators import graph, scoring
from linkloom.sources import site, tenant

SF = "/root/testdata/sf0.001"


def recorded(monkeypatch, module):
    """(name, columns) of every table that ``module`` stores."""
    seen, real = [], module.materialize
    monkeypatch.setattr(module, "materialize", lambda df, name: seen.append((name, df.columns)) or real(df, name))
    return seen


def test_documents_meet_their_embeddings_once(spark):
    own, links = tenant.site(spark, SF), tenant.links(spark, SF)
    for df in (own, links, catalog._candidates(spark, SF), tenant.pages(spark, SF)):
        assert not [f for f in df.inputFiles() if "documents" in f or "embeddings" in f]
    same = ["page", "url", "language", "hub", "vector"]
    assert sorted(own.select(same).collect()) == sorted(site.site_pages(spark, SF).select(same).collect())
    assert sorted(links.collect()) == sorted(site.site_links(spark, SF).collect())
    words = {r["page"]: len(r["body"].split()) for r in site.site_pages(spark, SF).where("body is not null").collect() if r["body"].isascii()}
    assert words and words == {r["page"]: r["words"] for r in own.collect() if r["page"] in words}


def test_strategic_rows_of_other_pages_are_left_at_the_scan(spark):
    pages = {r["page"] for r in tenant.site(spark, SF).select("page").collect()}
    every, kept = tenant.strategic_rows(spark, SF).collect(), tenant.strategic(spark, SF).collect()
    own = lambda rows: sorted((r for r in rows if r["page"] in pages), key=str)
    assert own(kept) == own(every) and len(kept) <= len(every)


def test_scores_store_what_they_read(spark, monkeypatch):
    in_catalog, in_scoring = recorded(monkeypatch, catalog), recorded(monkeypatch, scoring)
    found = catalog._scores(spark, SF)
    assert dict(in_catalog)["pair-features"] == ["source", "target", *[c for c, *_ in scoring.WEIGHTS]]
    assert dict(in_scoring)["raw-scores"] == ["source", "target", "raw_score"]
    columns = ["source", "target", "raw_score", "score", "tier"]
    assert found.columns == columns
    assert sorted(found.collect()) == sorted(catalog._scores(spark, SF, top=3).select(columns).collect())


def test_pairs_without_any_value_have_no_parts(spark):
    rows = spark.createDataFrame([(1, 1, 0.25, None), (1, 2, None, None), (2, 1, float("nan"), 4.0)], "source long, target long, a double, b double")
    weights = (("a", 0.5, True, False), ("b", 0.5, False, True))
    for top in (0, 2):
        got = {(r["source"], r["target"]): r for r in scoring.weighted_score(rows, ["source", "target"], weights, top=top).collect()}
        assert [got[k]["raw_score"] for k in ((1, 1), (1, 2), (2, 1))] == [pytest.approx(0.75), None, pytest.approx(0.5)]
    assert [(got[k]["top1_feature"], got[k]["top2_feature"]) for k in ((1, 1), (1, 2), (2, 1))] == [("a", None), (None, None), ("b", None)]


def test_the_first_rounds_of_ranks_are_walked_once(spark, monkeypatch):
    seen = recorded(monkeypatch, graph)
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 4), (5, 1)], "source long, target long")
    pages = spark.createDataFrame([(i,) for i in range(1, 6)], "page long")
    want = {r["page"]: r["rank"] for r in graph.pagerank(links, pages, steps=5, tolerance=None, together=2).collect()}
    assert [n for n, _ in seen].count("rank-moved") == 2
    seen.clear()
    got = {r["page"]: r["rank"] for r in graph.pagerank(links, pages, steps=5, tolerance=None).collect()}
    assert "rank-moved" not in [n for n, _ in seen]
    assert got == {k: pytest.approx(v, abs=1e-12) for k, v in want.items()}
