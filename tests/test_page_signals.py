"""Terms of pages: what they hold, and how often texts and events are read for them."""

from linkloom.operators import features
from linkloom.sources import tenant


def test_keys_are_taken_of_the_distinct_texts_of_known_pages(spark):
    pages = spark.createDataFrame([(1,), (2,), (3,)], "page long")
    queries = spark.createDataFrame([(1, "Red  Shoe"), (1, "red shoe"), (1, None), (2, " "), (9, "x")], "page long, query string")
    keywords = spark.createDataFrame([(1, "RED SHOE"), (1, "Straße"), (1, "STRASSE"), (1, ""), (2, "ﬁt"), (9, "y")], "page long, keyword string")
    found = features.page_signals(pages, queries, keywords)
    got = {r["page"]: (sorted(r["queries"]), sorted(r["keywords"]), r["keyword_gap"]) for r in found.collect()}
    assert got == {1: (["red shoe"], ["red shoe", "strasse"], 1), 2: ([], ["fit"], 1), 3: ([], [], 0)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1, "texts go to Python once per page, not once per row"


def test_search_rows_are_summed_once(spark):
    folder = "/root/testdata/sf0.001"
    rows = tenant.searches(spark, folder)
    assert not [f for f in rows.inputFiles() if "events" in f] and tenant.searches(spark, folder) is rows
    assert sorted(rows.collect()) == sorted(tenant.search_rows(spark, folder).collect())
    assert not [f for f in tenant.page_metrics(spark, folder).inputFiles() if "events" in f]
