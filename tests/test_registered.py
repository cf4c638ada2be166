"""Registered queries that have no SQL, against plain Python over the same tables."""

import re

import pytest
from pyspark.sql import functions as F

from linkloom import catalog
from linkloom.functions import url as U
from linkloom.sources import site

SF = "/root/testdata/sf0.001"


def test_url_keys(spark):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()}
    rows = catalog.queries()["url_keys"](spark, SF).collect()
    name = next(c for c in rows[0].asDict() if c != "page_id")
    assert {r["page_id"]: r[name] for r in rows} == {p: U.normalise(u) for p, u in pages.items()}


def test_anchor_extraction_points_into_texts(spark):
    rows = catalog.queries()["anchor_extraction"](spark, SF).collect()
    bodies = {r["page"]: r["body"] for r in site.site_pages(spark, SF).collect()}
    chain = {(r["page"], r["keyword"]) for r in catalog.queries()["keyword_chain"](spark, SF).collect()}
    assert rows and all(bodies[r["source"]][r["start"] : r["end"]] == r["phrase"] for r in rows)
    first = [r for r in rows if r["keyword_rank"] == 1]
    assert first and all((r["target"], r["keyword"]) in chain for r in first)
    exact = [r for r in rows if r["rung"] == "EXACT"]
    assert all(re.findall(r"\w+", r["phrase"].casefold()) == re.findall(r"\w+", r["keyword"].casefold()) for r in exact)


def test_index_recall(spark):
    row = catalog.queries()["index_recall"](spark, "/root/testdata/sf0.1").first()
    assert row["recall"] >= 0.9 and row["pairs"] < row["every"] and row["probes"] < 32


@pytest.mark.parametrize("name", ["recommendations_walk"])
def test_walk_keeps_its_rules(spark, name):
    rows = catalog.queries()[name](spark, SF).cache()
    links = rows.where("action = 'ADD_LINK'")
    assert links.groupBy("source").count().where("count > 12").count() == 0 and links.groupBy("source", "target").count().where("count > 1").count() == 0
    assert rows.where("action = 'CONTENT_GAP' and suggested").count() == 0 and links.where("orphan_slot and not suggested").count() == 0
    free = {r["page"] for r in catalog.queries()["hub_pillars"](spark, SF).select("page").collect()} if "hub_pillars" in catalog.queries() else set()
    taken = links.where(F.col("suggested") & ~F.col("orphan_slot")).groupBy("target").count().where("count > 5").collect()
    assert {r["target"] for r in taken} <= free
