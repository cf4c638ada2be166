"""Served rows and reports on planted tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

from linkloom.operators import outputs, reports
from linkloom.sources.runs import Runs

ROWS = "source long, target long, percentile double, tier int, candidates long, reason string, advice string, best_score double, rank_in_source int, anchored boolean, excluded boolean, hub_ok boolean"


def tables(spark):
    rows = spark.createDataFrame(
        [(1, 9, 0.9, 1, 3, None, None, None, 1, True, False, True), (2, 9, 0.95, 1, 3, "NO_KEYWORD", "fix", 0.2, 2, False, False, True), (3, 9, 0.9, 1, 3, None, None, None, 1, True, False, True),
         (4, 9, 0.99, 1, 3, None, None, None, 1, True, True, True), (5, 9, 0.5, 2, 1, None, None, None, 1, True, False, False), (6, 9, 0.4, 2, 1, None, None, None, 3, True, False, True), (1, 8, 0.2, 3, 3, "GAP", "write", 0.1, 2, False, False, True)],
        ROWS,
    )
    emitted = spark.createDataFrame([(1, 9, "ADD_LINK", 1, True, False), (3, 9, "ADD_LINK", 1, False, False), (1, 8, "CONTENT_GAP", 1, False, False)], "source long, target long, action string, place long, suggested boolean, orphan_slot boolean")
    choices = spark.createDataFrame([(1, 9, 2, "second"), (1, 9, 1, "x" * 121), (1, 9, 3, "third"), (3, 9, 1, "only")], "source long, target long, rank int, phrase string")
    pages = spark.createDataFrame([(i, i / 10) for i in range(1, 6)] + [(6, None)], "page long, rank_percentile double")
    return rows, emitted, choices, pages


def test_new_links(spark):
    rows, emitted, *_ = tables(spark)
    got = {(r["source"], r["target"]): r for r in outputs.new_links(emitted, rows, "acme").collect()}
    assert {k: (r["best_rank"], r["score"], r["reason"], r["advice"]) for k, r in got.items()} == {(1, 9): (1, 90.0, None, None), (3, 9): (2, 90.0, None, None), (1, 8): (3, 20.0, "GAP", "write")}
    assert got[1, 9]["id"] == hashlib.sha256(b"acme\x1fADD_LINK\x1f1\x1f9").hexdigest()[:16]


def test_rescues_and_unanchored(spark):
    rows, emitted, choices, pages = tables(spark)
    wanted, unmet = spark.createDataFrame([(9,), (77,)], "page long"), spark.createDataFrame([(77, "NO_RELEVANT_SOURCE")], "page long, reason string")
    got = {r["page"]: r for r in outputs.orphan_rescues(rows, emitted, choices, pages, wanted, unmet, 2, best=3).collect()}
    assert [(s["source"], s["score"], s["anchor"], s["suggested"]) for s in got[9]["sources"]] == [(3, 90.0, "only", False), (1, 90.0, "second", True), (6, 40.0, None, False)]
    assert (got[9]["guaranteed"], got[9]["suggested_in"], got[9]["unmet_reason"]) == (2, 1, None) and (got[77]["suggested_in"], got[77]["unmet_reason"], got[77]["sources"]) == (0, "NO_RELEVANT_SOURCE", [])
    assert sorted((r["source"], r["target"], r["recommended"]) for r in outputs.unanchored(rows, emitted).collect()) == [(1, 8, True), (2, 9, False)]
    records = outputs.new_links(emitted, rows, "acme")
    profile, own, incoming = outputs.page_detail(pages, records, 1)
    assert profile.count() == 1 and [r["target"] for r in own.collect()] == [9, 8] and incoming == 0 and outputs.page_detail(pages, records, 9)[2] == 2


def test_reports(spark):
    pages = spark.createDataFrame(
        [(1, True, 200, "a", "a", [1.0]), (2, False, None, "a", "a", [1.0]), (3, None, 301, "a", "a", [1.0]), (4, False, 200, "a", "a", [1.0]), (5, False, 204, "a", "b", [1.0]), (6, False, 200, "a", "a", None), (7, None, 299, None, None, [1.0])],
        "page long, placeholder boolean, status int, body_hash string, embedded_hash string, vector array<double>",
    )
    done = reports.work_selection(pages)
    assert {r["page"]: r["state"] for r in done.collect()} == {1: "placeholder", 2: "non_2xx", 3: "non_2xx", 4: "up_to_date", 5: "target", 6: "target", 7: "target"}
    assert tuple(reports.state_counts(done).first()) == (1, 2, 1, 3) and tuple(reports.state_counts(done.limit(0)).first()) == (0, 0, 0, 0)
    words = spark.createDataFrame([("A  b", "en"), ("a b", "en"), ("a b", "de"), ("c", "en")], "keyword string, language string")
    assert tuple(reports.unique_share(words).first()) == (3, 2 / 3) and tuple(reports.unique_share(words.limit(0)).first()) == (0, None)
    bands = spark.createDataFrame([(0.05,), (0.1,), (0.3,), (0.31,), (None,)], "r double").select(reports.fixable_band(F.col("r")).alias("b"))
    assert [r["b"] for r in bands.collect()] == ["feature", "both", "both", "product", None]
    assert reports.any_row(pages) and not reports.any_row(pages, F.col("status") == 999)
    assert "Limit" in pages.where("status = 200").limit(1)._jdf.queryExecution().executedPlan().toString()
    links = spark.createDataFrame([("A  b ", [1.0]), ("A b", [1.0]), ("c", None), (None, [2.0])], "around string, vector array<double>")
    assert [(r["key"], r["vector"]) for r in reports.vectors_by_sentence(links).collect()] == [(hashlib.sha256(b"A b").hexdigest(), [1.0])]
    facts = spark.createDataFrame([(1, 2, 1), (2, 0, 0)], "target long, linked long, linked_nearer long")
    found = spark.createDataFrame([(1, 5), (1, 6)], "target long, source long")
    row = reports.candidate_report(pages, pages.where("page < 3"), found, facts, found.limit(1), 2).first()
    assert (row["targets"], row["candidates"], row["full_targets"], row["empty_targets"], row["median_per_target"], row["drop_rate"], row["source_pages"]) == (2, 3, 1, 1, 1.0, 1 / 3, 7)


def test_score_reports_and_homes(spark):
    scored = spark.createDataFrame([(1, 10.0, 1, "a"), (2, 20.0, 2, "b"), (3, 30.0, 3, "a"), (4, 0.0, 3, None)], "k long, score double, tier int, top1_feature string")
    assert tuple(reports.score_summary(scored).first()) == pytest.approx((4, 1, 1, 2, 3.0, 15.0, 27.0))
    assert tuple(reports.score_summary(scored.limit(0)).first())[:4] == (0, 0, 0, 0)
    assert {r["feature"]: r["pairs"] for r in reports.leaders(scored).collect()} == {"a": 2, "b": 1}
    rows = spark.createDataFrame([(1.0, None), (float("nan"), 2.0)], "x double, y double")
    assert {r["feature"]: r["share"] for r in reports.missing_shares(rows, ["x", "y"]).collect()} == {"x": 0.5, "y": 0.5} and reports.missing_shares(rows.limit(0), ["x"]).count() == 0
    keys = spark.createDataFrame([(k,) for k in ("a.x", "a.x/en", "a.x/en/b", "a.x/EN", "a.x?page=2", "a.x/de/at", None)], "k string")
    assert [r["h"] for r in keys.select(reports.is_home(F.col("k"), ["/en/", "/DE/at"]).alias("h")).collect()] == [True, True, False, False, False, True, None]


def test_runs_with_ordinals(spark, tmp_path):
    runs = Runs(spark, f"file://{tmp_path}")
    rows = spark.createDataFrame([(i, i % 3) for i in range(50)], "k long, g int").repartition(4)
    runs.complete("r", {"links": runs.write("r", "links", rows, [F.col("g"), F.col("k").desc()])})
    got = [(r["g"], r["k"]) for r in runs.read("links").orderBy("ordinal").collect()]
    assert got == sorted(((i % 3, i) for i in range(50)), key=lambda x: (x[0], -x[1])) and runs.read("links").agg(F.max("ordinal")).first()[0] == 50
