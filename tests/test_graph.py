"""Graph operators against walks, closed forms and counts in plain Python."""

import collections
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from linkloom import catalog
from linkloom.operators import components, graph
from linkloom.operators.components import connected_components
from linkloom.plans import bitmap
from linkloom.sources import site

SF = "/root/testdata/sf0.001"

LINKS = "source long, position long, target long, anchor string"


def test_depth_of_long_chains(spark):
    last = 36
    chain = [(i, 1, i + 1, "next") for i in range(last)] + [(i, 2, 0, "home") for i in range(last)] + [(7, 3, 9, "skip"), (50, 1, 51, "island")]
    pages = spark.createDataFrame([(i,) for i in [*range(last + 1), 50, 51]], "page long")
    got = {r["page"]: r["depth"] for r in graph.crawl_depth(spark.createDataFrame(chain, LINKS), pages, [0]).collect()}
    assert got == {i: i if i < 9 else i - 1 for i in range(last + 1)} | {50: None, 51: None}


def test_pagerank_closed_form(spark):
    pages = spark.createDataFrame([(1,), (2,), (3,)], "page long")
    links = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (2, 3)], "source long, target long")
    want = {1: 800 / 4049, 2: 1140 / 4049, 3: 2109 / 4049}
    assert {r["page"]: r["rank"] for r in graph.pagerank(links, pages).collect()} == pytest.approx(want, abs=1e-9)
    # Two graphs side by side walk as they would alone.
    both = [d.withColumn("side", F.lit("a")).unionByName(d.where(F.col(c) != 2).withColumn("side", F.lit("b"))) for d, c in ((links, "source"), (pages, "page"))]
    got = graph.pagerank(both[0].where("side = 'a' or target <> 2"), both[1], by=("side",)).collect()
    assert {r["page"]: r["rank"] for r in got if r["side"] == "a"} == pytest.approx(want, abs=1e-9)
    assert {r["page"]: r["rank"] for r in got if r["side"] == "b"} == pytest.approx({1: 20 / 57, 3: 37 / 57}, abs=1e-9)


@pytest.mark.parametrize(("hot", "held"), [(1024, 1_000_000), (8, 20)])
def test_components_match_union_find(spark, monkeypatch, hot, held):
    monkeypatch.setattr(components, "HOT", hot)
    monkeypatch.setattr(components, "HELD", held)
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(1, 200)] + [(1999 - i, 2000) for i in range(40)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = connected_components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert {r["node"]: r["component"] for r in got} == {x: root(x) for x in linked}


def test_small_components_write_few_tables(spark, monkeypatch):
    names, write = [], components.materialize
    monkeypatch.setattr(components, "materialize", lambda df, name: names.append(name) or write(df, name))
    edges = [(i, i + 1) for i in range(400)] + [(5000, 5000 + i) for i in range(1, 300)]
    got = connected_components(spark.createDataFrame(edges, "u long, v long").repartition(9))
    assert {r["node"]: r["component"] for r in got.collect()} == {i: 0 for i in range(401)} | {5000 + i: 5000 for i in range(300)}
    assert got.count() == 701 and len(got.inputFiles()) == 1 and len(names) == 2


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_bitmap_joins_are_exact(spark):
    rows = spark.range(500).select(F.when(F.col("id") % 50 != 7, F.col("id")).alias("key"), "id").withColumn("_key", F.lit("x")).withColumn("row", F.lit("y"))
    keys = spark.range(0, 1000, 3).select(F.col("id").alias("key"), (F.col("id") * 2).alias("v"))
    want = [r["id"] for r in rows.join(keys, "key", "left_anti").collect()]
    assert sorted(r["id"] for r in bitmap.without(rows, keys, "key", log_bits=7).collect()) == sorted(want)
    left = rows.join(keys, "key", "left").select("id", "v").collect()
    assert sorted(map(str, bitmap.left_join(rows, keys, "key", log_bits=7).select("id", "v").collect())) == sorted(map(str, left))
    assert [bitmap.bits_for(n) for n in (0, 1000, 10**6, 10**12)] == [20, 20, 23, 26]


def test_pillars(spark):
    rows = [(1, 0, [1.0, 0.0]), (2, 0, [2.0, 2.0]), (3, 0, [0.0, 1.0]), (4, 1, [1.0, 0.0]), (5, 1, [3.0, 0.0]), (6, -1, [1.0, 0.0])]
    pages = spark.createDataFrame(rows, "page long, hub int, vector array<double>")
    ranks = spark.createDataFrame([(4, 0.1), (5, 0.2)], "page long, rank double")
    assert {r["hub"]: r["page"] for r in graph.hub_pillars(pages).collect()} == {0: 2, 1: 4}
    assert {r["hub"]: r["page"] for r in graph.hub_pillars(pages, ranks).collect()} == {0: 2, 1: 5}
    assert {r["hub"] for r in graph.hub_pillars(pages, least=3).collect()} == {0}


def brute_projection(rows, budget):
    of = collections.defaultdict(set)
    for page, keyword in rows:
        of[keyword].add(page)
    pairs, dropped = sum(math.comb(len(p), 2) for p in of.values()), set()
    for k in sorted(of, key=lambda k: (-len(of[k]), k)):
        if pairs <= budget:
            break
        pairs -= math.comb(len(of[k]), 2)
        dropped.add(k)
    shared = collections.Counter(ab for k, p in of.items() if k not in dropped for ab in itertools.combinations(sorted(p), 2))
    return dict(shared), dropped


def test_projection_drops_what_the_budget_demands(spark):
    rng = random.Random(3)
    rows = [(p, 1) for p in range(60)] + [(rng.randrange(60), k) for k in range(2, 40) for _ in range(rng.choice((1, 4, 9)))]
    rows += [(p, k) for k in range(40, 45) for p in range(20)] + rows[:9]
    table = spark.createDataFrame([*rows, (None, 1), (3, None)], "page long, keyword long")
    for budget in (None, 2500, 1000, 950, 0):
        pairs, dropped = graph.keyword_projection(table, budget)
        assert ({(r["a"], r["b"]): r["shared"] for r in pairs.collect()}, {r["keyword"] for r in dropped.collect()}) == brute_projection(rows, math.inf if budget is None else budget)


def test_projection_takes_tasks_by_its_pairs(spark, monkeypatch):
    """Hot keywords, pages of very many pairs and few rows a task give the same pairs, and more pairs take more tasks."""
    rng = random.Random(8)
    rows = [(p, 1) for p in range(60)] + [(0, k) for k in range(2, 40)] + [(rng.randrange(60), k) for k in range(2, 40) for _ in range(9)]
    expected = brute_projection(rows, math.inf)[0]
    for hot, pairs in ((1024, 4_000_000), (8, 100), (1024, 100), (8, 100_000)):
        for name, value in (("HOT", hot), ("PAIRS", pairs), ("ROWS", pairs)):
            monkeypatch.setattr(graph, name, value)
        found = graph.keyword_projection(spark.createDataFrame(rows, "page long, keyword long"))[0]
        assert {(r["a"], r["b"]): r["shared"] for r in found.collect()} == expected
        assert pairs > 100 or found.rdd.getNumPartitions() >= sum(expected.values()) / 100


def test_every_strategic_page_counts(spark):
    rows = catalog.queries()["merged_keywords"](spark, SF).where("source = 'strategic'").collect()
    customers = spark.read.parquet(f"{SF}/customer.parquet").select("c_custkey", "c_mktsegment").collect()
    assert len(customers) > 100 and sorted((r["page"], r["query"], r["rank"]) for r in rows) == sorted((c[0], c[1], 1) for c in customers)


def test_pair_features_read_whole_texts(spark):
    bodies = {r["page"]: r["body"] for r in site.site_pages(spark, SF).select("page", "body").collect()}
    terms = {p: {w for w in (b or "").lower().split(" ") if len(w) >= 4} for p, b in bodies.items()}
    links = {(r["source"], r["target"]) for r in site.site_links(spark, SF).collect()}
    shared = {(a, b): terms[a] & terms[b] for a, b in links if a in terms and b in terms}
    got = {(r["source"], r["target"]): (r["shared"], r["jaccard"]) for r in catalog.queries()["pair_features"](spark, SF).collect()}
    assert any(len(b or "") > 400 for b in bodies.values()) and got.keys() == shared.keys()
    for (a, b), both in shared.items():
        union = len(terms[a] | terms[b])
        assert got[a, b] == (len(both), pytest.approx(len(both) / union if union else 0.0, abs=6e-7))


def test_unit_vectors_take_their_length_once(spark):
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, [])], "page long, vector array<double>")
    found = rows.select("page", graph.unit_vector("vector").alias("u"))
    assert {r["page"]: r["u"] for r in found.collect()} == {1: [0.6, 0.8], 2: [0.0, 0.0], 3: None, 4: []}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1
