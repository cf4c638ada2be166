"""Evaluation, retrieval and communities against brute force and closed forms."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.operators import communities, evaluation, retrieval


def plain_auc(rows):
    pos, neg = [x for x, y in rows if y], [x for x, y in rows if not y]
    return sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg))


def test_feature_auc(spark):
    rng = random.Random(4)
    rows = [(int(rng.random() < 0.3), float(rng.randrange(6)) if rng.random() < 0.8 else None, 1.0, math.nan, None) for _ in range(150)]
    got = {r["column"]: r for r in evaluation.feature_auc(spark.createDataFrame(rows, "y int, a double, b double, c double, d double"), ["a", "b", "c", "d"], "y").collect()}
    known = [(x, y) for y, x, *_ in rows if x is not None]
    assert got["a"]["auc"] == pytest.approx(plain_auc(known)) and got["a"]["coverage"] == pytest.approx(len(known) / 150)
    orders = [[(-math.inf if x is None else s * x, y) for y, x, *_ in rows] for s in (1, -1)]
    assert got["a"]["ranker_auc"] == pytest.approx(0.5 + max(abs(plain_auc(o) - 0.5) for o in orders))
    assert got["b"]["auc"] is None and got["b"]["ranker_auc"] == 0.5 and got["c"]["coverage"] == 0 and got["d"]["ranker_auc"] == 0.5


def test_recall_and_bootstrap(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 12, 20), ("b", None, 100), ("b", 10, 10)], "s string, rank int, eligible int")
    one = rows.agg(evaluation.recall_at(rows, "rank", 10).alias("r"), evaluation.random_recall("eligible", 10).alias("e")).first()
    assert one["r"] == 0.5 and one["e"] == pytest.approx((1 + 0.5 + 0.1 + 1) / 4)
    values = spark.createDataFrame([(i % 12, float(i % 5)) for i in range(120)], "s long, v double")
    low, high = evaluation.bootstrap_interval(values, "v", "s", 3)
    assert low <= 2.0 <= high and (low, high) == evaluation.bootstrap_interval(values.repartition(7), "v", "s", 3)
    better = values.withColumn("w", F.col("v") + 1)
    assert evaluation.promotes(better, "w", "v", "s", 3) and not evaluation.promotes(better, "v", "w", "s", 3)


def test_agreement(spark):
    a, b = [0, 0, 1, 1, 2, 2, 2], [1, 1, 0, 0, 0, 2, 2]
    frame = lambda x: spark.createDataFrame(list(enumerate(x)), "vertex long, label int")
    same = [(a[i] == a[j], b[i] == b[j]) for i, j in itertools.combinations(range(7), 2)]
    both, x, y = sum(p and q for p, q in same), sum(p for p, _ in same), sum(q for _, q in same)
    expected = x * y / len(same)
    got = evaluation.agreement(frame(a), frame(b)).first()
    assert got["ari"] == pytest.approx((both - expected) / ((x + y) / 2 - expected)) and got["vertices"] == 7
    assert evaluation.agreement(frame(a), frame([5, 5, 3, 3, 9, 9, 9])).first()["ari"] == 1.0
    assert evaluation.agreement(frame(a), frame([1])).first()["ari"] is None


def test_split_between_two_modes(spark):
    rng = np.random.default_rng(0)
    two = np.concatenate([rng.normal(0.3, 0.05, 400), rng.normal(0.8, 0.05, 600)])
    frame = lambda x: spark.createDataFrame([(float(v),) for v in x], "v double")
    assert evaluation.mixture_split(frame(two), "v") == pytest.approx(0.55, abs=0.03)
    assert evaluation.mixture_split(frame(two[:49]), "v") is None and evaluation.mixture_split(frame([0.5] * 80), "v") is None
    one = evaluation.score_distribution(frame(np.clip(two, 0, 1)), "v").first()
    assert one["count"] == 1000 and sum(one["histogram"]) == 1000 and one["low_share"] == pytest.approx(0.4, abs=0.01) and one["p50"] == pytest.approx(np.quantile(np.clip(two, 0, 1), 0.5))


def planted_pages(spark, n=40, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choice(("en", "de", None)), rng.choice((0, 1)), [rng.gauss(0, 1) for _ in range(5)]) for i in range(n)]
    rows[3] = (3, "en", 0, [0.0] * 5)
    links = [(rng.randrange(n + 3), rng.randrange(n)) for _ in range(160)]
    return rows, links, spark.createDataFrame(rows, "page long, language string, hub int, vector array<double>"), spark.createDataFrame(links, "source long, target long")


def plain_cosine(a, b):
    size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return round(sum(x * y for x, y in zip(a, b, strict=True)) / size, 6) if size else 0.0


def test_retrieval_matches_brute_force(spark):
    rows, links, pages, table = planted_pages(spark)
    want = {}
    for t, lt, _, vt in rows:
        ok = [(-plain_cosine(vs, vt), s) for s, ls, _, vs in rows if s != t and ls == lt and (s, t) not in set(links)]
        want[t] = [s for _, s in sorted(ok)[:4]]
    for block in (None, 7):
        got = {}
        for r in sorted(retrieval.nearest_eligible(pages, table, 4, block).collect(), key=lambda r: (r["target"], r["rank"])):
            got.setdefault(r["target"], []).append(r["source"])
        assert {t: got.get(t, []) for t in want} == want
    facts = {r["target"]: r for r in retrieval.target_facts(pages, table, retrieval.nearest_eligible(pages, table, 4)).collect()}
    by = {p: (lang, v) for p, lang, _, v in rows}
    for t, (lt, vt) in by.items():
        own = {s for s, x in links if x == t and s != t and s in by and by[s][0] == lt}
        last = min((plain_cosine(by[s][1], vt) for s in want[t]), default=None)
        assert facts[t]["linked"] == len(own) and facts[t]["eligible"] == sum(x[0] == lt for x in by.values()) - 1 - len(own)
        assert facts[t]["linked_nearer"] == (0 if last is None else sum(plain_cosine(by[s][1], vt) > last for s in own))


def test_pillar_channel(spark):
    rows, links, pages, table = planted_pages(spark, 60, 2)
    candidates = retrieval.nearest_eligible(pages, table, 2)
    pillars = spark.createDataFrame([(0, min(r[0] for r in rows if r[2] == 0 and r[1])), (1, min(r[0] for r in rows if r[2] == 1 and r[1]))], "hub int, page long")
    by, taken = {r[0]: r for r in rows}, {(r["source"], r["target"]) for r in candidates.collect()} | set(links)
    cosines = {(s, t): plain_cosine(by[s][3], by[t][3]) for s, t in set(links) if s in by and s != t and by[s][1] == by[t][1]}
    for least in (5, 10_000):
        want = set()
        for r in pillars.collect():
            t = by[r["page"]]
            own = [c for (s, _), c in cosines.items() if by[s][1] == t[1]]
            basis = own if len(own) >= least else list(cosines.values()) if len(cosines) >= least else [r2["similarity"] for r2 in candidates.collect()]
            floor = np.quantile(basis, 0.25)
            want |= {(t[0], s[0]) for s in rows if s[0] != t[0] and s[1] == t[1] and s[2] == t[2] and (s[0], t[0]) not in taken and plain_cosine(s[3], t[3]) >= floor}
        assert {(r["target"], r["source"]) for r in retrieval.pillar_pairs(pages, table, candidates, pillars, 0.25, least).collect()} == want


def test_neighbour_graph(spark):
    rows, _, pages, _ = planted_pages(spark, 25, 3)
    want = {}
    for i, _, _, v in rows:
        for less, j in sorted((-plain_cosine(w, v), j) for j, _, _, w in rows if j != i)[:3]:
            if less < 0:
                want[min(i, j), max(i, j)] = -less
    assert {(r["a"], r["b"]): r["weight"] for r in retrieval.knn_graph(pages, 3).collect()} == pytest.approx(want)


def test_betweenness_closed_forms(spark):
    path = [(i, i + 1) for i in range(6)]
    star = [(100, 100 + i) for i in range(1, 6)] + [(101, 100)]
    pages = spark.createDataFrame([(i,) for i in [*range(7), *range(100, 106), 50]], "page long")
    links = spark.createDataFrame([*path, *star, (3, 999), (999, 4), (2, 2)], "source long, target long")
    got = {r["page"]: r["betweenness"] for r in communities.betweenness(links, pages).collect()}
    assert {i: got[i] for i in range(7)} == {i: float(i * (6 - i)) for i in range(7)}
    assert got[100] == 10.0 and got[101] == 0.0 and got[50] == 0.0


@pytest.mark.parametrize("kind", ["spread", "copies", "zero", "opposed", "broken"])
def test_blocks_compare_every_pair_but_sort_few(kind):
    import pandas as pd

    rng = np.random.default_rng(5)
    left, right = rng.normal(size=(70, 16)), rng.normal(size=(1500, 16))
    if kind == "copies":
        right[200:1400], left[:30] = right[200], right[200]
    elif kind == "zero":
        right[:900], left[3] = 0, 0
    elif kind == "opposed":
        right = -np.abs(right)
        left = np.abs(left)
    elif kind == "broken":
        right[::3, 2], left[4, 1], right[7, 0] = np.nan, np.inf, -np.inf
    targets, sources = rng.permutation(2000)[:70], rng.permutation(2000)[:1500]
    ruled = {(t, s) for t, s in zip(targets[rng.integers(0, 70, 900)].tolist(), sources[rng.integers(0, 1500, 900)].tolist(), strict=True)}
    side = lambda i, page, vector=None, other=None: pd.DataFrame({"side": i, "page": page, "vector": vector, "other": other})
    t, s = zip(*sorted(ruled), strict=True)
    got = retrieval._top(10)(pd.concat([side(0, targets, list(left)), side(1, sources, list(right)), side(2, list(t), other=list(s))], ignore_index=True))
    want = set()
    with np.errstate(all="ignore"):
        unit = lambda x: x / np.where(np.linalg.norm(x, axis=1) > 0, np.linalg.norm(x, axis=1), 1)[:, None]
        cos = np.clip(unit(left) @ unit(right).T, -1, 1).round(6)
    for i, t in enumerate(targets.tolist()):
        near = sorted((-c, s) for c, s in zip(cos[i].tolist(), sources.tolist(), strict=True) if np.isfinite(c) and s != t and (t, s) not in ruled)
        want |= {(t, s, -c) for c, s in near[:10]}
    assert set(got.itertuples(index=False, name=None)) == want and len(got) == len(want)


@pytest.mark.parametrize(("n", "degree", "hub"), [(3000, 8, 0), (400, 3, 300), (600, 1, 0)])
def test_loads_of_blocks_equal_those_of_single_sources(n, degree, hub):
    rng = np.random.default_rng(n)
    a, b = rng.integers(0, n, n * degree), rng.integers(0, n, n * degree)
    a, b = np.concatenate([a, np.zeros(hub, int), np.arange(n)]), np.concatenate([b, np.arange(1, hub + 1), (np.arange(n) // 7) * 7])
    a, b = a[a != b], b[a != b]
    code = np.unique(np.minimum(a, b) * n + np.maximum(a, b))
    names = np.unique([code // n, code % n])
    order, offset, near = communities._by_degree(*communities._neighbours(np.searchsorted(names, code // n), np.searchsorted(names, code % n), len(names)))
    sums, starts = communities._Sums(offset, near), np.arange(0, len(names), max(1, len(names) // 37))
    want = sum(communities._flow(s, offset, near, len(names)) for s in starts.tolist())
    assert communities._flows(starts, sums) == pytest.approx(want) and want.max() > 0


def test_betweenness_walks_in_many_tasks(spark, tmp_path):
    pages = spark.range(3000).select(F.col("id").alias("page"))
    links = pages.select(F.col("page").alias("source"), F.explode(F.array((F.col("page") * 7 + 3) % 3000, (F.col("page") * 5 + 1) % 3000)).alias("target"))
    found = communities.betweenness(links, pages)
    found.write.parquet(str(tmp_path / "out"))  # the plan is final once it ran
    plan = found._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" in plan and "REPARTITION_BY_COL" not in plan


def test_communities_of_planted_groups(spark):
    clique = lambda base: [(base + i, base + j) for i in range(5) for j in range(i)]
    edges = [("t", a, b, 1.0) for a, b in [*clique(0), *clique(10), (4, 10)]] + [("u", 0, 1, 1.0)]
    rng = random.Random(7)
    topic = [("v", i, j, 1.0) for i in range(160) for j in range(i) if rng.random() < (0.3 if i // 40 == j // 40 else 0.01)]
    frame = spark.createDataFrame(edges + topic, "tenant string, a long, b long, weight double")
    found = communities.communities(frame).collect()
    of = {(r["tenant"], r["vertex"]): r["label"] for r in found}
    assert [of["t", i] for i in range(5)] == [0] * 5 and [of["t", 10 + i] for i in range(5)] == [1] * 5 and of["u", 0] == of["u", 1]
    planted = spark.createDataFrame([(i, i // 40) for i in range(160)], "vertex long, label int")
    mine = spark.createDataFrame([(v, x) for (t, v), x in of.items() if t == "v"], "vertex long, label int")
    assert evaluation.agreement(planted, mine).first()["ari"] > 0.9
    assert communities.disconnected(frame.where("tenant = 'v'"), mine).count() == 0
    assert [r["label"] for r in communities.disconnected(spark.createDataFrame([(1, 2)], "a long, b long"), spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, 1)], "vertex long, label int")).collect()] == [0]


def test_density_clusters():
    rng = np.random.default_rng(3)
    centres = np.eye(6)[:3]
    points = np.concatenate([c + rng.normal(0, 0.03, (25, 6)) for c in centres] + [rng.normal(0, 1, (8, 6))])
    label = communities.density_clusters(points)
    groups = [label[25 * i : 25 * i + 25] for i in range(3)]
    assert all(len(set(g[g >= 0].tolist())) == 1 and (g >= 0).mean() > 0.8 for g in groups) and len({g[g >= 0][0] for g in groups}) == 3
    assert (label[75:] == -1).mean() >= 0.5 and (communities.density_clusters(points[:10]) == -1).all()


def test_hubs_keep_their_ids():
    import pandas as pd

    old = pd.DataFrame({"hub": [3, 5], "centroid": [[1.0, 0.0], [0.0, 1.0]]})
    new = pd.DataFrame({"hub": [0, 1, 2], "centroid": [[0.02, 1.0], [0.99, 0.1], [0.1, 0.99]]})
    assert communities.match_hubs(old, new, 9) == {0: 5, 1: 3, 2: 9}


def test_hubs_of_any_blocks_are_those_of_one(spark):
    """A tenant's clusters do not hang on the blocks its pages are dealt to; copies, a zero vector and missing ones among them."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    x = centres[rng.integers(0, 6, 300)] + rng.normal(size=(300, 8)) * 0.25
    x[40:80] = x[:40]
    rows = [(t, 1000 * i + p, v.tolist()) for i, t in enumerate(("a", None)) for p, v in enumerate(x[: 300 - 100 * i])] + [("a", 7000, [0.0] * 8), ("a", 7001, None), ("a", 7002, [float("nan")] * 8), ("c", 8000, [1.0] * 8)]
    pages = spark.createDataFrame(rows, "tenant string, page bigint, vector array<double>")
    found = {(r["tenant"], r["page"]): r["hub"] for r in communities.hubs(pages, block=37).collect()}
    assert len(found) == len(rows) and max(found.values()) >= 3 and all(found[k] == -1 for k in (("a", 7001), ("a", 7002), ("c", 8000)))
    for tenant in ("a", None):
        own = [(p, v) for t, p, v in rows if t == tenant and p < 7001]
        label = communities.density_clusters(np.array([v for _, v in own]))
        assert [found[tenant, p] for p, _ in own] == label.tolist()


def test_copies_are_one_cluster_whatever_their_order():
    """Points that meet at one distance meet at once: forty copies of one point never split into clusters."""
    rng = np.random.default_rng(1)
    points = np.concatenate([np.tile(rng.normal(size=8), (40, 1)), rng.normal(size=(30, 8)) * 0.1 + 1])
    for order in (np.arange(70), rng.permutation(70)):
        label = communities.density_clusters(points[order])[np.argsort(order)]
        assert len(set(label[:40])) == 1 and label[0] >= 0
