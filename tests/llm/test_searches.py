"""Filter audit, exact top-k and ranked lexical search against brute force, with nulls, ties, repeated rows and empty tables."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.llm import ball_tree, filter_audit, lexical

DOCS = "doc_id bigint, text string, source string, word int, row string"


def texts(seed=3):
    rng = random.Random(seed)
    word = lambda: rng.choice(["alpha", "Beta", "GAMMA", "d|e", "été", "x"] + [f"w{i}" for i in range(90)])
    rows = [(i, " ".join(word() for _ in range(rng.choice([0, 3, 49, 50, 60, 200]))), rng.choice(["a", "b", None])) for i in range(60)]
    rows += [(100 + i, rows[i][1], "c") for i in range(10)]  # copies under larger ids
    rows += [(None, rows[0][1], "a"), (None, None, None), (5, rows[5][1], "a"), (5, rows[5][1], "a"), (200, None, "b"), (201, "", "b"), (202, "ABC " * 60, "c"), (203, "word\x0bword x " * 400, "c")]
    return [(*r, 1, "clash") for r in rows]


def audit_by_hand(rows, labels):
    mask, counted = [], {}
    for doc_id, text, source, *_ in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        first = min((d for d, t, *_ in rows if d is not None and (t or "") == text), default=None)
        fails = [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search(r"[#$%&*|]", text)), doc_id is not None and doc_id > first]
        good, toxic = (any(d == doc_id and label[i] == 1 for d, *label in labels if doc_id is not None) for i in range(2))
        mask.append((source or "", {x for x, f in zip("ABCDE", fails, strict=True) if f}, good, toxic))
    for part in {m[0] for m in mask}:
        own = [m for m in mask if m[0] == part]
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            for step, x in enumerate(order, 1):
                before = set(order[: step - 1])
                out = [m for m in own if x in m[1] and not m[1] & before]
                shapley[x] += len(out)
                counted[part, "".join(order), step] = [
                    sum(not m[1] & (before | {x}) for m in own), len(out), sum(x in m[1] and bool(m[1] & before) for m in own), sum(m[1] == {x} for m in own), sum(m[2] for m in out), sum(m[3] for m in out),
                ]
        for (p, order, step), row in counted.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return counted


def test_audit_counts_every_order(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "PART_BYTES", 4096)
    rows = texts()
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(40)] + [(5, 1, None), (None, 1, 1), (7, None, None)]
    out = filter_audit.audit(spark.createDataFrame(rows, DOCS).repartition(5), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in out.collect()}
    assert got == audit_by_hand(rows, labels) and out.count() == 600 * len({r[2] for r in rows})


def test_audit_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit(spark.createDataFrame([], DOCS), labels).count() == 0
    assert {r["kept"] for r in filter_audit.audit(spark.createDataFrame([(1, "a " * 80, None, 1, "")], DOCS), labels).where("step = 5").collect()} == {0}


def test_audit_shuffles_texts_once(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "PART_BYTES", 4096)
    df = filter_audit.facts(spark.createDataFrame(texts(), DOCS))
    df.collect()
    assert df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("ReusedExchange") == 1


def top_by_hand(rows, k=5):
    whole = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, a) in enumerate(whole):
        if q % 50 == 0:
            found = sorted((-int(a @ b), c) for other, (c, b) in enumerate(whole) if other != at and len(a) == len(b))[:k]
            out += [(q, rank, c, -s) for rank, (s, c) in enumerate(found, 1)]
    return sorted(out)


def vectors(n=900, d=6, seed=5):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(7, d)) * [[0.2], [1], [3], [0.1], [1], [2], [1]]
    rows = [(i, [float(x) for x in centers[i % 7] + rng.normal(size=d) * 0.1], "x") for i in range(n)]
    same = rows[3][1]
    rows += [(1000 + i, same, "hot") for i in range(450)]  # a third of all rows
    rows += [(50, rows[50][1], "again"), (50, rows[51][1], "again"), (2000, None, ""), (2050, [1.0, None] * 3, ""), (2100, [float("nan")] * d, ""), (2150, [float("inf")] * d, ""), (None, rows[1][1], "")]
    return rows + [(3000, [], ""), (3001, [], ""), (3050, [1.0, 2.0], ""), (3100, [3.0, -2.0], ""), (4000, [0.0] * d, "")]


@pytest.mark.parametrize("shard", [40, 4096])
def test_top_k_equals_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(ball_tree, "SHARD", shard)
    monkeypatch.setattr(ball_tree, "QUERIES", 8)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, row string").repartition(3)
    single = [(i, v if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v, _ in rows]
    assert sorted(tuple(r) for r in ball_tree.search(df, F.col("vec_id") % 50 == 0).collect()) == top_by_hand(single)


def test_top_k_without_queries_or_rows(spark):
    for rows in ([], [(1, [1.0])], [(None, [1.0])], [(50, None)], [(50, [1.0])]):
        assert ball_tree.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), F.col("vec_id") % 50 == 0).count() == 0


def test_trees_drop_what_cannot_win():
    rng = np.random.default_rng(1)
    v = np.round(rng.normal(size=(5000, 3)) * 200 + np.repeat(rng.normal(size=(50, 3)) * 4000, 100, axis=0)).astype(np.int64)
    q, ids = v[:20], np.arange(5000)
    best = ball_tree.Best(5, np.full(20, np.iinfo(np.int64).min))
    ball_tree.search_shard(best, q, ids[:20], v, ids, ids)
    seen = len(ball_tree.Tree(v).leaves(q.astype(float), np.linalg.norm(q, axis=1), best.kth)[0])
    assert seen < 0.2 * 20 * 5000 / ball_tree.LEAF
    for i in range(20):
        assert [(-s, x) for s, x in zip(best.score[best.query == i], best.vec_id[best.query == i], strict=True)] == sorted((-int(q[i] @ v[j]), j) for j in range(5000) if j != i)[:5]


def test_products_of_large_integers():
    a = np.array([[2**40, 3], [1, 2**31]], np.int64)
    assert ball_tree.products(a, np.array([[2**20 + 1, 7]], np.int64)).tolist() == [[2**40 * (2**20 + 1) + 21], [2**20 + 1 + 7 * 2**31]]


def ranked_by_hand(docs, items, k=10):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(fold))
    held = [(d, cut(t)) for d, t, *_ in docs if cut(t)]
    n_docs, n_terms = len(held), sum(len(t) for _, t in held)
    df = Counter(x for _, t in held for x in set(t))
    out = []
    for item, text in items:
        scored = []
        for d, t in held:
            tf, m = Counter(t), 25 + (75 * len(t) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (1000000000 * tf[x] // (1000 * tf[x] + 8 * m)) for x in cut(text) if x in tf)
            if score > 0:
                scored.append((-score, d is None, d))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1 << 16, 4])
def test_ranking_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(lexical, "TERMS", block)
    docs = texts(9)
    docs += [(400 + i, "Alpha été\x7fÉTÉ w1.w1_w1 straße", "a", 1, "") for i in range(40)] + [(500, "w3 " * 100_000, "a", 1, "")]
    items = [(1, "alpha ALPHA w1 nothing"), (2, "été ÉTÉ straße"), (3, ""), (4, None), (None, "w3 w4 w5 w6 w7"), (1, "w9-w8"), (6, "%% ... ı missing"), (7, "alpha ALPHA w1 nothing")]
    out = lexical.search(spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(items, "item_id bigint, text string"))
    assert sorted((tuple(r) for r in out.collect()), key=str) == ranked_by_hand(docs, items)


def test_ranking_of_nothing(spark):
    none, one = spark.createDataFrame([], "item_id bigint, text string"), spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    empty, some = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "c", "s", 1, ""), (2, None, "s", 1, "")], DOCS)
    for docs, items in ((some, none), (empty, one), (some, one)):
        assert lexical.search(docs, items).count() == 0
