"""Batches, url variants, seeded negatives and digests against plain Python."""

import itertools
import random
from urllib.parse import parse_qsl, urlsplit

import pytest
from pyspark.sql import functions as F

from linkloom.operators import batches, digests, negatives, url_variants
from linkloom.sources.runs import Runs


def greedy(tokens, budget, most):
    out, start, total = [], 0, 0
    for i, n in enumerate(tokens):
        if i > start and (total + n > budget or i - start >= most):
            start, total = i, 0
        total += n
        out.append(start + 1)
    return out


@pytest.mark.parametrize(("n", "budget", "most", "block"), [(1, 5, 3, 4), (500, 100, 7, 16), (500, 100, 50, 16), (333, 60, 1, 8), (400, 10_000, 13, 13), (257, 30, 300, 64)])
def test_batches_equal_the_sequential_rule(spark, n, budget, most, block):
    rng = random.Random(n + most)
    tokens = [rng.choice([0, 1, 5, min(30, budget), rng.randrange(min(60, budget) + 1)]) for _ in range(n)]
    rows = spark.createDataFrame(list(enumerate(tokens)), "id bigint, tokens int").repartition(5)
    got = {r["id"]: (r["place"], r["batch"]) for r in batches.token_batches(rows, [F.col("id")], "tokens", budget, most, block).collect()}
    assert [got[i] for i in range(n)] == [(i + 1, b) for i, b in enumerate(greedy(tokens, budget, most))]


def test_batches_refuse_what_fits_nowhere(spark):
    rows = lambda *x: spark.createDataFrame(list(enumerate(x)), "id bigint, tokens int")
    for bad in ((1, 11), (1, -1), (1, None)):
        with pytest.raises(ValueError, match="outside"):
            batches.token_batches(rows(*bad), [F.col("id")], "tokens", 10, 5)
    with pytest.raises(ValueError, match="positive"):
        batches.token_batches(rows(1), [F.col("id")], "tokens", 0, 5)
    assert batches.token_batches(rows(1).limit(0), [F.col("id")], "tokens", 10, 5).count() == 0


def pairs_by_hand(crawl):
    seen, changed, same, groups = {}, {}, {}, {}
    for url, body in crawl:
        params = {k.lower(): v for k, v in parse_qsl(urlsplit(url or "").query)}
        for name in params:
            seen[name] = seen.get(name, 0) + 1
        if url and body:
            groups.setdefault(url.split("?")[0].split("#")[0], []).append((params, body))
    for own in groups.values():
        for (a, x), (b, y) in itertools.combinations(own, 2):
            names = [n for n in a.keys() | b.keys() if a.get(n) != b.get(n)]
            if len(names) == 1:
                kind = same if x == y else changed
                kind[names[0]] = kind.get(names[0], 0) + 1
    return {n: (c, changed.get(n, 0), same.get(n, 0)) for n, c in seen.items()}


def test_variants_of_one_parameter(spark):
    crawl = [
        ("https://e.test/blog", "h0"), ("https://e.test/blog?page=2", "h2"), ("https://e.test/blog?page=3#x", "h3"), ("https://e.test/post", "p"), ("https://e.test/post?utm_source=x", "p"),
        ("https://e.test/a?page=2&sort=x", "1"), ("https://e.test/a?page=3&sort=y", "2"), ("https://e.test/a?sort=x&PAGE=2", "1"), ("https://e.test/a?sort=%78&page=4", "9"), ("https://e.test/n?page=2", None), ("https://e.test/n", "h"),
        ("https://e.test/blog?page=", "h0"), ("https://e.test/blog?page=2&page=9", "z"), ("https://e.test/b?x=a+b&y", "q"), ("https://e.test/b?x=a%20c", "q"), (None, "n"), ("https://e.test/b", ""),
    ]
    rng = random.Random(4)
    crawl += [(f"https://e.test/hot?sid={rng.randrange(40)}&v={rng.randrange(3)}" + rng.choice(["", "&k=1"]), f"b{rng.randrange(4)}") for _ in range(300)]
    rows = spark.createDataFrame(crawl, "url string, body string").repartition(4)
    got = url_variants.evidence(rows, F.regexp_replace("url", "[?#].*$", ""))
    assert {r["name"]: (r["urls"], r["content_changed"], r["content_same"]) for r in got.collect()} == pairs_by_hand(crawl)
    keyed = url_variants.evidence(spark.createDataFrame([("http://www.e.test/x?a=1", "p"), ("https://e.test/x/", "q")], "url string, body string")).collect()
    assert [tuple(r) for r in keyed] == [("a", 1, 1, 0)]
    assert url_variants.evidence(rows.limit(0)).count() == 0


def test_permutation_repeats_nothing(spark):
    a, b = negatives.permuted(F.col("id"), 5, 7)
    rows = spark.range(1 << 10).select(a.alias("a"), b.alias("b")).collect()
    assert {(r["a"], r["b"]) for r in rows} == {(i, j) for i in range(32) for j in range(32)} and sum(r["a"] * 32 + r["b"] == i for i, r in enumerate(rows)) < 20


def test_negatives_do_not_depend_on_partitions(spark):
    pages = spark.createDataFrame([(i * 3,) for i in range(50)] + [(None,), (0,)], "page bigint")
    related = spark.createDataFrame([(i * 3, j * 3) for i in range(50) for j in range(0, 50, 2)] + [(None, 3)], "source bigint, target bigint")
    runs = [sorted(tuple(r) for r in negatives.negative_pairs(pages.repartition(n), related.repartition(7 - n), count=300, seed=1).collect()) for n in (1, 5)]
    assert runs[0] == runs[1] and len(runs[0]) == len({r[1:] for r in runs[0]}) == 300
    assert all(s != t and t % 6 == 3 for _, s, t in runs[0])
    other = negatives.negative_pairs(pages, related, count=300, seed=2).collect()
    assert {(r["source"], r["target"]) for r in other} != {r[1:] for r in runs[0]}
    # With draws for all pairs there are, every free pair is found.
    assert negatives.negative_pairs(pages, related, count=100_000).count() == 50 * 25 - 25 and negatives.negative_pairs(pages.limit(0), related).count() == 0


@pytest.mark.parametrize(("block", "levels", "roots"), [(4, 2, True), (4, 3, True), (4, None, False), (300, None, False)])
def test_digest_of_more_rows_than_the_levels_hold(spark, block, levels, roots):
    import hashlib

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    tree, up = [sha(f"{len(str(i))}:{i}") for i in range(203)], 0
    while up < levels if levels else len(tree) > 1:
        tree, up = [sha("".join(tree[i : i + block])) for i in range(0, len(tree), block)], up + 1
    rows = spark.createDataFrame([(i,) for i in range(203)], "id bigint").repartition(3)
    assert tuple(digests.table_digest(rows, ["id"], ["id"], block, levels, roots).first()) == (203, max(tree))


def test_digest_of_a_table(spark, tmp_path):
    rows = [(i, f"t{i}" if i % 5 else None, i / 3) for i in range(200)] + [(3, "again", None), (3, "again", None), (None, "", 0.0)]
    frame = lambda r, n=3: spark.createDataFrame(r, "id bigint, text string, x double").repartition(n)
    digest = lambda d, block=16: tuple(digests.table_digest(d, ["id"], ["id", "text", "x"], block).first())
    assert digest(frame(rows)) == digest(frame(rows[::-1], 7)) and digest(frame(rows))[0] == 203
    changed = [(r[0], r[1], 0.5) if r[0] == 150 else r for r in rows]
    assert len({digest(frame(x)) for x in (rows, changed, rows[:-1], [(i, "" if t is None else t, x) for i, t, x in rows])}) == 4
    assert digest(frame([], 1))[0] == 0
    with pytest.raises(ValueError, match="levels"):
        digest(frame(rows), 5)
    runs, built = Runs(spark, f"file://{tmp_path}"), []

    def stage(r, **parameters):
        inputs = [digests.table_digest(frame(r), ["id"], ["id", "text", "x"])]
        out, fresh = digests.unless_known(runs, "sizes", parameters, inputs, lambda: built.append(1) or frame(r).groupBy("text").count())
        return out.count(), fresh

    assert [stage(rows), stage(rows[::-1]), stage(changed), stage(rows, k="2")] == [(163, True), (163, False), (163, True), (163, True)] and len(built) == 3
