"""Operators against brute force, planted cases and odd inputs: nulls, empty and long texts, ties, repeats, clashing columns."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.llm import decontaminate, html_extract, mixing, neardup, pii, pu_quality, quality_rules, queries, toxicity, url_filter, warc
from linkloom.llm.superminhash import EMPTY, _draw, signatures

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _words string, n_words long, kept string"


def prose(seed, n=120):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(n))


def documents(spark, texts, **more):
    """Rows with columns whose names clash with the operators' own; ids from 0, one source of two thirds of the rows."""
    rows = [(i, t, "en" if i % 4 else None, "a" if i % 3 else None, len(t or ""), "x", 1, "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


ODD = [None, "", " \t\n", "one", "four words are here", "Ünïcode \U0001f600 " * 30, "x " * 40_000, "same\nsame\nsame\nline of five words\nline of five words"]


# 1


def base_counts(t):
    t = t or ""
    w = WORD.findall(t)
    grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_verdicts(spark):
    texts = ODD + [prose(i) for i in range(10)] + [prose(1) + " " + prose(1)]
    labels = spark.createDataFrame([(0, None), (9, 1), (9, 0), (10, 1), (99, 1)], "doc_id long, quality int")
    docs = documents(spark, texts)
    got = {r["doc_id"]: r for r in quality_rules.judge(docs, labels).collect()}
    for i, t in enumerate(texts):
        r, want = got[i], base_counts(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert r["base_failed"] == failed and r["kept"] == (not failed)  # too few labels certify nothing
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got.values())
    assert quality_rules.judge(docs.limit(0), labels.limit(0)).count() == 0


def test_quality_cutoffs_respect_the_risk(spark):
    row = lambda i, s, y: (i, "en", i, 1000, s, 0, 500, 200, 10, 0, 0, False, y)
    rows = [row(i, 0 if i % 500 else 60, 1) for i in range(4000)] + [row(5000 + i, 350, 0) for i in range(300)]
    schema = "doc_id long, lang string, body long, word_chars long, n_symbols long, n_upper long, n_words long, n_distinct_words long, n_lines long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality int"
    data = spark.createDataFrame(rows, schema)
    measured, labels = data.drop("quality"), data.select("doc_id", "quality")
    cut = quality_rules.fit(measured, labels).collect()
    assert len(cut) == 1 and cut[0]["cut_symbols"] == 0.3 and cut[0]["cut_dup_lines"] is None
    assert quality_rules.fit(measured.limit(0), labels).count() == 0
    # Copies of one good text are one trial: the rest is too few to certify anything.
    copies = measured.withColumn("body", F.when(F.col("doc_id") < 3900, F.lit(0)).otherwise(F.col("body")))
    assert quality_rules.fit(copies, labels).count() == 0


def test_exact_binomial_tail(spark):
    cases = [(50, 0), (400, 1), (2000, 9), (100, 30), (1, 0)]
    rows = spark.createDataFrame(cases, "n long, k long").select("n", "k", quality_rules._tail(F.col("n"), F.col("k"), 0.01).alias("t")).collect()
    for r in rows:
        exact = sum(math.comb(r["n"], i) * 0.01**i * 0.99 ** (r["n"] - i) for i in range(r["k"] + 1))
        assert r["t"] == pytest.approx(exact if r["k"] < r["n"] * 0.01 else 1.0, rel=1e-9)


# 2


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<aside><p>Aside</p></aside><article><h1>Head &amp; line</h1><p><b>First&nbsp; par<br>again<p>Short.</p><div class="ad">Buy now</div>
<form><p>Mail me</p></form><p>Last &lt;one&gt;</p></article><section id="comments"><article class="comment"><p>First!</p></article></section><footer>(c)</footer></body></html>"""


def test_html_article():
    assert html_extract.main_text(PAGE) == "Head & line\nFirst par again\nShort.\nLast <one>"


def test_html_without_container_uses_line_blocks():
    links = "".join(f"<li><a href=/{i}>menu {i}</a></li>" for i in range(8))
    body = "".join(f"<p>{prose(i, 30)}</p>" for i in range(6))
    got = html_extract.main_text(f"<body><ul>{links}</ul><div>{body}</div><ul>{links}</ul></body>")
    assert got == "\n".join(prose(i, 30) for i in range(6))


def test_html_short_lines_between_stretches():
    long = [(prose(i, 200)[:n]).strip() for i, n in enumerate((400, 400, 300, 500))]
    items = [f"item {i} text" for i in range(6)]
    tags = lambda tag, xs: "".join(f"<{tag}>{x}</{tag}>" for x in xs)
    links = "".join(f"<li><a href=/{i}>menu {i}</a></li>" for i in range(8))
    got = html_extract.main_text(f"<ul>{links}</ul><div>{tags('p', long[:2])}<ul>{tags('li', items)}</ul><p>{long[2]}</p><ul>{links}</ul><p>{long[3]}</p></div><ul>{links}</ul>")
    assert got == "\n".join([*long[:2], *items, *long[2:]])
    two = html_extract.main_text(f"<article><p>{long[0]}</p></article>{tags('p', items)}<article><p>{long[2]}</p><p>End.</p></article>")
    assert two == "\n".join([long[0], long[2], "End."])


def test_html_odd_rows(spark):
    pages = [(1, None, None), (2, "u", ""), (3, "u", "a < b"), (4, "u", "<p>" + "word " * 20000), (4, "u", "<<<"), (5, "u", "<div class='x>y<p>z")]
    got = html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()
    assert len(got) == 6 and all(r["n_chars"] == len(r["text"]) for r in got)
    by = {r["page_id"]: r["text"] for r in got if r["page_id"] != 4}
    assert by[1] == by[2] == "" and by[3] == "a < b"
    assert max(r["n_chars"] for r in got) == 99999


def test_html_unclosed_and_marked_elements():
    long = [prose(i, 30) for i in range(4)]
    text = html_extract.main_text
    assert text(f"<body><div><p class='ad'>Buy<p>{long[0]}<p>{long[1]}</div>") == f"{long[0]}\n{long[1]}"
    assert text(f"<article><p class='ad'>Buy<p>{long[0]}<p>End.</article><p>after</p>") == f"{long[0]}\nEnd."
    assert text(f"<div class='ad'>Buy<article><p>{long[0]}</p></article>") == long[0]
    assert text(f"<ul><li class='ad'>Buy<li>{long[0]}<li>{long[1]}</ul>") == f"{long[0]}\n{long[1]}"
    assert text(f"<table><tr><td>{long[0]}<td>{long[1]}<tr><td>{long[2]}</table>") == "\n".join(long[:3])
    related = f"<section class='related-work'><p>{long[1]}</p><p>{long[2]}</p></section>"
    share = "<div class='share'><a href=/x>Tweet this page</a></div><div class='search-box'>Find</div>"
    assert text(f"<article><p>{long[0]}</p>{related}{share}<p>{long[3]}</p></article>") == "\n".join(long)
    assert text(f"<div class='with-sidebar'><p>{long[0]}</p><p>{long[1]}</p></div><div class='sidebar'>Side</div>") == f"{long[0]}\n{long[1]}"
    assert text(f"<form id=page><div><p>{long[0]}</p></div></form>") == long[0]
    assert text(f"<article><p>{long[0]}</p></article><form><p>Name</p></form><div id=comments><p>{long[1]}</p><p>{long[2]}</p></div>") == long[0]
    assert text("<p><a>" * 20_000 + "<b>" * 20_000 + "</p></i>" * 20_000 + "<div class=ad>" * 20_000 + f"<p>{long[0]}") == long[0]


def brute_stretches(lengths, window=html_extract.WINDOW, surge=html_extract.SURGE):
    """Lines that lie in a window of text from a surge to its dive, short ends off."""
    high = [sum(lengths[i : i + window]) >= surge for i in range(len(lengths))]
    kept, i = set(), 0
    while i < len(lengths):
        if high[i]:
            j = i
            while j < len(lengths) and high[j]:
                j += 1
            run = list(range(i, min(len(lengths), j + window - 1)))
            while run and run[-1] > j and lengths[run[-1]] < surge / window:
                run.pop()
            if run[-1] == j and lengths[j] < surge / window:
                run.pop()
            while run[0] < j and lengths[run[0]] < surge / window:
                run.pop(0)
            kept |= set(run)
            i = j
        i += 1
    return kept


def test_html_line_blocks_match_brute_force():
    rng = np.random.default_rng(8)
    for _ in range(300):
        lengths = [int(n) for n in rng.choice([1, 5, 15, 25, 60, 200], rng.integers(1, 25))]
        got = {i for a, b in html_extract.stretches([float(n) for n in lengths]) for i in range(a, b)}
        assert got == brute_stretches(lengths)
        lines = [("x" * n, 0, -1) for n in lengths]
        want = range(min(got), max(got) + 1) if got else range(len(lengths))
        assert html_extract.kept_lines(lines) == list(want)


def test_html_of_the_pages(spark):
    """Every page of the driver's table has one article; its blocks, read off the raw html, are the text."""
    import html as references

    def truth(page):
        inner = page[page.index("<article>") + 9 : page.index("</article>")].replace("<br>", " ")
        blocks = (" ".join(references.unescape(re.sub("<[^>]+>", "", x)).split()) for x in re.split("</?(?:p|h1)>", inner))
        return "\n".join(x for x in blocks if x)

    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.queries()["op2_html_extraction"](spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r["text"] == truth(pages[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


# Ids

BIG = 2**60


def test_ids_keep_every_digit(spark):
    """Ids above 2**53, and a null id in the same batch, in every operator that runs Python."""
    ids = [BIG + 1, None, BIG + 3, BIG + 5]
    docs = spark.createDataFrame([(i, prose(1), "en", "a", 9) for i in ids], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    labels = spark.createDataFrame([(BIG + 1, 1, 0), (BIG + 3, 0, 1)], "doc_id long, quality int, toxic int")
    same = lambda rows: sorted((r[0] for r in rows), key=str) == sorted(ids, key=str)
    assert same(pu_quality.score(docs, pu_quality.fit(docs, labels)).collect())
    assert same(toxicity.score(docs, toxicity.fit(docs, labels)).collect())
    assert same(mixing.mix(docs).collect())
    assert same(mixing.mixed(docs).select("doc_id").distinct().collect())
    assert same(neardup.groups(docs).collect())
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://a/b").alias("url"), F.col("text").alias("html"))
    assert same(html_extract.extract(pages).collect())
    back = warc.round_trip(pages).collect()
    assert same(back) and {r["refers_to"] for r in back} == {None, BIG + 1}
    assert sorted(r["record_type"] for r in back) == ["response", "revisit", "revisit", "revisit"]


def test_empty_tables_and_long_texts(spark):
    long = "word " * 300_000
    docs = spark.createDataFrame([(1, long), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    none = docs.limit(0)
    for score, fit in ((pu_quality.score, pu_quality.fit), (toxicity.score, toxicity.fit)):
        assert score(none, fit(none, labels)).count() == 0
        assert all(0 <= r["score"] <= 1 for r in score(docs, fit(docs, labels)).collect())
    pages = spark.createDataFrame([(1, "http://a.org/" + "x" * 100_000, '<a href="http://b.org/">' * 20_000)], "page_id long, url string, html string")
    assert [r["verdict"] for r in url_filter.judge(pages).collect()] == ["allow"]
    assert html_extract.extract(pages.limit(0)).count() == 0


# 3


PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(x):
    total = 0
    for i, c in enumerate(reversed(x)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def base_list(t):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, e in PATTERNS.items() for m in e.finditer(t or "") if valid(k, m[0]))


def test_pii_base_spans(spark):
    texts = ODD + [
        "a@b.cc_x@d.ee\U0001f600 x@y@z.org, 1.2.3.4.5.6.7.8 and 300.1.1.1 or 001.002.0003.4", "4111 1111 1111 1111 4111-1111-1111-1112 5",
        "+1 (415) 555-0100. +12 +1.234.567.8901 1 ++49 30 123456 7", "é" * 9 + "me+tag%1@x-y.co.uk" * 3, "a" * 30_000 + "@" + "b." * 3000, "1" * 20_000 + " 1.1.1.1", "+" + "1(" * 5000,
    ]
    docs = documents(spark, texts)
    docs = docs.unionByName(docs.where("doc_id = 8")).withColumn("spans", F.lit("clash"))
    got = pii.find(docs).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        want = base_list(texts[r["doc_id"]])
        assert r["spans"] == want and r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] == len([x for x in want.split(",") if x])
    assert pii.find(docs.limit(0)).count() == 0


def test_pii_zero_octets(spark):
    texts = ["10.0.0.1 and 0.0.0.0", "127.0.0.1, 8.8.8.0", "000.00.0.255 not 0.0.0.256 or 0.0.00300.0", "0" * 4_000 + ".0.0.0", "0.0.0." + "0" * 4_000 + "256"]
    docs = documents(spark, texts)
    got = {r["doc_id"]: r for r in pii.find(docs).collect()}
    for i, t in enumerate(texts):
        assert got[i]["spans"] == base_list(t) and got[i]["n_ip"] == (2, 2, 1, 1, 0)[i]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert clean[0] == "[IP] and [IP]" and clean[1] == "[IP], [IP]" and clean[4] == texts[4]


def test_pii_terms_that_reveal_an_entity(spark):
    rare = [f"{prose(i, 20)} please ask Zanzibarov at boss@corp.example today {prose(100 + i, 20)}" for i in range(6)]
    plain = [f"{prose(200 + i, 40)} please ask at the desk today" for i in range(40)]
    docs = documents(spark, rare + plain)
    got = {r["doc_id"]: r for r in pii.find(docs).collect()}
    for i, t in enumerate(rare):
        at = t.index("Zanzibarov")
        assert got[i]["spans"].split(",")[1:] == [f"term:{at}:{at + 10}"]
    assert all(got[i]["spans"] == "" for i in range(6, 46))
    clean = {r["doc_id"]: r for r in pii.sanitise(docs).collect()}
    assert "Zanzibarov" not in clean[0]["text"] and "boss@" not in clean[0]["text"] and "please ask" in clean[0]["text"]
    assert all(clean[6 + i]["text"] == t for i, t in enumerate(plain)) and clean[0]["n_chars"] == len(clean[0]["text"])


def test_pii_terms_far_from_the_mention(spark):
    near = [f"{prose(i, 20)} Zanzibarov at boss@corp.example today" for i in range(3)]
    far = [f"Querubina {prose(300 + i, 400)} boss@corp.example {prose(400 + i, 400)} Zanzibarov" for i in range(3)]
    docs = documents(spark, near + far + [f"{prose(200 + i, 40)} today" for i in range(40)])
    got = {r["doc_id"]: r for r in pii.find(docs).collect()}
    for i, t in enumerate(near + far):
        want = [(t.index(w), t.index(w) + len(w)) for w in ("Querubina", "Zanzibarov") if w in t]
        assert set(want) <= {tuple(map(int, s.split(":")[1:])) for s in got[i]["spans"].split(",") if s.startswith("term:")}
    clean = [r["text"] for r in pii.sanitise(docs).where("doc_id < 6").collect()]
    assert not any(w in t for t in clean for w in ("Querubina", "Zanzibarov", "boss@"))


def brute_terms(texts):
    """(entity, term) -> disclosure, by definition; all texts differ."""
    rows = [(set(re.findall(r"[a-z]+@[a-z.]+", t)), set(re.findall(r"[A-Za-z]+", re.sub(r"[a-z]+@[a-z.]+", " ", t)))) for t in texts]
    df = collections.Counter(w for t in texts for w in set(re.findall(r"[A-Za-z]+", t)))
    of = collections.Counter(e for es, _ in rows for e in es)
    joint = collections.Counter((e, w) for es, ws in rows for e in es for w in ws if len(w) >= 3)
    n = len(texts)
    return {(e, w): math.log(k * n / (of[e] * df[w])) / math.log(n / of[e]) for (e, w), k in joint.items() if k >= 3 and of[e] < n}


def test_pii_disclosure_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghij"), 4)) for _ in range(60)]
    texts = []
    for i in range(90):
        own = [f"mark{i % 5}"[:4] + "vwxyz"[i % 5]] * (rng.random() < (0.9 if i % 3 == 0 else 0.1)) + [f"u{'vwxyz'[i % 5]}@m.org", "all@m.org"][: 1 + (i % 2)] * (i % 3 == 0)
        texts.append(" ".join(rng.permutation([*rng.choice(words, 25), *own, "every"])) + " id" + "".join(rng.choice(list("klmnop"), 9)))
    want = {k: v for k, v in brute_terms(texts).items() if v >= pii.GENERALISE}
    docs = documents(spark, texts)
    assert len(want) >= 3 and len(want) < len(brute_terms(texts))
    hits = pii.base_spans(docs)
    told = pii.mentions(hits)
    names = {e: docs.select(F.xxhash64(F.lit("email"), F.lit(e)).alias("h")).first()["h"] for e in {e for e, _ in brute_terms(texts)}}
    got = {(r["entity"], r["term"]): r["disclosure"] for r in pii.disclosing(hits, told, docs).collect()}
    assert got == pytest.approx({(names[e], w): v for (e, w), v in want.items()})


CLASH = ("_old", "_key", "removed", "generalised", "_row", "row", "k", "_text", "body", "kept", "size", "copies", "copy", "_words", "h", "component_id")


def test_stages_keep_columns_of_any_name(spark):
    """Columns named like the operators' own pass every stage with their values, and hold nothing else afterwards."""
    texts = [None, "", "call +1 415 555 0100 now", "x " * 9, prose(1), prose(1), prose(2) + " " + prose(3, 20)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in enumerate(texts)] + [(None, prose(4), None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    for i, c in enumerate(CLASH):
        docs = docs.withColumn(c, F.concat(F.lit(f"{i}:"), F.col("doc_id").cast("string")))
    labels = spark.createDataFrame([(4, 1)], "doc_id long, quality int")
    items = spark.createDataFrame([(0, prose(3, 20))], "item_id long, text string")
    stages = {
        "quality": (quality_rules.keep_good(docs, labels), {4, 5, 6, None}), "dedup": (neardup.keep_one(docs), {0, 1, 2, 3, 4, 6, None}),
        "leaks": (decontaminate.keep_clean(docs, items), {0, 1, 2, 3, 4, 5, None}), "pii": (pii.sanitise(docs), {0, 1, 2, 3, 4, 5, 6, None}),
    }
    for name, (out, ids) in stages.items():
        assert out.columns == docs.columns
        rows = out.collect()
        assert {r["doc_id"] for r in rows} == ids, name
        for r in rows:
            for i, c in enumerate(CLASH):
                assert r[c] == (None if r["doc_id"] is None else f"{i}:{r['doc_id']}")
    clean = {r["doc_id"]: r for r in stages["pii"][0].collect()}
    assert clean[0]["text"] is None and clean[2]["text"] == "call [PHONE] now" and clean[2]["n_chars"] == 16 and clean[1]["text"] == ""
    mixed = mixing.mixed(docs)
    assert mixed.columns == [*docs.columns, "copy_"] and all(r["_old"] == (None if r["doc_id"] is None else f"0:{r['doc_id']}") for r in mixed.collect())


# 4


def test_url_rules_and_propagation(spark):
    rows = [
        (1, "http://good.org/a", '<a href="http://mid.net/x">'), (2, "http://mid.net/x", "<A HREF='//bad.com/de/'>"), (3, "http://bad.com/de/1", ""), (4, "http://bad.com/x", None),
        (5, None, None), (6, "nourl", "x"), (7, "HTTP://EX.ORG?x", ""), (8, "http://farm.net/", '<a href="http://bad.com/de/1">' * 3), (9, "x://www.Example.org/en/12#f", ""), (9, "x://www.Example.org/en/12#f", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("verdict", F.lit("clash"))
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages).collect() if r["page_id"] != 9)
    assert got == [
        (1, "good.org", "/a", "org/", "allow"), (2, "mid.net", "/x", None, "allow"), (3, "bad.com", "/de/1", "com/de/", "block"), (4, "bad.com", "/x", None, "allow"),
        (5, "", "", None, "allow"), (6, "", "", None, "allow"), (7, "ex.org", "", None, "allow"), (8, "farm.net", "/", None, "allow"),
    ]
    assert [r["rule"] for r in url_filter.judge(pages).where("page_id = 9").collect()] == ["example.org/en/1"] * 2
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_walks_match_power_iteration(spark):
    rng = np.random.default_rng(6)
    hosts = [f"h{i}" for i in range(25)]
    weights = collections.Counter()
    for _ in range(70):
        a, b = rng.choice(25, 2, replace=False)
        weights[hosts[a], hosts[b]] += int(rng.integers(1, 4))
    seeds = {("trust", "h0"): 1.0, ("trust", "h3"): 0.25, ("distrust", "h5"): 0.5, ("distrust", "h0"): 0.1}
    want = {}
    for kind in ("trust", "distrust"):
        m = np.zeros((25, 25))
        for (a, b), w in weights.items():
            i, j = hosts.index(a), hosts.index(b)
            if kind == "trust":
                m[j, i] = w
            else:
                m[i, j] = w
        m = m / np.where(m.sum(axis=0) > 0, m.sum(axis=0), 1)
        s = np.array([seeds.get((kind, h), 0.0) for h in hosts])
        x = s.copy()
        for _ in range(500):
            x = s + 0.85 * m @ x
        want |= {(kind, h): v for h, v in zip(hosts, x, strict=True) if v > 0}
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in weights.items()], "source string, target string, weight long")
    rows = spark.createDataFrame([(k, h, v) for (k, h), v in seeds.items()], "kind string, host string, strength double")
    got = {(r["kind"], r["host"]): r["score"] for r in url_filter.propagate(edges, rows).collect()}
    assert got == pytest.approx(want, abs=2e-6)
    assert url_filter.propagate(edges, rows.limit(0)).count() == 0


def test_rules_of_equal_length(spark):
    rules = (("allow", "a.org", "/x"), ("block", "a.org", "/x"))
    pages = spark.createDataFrame([(1, "http://a.org/xy", None)], "page_id long, url string, html string")
    assert [r["verdict"] for r in url_filter.judge(pages, rules).collect()] == ["allow"]


def test_distrust_runs_against_links(spark):
    edges = spark.createDataFrame([("farm", "bad", 3), ("bad", "victim", 1), ("good", "friend", 1)], "source string, target string, weight long")
    seeds = spark.createDataFrame([("distrust", "bad", 1.0), ("trust", "good", 1.0)], "kind string, host string, strength double")
    got = {(r["kind"], r["host"]): r["score"] for r in url_filter.propagate(edges, seeds).collect()}
    assert got == pytest.approx({("distrust", "bad"): 1.0, ("distrust", "farm"): 0.85, ("trust", "good"): 1.0, ("trust", "friend"): 0.85})


# 5 and 10


def shingles(t, lower=True):
    w = WORD.findall((t or "").translate(LOWER) if lower else (t or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())


def test_containment_matches_brute_force(spark):
    items = [prose(i, n) for i, n in enumerate((9, 15, 40, 80, 200, 6))] + [None, "", "three word item", prose(2, 40)]
    cut = items[3].split()
    texts = ODD + [f"{prose(50 + i, 300)} {items[i]} {prose(80 + i, 3000)}" for i in range(6)]
    texts += [f"{prose(7, 50)} {' '.join(cut[:k])} {prose(8, 50)}" for k in (40, 60, 64, 65, 70)] + ["three word item", "Three WORD item more", items[4].upper()]
    docs = documents(spark, texts)
    docs = docs.unionByName(docs.where("doc_id = 9"))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").withColumn("n", F.lit("clash"))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()}
    sets = [shingles(t, lower=False) for t in items]
    want = {(i, j) for i, t in enumerate(texts) for j, s in enumerate(sets) if s and 100 * len(s & shingles(t, lower=False)) >= 75 * len(s)}
    assert got == want and len(want) > 10
    left = decontaminate.keep_clean(docs, bench)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == set(range(len(texts))) - {i for i, _ in want}
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def brute_components(texts):
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(texts))], [len(s) for s in sets]


def edited(seed, n, changes):
    words = prose(999, n).split()
    rng = np.random.default_rng(seed)
    for at in rng.choice(n, changes, replace=False):
        words[at] = f"edit{seed}x{at}"
    return " ".join(words)


@pytest.mark.parametrize("changes", [1, 4, 6])
def test_near_duplicates_match_brute_force(spark, changes):
    texts = ODD + ["ONE", "one ", prose(1), prose(1).upper(), prose(1) + " tail"] + [edited(i, 200, changes) for i in range(60)] + [edited(5, 200, changes)]
    docs = documents(spark, texts).withColumn("node", F.lit("clash"))
    got = {r["doc_id"]: r for r in neardup.groups(docs).collect()}
    root, size = brute_components(texts)
    assert [got[i]["component_id"] for i in range(len(texts))] == root
    assert [got[i]["n_shingles"] for i in range(len(texts))] == size
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())


def test_near_duplicates_of_nothing(spark):
    docs = documents(spark, ODD[:3])
    assert neardup.groups(docs.limit(0)).count() == 0
    assert all(r["kept"] and r["n_shingles"] == 0 for r in neardup.groups(docs.unionByName(docs)).collect())
    assert neardup.keep_one(docs).columns == docs.columns


def test_superminhash_equals_the_sequential_algorithm():
    size, elements = 16, np.random.default_rng(2).integers(0, 2**63, 40, dtype=np.uint64)
    for n in (1, 3, 40):
        want = np.full(size, EMPTY, dtype=np.uint64)
        for e in elements[:n]:
            order = list(range(size))
            for j in range(size):
                k, value = _draw(np.array([e]), j, size)
                order[j], order[int(k[0])] = order[int(k[0])], order[j]
                want[order[j]] = min(want[order[j]], value[0])
        assert (signatures(elements[:n], np.zeros(n, dtype=np.int64), 1, size)[0] == want).all()


# 6 and 9


def test_pu_quality_on_held_out_labels(spark):
    good = [prose(i, 60) for i in range(300)]
    bad = [" ".join(f"{w}$$$ ###" for w in prose(1000 + i, 60).split()) for i in range(60)]
    docs = documents(spark, good + bad + [None, ""])
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(360) if i % 2] + [(1, None)], "doc_id long, quality int")
    model = pu_quality.fit(docs, labels)
    assert 0.7 < model["prior"] < 0.95
    got = {r["doc_id"]: r["score"] for r in pu_quality.score(docs, model).collect()}
    assert np.mean([got[i] >= 0.3 for i in range(0, 300, 2)]) > 0.97 and np.mean([got[i] < 0.3 for i in range(300, 360, 2)]) > 0.9
    assert 0 <= got[360] <= 1 and got[360] == got[361]
    assert [r["score"] for r in pu_quality.score(docs, pu_quality.fit(docs, labels.limit(0))).limit(2).collect()] == [0.5, 0.5]


def test_toxicity_on_held_out_labels(spark):
    rude = ["idiot", "moron", "scum"]
    texts = [prose(i, 60) + (f" {rude[i % 3]} {rude[(i + 1) % 3]} end" if i % 4 == 0 else "") for i in range(400)] + [None, ""]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i] >= 0.7) == (i % 4 == 0) for i in held]) > 0.97
    assert got[400] == got[401] and 0 <= got[400] < 0.5
    assert all(r["score"] < 1e-6 for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).limit(3).collect())


def test_non_negative_risk_is_minimised():
    """The trained weights against the risk written out in plain Python: no small step lowers it."""
    rng = np.random.default_rng(1)
    good, bad = rng.normal(1.0, 1.0, (200, 2)), rng.normal(-1.5, 1.0, (60, 2))
    pos, unl = good[:100], np.vstack([good[100:], bad])
    one = lambda x: np.hstack([np.ones((len(x), 1)), x])
    prior, decay = 100 / 160, 3e-4

    def risk(w):
        soft = lambda z: math.log1p(math.exp(-abs(z))) + max(z, 0.0)
        f = lambda x: w[0] + w[1] * x[0] + w[2] * x[1]
        kept = sum(soft(-f(x)) for x in pos) / len(pos)
        rest = sum(soft(f(x)) for x in unl) / len(unl) - prior * sum(soft(f(x)) for x in pos) / len(pos)
        return prior * kept + max(0.0, rest) + decay / 2 * sum(x * x for x in w)

    w = pu_quality.train(one(pos), one(unl), prior, steps=3000)
    here = risk(w)
    for i in range(3):
        for step in (-0.05, 0.05):
            moved = w.copy()
            moved[i] += step
            assert risk(moved) > here - 1e-5
    assert np.mean([w @ x > 0 for x in one(good)]) > 0.9 and np.mean([w @ x < 0 for x in one(bad)]) > 0.8


def test_log_count_ratios_match_plain_counts(spark):
    """Grams and ratios against a count of character n-grams in plain Python."""
    texts = ["ab abc", "xyz ab", "", "abcabc", "ÄBC d"]
    owner, bucket = toxicity.grams(texts)
    for i, t in enumerate(texts):
        padded = f" {t.lower()} "
        distinct = {padded[j : j + n] for n in toxicity.ORDERS for j in range(len(padded) - n + 1)}
        own = bucket[owner == i]
        assert len(own) == len(distinct)  # no two of these few share a bucket
    rude = [prose(i, 30) + (" scumbag" * (i % 3 == 0)) for i in range(240)]
    docs = documents(spark, rude)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)], "doc_id long, toxic int")
    buckets, weights, _ = toxicity.fit(docs, labels)
    seen = [set(toxicity.grams([t])[1].tolist()) for t in rude]
    for b, w in zip(buckets.tolist(), weights.tolist(), strict=True):
        p = sum(b in s for i, s in enumerate(seen) if i % 3 == 0)
        q = sum(b in s for i, s in enumerate(seen) if i % 3)
        ratio = math.log((p + 1) / 82) - math.log((q + 1) / 162)
        assert abs(ratio) / math.sqrt(1 / (p + 1) + 1 / (q + 1)) >= 4 and (w == 0 or (w > 0) == (ratio * w / ratio > 0))
    for gram in ("scumb", "cumba"):
        own = set(toxicity.grams([gram])[1].tolist())
        assert own & set(buckets.tolist())


# 7


def test_warc_round_trip_and_repeatable_bytes(spark):
    same = "é" * 60
    rows = [(1, "http://a/\n b", same), (2, "u", same), (3, None, None), (4, "v", ""), (5, "w", "short"), (6, "w", "short"), (7, "x", "y" * 300_000), (None, "n", "null id"), (2, "u", same), (4001, "z", same)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages.repartition(3)).collect()), key=str)
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        again = html == same and page != 1
        want.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 1 if again else None))
    assert got == sorted(want, key=str)


def test_warc_files_do_not_depend_on_partitioning(spark, tmp_path):
    pages = spark.range(900).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h/"), "id").alias("url"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 40).alias("html"))
    found = []
    for n in (1, 5):
        root = f"file://{tmp_path}/{n}"
        rows = warc.write_archives(pages.repartition(n), root, shard_rows=300, roll_bytes=100_000).collect()
        found.append(sorted((r["name"], r["records"], r["bytes"], r["sha256"]) for r in rows))
        assert all(hashlib.sha256((tmp_path / str(n) / r["name"]).read_bytes()).hexdigest() == r["sha256"] and r["bytes"] <= 100_000 for r in rows)
        assert not list((tmp_path / str(n)).glob(".*.tmp"))
    assert found[0] == found[1] and len(found[0]) > 3
    assert warc.round_trip(pages.limit(0)).count() == 0


# 8


def water_fill(sizes, weights, total):
    limits, capped = {s: 2 * n for s, n in sizes.items()}, set()
    while True:
        open_ = [s for s in sizes if s not in capped]
        left, weight = total - sum(limits[s] for s in capped), sum(weights[s] for s in open_)
        target = {s: limits[s] if s in capped else left * weights[s] / weight for s in sizes}
        over = {s for s in open_ if target[s] > limits[s]}
        if not over:
            return target
        capped |= over


def independent_rates(size, target, cap=2):
    """The tilted rates of one source, by bisection of the multiplier on plain arrays."""
    mean, lo, hi = size.sum() / len(size), -1e4, 1e4
    rates = lambda lam: np.where(size > 0, np.minimum(cap, np.exp(np.minimum(60, lam * size / mean))), 0.0)
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (rates(mid) * size).sum() < target else (lo, mid)
    return rates(hi) if target < cap * size.sum() else np.where(size > 0, float(cap), 0.0)


def test_mixed_corpus_holds_the_copies(spark):
    docs = spark.createDataFrame([(i if i % 7 else None, prose(i, 5 + i % 40), "ab"[i % 5 == 0]) for i in range(300)], "doc_id long, text string, source string").repartition(5)
    plan = mixing.mix(docs).collect()
    rows = mixing.mixed(docs).collect()
    assert len(rows) == sum(r["copies"] for r in plan) and {r["copy"] for r in rows} <= {1, 2}
    words = collections.Counter()
    for r in rows:
        words[r["source"]] += len(r["text"].split())
    for r in plan:
        assert abs(words[r["source"]] - r["target"]) <= 45
    held = spark.createDataFrame([(None, "one two three", "a")] * 500 + [(None, "x " * 20, "a")] * 3, "doc_id long, text string, source string")
    assert mixing.mix(held).groupBy("size").agg(F.count_distinct("copies").alias("n")).select("n").distinct().collect()[0]["n"] == 1
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_mixing_meets_targets(spark):
    rng = np.random.default_rng(4)
    rows = [(i, prose(i, int(rng.integers(1, 90))), [None, "a", "b", "c", "é"][min(4, int(rng.integers(0, 9)) % 5)]) for i in range(1500)] + [(5000, None, "empty"), (5001, "", "empty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).repartition(3)
    got = mixing.mix(docs).toPandas()
    assert len(got) == len(rows)
    names = sorted({r[2] for r in rows if r[2]}, key=lambda s: s.encode()) + [None]
    sizes = {s: sum(len((r[1] or "").split()) for r in rows if r[2] == s) for s in names}
    target = water_fill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(sizes.values()))
    for s in names:
        part = got[got["source"].isna() if s is None else got["source"] == s]
        assert part["target"].iloc[0] == pytest.approx(target[s]) and part["source_size"].iloc[0] == sizes[s]
        assert abs(part["taken"].sum() - target[s]) <= max(part["size"])  # within a document of the target
        assert part["rate"].to_numpy() == pytest.approx(independent_rates(part["size"].to_numpy(), target[s]), abs=1e-6)
    assert (got["taken"] <= 2 * got["size"]).all() and set(got["copies"]) <= {0, 1, 2}
    again = mixing.mix(docs.repartition(7)).toPandas()
    key = lambda d: d.sort_values("doc_id")[["doc_id", "taken", "target"]].to_numpy().tolist()
    assert key(got) == key(again)
    assert mixing.mix(docs.limit(0)).count() == 0
