"""Cases that bounds and switches used to decide: deep nesting, very many matches, skewed ids, repeated rows in samples."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from linkloom.llm import html_extract, pii, pu_quality, sampling, warc


@pytest.mark.parametrize("depth", [3, 15, 16, 17, 200, 3000])
def test_boilerplate_is_cut_at_any_depth(depth):
    article = "<article><p>" + "The article has a long first paragraph with words in it. " * 5 + "</p><p>" + "And a second one that is as long as the first. " * 5 + "</p></article>"
    block = '<div class="newsletter"><p>' + "Subscribe to our letter and get news every week, for free, at once. " * 4 + "</p></div>"
    page = f"<body>{article}{'<div class=share>' * depth}{block}{'</div>' * depth}</body>"
    assert "Subscribe" not in html_extract.main_text(page) and html_extract.main_text(page).count("\n") == 1
    within = article.replace("</article>", f"{'<div class=share>' * depth}{block}{'</div>' * depth}<p>{'The end of the article is long enough to stay in it. ' * 4}</p></article>")
    got = html_extract.main_text(f"<body>{within}</body>")
    assert "Subscribe" not in got and "The end of" in got


def test_deep_elements_stay_linear():
    start = time.perf_counter()
    page = "".join(f'<div class="widget">line {i} of a deep page' for i in range(8000)) + "</div>" * 8000
    html_extract.main_text(page)
    assert time.perf_counter() - start < 20


def test_many_matches_in_one_text(spark):
    rng = random.Random(1)
    text = " ".join(str(rng.randrange(10**rng.randrange(1, 6))) for _ in range(400_000)) + " 4111 1111 1111 1111 é 10.2.3.4 " + "a@b.co " * 3000
    start = time.perf_counter()
    row = pii.base_spans(spark.createDataFrame([(1, text), (2, "1.2.3.4 x 5.6.7.8"), (3, None)], "doc_id long, text string")).where("doc_id = 1").first()
    assert time.perf_counter() - start < 120
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    assert [(s["start"], s["end"]) for s in row["email"]] == [m.span() for m in email.finditer(text)]
    digits = lambda m: re.sub("[^0-9]", "", m)
    luhn = lambda d: sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0
    cards = [m.span() for m in re.finditer(r"[0-9]([ -]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    assert [(s["start"], s["end"]) for s in row["card"]] == cards
    assert [s["value"] for s in row["ip"]] == ["10.2.3.4"]


def test_shards_are_even_whatever_the_ids(spark, tmp_path):
    ids = [*range(1000), 2**60, 2**62, -(2**61), *[7] * 300]
    rows = [(i, f"http://a.test/{k}", f"<p>{k % 900} text of some length to be compared, and more of it, so that it is long</p>") for k, i in enumerate(ids)] + [(None, None, f"n{k}") for k in range(90)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    runs = []
    for n in (1, 6):
        root = f"file://{tmp_path}/w{n}"
        runs.append(sorted((r["shard"], r["roll"], r["records"], r["sha256"]) for r in warc.write_archives(pages.repartition(n), root, shard_rows=100).collect()))
        back = warc.read_archives(spark.read.parquet(f"{root}/manifest"), root)
        assert back.count() == len(rows) and back.where("page_id = 7").count() == 301 and back.where(F.col("page_id") == 2**62).count() == 1
    assert runs[0] == runs[1]
    sizes = [n for s, _, n, _ in runs[0] if s >= 0]
    assert len(sizes) == 14 and max(sizes) == 100 and sum(n for s, _, n, _ in runs[0] if s < 0) == 90


def test_samples_are_bounded(spark):
    schema = "doc_id long, text string"
    null_ids = spark.createDataFrame([(None, f"t{i}") for i in range(5000)], schema)
    one_id = spark.createDataFrame([(1, f"t{i}") for i in range(5000)], schema)
    for docs in (null_ids, one_id):
        assert sampling.plain_sample(docs, 100).count() == 100 and sampling.plain_sample(docs, 9000).count() == 5000
    assert sampling.plain_sample(spark.createDataFrame([(1, "same")] * 5000, schema), 100).count() in (0, 100)
    first = [sorted(r["text"] for r in sampling.plain_sample(null_ids.repartition(n), 100).collect()) for n in (1, 7)]
    assert first[0] == first[1]
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert sampling.labelled_sample(one_id, labels, "quality", 50).count() == 50
    assert pu_quality.fit(one_id, labels, 50, 100)["prior"] > 0
