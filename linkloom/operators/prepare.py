"""Crawled rows to pages and links: usable rows, one row a key, boilerplate, cleaned texts, template links, exclusions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import markdown as M
from linkloom.functions.url import url_key
from linkloom.operators.text_tables import crawl_duplicates, exclusion_reason
from linkloom.plans.scratch import materialize

CLEAN = (
    "url_key string, url string, title string, h1 string, headings array<struct<level:int,text:string>>, body string, "
    "links array<struct<target:string,anchor:string,around:string,internal:boolean>>, template array<struct<target:string,zone:string>>"
)


def skip_reason(status: Column, usable: Column, content: Column, key: Column) -> Column:
    """Why a crawled row is no page: no_key, status, unusable, empty; null for a page."""
    return F.when(key.isNull(), "no_key").when(~F.coalesce(status == 200, F.lit(False)), "status").when(~F.coalesce(usable, F.lit(False)), "unusable").when(F.trim(F.coalesce(content, F.lit(""))) == "", "empty")


def template_lines(pages: DataFrame, share: float = 0.2, navigation: float = 0.02, least: int = 20) -> DataFrame:
    """line, documents, share, navigation: template keys of boilerplate lines, one count per page that holds the line."""
    total = pages.agg(F.count("*")).scalar()

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = [k for text in batch["content"] for k in {M.template_key(x) for x in (text or "").splitlines() if len(x.strip()) >= least}]
            yield pd.DataFrame({"line": pd.Series(keys, dtype=object)})

    per = pages.select("content").mapInPandas(parse, "line string").groupBy("line").agg(F.count("*").alias("documents"))

    def navigates(values: pd.Series) -> pd.Series:
        return values.map(M.is_navigation)

    own = F.pandas_udf(navigates, "boolean")
    rows = per.where(F.col("documents") / total >= navigation).select("line", "documents", (F.col("documents") / total).alias("share"), own("line").alias("navigation"))
    return rows.where((F.col("share") >= share) | F.col("navigation"))


def clean_pages(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """The columns of ``CLEAN`` per page. Template lines reach the tasks as one list: a line on a fiftieth of the pages or more, so a bounded number of them."""
    known = frozenset(r["line"] for r in lines.select("line").collect())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                c = M.clean(r.content or "", r.url, known)
                out.append((r.url_key, r.url, M.clean_meta(r.title), c.h1, [{"level": a, "text": b} for a, b in c.headings], c.body,
                            [{"target": t, "anchor": a, "around": s, "internal": i} for t, a, s, i in c.links], [{"target": t, "zone": z} for t, z in c.template]))
            yield pd.DataFrame(out, columns=["url_key", "url", "title", "h1", "headings", "body", "links", "template"])

    return pages.select("url_key", "url", "title", "content").mapInPandas(run, CLEAN)


def template_inlinks(cleaned: DataFrame) -> DataFrame:
    """url_key, menu, footer: distinct other pages that link to a page from each zone."""
    rows = cleaned.select("url_key", F.explode("template").alias("t")).select("url_key", url_key(F.col("t.target")).alias("target"), "t.zone").where("target is not null and target <> url_key").distinct()
    return rows.groupBy(F.col("target").alias("url_key")).agg(F.count_if(F.col("zone") == "menu").alias("menu"), F.count_if(F.col("zone") == "footer").alias("footer"))


def followed_links(cleaned: DataFrame) -> DataFrame:
    """(source, target) keys of the links that a crawler follows: internal ones in the body, and those of the template."""
    body = cleaned.select("url_key", F.explode("links").alias("x")).where("x.internal").select("url_key", F.col("x.target").alias("t"))
    rest = cleaned.select("url_key", F.explode("template").alias("x")).select("url_key", F.col("x.target").alias("t"))
    return body.unionByName(rest).select(F.col("url_key").alias("source"), url_key(F.col("t")).alias("target")).where("target is not null and source <> target").distinct()


def prepare(crawl: DataFrame, excluded_paths: tuple[str, ...] = (), share: float = 0.2, navigation: float = 0.02) -> dict[str, DataFrame]:
    """``pages``, ``links``, ``excluded`` and ``skipped`` of a crawl (url, title, content, status, usable).

    Of rows with one key the best is kept before anything is cleaned. Texts are read twice: for lines and for cleaning.
    """
    from linkloom.functions.url import under_paths

    keyed = materialize(crawl.withColumn("url_key", url_key(F.col("url"))).withColumn("reason", skip_reason(F.col("status"), F.col("usable"), F.col("content"), F.col("url_key"))), "crawl-keyed")
    skipped = keyed.where("reason is not null").groupBy("reason").agg(F.count("*").alias("rows"))
    usable = keyed.where("reason is null")
    best = crawl_duplicates(usable.select("url_key", "url", "status")).select("url_key", "url")
    pages = materialize(usable.dropDuplicates(["url_key", "url"]).join(best, ["url_key", "url"]), "crawl-pages")
    lines = materialize(template_lines(pages, share, navigation), "template-lines")
    cleaned = materialize(clean_pages(pages, lines), "cleaned")
    count = lambda c: F.size(F.filter(F.split(c, "\\s+"), lambda w: w != ""))
    linked = F.aggregate("links", F.lit(0), lambda a, x: a + count(x["anchor"]))
    out = under_paths(F.col("url_key"), list(excluded_paths)) if excluded_paths else F.lit(False)
    judged = cleaned.withColumn("words", count(F.col("body"))).withColumn("why", exclusion_reason(F.col("url_key"), linked, F.col("words"), F.size("links"), out))
    kept = judged.where("why is null")
    inlinks = template_inlinks(kept)
    rows = kept.join(inlinks, "url_key", "left").select(
        "url_key", "url", "title", "h1", "headings", "body", "words", F.sha2("body", 256).alias("body_hash"), F.coalesce("menu", F.lit(0)).alias("menu"), F.coalesce("footer", F.lit(0)).alias("footer")
    )
    links = kept.select(F.col("url_key").alias("source"), F.posexplode("links").alias("position", "x")).select("source", "position", url_key(F.col("x.target")).alias("target"), "x.anchor", "x.around", "x.internal")
    return {"pages": rows, "links": links, "excluded": judged.where("why is not null").select("url_key", "why"), "skipped": skipped}
