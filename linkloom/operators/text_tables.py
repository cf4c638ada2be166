"""Operators on page text: boilerplate lines, duplicates, sentences, languages and URL parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def line_shares(docs: DataFrame, key: str, text: str, least: int = 20) -> DataFrame:
    """line, documents, share: lines of ``least`` characters or more, once per document, over all documents."""
    total = docs.agg(F.count("*")).scalar()
    line = F.explode_outer(F.array_distinct(F.transform(F.split(text, "\n"), lambda x: F.trim(x)))).alias("line")
    rows = docs.select(key, line).where(F.length("line") >= least).groupBy("line").agg(F.count("*").alias("documents"))
    return rows.withColumn("share", F.round(F.col("documents") / total, 6))


def duplicate_groups(docs: DataFrame, key: str, text: str, language: str) -> DataFrame:
    """key, body_hash, copies, canonical (smallest key) of rows whose exact body repeats in a language; nulls group."""
    hashed = docs.select(key, F.sha2(text, 256).alias("body_hash"), F.col(language).alias("language"))
    groups = hashed.groupBy("body_hash", "language").agg(F.count("*").alias("copies"), F.min(key).alias("canonical")).where("copies > 1")
    groups = groups.select(F.col("body_hash").alias("_h"), F.col("language").alias("_l"), "copies", "canonical")
    same = F.col("body_hash").eqNullSafe(F.col("_h")) & F.col("language").eqNullSafe(F.col("_l"))
    return hashed.join(groups, same).select(key, "body_hash", "copies", "canonical")


def sentences(text: Column) -> Column:
    """Sentences: lines, then the gaps after . ! ? and the ellipsis."""
    parts = F.split(F.regexp_replace(text, "(?<=[.!?…])\\s+", "\n"), "\n")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def query_parameters(pages: DataFrame) -> DataFrame:
    """name, urls: query parameters and the number of urls that carry them."""
    query = F.regexp_extract("url", "\\?([^#]*)", 1)
    names = F.array_distinct(F.transform(F.split(query, "&"), lambda x: F.split_part(x, F.lit("="), F.lit(1))))
    return pages.select(F.explode_outer(names).alias("name")).where("name <> ''").groupBy("name").agg(F.count("*").alias("urls"))


def section(path: Column) -> Column:
    """First path segment of a key such as host/a/b, else an empty string."""
    return F.coalesce(F.get(F.split(path, "/"), F.lit(1)), F.lit(""))


def page_language(url: str, rules: DataFrame, pages: DataFrame) -> DataFrame:
    """url, language by the longest rule prefix that ends at a segment border; the rule table is small and joined by first host segment."""
    host = lambda c: F.split_part(c, F.lit("/"), F.lit(1))
    fits = (F.col(url) == F.col("prefix")) | F.col(url).startswith(F.concat("prefix", F.lit("/")))
    joined = pages.join(rules, (host(F.col(url)) == host(F.col("prefix"))) & fits, "left")
    return joined.groupBy(url).agg(F.max_by("rule_language", F.length("prefix")).alias("rule_language"))


def keyset_page(rows: DataFrame, keys: list[str], after: tuple | None, size: int) -> DataFrame:
    """The ``size`` rows after ``after`` in key order; the page size is the feature."""
    if after is not None:
        later = F.lit(False)
        for i, key in enumerate(keys):
            same = F.lit(True)
            for j in range(i):
                same = same & (F.col(keys[j]) == after[j])
            later = later | (same & (F.col(key) > after[i]))
        rows = rows.where(later)
    return rows.orderBy(*keys).limit(size)


def latest_per(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in ``order``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def boilerplate(docs: DataFrame, key: str, text: str, share: float = 0.2, navigation_share: float = 0.02, least: int = 20) -> DataFrame:
    """line: template lines that are boilerplate by their share of the documents; navigation (links alone, list items, headings) needs less.

    Link targets are blanked first, so that one menu line counts once whatever page it stands on.
    """
    total = docs.agg(F.count("*")).scalar()
    blank = lambda x: F.regexp_replace(F.trim(x), "\\]\\([^)]*\\)", "]()")
    lines = F.explode_outer(F.array_distinct(F.transform(F.split(text, "\n"), blank))).alias("line")
    per = docs.select(key, lines).where(F.length("line") >= least).groupBy("line").agg(F.count("*").alias("documents"))
    navigation = F.col("line").rlike("^(?:[-*+]\\s|#{1,6}\\s|[0-9]+[.)]\\s|\\[[^\\]]*\\]\\(\\)$)")
    ratio = F.col("documents") / total
    return per.select("line", "documents", F.round(ratio, 6).alias("share"), navigation.alias("navigation")).where((ratio >= share) | (F.col("navigation") & (ratio >= navigation_share)))


def exclusion_reason(url: Column, link_words: Column, words: Column, links: Column, excluded: Column) -> Column:
    """Why a page is left out: sitemap, tenant_path, mostly_links (five links or more with four fifths of the words), or null."""
    from linkloom.functions.url import is_sitemap

    return F.when(is_sitemap(url), "sitemap").when(excluded, "tenant_path").when((links >= 5) & (link_words >= 0.8 * words), "mostly_links")


def canonical_copies(pages: DataFrame) -> DataFrame:
    """page, duplicate_group, is_canonical of pages that share body_hash and language: indexable first, then most inbound, shortest url, url.

    Pages have page, url, body_hash, language, indexable and inbound. The group is the smallest page in it.
    """
    sizes = pages.groupBy("body_hash", "language").agg(F.count("*").alias("n"), F.min("page").alias("g")).where("n > 1 and body_hash is not null")
    sizes = sizes.select(F.col("body_hash").alias("_h"), F.col("language").alias("_l"), "g")
    rows = pages.join(sizes, (F.col("body_hash") == F.col("_h")) & F.col("language").eqNullSafe(F.col("_l")))
    best = rows.groupBy("g").agg(F.min(F.struct((~F.coalesce("indexable", F.lit(False))).alias("a"), (-F.coalesce("inbound", F.lit(-1))).alias("b"), F.length("url").alias("c"), "url")).alias("b"))
    joined = rows.join(best.select(F.col("g"), F.col("b.url").alias("first")), "g")
    return joined.select("page", F.col("g").alias("duplicate_group"), (F.col("url") == F.col("first")).alias("is_canonical"))


def crawl_duplicates(pages: DataFrame) -> DataFrame:
    """One crawled row per url key: answered 200 first, then https, then the shortest url, then url. Pages have url_key, url and status."""
    order = F.struct((F.col("status") != 200).alias("a"), (~F.col("url").startswith("https:")).alias("b"), F.length("url").alias("c"), F.col("url").alias("d"))
    kept = pages.where("url_key is not null").groupBy("url_key").agg(F.min_by(F.struct("url", "status"), order).alias("r"), F.count("*").alias("copies"))
    return kept.select("url_key", "r.url", "r.status", "copies")


def title_affixes(titles: DataFrame, title: str, share: float = 0.3, least: int = 2) -> DataFrame:
    """(side, text, titles): the first and the last title segment that a brand leaves, where ``share`` of the titles carry it.

    Segments stand between a bar, hyphen, dash or double colon with spaces; they count by key and show as written most often.
    """
    from linkloom.functions.terms import term_key

    shown = F.trim(F.regexp_replace(title, "\\s+", " "))
    known = titles.where(F.trim(title) != "").select(F.split(shown, " (?:\\||-|\u2013|\u2014|::) ").alias("s"))
    total = known.agg(F.count("*")).scalar()
    ends = known.where(F.size("s") > 1).select(F.explode(F.array(F.struct(F.lit("first").alias("side"), F.trim(F.get("s", F.lit(0))).alias("text")), F.struct(F.lit("last").alias("side"), F.trim(F.element_at("s", -1)).alias("text")))).alias("x"))
    ends = ends.select("x.*").where("text <> ''").withColumn("k", term_key(F.col("text")))
    counted = ends.groupBy("side", "k", "text").agg(F.count("*").alias("n"))
    keys = counted.groupBy("side", "k").agg(F.sum("n").alias("titles"), F.min(F.struct((-F.col("n")).alias("n"), "text")).alias("w"))
    best = keys.groupBy("side").agg(F.min(F.struct((-F.col("titles")).alias("n"), "k", "w.text")).alias("b"))
    found = best.select("side", F.col("b.text").alias("text"), (-F.col("b.n")).alias("titles"))
    return found.where((F.col("titles") >= least) & (F.col("titles") >= share * total))


def merged_strategic(rows: DataFrame) -> DataFrame:
    """page, keyword, language, priority, is_primary: repeated keywords of a page as one, in ranks from 1 per page.

    Rows need a keyword and a language of two letters or more. The highest priority and any primary win; the text is that of
    the best row: primary, then priority, then key, then text.
    """
    from linkloom.functions.terms import term_key

    shown = F.trim(F.regexp_replace("keyword", "\\s+", " "))
    usable = rows.where((F.length("language") >= 2) & (shown != "")).select("page", shown.alias("text"), term_key(F.col("keyword")).alias("k"), "language", "priority", "is_primary")
    rank = F.struct((~F.col("is_primary")).alias("a"), (-F.coalesce("priority", F.lit(0))).alias("b"), F.col("k"), F.col("text"))
    one = usable.groupBy("page", "k", "language").agg(F.min_by("text", rank).alias("keyword"), F.max("priority").alias("priority"), F.max("is_primary").alias("is_primary"))
    by = Window.partitionBy("page").orderBy(F.col("is_primary").desc(), F.coalesce("priority", F.lit(0)).desc(), "k", "keyword", "language")
    return one.withColumn("rank", F.row_number().over(by)).select("page", "keyword", "language", "priority", "is_primary", "rank")


def usable_queries(rows: DataFrame, texts: DataFrame, brand: list[str], least: int = 50) -> DataFrame:
    """The search rows (page, query, impressions, ...) whose words all stand on their page and are not only the brand's.

    Words have two characters or more and compare by key; ``texts`` has page and text.
    """
    from linkloom.functions.terms import term_key

    words = lambda c: F.array_distinct(F.regexp_extract_all(term_key(c), F.lit("[\\p{L}\\p{N}_]+"), F.lit(0)))
    asked = rows.where(F.col("impressions") >= least).withColumn("_w", F.filter(words(F.col("query")), lambda w: F.length(w) >= 2))
    asked = asked.where((F.size("_w") > 0) & (F.size(F.array_except("_w", F.array(*[F.lit(b) for b in brand]) if brand else F.array().cast("array<string>"))) > 0))
    held = texts.select("page", words(F.col("text")).alias("_t")).join(asked.select("page").distinct(), "page", "left_semi")
    return asked.join(held, "page").where(F.size(F.array_except("_w", "_t")) == 0).drop("_w", "_t")


def hidden_links(links: DataFrame, share: float, seed: int, fold: int = 0) -> DataFrame:
    """The distinct links (source, target) that a fold hides: those whose hash falls into its part of the hash range.

    Hex digits of one length compare like the numbers they write, so the test is a string comparison.
    """
    bound = lambda x: f"{min(int(x * 2**256), 2**256 - 1):064x}"
    h = F.sha2(F.concat_ws("\t", F.lit(str(seed)), F.col("source").cast("string"), F.col("target").cast("string")), 256)
    pairs = links.select("source", "target").distinct().withColumn("_h", h)
    return pairs.where((F.col("_h") >= bound(fold * share)) & (F.col("_h") < bound((fold + 1) * share))).drop("_h")


def held_out_sources(pages: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """The sources that a seed holds out, by hash."""
    h = F.sha2(F.concat_ws("\t", F.lit(str(seed)), F.col(key).cast("string")), 256)
    return pages.select(key).distinct().where(h < f"{min(int(share * 2**256), 2**256 - 1):064x}")
