"""A tenant's stored tables over the driver's tables, and the same in DuckDB SQL.

Structure, ranks, depths and pillars are computed from the site's links and vectors; communities, status codes and
keywords, which a tenant brings along, are derived from ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators import graph, percentiles
from linkloom.plans import bitmap
from linkloom.plans.scratch import materialize
from linkloom.sources.site import search_rows, site_links, site_pages, table

STEPS = 5
_stored: dict[tuple[str, str, str], DataFrame] = {}


def _listing(spark: SparkSession, sf_dir: str) -> str:
    """The files of a folder with their lengths and times, so that a changed folder is another one."""
    where = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    return "|".join(sorted(f"{x.getPath().getName()}:{x.getLen()}:{x.getModificationTime()}" for x in found))


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What a stage of the tenant leaves behind for the queries after it: built by the first that asks, once per session and state of the folder."""
    key = (spark.sparkContext.applicationId, f"{sf_dir}|{_listing(spark, sf_dir)}", name)
    if key not in _stored:
        _stored[key] = materialize(build(), name)
    return _stored[key]


def strategic_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, keyword, language, priority, is_primary as a client's file might list them: repeated, unevenly spaced and cased."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        F.col("o_custkey").alias("page"), F.when(k % 2 == 0, F.lower("o_orderpriority")).otherwise(F.concat(F.lit("  "), "o_orderpriority")).alias("keyword"),
        F.when(k % 7 == 0, "").otherwise("en").alias("language"), F.when(k % 3 > 0, 1 + k % 5).cast("int").alias("priority"), (k % 11 == 0).alias("is_primary"),
    )


def strategic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strategic rows of the site's pages, stored. A bitmap of the pages decides at the scan, so a few rows of other pages may be left."""

    def build() -> DataFrame:
        return strategic_rows(spark, sf_dir).where(bitmap.may_contain(site(spark, sf_dir), "page", F.col("page").cast("bigint")))

    return stored(spark, sf_dir, "strategic-rows", build)


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search rows, stored: the events are read and summed once for all that asks for them."""
    return stored(spark, sf_dir, "search-rows", lambda: search_rows(spark, sf_dir))


def page_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = F.sum(F.col("impressions") * F.col("position")) / F.sum("impressions")
    return searches(spark, sf_dir).groupBy("page").agg(
        F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"), F.round(mean, 6).alias("avg_position"), F.count("*").alias("query_count")
    )


def site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The site's pages with their words in the place of the body, stored: documents are read and meet their embeddings once for all that asks for them."""
    words = F.size(F.array_remove(F.split("text", "[ \\t-\\r]+"), ""))
    derived = {"words": F.when(F.col("text").isNull(), 0).otherwise(words)}
    return stored(spark, sf_dir, "site-pages", lambda: site_pages(spark, sf_dir, derived).withColumn("page", F.col("page").cast("bigint")))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The site's links, stored."""
    return stored(spark, sf_dir, "site-links", lambda: site_links(spark, sf_dir, site(spark, sf_dir)))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The structure of every page: what the crawl and the graph stages leave behind."""
    return stored(spark, sf_dir, "tenant-pages", lambda: _pages(spark, sf_dir))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, linked = site(spark, sf_dir), links(spark, sf_dir)
    rank = graph.pagerank(linked, own, steps=STEPS, tolerance=None)
    known = materialize(own.select("page").join(rank.select("page", F.round("rank", 9).alias("rank")), "page"), "page-ranks")
    ranked = percentiles.share_below(known, "rank", "rank_percentile").drop("rank")
    edges = materialize(graph.crawled_edges(linked, own), "site-edges")
    depth = graph.crawl_depth(linked, own, [0], edges=edges)
    pillar = graph.hub_pillars(own).select("page", F.lit(True).alias("is_pillar"))
    base = own.select("page", "language", "hub", "words")
    for other in (graph.structure(linked, own, edges), ranked, depth, pillar):
        base = base.join(other, "page", "left")
    p = F.col("page")
    return base.select(
        "page", "language", "hub", "words", "inbound", "outbound", "rank_percentile", "depth", F.coalesce("is_pillar", F.lit(False)).alias("is_pillar"),
        F.lit(None).cast("boolean").alias("is_orphan"), F.when(p % 13 > 0, p % 5).cast("int").alias("link_community"),
        F.when(p % 4 > 0, p % 3).cast("int").alias("keyword_community"), F.when(p % 17 > 0, p % 7).cast("int").alias("content_community"),
    )


def _rank_sql() -> str:
    parts = ["r0 AS (SELECT page, 1.0 / n AS rank FROM nodes, node_count)"]
    for i in range(1, STEPS + 1):
        loose = f"(SELECT coalesce(sum(rank), 0.0) FROM r{i - 1} WHERE page NOT IN (SELECT source FROM outs))"
        got = f"(SELECT e.target, sum(r.rank / o.n) AS got FROM votes e JOIN outs o ON o.source = e.source JOIN r{i - 1} r ON r.page = e.source GROUP BY e.target)"
        parts.append(f"r{i} AS MATERIALIZED (SELECT x.page, 0.15 / s.n + 0.85 * (coalesce(g.got, 0.0) + {loose} / s.n) AS rank FROM nodes x CROSS JOIN node_count s LEFT JOIN {got} g ON g.target = x.page)")
    return ", ".join(parts)


#: To stand after ``site.SQL``.
SQL = f"""
, crawled AS (SELECT DISTINCT l.source, l.target FROM site_links l JOIN site_pages a ON a.page = l.source JOIN site_pages b ON b.page = l.target),
votes AS (SELECT DISTINCT source, target FROM site_links), nodes AS (SELECT page FROM site_pages UNION SELECT target FROM votes), node_count AS (SELECT count(*) AS n FROM nodes),
outs AS (SELECT source, count(*) AS n FROM votes GROUP BY source), {_rank_sql()},
rounded AS (SELECT r.page, round(r.rank, 9) AS rank FROM r{STEPS} r JOIN site_pages p ON p.page = r.page),
grid AS (SELECT page, floor(rank / ((SELECT max(rank) FROM rounded) * 1e-9) + 0.5) AS g FROM rounded),
percents AS (SELECT page, (rank() OVER (ORDER BY g) - 1) / count(*) OVER () AS rank_percentile FROM grid),
walk(page, depth) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT c.target, w.depth + 1 FROM walk w JOIN crawled c ON c.source = w.page WHERE w.depth < (SELECT count(*) FROM site_pages)),
depths AS (SELECT page, min(depth) AS depth FROM walk GROUP BY page),
vector_parts AS (SELECT page, hub, unnest(vector) AS x, generate_subscripts(vector, 1) AS i FROM site_pages WHERE hub >= 0),
unit_parts AS (SELECT page, hub, i, x / sqrt(sum(x * x) OVER (PARTITION BY page)) AS x FROM vector_parts),
centres AS (SELECT hub, i, avg(x) AS m FROM unit_parts GROUP BY hub, i),
near AS (SELECT p.page, p.hub, round(sum(p.x * c.m) / sqrt(sum(c.m * c.m)), 9) AS cosine FROM unit_parts p JOIN centres c ON c.hub = p.hub AND c.i = p.i GROUP BY p.page, p.hub),
pillars AS (SELECT hub, page, cosine FROM (SELECT *, row_number() OVER (PARTITION BY hub ORDER BY cosine DESC, page) AS n FROM near) WHERE n = 1),
tenant_pages AS (
  SELECT p.page, p.language, p.hub, len(list_filter(regexp_split_to_array(coalesce(p.body, ''), '[ \\t-\\r]+'), lambda w: w <> '')) AS words,
    (SELECT count(*) FROM crawled c WHERE c.target = p.page) AS inbound, (SELECT count(*) FROM crawled c WHERE c.source = p.page) AS outbound,
    r.rank_percentile, d.depth, i.page IS NOT NULL AS is_pillar, CASE WHEN p.page % 13 > 0 THEN p.page % 5 END AS link_community,
    CASE WHEN p.page % 4 > 0 THEN p.page % 3 END AS keyword_community, CASE WHEN p.page % 17 > 0 THEN p.page % 7 END AS content_community
  FROM site_pages p LEFT JOIN percents r ON r.page = p.page LEFT JOIN depths d ON d.page = p.page LEFT JOIN pillars i ON i.page = p.page),
strategic AS (
  SELECT o_custkey AS page, CASE WHEN o_orderkey % 2 = 0 THEN lower(o_orderpriority) ELSE '  ' || o_orderpriority END AS keyword, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'en' END AS language,
    CASE WHEN o_orderkey % 3 > 0 THEN 1 + o_orderkey % 5 END AS priority, o_orderkey % 11 = 0 AS is_primary FROM orders),
metrics AS (SELECT page, sum(impressions) AS impressions, sum(clicks) AS clicks, round(sum(impressions * position) / sum(impressions), 6) AS avg_position, count(*) AS query_count FROM search_rows GROUP BY page),
seen AS (SELECT CAST(floor(least(position, 100.0) + 0.5) AS INTEGER) AS pos, sum(impressions) AS shown, sum(least(clicks, impressions)) AS clicked FROM search_rows GROUP BY 1),
spans AS (SELECT a.pos AS a, b.pos AS b, sum(s.clicked) / sum(s.shown) AS rate FROM seen a JOIN seen b ON a.pos <= b.pos JOIN seen s ON s.pos BETWEEN a.pos AND b.pos GROUP BY a.pos, b.pos),
pooled AS (SELECT pos, min(high) AS ctr FROM (SELECT s.pos, x.a, max(x.rate) AS high FROM seen s JOIN spans x ON x.a <= s.pos AND x.b >= s.pos GROUP BY s.pos, x.a) GROUP BY pos),
positions AS (SELECT unnest(range(1, 101)) AS pos),
curve AS (SELECT p.pos, coalesce((SELECT ctr FROM pooled q WHERE q.pos = (SELECT max(pos) FROM pooled z WHERE z.pos <= p.pos)), (SELECT ctr FROM pooled q WHERE q.pos = (SELECT min(pos) FROM pooled))) AS ctr
  FROM positions p WHERE (SELECT count(*) >= 100 AND sum(impressions) >= 10000 FROM search_rows)),
term_queries AS (SELECT page, list_distinct(list(lower(query))) AS queries FROM search_rows GROUP BY page),
term_keywords AS (SELECT page, list_distinct(list(lower(trim(keyword)))) AS keywords FROM strategic GROUP BY page),
decile_medians AS (SELECT least(floor(rank_percentile * 10), 9) AS decile, quantile_cont(inbound, 0.5) AS median FROM tenant_pages GROUP BY 1),
hub_sizes AS (SELECT hub, count(*) AS hub_size FROM tenant_pages WHERE hub >= 0 GROUP BY hub),
withins AS (SELECT c.target AS page, count(*) AS within FROM crawled c JOIN tenant_pages a ON a.page = c.source JOIN tenant_pages b ON b.page = c.target WHERE a.hub = b.hub AND a.hub >= 0 GROUP BY c.target),
contexts AS (
  SELECT p.*, coalesce(q.queries, []) AS queries, coalesce(k.keywords, []) AS keywords, len(list_filter(coalesce(k.keywords, []), lambda x: NOT list_contains(coalesce(q.queries, []), x))) AS keyword_gap,
    m.query_count, (SELECT max(priority) FROM strategic s WHERE s.page = p.page) AS max_priority, m.page IS NOT NULL AS has_gsc, ln(1 + m.impressions) AS impressions_log,
    CASE WHEN m.avg_position IS NULL THEN NULL WHEN floor(m.avg_position + 0.5) <= 3 THEN 0 WHEN floor(m.avg_position + 0.5) <= 10 THEN 1 WHEN floor(m.avg_position + 0.5) <= 20 THEN 2 WHEN floor(m.avg_position + 0.5) <= 50 THEN 3 ELSE 4 END AS band,
    CASE WHEN m.impressions > 0 THEN least(m.clicks / m.impressions, 1.0) - (SELECT ctr FROM curve c WHERE c.pos = floor(least(m.avg_position, 100.0) + 0.5)) END AS ctr_gap,
    p.inbound = 0 AS is_orphan, CASE WHEN d.median > 0 THEN p.inbound / d.median ELSE CAST(p.inbound AS DOUBLE) END AS saturation, p.outbound * 1000 / greatest(p.words, 1) AS density, 1 / (p.outbound + 1) AS share,
    h.hub_size, CASE WHEN h.hub_size > 1 THEN coalesce(w.within, 0) / (h.hub_size - 1) WHEN h.hub_size = 1 THEN 0.0 END AS coverage
  FROM tenant_pages p LEFT JOIN term_queries q ON q.page = p.page LEFT JOIN term_keywords k ON k.page = p.page LEFT JOIN metrics m ON m.page = p.page
  LEFT JOIN decile_medians d ON d.decile = least(floor(p.rank_percentile * 10), 9) LEFT JOIN hub_sizes h ON h.hub = p.hub LEFT JOIN withins w ON w.page = p.page)
"""
