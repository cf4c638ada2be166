"""The registry of queries over the driver's tables and their DuckDB SQL.

Every query runs over whole tables. A limit stands only where it is the feature: top-k retrieval and keyset pages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.functions import url as U
from linkloom.functions import vector as V
from linkloom.functions.terms import GENERIC
from linkloom.operators import anchors, audit, bridges, communities, evaluation, features, graph, keywords, listings, percentiles, recommend, retrieval, scoring, semantic, text_tables
from linkloom.plans.scratch import materialize
from linkloom.sources import site, tenant
from linkloom.sources.site import search_rows, site_links, site_pages, table

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None, site_tables: bool = True) -> Callable[[Query], Query]:
    """Registers a query under its function name; ``sql`` may use the tables of ``site.SQL``."""

    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = f"WITH RECURSIVE {site.SQL} {sql}" if site_tables else sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


# Retrieval and vectors


@query("""
, scored AS (
  SELECT t.page AS target, s.page AS source, round(list_dot_product(t.vector, s.vector) / (sqrt(list_dot_product(t.vector, t.vector)) * sqrt(list_dot_product(s.vector, s.vector))), 6) AS similarity
  FROM site_pages t JOIN site_pages s ON t.language = s.language AND t.page <> s.page
  LEFT JOIN (SELECT DISTINCT source, target FROM site_links) l ON l.source = s.page AND l.target = t.page WHERE l.source IS NULL)
SELECT target, source, CAST(rank AS INTEGER) AS rank, similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY target ORDER BY similarity DESC, source) AS rank FROM scored) WHERE rank <= 10""")
def candidate_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.nearest_eligible(site_pages(spark, sf_dir), site_links(spark, sf_dir))


def _link_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.link_cosines(site_pages(spark, sf_dir), site_links(spark, sf_dir))


_LINK_COSINES = """
, pairs AS (SELECT DISTINCT source, target FROM site_links),
cosines AS (
  SELECT p.source, p.target, a.language, round(list_dot_product(a.vector, b.vector) / (sqrt(list_dot_product(a.vector, a.vector)) * sqrt(list_dot_product(b.vector, b.vector))), 6) AS similarity
  FROM pairs p JOIN site_pages a ON a.page = p.source JOIN site_pages b ON b.page = p.target WHERE a.language = b.language)"""


@query(f"{_LINK_COSINES} SELECT * FROM cosines")
def link_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _link_cosines(spark, sf_dir)


@query(f"{_LINK_COSINES} SELECT language, count(*) AS links, round(quantile_cont(similarity, 0.25), 6) AS floor FROM cosines GROUP BY language")
def language_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _link_cosines(spark, sf_dir).groupBy("language").agg(F.count("*").alias("links"), F.round(F.expr("percentile(similarity, 0.25)"), 6).alias("floor"))


@query("""
, parts AS (SELECT page, hub, unnest(vector) AS x, generate_subscripts(vector, 1) AS i FROM site_pages WHERE hub >= 0),
units AS (SELECT hub, i, x / sqrt(sum(x * x) OVER (PARTITION BY page)) AS x FROM parts), means AS (SELECT hub, i, avg(x) AS m FROM units GROUP BY hub, i)
SELECT hub, CAST(i - 1 AS INTEGER) AS at, round(m / sqrt(sum(m * m) OVER (PARTITION BY hub)), 6) AS mean FROM means""")
def hub_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.hub_centroids(site_pages(spark, sf_dir)).select("hub", F.posexplode("centroid").alias("at", "x")).select("hub", "at", F.round("x", 6).alias("mean"))


@query("SELECT page, round(sqrt(list_dot_product(vector, vector)), 6) AS norm FROM site_pages")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_pages(spark, sf_dir).select("page", F.round(V.norm("vector"), 6).alias("norm"))


@query(f"""{_LINK_COSINES}, pools AS (SELECT language, count(*) AS pool FROM site_pages GROUP BY language),
scored AS (SELECT t.page AS target, s.page AS source, round(list_dot_product(t.vector, s.vector) / (sqrt(list_dot_product(t.vector, t.vector)) * sqrt(list_dot_product(s.vector, s.vector))), 6) AS similarity
  FROM site_pages t JOIN site_pages s ON t.language = s.language AND t.page <> s.page LEFT JOIN pairs l ON l.source = s.page AND l.target = t.page WHERE l.source IS NULL),
lasts AS (SELECT target, min(similarity) AS last FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY similarity DESC, source) AS r FROM scored) WHERE r <= 10 GROUP BY target),
linking AS (SELECT c.target, count(*) AS linked, sum(CASE WHEN c.similarity > l.last THEN 1 ELSE 0 END) AS nearer FROM cosines c LEFT JOIN lasts l ON l.target = c.target GROUP BY c.target)
SELECT p.page AS target, o.pool - 1 - coalesce(k.linked, 0) AS eligible, coalesce(k.linked, 0) AS linked, CAST(coalesce(k.nearer, 0) AS BIGINT) AS linked_nearer FROM site_pages p JOIN pools o ON o.language = p.language LEFT JOIN linking k ON k.target = p.page""")
def target_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, links = site_pages(spark, sf_dir), site_links(spark, sf_dir)
    return retrieval.target_facts(pages, links, materialize(retrieval.nearest_eligible(pages, links), "candidates"))


@query("""
, near AS (SELECT a.page AS x, b.page AS y, round(list_dot_product(a.vector, b.vector) / (sqrt(list_dot_product(a.vector, a.vector)) * sqrt(list_dot_product(b.vector, b.vector))), 6) AS w FROM site_pages a JOIN site_pages b ON a.page <> b.page),
top AS (SELECT x, y, w FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY w DESC, y) AS r FROM near) WHERE r <= 10 AND w > 0)
SELECT least(x, y) AS a, greatest(x, y) AS b, max(w) AS weight FROM top GROUP BY 1, 2""")
def knn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.knn_graph(site_pages(spark, sf_dir))


@query(f"""{tenant.SQL}, pairs AS (SELECT DISTINCT source, target FROM site_links),
linked AS (SELECT p.source, p.target, a.language, round(list_dot_product(a.vector, b.vector) / (sqrt(list_dot_product(a.vector, a.vector)) * sqrt(list_dot_product(b.vector, b.vector))), 6) AS similarity
  FROM pairs p JOIN site_pages a ON a.page = p.source JOIN site_pages b ON b.page = p.target WHERE a.language = b.language),
scored AS (SELECT t.page AS target, s.page AS source, round(list_dot_product(t.vector, s.vector) / (sqrt(list_dot_product(t.vector, t.vector)) * sqrt(list_dot_product(s.vector, s.vector))), 6) AS similarity
  FROM site_pages t JOIN site_pages s ON t.language = s.language AND t.page <> s.page LEFT JOIN pairs l ON l.source = s.page AND l.target = t.page WHERE l.source IS NULL),
near10 AS (SELECT target, source, similarity FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY similarity DESC, source) AS r FROM scored) WHERE r <= 10),
own AS (SELECT language, quantile_cont(similarity, 0.25) AS floor FROM linked GROUP BY language HAVING count(*) >= 50),
rest AS (SELECT CASE WHEN (SELECT count(*) FROM linked) >= 50 THEN (SELECT quantile_cont(similarity, 0.25) FROM linked) ELSE (SELECT quantile_cont(similarity, 0.25) FROM near10) END AS floor)
SELECT c.target, c.source, c.similarity FROM scored c JOIN pillars i ON i.page = c.target JOIN site_pages s ON s.page = c.source AND s.hub = i.hub LEFT JOIN near10 n ON n.target = c.target AND n.source = c.source
LEFT JOIN own o ON o.language = s.language CROSS JOIN rest r WHERE n.target IS NULL AND c.similarity >= coalesce(o.floor, r.floor)""")
def pillar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, links = site_pages(spark, sf_dir), site_links(spark, sf_dir)
    candidates = materialize(retrieval.nearest_eligible(pages, links), "candidates")
    return retrieval.pillar_pairs(pages, links, candidates, graph.hub_pillars(pages))


# Link graph


@query("""
, edges AS (SELECT DISTINCT source, target FROM site_links WHERE source IN (SELECT page FROM site_pages) AND target IN (SELECT page FROM site_pages))
SELECT p.page, (SELECT count(*) FROM edges e WHERE e.target = p.page) AS inbound, (SELECT count(*) FROM edges e WHERE e.source = p.page) AS outbound FROM site_pages p""")
def page_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.structure(site_links(spark, sf_dir), site_pages(spark, sf_dir))


@query("SELECT target, count(*) AS inlinks FROM site_links WHERE target NOT IN (SELECT page FROM site_pages) GROUP BY target")
def placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.placeholders(site_links(spark, sf_dir), site_pages(spark, sf_dir))


@query("SELECT l.target, p.language, l.anchor, count(*) AS links FROM site_links l JOIN site_pages p ON p.page = l.source GROUP BY ALL")
def inbound_anchor_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.inbound_anchors(site_links(spark, sf_dir), site_pages(spark, sf_dir))


@query("""
SELECT (SELECT count(*) FROM site_pages) AS pages, count(*) AS links, count(DISTINCT source) AS linking,
  CAST(sum(CASE WHEN anchor = 'read more' THEN 1 ELSE 0 END) AS BIGINT) AS generic, CAST(sum(CASE WHEN target IN (SELECT page FROM site_pages) THEN 0 ELSE 1 END) AS BIGINT) AS dangling FROM site_links""")
def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = site_pages(spark, sf_dir).select(F.col("page").alias("target"), F.lit(True).alias("known"))
    links = site_links(spark, sf_dir).join(pages, "target", "left")
    return links.agg(
        pages.agg(F.count("*")).scalar().alias("pages"), F.count("*").alias("links"), F.count_distinct("source").alias("linking"),
        F.count_if(F.col("anchor") == "read more").alias("generic"), F.count_if(F.col("known").isNull()).alias("dangling"),
    )


@query("""
, edges AS (SELECT DISTINCT source, target FROM site_links WHERE target IN (SELECT page FROM site_pages)),
deg AS (SELECT p.page, (SELECT count(*) FROM edges e WHERE e.target = p.page) AS inbound FROM site_pages p)
SELECT page, inbound, CASE WHEN inbound > 0 THEN 'linked' WHEN page % 5 > 0 THEN 'template_only' ELSE 'orphan' END AS label FROM deg""")
def orphan_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.structure(site_links(spark, sf_dir), site_pages(spark, sf_dir))
    return found.select("page", "inbound", graph.orphan_label(F.col("inbound"), F.col("page") % 5).alias("label"))


@query("""
, edges AS (SELECT DISTINCT source, target FROM site_links WHERE target IN (SELECT page FROM site_pages)),
walk(page, depth) AS (SELECT page, 0 FROM site_pages WHERE page IN (0, 3) UNION SELECT e.target, w.depth + 1 FROM walk w JOIN edges e ON e.source = w.page WHERE w.depth < (SELECT count(*) FROM site_pages))
SELECT p.page, CAST(min(w.depth) AS INTEGER) AS depth FROM site_pages p LEFT JOIN walk w ON w.page = p.page GROUP BY p.page""")
def crawl_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.crawl_depth(site_links(spark, sf_dir), site_pages(spark, sf_dir), [0, 3])


def _rank_sql(steps: int = 30) -> str:
    parts = [
        "edges AS MATERIALIZED (SELECT DISTINCT source, target FROM site_links)", "nodes AS MATERIALIZED (SELECT page FROM site_pages UNION SELECT target FROM edges)",
        "outs AS MATERIALIZED (SELECT source, count(*) AS n FROM edges GROUP BY source)", "size AS (SELECT count(*) AS n FROM nodes)", "r0 AS (SELECT page, 1.0 / n AS rank FROM nodes, size)",
    ]
    for i in range(1, steps + 1):
        loose = f"(SELECT coalesce(sum(rank), 0.0) FROM r{i - 1} WHERE page NOT IN (SELECT source FROM outs))"
        got = f"(SELECT e.target, sum(r.rank / o.n) AS got FROM edges e JOIN outs o ON o.source = e.source JOIN r{i - 1} r ON r.page = e.source GROUP BY e.target)"
        parts.append(f"r{i} AS MATERIALIZED (SELECT x.page, 0.15 / s.n + 0.85 * (coalesce(g.got, 0.0) + {loose} / s.n) AS rank FROM nodes x CROSS JOIN size s LEFT JOIN {got} g ON g.target = x.page)")
    return f", {', '.join(parts)} SELECT page, round(rank, 6) AS rank FROM r{steps}"


@query(_rank_sql())
def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.pagerank(site_links(spark, sf_dir), site_pages(spark, sf_dir), tolerance=1e-8).select("page", F.round("rank", 6).alias("rank"))


_HUBS = f"""{tenant.SQL}
, sizes AS (SELECT language, hub, count(*) AS size FROM tenant_pages WHERE hub >= 0 GROUP BY language, hub),
centroids AS (SELECT hub, list(m ORDER BY i) AS c FROM centres GROUP BY hub),
crossings AS (SELECT a.language, a.hub AS hub_from, b.hub AS hub_to, v.source, v.target FROM votes v JOIN tenant_pages a ON a.page = v.source JOIN tenant_pages b ON b.page = v.target WHERE a.language = b.language AND a.hub >= 0 AND b.hub >= 0 AND a.hub <> b.hub),
asked AS (SELECT p.language, p.hub, s.query, count(*) AS n FROM tenant_pages p JOIN search_rows s ON s.page = p.page WHERE p.hub >= 0 GROUP BY p.language, p.hub, s.query),
pairs AS (
  SELECT a.language, a.hub AS hub_a, b.hub AS hub_b, a.size AS size_a, b.size AS size_b,
    (SELECT count(DISTINCT source) FROM crossings x WHERE x.language = a.language AND x.hub_from = a.hub AND x.hub_to = b.hub) AS pages_ab, (SELECT count(DISTINCT source) FROM crossings x WHERE x.language = a.language AND x.hub_from = b.hub AND x.hub_to = a.hub) AS pages_ba,
    (SELECT count(*) FROM crossings x WHERE x.language = a.language AND ((x.hub_from = a.hub AND x.hub_to = b.hub) OR (x.hub_from = b.hub AND x.hub_to = a.hub))) / (a.size * b.size) AS density,
    list_dot_product(ca.c, cb.c) / (sqrt(list_dot_product(ca.c, ca.c)) * sqrt(list_dot_product(cb.c, cb.c))) AS cosine,
    (SELECT count(*) FROM asked x JOIN asked y ON x.query = y.query AND x.language = y.language WHERE x.language = a.language AND x.hub = a.hub AND y.hub = b.hub) AS common,
    (SELECT count(*) FROM asked x WHERE x.language = a.language AND x.hub = a.hub) + (SELECT count(*) FROM asked x WHERE x.language = a.language AND x.hub = b.hub) AS terms
  FROM sizes a JOIN sizes b ON a.language = b.language AND a.hub < b.hub JOIN centroids ca ON ca.hub = a.hub JOIN centroids cb ON cb.hub = b.hub),
gapped AS (SELECT *, CASE WHEN terms > 0 THEN common / (terms - common) ELSE 0.0 END AS query_jaccard, 0.4 * cosine + 0.6 * CASE WHEN terms > 0 THEN common / (terms - common) ELSE 0.0 END - 50.0 * density AS gap FROM pairs)"""


def _hub_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    site_rows, stored = site_pages(spark, sf_dir), tenant.pages(spark, sf_dir)
    pages = site_rows.select("page", "language", "hub", "vector").join(stored.select("page", "rank_percentile", "outbound"), "page")
    return materialize(bridges.hub_pairs(pages, site_links(spark, sf_dir), search_rows(spark, sf_dir)), "hub-pairs"), pages


@query(f"{_HUBS} SELECT language, hub_a, hub_b, size_a, size_b, pages_ab, pages_ba, round(density, 6) AS density, round(cosine, 6) AS cosine, round(query_jaccard, 6) AS query_jaccard, round(gap, 6) AS gap FROM gapped")
def hub_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = _hub_pairs(spark, sf_dir)
    return found.select("language", "hub_a", "hub_b", "size_a", "size_b", "pages_ab", "pages_ba", *[F.round(c, 6).alias(c) for c in ("density", "cosine", "query_jaccard", "gap")])


_COVERED = f"""{_HUBS}, ends AS (SELECT language, hub_a, hub_b, hub_a AS own, hub_b AS other, cosine FROM gapped UNION ALL SELECT language, hub_a, hub_b, hub_b, hub_a, cosine FROM gapped),
near2 AS (SELECT DISTINCT language, hub_a, hub_b FROM (SELECT *, row_number() OVER (PARTITION BY language, own ORDER BY cosine DESC, other) AS r FROM ends) WHERE r <= 2),
wide3 AS (SELECT language, hub_a, hub_b FROM (SELECT *, row_number() OVER (PARTITION BY language ORDER BY gap DESC, hub_a, hub_b) AS r FROM gapped) WHERE r <= 3),
numbered AS (SELECT language, hub_a, hub_b, row_number() OVER (PARTITION BY language ORDER BY cosine DESC, hub_a, hub_b) AS n FROM gapped),
nearer(language, n, goal, hub) AS (SELECT language, n, hub_b, hub_a FROM numbered UNION SELECT r.language, r.n, r.goal, CASE WHEN e.hub_a = r.hub THEN e.hub_b ELSE e.hub_a END FROM nearer r JOIN numbered e ON e.language = r.language AND e.n < r.n AND r.hub IN (e.hub_a, e.hub_b)),
covered AS (
  SELECT g.*, NOT EXISTS (SELECT 1 FROM nearer r WHERE r.language = g.language AND r.n = x.n AND r.hub = r.goal) AS tree, n.hub_a IS NOT NULL AS nearest, w.hub_a IS NOT NULL AS widest FROM gapped g JOIN numbered x ON x.language = g.language AND x.hub_a = g.hub_a AND x.hub_b = g.hub_b
  LEFT JOIN near2 n ON n.language = g.language AND n.hub_a = g.hub_a AND n.hub_b = g.hub_b LEFT JOIN wide3 w ON w.language = g.language AND w.hub_a = g.hub_a AND w.hub_b = g.hub_b)"""


@query(f"{_COVERED} SELECT language, hub_a, hub_b, tree, nearest, widest FROM covered")
def covered_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bridges.covered_pairs(_hub_pairs(spark, sf_dir)[0])
    return found.select("language", "hub_a", "hub_b", *[F.array_contains("reasons", r).alias(n) for r, n in zip(bridges.REASONS, ("tree", "nearest", "widest"), strict=True)])


_WAYS = """
ways AS (SELECT language, hub_a AS hub_from, hub_b AS hub_to, size_a AS size, pages_ab AS have, {0} FROM {1} UNION ALL SELECT language, hub_b, hub_a, size_b, pages_ba, {0} FROM {1}),
slotted AS (SELECT *, greatest(1, CAST(ceil(round(0.05 * size, 9)) AS BIGINT)) - have AS slots FROM ways)"""


@query(f"""{_COVERED}, {_WAYS.format("concat_ws(',', CASE WHEN tree THEN 'SPANNING_TREE' END, CASE WHEN nearest THEN 'NEAREST_HUB' END, CASE WHEN widest THEN 'BRIDGE_GAP' END) AS reasons", "(SELECT * FROM covered WHERE tree OR nearest OR widest)")},
copies AS (SELECT page FROM (SELECT page, min(page) OVER (PARTITION BY sha256(body), language) AS first FROM site_pages) WHERE page <> first),
members AS (SELECT p.page, p.language, p.hub, p.rank_percentile, p.outbound, p.words, s.vector FROM tenant_pages p JOIN site_pages s ON s.page = p.page WHERE p.hub >= 0 AND p.page NOT IN (SELECT page FROM copies)),
free AS (SELECT w.*, m.page AS source, m.vector AS vs, m.rank_percentile, m.outbound FROM slotted w JOIN members m ON m.language = w.language AND m.hub = w.hub_from
  WHERE w.slots > 0 AND NOT EXISTS (SELECT 1 FROM crossings c WHERE c.source = m.page AND c.hub_to = w.hub_to)),
tried AS (SELECT f.*, t.page AS target, round(list_dot_product(f.vs, t.vector) / (sqrt(list_dot_product(f.vs, f.vs)) * sqrt(list_dot_product(t.vector, t.vector))), 6) AS similarity FROM free f JOIN members t ON t.language = f.language AND t.hub = f.hub_to WHERE t.words >= 100),
best AS (SELECT *, row_number() OVER (PARTITION BY language, hub_from, hub_to, source ORDER BY similarity DESC, target) AS rank FROM tried QUALIFY rank <= 3),
chosen AS (SELECT language, hub_from, hub_to, source, row_number() OVER (PARTITION BY language, hub_from, hub_to ORDER BY round(CAST(similarity AS DECIMAL(9, 6)), 2) DESC, rank_percentile DESC NULLS LAST, outbound, source) AS slot, slots FROM best WHERE rank = 1 QUALIFY slot <= slots)
SELECT b.language, b.hub_from, b.hub_to, CAST(c.slot AS INTEGER) AS slot, CAST(b.rank AS INTEGER) AS rank, b.source, b.target, b.similarity, b.reasons FROM best b JOIN chosen c ON c.language = b.language AND c.hub_from = b.hub_from AND c.hub_to = b.hub_to AND c.source = b.source""")
def bridge_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bridges into pages of a hundred words or more; copies of other pages neither give nor take any."""
    pairs, pages = _hub_pairs(spark, sf_dir)
    targets = tenant.pages(spark, sf_dir).where("words >= 100").select("page")
    copies = text_tables.duplicate_groups(site_pages(spark, sf_dir, {"digest": F.sha2("text", 256)}), "page", "digest", "language").where("page <> canonical").select("page")
    found = bridges.bridge_links(bridges.covered_pairs(pairs), pages, site_links(spark, sf_dir), targets, copies)
    return found.withColumn("reasons", F.array_join("reasons", ","))


@query(f"""{_HUBS}, {_WAYS.format("hub_a, hub_b", "gapped")},
met AS (SELECT language, hub_a, hub_b FROM slotted GROUP BY language, hub_a, hub_b HAVING max(slots) <= 0),
joined(language, hub, other) AS (SELECT language, hub, hub FROM sizes UNION SELECT j.language, j.hub, CASE WHEN m.hub_a = j.other THEN m.hub_b ELSE m.hub_a END FROM joined j JOIN met m ON m.language = j.language AND j.other IN (m.hub_a, m.hub_b))
SELECT language, hub, min(other) AS component FROM joined GROUP BY language, hub""")
def hub_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hub with the smallest hub that it is joined with."""
    pairs, pages = _hub_pairs(spark, sf_dir)
    found = materialize(bridges.components(pages, pairs), "hub-components")
    first = found.groupBy("language", "component").agg(F.min("hub").alias("first"))
    return found.join(first, ["language", "component"]).select("language", "hub", F.col("first").alias("component"))


@query()
def recommendations_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, reserves and gaps of the tenant; anchors and reasons, which the anchor stage leaves, follow from ids."""
    by = Window.partitionBy("source").orderBy(F.col("score").desc(), "target")
    ranked = materialize(_scores(spark, sf_dir).select("source", "target", "score", F.row_number().over(by).alias("rank_in_source")), "ranked-pairs")
    s, t = F.col("source"), F.col("target")
    choices = ranked.where((s + t) % 3 > 0).select("source", "target", F.repeat(F.lit("word "), ((s * t) % 27 + 1).cast("int")).alias("phrase"))
    reason = F.when(s % 2 == 0, recommend.GAPS[0]).otherwise("TARGET_PAGE_HAS_NO_KEYWORD")
    unanchored = ranked.where((s + t) % 3 == 0).select("source", "target", reason.alias("reason"), F.lit(None).cast("string").alias("advice"), F.lit(None).cast("double").alias("best_score"))
    pages = tenant.pages(spark, sf_dir).withColumn("linkable", F.col("page") % 9 > 0)
    rows = recommend.assessed(ranked, choices, unanchored, pages, pages.where(F.col("page") % 41 == 0).select("page"), limit=12, words_per_link=60)
    return recommend.walk(rows, pages, limit=12, gap_limit=3, below=2)[0]


@query("""
WITH part AS (SELECT DISTINCT l_suppkey AS page, l_partkey AS keyword FROM lineitem)
SELECT a.page AS a, b.page AS b, count(*) AS shared FROM part a JOIN part b ON a.keyword = b.keyword AND a.page < b.page GROUP BY a.page, b.page""", site_tables=False)
def keyword_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), F.col("l_partkey").alias("keyword"))
    return graph.keyword_projection(rows)[0]


@query("""
, ends AS (SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM site_links WHERE source <> target AND source IN (SELECT page FROM site_pages) AND target IN (SELECT page FROM site_pages)),
ways AS (SELECT a AS x, b AS y FROM ends UNION ALL SELECT b, a FROM ends),
walks(step, s, v, n) AS (SELECT 0, page, page, CAST(1 AS DOUBLE) FROM site_pages UNION ALL SELECT any_value(w.step) + 1, w.s, y, sum(n) FROM walks w JOIN ways ON ways.x = w.v WHERE w.step < 8 GROUP BY w.s, y),
near AS (SELECT s, v, min(step) AS d, arg_min(n, step) AS paths FROM walks GROUP BY s, v),
loads AS (SELECT x.v AS page, sum(x.paths * y.paths / z.paths) AS load FROM near x JOIN near y ON y.s = x.v JOIN near z ON z.s = x.s AND z.v = y.v AND z.d = x.d + y.d WHERE x.s < y.v AND x.v <> x.s AND x.v <> y.v GROUP BY x.v)
SELECT p.page, round(coalesce(l.load, 0.0), 6) AS betweenness FROM site_pages p LEFT JOIN loads l ON l.page = p.page""")
def betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return communities.betweenness(site_links(spark, sf_dir), site_pages(spark, sf_dir)).select("page", F.round("betweenness", 6).alias("betweenness"))


@query()
def link_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graph.crawled_edges(site_links(spark, sf_dir), site_pages(spark, sf_dir))
    return communities.communities(edges.select(F.lit("site").alias("tenant"), F.col("source").alias("a"), F.col("target").alias("b"), F.lit(1.0).alias("weight")))


@query()
def density_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return communities.hubs(site_pages(spark, sf_dir).withColumn("tenant", F.col("language")))


@query("""
, cells AS (SELECT hub AS a, language AS b, count(*) AS n FROM site_pages GROUP BY hub, language), t AS (SELECT sum(n) AS n, sum(n * (n - 1) / 2) AS x FROM cells),
r AS (SELECT sum(m * (m - 1) / 2) AS x FROM (SELECT sum(n) AS m FROM cells GROUP BY a)), c AS (SELECT sum(m * (m - 1) / 2) AS x FROM (SELECT sum(n) AS m FROM cells GROUP BY b))
SELECT CAST(t.n AS BIGINT) AS vertices, round((t.x - r.x * c.x / (t.n * (t.n - 1) / 2)) / ((r.x + c.x) / 2 - r.x * c.x / (t.n * (t.n - 1) / 2)), 6) AS ari FROM t, r, c""")
def label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = site_pages(spark, sf_dir)
    found = evaluation.agreement(pages.select(F.col("page").alias("vertex"), F.col("hub").alias("label")), pages.select(F.col("page").alias("vertex"), F.col("language").alias("label")))
    return found.select("vertices", F.round("ari", 6).alias("ari"))


# Percentiles


@query("SELECT c_custkey, round((rank() OVER (ORDER BY c_acctbal) - 1) / count(*) OVER (), 6) AS percentile FROM customer", site_tables=False)
def percentile_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentiles.share_below(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal").select("c_custkey", F.round("percentile", 6).alias("percentile"))


@query("""
SELECT c_custkey, round(CASE WHEN v IS NULL THEN NULL WHEN n < 2 THEN 0.5 ELSE (low + (ties - 1) / 2.0 - 1) / (n - 1) END, 6) AS percentile FROM (
  SELECT *, rank() OVER (PARTITION BY c_nationkey, v IS NULL ORDER BY v) AS low, count(*) OVER (PARTITION BY c_nationkey, v) AS ties, count(v) OVER (PARTITION BY c_nationkey) AS n
  FROM (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 9 > 0 THEN floor(c_acctbal / 100) END AS v FROM customer))""", site_tables=False)
def average_rank_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("c_custkey") % 9 > 0, F.floor(F.col("c_acctbal") / 100)).alias("v")
    rows = percentiles.average_rank(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", v), "v", ["c_nationkey"])
    return rows.select("c_custkey", F.round("percentile", 6).alias("percentile"))


@query("""
SELECT l_shipmode AS mode, round(quantile_cont(l_extendedprice, 0.25), 6) AS q1, round(quantile_cont(l_extendedprice, 0.5), 6) AS median, round(quantile_cont(l_extendedprice, 0.9), 6) AS q9 FROM (
  SELECT CASE l_linenumber % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS l_shipmode, l_extendedprice FROM lineitem) GROUP BY 1""", site_tables=False)
def exact_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.when(F.col("l_linenumber") % 3 == 0, "a").when(F.col("l_linenumber") % 3 == 1, "b")
    found = percentiles.quantiles(table(spark, sf_dir, "lineitem").select(mode.alias("mode"), "l_extendedprice"), "l_extendedprice", (0.25, 0.5, 0.9), ["mode"])
    return found.select("mode", F.round("q0", 6).alias("q1"), F.round("q1", 6).alias("median"), F.round("q2", 6).alias("q9"))


# Text


@query("""
SELECT line, count(*) AS documents, round(count(*) / (SELECT count(*) FROM documents), 6) AS share FROM (
  SELECT DISTINCT doc_id, trim(line) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)) WHERE length(line) >= 20 GROUP BY line""", site_tables=False)
def line_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_tables.line_shares(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("""
SELECT doc_id, body_hash, count(*) OVER w AS copies, min(doc_id) OVER w AS canonical FROM (SELECT doc_id, sha256(text) AS body_hash, lang FROM documents)
WINDOW w AS (PARTITION BY body_hash, lang) QUALIFY count(*) OVER w > 1""", site_tables=False)
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_tables.duplicate_groups(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")


@query("SELECT doc_id, sha256(text) AS body_hash FROM documents", site_tables=False)
def body_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("body_hash"))


@query("""
SELECT doc_id, CAST(i - 1 AS INTEGER) AS "at", sentence FROM (SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) AS i FROM (
  SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?…])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents))""", site_tables=False)
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text_tables.sentences(F.col("text")).alias("s"))
    return docs.select("doc_id", F.posexplode_outer("s").alias("at", "sentence")).where("sentence is not null")


@query("""
SELECT name, count(*) AS urls FROM (SELECT DISTINCT page_id, split_part(part, '=', 1) AS name FROM (
  SELECT page_id, unnest(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&')) AS part FROM pages)) WHERE name <> '' GROUP BY name""", site_tables=False)
def url_query_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_tables.query_parameters(table(spark, sf_dir, "pages"))


@query("""
SELECT page_id, regexp_matches('&' || regexp_extract(lower(url), '\\?([^#]*)', 1), '&(page|paged|pg|pagenum|page_no|pagenumber|seite|pagina|sayfa|strona|start|offset|limitstart|p|currentpage|pageindex|page_index)(=|&|$)')
    OR regexp_matches(regexp_extract(lower(url), '://[^/?#]*([^?#]*)', 1), '(^|/)(page-[0-9]+|(page|p)/+[0-9]+)(/|$)') AS paginated,
  regexp_matches(regexp_extract(lower(url), '://[^/?#]*([^?#]*)', 1), '(^|[^0-9a-z])(sitemap|site[^0-9a-z/]+map)([^0-9a-z]|$)') AS sitemap, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages""", site_tables=False)
def url_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", U.is_pagination(url).alias("paginated"), U.is_sitemap(url).alias("sitemap"), F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"))


@query()
def url_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", U.url_key(F.col("url")).alias("url_key"))


@query("""
SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN 'empty' WHEN n_chars < 200 THEN 'short' WHEN regexp_matches(text, '[#$%&*]{3}') THEN 'noisy' ELSE 'usable' END AS state FROM documents""", site_tables=False)
def corpus_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    state = F.when(text.isNull() | (text == ""), "empty").when(F.col("n_chars") < 200, "short").when(text.rlike("[#$%&*]{3}"), "noisy")
    return table(spark, sf_dir, "documents").select("doc_id", state.otherwise("usable").alias("state"))


@query("""
, words AS (SELECT page, language, hub, list_distinct(list_filter(string_split(lower(body), ' '), lambda x: length(x) >= 4)) AS terms FROM site_pages),
pairs AS (SELECT DISTINCT source, target FROM site_links)
SELECT p.source, p.target, CAST(len(list_intersect(a.terms, b.terms)) AS INTEGER) AS shared,
  round(CASE WHEN len(a.terms) + len(b.terms) - len(list_intersect(a.terms, b.terms)) > 0 THEN len(list_intersect(a.terms, b.terms)) / (len(a.terms) + len(b.terms) - len(list_intersect(a.terms, b.terms))) ELSE 0.0 END, 6) AS jaccard,
  CASE WHEN a.hub = -1 OR b.hub = -1 THEN false ELSE a.hub = b.hub END AS same_hub, a.language = b.language AS same_language
FROM pairs p JOIN words a ON a.page = p.source JOIN words b ON b.page = p.target""")
def pair_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term overlap of linked pages; the whole matrix is ``feature_matrix``."""
    terms = F.array_distinct(F.filter(F.split(F.lower("body"), " "), lambda x: F.length(x) >= 4))
    words = site_pages(spark, sf_dir).select("page", "language", "hub", terms.alias("terms"))
    a = words.select(F.col("page").alias("source"), F.col("language").alias("la"), F.col("hub").alias("ha"), F.col("terms").alias("ta"))
    b = words.select(F.col("page").alias("target"), F.col("language").alias("lb"), F.col("hub").alias("hb"), F.col("terms").alias("tb"))
    pairs = site_links(spark, sf_dir).select("source", "target").distinct().join(a, "source").join(b, "target")
    pairs = pairs.withColumn("shared", F.size(F.array_intersect("ta", "tb")))
    union = F.size("ta") + F.size("tb") - F.col("shared")
    same_hub = F.when((F.col("ha") == -1) | (F.col("hb") == -1), False).otherwise(F.col("ha") == F.col("hb"))
    jaccard = F.round(F.when(union > 0, F.col("shared") / union).otherwise(0.0), 6)
    return pairs.select("source", "target", "shared", jaccard.alias("jaccard"), same_hub.alias("same_hub"), (F.col("la") == F.col("lb")).alias("same_language"))


@query(f"""{tenant.SQL}
, usable AS (SELECT page, trim(regexp_replace(keyword, '\\s+', ' ', 'g')) AS text, lower(trim(regexp_replace(keyword, '\\s+', ' ', 'g'))) AS k, language, priority, is_primary FROM strategic WHERE length(language) >= 2 AND trim(keyword) <> ''),
one AS (SELECT page, k, language, arg_min(text, (NOT is_primary, -coalesce(priority, 0), k, text)) AS keyword, max(priority) AS priority, bool_or(is_primary) AS is_primary FROM usable GROUP BY page, k, language)
SELECT page, keyword, language, CAST(priority AS BIGINT) AS priority, is_primary, CAST(row_number() OVER (PARTITION BY page ORDER BY is_primary DESC, coalesce(priority, 0) DESC, k, keyword, language) AS INTEGER) AS rank FROM one""")
def merge_strategic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_tables.merged_strategic(tenant.strategic_rows(spark, sf_dir)).withColumn("priority", F.col("priority").cast("long"))


@query("""
, duplicated AS (SELECT page, url, sha256(body) AS h, language, page % 9 > 0 AS indexable, (SELECT count(*) FROM site_links l WHERE l.target = p.page) AS inbound FROM site_pages p)
SELECT page, min(page) OVER w AS duplicate_group, url = first_value(url) OVER (PARTITION BY h, language ORDER BY indexable DESC, inbound DESC, length(url), url) AS is_canonical FROM duplicated
WINDOW w AS (PARTITION BY h, language) QUALIFY count(*) OVER w > 1""")
def canonical_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    into = site_links(spark, sf_dir).groupBy(F.col("target").alias("page")).agg(F.count("*").alias("inbound"))
    pages = site_pages(spark, sf_dir).select("page", "url", F.sha2("body", 256).alias("body_hash"), "language", (F.col("page") % 9 > 0).alias("indexable"))
    return text_tables.canonical_copies(pages.join(into, "page", "left").fillna({"inbound": 0}))


@query("""
SELECT DISTINCT source, target FROM site_links WHERE sha256('7' || chr(9) || CAST(source AS VARCHAR) || chr(9) || CAST(target AS VARCHAR)) < '3333333333333400000000000000000000000000000000000000000000000000'""")
def hide_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_tables.hidden_links(site_links(spark, sf_dir), 0.2, 7)


@query("""
SELECT 'first' AS side, source AS text, titles FROM (SELECT source, count(*) AS titles FROM documents GROUP BY source ORDER BY titles DESC, lower(source) LIMIT 1) WHERE titles >= 2 AND titles >= 0.05 * (SELECT count(*) FROM documents)
UNION ALL SELECT 'last', lang, titles FROM (SELECT lang, count(*) AS titles FROM documents GROUP BY lang ORDER BY titles DESC, lang LIMIT 1) WHERE titles >= 2 AND titles >= 0.05 * (SELECT count(*) FROM documents)""", site_tables=False)
def brand_affixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat("source", F.lit(" | "), F.col("doc_id").cast("string"), F.lit(" \u2013 "), "lang")
    return text_tables.title_affixes(table(spark, sf_dir, "documents").select(title.alias("title")), F.col("title"), share=0.05)


@query("""
SELECT line, documents, round(documents / (SELECT count(*) FROM documents), 6) AS share, navigation FROM (
  SELECT line, count(*) AS documents, regexp_matches(line, '^([-*+]\\s|#{1,6}\\s|[0-9]+[.)]\\s|\\[[^\\]]*\\]\\(\\)$)') AS navigation FROM (
    SELECT DISTINCT doc_id, regexp_replace(trim(line), '\\]\\([^)]*\\)', ']()', 'g') AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)) WHERE length(line) >= 20 GROUP BY line)
WHERE documents / (SELECT count(*) FROM documents) >= 0.01 OR (navigation AND documents / (SELECT count(*) FROM documents) >= 0.005)""", site_tables=False)
def boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_tables.boilerplate(table(spark, sf_dir, "documents"), "doc_id", "text", 0.01, 0.005)


@query(f"""{tenant.SQL}
, tokens AS (SELECT page, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(body, '') || ' click view'), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> '')) AS t FROM site_pages),
words AS (SELECT s.page, s.query, s.impressions, list_filter(regexp_split_to_array(lower(s.query), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) >= 2) AS w FROM search_rows s WHERE s.impressions >= 2)
SELECT w.page, w.query, w.impressions FROM words w JOIN tokens t ON t.page = w.page WHERE len(w.w) > 0 AND len(list_filter(w.w, lambda x: x <> 'view')) > 0 AND len(list_filter(w.w, lambda x: NOT list_contains(t.t, x))) = 0""")
def usable_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = site_pages(spark, sf_dir).select("page", F.concat(F.coalesce("body", F.lit("")), F.lit(" click view")).alias("text"))
    return text_tables.usable_queries(search_rows(spark, sf_dir), texts, ["view"], 2).select("page", "query", "impressions")


# Search metrics


@query("""
SELECT page, query, source, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY page ORDER BY priority, impressions DESC, query) AS rank FROM (
    SELECT page, query, 'search' AS source, 2 AS priority, impressions FROM search_rows UNION ALL SELECT c_custkey, c_mktsegment, 'strategic', 1, 0 FROM customer)) WHERE rank <= 4""")
def merged_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search_rows(spark, sf_dir).select("page", "query", F.lit("search").alias("source"), F.lit(2).alias("priority"), "impressions")
    own = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("page"), F.col("c_mktsegment").alias("query"), F.lit("strategic").alias("source"), F.lit(1).alias("priority"), F.lit(0).cast("long").alias("impressions")
    )
    by = Window.partitionBy("page").orderBy("priority", F.col("impressions").desc(), "query")
    return found.unionByName(own).withColumn("rank", F.row_number().over(by)).where("rank <= 4").select("page", "query", "source", "rank")


@query("""
WITH stamped AS (SELECT event_type || '_' || CAST(user_id % 10 AS VARCHAR) AS metric, epoch(ts) >= (SELECT (epoch(min(ts)) + epoch(max(ts))) / 2 FROM events) AS late FROM events),
halves AS (SELECT metric, CAST(sum(CASE WHEN late THEN 1 ELSE 0 END) AS DOUBLE) AS now, CAST(sum(CASE WHEN late THEN 0 ELSE 1 END) AS DOUBLE) AS before FROM stamped GROUP BY metric)
SELECT metric, before AS previous, now AS current, round(CASE WHEN before <> 0 THEN (now - before) / before END, 6) AS change FROM halves WHERE CASE WHEN before = 0 THEN now <> 0 ELSE abs(now - before) / before > 0.2 + 1e-9 END""", site_tables=False)
def drift_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per type and group of users, the later half of the time against the earlier one."""
    e = table(spark, sf_dir, "events").select(F.concat_ws("_", "event_type", (F.col("user_id") % 10).cast("string")).alias("metric"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    middle = e.agg((F.min("t") + F.max("t")) / 2).scalar()
    per = materialize(e.groupBy("metric").agg(F.count_if(F.col("t") >= middle).cast("double").alias("now"), F.count_if(F.col("t") < middle).cast("double").alias("before")), "halves")
    found = semantic.drift_alerts(per.select("metric", F.col("now").alias("value")), per.select("metric", F.col("before").alias("value")))
    return found.withColumn("change", F.round("change", 6))


@query("""
SELECT CAST(floor(least(position, 100.0) + 0.5) AS INTEGER) AS at, CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(clicks) AS BIGINT) AS clicks, round(sum(clicks) / sum(impressions), 6) AS ctr
FROM search_rows GROUP BY 1""")
def ctr_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.observed_ctr(search_rows(spark, sf_dir))


@query(f"""{tenant.SQL}
SELECT s.page, s.query, round(CASE WHEN EXISTS (SELECT 1 FROM curve) THEN greatest(0.0, s.impressions * ((SELECT ctr FROM curve WHERE pos = 1) - (SELECT ctr FROM curve c WHERE c.pos = floor(least(s.position, 100.0) + 0.5)))) END, 6) AS opportunity FROM search_rows s""")
def ctr_opportunity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search_rows(spark, sf_dir)
    curve = scoring.fitted_curve(rows)
    if curve is None:
        return rows.select("page", "query", F.lit(None).cast("double").alias("opportunity"))
    return rows.select("page", "query", F.round(scoring.opportunity(F.col("impressions"), F.col("position"), F.array(*[F.lit(c) for c in curve])), 6).alias("opportunity"))


@query("SELECT page, CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(clicks) AS BIGINT) AS clicks, round(sum(impressions * position) / sum(impressions), 6) AS avg_position, count(*) AS query_count FROM search_rows GROUP BY page")
def page_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = F.sum(F.col("impressions") * F.col("position")) / F.sum("impressions")
    return search_rows(spark, sf_dir).groupBy("page").agg(
        F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"), F.round(mean, 6).alias("avg_position"), F.count("*").alias("query_count")
    )


@query("SELECT page, query, impressions, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY impressions DESC, query) AS rank FROM search_rows) WHERE rank <= 3")
def ranked_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("page").orderBy(F.col("impressions").desc(), "query")
    rows = search_rows(spark, sf_dir).withColumn("rank", F.row_number().over(by))
    return rows.where("rank <= 3").select("page", "query", "impressions", "rank")


@query(f"{tenant.SQL} SELECT hub, page, round(cosine, 6) AS cosine FROM pillars")
def hub_pillars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.hub_pillars(site_pages(spark, sf_dir)).select("hub", "page", F.round("cosine", 6).alias("cosine"))


# Scores and ranks


def _contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every page of the tenant brings to its pairs."""
    return tenant.stored(spark, sf_dir, "page-contexts", lambda: _built_contexts(spark, sf_dir))


def _built_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, rows = tenant.pages(spark, sf_dir), tenant.searches(spark, sf_dir)
    strategic = tenant.strategic(spark, sf_dir)
    signals = features.page_signals(pages, rows, strategic)
    return features.page_contexts(pages, signals, tenant.links(spark, sf_dir), tenant.page_metrics(spark, sf_dir), strategic, scoring.fitted_curve(rows))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.nearest_eligible(tenant.site(spark, sf_dir), tenant.links(spark, sf_dir))


_CANDIDATES = """
, cosined AS (
  SELECT t.page AS target, s.page AS source, round(list_dot_product(t.vector, s.vector) / (sqrt(list_dot_product(t.vector, t.vector)) * sqrt(list_dot_product(s.vector, s.vector))), 6) AS similarity
  FROM site_pages t JOIN site_pages s ON t.language = s.language AND t.page <> s.page LEFT JOIN votes l ON l.source = s.page AND l.target = t.page WHERE l.source IS NULL),
candidates AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY similarity DESC, source) AS rank FROM cosined) WHERE rank <= 10)"""


def _feature_sql() -> str:
    """The 47 columns in SQL, one expression each."""
    jaccard = lambda f: f"CASE WHEN len(s.{f}) + len(t.{f}) > 0 THEN len(list_intersect(s.{f}, t.{f})) / (len(s.{f}) + len(t.{f}) - len(list_intersect(s.{f}, t.{f}))) ELSE 0.0 END"
    links = "coalesce(s.link_community = t.link_community, false)"

    def agree(topic: str, kind: str) -> str:
        unknown = f"(s.{topic} IS NULL OR t.{topic} IS NULL)"
        tests = {
            "same_topic_same_links": f"NOT {unknown} AND s.{topic} = t.{topic} AND {links}", "same_topic_other_links": f"NOT {unknown} AND s.{topic} = t.{topic} AND NOT {links}",
            "other_topic_same_links": f"NOT {unknown} AND s.{topic} <> t.{topic} AND {links}", "other_topic_other_links": f"NOT {unknown} AND s.{topic} <> t.{topic} AND NOT {links}", "unknown_topic": unknown,
        }
        return tests[kind]

    plain = {
        "source_impressions_log": "s.impressions_log", "target_impressions_log": "t.impressions_log", "target_ctr_gap": "t.ctr_gap", "target_query_count": "t.query_count", "has_gsc_data": "t.has_gsc",
        "pair_query_overlap": jaccard("queries"), "pair_kw_overlap": jaccard("keywords"), "target_kw_count": "len(t.keywords)", "target_max_priority": "t.max_priority",
        "target_keyword_gap": "t.keyword_gap", "target_inbound_count": "t.inbound", "target_is_orphan": "t.is_orphan", "target_crawl_depth": "t.depth", "target_page_rank_percentile": "t.rank_percentile",
        "target_saturation_ratio": "t.saturation", "source_outbound_count": "s.outbound", "source_outbound_density": "s.density", "source_link_equity_share": "s.share",
        "source_page_rank_percentile": "s.rank_percentile", "same_hub": "s.hub = t.hub AND s.hub <> -1", "source_is_hub_pillar": "s.is_pillar", "target_is_hub_pillar": "t.is_pillar",
        "source_hub_size": "s.hub_size", "target_hub_size": "t.hub_size", "target_hub_coverage": "t.coverage", "content_cosine": "c.similarity", "context_relevance": "NULL", "anchor_target_fit": "NULL",
        **{f"same_{k}_community": f"s.{k}_community = t.{k}_community" for k in ("link", "keyword", "content")},
        **{f"target_position_band_{b}": f"coalesce(t.band = {b}, false)" for b in range(5)}, "target_position_band_null": "t.band IS NULL",
        **{f"cluster_agreement_{k}": agree("keyword_community", k) for k in features.AGREEMENT}, **{f"content_agreement_{k}": agree("content_community", k) for k in features.AGREEMENT},
    }
    listed = ", ".join(f"CAST({x} AS DOUBLE) AS {n}" for n, x in plain.items())
    return f"{tenant.SQL} {_CANDIDATES}, features AS (SELECT c.source, c.target, {listed} FROM candidates c JOIN contexts s ON s.page = c.source JOIN contexts t ON t.page = c.target)"


def _score_sql() -> str:
    """The baseline scorer in SQL: normalised values, contributions, raw score, score and tier."""
    values = []
    for i, (column, _, lower, by_rank) in enumerate(scoring.WEIGHTS):
        if by_rank:
            rank = f"rank() OVER (PARTITION BY {column} IS NULL ORDER BY {column}) + (count(*) OVER (PARTITION BY {column}) - 1) / 2.0 - 1"
            x = f"CASE WHEN {column} IS NULL THEN NULL WHEN count({column}) OVER () < 2 THEN 0.5 ELSE ({rank}) / (count({column}) OVER () - 1) END"
        else:
            x = f"greatest(0.0, least(1.0, {column}))" if lower is None else f"CASE WHEN {column} IS NULL THEN NULL ELSE greatest(0.0, least(1.0, {column})) END"
        values.append(f"{'1 - ' if lower else ''}({x}) AS v{i}")
    total = " + ".join(f"CASE WHEN v{i} IS NULL THEN 0 ELSE {w} END" for i, (_, w, _, _) in enumerate(scoring.WEIGHTS))
    parts = ", ".join(f"CASE WHEN v{i} IS NULL THEN NULL ELSE v{i} * {w} / total END AS p{i}" for i, (_, w, _, _) in enumerate(scoring.WEIGHTS))
    raw = " + ".join(f"coalesce(p{i}, 0)" for i in range(len(scoring.WEIGHTS)))
    listed = ", ".join(f"{{'less': -p{i}, 'i': {i}, 'feature': '{c}'}}" for i, (c, _, _, _) in enumerate(scoring.WEIGHTS))
    return f"""{_feature_sql()},
valued AS (SELECT source, target, {', '.join(values)} FROM features), totalled AS (SELECT *, {total} AS total FROM valued), parted AS (SELECT *, {parts} FROM totalled),
rawed AS (SELECT source, target, CASE WHEN total > 0 THEN round({raw}, 9) END AS raw_score, list_sort(list_filter([{listed}], lambda x: x.less IS NOT NULL)) AS tops FROM parted),
scored AS (
  SELECT source, target, raw_score, CASE WHEN raw_score IS NULL THEN 0.0 WHEN max(raw_score) OVER () = min(raw_score) OVER () THEN 50.0
    ELSE (raw_score - min(raw_score) OVER ()) / (max(raw_score) OVER () - min(raw_score) OVER ()) * 100 END AS score,
    row_number() OVER (ORDER BY raw_score DESC NULLS LAST, source, target) AS place, count(*) OVER () AS n, tops FROM rawed),
tiered AS (SELECT *, CASE WHEN raw_score IS NULL THEN 3 WHEN place <= floor(0.1 * n + 0.5) THEN 1 WHEN place <= floor(0.4 * n + 0.5) THEN 2 ELSE 3 END AS tier FROM scored)"""


def _scores(spark: SparkSession, sf_dir: str, top: int = 0) -> DataFrame:
    """Baseline scores of the candidates; raw scores rounded to 9 places, so that sums in another order rank alike.

    Only the columns that have a weight are computed, and contributions only where they are asked for.
    """
    pairs = features.pair_features(_candidates(spark, sf_dir), _contexts(spark, sf_dir)).select("source", "target", *[c for c, *_ in scoring.WEIGHTS])
    return scoring.weighted_score(materialize(pairs, "pair-features"), ["source", "target"], top=top)


@query(f"{_feature_sql()} SELECT source, target, " + ", ".join(f"round({c}, 6) AS {c}" for c in features.MATRIX) + " FROM features")
def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = features.pair_features(_candidates(spark, sf_dir), _contexts(spark, sf_dir))
    return pairs.select("source", "target", *[F.round(c, 6).alias(c) for c in features.MATRIX])


@query(f"{tenant.SQL} SELECT page, has_gsc, round(impressions_log, 6) AS impressions_log, CAST(band AS INTEGER) AS band, round(ctr_gap, 6) AS ctr_gap, keyword_gap, max_priority, is_orphan, round(saturation, 6) AS saturation, round(density, 6) AS density, round(share, 6) AS share, hub_size, round(coverage, 6) AS coverage FROM contexts")
def page_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = [F.round(c, 6).alias(c) for c in ("impressions_log", "ctr_gap", "saturation", "density", "share", "coverage")]
    whole = ["page", "has_gsc", "band", F.col("keyword_gap").cast("long").alias("keyword_gap"), F.col("max_priority").cast("long").alias("max_priority"), "is_orphan", "hub_size"]
    return _contexts(spark, sf_dir).select(*whole, *rounded)


@query(f"{tenant.SQL} SELECT page, array_to_string(list_sort(queries), chr(44)) AS queries, array_to_string(list_sort(keywords), chr(44)) AS keywords, keyword_gap FROM contexts")
def page_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = features.page_signals(tenant.site(spark, sf_dir), tenant.searches(spark, sf_dir), tenant.strategic(spark, sf_dir))
    return found.select("page", F.array_join(F.sort_array("queries"), ",").alias("queries"), F.array_join(F.sort_array("keywords"), ",").alias("keywords"), F.col("keyword_gap").cast("long").alias("keyword_gap"))


@query(f"{_score_sql()} SELECT source, target, round(raw_score, 6) AS raw_score, round(score, 4) AS score FROM tiered")
def baseline_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select("source", "target", F.round("raw_score", 6).alias("raw_score"), F.round("score", 4).alias("score"))


@query(f"{_score_sql()} SELECT source, target, CAST(tier AS INTEGER) AS tier FROM tiered")
def score_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select("source", "target", "tier")


@query(f"{_score_sql()} SELECT source, target, CAST(row_number() OVER (PARTITION BY source ORDER BY round(score, 4) DESC NULLS LAST, target) AS INTEGER) AS rank_in_source FROM tiered")
def rank_in_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("source").orderBy(F.round("score", 4).desc_nulls_last(), "target")
    return _scores(spark, sf_dir).select("source", "target", F.row_number().over(by).alias("rank_in_source"))


@query(f"{_score_sql()} SELECT source, target, round(-tops[1].less, 6) AS first, round(-tops[2].less, 6) AS second, round(-tops[3].less, 6) AS third FROM tiered")
def top_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = [F.round(f"top{i}_contribution", 6).alias(n) for i, n in ((1, "first"), (2, "second"), (3, "third"))]
    return _scores(spark, sf_dir, top=3).select("source", "target", *best)


@query(f"{_score_sql()} SELECT CAST(least(floor(round(score, 6) / 5), 19) AS BIGINT) AS bin, count(*) AS pairs FROM tiered GROUP BY 1")
def score_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    bin_ = F.least(F.floor(F.round("score", 6) / 5), F.lit(19).cast("long")).alias("bin")
    return _scores(spark, sf_dir).groupBy(bin_).agg(F.count("*").alias("pairs"))


@query(f"""{_feature_sql()}, long AS (SELECT column_, x FROM (SELECT {', '.join(features.MATRIX)} FROM features) UNPIVOT INCLUDE NULLS (x FOR column_ IN ({', '.join(features.MATRIX)})))
SELECT column_ AS "column", count(*) - count(x) AS missing, round(min(x), 6) AS low, round(max(x), 6) AS high, coalesce(min(x) = max(x), true) AS constant FROM long GROUP BY column_""")
def feature_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = features.pair_features(_candidates(spark, sf_dir), _contexts(spark, sf_dir))
    return features.feature_report(pairs).select("column", "missing", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "constant")


@query(f"""{_feature_sql()}
SELECT count(*) AS pairs, CAST(sum(CASE WHEN pair_query_overlap > 0 THEN 1 ELSE 0 END) AS BIGINT) AS query_overlap_pairs, round(avg(pair_query_overlap), 6) AS query_overlap_mean,
  CAST(sum(CASE WHEN pair_kw_overlap > 0 THEN 1 ELSE 0 END) AS BIGINT) AS keyword_overlap_pairs, round(avg(pair_kw_overlap), 6) AS keyword_overlap_mean, CAST(sum(CASE WHEN same_hub = 1 THEN 1 ELSE 0 END) AS BIGINT) AS same_hub_pairs,
  {', '.join(f'CAST(sum({k}_agreement_{a}) AS BIGINT) AS {k}_{a}' for k in ('cluster', 'content') for a in features.AGREEMENT)} FROM features""")
def signal_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.signal_report(_candidates(spark, sf_dir), _contexts(spark, sf_dir))


@query("""
, counts AS (SELECT source, count(*) AS n FROM site_links GROUP BY source), q AS (SELECT quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.75) AS q3 FROM counts)
SELECT round(q3, 6) AS saturation, round(q3 + 3 * greatest(q3 - q1, 1.0), 6) AS fence FROM q""")
def outbound_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = audit.sources(site_links(spark, sf_dir).withColumn("source_words", F.lit(None).cast("int")))
    cuts = audit.cutoffs(per, per.select(F.lit(None).cast("double").alias("equity")), None, None)
    return cuts.select(F.round("saturation", 6).alias("saturation"), F.round("outbound_fence", 6).alias("fence"))


# Audit


def _audit_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The site's links as the audit reads them: structure from the tenant, statuses and stored scores from ids."""
    pages = tenant.pages(spark, sf_dir)
    s = pages.select(F.col("page").alias("source"), F.col("rank_percentile").alias("source_percentile"), F.when(F.col("page") % 6 > 0, F.col("words")).alias("source_words"))
    t = pages.select(F.col("page").alias("target"), F.col("rank_percentile").alias("target_percentile"), F.col("hub").alias("target_hub"), F.lit(False).alias("known"))
    e = site_links(spark, sf_dir).join(s, "source").join(t, "target", "left")
    x, p, y = F.col("source"), F.col("position"), F.col("target")
    generic = F.col("anchor") == "read more"
    mix = (x * 31 + p * 17 + y * 7) % 100
    return e.select(
        "source", "position", "target", F.col("anchor").alias("anchor_key"), generic.alias("generic"), (~generic & (y % 3 > 0)).alias("exact_match"),
        F.when(~generic, F.when(mix < 40, 0.0).otherwise(mix / 100)).alias("keyword_jaccard"), F.when(~generic & (mix % 2 == 0), mix / 200 + 0.5).alias("keyword_cosine"), (p % 7 > 0).alias("is_follow"),
        F.when(mix % 11 > 0, (mix * 3 % 100) / 100).alias("context_relevance"), F.when(~generic & (mix % 13 > 0), (mix * 7 % 100) / 100).alias("anchor_target_fit"),
        "source_percentile", "target_percentile", "source_words", F.coalesce("known", F.lit(True)).alias("target_placeholder"),
        F.when(y % 10 == 3, 301).when(y % 10 == 7, 404).otherwise(200).alias("target_status"), (y % 9 > 0).alias("target_indexable"), "target_hub",
        F.when(y % 14 == 5, F.when(y % 4 == 1, x).otherwise(y - 1)).alias("target_canonical"),
    )


_AUDIT = f"""{tenant.SQL}
, mixed AS (SELECT l.*, (l.source * 31 + l.position * 17 + l.target * 7) % 100 AS mix, l.anchor = 'read more' AS generic FROM site_links l),
edges AS (
  SELECT m.source, m.position, m.target, m.anchor AS anchor_key, m.generic, NOT m.generic AND m.target % 3 > 0 AS exact_match, CASE WHEN NOT m.generic THEN CASE WHEN mix < 40 THEN 0.0 ELSE mix / 100 END END AS keyword_jaccard,
    CASE WHEN NOT m.generic AND mix % 2 = 0 THEN mix / 200 + 0.5 END AS keyword_cosine, m.position % 7 > 0 AS is_follow, CASE WHEN mix % 11 > 0 THEN (mix * 3 % 100) / 100 END AS context_relevance,
    CASE WHEN NOT m.generic AND mix % 13 > 0 THEN (mix * 7 % 100) / 100 END AS fit, s.rank_percentile AS source_percentile, t.rank_percentile AS target_percentile, CASE WHEN m.source % 6 > 0 THEN s.words END AS source_words,
    t.page IS NULL AS placeholder, CASE m.target % 10 WHEN 3 THEN 301 WHEN 7 THEN 404 ELSE 200 END AS status, m.target % 9 > 0 AS indexable, t.hub AS target_hub,
    CASE WHEN m.target % 14 = 5 THEN CASE WHEN m.target % 4 = 1 THEN m.source ELSE m.target - 1 END END AS canonical
  FROM mixed m JOIN tenant_pages s ON s.page = m.source LEFT JOIN tenant_pages t ON t.page = m.target),
placed AS (SELECT *, count(*) OVER (PARTITION BY source) AS links, row_number() OVER (PARTITION BY source ORDER BY position) - 1 AS rank FROM edges),
equal AS (SELECT *, CASE WHEN NOT placeholder THEN source_percentile * (1 - rank / links) * (1 - target_percentile) END AS equity FROM placed),
per AS (SELECT source, count(*) AS outbound, max(source_words) AS words, CASE WHEN max(source_words) > 0 THEN 100 * count(*) / max(source_words) END AS density FROM equal GROUP BY source),
cuts AS (SELECT quantile_cont(outbound, 0.75) AS saturation, quantile_cont(outbound, 0.75) + 3 * greatest(quantile_cont(outbound, 0.75) - quantile_cont(outbound, 0.25), 1.0) AS fence,
  quantile_cont(density, 0.75) + 3 * greatest(quantile_cont(density, 0.75) - quantile_cont(density, 0.25), 1.0) AS thick, (SELECT quantile_cont(equity, 0.75) FROM equal) AS top, 0.55 AS context_split, 0.45 AS fit_split FROM per),
wide AS (SELECT e.*, p.outbound, coalesce(p.density > c.thick, false) AS listing, c.* FROM equal e JOIN per p ON p.source = e.source CROSS JOIN cuts c),
told AS (SELECT target, anchor_key, exact_match FROM wide WHERE NOT placeholder AND NOT listing AND NOT generic),
blocked AS (SELECT target, anchor_key, block, descriptive FROM (SELECT target, anchor_key, sum(CASE WHEN exact_match THEN 1 ELSE 0 END) AS block, sum(count(*)) OVER (PARTITION BY target) AS descriptive FROM told GROUP BY target, anchor_key) WHERE block >= 5 AND block >= 0.5 * descriptive),
judged AS (
  SELECT w.*, CASE WHEN NOT generic THEN fit END AS own_fit, coalesce(NOT generic AND fit < fit_split, false) AS weak, b.target IS NOT NULL AND NOT listing AS over,
    status >= 400 AS broken, status BETWEEN 300 AND 399 AS moved, status < 300 AND NOT indexable AS closed FROM wide w LEFT JOIN blocked b ON b.target = w.target AND b.anchor_key = w.anchor_key),
flagged AS (
  SELECT *, NOT generic AND coalesce(keyword_jaccard = 0, false) AND (weak OR own_fit IS NULL) AS misaligned, weak AND coalesce(context_relevance < context_split, false) AS off_topic FROM judged),
spent AS (SELECT *, coalesce(equity > top, false) AND (off_topic OR NOT indexable OR status >= 300 OR coalesce(target_hub = -1, false)) AS wasted, broken OR moved OR closed OR NOT is_follow OR canonical IS NOT NULL AS broke FROM flagged),
verdicts AS (
  SELECT *, CASE WHEN keyword_cosine IS NULL THEN keyword_jaccard ELSE least(1.0, 0.7 * keyword_jaccard + 0.3 * keyword_cosine) END AS aligned, NOT broke AND NOT listing AND off_topic AND misaligned AND (wasted OR outbound > saturation) AND NOT outbound > fence AS removes FROM spent),
answered AS (
  SELECT source, position, target, placeholder, listing, weak, misaligned, over, generic, NOT placeholder AND broke AS fix, NOT placeholder AND removes AS remove, equity,
    list_filter([CASE WHEN broken THEN 'BROKEN' END, CASE WHEN moved THEN 'REDIRECTED' END, CASE WHEN closed THEN 'NOINDEX_TARGET' END, CASE WHEN NOT is_follow THEN 'NOFOLLOW' END, CASE WHEN generic THEN 'GENERIC' END,
      CASE WHEN misaligned THEN 'MISALIGNED' END, CASE WHEN over THEN 'OVER_OPTIMISED' END, CASE WHEN off_topic THEN 'OFF_TOPIC' END, CASE WHEN wasted THEN 'WASTED_EQUITY' END], lambda x: x IS NOT NULL AND NOT placeholder) AS flags,
    CASE WHEN placeholder OR (aligned IS NULL AND own_fit IS NULL AND context_relevance IS NULL) THEN NULL ELSE least(CASE WHEN generic THEN 20.0 ELSE 100.0 END, greatest(0.0, 100 * (0.35 * coalesce(aligned, 0) + 0.35 * coalesce(own_fit, 0) + 0.3 * coalesce(context_relevance, 0))
      / (CASE WHEN aligned IS NULL THEN 0 ELSE 0.35 END + CASE WHEN own_fit IS NULL THEN 0 ELSE 0.35 END + CASE WHEN context_relevance IS NULL THEN 0 ELSE 0.3 END))) END AS quality,
    CASE WHEN NOT placeholder AND canonical <> source THEN canonical END AS fix_target, NOT placeholder AND NOT broke AND NOT removes AND NOT listing AND (generic OR misaligned OR over OR weak) AS reanchor FROM verdicts)"""


def _assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.assess(_audit_edges(spark, sf_dir), 0.55, 0.45)


@query(f"{_AUDIT} SELECT source, position, array_to_string(flags, ',') AS flags, round(quality, 4) AS quality, fix, fix_target, remove, reanchor FROM answered")
def link_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assessed(spark, sf_dir).select("source", "position", F.array_join("flags", ",").alias("flags"), F.round("quality", 4).alias("quality"), "fix", "fix_target", "remove", "reanchor")


@query(f"{_AUDIT} SELECT source, position, round(equity, 9) AS equity FROM answered")
def equity_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assessed(spark, sf_dir).select("source", "position", F.round("equity", 9).alias("equity"))


@query(f"""{_AUDIT}, phrases AS (SELECT DISTINCT source, target, 'topic ' || CAST(target % 5 AS VARCHAR) AS phrase, (source + target) % 10 / 10 AS jaccard, (target % 8) / 8 AS phrase_fit FROM answered WHERE (source + target) % 2 = 0),
tried AS (
  SELECT a.source, a.position, min(p.phrase) AS proposed FROM answered a JOIN verdicts v ON v.source = a.source AND v.position = a.position JOIN phrases p ON p.source = a.source AND p.target = a.target
  WHERE a.reanchor AND p.phrase <> v.anchor_key AND (a.generic OR a.over OR coalesce(p.jaccard > v.aligned, false) OR coalesce(p.phrase_fit > v.own_fit, false)) GROUP BY a.source, a.position)
SELECT a.source, a.position, CASE WHEN fix THEN 'FIX' WHEN remove THEN 'REMOVE' WHEN reanchor AND (t.proposed IS NOT NULL OR generic OR over) THEN 'REANCHOR' END AS verdict, t.proposed
FROM answered a LEFT JOIN tried t ON t.source = a.source AND t.position = a.position""")
def audit_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = materialize(_assessed(spark, sf_dir), "audit-assessed")
    s, t = F.col("source"), F.col("target")
    phrase = F.concat(F.lit("topic "), (t % 5).cast("string"))
    pairs = found.select("source", "target").distinct().where((s + t) % 2 == 0)
    proposals = pairs.select("source", "target", F.lit(1).alias("place"), phrase.alias("phrase"), phrase.alias("phrase_key"), ((s + t) % 10 / 10).alias("keyword_jaccard"), F.lit(None).cast("double").alias("keyword_cosine"), (t % 8 / 8).alias("phrase_fit"))
    return audit.decide(found, proposals).select("source", "position", "verdict", "proposed")


@query(f"{_AUDIT} SELECT flag AS name, count(*) AS links FROM (SELECT unnest(flags) AS flag FROM answered) GROUP BY flag")
def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = spark.createDataFrame([], "source long, target long, place int, phrase string, phrase_key string, keyword_jaccard double, keyword_cosine double, phrase_fit double")
    return audit.report(audit.decide(materialize(_assessed(spark, sf_dir), "audit-assessed"), none)).where("kind = 'flag'").select("name", "links")


@query("""
, twenty AS (SELECT l.*, l.target % 20 AS hub_page, 'topic ' || CAST(l.target % 20 % 3 AS VARCHAR) AS text FROM site_links l),
told AS (SELECT hub_page AS target, text, position % 4 > 0 AS exact FROM twenty WHERE anchor <> 'read more')
SELECT target, text AS anchor_key, CAST(block AS BIGINT) AS block, CAST(descriptive AS BIGINT) AS descriptive FROM (
  SELECT target, text, sum(CASE WHEN exact THEN 1 ELSE 0 END) AS block, sum(count(*)) OVER (PARTITION BY target) AS descriptive FROM told GROUP BY target, text) WHERE block >= 5 AND block >= 0.5 * descriptive""")
def over_optimised(spark: SparkSession, sf_dir: str) -> DataFrame:
    twenty = site_links(spark, sf_dir).select((F.col("target") % 20).alias("target"), F.concat(F.lit("topic "), (F.col("target") % 20 % 3).cast("string")).alias("anchor_key"), (F.col("anchor") == "read more").alias("generic"), (F.col("position") % 4 > 0).alias("exact_match"))
    return audit.blocks(twenty)


# Evaluation


@query("""
, rows AS (SELECT n_chars % 50 AS score, quality AS label FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
per AS (SELECT score, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS p, sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS q FROM rows GROUP BY score),
won AS (SELECT p, q, p * (coalesce(sum(q) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + q / 2.0) AS w FROM per)
SELECT CAST(sum(p) AS BIGINT) AS positives, CAST(sum(q) AS BIGINT) AS negatives, round(sum(w) / (sum(p) * sum(q)), 6) AS auc FROM won""")
def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return scoring.auc(rows.select((F.col("n_chars") % 50).alias("score"), F.col("quality").alias("label")), "score", "label")


@query("""
, rows AS (SELECT quality AS y, CASE WHEN d.doc_id % 7 > 0 THEN n_chars % 50 END AS length, d.doc_id % 10 AS digit FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
long AS (SELECT y, 'length' AS "column", CAST(length AS DOUBLE) AS x FROM rows UNION ALL SELECT y, 'digit', CAST(digit AS DOUBLE) FROM rows),
ranked AS (SELECT *, rank() OVER (PARTITION BY "column", x IS NULL ORDER BY x) + (count(*) OVER (PARTITION BY "column", x) - 1) / 2.0 AS r,
  rank() OVER (PARTITION BY "column" ORDER BY x NULLS FIRST) + (count(*) OVER (PARTITION BY "column", x) - 1) / 2.0 AS up, rank() OVER (PARTITION BY "column" ORDER BY -x NULLS FIRST) + (count(*) OVER (PARTITION BY "column", x) - 1) / 2.0 AS down FROM long),
sums AS (SELECT "column", sum(CASE WHEN x IS NOT NULL AND y = 1 THEN r END) AS r, sum(CASE WHEN y = 1 THEN up END) AS up, sum(CASE WHEN y = 1 THEN down END) AS down, sum(CASE WHEN x IS NOT NULL THEN y END) AS p, count(x) AS k, sum(y) AS q, count(*) AS n FROM ranked GROUP BY "column")
SELECT "column", round((r - p * (p + 1) / 2) / (p * (k - p)), 6) AS auc, round(k / n, 6) AS coverage, round(0.5 + greatest(abs((up - q * (q + 1) / 2) / (q * (n - q)) - 0.5), abs((down - q * (q + 1) / 2) / (q * (n - q)) - 0.5)), 6) AS ranker_auc FROM sums""")
def feature_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = rows.select(F.col("quality").alias("y"), F.when(F.col("doc_id") % 7 > 0, F.col("n_chars") % 50).alias("length"), (F.col("doc_id") % 10).alias("digit"))
    found = evaluation.feature_auc(rows, ["length", "digit"], "y")
    return found.select("column", *[F.round(c, 6).alias(c) for c in ("auc", "coverage", "ranker_auc")])


@query("""
WITH rows AS (SELECT l_orderkey AS source, l_linenumber AS item, l_linenumber % 3 AS label, l_quantity AS score FROM lineitem),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, item) AS r, row_number() OVER (PARTITION BY source ORDER BY label DESC, item) AS i FROM rows),
sums AS (SELECT source, sum(CASE WHEN r <= 3 THEN (power(2, label) - 1) / log2(r + 1) ELSE 0 END) AS dcg, sum(CASE WHEN i <= 3 THEN (power(2, label) - 1) / log2(i + 1) ELSE 0 END) AS ideal,
  sum(CASE WHEN r <= 3 AND label > 0 THEN 1 ELSE 0 END) AS hits, sum(CASE WHEN label > 0 THEN 1 ELSE 0 END) AS wanted FROM ranked GROUP BY source)
SELECT source, round(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END, 6) AS ndcg, round(hits / 3, 6) AS precision, round(CASE WHEN wanted > 0 THEN hits / wanted ELSE 0 END, 6) AS recall FROM sums""", site_tables=False)
def ranking_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_linenumber").alias("item"), (F.col("l_linenumber") % 3).alias("label"), F.col("l_quantity").alias("score"))
    return scoring.ranking_measures(rows, "source", "score", "label", "item", 3)


@query("""
WITH v AS (SELECT c_nationkey + 1 AS x FROM customer), r AS (SELECT x, row_number() OVER (ORDER BY x) AS i, count(*) OVER () AS n FROM v)
SELECT round(2 * sum(i * x) / (max(n) * sum(x)) - (max(n) + 1) / max(n), 6) AS gini FROM r""", site_tables=False)
def gini(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.gini(table(spark, sf_dir, "customer").select((F.col("c_nationkey") + 1).alias("x")), "x")


@query("SELECT url, CASE WHEN substr(sha256('fold' || chr(9) || url), 1, 4) < '3333' THEN 'held_out' ELSE 'train' END AS split FROM site_pages")
def split_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.substring(F.sha2(F.concat(F.lit("fold\t"), F.col("url")), 256), 1, 4)
    return site_pages(spark, sf_dir).select("url", F.when(key < "3333", "held_out").otherwise("train").alias("split"))


@query("SELECT c_custkey, CAST(ntile(5) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS INTEGER) AS band FROM customer", site_tables=False)
def label_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", F.ntile(5).over(by).alias("band"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1", site_tables=False)
def latest_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text_tables.latest_per(table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()])
    return rows.select("o_custkey", "o_orderkey", "o_totalprice")


# Anchors


def _keyword_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages as the keyword chain reads them, a client's keywords that are primary, and search rows of ten impressions or more."""
    first = F.nullif(F.regexp_extract("text", "[^ \\t-\\r]+", 0), F.lit(""))
    line = F.trim(F.substring_index("text", "\n", 1))
    pages = site_pages(spark, sf_dir, {"h1": line, "first": first, "body_hash": F.sha2("text", 256)}).select(
        "page", "language", "h1", F.array(F.struct(F.lit(1).alias("level"), F.col("first").alias("text"))).alias("headings"), F.concat("first", F.lit(" | Example")).alias("meta_title"), "body_hash"
    )
    strategic = tenant.strategic_rows(spark, sf_dir).where("is_primary")
    queries = search_rows(spark, sf_dir).where("impressions >= 10").select("page", "query", F.col("impressions").cast("double").alias("opportunity"))
    return pages, strategic, queries


_NO_TOPIC = ", ".join("'" + x.replace("'", "''") + "'" for x in sorted(GENERIC | keywords.PLACEHOLDERS))


@query(f"""{tenant.SQL}
, usable AS (SELECT page, trim(regexp_replace(keyword, '\\s+', ' ', 'g')) AS text, lower(trim(regexp_replace(keyword, '\\s+', ' ', 'g'))) AS k, language, priority, is_primary FROM strategic WHERE is_primary AND length(language) >= 2 AND trim(keyword) <> ''),
one AS (SELECT page, k, language, arg_min(text, (NOT is_primary, -coalesce(priority, 0), k, text)) AS keyword, max(priority) AS priority FROM usable GROUP BY page, k, language),
first_keyword AS (SELECT page, keyword, language FROM one QUALIFY row_number() OVER (PARTITION BY page ORDER BY coalesce(priority, 0) DESC, k, keyword, language) = 1),
first_query AS (SELECT page, query, CAST(impressions AS DOUBLE) AS opportunity FROM search_rows WHERE impressions >= 10 QUALIFY row_number() OVER (PARTITION BY page ORDER BY impressions DESC, lower(query), query) = 1),
texts AS (SELECT page, sha256(body) AS body_hash, trim(regexp_replace(string_split(body, chr(10))[1], '\\s+', ' ', 'g')) AS line, list_filter(regexp_split_to_array(body, '[ \\t-\\r]+'), lambda w: w <> '')[1] AS word FROM site_pages),
heads AS (SELECT page, body_hash, 0 AS place, 'H1' AS rung, line AS text FROM texts WHERE line <> '' UNION ALL SELECT page, body_hash, 1, 'H1', word FROM texts WHERE word <> line UNION ALL SELECT page, body_hash, 2, 'TITLE', word FROM texts),
keyed AS (SELECT *, lower(text) AS k FROM heads WHERE text IS NOT NULL),
spread AS (SELECT k FROM keyed GROUP BY k HAVING count(DISTINCT body_hash) >= 3),
fit AS (SELECT page, rung, text FROM keyed WHERE regexp_matches(text, '\\pL') AND regexp_replace(k, '^\\pP+|\\pP+$', '', 'g') NOT IN ({_NO_TOPIC}) AND k NOT IN (SELECT k FROM spread) AND k <> 'example' QUALIFY row_number() OVER (PARTITION BY page ORDER BY place) = 1)
SELECT p.page, coalesce(b.keyword, q.query, f.text) AS keyword, coalesce(b.language, p.language) AS language, CASE WHEN b.page IS NOT NULL THEN 'STRATEGIC' WHEN q.page IS NOT NULL THEN 'GSC' ELSE f.rung END AS rung, CASE WHEN b.page IS NULL THEN q.opportunity END AS opportunity
FROM site_pages p LEFT JOIN first_keyword b ON b.page = p.page LEFT JOIN first_query q ON q.page = p.page LEFT JOIN fit f ON f.page = p.page WHERE coalesce(b.keyword, q.query, f.text) IS NOT NULL""")
def keyword_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, strategic, queries = _keyword_tables(spark, sf_dir)
    return keywords.resolve(pages, strategic, queries, ["Example"])


@query()
def anchor_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ladder over the candidate pairs, with the keywords that the chain gives their targets."""
    pages, strategic, queries = _keyword_tables(spark, sf_dir)
    asked = keywords.ranked_keywords(materialize(keywords.resolve(pages, strategic, queries, ["Example"]), "keywords"), strategic, queries).select("page", "keyword", "rank")
    texts = site_pages(spark, sf_dir).select("page", "body", F.array().cast("array<string>").alias("headings"), "language")
    links = site_links(spark, sf_dir).select("source", "anchor", F.col("anchor").alias("around"))
    return anchors.extract(_candidates(spark, sf_dir), texts, asked, links)


# Output


@query("SELECT source, position, target, substr(sha256('tenant' || chr(31) || 'add' || chr(31) || CAST(source AS VARCHAR) || chr(31) || CAST(target AS VARCHAR) || chr(31) || CAST(position AS VARCHAR)), 1, 16) AS id FROM site_links")
def recommendation_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.concat_ws("\x1f", F.lit("tenant"), F.lit("add"), *[F.col(c).cast("string") for c in ("source", "target", "position")])
    return site_links(spark, sf_dir).select("source", "position", "target", F.substring(F.sha2(parts, 256), 1, 16).alias("id"))


@query("SELECT source, position, target FROM site_links WHERE source > 20 OR (source = 20 AND position > 3) ORDER BY source, position LIMIT 50")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_tables.keyset_page(site_links(spark, sf_dir).select("source", "position", "target"), ["source", "position"], (20, 3), 50)


@query("""
, counted AS (SELECT source, count(*) AS outbound FROM site_links GROUP BY source)
SELECT p.page, CAST(greatest(0, least(12, greatest(1, len(list_filter(regexp_split_to_array(coalesce(p.body, ''), '[ \\t-\\r]+'), lambda w: w <> '')) // 80)) - coalesce(c.outbound, 0)) AS BIGINT) AS budget FROM site_pages p LEFT JOIN counted c ON c.source = p.page""")
def link_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = site_links(spark, sf_dir).groupBy(F.col("source").alias("page")).agg(F.count("*").alias("outbound"))
    words = F.size(F.filter(F.split("body", "[ \\t-\\r]+"), lambda w: w != ""))
    pages = site_pages(spark, sf_dir).join(out, "page", "left")
    return pages.select("page", recommend.link_budget(words, F.col("outbound"), 12, 80).alias("budget"))


@query("""
SELECT language, count(*) AS pages, count(DISTINCT hub) AS hubs, CAST(sum(CASE WHEN hub < 0 THEN 1 ELSE 0 END) AS BIGINT) AS noise, round(avg(length(body)), 6) AS mean_length FROM site_pages GROUP BY language""")
def site_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_pages(spark, sf_dir).groupBy("language").agg(
        F.count("*").alias("pages"), F.count_distinct("hub").alias("hubs"), F.count_if(F.col("hub") < 0).alias("noise"), F.round(F.avg(F.length("body")), 6).alias("mean_length")
    )


@query(f"""{tenant.SQL}, typed AS (SELECT target, CASE WHEN anchor = 'read more' THEN 'GENERIC' WHEN target % 3 = 0 THEN 'EXACT' WHEN target % 3 = 1 THEN 'PARTIAL' ELSE 'NATURAL' END AS type FROM site_links)
SELECT p.page, p.language, p.hub, p.inbound, p.outbound, CASE WHEN p.inbound > 0 THEN 'linked' WHEN p.page % 5 + p.page % 2 > 0 THEN 'template_only' ELSE 'orphan' END AS label,
  (SELECT count(*) FROM typed t WHERE t.target = p.page AND t.type = 'EXACT') AS anchors_exact, (SELECT count(*) FROM typed t WHERE t.target = p.page AND t.type = 'GENERIC') AS anchors_generic FROM tenant_pages p""")
def page_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("target") % 3
    typed = site_links(spark, sf_dir).select("target", F.when(F.col("anchor") == "read more", "GENERIC").when(t == 0, "EXACT").when(t == 1, "PARTIAL").otherwise("NATURAL").alias("type"))
    pages = tenant.pages(spark, sf_dir).withColumn("menu", F.col("page") % 5).withColumn("footer", F.col("page") % 2)
    return listings.page_profiles(pages, typed).select("page", "language", "hub", "inbound", "outbound", "label", "anchors_exact", "anchors_generic")


@query(f"""{tenant.SQL}, flows AS (SELECT a.hub, sum(CASE WHEN a.hub = b.hub THEN 1 ELSE 0 END) AS inside, sum(CASE WHEN a.hub = b.hub THEN 0 ELSE 1 END) AS outside FROM crawled c JOIN tenant_pages a ON a.page = c.source JOIN tenant_pages b ON b.page = c.target WHERE a.hub >= 0 GROUP BY a.hub)
SELECT p.hub, count(*) AS pages, count(DISTINCT language) AS languages, max(i.page) AS pillar, CAST(sum(CASE WHEN inbound = 0 THEN 1 ELSE 0 END) AS BIGINT) AS orphans, round(avg(rank_percentile), 6) AS mean_percentile,
  CAST(coalesce(max(f.inside), 0) AS BIGINT) AS links_inside, CAST(coalesce(max(f.outside), 0) AS BIGINT) AS links_out FROM tenant_pages p LEFT JOIN pillars i ON i.hub = p.hub LEFT JOIN flows f ON f.hub = p.hub WHERE p.hub >= 0 GROUP BY p.hub""")
def hub_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = listings.hub_summaries(tenant.pages(spark, sf_dir), site_links(spark, sf_dir), graph.hub_pillars(site_pages(spark, sf_dir)))
    return found.withColumn("mean_percentile", F.round("mean_percentile", 6))


@query(f"""{tenant.SQL} SELECT count(*) AS pages, (SELECT count(*) FROM votes) AS links, CAST(sum(CASE WHEN inbound = 0 THEN 1 ELSE 0 END) AS BIGINT) AS orphans, CAST(sum(CASE WHEN outbound = 0 THEN 1 ELSE 0 END) AS BIGINT) AS dead_ends,
  count(DISTINCT CASE WHEN hub >= 0 THEN hub END) AS hubs, CAST(sum(CASE WHEN hub = -1 THEN 1 ELSE 0 END) AS BIGINT) AS noise, count(DISTINCT language) AS languages, CAST(sum(words) AS BIGINT) AS words FROM tenant_pages""")
def site_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.site_summary(tenant.pages(spark, sf_dir), site_links(spark, sf_dir))


@query("SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2", site_tables=False)
def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour"))
    return rows.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


# The queries of the other module register themselves with these.
from linkloom import catalog_scale  # noqa: E402, F401
