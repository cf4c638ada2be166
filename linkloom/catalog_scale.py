"""More queries of the registry: indexed search, tables written by key, vectors by content, batches, digests, variants and samples.

Registered with those of :mod:`linkloom.catalog`; stores are built below the shared scratch folder from the given tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.catalog import _LINK_COSINES, _candidates, _contexts, _feature_sql, _score_sql, _scores, query
from linkloom.functions.vector import cosine
from linkloom.operators import batches, digests, features, heldout, negatives, outputs, percentiles, reports, retrieval, scoring, semantic, url_variants, vector_index
from linkloom.plans.scratch import materialize, new_path
from linkloom.sources import inputs, tenant
from linkloom.sources.keyed import KeyedTable
from linkloom.sources.site import site_links, site_pages, table
from linkloom.sources.store import Snapshot, Store
from linkloom.sources.vectors import VectorStore, text_key
from linkloom.streaming import upserts
from linkloom.streaming.metrics import read_events

# Indexed retrieval


@query("""
, scored AS (
  SELECT t.page AS target, s.page AS source, round(list_dot_product(t.vector, s.vector) / (sqrt(list_dot_product(t.vector, t.vector)) * sqrt(list_dot_product(s.vector, s.vector))), 6) AS similarity
  FROM site_pages t JOIN site_pages s ON t.language = s.language AND t.page <> s.page
  LEFT JOIN (SELECT DISTINCT source, target FROM site_links) l ON l.source = s.page AND l.target = t.page WHERE l.source IS NULL AND t.page % 50 = 0)
SELECT target, source, CAST(rank AS INTEGER) AS rank, similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY target ORDER BY similarity DESC, source) AS rank FROM scored) WHERE rank <= 10""")
def candidate_retrieval_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = vector_index.build(site_pages(spark, sf_dir))
    return vector_index.nearest(index, F.col("page") % 50 == 0, site_links(spark, sf_dir))


@query()
def index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of a search of some cells against the exact one, with as many probes as the other half of the queries asks for; and the pairs it compares."""
    index, links, page = vector_index.build(site_pages(spark, sf_dir), cells=32), site_links(spark, sf_dir), F.col("page")
    truth = materialize(vector_index.nearest(index, page % 50 == 0, links), "index-truth")
    probes = vector_index.needed_probes(index, truth.where("target % 100 = 0"), 0.97)
    asked = page % 100 == 50
    found = materialize(vector_index.nearest(index, asked, links, probes=probes, exact=False), "index-some")
    measured = vector_index.recall(found, truth.where("target % 100 = 50")).withColumn("probes", F.lit(probes))
    return measured.crossJoin(vector_index.compared(index, asked, probes))  # one row each


# Tables written by key


@query("""
WITH old AS (SELECT doc_id AS page, source, n_chars AS size FROM documents),
fresh AS (SELECT page_id * 3 AS page, 'crawled' AS source, CAST(length(html) AS BIGINT) AS size FROM pages),
merged AS (SELECT * FROM old WHERE page NOT IN (SELECT page FROM fresh) UNION ALL SELECT f.page, coalesce(o.source, f.source), f.size FROM fresh f LEFT JOIN old o ON o.page = f.page),
kept AS (SELECT * FROM merged WHERE page NOT IN (SELECT vec_id FROM embeddings WHERE label = 9))
SELECT k.page, k.source, CASE WHEN l.doc_id IS NULL THEN k.size ELSE l.quality END AS size FROM kept k LEFT JOIN (SELECT DISTINCT doc_id, CAST(quality AS BIGINT) AS quality FROM labels) l ON l.doc_id = k.page""", site_tables=False)
def keyed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is stored after an upsert that keeps sources, a delete and a change of one column."""
    stored = KeyedTable(spark, new_path(spark, "keyed"), "page bigint, source string, size bigint", ["page"], 16)
    stored.upsert(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), "source", F.col("n_chars").alias("size")))
    fresh = table(spark, sf_dir, "pages").select((F.col("page_id") * 3).alias("page"), F.lit("crawled").alias("source"), F.length("html").cast("bigint").alias("size"))
    stored.upsert(fresh, keep=["source"])
    stored.delete(table(spark, sf_dir, "embeddings").where("label = 9").select(F.col("vec_id").alias("page")))
    stored.set_columns(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page"), F.col("quality").cast("bigint").alias("size")).distinct(), ["size"])
    return stored.read()


@query("""
, later AS (SELECT * FROM site_pages WHERE language <> 'en')
SELECT 'before' AS moment, (SELECT count(*) FROM site_pages) AS pages, count(*) AS links, CAST(0 AS BIGINT) AS strays FROM site_links
UNION ALL SELECT 'after', (SELECT count(*) FROM later), (SELECT count(*) FROM site_links WHERE source IN (SELECT page FROM later)), CAST(0 AS BIGINT)""")
def snapshot_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, links, and links without their page, of a snapshot taken before and of one taken after a commit of both tables."""
    store = Store(spark, new_path(spark, "tenant"))
    store.write_all({"pages": site_pages(spark, sf_dir).select("page", "language"), "links": site_links(spark, sf_dir)})
    before = store.snapshot()

    def drop_english(now: Snapshot) -> dict[str, DataFrame]:
        pages = now.read("pages").where("language <> 'en'")
        return {"pages": pages, "links": now.read("links").join(pages.select(F.col("page").alias("source")), "source", "left_semi")}

    store.change(drop_english)
    rows = []
    for moment, now in (("before", before), ("after", store.snapshot())):
        strays = now.read("links").join(now.read("pages").select(F.col("page").alias("source")), "source", "left_anti").agg(F.count("*")).scalar()
        pages = now.read("pages").agg(F.count("*")).scalar()
        rows.append(now.read("links").agg(F.count("*").alias("links")).select(F.lit(moment).alias("moment"), pages.alias("pages"), "links", strays.alias("strays")))
    return rows[0].unionByName(rows[1])


# Vectors by content


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[VectorStore, DataFrame]:
    """A store filled twice, with unusable rows in the first filling, and the documents with their keys."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text_key(F.col("text")).alias("key"))
    rows = docs.join(table(spark, sf_dir, "embeddings"), F.col("doc_id") == F.col("vec_id"))
    one = rows.groupBy("key").agg(F.min_by("embedding", "doc_id").alias("vector"), F.min_by("label", "doc_id").alias("label"))
    store = VectorStore(spark, new_path(spark, "vectors"), 64, 16)
    store.add(one.where("label < 6").select("key", F.when(F.col("label") == 3, F.slice("vector", 1, 9)).otherwise(F.col("vector")).alias("vector")), "m1")
    store.add(one.where("label between 3 and 7").select("key", F.transform("vector", lambda x: -x).alias("vector")), "m1")
    store.add(one.where("label = 9"), "m2")
    return store, docs


_STORED = """
WITH docs AS (SELECT doc_id, sha256(text) AS key FROM documents),
one AS (SELECT key, embedding, label FROM docs JOIN embeddings ON vec_id = doc_id QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id) = 1),
held AS (SELECT key, CASE WHEN label IN (0, 1, 2, 4, 5) THEN embedding ELSE list_transform(embedding, lambda x: -x) END AS vector FROM one WHERE label <= 7)"""


@query(f"{_STORED} SELECT DISTINCT key FROM docs WHERE key IS NOT NULL AND key NOT IN (SELECT key FROM held)", site_tables=False)
def missing_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, docs = _vectors(spark, sf_dir)
    return store.missing(docs, "m1")


@query(f"{_STORED} SELECT doc_id, d.key, round(CAST(vector[1] AS DOUBLE), 6) AS first, len(vector) AS length FROM docs d LEFT JOIN held h ON h.key = d.key", site_tables=False)
def gathered_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, docs = _vectors(spark, sf_dir)
    store.compact()
    found = store.gathered(docs, "m1")
    return found.select("doc_id", "key", F.round(F.get("vector", 0).cast("double"), 6).alias("first"), F.when(F.col("vector").isNotNull(), F.size("vector").cast("bigint")).alias("length"))


# Work for an embedding service


@query("""
WITH RECURSIVE counts AS (
  SELECT row_number() OVER (ORDER BY doc_id) AS place, doc_id, least(8000, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t-\\r]+'), lambda w: w <> ''))) AS tokens FROM documents),
walk(place, batch, total) AS (
  SELECT place, place, CAST(tokens AS BIGINT) FROM counts WHERE place = 1
  UNION ALL SELECT c.place, CASE WHEN w.total + c.tokens > 20000 OR c.place - w.batch >= 64 THEN c.place ELSE w.batch END, CASE WHEN w.total + c.tokens > 20000 OR c.place - w.batch >= 64 THEN c.tokens ELSE w.total + c.tokens END
  FROM walk w JOIN counts c ON c.place = w.place + 1)
SELECT c.doc_id, c.place, w.batch, CAST(c.tokens AS BIGINT) AS tokens FROM counts c JOIN walk w ON w.place = c.place""", site_tables=False)
def token_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in requests of at most 64 texts and 20,000 words, each text cut to 8,000 before."""
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "[ \\t-\\r]+"), lambda w: w != ""))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.least(F.lit(8000), words).cast("bigint").alias("tokens"))
    return batches.token_batches(rows, [F.col("doc_id")], "tokens", 20_000, 64, 512).select("doc_id", F.col("place").cast("bigint").alias("place"), "batch", "tokens")


# Urls, samples, digests


@query("""
WITH crawl AS (SELECT url, md5(html) AS body, regexp_replace(url, '[?#].*$', '') AS base, string_split(regexp_extract(coalesce(url, ''), '^[^?#]*\\?([^#]*)', 1), '&') AS raw FROM pages),
parts AS (SELECT row_number() OVER () AS id, url, body, base, raw FROM crawl),
named AS (SELECT id, lower(url_decode(split_part(x, '=', 1))) AS name, url_decode(regexp_extract(x, '^[^=]*=(.*)$', 1)) AS value, i FROM (SELECT id, unnest(raw) AS x, generate_subscripts(raw, 1) AS i FROM parts)),
params AS (SELECT id, name, value FROM named WHERE value <> '' QUALIFY row_number() OVER (PARTITION BY id, name ORDER BY i DESC) = 1),
pairs AS (SELECT a.id AS a, b.id AS b, a.body = b.body AS same FROM parts a JOIN parts b ON a.base = b.base AND a.id < b.id WHERE a.body IS NOT NULL AND b.body IS NOT NULL),
differ AS (
  SELECT p.a, p.b, p.same, n.name FROM pairs p JOIN (SELECT DISTINCT id, name FROM params) n ON n.id = p.a OR n.id = p.b
  LEFT JOIN params x ON x.id = p.a AND x.name = n.name LEFT JOIN params y ON y.id = p.b AND y.name = n.name WHERE x.value IS DISTINCT FROM y.value GROUP BY ALL),
single AS (SELECT any_value(name) AS name, any_value(same) AS same FROM differ GROUP BY a, b HAVING count(*) = 1)
SELECT p.name, count(*) AS urls, (SELECT count(*) FROM single s WHERE s.name = p.name AND NOT same) AS content_changed, (SELECT count(*) FROM single s WHERE s.name = p.name AND same) AS content_same FROM params p GROUP BY p.name""", site_tables=False)
def url_param_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    crawl = table(spark, sf_dir, "pages").select("url", F.md5(F.col("html").cast("binary")).alias("body"))
    return url_variants.evidence(crawl, F.regexp_replace("url", "[?#].*$", ""))


def _rounds() -> str:
    parts, mixed = [], "CAST('0x' || substr(md5(CAST(r AS VARCHAR) || ':42:{}'), 1, 12) AS BIGINT)"
    for i in range(negatives.ROUNDS):
        parts.append(f"f{i + 1} AS (SELECT draw, s, r AS l, xor(l, {mixed.format(i)} % s) AS r FROM f{i})")
    return ", ".join(parts)


_NEGATIVES = f"""
, ranked AS (SELECT page, row_number() OVER (ORDER BY page) - 1 AS place FROM site_pages),
size_ AS (SELECT count(*) AS n, CAST(pow(2, greatest(1, ceil(log2(count(*))))) AS BIGINT) AS s FROM ranked),
f0 AS (SELECT draw, s, draw // s AS l, draw % s AS r FROM (SELECT unnest(range(0, least(100000, s * s))) AS draw, s FROM size_)), {_rounds()},
draws AS (SELECT f.draw, a.page AS source, b.page AS target FROM f{negatives.ROUNDS} f JOIN ranked a ON a.place = f.l JOIN ranked b ON b.place = f.r WHERE a.page <> b.page),
chosen AS (
  SELECT d.draw, d.source, d.target FROM draws d JOIN site_pages a ON a.page = d.source JOIN site_pages b ON b.page = d.target
  WHERE a.hub >= 0 AND b.hub >= 0 AND a.hub <> b.hub AND NOT EXISTS (SELECT 1 FROM site_links l WHERE l.source = d.source AND l.target = d.target) ORDER BY d.draw LIMIT 5000)"""


def _negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = site_pages(spark, sf_dir).select("page", "hub")
    hubs = lambda side: pages.select(F.col("page").alias(side), F.col("hub").alias(f"hub_{side}"))
    none = F.lit(None).cast("int")

    def other_topics(drawn: DataFrame) -> DataFrame:
        both = drawn.join(hubs("source"), "source").join(hubs("target"), "target")
        return both.where(semantic.unrelated(F.col("hub_source"), F.col("hub_target"), none, none)).select("draw", "source", "target")

    return negatives.negative_pairs(pages, site_links(spark, sf_dir), other_topics)


@query(f"{_NEGATIVES} SELECT * FROM chosen")
def negative_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _negatives(spark, sf_dir)


@query(f"""{_LINK_COSINES}{_NEGATIVES},
unlike AS (SELECT round(list_dot_product(a.vector, b.vector) / (sqrt(list_dot_product(a.vector, a.vector)) * sqrt(list_dot_product(b.vector, b.vector))), 6) AS cosine FROM chosen c JOIN site_pages a ON a.page = c.source JOIN site_pages b ON b.page = c.target),
cut AS (SELECT CASE WHEN count(*) < 300 THEN 0.6 ELSE greatest(0.35, least(0.9, quantile_cont(cosine, 0.99))) END AS value, count(*) AS negatives,
  CASE WHEN count(*) < 300 THEN 'default' WHEN quantile_cont(cosine, 0.99) < 0.35 OR quantile_cont(cosine, 0.99) > 0.9 THEN 'bounded' ELSE 'quantile' END AS basis FROM unlike)
SELECT round(value, 6) AS value, negatives, basis, (SELECT count(*) FROM cosines) AS positives, round((SELECT avg(CASE WHEN similarity >= value THEN 1.0 ELSE 0.0 END) FROM cosines), 6) AS recall FROM cut""")
def semantic_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold from pairs of unrelated pages, and the share of links that it keeps."""
    pages = site_pages(spark, sf_dir)
    drawn = materialize(_negatives(spark, sf_dir), "negatives")
    both = drawn.join(pages.select(F.col("page").alias("source"), F.col("vector").alias("va")), "source").join(pages.select(F.col("page").alias("target"), F.col("vector").alias("vb")), "target")
    found = semantic.threshold(both.select(F.round(cosine("va", "vb"), 6).alias("cosine")), retrieval.link_cosines(pages, site_links(spark, sf_dir)).select(F.col("similarity").alias("cosine")))
    return found.select(F.round("value", 6).alias("value"), "negatives", "basis", "positives", F.round("recall", 6).alias("recall"))


def _level(name: str, below: str, block: int) -> str:
    return f"{name} AS (SELECT (place - 1) // {block} + 1 AS place, sha256(string_agg(digest, '' ORDER BY place)) AS digest FROM {below} GROUP BY 1)"


@query(f"""
WITH leaves AS (SELECT doc_id, sha256(coalesce(len(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || ',' || coalesce(len(text) || ':' || text, '-') || ',' || coalesce(len(source) || ':' || source, '-')) AS digest FROM documents),
l0 AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, digest) AS place, digest FROM leaves), {_level('l1', 'l0', 64)}, {_level('l2', 'l1', 64)}, {_level('l3', 'l2', 64)}
SELECT (SELECT count(*) FROM l0) AS rows, max(digest) AS digest FROM l3""", site_tables=False)
def documents_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three levels of 64, as the SQL fixes them; above 262,144 documents the greatest of several roots."""
    return digests.table_digest(table(spark, sf_dir, "documents"), ["doc_id"], ["doc_id", "text", "source"], 64, roots=True)


# Held-out rounds

FOLDS, STEPS = 4, 5
_HASHED = f"""
, pairs0 AS (SELECT DISTINCT source, target FROM site_links),
hashed AS (SELECT *, sha256('42' || chr(9) || source || chr(9) || target) AS h FROM pairs0),
hidden AS (SELECT fold, source, target FROM (SELECT source, target, CASE {' '.join(f"WHEN h >= '{heldout._bound(i * heldout.SHARE)}' AND h < '{heldout._bound((i + 1) * heldout.SHARE)}' THEN {i}" for i in range(FOLDS))}
  WHEN h = (SELECT min(h) FROM hashed) THEN 0 END AS fold FROM hashed) WHERE fold IS NOT NULL),
folds AS (SELECT CAST(unnest(range(0, {FOLDS})) AS INTEGER) AS fold),
shown AS (SELECT f.fold, p.source, p.target FROM folds f CROSS JOIN pairs0 p WHERE NOT EXISTS (SELECT 1 FROM hidden h WHERE h.fold = f.fold AND h.source = p.source AND h.target = p.target))"""


def _fold_ranks() -> str:
    parts = [
        "fold_nodes AS (SELECT fold, page FROM folds, site_pages UNION SELECT fold, target FROM shown)", "fold_sizes AS (SELECT fold, count(*) AS n FROM fold_nodes GROUP BY fold)",
        "fold_outs AS (SELECT fold, source, count(*) AS n FROM shown GROUP BY fold, source)", "k0 AS (SELECT x.fold, page, 1.0 / n AS rank FROM fold_nodes x JOIN fold_sizes s ON s.fold = x.fold)",
    ]
    for i in range(1, STEPS + 1):
        loose = f"(SELECT r.fold, sum(r.rank) AS loose FROM k{i - 1} r WHERE NOT EXISTS (SELECT 1 FROM fold_outs o WHERE o.fold = r.fold AND o.source = r.page) GROUP BY r.fold)"
        got = f"(SELECT e.fold, e.target, sum(r.rank / o.n) AS got FROM shown e JOIN fold_outs o ON o.fold = e.fold AND o.source = e.source JOIN k{i - 1} r ON r.fold = e.fold AND r.page = e.source GROUP BY e.fold, e.target)"
        parts.append(f"k{i} AS MATERIALIZED (SELECT x.fold, x.page, 0.15 / s.n + 0.85 * (coalesce(g.got, 0.0) + coalesce(l.loose, 0.0) / s.n) AS rank FROM fold_nodes x JOIN fold_sizes s ON s.fold = x.fold LEFT JOIN {loose} l ON l.fold = x.fold LEFT JOIN {got} g ON g.fold = x.fold AND g.target = x.page)")
    return ", ".join(parts)


@query(f"""{_HASHED}, {_fold_ranks()},
known AS (SELECT r.fold, r.page, round(r.rank, 9) AS rank FROM k{STEPS} r JOIN site_pages p ON p.page = r.page),
gridded AS (SELECT *, floor(rank / (max(rank) OVER (PARTITION BY fold) * 1e-9) + 0.5) AS g FROM known),
placed AS (SELECT fold, page, rank, (rank() OVER (PARTITION BY fold ORDER BY g) - 1) / count(*) OVER (PARTITION BY fold) AS percentile FROM gridded),
vparts AS (SELECT page, hub, unnest(vector) AS x, generate_subscripts(vector, 1) AS i FROM site_pages WHERE hub >= 0), vunits AS (SELECT page, hub, i, x / sqrt(sum(x * x) OVER (PARTITION BY page)) AS x FROM vparts),
vcentres AS (SELECT hub, i, avg(x) AS m FROM vunits GROUP BY hub, i),
vnear AS (SELECT p.page, p.hub, round(sum(p.x * c.m) / sqrt(sum(c.m * c.m)), 9) AS cosine FROM vunits p JOIN vcentres c ON c.hub = p.hub AND c.i = p.i GROUP BY p.page, p.hub),
best AS (SELECT k.fold, v.page FROM vnear v JOIN known k ON k.page = v.page QUALIFY row_number() OVER (PARTITION BY k.fold, v.hub ORDER BY cosine DESC, rank DESC, v.page) = 1),
inner_ AS (SELECT DISTINCT fold, source, target FROM shown WHERE source <> target AND source IN (SELECT page FROM site_pages) AND target IN (SELECT page FROM site_pages)),
ins AS (SELECT fold, target AS page, count(*) AS n FROM inner_ GROUP BY 1, 2), outs_ AS (SELECT fold, source AS page, count(*) AS n FROM inner_ GROUP BY 1, 2)
SELECT p.fold, p.page, coalesce(i.n, 0) AS inbound, coalesce(o.n, 0) AS outbound, coalesce(i.n, 0) = 0 AS is_orphan, round(p.rank, 6) AS rank, round(p.percentile, 6) AS rank_percentile, b.page IS NOT NULL AS is_pillar
FROM placed p LEFT JOIN ins i ON i.fold = p.fold AND i.page = p.page LEFT JOIN outs_ o ON o.fold = p.fold AND o.page = p.page LEFT JOIN best b ON b.fold = p.fold AND b.page = p.page""")
def held_out_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's counts, rank and pillar in each of four folds, with five rounds of PageRank."""
    found = heldout.views(site_links(spark, sf_dir), site_pages(spark, sf_dir), FOLDS, steps=STEPS, tolerance=None)
    return found.select("fold", "page", "inbound", "outbound", "is_orphan", F.round("rank", 6).alias("rank"), F.round("rank_percentile", 6).alias("rank_percentile"), "is_pillar")


@query(f"""{_HASHED},
cos AS (SELECT t.page AS target, s.page AS source, round(list_dot_product(t.vector, s.vector) / (sqrt(list_dot_product(t.vector, t.vector)) * sqrt(list_dot_product(s.vector, s.vector))), 6) AS similarity
  FROM site_pages t JOIN site_pages s ON t.language = s.language AND t.page <> s.page),
able AS (SELECT h.fold, h.source, h.target FROM hidden h JOIN cos c ON c.source = h.source AND c.target = h.target),
choice AS (SELECT f.fold, c.target, c.source, row_number() OVER (PARTITION BY f.fold, c.target ORDER BY similarity DESC, c.source) AS r FROM folds f CROSS JOIN cos c
  WHERE NOT EXISTS (SELECT 1 FROM shown s WHERE s.fold = f.fold AND s.source = c.source AND s.target = c.target))
SELECT f.fold, (SELECT count(*) FROM hidden h WHERE h.fold = f.fold) AS hidden, (SELECT count(*) FROM able a WHERE a.fold = f.fold) AS recoverable,
  (SELECT count(*) FROM able a JOIN choice c ON c.fold = a.fold AND c.source = a.source AND c.target = a.target WHERE a.fold = f.fold AND c.r <= 10) AS found FROM folds f""")
def held_out_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the links that each fold hides, those that retrieval finds again."""
    return heldout.rounds(site_links(spark, sf_dir), site_pages(spark, sf_dir), FOLDS)


# Reports and served rows


@query("""
SELECT count(*) FILTER (state = 'placeholder') AS placeholder, count(*) FILTER (state = 'non_2xx') AS non_2xx, count(*) FILTER (state = 'up_to_date') AS up_to_date, count(*) FILTER (state = 'target') AS target FROM (
  SELECT CASE WHEN d.text IS NULL THEN 'placeholder' WHEN n_chars < 200 THEN 'non_2xx' WHEN e.vec_id IS NOT NULL AND e.label <> 9 THEN 'up_to_date' ELSE 'target' END AS state FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id)""", site_tables=False)
def work_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left to embed: short documents stand for pages that answer with an error, vectors of one label for those of older texts."""
    docs, vectors = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    body = F.md5(F.col("text").cast("binary"))
    pages = docs.join(vectors, F.col("doc_id") == F.col("vec_id"), "left").select(
        F.col("text").isNull().alias("placeholder"), F.when(F.col("n_chars") < 200, 404).otherwise(200).alias("status"), body.alias("body_hash"),
        F.when(F.col("label") == 9, F.lit("old")).when(F.col("vec_id").isNotNull(), body).alias("embedded_hash"), F.col("embedding").alias("vector"),
    )
    return reports.state_counts(reports.work_selection(pages))


@query(f"""{_LINK_COSINES}, pools AS (SELECT language, count(*) AS pool FROM site_pages GROUP BY language),
scored AS (SELECT t.page AS target, s.page AS source, round(list_dot_product(t.vector, s.vector) / (sqrt(list_dot_product(t.vector, t.vector)) * sqrt(list_dot_product(s.vector, s.vector))), 6) AS similarity
  FROM site_pages t JOIN site_pages s ON t.language = s.language AND t.page <> s.page LEFT JOIN pairs l ON l.source = s.page AND l.target = t.page WHERE l.source IS NULL),
near10 AS (SELECT target, similarity FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY similarity DESC, source) AS r FROM scored) WHERE r <= 10),
lasts AS (SELECT target, min(similarity) AS last, count(*) AS n FROM near10 GROUP BY target),
linking AS (SELECT count(*) AS linked, count(*) FILTER (c.similarity > l.last) AS nearer FROM cosines c LEFT JOIN lasts l ON l.target = c.target),
counts AS (SELECT coalesce(l.n, 0) AS n FROM site_pages p LEFT JOIN lasts l ON l.target = p.page)
SELECT count(*) AS targets, CAST(sum(n) AS BIGINT) AS candidates, count(*) FILTER (n >= 10) AS full_targets, count(*) FILTER (n > 0 AND n < 10) AS short_targets, count(*) FILTER (n = 0) AS empty_targets,
  min(n) AS min_per_target, quantile_cont(n, 0.5) AS median_per_target, max(n) AS max_per_target, any_value(linked) AS linked_pairs, any_value(nearer) AS linked_nearer, CAST(0 AS BIGINT) AS pillar_pairs,
  (SELECT count(*) FROM site_pages) AS source_pages, round(any_value(nearer) / (sum(n) + any_value(nearer)), 6) AS drop_rate FROM counts, linking""")
def candidate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, links = site_pages(spark, sf_dir), site_links(spark, sf_dir)
    found = materialize(retrieval.nearest_eligible(pages, links), "candidates")
    report = reports.candidate_report(pages, pages, found, retrieval.target_facts(pages, links, found), found.limit(0), 10)
    return report.withColumn("drop_rate", F.round("drop_rate", 6))


@query(f"""{tenant.SQL} SELECT count(*) AS keywords, round(avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END), 6) AS share FROM (
  SELECT lower(trim(keyword)) AS k, language, count(*) AS n FROM (SELECT DISTINCT page, lower(trim(keyword)) AS keyword, language FROM strategic) GROUP BY ALL)""")
def unique_keyword_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tenant.strategic_rows(spark, sf_dir).select("page", F.lower(F.trim("keyword")).alias("keyword"), "language").distinct()
    return reports.unique_share(rows).select("keywords", F.round("share", 6).alias("share"))


@query("SELECT page FROM site_pages WHERE page IN (SELECT source FROM site_links WHERE anchor = 'topic 3')")
def linking_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.linking_sources(site_pages(spark, sf_dir), site_links(spark, sf_dir).where("anchor = 'topic 3'"))


@query(f"""{_score_sql()},
scored4 AS (SELECT source, target, round(score, 4) AS score FROM tiered),
ranked4 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC NULLS LAST, target) AS place, (rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 - 1) / (count(*) OVER () - 1) AS percentile FROM scored4)
SELECT source, target, place AS rank_in_source, row_number() OVER (ORDER BY round(percentile, 9) DESC, source, place, target) AS best_rank, round(100 * round(percentile, 9), 1) AS score FROM ranked4 WHERE place <= 3""")
def best_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site-wide ranks of the three best links of every source."""
    by = Window.partitionBy("source").orderBy(F.col("score").desc_nulls_last(), "target")
    rows = _scores(spark, sf_dir).select("source", "target", F.round("score", 4).alias("score"))
    rows = percentiles.average_rank(materialize(rows.withColumn("place", F.row_number().over(by)), "ranked-pairs"), "score", [], "percentile")
    facts = rows.select("source", "target", F.round("percentile", 9).alias("percentile"), F.lit(1).alias("tier"), F.lit(1).alias("candidates"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("advice"))
    emitted = rows.where("place <= 3").select("source", "target", F.lit("ADD_LINK").alias("action"), F.col("place").cast("bigint").alias("place"), F.lit(True).alias("suggested"), F.lit(False).alias("orphan_slot"))
    return outputs.new_links(emitted, facts, "site").select("source", "target", "rank_in_source", "best_rank", "score")


@query(f"""{_score_sql()} SELECT count(*) AS pairs, count(*) FILTER (tier = 1) AS tier_1, count(*) FILTER (tier = 2) AS tier_2, count(*) FILTER (tier = 3) AS tier_3,
round(quantile_cont(score, 0.1), 4) AS score_p10, round(quantile_cont(score, 0.5), 4) AS score_p50, round(quantile_cont(score, 0.9), 4) AS score_p90 FROM tiered""")
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.score_summary(_scores(spark, sf_dir))
    return found.select("pairs", "tier_1", "tier_2", "tier_3", *[F.round(c, 4).alias(c) for c in ("score_p10", "score_p50", "score_p90")])


_WEIGHTED = [c for c, *_ in scoring.WEIGHTS]


@query(f"{_feature_sql()} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS share FROM features" for c in _WEIGHTED))
def missing_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = features.pair_features(_candidates(spark, sf_dir), _contexts(spark, sf_dir))
    return reports.missing_shares(pairs, _WEIGHTED).select("feature", F.round("share", 6).alias("share"))


# Seeded draws


@query("""
, hashed AS (SELECT DISTINCT source, sha256('7' || chr(9) || source) AS a, sha256('8' || chr(9) || source) AS b FROM site_links)
SELECT source, CASE WHEN a < '3333333333333400000000000000000000000000000000000000000000000000' THEN 'test' WHEN b < '4000000000000000000000000000000000000000000000000000000000000000' THEN 'valid' ELSE 'train' END AS fold FROM hashed""")
def seed_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.split(site_links(spark, sf_dir).select("source").distinct(), "source", 0.2, 0.25, 7)


@query("""
SELECT doc_id, source FROM documents ORDER BY sha256('42' || chr(9) || doc_id), doc_id LIMIT 100""", site_tables=False)
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.sample(table(spark, sf_dir, "documents").select("doc_id", "source"), ["doc_id"], 100, 42)


# Streams


@query("SELECT user_id AS page, event_type AS query, count(*) AS impressions, CAST(sum(CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS clicks FROM events GROUP BY user_id, event_type", site_tables=False)
def streamed_search_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search rows kept by a stream over files of events, a tenth of which arrive twice."""
    events, folder = table(spark, sf_dir, "events"), new_path(spark, "event-files")
    for part in (events.repartition(4), events.where("event_id % 10 = 0").repartition(2)):
        part.write.mode("append").parquet(folder)
    stored = KeyedTable(spark, new_path(spark, "streamed"), "page bigint, query string, impressions bigint, clicks bigint", ["page", "query"], 8)
    sums = {"impressions": F.count("*"), "clicks": F.sum((F.col("event_id") % 7 == 0).cast("bigint"))}
    named = lambda rows: rows.select(F.col("user_id").alias("page"), F.col("event_type").alias("query"), "event_id")
    run = upserts.totals(read_events(spark, folder, events.schema, 2), stored, sums, new_path(spark, "stream-state"), "event_id", "ts", "3650 days", named)
    run.awaitTermination()
    return stored.read()
