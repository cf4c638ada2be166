"""Site tables over the driver's tables: pages with vectors and topic hubs, their links, and search metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.plans import bitmap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def site_pages(spark: SparkSession, sf_dir: str, derived: dict[str, Column] | None = None) -> DataFrame:
    """page, url, language, body, hub (-1: noise), vector; one row per document with an embedding.

    ``derived`` columns stand in the place of the body. They are computed from ``text`` at the scan, so that no text moves to meet its embedding,
    for documents that may have one.
    """
    docs, vectors = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    if derived:
        keys = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"))
        docs = docs.where(bitmap.may_contain(keys, "vec_id", F.col("doc_id").cast("bigint"))).select("doc_id", "lang", "source", *[c.alias(n) for n, c in derived.items()])
    body = [F.col(n) for n in derived] if derived else [F.col("text").alias("body")]
    url = F.concat("source", F.lit(".example.com/"), "lang", F.lit("/"), F.col("doc_id").cast("string"))
    return docs.join(vectors, docs.doc_id == vectors.vec_id).select(
        F.col("doc_id").alias("page"), url.alias("url"), F.col("lang").alias("language"), *body,
        F.when(F.col("label") == 9, -1).otherwise(F.col("label")).cast("int").alias("hub"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )


def site_links(spark: SparkSession, sf_dir: str, pages: DataFrame | None = None) -> DataFrame:
    """source, position, target, anchor: eight links a page, some to pages that do not exist. ``pages`` are the site's where they are stored."""
    pages = (site_pages(spark, sf_dir) if pages is None else pages).select("page")
    n = table(spark, sf_dir, "embeddings").agg(F.count("*")).scalar()
    j = F.col("position")
    target = (F.col("page") * 7 + j * j * 13 + j * 11) % F.floor(n * 11 / 10)
    links = pages.select("page", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(8).cast("long"))).alias("position"))
    links = links.select(F.col("page").alias("source"), "position", target.alias("target")).where("source <> target")
    anchor = F.when(j % 4 == 0, "read more").otherwise(F.concat(F.lit("topic "), (F.col("target") % 17).cast("string")))
    return links.withColumn("anchor", anchor)


def search_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, query, impressions, clicks, position from the events of users."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("page"), F.col("event_type").alias("query")).agg(
        F.count("*").alias("impressions"),
        F.sum((F.col("event_id") % 7 == 0).cast("long")).alias("clicks"),
        F.greatest(F.lit(1.0), F.round(F.avg(F.col("event_id") % 30), 6)).alias("position"),
    )


#: The same tables in DuckDB SQL, to stand before a query.
SQL = """
site_pages AS (
  SELECT d.doc_id AS page, d.source || '.example.com/' || d.lang || '/' || CAST(d.doc_id AS VARCHAR) AS url, d.lang AS language,
         d.text AS body, CAST(CASE WHEN e.label = 9 THEN -1 ELSE e.label END AS INTEGER) AS hub, CAST(e.embedding AS DOUBLE[]) AS vector
  FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id),
raw_links AS (
  SELECT p.page AS source, s.j AS position, (p.page * 7 + s.j * s.j * 13 + s.j * 11) % (m.n * 11 // 10) AS target
  FROM site_pages p, (SELECT count(*) AS n FROM embeddings) m, (VALUES (1),(2),(3),(4),(5),(6),(7),(8)) s(j)),
site_links AS (
  SELECT source, CAST(position AS BIGINT) AS position, target,
         CASE WHEN position % 4 = 0 THEN 'read more' ELSE 'topic ' || CAST(target % 17 AS VARCHAR) END AS anchor
  FROM raw_links WHERE source <> target),
search_rows AS (
  SELECT user_id AS page, event_type AS query, count(*) AS impressions,
         CAST(sum(CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS clicks,
         greatest(1.0, round(avg(event_id % 30), 6)) AS position
  FROM events GROUP BY user_id, event_type)
"""
