"""The queries of this subpackage: ``opN_<name>(spark, sf_dir)`` over whole tables, and their DuckDB SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import ball_tree, decontaminate, filter_audit, html_extract, lexical, mixing, neardup, oracles, pii, pu_quality, quality_rules, toxicity, url_filter, warc
from linkloom.llm.sampling import fold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select(*first, F.array_join("failed_rules", ",").alias("failed_rules"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op3_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_term")


def op4_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op5_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = pu_quality.fit(docs, labels.where(fold(F.col("doc_id"), 5) != 0))
    held_out = (fold(F.col("doc_id"), 5) == 0).alias("held_out")
    return pu_quality.score(docs, model).select("doc_id", held_out, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(_table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(fold(F.col("doc_id"), 3) != 1))
    held_out = (fold(F.col("doc_id"), 3) == 1).alias("held_out")
    return toxicity.score(docs, model).select("doc_id", held_out, "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(_table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    """SQL of eight of the thirteen. Positions of overlapping patterns, page structure, learned models and rounded rates have none; tests use brute force."""
    return {
        "op1_quality_rules": oracles.quality(),
        "op4_url_verdicts": oracles.urls(),
        "op5_benchmark_containment": oracles.containment(),
        "op7_warc_round_trip": oracles.archives(),
        "op10_near_duplicates": oracles.near_duplicates(),
        "op11_filter_audit": oracles.filter_audit(),
        "op12_exact_top_k": oracles.exact_top_k(),
        "op13_ranked_search": oracles.ranked_search(),
    }
