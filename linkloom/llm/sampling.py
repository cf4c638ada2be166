"""Bounded, repeatable samples of labelled and unlabelled rows for model fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.plans import bitmap
from linkloom.plans.scratch import materialize

#: Tasks that read a sample.
TASKS = 32


def fold(doc_id, folds: int):
    """crc32 of the id as text, modulo ``folds``; null ids fall into fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, most: int) -> DataFrame:
    """(doc_id, text, y) of at most ``most`` labelled rows, lowest id hashes first.

    Null labels and labels that contradict each other are left out. Only sampled texts move.
    """
    agreed = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(column).alias("y"), F.max(column).alias("top"))
    chosen = materialize(agreed.where("y = top").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", "y"), "sample")
    found = docs.where(bitmap.may_contain(chosen, "doc_id", F.col("doc_id"))).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return _first(found.join(chosen, "doc_id"), most)


def _hash():
    """Of id and text, so rows without an id and rows of one id are drawn apart."""
    return F.xxhash64(F.col("doc_id"), F.coalesce("text", F.lit("")))


def _first(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows, lowest hashes first: repeated rows share a hash and may be more than any share of a table. Dealt to ``TASKS`` again."""
    low = F.pmod(_hash(), F.lit(1 << 30))
    return rows.orderBy(low, "doc_id").limit(most).repartition(TASKS, _hash())


def plain_sample(docs: DataFrame, most: int) -> DataFrame:
    """(doc_id, text) of ``most`` rows or all there are, lowest hashes first. The scan passes on little more than the sample.

    Of a table with many equal rows the share that passes is uneven, so the sample may be smaller; it is never larger.
    """
    share = min(1.0, 1.1 * most / max(1, docs.count()))
    rows = docs.where(F.pmod(_hash(), F.lit(1 << 30)) < int(share * (1 << 30))).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return _first(rows, most)
