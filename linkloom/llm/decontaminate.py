"""Benchmark decontamination by size-partitioned MinHash containment search.

An item is found in a document that holds at least 75 % of the item's distinct five-word shingles, anywhere in a text of
any length. Items are partitioned by size into powers of two. In the class up to u shingles, an item's sketch is its
``k = floor((1 - t) * u) + 1`` smallest hashes (bottom-k MinHash). A document that contains the share t of the item misses
at most ``(1 - t) * n`` of its n shingles, so it holds at least ``k - misses >= 1`` of the sketch: searching the documents'
shingles for sketches alone loses nothing, at about a quarter of the postings. What reaches that count is verified by
exact containment of full shingle sets; only candidate documents are cut into shingles again.

Texts are lower-cased. Defined cases: null, empty and blank items and documents match nothing; an item or document of
fewer than five words is one shingle, so such an item only matches an equal text; repeated rows give one result per
(doc_id, item_id); equal items with different ids are all reported; rows without an id are left out of the hits, and
stay in the filter; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm import text as T
from linkloom.plans import bitmap
from linkloom.plans.scratch import materialize

PERCENT = 75


def _sets(rows: DataFrame, key: str) -> DataFrame:
    """(key, shingles) of rows with a key; words are a column of their own before they are hashed."""
    cut = rows.where(F.col(key).isNotNull()).select(key, T.pinned(T.words(F.lower("text"))).alias("_words"))
    return cut.select(key, T.pinned(T.shingle_set(F.col("_words"))).alias("shingles"))


def item_sketches(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(item_id, n, need, enough, sketch) from (item_id, shingles): ``enough`` sketch hits are unavoidable at ``need``."""
    sized = sets.withColumn("n", F.size("shingles"))
    upper = F.pow(F.lit(2.0), F.ceil(F.log2("n")))
    k = F.least(F.col("n"), (F.floor((100 - percent) * upper / 100) + 1).cast("int"))
    need = F.ceil(percent * F.col("n") / 100).cast("int")
    return sized.select("item_id", "n", need.alias("need"), (k - (F.col("n") - need)).alias("enough"), F.slice(F.sort_array("shingles"), 1, k).alias("sketch"))


def contaminated(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of every document that contains an item."""
    item_sets = materialize(_sets(items, "item_id"), "bench-items").where(F.size("shingles") > 0)
    sketches = materialize(item_sketches(item_sets, percent), "bench-sketches")
    postings = sketches.select("item_id", "enough", F.explode("sketch").alias("h"))
    # The outer form, since for the inner one Catalyst would filter on the size of the set and build it twice.
    grams = _sets(docs, "doc_id").select("doc_id", F.explode_outer("shingles").alias("h"))
    hits = grams.join(postings, "h").groupBy("doc_id", "item_id").agg(F.count_distinct("h").alias("hits"), F.first("enough").alias("enough"))
    candidates = materialize(hits.where("hits >= enough").select("doc_id", "item_id"), "bench-candidates")
    again = _sets(docs.where(bitmap.may_contain(candidates, "doc_id", F.col("doc_id"))), "doc_id")
    full = item_sets.select("item_id", F.col("shingles").alias("item")).join(sketches.select("item_id", "n", "need"), "item_id")
    pairs = again.join(candidates, "doc_id").join(full, "item_id")
    checked = pairs.select("doc_id", "item_id", F.col("n").cast("long").alias("n_item"), "need", F.size(F.array_intersect("item", "shingles")).cast("long").alias("n_shared"))
    found = checked.where(F.col("n_shared") >= F.col("need")).groupBy("doc_id", "item_id").agg(F.max("n_item").alias("n_item"), F.max("n_shared").alias("n_shared"))
    return found.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that contain no item, unchanged."""
    found = materialize(contaminated(docs, items).select("doc_id").distinct(), "bench-found")
    return bitmap.without(docs, found, "doc_id")
