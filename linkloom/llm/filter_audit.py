"""What five text filters remove, alone and in every order: a relational word pipeline and 32 conditional counts.

A document fails A with fewer than 50 words, B if 100 * distinct words < 65 * words, C if 100 * ``[A-Z]`` characters > 5 *
code points, D if it holds one of ``#$%&*|``, and E if its text is that of a smaller doc_id, removed or not. Words are
runs without space and U+0009 to U+000D, case-sensitive.

A null text is empty, fails A alone and equals every other empty text. A row without doc_id is judged by A to D; it is no
copy of anything, nothing is a copy of it, and it has no label. Repeated rows are documents of their own, rows of one
doc_id are no copies of each other. A null source is the part with the empty name. A label counts if any row of ``labels``
for that doc_id has it. Columns beside doc_id, text and source are ignored; an empty table has no parts and gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.text import words
from linkloom.plans.scratch import materialize

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
#: Bytes of text in a partition of the word pipeline; each word of it may take a row of a hash map.
PART_BYTES, MOST_PARTS = 16 << 20, 100_000
#: What is counted: all documents, those labelled good, those labelled toxic.
WEIGHTS = ("n", "good", "toxic")


def _partitions(docs: DataFrame) -> int:
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(MOST_PARTS, max(1, -(-size // PART_BYTES)))


def facts(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, mask) per row: the SHA-256 of its text and bits 0 to 3 for the failing filters A to D.

    Texts are dealt by a row number, so no key is hot, and one exchange serves both sides: words explode, are counted by
    (row, word) and then by row, and the counts meet the row's other flags in an outer join without another shuffle. A word
    stands as its 64-bit hash there: two of the n words of a text share one with probability n * n / 2**65.
    """
    own = F.array(F.struct("doc_id", "source", F.coalesce("text", F.lit("")).alias("text")))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), own.alias("d")).repartition(_partitions(docs), "row")
    field = lambda name: F.get(F.transform("d", lambda x: x[name]), 0)  # noqa: E731  a plain field would be pruned below the exchange, and each side would get its own
    text = field("text")
    word = rows.select("row", F.explode(words(text)).alias("w")).select("row", F.xxhash64("w").alias("word"))
    totals = word.groupBy("row", "word").agg(F.count("*").alias("times")).groupBy("row").agg(F.sum("times").alias("n_words"), F.count("*").alias("n_distinct"))
    flags = rows.select(
        "row", field("doc_id").alias("doc_id"), F.coalesce(field("source"), F.lit("")).alias("part"), F.sha2(text.cast("binary"), 256).alias("digest"),
        (100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 5 * F.length(text)).alias("c"), text.rlike("[#$%&*|]").alias("d"),
    )
    n, distinct = F.coalesce("n_words", F.lit(0)), F.coalesce("n_distinct", F.lit(0))
    fails = [n < 50, 100 * distinct < 65 * n, F.col("c"), F.col("d")]
    return flags.join(totals, "row", "left").select("doc_id", "part", "digest", sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0)).alias("mask"))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic) per row of ``docs``: bit i of the mask is the i-th filter's failure."""
    rows = materialize(facts(docs), "filter-facts")
    copied = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("last > first").drop("last")
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int") * (1 << 4)
    whole = rows.join(copied, "digest", "left").join(marks, "doc_id", "left")
    return whole.select("part", (F.col("mask") + copy).alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def counts(rows: DataFrame) -> DataFrame:
    """One row per part: 32 conditional counts for all documents, for good and for toxic ones, as the arrays n, good, toxic."""
    held = {"n": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    columns = [F.count_if((F.col("mask") == m) & held[w]).alias(f"{w}{m}") for w in WEIGHTS for m in range(MASKS)]
    return rows.groupBy("part").agg(*columns).select("part", *[F.array(*[f"{w}{m}" for m in range(MASKS)]).alias(w) for w in WEIGHTS])


def _orders(parts: DataFrame) -> DataFrame:
    """``parts`` with every order of the filters and every step of it: one letter more at a time, none twice."""
    letters, rows = F.array(*[F.lit(x) for x in FILTERS]), parts.withColumn("filter_order", F.lit(""))
    for _ in FILTERS:
        left = F.filter(letters, lambda x: ~F.contains(F.col("filter_order"), x))
        rows = rows.withColumn("next", F.explode(left)).withColumn("filter_order", F.concat("filter_order", "next")).drop("next")
    return rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))


def _bits(letters: Column) -> Column:
    """The mask of the filters named by a string of letters."""
    return sum((F.contains(letters, F.lit(x)).cast("int") * (1 << i) for i, x in enumerate(FILTERS)), F.lit(0))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, filter_order and step (1 to 5): documents kept after it, removed by it, and what else the filter does.

    redundant: fail this filter, removed earlier; unique_fails: fail this filter only; good_lost and toxic_lost: removed
    here, labelled so; shapley: removed by this filter, summed over all orders: of a document that fails k filters each
    is the first in a k-th of the orders. Only the counts of a part are read, never its documents again.
    """
    steps = _orders(materialize(counts(judged(docs, labels)), "filter-counts"))
    steps = steps.withColumn("own", _bits(F.substr("filter_order", "step", F.lit(1)))).withColumn("gone", _bits(F.substr("filter_order", F.lit(1), F.col("step") - 1)))
    own, gone = F.col("own"), F.col("gone")
    every, orders = F.sequence(F.lit(0), F.lit(MASKS - 1)), 120

    def total(of: str, share) -> Column:
        return F.aggregate(every, F.lit(0).cast("long"), lambda a, m: a + F.get(F.col(of), m) * share(m))

    hit = lambda m: (m.bitwiseAND(own) > 0).cast("long")
    free = lambda m: (m.bitwiseAND(gone) == 0).cast("long")
    return steps.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"),
        total("n", lambda m: (m.bitwiseAND(own.bitwiseOR(gone)) == 0).cast("long")).alias("kept"),
        total("n", lambda m: hit(m) * free(m)).alias("removed"),
        total("n", lambda m: hit(m) * (1 - free(m))).alias("redundant"),
        F.get("n", own).alias("unique_fails"),
        total("good", lambda m: hit(m) * free(m)).alias("good_lost"),
        total("toxic", lambda m: hit(m) * free(m)).alias("toxic_lost"),
        total("n", lambda m: hit(m) * (orders / F.greatest(F.bit_count(m), F.lit(1))).cast("long")).alias("shapley"),
    )
