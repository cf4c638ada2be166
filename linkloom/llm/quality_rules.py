"""Quality rules with risk-controlled cutoffs.

Fixed base rules come first. Then each method rule compares one share with a cutoff from a fixed grid. A labelled
holdout selects the cutoff in every stratum (language): going from the most lenient cutoff to the strictest, a cutoff
is certified while the exact binomial tail ``P(Bin(n, alpha / rules) <= rejected good)`` stays at or below
``delta / (rules * strata)``. The walk stops at the first failure, so the cutoffs of one rule need no further
correction (fixed-sequence testing); rules and strata are corrected by Bonferroni. With probability ``1 - delta`` no
stratum loses more than the share ``alpha`` of its good documents that pass the base rules. Among certified cutoffs
the one with the greatest gain wins: bad rejected minus ``good_weight`` times good rejected, ties to the lenient one,
none if no gain is positive. A stratum with too few labels certifies nothing and keeps its documents.

Defined cases: a null or empty text has no words and fails the base rules; a null language is a stratum of its own;
labels that are null or contradict each other for a document are left out; repeated rows are judged alike, each for
itself; null ids have no label; an empty table gives an empty result; without labels no cutoff is certified; other columns of the input are neither read nor changed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm import text as T
from linkloom.plans import bitmap
from linkloom.plans.scratch import materialize


@dataclass(frozen=True)
class Rule:
    """Rejects where ``top / bottom`` is at or beyond a cutoff; ``cutoffs`` run from lenient to strict."""

    name: str
    top: str
    bottom: str
    cutoffs: tuple[float, ...]
    high: bool = True

    def share(self) -> Column:
        return F.col(self.top) / F.when(F.col(self.bottom) > 0, F.col(self.bottom))

    def rejects(self, cutoff: Column) -> Column:
        hit = self.share() >= cutoff if self.high else self.share() <= cutoff
        return F.coalesce(hit, F.lit(False))

    def strictness(self) -> Column:
        """How many cutoffs, counted from the strict end, reject the row."""
        return sum((self.rejects(F.lit(c)).cast("int") for c in self.cutoffs), F.lit(0))


RULES = (
    Rule("symbols", "n_symbols", "word_chars", (0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03)),
    Rule("dup_lines", "n_dup_lines", "n_lines", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3)),
    Rule("capitals", "n_upper", "word_chars", (0.8, 0.7, 0.6, 0.5, 0.4, 0.3)),
    Rule("distinct_words", "n_distinct_words", "n_words", (0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3), high=False),
)


def _repeat_positions(pairs: Column) -> Column:
    """Sorted positions of windows that occur twice or more. ``pairs`` (hash, position) is sorted: equal hashes adjoin."""
    none = F.array(F.lit(None).cast("bigint"))
    hashes = pairs["h"]
    marked = F.arrays_zip(
        pairs.alias("at"),
        F.concat(none, hashes).alias("before"),
        F.concat(F.slice(hashes, 2, F.greatest(F.size(pairs) - 1, F.lit(0))), none).alias("after"),
    )
    hit = F.filter(marked, lambda x: x["at"].isNotNull() & ((x["at"]["h"] == x["before"]) | (x["at"]["h"] == x["after"])))
    return F.sort_array(F.transform(hit, lambda x: x["at"]["i"]))


def measure(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Base counts and ``base_failed`` of every row, beside the columns in ``keep``; no shuffle, no Python.

    Windows are compared by 64-bit hash within one text: two of n windows collide with probability n * n / 2**65.
    """
    width = T.SHINGLE
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    count = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    kept = [F.col(c) for c in keep]
    first = docs.select(
        *kept,
        T.pinned(T.words(F.col("text"))).alias("_words"),
        lines.alias("_lines"),
        count("[^#*$%&|<>]+").cast("long").alias("n_symbols"),
        count("[^\\p{Lu}]+").cast("long").alias("n_upper"),
    )
    second = first.select(
        "*",
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.size("_words").cast("long").alias("n_words"),
        F.size(F.array_distinct("_words")).cast("long").alias("n_distinct_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        T.pinned(T.window_hashes(F.col("_words"), width)).alias("_windows"),
    ).drop("_words", "_lines")
    # Most texts repeat no window; only the others are sorted.
    pairs = F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    third = second.withColumn("_pairs", T.pinned(pairs)).drop("_windows")
    third = third.withColumn("_at", T.pinned(F.when(F.col("_pairs").isNotNull(), _repeat_positions(F.col("_pairs"))))).drop("_pairs")
    gaps = F.zip_with(
        F.slice("_at", 1, F.greatest(F.size("_at") - 1, F.lit(0))),
        F.slice("_at", 2, F.greatest(F.size("_at") - 1, F.lit(0))),
        lambda a, b: F.least(b - a, F.lit(width)),
    )
    covered = F.when(F.size("_at") > 0, F.aggregate(gaps, F.lit(width), lambda acc, g: acc + g)).otherwise(0)
    return (
        third.withColumn("n_repeat_words", covered.cast("long"))
        .drop("_at")
        .withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    )


def _tail(n: Column, k: Column, p: float) -> Column:
    """``P(Bin(n, p) <= k)`` for ``k < n * p``, else 1: the term at k by logarithms, the rest relative to it."""
    ks = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    log_choose = F.aggregate(ks, F.lit(0.0), lambda acc, i: acc + F.log((n - i + 1) / i))
    at_k = log_choose + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(acc: Column, j: Column) -> Column:
        i = k - j + 1
        term = acc["term"] * i * (1 - p) / ((n - i + 1) * p)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    below = F.aggregate(ks, start, step, lambda acc: acc["total"])
    return F.when(k < n * p, F.exp(at_k) * below).otherwise(1.0)


def fit(measured: DataFrame, labels: DataFrame, alpha: float = 0.03, delta: float = 0.05, good_weight: float = 10.0) -> DataFrame:
    """Certified cutoffs: one row per stratum that has a cutoff, a double column per rule (null: rule off).

    ``measured`` needs doc_id, lang and body (a hash of the text) beside the columns of :func:`measure`; ``labels`` needs
    doc_id and quality. Equal texts of a stratum with equal labels are one trial, since copies are not independent. Only
    counts are shuffled.
    """
    agreed = (
        labels.where("quality is not null and doc_id is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("lo"), F.max("quality").alias("hi"))
        .where("lo = hi")
        .select("doc_id", F.col("lo").alias("_good"))
    )
    rows = measured.where(~F.col("base_failed")).join(agreed, "doc_id").dropDuplicates(["lang", "_good", "body"])
    hits = F.array(*[F.struct(F.lit(i).alias("rule"), r.strictness().alias("level")) for i, r in enumerate(RULES)])
    by_level = (
        rows.select("lang", "_good", F.explode(hits).alias("x"))
        .groupBy("lang", "x.rule", "x.level")
        .agg(F.sum((F.col("_good") == 1).cast("long")).alias("good"), F.sum((F.col("_good") == 0).cast("long")).alias("bad"))
    )
    # The grid of cutoffs has a fixed length, so what follows is a few rows per stratum and rule.
    per_rule = by_level.groupBy("lang", "rule").agg(
        F.sum("good").alias("n"), F.collect_list(F.struct("level", "good", "bad")).alias("levels")
    )
    grids = F.array(*[F.array(*[F.lit(c) for c in r.cutoffs]) for r in RULES])
    above = lambda field: F.aggregate(
        F.filter("levels", lambda x: x["level"] >= F.col("need")), F.lit(0).cast("long"), lambda acc, x: acc + x[field]
    )
    walked = (
        per_rule.select("*", F.get(grids, F.col("rule")).alias("grid"))
        .select("*", F.posexplode("grid").alias("step", "cutoff"))
        .withColumn("need", F.size("grid") - F.col("step"))
        .withColumn("k", above("good"))
        .withColumn("gain", above("bad") - good_weight * F.col("k"))
        .withColumn("strata", F.count("*").over(Window.partitionBy("rule", "step")))
        .withColumn("tail", _tail(F.col("n"), F.col("k"), alpha / len(RULES)))
        .withColumn("ok", F.col("tail") <= delta / (len(RULES) * F.col("strata")))
    )
    so_far = Window.partitionBy("lang", "rule").orderBy("step")
    certified = walked.withColumn("ok", F.min(F.col("ok").cast("int")).over(so_far) == 1).where("ok and gain > 0")
    best = certified.groupBy("lang", "rule").agg(F.max(F.struct("gain", (-F.col("step")).alias("s"), "cutoff")).alias("b"))
    return best.groupBy("lang").agg(*[F.max(F.when(F.col("rule") == i, F.col("b.cutoff"))).alias(f"cut_{r.name}") for i, r in enumerate(RULES)])


def apply(measured: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Adds ``failed_rules`` (array of names) and ``kept``.

    ``cutoffs`` has a row per stratum; Spark broadcasts it where its size allows and splits hot strata where not.
    """
    joined = measured.join(cutoffs.withColumnRenamed("lang", "_stratum"), F.col("lang").eqNullSafe(F.col("_stratum")), "left")
    failed = F.array_compact(
        F.array(*[F.when(F.col(f"cut_{r.name}").isNotNull() & r.rejects(F.col(f"cut_{r.name}")), F.lit(r.name)) for r in RULES])
    )
    return (
        joined.withColumn("failed_rules", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
        .drop("_stratum", *[f"cut_{r.name}" for r in RULES])
    )


def _body() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("body")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Measures ``docs`` once, selects cutoffs on the labelled rows and returns counts and verdicts per row."""
    rows = docs.select("doc_id", "lang", "text", _body())
    measured = materialize(measure(rows, ["doc_id", "lang", "body"]), "quality-counts")
    cutoffs = materialize(fit(measured, labels), "quality-cutoffs")
    return apply(measured, cutoffs)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns unchanged; texts are never shuffled.

    Only labelled rows are measured for the cutoffs, found at the scan; then every row is measured for its verdict.
    """
    known = materialize(labels.select("doc_id").where("doc_id is not null").distinct(), "quality-labelled")
    rows = docs.select("doc_id", "lang", "text", _body()).where(bitmap.may_contain(known, "doc_id", F.col("doc_id")))
    measured = materialize(measure(rows, ["doc_id", "lang", "body"]), "quality-counts")
    cutoffs = materialize(fit(measured, labels), "quality-cutoffs")
    row = docs.select("text", "lang", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return apply(measure(row, ["_row", "lang"]), cutoffs).where("kept").select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
