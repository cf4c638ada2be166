"""Mixing sources to target weights by entropy balancing.

Targets: sources in code point order (null last) weigh 5, 2, 1, repeating, and share ``budget`` times all words; a
target stops at ``cap`` times the words of its source and the excess is shared again by weight. There is one row a source in
these steps; documents only enter as grouped sums.

Rates: among all rates ``0 <= r <= cap`` whose words per source meet the targets, the ones nearest to 1 in
Kullback-Leibler divergence are exponential tilts, ``r = min(cap, exp(lambda_s * size / mean_s))``. The dual is convex
and has one multiplier per source. Every Newton step sums gradient and curvature over a table of (source, size,
documents), so its cost does not depend on how many documents share a size; a bracket around each multiplier falls back
to bisection where a step would leave it, which the cap makes necessary.

Copies: every document has a fixed fraction u from its id and text, and takes ``floor(rate + u + shift)`` copies, 0 to
``cap``. The shift of a source starts near 0 and is set where the words of its copies come nearest to its target: the
shift at which each document would take another copy is known beforehand, so counting words by shift, in ``PASSES``
histograms of ``BINS`` bins each finer than the last, finds it to 2**-30. A source ends within about one document of its
target, and the copies of a row follow from the row and its source alone: no row moves, and none meets another in a task.

Defined cases: null and empty texts have size 0 and take 0 words; a null source is a source; a source without words has
target 0; repeated rows count as rows of their own and, where id and text are equal, take the same number of copies;
ids may be null; an empty table gives an empty result; reruns agree, whatever the partitioning. Columns of the input keep
their names and values; see :func:`mixed` for names that clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm import text as T
from linkloom.plans.scratch import materialize

WEIGHTS = (5, 2, 1)
BINS, PASSES = 1024, 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = 1.5, cap: int = 2) -> DataFrame:
    """source, source_size, n_docs, target. The windows run over one row per source.

    Sorted by ``cap * source_size / weight``, the capped sources are a prefix; the water level after each prefix tells
    where it ends.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.get(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(order) - 1) % len(weights))
    everything = Window.partitionBy()
    per = per.withColumn("weight", weight.cast("long")).withColumn("limit", cap * F.col("source_size"))
    per = per.withColumn("ratio", F.col("limit") / F.col("weight"))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = (budget * F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    per = per.withColumn("level", level).withColumn("capped", F.col("ratio") <= F.col("level"))
    # Past the first source that is not capped the level falls, so the greatest one is that source's.
    water = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)
    target = F.when(F.col("capped"), F.col("limit")).otherwise(F.col("weight") * water)
    return per.select("source", "source_size", "n_docs", target.cast("double").alias("target"))


def tilt(sizes: DataFrame, targets: DataFrame, cap: int = 2, steps: int = 40, tolerance: float = 1e-9) -> DataFrame:
    """Multiplier of every source: source, mean, lam. Distributed safeguarded Newton; each step is one aggregation.

    ``lam`` is null where every document takes ``cap`` copies (the target equals the limit).
    """
    counts = materialize(sizes.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")), "mix-sizes")
    state = targets.where("source_size > 0").select(
        F.col("source").alias("s"),
        "target",
        F.col("source_size").alias("limit"),
        (F.col("source_size") / F.col("n_docs")).alias("mean"),
        F.lit(0.0).alias("lam"),
        F.lit(-1e4).alias("lo"),
        F.lit(1e4).alias("hi"),
        (F.col("target") >= cap * F.col("source_size")).alias("done"),
    )
    state = materialize(state, "mix-state")
    for _ in range(steps):
        x = F.col("size") / F.col("mean")
        tilted = F.exp(F.least(F.col("lam") * x, F.lit(60.0)))
        free = tilted < cap
        words = F.col("n") * F.col("size")
        sums = (
            counts.join(state.where("not done").select("s", "mean", "lam"), F.col("source").eqNullSafe(F.col("s")))
            .groupBy("s")
            .agg(
                F.sum(words * F.when(free, tilted).otherwise(F.lit(float(cap)))).alias("taken"),
                F.sum(F.when(free, words * tilted * x).otherwise(0.0)).alias("slope"),
            )
            .withColumnRenamed("s", "s2")
        )
        gap = F.col("taken") - F.col("target")
        lo = F.when(gap < 0, F.greatest("lo", "lam")).otherwise(F.col("lo"))
        hi = F.when(gap > 0, F.least("hi", "lam")).otherwise(F.col("hi"))
        moved = state.join(sums, F.col("s").eqNullSafe(F.col("s2")), "left")
        moved = moved.select(
            "s", "target", "limit", "mean", "lam", lo.alias("lo"), hi.alias("hi"),
            (F.col("done") | F.coalesce(F.abs(gap) <= tolerance * F.greatest(F.col("target"), F.lit(1.0)), F.lit(True))).alias("done"),
            (F.col("lam") - gap / F.when(F.col("slope") > 0, F.col("slope"))).alias("newton"),
        )
        inside = (F.col("newton") > F.col("lo")) & (F.col("newton") < F.col("hi"))
        after = F.when(F.col("done"), F.col("lam")).when(F.coalesce(inside, F.lit(False)), F.col("newton")).otherwise((F.col("lo") + F.col("hi")) / 2)
        state = materialize(moved.withColumn("lam", after).drop("newton"), "mix-state")
        if state.where("not done").isEmpty():
            break
    full = F.col("target") >= cap * F.col("limit")
    return state.select("s", "mean", F.when(~full, F.col("lam")).alias("lam"))


def _fraction(doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) that a row keeps for good; rows of one text differ by id, rows of one id by text."""
    return F.pmod(F.xxhash64(doc_id.cast("string"), F.coalesce(text, F.lit(""))), F.lit(1 << 40)) / float(1 << 40)


def _copies(rate: Column, u: Column, shift: Column, cap: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(cap), F.floor(rate + u + shift))).cast("long")


def shifts(rated: DataFrame, targets: DataFrame, cap: int) -> DataFrame:
    """source, shift in [-1, 1] from (source, size, rate, u): where the words taken come nearest to the target.

    Document i takes its k-th copy at shift ``k - rate - u``. A histogram holds ``BINS`` rows a source, whatever the
    source's size, and each pass keeps only the bin in which the target is reached.
    """
    at = F.explode(F.transform(F.sequence(F.lit(1), F.lit(cap)), lambda k: k - F.col("rate") - F.col("u"))).alias("at")
    steps = materialize(rated.where("size > 0").select("source", "size", at).where("at <= 1"), "mix-steps")
    state = targets.select(F.col("source").alias("s"), "target", F.lit(-1.0).alias("lo"), F.lit(0.0).alias("below"), F.lit(None).cast("double").alias("shift"))
    width = 2.0
    for step in range(PASSES):
        width /= BINS
        found = steps.join(state.where("shift is null").select("s", "lo"), F.col("source").eqNullSafe(F.col("s")))
        bin_ = F.floor((F.col("at") - F.col("lo")) / width).cast("int")
        # Before the first bin lies what is taken at any shift; it counts at the first pass and is in ``below`` later.
        bin_ = F.greatest(F.lit(-1), bin_)
        words = found.select("source", bin_.alias("bin"), "size").where(F.col("bin") < BINS)
        words = words if step == 0 else words.where("bin >= 0")
        per = words.groupBy("source", "bin").agg(F.sum("size").alias("words"))
        so_far = Window.partitionBy("source").orderBy("bin")
        sums = per.withColumn("after", F.sum("words").over(so_far))
        joined = sums.join(state.where("shift is null"), F.col("source").eqNullSafe(F.col("s")))
        joined = joined.withColumn("reach", F.col("below") + F.col("after"))
        # The first bin that passes the target; ``below`` is what all bins before it take.
        over = joined.where(F.col("reach") > F.col("target")).groupBy("source").agg(F.min(F.struct("bin", "reach", "words")).alias("x"))
        over = over.select(F.col("source").alias("o"), F.col("x.bin").alias("bin"), (F.col("x.reach") - F.col("x.words")).alias("before"), F.col("x.reach").alias("reach"))
        moved = state.join(over, F.col("s").eqNullSafe(F.col("o")), "left")
        start = F.col("lo") + F.greatest(F.col("bin"), F.lit(0)) * width
        last = step == PASSES - 1
        nearer = F.when(F.col("target") - F.col("before") <= F.col("reach") - F.col("target"), start - width / 2).otherwise(start + width)
        settled = F.when(F.col("shift").isNotNull(), F.col("shift")).when(F.col("bin").isNull(), F.col("lo") + width * BINS).when(F.lit(last), nearer)
        state = materialize(moved.select("s", "target", F.coalesce(start, "lo").alias("lo"), F.coalesce("before", "below").alias("below"), settled.alias("shift")), "mix-shifts")
    return state.select("s", F.col("shift"))


def plan(docs: DataFrame, cap: int = 2, weights: tuple[int, ...] = WEIGHTS, budget: float = 1.5) -> DataFrame:
    """One row per source: s, source_size, target, mean, lam (null: everything ``cap`` times), shift. Texts are read once, for their sizes."""
    sizes = docs.select("source", F.size(T.words(F.col("text"))).cast("long").alias("size"), _fraction(F.col("doc_id"), F.col("text")).alias("u"))
    sizes = materialize(sizes, "mix-docs")
    targets = materialize(source_targets(sizes, weights, budget, cap), "mix-targets")
    rates = materialize(targets.join(tilt(sizes, targets, cap), F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("s"), "source_size", "target", "mean", "lam"), "mix-rates")
    rated = sizes.join(rates.select("s", "mean", "lam"), F.col("source").eqNullSafe(F.col("s"))).select("source", "size", "u", _rate(cap).alias("rate"))
    shift = shifts(rated, targets, cap)
    return materialize(rates.join(shift.withColumnRenamed("s", "s2"), F.col("s").eqNullSafe(F.col("s2"))).drop("s2"), "mix-plan")


def _rate(cap: int) -> Column:
    tilted = F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(60.0)))
    return F.when(F.col("size") == 0, 0.0).otherwise(F.least(F.coalesce(tilted, F.lit(float(cap))), F.lit(float(cap))))


def _decided(docs: DataFrame, cap: int, weights: tuple[int, ...], budget: float) -> DataFrame:
    """(row, doc_id, source, size, source_size, target, rate, copies): the caller's columns are inside ``row``."""
    by_source = plan(docs, cap, weights, budget)
    size = F.size(T.words(F.col("text"))).cast("long")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, "doc_id", "source", size.alias("size"), _fraction(F.col("doc_id"), F.col("text")).alias("u"))
    rated = rows.join(by_source, F.col("source").eqNullSafe(F.col("s"))).withColumn("rate", _rate(cap))
    return rated.select("row", "doc_id", "source", "size", "source_size", "target", "rate", _copies(F.col("rate"), F.col("u"), F.coalesce("shift", F.lit(0.0)), cap).alias("copies"))


def mix(docs: DataFrame, cap: int = 2, weights: tuple[int, ...] = WEIGHTS, budget: float = 1.5) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, rate, copies, taken."""
    own = ["doc_id", "source", "size", "source_size", "target", "rate", "copies"]
    return _decided(docs.select("doc_id", "source", "text"), cap, weights, budget).select(*own, (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, cap: int = 2, weights: tuple[int, ...] = WEIGHTS, budget: float = 1.5) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as it has copies, with all its columns, and ``copy`` from 1 upwards.

    Where ``docs`` has a column of that name, the number is called ``copy_``, and so on. Texts do not move.
    """
    name = "copy"
    while name in docs.columns:
        name += "_"
    rows = _decided(docs, cap, weights, budget).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("n"))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], F.col("n").alias(name))
