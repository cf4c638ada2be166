"""Seeded pairs of pages that no table holds: sampling without replacement by a permutation of all pairs.

Draw i is the i-th value of a permutation of the numbers below 4^b, a Feistel network of four keyed rounds; numbers stand for
pairs of places of pages. Different draws are different pairs, so nothing has to be deduplicated, a draw depends on its
number and the seed alone, and the sample is the same whatever the partitioning. A draw is refused where a place does not
exist, the page meets itself, or ``refused`` holds the pair; every pair wanted gets a fixed number of draws.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.operators.percentiles import places
from linkloom.plans import bitmap
from linkloom.plans.scratch import materialize

#: Pairs wanted, draws for each, seed.
COUNT, DRAWS, SEED = 5_000, 20, 42
ROUNDS = 4


def permuted(number: Column, bits: int, seed: int) -> tuple[Column, Column]:
    """The two halves, of ``bits`` bits each, of the permuted ``number`` below 2 ** (2 * bits)."""
    size = F.lit(1 << bits)
    left, right = F.call_function("div", number, size), F.pmod(number, size)
    for i in range(ROUNDS):
        mixed = F.conv(F.substring(F.md5(F.concat_ws(":", right.cast("string"), F.lit(str(seed)), F.lit(str(i))).cast("binary")), 1, 12), 16, 10).cast("bigint")
        left, right = right, left.bitwiseXOR(F.pmod(mixed, size))
    return left, right


def negative_pairs(pages: DataFrame, related: DataFrame, refused: Callable[[DataFrame], DataFrame] | None = None, count: int = COUNT, draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """(draw, source, target): up to ``count`` ordered pairs of different ``pages`` (page) that are not in ``related`` (source, target).

    ``refused`` may drop further rows of (draw, source, target). Fewer pages have fewer pairs; null pages take no part. The
    places of pages are stored once; ``related`` is read through a bitmap of the drawn pairs, so only links that could refuse one move.
    """
    placed = materialize(places(pages.where("page is not null").select("page").distinct(), [F.col("page")]), "negative-places")
    n = placed.count()
    bits = max(1, (max(n, 1) - 1).bit_length())
    tries = min(count * draws, 1 << (2 * bits)) if n else 0
    a, b = permuted(F.col("draw"), bits, seed)
    drawn = pages.sparkSession.range(tries).select(F.col("id").alias("draw")).select("draw", (a + 1).alias("a"), (b + 1).alias("b")).where((F.col("a") <= n) & (F.col("b") <= n) & (F.col("a") != F.col("b")))
    named = drawn.join(placed.select(F.col("place").alias("a"), F.col("page").alias("source")), "a").join(placed.select(F.col("place").alias("b"), F.col("page").alias("target")), "b")
    named = materialize(named.select("draw", "source", "target", F.xxhash64("source", "target").alias("pair")), "negative-draws")
    near = related.select("source", "target").where(bitmap.may_contain(named, "pair", F.xxhash64("source", "target"))).distinct()
    free = named.drop("pair").join(near, ["source", "target"], "left_anti").select("draw", "source", "target")
    free = free if refused is None else refused(free)
    return free.orderBy("draw").limit(count)
