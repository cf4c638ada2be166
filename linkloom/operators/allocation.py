"""Choices in order of priority under capacities, without going through them one by one.

Agents choose one after another, each the first of its options that still has room. Because every place would take the
earlier agent first, the result is the same when all propose at once: each agent asks its best options that have not turned
it down, every place keeps the agents of highest priority that fit, and whoever was turned down asks its next one. Refusals
are final, so the rounds end, and each is a few windows over what is left, however many agents there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.plans.scratch import materialize, release

#: Parts of a place's proposals that are ranked first by themselves, so that no task meets all agents of a wanted place.
PARTS = 64


def _first(rows: DataFrame, by: str, order: list, most, spread: str) -> DataFrame:
    """The first ``most`` rows (a column or a number) of every ``by`` in ``order``."""
    part = Window.partitionBy(by, F.pmod(F.xxhash64(spread), F.lit(PARTS))).orderBy(*order)
    some = rows.withColumn("_n", F.row_number().over(part)).where(F.col("_n") <= most)
    return some.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def chosen(options: DataFrame, capacity: int | None = None, rounds: int = 100_000) -> DataFrame:
    """(agent, object): what agents get from ``options`` (agent, priority, demand, rank, object, pool).

    Agents go by ``priority``, smallest first and unique to each, and take their first ``demand`` options by ``rank`` that are
    free: an object goes to one agent, and all objects of a pool to ``capacity`` agents at most; a null pool, or a null
    capacity, has room for all.
    """
    left = materialize(options, "allocation")
    for _ in range(rounds):
        asking = left.withColumn("_r", F.row_number().over(Window.partitionBy("agent").orderBy("rank", "object"))).where(F.col("_r") <= F.col("demand")).drop("_r")
        asking = materialize(asking, "allocation-asking")
        kept = _first(asking, "object", [F.col("priority")], 1, "agent")
        if capacity is not None:
            kept = _first(kept.where("pool is not null"), "pool", [F.col("priority")], capacity, "agent").unionByName(kept.where("pool is null"))
        kept = materialize(kept.select("agent", "object"), "allocation-kept")
        refused = materialize(asking.select("agent", "object").join(kept, ["agent", "object"], "left_anti"), "allocation-refused")
        release(asking)
        if refused.isEmpty():
            return kept
        before, left = left, materialize(left.join(refused, ["agent", "object"], "left_anti"), "allocation")
        for done in (before, kept, refused):
            release(done)
    raise RuntimeError("choices did not settle")
