"""Greedy batches of an ordered table under a token budget and a number of items, without reading it in one task.

A batch takes rows in order until the next one would pass the budget or the number of items. Where it ends follows from
where it starts, so each block of the order makes a table of jumps: from every place at which a batch may enter the block
(its first ``max_items``) to where the batches leave it. The jumps are doubled, log2(blocks) joins in all, until the places
that are reached from the first row are known; then each block cuts its own rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.operators.percentiles import places
from linkloom.plans.scratch import materialize

#: Rows of a block; more where a batch may have more items.
BLOCK = 65_536


def _ends(tokens: np.ndarray, budget: int, most: int) -> np.ndarray:
    """For a batch that starts at each row, the row at which the next one starts."""
    total = np.concatenate([[0], np.cumsum(tokens)])
    return np.minimum(np.searchsorted(total, total[:-1] + budget, side="right") - 1, np.arange(len(tokens)) + most)


def _sorted(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, int]:
    place, tokens = rows["place"].to_numpy(), rows["tokens"].to_numpy()
    order = np.argsort(place)
    own = int((rows["block"].to_numpy() == rows["home"].to_numpy()).sum())
    return place[order], tokens[order], own


def _jumps(budget: int, most: int):
    """(start, to): from each place where a batch may enter the block to the first start behind it."""

    def run(rows: pa.Table) -> pa.Table:
        place, tokens, own = _sorted(rows)
        ends = _ends(tokens, budget, most)
        to = ends[:own]
        while (inside := to < own).any():
            to = np.where(inside, ends[np.minimum(to, own - 1)], to)
        first = int(place[0]) if own else 0
        return pa.table({"start": np.arange(min(own, most)) + first, "to": to[:most] + first})

    return run


def _cuts(budget: int, most: int):
    """(place, batch): every row of the block and the place at which its batch starts; rows before the entry belong to the block before."""

    def run(rows: pa.Table, entries: pa.Table) -> pa.Table:
        place, tokens, own = _sorted(rows)
        starts = []
        if own and entries.num_rows:
            ends, at = _ends(tokens, budget, most), int(entries["start"][0].as_py() - place[0])
            while at < own:
                starts.append(at)
                at = int(ends[at])
        if not starts:
            return pa.table({"place": np.zeros(0, np.int64), "batch": np.zeros(0, np.int64)})
        rank = np.arange(starts[0], at if at < len(place) else len(place))
        return pa.table({"place": place[rank], "batch": place[np.array(starts)[np.searchsorted(starts, rank, side="right") - 1]]})

    return run


def token_batches(rows: DataFrame, order: list[Column], tokens: str, budget: int, max_items: int, block: int = BLOCK) -> DataFrame:
    """``rows`` with place (from 1, in the order of ``order``, which has to be unique) and batch, the place of its batch's first row.

    A row whose tokens are null, negative or above ``budget`` is refused: truncate texts before. An empty table stays empty.
    """
    if budget < 1 or max_items < 1:
        raise ValueError("budget and max_items must be positive")
    if bad := rows.where(F.col(tokens).isNull() | (F.col(tokens) < 0) | (F.col(tokens) > budget)).limit(1).count():
        raise ValueError(f"{bad} or more rows have tokens outside 0..{budget}")
    size = max(block, max_items)
    placed = materialize(places(rows, order), "batch-places")
    home = F.call_function("div", F.col("place") - 1, F.lit(size))
    counts = placed.select("place", F.col(tokens).cast("bigint").alias("tokens"), home.alias("home"))
    # The first rows of a block also close the batches of the block before it.
    seen = F.when((F.col("place") - 1) % size < max_items, F.array(F.col("home"), F.col("home") - 1)).otherwise(F.array(F.col("home")))
    dealt = materialize(counts.withColumn("block", F.explode(seen)).where("block >= 0"), "batch-blocks")
    jumps = materialize(dealt.groupBy("block").applyInArrow(_jumps(budget, max_items), "start bigint, to bigint"), "batch-jumps")
    last = placed.count()
    reached = placed.where("place = 1").select(F.col("place").alias("start"))
    for _ in range(max(1, -(-last // size)).bit_length()):
        further = reached.join(jumps, "start").select(F.col("to").alias("start")).where(F.col("start") <= last)
        reached = materialize(reached.unionByName(further).distinct(), "batch-starts")
        again = jumps.select(F.col("start").alias("to"), F.col("to").alias("t9"))
        jumps = materialize(jumps.join(again, "to", "left").select("start", F.coalesce("t9", "to").alias("to")), "batch-jumps")
    entries = reached.select("start", F.call_function("div", F.col("start") - 1, F.lit(size)).alias("at"))
    cut = dealt.groupBy("block").cogroup(entries.groupBy("at")).applyInArrow(_cuts(budget, max_items), "place bigint, batch bigint")
    return placed.join(cut, "place")
