"""Streams into stored tables: what a table holds in the end does not depend on the order or the repetition of its input.

Two kinds. :func:`latest` keeps, of each key, the row of the greatest time: a batch is reduced to one row a key and merged
with the stored ones by the same rule, so a batch that arrives late, twice, or again after a failure changes nothing that a
newer row decided. :func:`totals` keeps sums per key: Spark's state adds up what is new, events that repeat within
the watermark count once, and a batch writes the whole sums of the keys that it touched, so writing it again is harmless.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linkloom.sources.keyed import KeyedTable


def newest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of every key: the greatest by ``order`` (nulls are least), ties by all columns, so no partitioning decides. Rows with a null key go."""
    named = rows.where(" and ".join(f"`{k}` is not null" for k in keys))
    rest = [c for c in rows.columns if c not in (*keys, *order)]
    best = F.max(F.struct(*order, *rest)).alias("_best")
    return named.groupBy(*keys).agg(best).select(*[F.col(c) if c in keys else F.col(f"_best.{c}").alias(c) for c in rows.columns])


def merge_newest(table: KeyedTable, rows: DataFrame, order: list[str]) -> list[int]:
    """Writes the rows of a batch that are newer than what is stored; the buckets that nothing newer came for stay as they are."""
    columns = table.schema.names
    fresh = newest(rows.select(*columns), table.keys, order)
    both = newest(fresh.unionByName(table.of(fresh)), table.keys, order)
    old = table.of(fresh)
    changed = both.exceptAll(old)
    return table.upsert(changed) if not changed.isEmpty() else []


def latest(stream: DataFrame, table: KeyedTable, order: list[str], checkpoint: str) -> StreamingQuery:
    """Keeps the newest row of every key of ``table``; runs until all input that there is now has been read."""

    def write(batch: DataFrame, batch_id: int) -> None:
        merge_newest(table, batch, order)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(stream: DataFrame, table: KeyedTable, sums: dict[str, Column], checkpoint: str, event: str | None = None, time: str | None = None, late: str = "1 day", prepare: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Keeps ``sums`` per key of ``table`` over all events; with ``event`` and ``time``, an event id that repeats within ``late`` counts once.

    ``prepare`` turns an event into key and values after repeats are out. The state holds one row a key and the ids of the
    watermark's span. Runs until all input that there is now has been read.
    """
    rows = stream
    if event is not None and time is not None:
        rows = rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([event])
    rows = rows if prepare is None else prepare(rows)
    kept = rows.groupBy(*table.keys).agg(*[c.alias(n) for n, c in sums.items()])

    def write(batch: DataFrame, batch_id: int) -> None:
        table.upsert(batch)

    return kept.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
