"""A membership filter of bounded size in front of a large shuffle.

The keys of a small side set bits in a bitmap of ``2 ** log_bits`` bits; rows of the large side whose bit is unset
cannot have a partner and are decided at the scan. The bitmap is built by a pre-aggregated sum in Spark and reaches the
scan as a scalar subquery of one row. Its size follows the number of keys, eight bits a key, between ``LEAST`` and
``MOST`` (8 MB, the bound that Spark sets to its own runtime bloom filters). A full bitmap only lets more rows through
to the join that follows, which stays exact.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.plans.scratch import materialize

LEAST, MOST = 20, 26


def _slot(key: Column, log_bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << log_bits)).cast("int")


def bits_for(keys: int) -> int:
    """log2 of the bits for that many keys."""
    return min(MOST, max(LEAST, math.ceil(math.log2(8 * keys + 1))))


def member(keys: DataFrame, key: str, log_bits: int | None = None) -> Callable[[Column], Column]:
    """A test of columns against the bitmap of ``keys``: false where the bit is unset, and for null. Evaluated in the JVM.

    ``keys`` is counted where ``log_bits`` is not given, so it should be a stored table.
    """
    log_bits = bits_for(keys.count()) if log_bits is None else log_bits
    at = _slot(F.col(f"`{key}`"), log_bits)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)))
    found = keys.where(F.col(f"`{key}`").isNotNull()).select(F.shiftright(at, 6).alias("w"), bit.alias("b"))
    every = keys.sparkSession.range(1 << (log_bits - 6), numPartitions=1).select(F.col("id").cast("int").alias("w"), F.lit(0).cast("long").alias("b"))
    words = found.unionByName(every).groupBy("w").agg(F.bit_or("b").alias("b"))
    listed = words.agg(F.sort_array(F.collect_list(F.struct("w", "b"))).alias("x"))
    bits = materialize(listed.select(F.transform("x", lambda x: x["b"]).alias("bits")), "bitmap")

    def test(of: Column) -> Column:
        slot = _slot(of, log_bits)
        return of.isNotNull() & (F.call_function("getbit", F.get(bits.scalar(), F.shiftright(slot, 6)), F.pmod(slot, F.lit(64))) == 1)

    return test


def may_contain(keys: DataFrame, key: str, of: Column, log_bits: int | None = None) -> Column:
    """Whether the bit of ``of`` is set by column ``key`` of ``keys``."""
    return member(keys, key, log_bits)(of)


def _whole(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` as (k, row): the key and all columns in one struct, so that no name of the caller's meets one of ours."""
    return rows.select(F.col(f"`{key}`").alias("k"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"))


def without(rows: DataFrame, keys: DataFrame, key: str, log_bits: int | None = None) -> DataFrame:
    """``rows`` whose ``key`` is not in ``keys``; rows with a null key stay. Other columns may have any name.

    Rows whose bit is unset pass at the scan; only the others go through the anti join, so wide rows hardly move.
    """
    packed = _whole(rows, key)
    maybe = may_contain(keys, key, F.col("k"), log_bits)
    checked = packed.where(maybe).join(keys.select(F.col(f"`{key}`").alias("k")), "k", "left_anti")
    return packed.where(~maybe).unionByName(checked).select(*[F.col("row").getField(c).alias(c) for c in rows.columns])


def left_join(rows: DataFrame, small: DataFrame, key: str, log_bits: int | None = None) -> DataFrame:
    """``rows`` left join ``small`` on ``key``; rows whose bit is unset get nulls at the scan and never move.

    Names that both sides have beside the key are an error, as they are for any join that names its columns.
    """
    added = [f for f in small.schema.fields if f.name != key]
    if clash := {f.name for f in added} & set(rows.columns):
        raise ValueError(f"both sides have columns {sorted(clash)}")
    packed = _whole(rows, key)
    maybe = may_contain(small, key, F.col("k"), log_bits)
    other = small.select(F.col(f"`{key}`").alias("k"), F.struct(*[F.col(f"`{f.name}`") for f in added]).alias("more"))
    none = F.lit(None).cast(other.schema["more"].dataType)
    both = packed.where(maybe).join(other, "k", "left").select("row", "more").unionByName(packed.where(~maybe).select("row", none.alias("more")))
    return both.select(*[F.col("row").getField(c).alias(c) for c in rows.columns], *[F.col("more").getField(f.name).alias(f.name) for f in added])
