"""Percentiles and places in a whole table without gathering it: counts per distinct value, range-sorted, with offsets per partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.plans.scratch import materialize

#: Values closer than this share of the greatest one are ties of :func:`share_below`.
TIE = 1e-9


def _offsets(parts: DataFrame, count: Column) -> DataFrame:
    """(_p, _start): what lies before each range partition. One row a partition, so its window is small for any table."""
    sizes = parts.groupBy("_p").agg(count.alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))


def _ranged(rows: DataFrame, keys: list, name: str) -> DataFrame:
    """``rows`` range-sorted by ``keys`` and stored, with the number of their partition in ``_p``."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(rows.repartitionByRange(tasks, *keys).withColumn("_p", F.spark_partition_id()), name)


def places(rows: DataFrame, keys: list[Column], name: str = "place") -> DataFrame:
    """``rows`` with their place from 1 in the order of ``keys``, which have to be unique for a place to be fixed."""
    parts = _ranged(rows, keys, "placed")
    at = F.col("_start") + F.row_number().over(Window.partitionBy("_p").orderBy(*keys))
    return parts.join(_offsets(parts, F.count("*")), "_p").withColumn(name, at).drop("_p", "_start")


def value_counts(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, value, below, ties, n): rows of the group with a smaller value, with that value, and with any; nulls and NaN out."""
    known = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    per = _ranged(known.groupBy(*by, value).agg(F.count("*").alias("ties")), [*by, value], "value-counts")
    inside = Window.partitionBy("_p").orderBy(*by, value).rowsBetween(Window.unboundedPreceding, -1)
    seen = per.join(_offsets(per, F.sum("ties")), "_p").withColumn("_seen", F.col("_start") + F.coalesce(F.sum("ties").over(inside), F.lit(0)))
    if not by:
        return seen.select(value, F.col("_seen").alias("below"), "ties", seen.agg(F.sum("ties")).scalar().alias("n"))
    groups = seen.groupBy(*by).agg(F.min("_seen").alias("_first"), F.sum("ties").alias("n"))
    renamed = groups.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(by)], "_first", "n")
    same = [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(by)]
    return seen.join(renamed, same).select(*by, value, (F.col("_seen") - F.col("_first")).alias("below"), "ties", "n")


def _joined(rows: DataFrame, found: DataFrame, value: str, by: list[str]) -> DataFrame:
    renamed = found.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate([*by, value])], "below", "ties", "n")
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate([*by, value])]
    return rows.join(renamed, same, "left").drop(*[f"_k{i}" for i in range(len(by) + 1)])


def share_below(rows: DataFrame, value: str, name: str = "percentile") -> DataFrame:
    """``rows`` with the share of rows strictly below, in [0, 1); values within ``TIE`` of the greatest one are ties."""
    top = rows.agg(F.max(F.abs(F.col(value).cast("double")))).scalar()
    grid = F.when(top > 0, F.floor(F.col(value) / (top * TIE) + 0.5)).otherwise(F.lit(0).cast("long"))
    put = rows.withColumn("_grid", F.when(F.col(value).isNotNull(), grid))
    done = _joined(put, value_counts(put, "_grid", []), "_grid", [])
    return done.withColumn(name, F.col("below") / F.col("n")).drop("_grid", "below", "ties", "n")


def average_rank(rows: DataFrame, value: str, by: list[str], name: str = "percentile") -> DataFrame:
    """``rows`` with (mean rank of ties - 1) / (values - 1); 0.5 where there are fewer than two; null and NaN stay null and unranked."""
    done = _joined(rows, value_counts(rows, value, by), value, by)
    rank = F.col("below") + (F.col("ties") - 1) / 2
    return done.withColumn(name, F.when(F.col("n") < 2, 0.5).otherwise(rank / (F.col("n") - 1))).drop("below", "ties", "n")


def quantiles(rows: DataFrame, value: str, shares: tuple[float, ...], by: list[str] | None = None) -> DataFrame:
    """(by, n, q0, q1, ...): exact quantiles with linear interpolation, from counts per distinct value; one row without ``by``.

    No value list of a group is ever gathered. A group without values has no row; without ``by`` the row is null then.
    """
    by = by or []
    per = materialize(value_counts(rows, value, by), "quantile-counts")
    parts = []
    for i, share in enumerate(shares):
        at = share * (F.col("n") - 1)
        held = lambda k: F.max(F.when((F.col("below") <= k) & (k < F.col("below") + F.col("ties")), F.col(value).cast("double")))
        parts += [held(F.floor(at)).alias(f"_lo{i}"), held(F.ceil(at)).alias(f"_hi{i}")]
    grouped = per.groupBy(*by).agg(F.max("n").alias("n"), *parts)
    mixed = []
    for i, share in enumerate(shares):
        at = share * (F.col("n") - 1)
        mixed.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (at - F.floor(at))).alias(f"q{i}"))
    return grouped.select(*by, "n", *mixed)
