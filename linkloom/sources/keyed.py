"""Large tables written by key: a write reads and replaces the partitions of its own keys and no others.

A table is a Parquet folder partitioned by ``bucket``, a hash of the key columns, and written with Spark's dynamic partition
overwrite. A write first finds the buckets of its keys, at most ``buckets`` small numbers, and reads those through the
partition filter of the scan; files of other buckets are neither read nor touched. Spark stages the new files and puts each
bucket in place at the commit, so a write that fails leaves the table as it was. Between two buckets of one commit a reader may
see the one new and the other old: tables that have to agree at every moment belong in :class:`linkloom.sources.store.Store`.
One writer a table at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.plans.scratch import drop, materialize

BUCKETS = 256


class KeyedTable:
    """The table at ``path`` with unique ``keys`` and the columns of ``schema`` (a DDL string). Nulls are key values like others."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = BUCKETS, group: list[str] | None = None) -> None:
        """``group``, some of the keys, decides the bucket: rows that are replaced together, as the links of a page, lie together."""
        self.spark, self.path, self.keys, self.buckets, self.group = spark, path.rstrip("/"), keys, buckets, group or keys
        self.schema = spark.createDataFrame([], schema).schema
        if "bucket" in self.schema.names:
            raise ValueError("the column bucket belongs to the table")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.group), F.lit(self.buckets)).cast("int")

    def _exists(self) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def _stored(self) -> DataFrame:
        whole = T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])
        return self.spark.read.schema(whole).parquet(self.path) if self._exists() else self.spark.createDataFrame([], whole)

    def read(self) -> DataFrame:
        return self._stored().drop("bucket")

    def of(self, keys: DataFrame) -> DataFrame:
        """The rows of the given keys (the columns of ``group`` or all key columns), from their buckets only."""
        on = self.keys if set(self.keys) <= set(keys.columns) else self.group
        asked = materialize(keys.select(*on).distinct(), "keyed-asked")
        return self._joined(self._in(self._buckets(asked)).drop("bucket"), asked, on, "left_semi")

    def _buckets(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(self._bucket()).distinct().collect())

    def _in(self, buckets: list[int]) -> DataFrame:
        return self._stored().where(F.col("bucket").isin(buckets))

    @staticmethod
    def _joined(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
        renamed = right.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(on)])
        same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(on)]
        return left.join(renamed, same, how)

    def _put(self, rows: DataFrame, buckets: list[int]) -> None:
        """Makes ``rows`` all there is in ``buckets``. Dynamic overwrite leaves a bucket without rows alone, so those are emptied by hand, after the others stand."""
        fresh = materialize(rows.select(*self.schema.names).withColumn("bucket", self._bucket()), "keyed-write")
        filled = {r["bucket"] for r in fresh.select("bucket").distinct().collect()}
        if filled:
            # One task a bucket, so a bucket is one file and a write makes no more files than buckets.
            fresh.repartition(len(filled), "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        for bucket in sorted(set(buckets) - filled):
            drop(self.spark, f"{self.path}/bucket={bucket}")

    def upsert(self, rows: DataFrame, keep: list[str] | None = None) -> list[int]:
        """Adds rows of new keys and replaces those of known keys; columns in ``keep`` stay as stored where they are set. Returns the buckets written.

        Two rows of one key are refused, before anything is written.
        """
        rows = materialize(rows.select(*self.schema.names), "keyed-rows")
        if not rows.groupBy(*self.keys).count().where("count > 1").isEmpty():
            raise ValueError("a key is written twice")
        buckets = self._buckets(rows)
        old = self._in(buckets).drop("bucket")
        if keep:
            known = old.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(self.keys)], *[F.col(c).alias(f"_o{i}") for i, c in enumerate(keep)])
            held = rows.join(known, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(self.keys)], "left")
            fresh = held.select(*[F.coalesce(f"_o{keep.index(c)}", c).alias(c) if c in keep else F.col(c) for c in self.schema.names])
        else:
            fresh = rows
        self._put(self._joined(old, rows, self.keys, "left_anti").unionByName(fresh), buckets)
        return buckets

    def insert_missing(self, rows: DataFrame) -> list[int]:
        """Adds rows of new keys only, one for each key; known rows stay untouched, and so do their buckets if nothing is added there."""
        rows = materialize(rows.select(*self.schema.names).dropDuplicates(self.keys), "keyed-rows")
        fresh = materialize(self._joined(rows, self._in(self._buckets(rows)).drop("bucket"), self.keys, "left_anti"), "keyed-rows")
        buckets = self._buckets(fresh)
        self._put(self._in(buckets).drop("bucket").unionByName(fresh), buckets)
        return buckets

    def delete(self, keys: DataFrame) -> list[int]:
        """Removes the rows of the given keys, or of whole groups where only the columns of ``group`` are given."""
        on = self.keys if set(self.keys) <= set(keys.columns) else self.group
        gone = materialize(self.of(keys).select(*on).distinct(), "keyed-gone")
        buckets = self._buckets(gone)
        self._put(self._joined(self._in(buckets).drop("bucket"), gone, on, "left_anti"), buckets)
        return buckets

    def replace_groups(self, rows: DataFrame, groups: DataFrame | None = None) -> list[int]:
        """Makes ``rows`` all there is of their groups; ``groups`` names groups that may end up empty. Others stay."""
        rows = materialize(rows.select(*self.schema.names), "keyed-rows")
        if not rows.groupBy(*self.keys).count().where("count > 1").isEmpty():
            raise ValueError("a key is written twice")
        named = rows.select(*self.group) if groups is None else rows.select(*self.group).union(groups.select(*self.group))
        named = materialize(named.distinct(), "keyed-groups")
        buckets = self._buckets(named)
        self._put(self._joined(self._in(buckets).drop("bucket"), named, self.group, "left_anti").unionByName(rows), buckets)
        return buckets

    def set_columns(self, values: DataFrame, names: list[str]) -> list[int]:
        """Sets ``names`` on the rows that have the key columns of ``values``; one value may be meant for many rows, if only ``group`` is given."""
        on = self.keys if set(self.keys) <= set(values.columns) else self.group
        values = materialize(values.select(*on, *names), "keyed-values")
        if not values.groupBy(*on).count().where("count > 1").isEmpty():
            raise ValueError("a key is written twice")
        buckets = self._buckets(values)
        fresh = values.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(on)], *[F.col(c).alias(f"_v{i}") for i, c in enumerate(names)], F.lit(True).alias("_set"))
        rows = self._in(buckets).drop("bucket").join(fresh, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(on)], "left")
        pick = [F.when(F.col("_set"), F.col(f"_v{names.index(c)}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in self.schema.names]
        self._put(rows.select(*pick), buckets)
        return buckets
