"""Vectors by the content of their texts: an append-only store that is asked before anything is embedded again.

Rows are (model, key, vector, added), key the SHA-256 of the text; folders by ``bucket``, a hash of the key. Writers only
append, so none loses another's rows; what two of them add for one key is settled when reading: the first usable row
of a model and key counts, by the number of its append, then by its own hash. A row is usable if its vector has the store's
length and finite numbers only and is not zero; others count nowhere, so their texts are embedded again, and go with
:meth:`compact`. Every read names the keys it wants and reads their buckets only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.plans.scratch import drop, materialize

BUCKETS = 64
COLUMNS = "model string, key string, vector array<float>, added bigint, bucket int"


def text_key(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


class VectorStore:
    def __init__(self, spark: SparkSession, path: str, dimension: int, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.dimension, self.buckets = spark, path.rstrip("/"), dimension, buckets

    def _exists(self) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(COLUMNS).parquet(self.path) if self._exists() else self.spark.createDataFrame([], COLUMNS)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")

    def usable(self, vector: str = "vector") -> Column:
        v = F.col(vector)
        finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return F.coalesce((F.size(v) == self.dimension) & finite & F.exists(v, lambda x: x != 0), F.lit(False))

    def _first(self, rows: DataFrame) -> DataFrame:
        order = F.struct("added", F.xxhash64("vector").alias("h"))
        return rows.where(self.usable()).groupBy("model", "key").agg(F.min_by("vector", order).alias("vector"), F.min("added").alias("added"))

    def _of(self, keys: DataFrame, model: str) -> DataFrame:
        """The usable rows of distinct, stored ``keys`` (key) and one model; the scan reads the keys' buckets."""
        buckets = [r[0] for r in keys.select(self._bucket()).distinct().collect()]  # no more than self.buckets
        return self._first(self._rows().where(F.col("bucket").isin(buckets) & (F.col("model") == model)).join(keys, "key", "left_semi"))

    def _distinct(self, wanted: DataFrame) -> DataFrame:
        return materialize(wanted.where("key is not null").select("key").distinct(), "vector-keys")

    def missing(self, wanted: DataFrame, model: str) -> DataFrame:
        """key: the distinct keys of ``wanted`` without a usable vector of the model. Null keys are no texts."""
        keys = self._distinct(wanted)
        return keys.join(self._of(keys, model).select("key"), "key", "left_anti")

    def gathered(self, wanted: DataFrame, model: str) -> DataFrame:
        """``wanted`` with ``vector``, null where there is none; rows of one text share its vector."""
        return wanted.join(self._of(self._distinct(wanted), model).select("key", "vector"), "key", "left")

    def add(self, rows: DataFrame, model: str) -> int:
        """Appends ``rows`` (key, vector) of keys that have no usable vector yet, one row a key; returns how many.

        Unusable rows are appended too, as they came; they fill no gap. Rows of one append that differ for a key are settled
        by their hash, a usable one first.
        """
        one = rows.where("key is not null").groupBy("key").agg(F.min_by("vector", F.struct((~self.usable()).alias("bad"), F.xxhash64("vector").alias("h"))).alias("vector"))
        fresh = materialize(one, "vector-rows")
        fresh = materialize(fresh.join(self.missing(fresh, model), "key", "left_semi"), "vector-rows")
        if not (n := fresh.count()):
            return 0
        added = (self._rows().agg(F.max("added")).first()[0] or 0) + 1
        whole = fresh.select(F.lit(model).alias("model"), "key", F.col("vector").cast("array<float>").alias("vector"), F.lit(added).cast("bigint").alias("added"), self._bucket().alias("bucket"))
        whole.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(self.path)
        return n

    def compact(self) -> None:
        """Rewrites every bucket as the rows that count, so unusable and later rows go; one writer at a time. A bucket left without rows goes whole."""
        kept = materialize(self._first(self._rows()).withColumn("bucket", self._bucket()), "vector-compact")
        filled = {r["bucket"] for r in kept.select("bucket").distinct().collect()}
        gone = {r["bucket"] for r in self._rows().select("bucket").distinct().collect()} - filled
        kept.select("model", "key", "vector", "added", "bucket").repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        for bucket in sorted(gone):
            drop(self.spark, f"{self.path}/bucket={bucket}")
