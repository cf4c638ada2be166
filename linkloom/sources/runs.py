"""Output runs: tables of one run in a folder of its own, served only once a completion marker stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators.percentiles import places
from linkloom.plans.scratch import drop

MARKER = "run_id string, table_name string, rows bigint, completed_at timestamp"


class Runs:
    """Runs below ``root``. A reader never sees a run that is still being written, nor half of one."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _exists(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def write(self, run_id: str, table: str, rows: DataFrame, order: list[Column] | None = None) -> int:
        """Writes one table of a run and returns its rows; Spark's commit leaves all files or none.

        With ``order``, rows get an ``ordinal`` from 1 in that order, by which a reader pages through them.
        """
        path = f"{self.root}/runs/{run_id}/{table}"
        rows = rows if order is None else places(rows, order, "ordinal")
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path).count()

    def complete(self, run_id: str, counts: dict[str, int]) -> None:
        """Sets the marker, after every table has the rows that were announced."""
        for table, n in counts.items():
            found = self.spark.read.parquet(f"{self.root}/runs/{run_id}/{table}").count()
            if found != n:
                raise ValueError(f"{table} of run {run_id} has {found} rows, not {n}")
        rows = self.spark.createDataFrame([(run_id, t, n) for t, n in counts.items()], "run_id string, table_name string, rows bigint")
        rows.withColumn("completed_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.root}/markers")

    def markers(self) -> DataFrame:
        path = f"{self.root}/markers"
        return self.spark.read.schema(MARKER).parquet(path) if self._exists(path) else self.spark.createDataFrame([], MARKER)

    def latest(self) -> str | None:
        """The run completed last; ties go to the greater id."""
        return self.markers().agg(F.max(F.struct("completed_at", "run_id"))["run_id"]).first()[0]

    def read(self, table: str) -> DataFrame | None:
        """A table of the latest complete run."""
        run_id = self.latest()
        return None if run_id is None else self.spark.read.parquet(f"{self.root}/runs/{run_id}/{table}")

    def prune(self) -> list[str]:
        """Removes the folders of all other complete runs and returns their ids."""
        keep = self.latest()
        old = [r["run_id"] for r in self.markers().select("run_id").distinct().collect() if r["run_id"] != keep]
        gone = [r for r in old if self._exists(f"{self.root}/runs/{r}")]
        for run_id in gone:
            drop(self.spark, f"{self.root}/runs/{run_id}")
        return sorted(gone)
