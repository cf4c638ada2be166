"""A tenant's tables as versions: scans, merges, guarded writes and replacements, each a commit that readers see whole.

A table's version is a folder that never changes. A commit is one small file that names the version of every table; it is
written aside and then moved to the next number, which fails if that number is taken. So a reader of the greatest number
sees tables that belong together, whatever is written meanwhile, and of two writers the second notices: it commits on top if
the other changed nothing that it had read, and else reads again and repeats its work. Old versions go with
:meth:`Store.prune`. A file system that decides a move without overwriting in one step, as HDFS does, makes this exact; a
local folder looks before it moves.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.plans.scratch import drop


class Conflict(RuntimeError):
    """Another writer changed a table that this one had read."""


@dataclass(frozen=True)
class Snapshot:
    """The tables of one commit; ``seen`` are those that were asked for."""

    store: Store
    number: int
    versions: dict[str, str]
    seen: set[str] = field(default_factory=set)

    def has(self, table: str) -> bool:
        self.seen.add(table)
        return table in self.versions

    def read(self, table: str, schema: str | None = None) -> DataFrame:
        """The table as of this commit; an empty one of ``schema`` before its first write."""
        if not self.has(table):
            if schema is None:
                raise ValueError(f"there is no table {table}")
            return self.store.spark.createDataFrame([], schema)
        return self.store.spark.read.parquet(f"{self.store.root}/{table}/{self.versions[table]}")


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, where: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(where)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    # Commits

    def _numbers(self) -> list[int]:
        where = self._path(f"{self.root}/_commits")
        names = [x.getPath().getName() for x in self._fs().listStatus(where)] if self._fs().exists(where) else []
        return sorted(int(n[2:]) for n in names if n.startswith("c-"))

    def _pointer(self, number: int) -> str:
        return f"{self.root}/_commits/c-{number:012d}"

    def _versions(self, number: int) -> dict[str, str]:
        stream = self._fs().open(self._path(self._pointer(number)))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return dict(line.split("\t") for line in text.splitlines())

    def snapshot(self) -> Snapshot:
        """All tables as of the last commit."""
        numbers = self._numbers()
        return Snapshot(self, numbers[-1], self._versions(numbers[-1])) if numbers else Snapshot(self, -1, {})

    def _create(self, number: int, versions: dict[str, str]) -> bool:
        """Puts the commit in place under its number; false if the number is taken."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        aside = self._path(f"{self.root}/_commits/.new-{uuid.uuid4().hex}")
        out = self._fs().create(aside, False)
        out.write("".join(f"{t}\t{v}\n" for t, v in sorted(versions.items())).encode())
        out.close()
        never = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), conf).rename(aside, self._path(self._pointer(number)), never)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
                raise
            self._fs().delete(aside, False)
            return False
        return True

    def commit(self, tables: dict[str, DataFrame], base: Snapshot | None = None) -> int:
        """Writes new versions of ``tables`` and shows them at once; returns the number of the commit.

        With ``base`` the commit is refused if a table that was read through it, or one of ``tables``, has changed since:
        nothing of it is left then. Without, the tables are replaced whatever they are.
        """
        made = {table: f"v-{uuid.uuid4().hex}" for table in tables}
        for table, rows in tables.items():
            rows.write.parquet(f"{self.root}/{table}/{made[table]}")
        while True:
            now = self.snapshot()
            if base is not None and (changed := [t for t in sorted(base.seen | set(tables)) if now.versions.get(t) != base.versions.get(t)]):
                for table, version in made.items():
                    drop(self.spark, f"{self.root}/{table}/{version}")
                raise Conflict(f"{', '.join(changed)} changed since commit {base.number}")
            if self._create(now.number + 1, now.versions | made):
                return now.number + 1

    def change(self, build: Callable[[Snapshot], dict[str, DataFrame]], attempts: int = 5) -> int:
        """Commits the tables that ``build`` makes of a snapshot; when another writer was first, it is asked again with the new one."""
        for last in range(attempts - 1, -1, -1):
            snapshot = self.snapshot()
            try:
                return self.commit(build(snapshot), snapshot)
            except Conflict:
                if not last:
                    raise
        raise ValueError("attempts must be positive")

    def version(self, table: str) -> str | None:
        """The version that readers see."""
        return self.snapshot().versions.get(table)

    def read(self, table: str, schema: str | None = None) -> DataFrame:
        """The table as of now; an empty one of ``schema`` before its first write. Tables that belong together are read from one :meth:`snapshot`."""
        return self.snapshot().read(table, schema)

    def write(self, table: str, rows: DataFrame) -> None:
        """Makes ``rows`` the table."""
        self.write_all({table: rows})

    def write_all(self, tables: dict[str, DataFrame]) -> None:
        """Makes each frame its table, all in one commit."""
        self.commit(tables)

    def prune(self, table: str) -> int:
        """Removes versions of a table that only earlier commits name, and those commits; returns how many. Versions not committed yet stay."""
        numbers = self._numbers()
        old = numbers[:-1]
        keep = self._versions(numbers[-1]) if numbers else {}
        gone = {v for n in old if (v := self._versions(n).get(table))} - {keep.get(table)}
        gone = {v for v in gone if self._fs().exists(self._path(f"{self.root}/{table}/{v}"))}
        for version in gone:
            drop(self.spark, f"{self.root}/{table}/{version}")
        return len(gone)

    def forget(self) -> None:
        """Removes all commits but the last; versions that only they name can no longer be pruned, so prune first."""
        for number in self._numbers()[:-1]:
            drop(self.spark, self._pointer(number))

    def drop_tenant(self) -> None:
        drop(self.spark, self.root)

    # Scans

    def page(self, table: str, key: str, after: object | None, size: int, columns: list[str] | None = None) -> DataFrame:
        """The next ``size`` rows behind ``after`` by key: a range that reaches the scan, and a top-k."""
        rows = self.read(table)
        rows = rows if after is None else rows.where(F.col(key) > F.lit(after))
        return (rows.select(*columns) if columns else rows).orderBy(key).limit(size)

    def lookup(self, table: str, keys: DataFrame, key: str) -> DataFrame:
        """The rows of the given keys, by a semi join instead of lists in a query."""
        return self.read(table).join(keys.select(key).distinct(), key, "left_semi")

    def missing(self, table: str, keys: DataFrame, key: str) -> DataFrame:
        """The given keys that have no row."""
        return keys.select(key).distinct().join(self.read(table).select(key), key, "left_anti")

    # Writes

    def upsert(self, table: str, rows: DataFrame, keys: list[str], keep: list[str] | None = None) -> None:
        """Rows of new keys are added, those of known keys replaced; columns in ``keep`` stay as stored where they are set.

        Two rows of one key are refused.
        """
        if not rows.groupBy(*keys).count().where("count > 1").isEmpty():
            raise ValueError("a key is written twice")

        def build(now: Snapshot) -> dict[str, DataFrame]:
            if not now.has(table):
                return {table: rows}
            old, fresh = now.read(table), rows
            if keep:
                stored = old.select(*keys, *[F.col(c).alias(f"_{c}") for c in keep])
                fresh = rows.join(stored, keys, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in keep else F.col(c) for c in rows.columns])
            return {table: old.join(rows.select(*keys), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)}

        self.change(build)

    def insert_missing(self, table: str, rows: DataFrame, keys: list[str]) -> None:
        """Adds rows of new keys only: placeholders that must not touch known pages."""
        more = lambda old: rows.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")
        self.change(lambda now: {table: now.read(table).unionByName(more(now.read(table)), allowMissingColumns=True)})

    def delete(self, table: str, keys: DataFrame, on: list[str]) -> None:
        self.change(lambda now: {table: now.read(table).join(keys.select(*on).distinct(), on, "left_anti")})

    def replace_groups(self, table: str, rows: DataFrame, group: list[str], groups: DataFrame | None = None) -> None:
        """Makes ``rows`` all there is of their groups; ``groups`` names groups that may end up empty. Others stay."""
        named = rows.select(*group) if groups is None else rows.select(*group).union(groups.select(*group))

        def build(now: Snapshot) -> dict[str, DataFrame]:
            old = now.read(table) if now.has(table) else rows.limit(0)
            return {table: old.join(named.distinct(), group, "left_anti").unionByName(rows, allowMissingColumns=True)}

        self.change(build)

    def keep_only(self, table: str, keys: DataFrame, on: list[str]) -> None:
        """Removes what is not on the list."""
        self.change(lambda now: {table: now.read(table).join(keys.select(*on).distinct(), on, "left_semi")})

    def set_columns(self, table: str, values: DataFrame, on: list[str], names: list[str], clear: bool = False, scope: Column | None = None) -> None:
        """Sets ``names`` on the rows of ``values``; with ``clear`` rows without a value lose theirs, within ``scope`` if given.

        One value fans out to every row that has its key.
        """
        self.change(lambda now: {table: self._set(now.read(table), values, on, names, clear, scope)})

    @staticmethod
    def _set(old: DataFrame, values: DataFrame, on: list[str], names: list[str], clear: bool = False, scope: Column | None = None) -> DataFrame:
        fresh = values.select(*on, *[F.col(n).alias(f"_{n}") for n in names], F.lit(True).alias("_set"))
        emptied = F.col("_set").isNull() & (F.lit(True) if scope is None else scope)
        pick = lambda n: F.when(F.col("_set"), F.col(f"_{n}")).when(emptied & F.lit(clear), F.lit(None)).otherwise(F.col(n)).alias(n)
        rows, added = old.join(fresh, on, "left"), [n for n in names if n not in old.columns]
        for n in added:
            rows = rows.withColumn(n, F.lit(None).cast(values.schema[n].dataType))
        return rows.select(*[pick(c) if c in names else F.col(c) for c in [*old.columns, *added]])

    def set_vectors(self, table: str, vectors: DataFrame, key: str, guard: str, name: str, width: int) -> None:
        """Writes unit vectors of pages whose ``guard`` (a hash of the text that was embedded) still holds, all or none.

        Refused: ids twice, another width, numbers that are not finite, lengths off 1 by more than 1e-6, and texts that changed.
        """
        ok = (F.size(name) == width) & ~F.exists(name, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))) & (F.abs(F.sqrt(F.aggregate(name, F.lit(0.0), lambda a, x: a + x * x)) - 1) <= 1e-6)

        def build(now: Snapshot) -> dict[str, DataFrame]:
            stored = now.read(table).select(key, F.col(guard).alias("_guard"))
            seen = vectors.join(stored, key, "left")
            bad = seen.agg(
                (F.count("*") - F.count_distinct(key)).alias("ids seen twice"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("vectors unfit"), F.count_if(~F.col("_guard").eqNullSafe(F.col(guard))).alias("texts changed")
            ).first()
            if any(bad):
                raise ValueError(", ".join(f"{n} {k}" for k, n in bad.asDict().items() if n))
            return {table: self._set(now.read(table), vectors, [key], [name])}

        self.change(build)

    def retire(self, table: str, active: DataFrame, key: str) -> None:
        """Active hubs are written, others stay as retired: an id is never given twice."""

        def build(now: Snapshot) -> dict[str, DataFrame]:
            old = now.read(table) if now.has(table) else active.withColumn("retired", F.lit(False)).limit(0)
            gone = old.join(active.select(key), key, "left_anti").withColumn("retired", F.lit(True))
            return {table: gone.unionByName(active.withColumn("retired", F.lit(False)), allowMissingColumns=True)}

        self.change(build)

    def next_id(self, table: str, key: str) -> int:
        """One more than any id there ever was."""
        return 0 if self.version(table) is None else (self.read(table).agg(F.max(key)).first()[0] if not self.read(table).isEmpty() else -1) + 1


def label_file(rows: DataFrame, path: str, columns: list[str], seed: int) -> None:
    """A CSV that people fill in: UTF-8 with a mark, rows in a seeded order, cells that a spreadsheet would run as formulas made text."""
    guard = lambda c: F.when(F.col(c).cast("string").rlike("^[=+\\-@\\t\\r]"), F.concat(F.lit("'"), F.col(c).cast("string"))).otherwise(F.col(c).cast("string")).alias(c)
    order = F.sha2(F.concat_ws("\t", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]), 256)
    first = columns[0]
    named = rows.orderBy(order).select(*[guard(c) for c in columns]).withColumnRenamed(first, "﻿" + first)
    named.coalesce(1).write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def read_label_file(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """The rows of a filled-in file, blank ones left out; missing or repeated columns are refused."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(path)
    names = [c.lstrip("﻿").strip() for c in rows.columns]
    if len(set(names)) != len(names) or (lost := [c for c in required if c not in names]):
        raise ValueError(f"columns {names} repeat or lack some of {required}")
    rows = rows.toDF(*names)
    return rows.where(F.concat_ws("", *[F.trim(F.coalesce(c, F.lit(""))) for c in names]) != "")


def checked_labels(rows: DataFrame, exported: DataFrame) -> DataFrame:
    """``rows`` of a label file with problem (null: none) and grade: 3 good, 2 fair, 1 poor. ``exported`` has pair_id, source and target."""
    known = exported.select("pair_id", F.col("source").alias("_s"), F.col("target").alias("_t"))
    joined = rows.join(known, "pair_id", "left").withColumn("_n", F.count("*").over(Window.partitionBy("pair_id")))
    label = F.lower(F.trim("label"))
    problem = (
        F.when(F.col("_s").isNull(), "unknown_pair").when(F.col("_n") > 1, "pair_twice").when((F.col("source") != F.col("_s")) | (F.col("target") != F.col("_t")), "pair_changed")
        .when(F.coalesce(label, F.lit("")) == "", "no_label").when(~label.isin("good", "fair", "poor"), "unknown_label").when((label != "good") & (F.trim(F.coalesce("reason", F.lit(""))) == ""), "no_reason")
    )
    grade = F.when(label == "good", 3).when(label == "fair", 2).when(label == "poor", 1)
    return joined.withColumn("problem", problem).withColumn("grade", F.when(F.col("problem").isNull(), grade)).drop("_s", "_t", "_n")

