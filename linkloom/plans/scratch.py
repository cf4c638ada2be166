"""Intermediate tables in the shared folder of the cluster.

A table written here cuts the lineage of what follows: every executor can read it again, so a lost
executor costs a task and never a recomputation of the whole plan.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: Paths handed out inside each open :func:`staged` call, innermost last.
_open: list[list[str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder of its own; a cluster session is refused,
    since a folder of one machine would lose rows there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        path = tempfile.mkdtemp(prefix="linkloom-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _own[app] = f"file://{path}"
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    path = f"{shared_root(spark)}/linkloom/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and returns a reader of it with the same schema."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged(spark: SparkSession, build: Callable[[], DataFrame], name: str) -> DataFrame:
    """Materializes what ``build`` returns, then removes every other table that it wrote on the way."""
    _open.append([])
    try:
        out = materialize(build(), name)
    finally:
        paths = _open.pop()
    keep = paths[-1]  # the last path handed out is that of the result
    for path in paths[:-1]:
        drop(spark, path)
    if _open:
        _open[-1].append(keep)
    return out


def drop(spark: SparkSession, path: str) -> None:
    """Removes a folder of this module through the file system that Spark uses for it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(df: DataFrame) -> None:
    """Drops the table behind a reader returned by :func:`materialize`, once nothing needs it."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/linkloom/" in folder:
            drop(df.sparkSession, folder)
