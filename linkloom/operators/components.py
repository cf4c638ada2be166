"""Connected components of an edge table, without gathering edges on one machine.

Every partition first contracts its own edges with union-find to spanning forests of at most ``HELD`` nodes. Forests of
at most ``ONE`` edges are then joined by one task, which writes two tables in all; a loop over small tables mostly writes
files, and a local file system starts processes for each of them. Of larger ones, large-star and small-star steps
alternate until the edge set no longer changes. Grouped minima are pre-aggregated. A node
with very many larger neighbours (the centre of a star) is joined under ``SALTS`` keys, its minimum once under each, so
no task gets all its edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.plans import bitmap
from linkloom.plans.scratch import materialize

#: Nodes that a contracting task holds at most; edges of a node that are dealt under salts; the number of salts.
HELD, HOT, SALTS = 1_000_000, 1024, 64
#: Edges that one task joins at most, so that it holds less than ``HELD`` nodes.
ONE = 200_000


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent.setdefault(p, p)
            x = parent[x]
        return x

    def forest() -> Iterator[pd.DataFrame]:
        pairs = [(x, root(x)) for x in list(parent)]
        parent.clear()
        pairs = np.array([p for p in pairs if p[0] != p[1]], dtype=np.int64).reshape(-1, 2)
        for i in range(0, len(pairs), 100_000):
            yield pd.DataFrame(pairs[i : i + 100_000], columns=["u", "v"])

    for batch in batches:
        for a, b in zip(batch["u"].tolist(), batch["v"].tolist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > HELD:
            yield from forest()
    yield from forest()


def _labelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, component) of all edges of a table that fits one task; every root once, as its own component."""
    known: set[int] = set()
    for part in _contract(batches):
        roots = set(part["v"].tolist()) - known
        known |= roots
        yield pd.DataFrame({"node": [*part["u"].tolist(), *roots], "component": [*part["v"].tolist(), *roots]}, dtype="int64")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours, linked to its smallest neighbour. ``edges`` run from the larger to the smaller end."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))  # nodes without a smaller neighbour are their own minimum
    hot = materialize(edges.groupBy("v").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("v"), "hot-nodes")
    if hot.isEmpty():
        moved = edges.join(low.select(F.col("u").alias("v"), "m"), "v", "left")
    else:
        # Both sides ask the same bitmap, so a node that shares a hot node's bit is salted on both, too.
        shared = bitmap.member(hot, "v")(F.col("v"))
        salted = edges.withColumn("salt", F.when(shared, F.pmod(F.xxhash64("u"), F.lit(SALTS))).otherwise(0).cast("int"))
        every = F.when(shared, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        moved = salted.join(low.select(F.col("u").alias("v"), "m").withColumn("salt", F.explode(every)), ["v", "salt"], "left")
    return moved.select("u", F.coalesce("m", "v").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", most: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; the component is its smallest node. Nodes are longs."""
    now = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).where("u <> v")
    now = materialize(now.mapInPandas(_contract, "u bigint, v bigint"), "edges")  # the root is the smaller end
    if now.count() <= min(ONE, HELD // 2):
        return materialize(now.coalesce(1).mapInPandas(_labelled, "node bigint, component bigint"), "components")
    seen = None
    for _ in range(most):
        now = materialize(_small_star(_large_star(now)), "edges")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
