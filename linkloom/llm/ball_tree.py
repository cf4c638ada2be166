"""Exact top-k inner products of stated queries: branch and bound over cells in Spark and over one ball tree per shard in tasks.

A ball of centre c and radius r around vectors v bounds q.v by q.c + |q| r. Vectors are dealt to cells (centres from a
bounded sample; every vector is dealt), large cells to shards by hash. A query first searches its own shard, then the rest
of its cell, then the other cells whose bound reaches its current k-th score; each wave starts from the k-th scores that all
earlier ones found. Inside a task a shard's tree drops subtrees below the k-th score, and a query visits its leaves by
falling bound until none can reach it. Bounds are floats with a margin, scores are exact integers, so nothing is lost.

A component x becomes floor(256 * x). Vectors that are null or hold null or non-finite components take no part, nor do rows
without an id. Vectors of another length have no product with a query, empty vectors have product 0. Rows are vectors of
their own, whatever their id: a query leaves out its own row only, and a repeated row is found. Scores outside 64 bits are
not supported. Columns beside the id and the vector are ignored; no queries or an empty table give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.plans.scratch import materialize

#: Vectors of a shard, of a leaf; shards of a cell that one task takes; queries of a block; most cells; vectors sampled for their centres.
SHARD, LEAF, SHARDS, QUERIES, CELLS, SAMPLE = 2048, 64, 4, 4096, 128, 4096
FOUND = "query bigint, query_id bigint, row bigint, vec_id bigint, score bigint"
_NONE = np.iinfo(np.int64).min


def _matrix(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1 if len(lists.flatten()) else 0)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of two matrices of rows; by floats where these hold every sum exactly."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return (a.astype(float) @ b.astype(float).T).astype(np.int64) if top < 2.0**53 else a @ b.T


class Tree:
    """A ball tree: node i covers ``order[start[i]:end[i]]`` in the ball (center[i], radius[i]); ``kids[i]`` is None for a leaf."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order, self.start, self.end, self.center, self.radius, self.kids = np.arange(len(points)), [], [], [], [], []
        self._add(points.astype(float), 0, len(points), leaf)

    def _add(self, x: np.ndarray, start: int, end: int, leaf: int) -> int:
        own = x[self.order[start:end]]
        center = own.mean(axis=0)
        far = np.linalg.norm(own - center, axis=1)
        node = len(self.start)
        for name, value in (("start", start), ("end", end), ("center", center), ("radius", far.max(initial=0.0)), ("kids", None)):
            getattr(self, name).append(value)
        if end - start > leaf and far.max() > 0:
            one = own[far.argmax()]
            axis = own[np.linalg.norm(own - one, axis=1).argmax()] - one
            half = (end - start) // 2
            self.order[start:end] = self.order[start:end][np.argpartition(own @ axis, half)]
            self.kids[node] = (self._add(x, start, start + half, leaf), self._add(x, start + half, end, leaf))
        return node

    def bound(self, node: int, q: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """Upper bounds of the products of the rows of ``q`` with every vector of the node; a margin covers rounding."""
        c, r = self.center[node], self.radius[node]
        return q @ c + norm * r + 1e-9 * norm * (np.linalg.norm(c) + r) + 1e-6

    def leaves(self, q: np.ndarray, norm: np.ndarray, kth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, leaf, bound) of the leaves that may hold a score of ``kth`` or more; subtrees below it are not entered."""
        found, stack = [], [(0, np.arange(len(q)), np.full(len(q), np.inf))]
        while stack:
            node, at, above = stack.pop()
            bound = np.minimum(above, self.bound(node, q[at], norm[at]))
            good = bound >= kth[at]
            at, bound = at[good], bound[good]
            if len(at) and self.kids[node]:
                stack += [(kid, at, bound) for kid in self.kids[node]]
            elif len(at):
                found.append((at, np.full(len(at), node), bound))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


class Best:
    """The ``k`` best (score, vec_id, row) of every query so far, and the score that a new one has to reach."""

    def __init__(self, k: int, kth: np.ndarray):
        self.k, self.kth = k, kth.copy()
        self.query, self.score, self.vec_id, self.row = (np.zeros(0, np.int64) for _ in range(4))

    def add(self, query: np.ndarray, score: np.ndarray, vec_id: np.ndarray, row: np.ndarray) -> None:
        a = [np.concatenate(x) for x in ((self.query, query), (self.score, score), (self.vec_id, vec_id), (self.row, row))]
        order = np.lexsort((a[3], a[2], -a[1], a[0]))
        a = [x[order] for x in a]
        place = np.arange(len(order)) - np.searchsorted(a[0], a[0])
        self.query, self.score, self.vec_id, self.row = (x[place < self.k] for x in a)
        last = a[0][place == self.k - 1], a[1][place == self.k - 1]
        self.kth[last[0]] = np.maximum(self.kth[last[0]], last[1])


def search_shard(best: Best, q: np.ndarray, q_row: np.ndarray, v: np.ndarray, vec_id: np.ndarray, row: np.ndarray) -> None:
    """Adds to ``best`` what the queries find among the vectors of one shard, each query's leaves by falling bound."""
    tree, norm, qf = Tree(v), np.linalg.norm(q.astype(float), axis=1), q.astype(float)
    at, leaf, bound = tree.leaves(qf, norm, best.kth)
    order = np.lexsort((-bound, at))
    at, leaf, bound = at[order], leaf[order], bound[order]
    place = np.arange(len(at)) - np.searchsorted(at, at)
    for step in range(place.max(initial=-1) + 1):
        now = (place == step) & (bound >= best.kth[at])
        hits = []
        for node in np.unique(leaf[now]):
            asking, held = at[now & (leaf == node)], tree.order[tree.start[node] : tree.end[node]]
            score = products(q[asking], v[held])
            i, j = np.nonzero((score >= best.kth[asking][:, None]) & (q_row[asking][:, None] != row[held][None, :]))
            hits.append((asking[i], score[i, j], vec_id[held[j]], row[held[j]]))
        if hits:
            best.add(*(np.concatenate(x) for x in zip(*hits, strict=True)))


def _result(best: Best, q_row: np.ndarray, q_id: np.ndarray) -> pa.Table:
    return pa.table({"query": q_row[best.query], "query_id": q_id[best.query], "row": best.row, "vec_id": best.vec_id, "score": best.score})


def _at_home(k: int):
    """Queries of a shard search the shard they stand in."""

    def run(shard: pa.Table) -> pa.Table:
        v, (row, vec_id, is_query) = _matrix(shard["v"]), (shard[c].to_numpy() for c in ("row", "vec_id", "is_query"))
        q = np.flatnonzero(is_query)
        best = Best(k, np.full(len(q), _NONE))
        if len(q):
            search_shard(best, v[q], row[q], v, vec_id, row)
        return _result(best, row[q], vec_id[q])

    return run


def _away(k: int):
    """A block of queries searches some shards of one cell, without the shard it comes from; k-th scores pass from one to the next."""

    def run(shards: pa.Table, queries: pa.Table) -> pa.Table:
        v, q = _matrix(shards["v"]), _matrix(queries["q_v"])
        row, vec_id, shard = (shards[c].to_numpy() for c in ("row", "vec_id", "shard"))
        q_row, q_id, home = (queries[f"q_{c}"].to_numpy() for c in ("row", "vec_id", "skip"))
        best = Best(k, queries["q_kth"].to_numpy())
        for s in np.unique(shard) if len(q) else ():
            held, asking = np.flatnonzero(shard == s), np.flatnonzero(home != s)
            part = Best(k, best.kth[asking])
            search_shard(part, q[asking], q_row[asking], v[held], vec_id[held], row[held])
            best.add(asking[part.query], part.score, part.vec_id, part.row)
        return _result(best, q_row, q_id)

    return run


def _centers(vectors: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Centres of cells by vector length, from about ``SAMPLE`` vectors chosen by hash, twice as many at most; five rounds of nearest means."""
    chosen = vectors.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(1, n)) * (1 << 30))).limit(2 * SAMPLE)
    lists = chosen.select("v").toArrow()["v"].combine_chunks()
    lengths = lists.value_lengths().to_numpy()
    centers = {}
    for length in np.unique(lengths).tolist():
        x = np.unique(_matrix(lists.take(pa.array(np.flatnonzero(lengths == length)))).astype(float), axis=0)
        c = x[np.random.default_rng(0).permutation(len(x))[: min(CELLS, -(-n // SHARD))]]
        for _ in range(5):
            near = ((c * c).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
            c = np.array([x[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(len(c))]).reshape(c.shape)
        centers[length] = c
    return centers


def _cells(centers: dict[int, np.ndarray]):
    """Adds the nearest centre and the distance to it; a length that the sample missed has one cell around 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, lengths = batch.column("v"), batch.column("v").value_lengths().to_numpy()
            cell, far = np.zeros(len(lists), np.int32), np.zeros(len(lists))
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                x, c = _matrix(lists.take(pa.array(at))).astype(float), centers.get(int(n), np.zeros((1, n)))
                cell[at] = ((c * c).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
                far[at] = np.linalg.norm(x - c[cell[at]], axis=1)
            names = [*batch.schema.names, "cell", "far"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=names)

    return run


def _reached(centers: dict[int, np.ndarray], radius: dict[tuple[int, int], float]):
    """(row, to) for the cells, without the query's own, whose bound reaches the query's k-th score; at most ``CELLS`` a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, lengths = batch.column("v"), batch.column("v").value_lengths().to_numpy()
            row, cell, kth = (batch.column(c).to_numpy() for c in ("row", "cell", "kth"))
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                q, c = _matrix(lists.take(pa.array(at))).astype(float), centers.get(int(n), np.zeros((1, n)))
                r = np.array([radius.get((int(n), i), -np.inf) for i in range(len(c))])
                norm = np.linalg.norm(q, axis=1)[:, None]
                size = np.linalg.norm(c, axis=1) + np.maximum(r, 0)
                bound = np.where(np.isfinite(r), q @ c.T + norm * np.maximum(r, 0) + 1e-9 * norm * size + 1e-6, -np.inf)
                i, j = np.nonzero(np.isfinite(bound) & (bound >= kth[at][:, None]) & (cell[at][:, None] != np.arange(len(c))))
                yield pa.RecordBatch.from_arrays([pa.array(row[at[i]]), pa.array(j.astype(np.int32))], names=["row", "to"])

    return run


def _visit(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """What ``queries`` (row, vec_id, v, length, to, skip, kth) find in the cells they go ``to``, in blocks of bounded size."""
    asked = queries.groupBy("length", "to").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks"))
    groups = F.ceil(F.col("shards") / SHARDS).cast("int")
    left = vectors.join(asked.withColumnRenamed("to", "cell"), ["length", "cell"]).select(
        "length", "cell", F.floor(F.col("shard") / SHARDS).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "row", "vec_id", "v", "shard"
    )
    sizes = vectors.groupBy("length", F.col("cell").alias("to")).agg(F.max("shards").alias("shards"))
    right = queries.join(asked, ["length", "to"]).join(sizes, ["length", "to"]).select(
        F.col("length").alias("q_length"), F.col("to").alias("q_cell"), F.explode(F.sequence(F.lit(0), groups - 1)).alias("q_part"), F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int").alias("q_block"),
        *[F.col(c).alias(f"q_{c}") for c in ("row", "vec_id", "v", "skip", "kth")],
    )
    keys = ["length", "cell", "part", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*[f"q_{c}" for c in keys])).applyInArrow(_away(k), FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(embeddings: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest products of every row for which ``is_query`` holds, ties to the smaller vec_id."""
    x = F.col("embedding")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    good = embeddings.where(F.col("vec_id").isNotNull() & x.isNotNull() & F.coalesce(whole, F.lit(False)))
    ints = good.select("vec_id", F.coalesce(is_query, F.lit(False)).alias("is_query"), F.transform(x, lambda c: F.floor(256 * c.cast("double"))).alias("v"))
    centers = _centers(ints, ints.count())
    placed = ints.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("bigint").alias("vec_id"), "is_query", "v", F.size("v").alias("length"))
    placed = materialize(placed.mapInArrow(_cells(centers), "row bigint, vec_id bigint, is_query boolean, v array<bigint>, length int, cell int, far double"), "cells")
    sizes = materialize(placed.groupBy("length", "cell").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards"), F.max("far").alias("far")), "cell-sizes")
    vectors = placed.join(sizes.select("length", "cell", "shards"), ["length", "cell"]).withColumn("shard", F.pmod(F.xxhash64("row"), F.col("shards")).cast("int"))
    found = materialize(vectors.select("length", "cell", "shard", "row", "vec_id", "is_query", "v").groupBy("length", "cell", "shard").applyInArrow(_at_home(k), FOUND), "found")

    def asking() -> DataFrame:
        """Every query with the k-th score that all waves so far know."""
        kth = _best(found, k).groupBy("query").agg(F.when(F.count("*") == k, F.min("score")).alias("kth"))
        own = vectors.where("is_query").join(kth, F.col("row") == F.col("query"), "left")
        return own.select("row", "vec_id", "v", "length", "cell", "shard", F.coalesce("kth", F.lit(_NONE)).alias("kth"))

    if sizes.where("shards > 1").limit(1).count():
        more = vectors.where("shards > 1").select("length", F.col("cell").alias("c9")).distinct()
        at_home = asking().join(more.withColumnRenamed("c9", "cell"), ["length", "cell"]).withColumnRenamed("cell", "to").withColumnRenamed("shard", "skip")
        found = found.unionByName(materialize(_visit(vectors, at_home, k), "found"))
    radius = {(r["length"], r["cell"]): r["far"] for r in sizes.where(F.col("length").isin(list(centers))).collect()}  # no more than sampled vectors
    queries = materialize(asking(), "queries")
    to = queries.select("row", "v", "cell", "kth").mapInArrow(_reached(centers, radius), "row bigint, to int")
    away = queries.drop("cell", "shard").withColumn("skip", F.lit(-1)).join(to, "row")
    found = found.unionByName(materialize(_visit(vectors, away, k), "found"))
    return _best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
