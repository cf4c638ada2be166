"""An inverted-file index of page vectors: cells around centres, searched cell by cell, exactly or with a stated number of probes.

Centres come from a bounded sample; every page is put into the cell of its nearest centre, and large cells are split into
pieces by hash, so no task holds more than one piece and one block of queries. A query visits the cells nearest to it, then,
in exact mode, every other cell that can still hold one of its ``k`` nearest: a page at angle t from its centre, of which no
page of the cell is farther than r, cannot be nearer to a query at angle a than a - r. Where vectors form groups most cells
drop out; where they don't, the search reads all of them, in the same blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.plans.scratch import materialize

#: Pages in a piece of a cell, queries of a block, most cells of an index, pages whose vectors are sampled for the centres.
PIECE, QUERIES, CELLS, SAMPLE = 2048, 2048, 256, 8192
#: Queries of a block that are compared at once.
ROWS = 512
#: Similarities are rounded to 6 places, so a bound may be short by half of the last one.
MARGIN = 1e-6
FOUND = "target bigint, source bigint, similarity double"


@dataclass(frozen=True)
class Index:
    """The stored rows (page, language, vector, cell, piece, pieces), the centres, and by cell the greatest angle of a page to its centre."""

    rows: DataFrame
    centers: np.ndarray
    angles: np.ndarray


def _matrix(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(lists), -1) if len(flat) else np.zeros((len(lists), 0))


def _units(x: np.ndarray) -> np.ndarray:
    """Rows over their lengths; zero rows stay."""
    size = np.linalg.norm(x, axis=1)
    return x / np.where(size > 0, size, 1)[:, None]


def _centers(x: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Unit centres of a sample of unit rows: seeded start, then means of the nearest rows."""
    x = np.unique(x.round(9), axis=0)
    c = x[np.random.default_rng(0).permutation(len(x))[: min(count, len(x))]]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        c = _units(np.array([x[near == i].sum(axis=0) if (near == i).any() else c[i] for i in range(len(c))]))
    return c


def build(pages: DataFrame, cells: int | None = None, sample: int = SAMPLE) -> Index:
    """Indexes every row of ``pages`` (page, language, vector). ``cells`` defaults to one per half piece, ``CELLS`` at most.

    The sample is about ``sample`` rows by hash and twice as many at most; nothing else of the pages reaches the driver.
    """
    n = pages.count()
    share = int(min(1.0, sample / max(1, n)) * (1 << 30))
    chosen = pages.where(F.pmod(F.xxhash64("page"), F.lit(1 << 30)) < share).select("vector").limit(2 * sample).toArrow()
    centers = _centers(_units(_matrix(chosen["vector"])), cells or min(CELLS, max(1, -(-2 * n // PIECE)))) if chosen.num_rows else np.zeros((1, 0))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = _units(_matrix(batch.column("vector"))) @ centers.T if batch.num_rows else np.zeros((0, 1))
            cell = near.argmax(axis=1)
            angle = np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(angle)], names=[*batch.schema.names, "cell", "angle"])

    rows = pages.select(F.col("page").cast("bigint").alias("page"), "language", F.col("vector").cast("array<double>").alias("vector"))
    placed = materialize(rows.mapInArrow(assign, "page bigint, language string, vector array<double>, cell int, angle double"), "index-cells")
    angles = np.full(len(centers), -1.0)
    for r in placed.groupBy("cell").agg(F.max("angle").alias("a")).collect():  # no more than CELLS
        angles[r["cell"]] = r["a"]
    sizes = placed.groupBy(F.col("language").alias("l9"), F.col("cell").alias("c9")).agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces"))
    dealt = placed.join(sizes, F.col("language").eqNullSafe(F.col("l9")) & (F.col("cell") == F.col("c9"))).drop("l9", "c9", "angle")
    return Index(materialize(dealt.withColumn("piece", F.pmod(F.xxhash64("page"), F.col("pieces")).cast("int")), "index"), centers, angles)


def _probes(index: Index, first: int | None, after: int | None, places: bool = False):
    """(page, cell), with ``places`` and its place in the order of bounds: the ``first`` nearest non-empty cells of every query; or those behind the first ``after`` that reach its k-th similarity."""
    centers, angles = index.centers, index.angles
    filled = np.flatnonzero(angles >= 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not len(filled):
                continue
            cos = np.clip(_units(_matrix(batch.column("vector"))) @ centers[filled].T, -1, 1)
            bound = np.cos(np.maximum(0, np.arccos(cos) - angles[filled]))
            order = np.argsort(-bound, axis=1, kind="stable")
            if first is not None:
                row, cell = np.repeat(np.arange(len(cos)), min(first, len(filled))), order[:, :first].ravel()
                place = np.tile(np.arange(min(first, len(filled))), len(cos))
            else:
                kth = batch.column("kth").to_numpy(zero_copy_only=False)
                rest = order[:, after:]
                row, place = np.nonzero(np.take_along_axis(bound, rest, axis=1) + MARGIN >= kth[:, None])
                cell = rest[row, place]
            columns = [batch.column("page").take(pa.array(row)), pa.array(filled[cell].astype(np.int32)), pa.array(place.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns if places else columns[:2], names=["page", "cell", "place"] if places else ["page", "cell"])

    return run


def _block(k: int):
    """The ``k`` nearest pages of one piece for every query of a block; side 1 of the right are links that rule a pair out."""

    def run(pages: pa.Table, asked: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        links = asked.filter(pa.compute.equal(asked["side"], 1))
        asked = asked.filter(pa.compute.equal(asked["side"], 0))
        if pages.num_rows and asked.num_rows:
            sources, order = (lambda x: (np.sort(x), np.argsort(x, kind="stable")))(pages["page"].to_numpy())
            b, kth, targets = _units(_matrix(pages["vector"]))[order], asked["kth"].to_numpy(), asked["target"].to_numpy()
            by_id = np.argsort(targets, kind="stable")
            at = by_id[np.minimum(np.searchsorted(targets[by_id], links["target"].to_numpy()), len(targets) - 1)]
            place = np.minimum(np.searchsorted(sources, links["other"].to_numpy()), len(sources) - 1)
            good = (targets[at] == links["target"].to_numpy()) & (sources[place] == links["other"].to_numpy())
            at, place = at[good], place[good]
            for start in range(0, len(targets), ROWS):
                own = targets[start : start + ROWS]
                cos = np.clip(_units(_matrix(asked["t_vector"].slice(start, ROWS))) @ b.T, -1, 1).round(6)
                here = (at >= start) & (at < start + len(own))
                cos[at[here] - start, place[here]] = -np.inf
                cos[own[:, None] == sources[None, :]] = -np.inf
                floor = np.partition(cos, -k, axis=1)[:, -k] if cos.shape[1] > k else np.full(len(cos), -2.0)
                i, j = np.nonzero((cos >= np.maximum(floor, kth[start : start + ROWS])[:, None]) & np.isfinite(cos))
                best = np.lexsort((j, -cos[i, j], i))
                i, j = i[best], j[best]
                first = np.arange(len(i)) - np.searchsorted(i, i) < k
                i, j = i[first], j[first]
                out.append((own[i], sources[j], cos[i, j]))
        return pa.table(dict(zip(("target", "source", "similarity"), (np.concatenate(x) for x in zip(*out, strict=True)), strict=True)))

    return run


def _visit(index: Index, queries: DataFrame, links: DataFrame, k: int) -> DataFrame:
    """What ``queries`` (page, language, vector, kth, cell) find in their cells."""
    key = lambda *names: [F.col(n) for n in names]
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    asked = queries.groupBy(F.col("language").alias("l9"), F.col("cell").alias("c9")).agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks"))
    dealt = queries.join(asked, same("language", "l9") & (F.col("cell") == F.col("c9"))).drop("l9", "c9").withColumn("block", F.pmod(F.xxhash64("page"), F.col("blocks")).cast("int"))
    left = index.rows.join(asked, same("language", "l9") & (F.col("cell") == F.col("c9"))).select("language", "cell", "piece", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "page", "vector")
    sizes = index.rows.select(F.col("language").alias("l9"), F.col("cell").alias("c9"), "pieces").distinct()
    none = F.lit(None)
    sides = dealt.join(sizes, same("language", "l9") & (F.col("cell") == F.col("c9"))).select(
        F.col("language").alias("q_language"), F.col("cell").alias("q_cell"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("q_piece"), F.col("block").alias("q_block"),
        F.col("page").alias("target"), F.col("vector").alias("t_vector"), F.col("kth"), none.cast("bigint").alias("other"), F.lit(0).alias("side"),
    )
    placed = index.rows.select(F.col("page").alias("source"), F.col("language").alias("s_language"), F.col("cell").alias("s_cell"), F.col("piece").alias("s_piece"))
    ends = links.where("source <> target").select("source", "target").distinct().join(placed, "source").join(dealt.select(F.col("page").alias("target"), "language", "cell", "block"), "target")
    ruled = ends.where(same("language", "s_language") & (F.col("cell") == F.col("s_cell"))).select(
        F.col("language").alias("q_language"), F.col("cell").alias("q_cell"), F.col("s_piece").alias("q_piece"), F.col("block").alias("q_block"),
        "target", none.cast("array<double>").alias("t_vector"), none.cast("double").alias("kth"), F.col("source").alias("other"), F.lit(1).alias("side"),
    )
    names = ("language", "cell", "piece", "block")
    return left.groupBy(*key(*names)).cogroup(sides.unionByName(ruled).groupBy(*key(*(f"q_{n}" for n in names)))).applyInArrow(_block(k), FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("target").orderBy(F.col("similarity").desc(), "source")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(index: Index, is_query: Column, links: DataFrame, k: int = 10, probes: int = 4, exact: bool = True) -> DataFrame:
    """(target, source, rank, similarity): the ``k`` nearest pages of the same language that are neither the target nor link to it.

    Targets are the indexed pages for which ``is_query`` holds. Without ``exact`` only the ``probes`` cells with the best
    bound are read. Ties go to the smaller id, a zero vector scores 0, links from a page to itself don't count.
    """
    queries = materialize(index.rows.where(is_query).select("page", "language", "vector"), "index-queries")
    own = queries.mapInArrow(_probes(index, probes, None), "page bigint, cell int")
    first = queries.withColumn("kth", F.lit(-2.0)).join(own, "page")
    found = materialize(_visit(index, first, links, k), "index-found")
    if exact and (index.angles >= 0).sum() > probes:
        kth = _first(found, k).groupBy(F.col("target").alias("page")).agg(F.when(F.count("*") == k, F.min("similarity")).alias("kth"))
        known = materialize(queries.join(kth, "page", "left").withColumn("kth", F.coalesce("kth", F.lit(-2.0))), "index-queries")
        more = known.mapInArrow(_probes(index, None, probes), "page bigint, cell int")
        found = found.unionByName(materialize(_visit(index, known.join(more, "page"), links, k), "index-found"))
    return _first(found, k).select("target", "source", F.col("rank").cast("int").alias("rank"), "similarity")


def compared(index: Index, is_query: Column, probes: int = 4) -> DataFrame:
    """pairs, every: the pairs that a search with ``probes`` cells compares, and those of comparing every query with every page of its language."""
    queries = index.rows.where(is_query).select("page", "language", "vector")
    sizes = index.rows.groupBy(F.col("language").alias("l9"), F.col("cell").alias("c9")).agg(F.count("*").alias("n"))
    own = queries.mapInArrow(_probes(index, probes, None), "page bigint, cell int").join(queries.select("page", "language"), "page")
    pairs = own.join(sizes, F.col("language").eqNullSafe(F.col("l9")) & (F.col("cell") == F.col("c9"))).agg(F.sum("n").alias("pairs"))
    pools = index.rows.groupBy(F.col("language").alias("l9")).agg(F.count("*").alias("n"))
    every = queries.join(pools, F.col("language").eqNullSafe(F.col("l9"))).agg(F.sum("n").alias("every"))
    return pairs.crossJoin(every)  # one row each


def needed_probes(index: Index, truth: DataFrame, least: float = 0.9) -> int:
    """The fewest cells to probe so that a share ``least`` of the pairs (target, source) of ``truth`` is found; all of them for none.

    ``truth`` should come from an exact search of some targets; only counts per place of a cell, at most ``CELLS``, reach the driver.
    """
    every = len(index.centers)
    queries = index.rows.join(truth.select(F.col("target").alias("page")).distinct(), "page", "left_semi").select("page", "vector")
    order = queries.mapInArrow(_probes(index, every, None, True), "page bigint, cell int, place int")
    own = index.rows.select(F.col("page").alias("source"), "cell")
    seen = truth.join(own, "source").join(order.withColumnRenamed("page", "target"), ["target", "cell"]).groupBy("place").agg(F.count("*").alias("n"))
    counts = np.zeros(every)
    for r in seen.collect():
        counts[r["place"]] = r["n"]
    return int(np.searchsorted(np.cumsum(counts), least * counts.sum())) + 1 if counts.sum() else every


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: pairs (target, source) of ``truth``, those of them in ``found``, and their share."""
    both = truth.select("target", "source").join(found.select("target", "source").withColumn("hit", F.lit(1)), ["target", "source"], "left")
    return both.agg(F.count("*").alias("wanted"), F.count("hit").alias("found")).withColumn("recall", F.round(F.col("found") / F.col("wanted"), 6))
