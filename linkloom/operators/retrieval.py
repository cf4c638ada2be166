"""Nearest sources of every target page, the pillar channel, and the k-nearest-neighbour graph."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.vector import cosine
from linkloom.operators.percentiles import quantiles
from linkloom.plans.scratch import materialize

#: Pages in a block, where a language has no more than that many blocks of them, and at least, and numbers of a block's vectors; pairs of pages that are compared in full at once; groups of sources whose best ones bound the rest; targets and sources that are compared in single precision at once.
BLOCK, BLOCKS, LEAST, NUMBERS, PAIRS, GROUPS, ROWS, PIECE = 16_384, 12, 1024, 4_000_000, 2_000_000, 128, 256, 4096
FOUND = "target bigint, source bigint, similarity double"
#: What stands for a pair that is ruled out.
OUT = -2.0


def _units(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Pages and unit vectors, without those that have no finite direction."""
    x = np.stack(pdf["vector"]).astype(float)
    size = np.linalg.norm(x, axis=1)
    with np.errstate(invalid="ignore"):
        x /= np.where(size > 0, size, 1)[:, None]
    good = np.isfinite(x).all(axis=1)
    return pdf["page"].to_numpy()[good], x[good]


def _first(row: np.ndarray, col: np.ndarray, value: np.ndarray, k: int) -> np.ndarray:
    """The places of the ``k`` best of every row, ties to the smaller column."""
    order = np.lexsort((col, -value, row))
    own = row[order]
    start = np.flatnonzero(np.diff(own, prepend=-1))
    return order[np.arange(len(own)) - np.repeat(start, np.diff(start, append=len(own))) < k]


def _best(a: np.ndarray, b: np.ndarray, ruled: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and cosine of the ``k`` best columns of every row from all cosines; ``ruled`` are flat places that are out."""
    cos = np.clip(a @ b.T, -1, 1).round(6)
    cos.ravel()[ruled] = OUT
    k = min(k, len(b))
    least = np.partition(cos, len(b) - k, axis=1)[:, len(b) - k, None]
    above, tied = cos > least, cos == least
    open_ = k - above.sum(axis=1, dtype=np.int32)
    row, col = np.nonzero(above | (tied & (np.cumsum(tied, axis=1, dtype=np.int32) <= open_[:, None])))
    value = cos[row, col]
    kept = value > OUT
    return row[kept], col[kept], value[kept]


def _bounded(a: np.ndarray, b: np.ndarray, a4: np.ndarray, b4: np.ndarray, room: np.ndarray, ruled: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same from cosines in single precision: the ``k``-th best of the groups' best ones bounds what can be among the ``k`` best, and only that is computed in full.

    The bound gives way by twice the error of a product and by a step of the rounding. Sources are taken in pieces whose cosines stay in the
    processor's cache, in ``room``; the bound rises from piece to piece, and of a piece only groups whose best one reaches it are read again.
    Rows where very many sources lie on the bound are taken in full. ``b4`` is filled up to whole groups.
    """
    slack = np.float32(2 * (a.shape[1] + 2) * 2.0**-23 + 2e-6)
    tops = np.full((len(a), GROUPS), OUT, np.float32)
    out_row, out_col = np.divmod(ruled, len(b))
    order = np.argsort(out_col, kind="stable")
    out_row, out_col = out_row[order], out_col[order]
    found = []
    for start in range(0, len(b4), room.shape[1]):
        piece = b4[start : start + room.shape[1]]
        cos = np.matmul(a4, piece.T, out=room[: len(a), : len(piece)])
        cos[:, max(0, len(b) - start) :] = OUT
        here = slice(*np.searchsorted(out_col, [start, start + len(piece)]))
        cos[out_row[here], out_col[here] - start] = OUT
        grouped = cos.reshape(len(a), -1, GROUPS)
        best = grouped.max(axis=1)
        np.maximum(tops, best, out=tops)
        bound = np.maximum(np.partition(tops, GROUPS - k, axis=1)[:, GROUPS - k] - slack, np.float32(OUT / 2 - 0.5))
        held, group = np.nonzero(best >= bound[:, None])
        near = grouped[held, :, group]
        at, place = np.nonzero(near >= bound[held, None])
        found.append((held[at], start + place * GROUPS + group[at], near[at, place]))
    row, col, near = (np.concatenate(x) for x in zip(*found, strict=True))
    kept = near >= bound[row]  # that of all pieces
    row, col = row[kept], col[kept]
    full = np.bincount(row, minlength=len(a)) > 16 * k
    out = []
    step = max(1, PAIRS // len(b))
    every = np.flatnonzero(full)
    for start in range(0, len(every), step):
        at = every[start : start + step]
        place = np.full(len(a), -1)
        place[at] = np.arange(len(at))
        mine = place[out_row] >= 0
        r, c, v = _best(a[at], b, place[out_row[mine]] * len(b) + out_col[mine], k)
        out.append((at[r], c, v))
    mine = ~full[row]
    row, col = row[mine], col[mine]
    value = np.clip(np.einsum("ij,ij->i", a[row], b[col]), -1, 1).round(6)
    kept = _first(row, col, value, k)
    out.append((row[kept], col[kept], value[kept]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _top(k: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The ``k`` best sources of every target of one block pair; side 0 are targets, 1 sources, 2 links that rule a pair out."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right, links = (pdf[pdf["side"] == i] for i in range(3))
        right = right.sort_values("page")  # so that ties go to the smaller source
        out = []
        if len(left) and len(right):
            (targets, a), (sources, b) = _units(left), _units(right)
            row, col = pd.Index(targets), pd.Index(sources)
            out_row, out_col = row.get_indexer(links["page"]), col.get_indexer(links["other"])
            out_row, out_col = np.concatenate([out_row, np.arange(len(targets))]), np.concatenate([out_col, col.get_indexer(targets)])
            good = (out_row >= 0) & (out_col >= 0)
            out_row, out_col = out_row[good], out_col[good]
            order = np.argsort(out_row, kind="stable")
            out_row, out_col = out_row[order], out_col[order]
            small = len(b) < 8 * GROUPS or k > GROUPS // 2
            step = max(1, PAIRS // max(1, len(b))) if small else ROWS
            a4 = b4 = room = None
            if not small:
                a4, b4 = a.astype(np.float32), np.zeros((-(-len(b) // GROUPS) * GROUPS, b.shape[1]), np.float32)
                b4[: len(b)] = b
                room = np.empty((ROWS, PIECE), np.float32)
            for start in range(0, len(a) if len(b) else 0, step):
                stop = min(len(a), start + step)
                here = slice(*np.searchsorted(out_row, [start, stop]))
                ruled = (out_row[here] - start) * len(b) + out_col[here]
                at, best, value = _best(a[start:stop], b, ruled, k) if small else _bounded(a[start:stop], b, a4[start:stop], b4, room, ruled, k)
                out.append(pd.DataFrame({"target": targets[start + at], "source": sources[best], "similarity": value}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"target": [], "source": [], "similarity": []}).astype({"target": "int64", "source": "int64", "similarity": "float64"})

    return run


def _blocks(pages: DataFrame, block: int | None = None) -> DataFrame:
    """(l9, blocks): how many blocks a language is dealt to."""
    most = F.floor(F.lit(NUMBERS) / F.greatest(F.lit(1), F.max(F.size("vector"))))
    size = F.lit(block) if block else F.greatest(F.lit(LEAST), F.least(F.greatest(F.lit(BLOCK), F.ceil(F.count("*") / BLOCKS)), most))
    return pages.groupBy(F.col("language").alias("l9")).agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))


def nearest_eligible(pages: DataFrame, links: DataFrame, k: int = 10, block: int | None = None) -> DataFrame:
    """(target, source, rank, similarity): the ``k`` nearest pages of the same language that are neither the target nor link to it.

    Exact, every pair is compared. Pages of a language are dealt to blocks by hash; a task multiplies one block of targets with one block of
    sources in single precision, computes what may be among the best in full, and keeps ``k`` rows a target, which a window merges. A link goes to the one task that could pair its ends, so
    however many links a page has, they are split by their sources. Ties go to the smaller id; a zero vector scores 0.
    Blocks grow with a language of more than ``BLOCKS`` of them, up to ``NUMBERS``, so that copies of a vector and rows found for a target do not.
    """
    counts = _blocks(pages, block)
    dealt = pages.select("page", "language", "vector").join(counts, F.col("language").eqNullSafe(F.col("l9"))).drop("l9")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("page"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other_block")
    none = F.lit(None).cast("bigint").alias("other")
    targets = dealt.select("language", F.col("own").alias("t"), every, "page", "vector").select("language", "t", F.col("other_block").alias("s"), "page", "vector", none, F.lit(0).alias("side"))
    sources = dealt.select("language", F.col("own").alias("s"), every, "page", "vector").select("language", F.col("other_block").alias("t"), "s", "page", "vector", none, F.lit(1).alias("side"))
    place = dealt.select("page", "language", "own")
    ends = links.where("source <> target").select("source", "target").distinct()
    ends = ends.join(place.select(F.col("page").alias("target"), "language", F.col("own").alias("t")), "target").join(place.select(F.col("page").alias("source"), F.col("language").alias("l2"), F.col("own").alias("s")), "source")
    ruled = ends.where(F.col("language").eqNullSafe(F.col("l2"))).select("language", "t", "s", F.col("target").alias("page"), F.lit(None).cast(pages.schema["vector"].dataType).alias("vector"), F.col("source").alias("other"), F.lit(2).alias("side"))
    found = targets.unionByName(sources).unionByName(ruled).groupBy("language", "t", "s").applyInPandas(_top(k), FOUND)
    rank = F.row_number().over(Window.partitionBy("target").orderBy(F.col("similarity").desc(), "source"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("target", "source", F.col("rank").cast("int").alias("rank"), "similarity")


def link_cosines(pages: DataFrame, links: DataFrame) -> DataFrame:
    """source, target, language, similarity of the distinct links between two pages of one language."""
    a = pages.select(F.col("page").alias("source"), "language", F.col("vector").alias("va"))
    b = pages.select(F.col("page").alias("target"), F.col("language").alias("lb"), F.col("vector").alias("vb"))
    pairs = links.where("source <> target").select("source", "target").distinct().join(a, "source").join(b, "target").where(F.col("language").eqNullSafe(F.col("lb")))
    return pairs.select("source", "target", "language", F.round(cosine("va", "vb"), 6).alias("similarity"))


def target_facts(pages: DataFrame, links: DataFrame, candidates: DataFrame) -> DataFrame:
    """target, eligible, linked, linked_nearer: pages it could take, same-language pages that link to it, and how many of those are nearer than its last candidate."""
    pool = pages.groupBy("language").agg(F.count("*").alias("pool"))
    cosines = link_cosines(pages, links)
    last = candidates.groupBy("target").agg(F.min("similarity").alias("last"))
    near = cosines.join(last, "target", "left").groupBy("target").agg(F.count("*").alias("linked"), F.count_if(F.col("similarity") > F.col("last")).alias("nearer"))
    rows = pages.select(F.col("page").alias("target"), "language").join(pool.withColumnRenamed("language", "l2"), F.col("language").eqNullSafe(F.col("l2"))).join(near, "target", "left")
    linked = F.coalesce("linked", F.lit(0))
    return rows.select("target", (F.col("pool") - 1 - linked).alias("eligible"), linked.alias("linked"), F.coalesce("nearer", F.lit(0)).alias("linked_nearer"))


def pillar_floors(cosines: DataFrame, candidates: DataFrame, quantile: float, least: int) -> DataFrame:
    """(language, floor, basis, links): per language with ``least`` links or more, and one row without a language for all others.

    That row's floor is the quantile over every link if they are enough, else over the candidates; without either there is none.
    """
    own = quantiles(cosines, "similarity", (quantile,), ["language"]).where((F.col("n") >= least) & F.col("language").isNotNull())
    own = own.select("language", F.col("q0").alias("floor"), F.lit("existing_links").alias("basis"), F.col("n").alias("links"))
    every = quantiles(cosines, "similarity", (quantile,)).select("n", F.col("q0").alias("a"))
    pairs = quantiles(candidates, "similarity", (quantile,)).select(F.col("n").alias("m"), F.col("q0").alias("b"))
    both = every.crossJoin(pairs)  # one row each
    enough = F.coalesce(F.col("n") >= least, F.lit(False))
    rest = both.select(
        F.lit(None).cast("string").alias("language"), F.when(enough, F.col("a")).otherwise(F.col("b")).alias("floor"), F.when(enough, "existing_links").otherwise("candidate_pairs").alias("basis"),
        F.coalesce("n", F.lit(0)).alias("links"),
    )
    return own.unionByName(rest.where("floor is not null"))


def pillar_pairs(pages: DataFrame, links: DataFrame, candidates: DataFrame, pillars: DataFrame, quantile: float = 0.25, least: int = 50) -> DataFrame:
    """(target, source, similarity): for every hub's pillar the pages of its hub and language that don't link to it, are no candidates yet and reach the floor.

    ``pillars`` has hub and page. A pillar is one row per hub, so the join makes one row per page of a hub.
    """
    floors = materialize(pillar_floors(materialize(link_cosines(pages, links), "link-cosines"), candidates, quantile, least), "pillar-floors")
    t = pages.join(pillars.select("page", F.col("hub").alias("h")), "page").where("hub = h")
    t = t.select(F.col("page").alias("target"), F.col("language").alias("lt"), F.col("hub").alias("ht"), F.col("vector").alias("vt"))
    found = pages.select(F.col("page").alias("source"), "language", "hub", F.col("vector").alias("vs")).join(t, F.col("language").eqNullSafe(F.col("lt")) & (F.col("hub") == F.col("ht"))).where("source <> target")
    taken = links.select("source", "target").union(candidates.select("source", "target")).distinct()
    found = found.join(taken, ["source", "target"], "left_anti").withColumn("similarity", F.round(cosine("vs", "vt"), 6))
    own = floors.where("language is not null").select(F.col("language").alias("l1"), F.col("floor").alias("own"))
    rest = floors.where("language is null").agg(F.max("floor")).scalar()
    held = found.join(own, F.col("language") == F.col("l1"), "left").where(F.col("similarity") >= F.coalesce("own", rest))
    return held.select("target", "source", "similarity")


def pair_pool(candidates: DataFrame, bridges: DataFrame) -> DataFrame:
    """(target, source, similarity, bridge): candidates, then bridge pairs that are none of them."""
    own = candidates.select("target", "source", "similarity", F.lit(False).alias("bridge"))
    more = bridges.groupBy("target", "source").agg(F.max("similarity").alias("similarity")).join(candidates.select("target", "source"), ["target", "source"], "left_anti")
    return own.unionByName(more.withColumn("bridge", F.lit(True)))


def knn_graph(pages: DataFrame, k: int = 10) -> DataFrame:
    """(a, b, weight) with a < b: each page with its ``k`` nearest ones of any language, the greater similarity where both found the other, positive ones only."""
    alone = pages.select("page", F.lit("").alias("language"), "vector")
    none = pages.select(F.col("page").alias("source"), F.col("page").alias("target")).limit(0)
    near = nearest_eligible(alone, none, k)
    ends = near.where("similarity > 0").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), "similarity")
    return ends.groupBy("a", "b").agg(F.max("similarity").alias("weight"))
