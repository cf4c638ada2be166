"""Near-duplicate groups by SuperMinHash, banding, exact verification and union-find.

Texts are lower-cased in A-Z and compared as sets of distinct five-word shingles; two are linked where
``100 * |intersection| >= 75 * |union|``. Steps:

1. Sketch: every text becomes its shingle count, a 128-bit digest of its sorted shingle hashes, band keys and one byte
   per signature position. Equal digests are copies: one node each, whatever the number of copies.
2. Star candidates: in every band bucket each node pairs with the smallest node of the bucket, so a bucket of k nodes
   gives k - 1 pairs. Pairs are dropped where sizes or signatures rule a link out (six deviations below 0.75), the rest
   is verified on full shingle sets, and components are found.
3. Mixed buckets: a bucket that holds one component needs nothing more. In the others, signatures are compared between
   components in pairs of blocks of bounded size, and nodes with plausible partners form families; buckets over ``HOT``
   nodes are split by a second band first. Within a family, pairs of blocks compare full sets and report the links that
   join components. Either way a task reports a forest, never all its pairs.

With 32 bands of 4 rows a pair at 0.75 shares no band with probability 5e-6; no other step loses a link. Shingles are
64-bit hashes (two of n differing shingles of a pair collide with probability n * n / 2**65).

Defined cases: null, empty and blank texts have an empty set, are linked with nothing and form a component of their
own; repeated rows get equal results; a component's id is its smallest doc_id; a null doc_id is its own component unless
its text has copies or links; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.arrow import slices
from linkloom.llm.superminhash import _mix, band_keys, signatures
from linkloom.operators.components import connected_components
from linkloom.plans import bitmap
from linkloom.plans.scratch import materialize

WIDTH, PERCENT, SIZE, ROWS = 5, 75, 128, 4
#: Six standard deviations of a signature estimate below the threshold.
PLAUSIBLE = int(SIZE * (PERCENT / 100 - 6 * (PERCENT / 100 * (1 - PERCENT / 100) / SIZE) ** 0.5))
#: Texts in a block when signatures are compared, and when full sets are; most texts of a bucket; shingles in a block.
MARKS, BLOCK, HOT, SHINGLES = 1024, 256, 4096, 400_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(texts: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text; A-Z lower-cased, words cut at space and U+0009 to U+000D."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = parts.flatten()
    offsets = parts.offsets.to_numpy().astype(np.int64)
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    coded = flat.dictionary_encode()
    known = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
    hashed = known[coded.indices.to_numpy()] if len(flat) else np.zeros(0, dtype=np.uint64)
    # Leading and trailing white space leaves empty pieces; drop them and move the offsets along.
    kept_before = np.concatenate([[0], np.cumsum(real)])
    hashed, offsets = hashed[real], kept_before[offsets - offsets[0]]
    rolled = hashed.copy()
    for k in range(1, width):
        rolled[: len(rolled) - k] = rolled[: len(rolled) - k] * _STEP + hashed[k:] if k < len(rolled) else rolled[:0]
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        n = b - a
        if n >= width:
            out.append(np.unique(_mix(rolled[a : b - width + 1])))
        elif n:
            whole = np.array([n], dtype=np.uint64)  # arrays wrap around silently
            for x in hashed[a:b]:
                whole = whole * _STEP + x
            out.append(_mix(whole))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


SKETCH = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("bytes", pa.binary())])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            sets = shingle_hashes(batch.column("text"))
            counts = np.array([len(s) for s in sets], dtype=np.int64)
            sig = signatures(np.concatenate(sets), np.repeat(np.arange(len(sets)), counts), len(sets), SIZE)
            low, keys = (sig & np.uint64(0xFF)).astype(np.uint8), band_keys(sig, ROWS)
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(counts),
                    pa.array(digests, pa.binary()),
                    pa.array([k if n else None for k, n in zip(keys, counts, strict=True)], pa.list_(pa.int64())),
                    pa.array([x.tobytes() for x in low], pa.binary()),
                ],
                schema=SKETCH,
            )


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            sets = shingle_hashes(batch.column("text"))
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            arrays = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), arrays], names=["digest", "shingles"])


def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, SIZE) for c in ("sa", "sb"))
            same = (a == b).sum(axis=1)
            yield batch.select(["a", "b"]).filter(pa.array(same >= PLAUSIBLE))


def _near_size(n: str, m: str):
    """Sizes that allow a link."""
    return (100 * F.least(n, m)) >= (PERCENT * F.greatest(n, m))


def _full_sets_of(ends: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, shingles) of the given nodes.

    Texts are read a second time, and only those whose bit in a bitmap of wanted ids is set are cut into shingles.
    """
    wanted = materialize(ends.distinct().join(nodes.select("node", "digest", "doc_id"), "node"), "near-wanted")
    read = docs.select("doc_id", "text").where(F.col("doc_id").isNull() | bitmap.may_contain(wanted, "doc_id", F.col("doc_id")))
    sets = read.select("text").mapInArrow(_full_sets, "digest binary, shingles array<bigint>")
    return materialize(sets.join(wanted.select("digest", "node"), "digest").dropDuplicates(["node"]).select("node", "shingles"), "near-sets")


def _verify(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that are linked, on full shingle sets."""
    sets = _full_sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")), nodes, docs)
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    counted = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("i"), (F.size("x") + F.size("y")).alias("s"))
    return counted.where(100 * F.col("i") >= PERCENT * (F.col("s") - F.col("i"))).select("a", "b")


class _Forest:
    """Union-find over small integers."""

    def __init__(self, size: int) -> None:
        self.parent = list(range(size))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def _grouped(function):
    """Runs ``function`` on every run of equal (group, bi, bj) of a sorted partition, as a dict of arrays.

    Thousands of small groups share a batch, so a group costs no frame of its own; a group is held whole, and groups are
    bounded.
    """
    keys = ["group", "bi", "bj"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            if not len(batch):
                continue
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if (held[keys].iloc[0] == held[keys].iloc[-1]).all():
                continue  # the group goes on
            found, rest = _runs(held, function, last=False)
            held = rest
            yield _edges(found)
        if held is not None:
            yield _edges(_runs(held, function, last=True)[0])

    def _runs(pdf: pd.DataFrame, function, last: bool) -> tuple[list[tuple[int, int]], pd.DataFrame]:
        k = pdf[keys].to_numpy()
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), *([len(pdf)] if last else [])]
        arrays, found = {c: pdf[c].to_numpy() for c in pdf.columns}, []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a > 1:
                found += function({c: x[a:b] for c, x in arrays.items()})
        return found, pdf.iloc[cuts[-1] :].reset_index(drop=True)

    return run


def _in_groups(rows: DataFrame, function) -> DataFrame:
    """(a, b) from ``function`` on every (group, bi, bj); the groups are dealt by hash, to as many tasks as AQE finds fit."""
    dealt = rows.repartition("group", "bi", "bj").sortWithinPartitions("group", "bi", "bj")
    return dealt.mapInPandas(_grouped(function), "a bigint, b bigint")


def _edges(found: list[tuple[int, int]]) -> pd.DataFrame:
    a = np.array(found, dtype=np.int64).reshape(-1, 2)
    return pd.DataFrame({"a": a.min(axis=1), "b": a.max(axis=1)})


def _families(rows: dict[str, np.ndarray]) -> list[tuple[int, int]]:
    """Of one block pair, edges that join plausible partners of different components: a forest, not all pairs.

    What holds together within either block is left to the group of that block alone.
    """
    component = rows["component"]
    if (component == component[0]).all():
        return []
    node, first = np.unique(rows["node"], return_index=True)  # a bucket reached twice lists a node twice
    n, component, own = (rows[c][first] for c in ("n", "component", "own"))
    i, j = rows["bi"][0], rows["bj"][0]
    sig = np.frombuffer(b"".join(rows["bytes"][first]), dtype=np.uint8).reshape(-1, SIZE)
    same = np.stack([(sig == x).sum(axis=1, dtype=np.uint8) for x in sig])
    fits = (same >= PLAUSIBLE) & (component[:, None] != component[None, :])
    fits &= 100 * np.minimum(n[:, None], n[None, :]) >= PERCENT * np.maximum(n[:, None], n[None, :])
    across = own[:, None] != own[None, :]
    return [(int(node[x]), int(node[y])) for x, y in _spanning(fits & ~across, fits & across, i == j)]


def _spanning(inner: np.ndarray, cross: np.ndarray, tell_inner: bool) -> list[tuple[int, int]]:
    """A spanning forest of two symmetric relations that takes an edge of ``cross`` only where ``inner`` does not lead."""
    seen, out = ~(inner.any(axis=1) | cross.any(axis=1)), []
    for start in np.flatnonzero(~seen).tolist():
        if seen[start]:
            continue
        seen[start], stack, reach = True, [start], np.full(len(seen), -1)
        while stack:
            x = stack.pop()
            new = np.flatnonzero(inner[x] & ~seen).tolist()
            seen[new] = True
            stack += new
            if tell_inner:
                out += [(x, y) for y in new]
            reach[cross[x] & ~seen & (reach < 0)] = x
            if not stack and len(left := np.flatnonzero((reach >= 0) & ~seen)):
                y = int(left[0])
                out.append((int(reach[y]), y))
                seen[y] = True
                stack.append(y)
    return out


def _exact_links(rows_of: dict[str, np.ndarray]) -> list[tuple[int, int]]:
    """Of one block pair, links on full sets that join different components: a forest over the components."""
    i, j = rows_of["bi"][0], rows_of["bj"][0]
    node, component, own = (rows_of[c] for c in ("node", "component", "own"))
    if (component == component[0]).all():
        return []
    sets = [np.asarray(x) for x in rows_of["shingles"]]
    n = np.array([len(x) for x in sets])
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    rows = np.repeat(np.arange(len(sets)), n)
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    common, step = np.zeros((len(sets), len(sets)), dtype=np.float32), max(1, (4 << 20) // len(sets))
    for start in range(0, len(values), step):
        a, b = np.searchsorted(column, (start, start + step))
        part = np.zeros((len(sets), min(step, len(values) - start)), dtype=np.float32)
        part[rows[a:b], column[a:b] - start] = 1
        common += part @ part.T
    linked = 100 * common >= PERCENT * (n[:, None] + n[None, :] - common)
    linked &= component[:, None] != component[None, :]
    linked &= (own[:, None] == i) & (own[None, :] == j)
    names, place = np.unique(component, return_inverse=True)
    forest = _Forest(len(names))
    return [(int(node[x]), int(node[y])) for x, y in np.argwhere(linked).tolist() if forest.join(int(place[x]), int(place[y]))]


def _block_pairs(rows: DataFrame, count) -> DataFrame:
    """Deals the nodes of a group to ``count`` blocks by hash, and every node to the pairs its block is in."""
    dealt = rows.withColumn("_count", count.cast("int")).withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), F.col("_count")).cast("int"))
    pair = lambda x: F.struct(F.least(x, F.col("own")).alias("bi"), F.greatest(x, F.col("own")).alias("bj"))
    others = F.transform(F.sequence(F.lit(0), F.col("_count") - 1), pair)
    return dealt.withColumn("pair", F.explode(others)).select(*rows.columns, "own", "pair.bi", "pair.bj")


def _mixed(rows: DataFrame, where: DataFrame) -> DataFrame:
    """The rows (bucket, node) of buckets that hold more than one component, with component and bucket size."""
    labelled = rows.join(where, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = labelled.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("k"))
    return labelled.join(mixed.where("lo <> hi").select("bucket", "k"), "bucket")


def _families_of(rows: DataFrame, nodes: DataFrame, where: DataFrame) -> DataFrame:
    """(node, family, component): nodes with plausible partners in other components, by connected families."""
    mixed = _mixed(rows, where)
    hot = mixed.where(F.col("k") > HOT).join(nodes.select("node", "bands"), "node")
    hot = hot.select("node", "bucket", F.array_position("bands", F.col("bucket")).alias("at"), F.posexplode("bands").alias("p", "second"))
    # A pair that shares two bands meets under the pair of bands; 0.9999 of the linked ones share two or more.
    hot = hot.where("p >= at").select("node", F.xxhash64("bucket", "second").alias("bucket"))
    cold = mixed.where(F.col("k") <= HOT).select("node", "bucket", "component", "k")
    dealt = cold.unionByName(_mixed(hot, where).select("node", "bucket", "component", "k"))
    blocks = _block_pairs(dealt.withColumnRenamed("bucket", "group"), F.ceil(F.col("k") / MARKS)).join(nodes.select("node", "n", "bytes"), "node")
    edges = materialize(_in_groups(blocks, _families).distinct(), "near-plausible")
    families = connected_components(edges, "a", "b").withColumnRenamed("component", "family")
    return materialize(families.join(where, "node", "left").withColumn("component", F.coalesce("component", "node")), "near-families")


def _links_between(families: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links between components within families; blocks are bounded in nodes and in shingles."""
    sets = _full_sets_of(families.select("node"), nodes, docs)
    sized = families.join(nodes.select("node", "n"), "node")
    total = sized.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / SHINGLES)).alias("count"))
    dealt = families.join(total, "family").withColumnRenamed("family", "group")
    return _in_groups(_block_pairs(dealt, F.col("count")).drop("count").join(sets, "node"), _exact_links)


def groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    sketch = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_sketch, "doc_id bigint, n bigint, digest binary, bands array<bigint>, bytes binary"), "near-sketch")
    one = sketch.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands"), F.any_value("bytes").alias("bytes"))
    nodes = materialize(one.withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    rows = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    first = rows.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("p"), F.count("*").alias("k")).where("k > 1").select("bucket", "p.node", F.col("p.n").alias("m"))
    shared = rows.join(first.select("bucket", F.col("node").alias("a"), "m"), "bucket")
    members = materialize(shared.select("node", "bucket", "a", "n", "m"), "near-members")
    stars = members.where("a <> node").where(_near_size("n", "m")).select("a", F.col("node").alias("b")).distinct()
    marks = nodes.select("node", "bytes")
    marked = stars.join(marks.select(F.col("node").alias("a"), F.col("bytes").alias("sa")), "a").join(marks.select(F.col("node").alias("b"), F.col("bytes").alias("sb")), "b")
    tried = materialize(marked.select("a", "b", "sa", "sb").mapInArrow(_plausible, "a bigint, b bigint"), "near-pairs")
    links = materialize(_verify(tried, nodes, docs), "near-links")
    where = materialize(connected_components(links, "a", "b"), "near-where")
    buckets = members.select("node", "bucket")
    families = _families_of(buckets, nodes, where)
    if not families.isEmpty():
        links = links.unionByName(_links_between(families, nodes, docs))
        where = materialize(connected_components(links, "a", "b"), "near-where")
    labelled = nodes.select("node", "digest", "doc_id").join(where, "node", "left").withColumn("component", F.coalesce("component", "node"))
    labelled = labelled.select("digest", "component", "doc_id")
    smallest = labelled.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_digest = labelled.join(smallest, "component").select("digest", "component_id")
    out = sketch.select("doc_id", "n", "digest").join(by_digest, "digest", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document stays: one id per group. Only ids of dropped documents move."""
    dropped = materialize(groups(docs).where("not kept").select("doc_id").distinct(), "near-dropped")
    return bitmap.without(docs, dropped, "doc_id")
