"""Link graph operators on (source, position, target, anchor) and page tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.vector import dot, norm
from linkloom.plans.scratch import materialize, release


def crawled_edges(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Distinct (source, target) between crawled pages, self-links out."""
    known = pages.select("page")
    pairs = links.where("source <> target").select("source", "target").distinct()
    return pairs.join(known.withColumnRenamed("page", "target"), "target", "left_semi").join(known.withColumnRenamed("page", "source"), "source", "left_semi")


def placeholders(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Link targets that were never crawled, with the number of links to them."""
    missing = links.join(pages.select(F.col("page").alias("target")), "target", "left_anti")
    return missing.groupBy("target").agg(F.count("*").alias("inlinks"))


def structure(links: DataFrame, pages: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """page, distinct crawled in- and out-neighbours; zero where there are none. ``edges`` are the crawled ones where they are stored."""
    edges = crawled_edges(links, pages) if edges is None else edges
    into = edges.groupBy(F.col("target").alias("page")).agg(F.count("*").alias("inbound"))
    out = edges.groupBy(F.col("source").alias("page")).agg(F.count("*").alias("outbound"))
    joined = pages.select("page").join(into, "page", "left").join(out, "page", "left")
    return joined.select("page", F.coalesce("inbound", F.lit(0)).alias("inbound"), F.coalesce("outbound", F.lit(0)).alias("outbound"))


def orphan_label(inbound: Column, template: Column) -> Column:
    """linked, template_only or orphan."""
    return F.when(inbound > 0, "linked").when(template > 0, "template_only").otherwise("orphan")


def inbound_anchors(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Anchor texts a page receives, per language of the linking page."""
    languages = pages.select(F.col("page").alias("source"), "language")
    return links.join(languages, "source").groupBy("target", "language", "anchor").agg(F.count("*").alias("links"))


def crawl_depth(links: DataFrame, pages: DataFrame, roots: list[int], together: int = 16, edges: DataFrame | None = None) -> DataFrame:
    """page, depth: clicks from the nearest of ``roots``, null where out of reach. One frontier join per level, until it is empty.

    A level joins the pages found last with the edges; the tables of ``together`` levels become one, so that plans stay
    short however deep the site is. ``edges`` are the crawled ones where they are stored.
    """
    edges = materialize(crawled_edges(links, pages), "depth-edges") if edges is None else edges
    front = reached = materialize(pages.where(F.col("page").isin(roots)).select("page", F.lit(0).alias("depth")), "depth")
    level = 0
    while True:
        level += 1
        fresh = edges.join(front, edges.source == front.page).select(F.col("target").alias("page")).distinct().join(reached, "page", "left_anti")
        front = materialize(fresh.withColumn("depth", F.lit(level)), "depth")
        if front.isEmpty():
            break
        reached = reached.unionByName(front)
        if level % together == 0:
            parts, reached = reached, materialize(reached, "depth")
            front = reached.where(F.col("depth") == level)
            release(parts)
    return pages.select("page").join(reached, "page", "left")


#: Rounds of PageRank that one job walks; targets of a page that lie in one row.
TOGETHER, TARGETS = 8, 1024


def _spread(start: DataFrame, near: DataFrame, by: list[str], rounds: int, damping: float) -> DataFrame:
    """(by, page, y1, ..., y``rounds``): ``start`` (by, page, y0) moved along the links once, twice and so on, without any teleport.

    A round is one join with the links and one sum per page. Every page has a row of ``near`` without targets, which carries its
    earlier values on, so a round refers to the one before once and a chain of them stays one plan of that length.
    """
    now, held = start, []
    for i in range(1, rounds + 1):
        row = lambda page, y, old: F.struct(page.alias("p"), y.alias("y"), *[c.alias(n) for n, c in zip(held, old, strict=True)])
        none = [F.lit(None).cast("double")] * len(held)
        own = F.array(row(F.col("page"), F.lit(0.0), [F.col(n) for n in held]))
        given = F.transform("targets", lambda t: row(t, damping * F.col(f"y{i - 1}") * F.col("share"), none))
        sent = now.join(near, [*by, "page"]).select(*by, F.explode(F.when(F.col("targets").isNull(), own).otherwise(given)).alias("x")).select(*by, "x.*")
        now = sent.groupBy(*by, F.col("p").alias("page")).agg(F.sum("y").alias(f"y{i}"), *[F.sum(n).alias(n) for n in held])
        held.append(f"y{i}")
    return now.select(*by, "page", *held)


def pagerank(links: DataFrame, pages: DataFrame, damping: float = 0.85, steps: int = 100, tolerance: float | None = 1e-10, by: tuple[str, ...] = (), together: int = TOGETHER) -> DataFrame:
    """page, rank from 1/n until a round moves less than ``tolerance`` in all (None: exactly ``steps`` rounds).

    Placeholders take part, dangling mass is spread evenly, repeated links are one vote. ``together`` rounds are one job: what is
    spread evenly in a round is a multiple of the same vector, so the job only moves ranks along the links, and the multiples
    follow from the sums of its rounds afterwards. The tolerance is asked once a job. With ``by``, columns of both tables
    that are not null, every group is a graph of its own, and all of them walk together until none moves.
    """
    by = list(by)
    edges = links.where("source <> target").select(*by, "source", "target").distinct()
    out = edges.groupBy(*by, "source").agg(F.count("*").alias("out"))
    votes = edges.join(out, [*by, "source"]).withColumn("part", F.pmod(F.xxhash64("target"), F.ceil(F.col("out") / TARGETS)))
    listed = votes.groupBy(*by, F.col("source").alias("page"), "part").agg(F.collect_list("target").alias("targets"), F.max(1 / F.col("out")).alias("share")).drop("part")
    listed = materialize(listed, "rank-votes")
    nodes = materialize(pages.select(*by, "page").union(listed.select(*by, F.explode("targets"))).union(listed.select(*by, "page")).distinct(), "rank-nodes")
    near = materialize(listed.unionByName(nodes.select(*by, "page", F.lit(None).cast(listed.schema["targets"].dataType).alias("targets"), F.lit(0.0).alias("share"))), "rank-links")
    sizes = nodes.groupBy(*by).agg(F.count("*").alias("n"))
    even = nodes.join(sizes, by) if by else nodes.crossJoin(sizes)  # one row on the right
    even = even.select(*by, "page", (F.lit(1.0) / F.col("n")).alias("y0"))
    m = max(1, min(together, steps))
    first = materialize(even.join(_spread(even, near, by, m, damping), [*by, "page"]), "rank-base")  # the even vector's rounds are those of the first job, too
    base = first.select(*by, "page", *[F.col(f"y{i}").alias(f"v{i}") for i in range(m)])
    masses = materialize(base.groupBy(*by).agg(*[F.sum(f"v{i}").alias(f"m{i}") for i in range(m)]), "rank-masses")

    def after(moved: DataFrame, rounds: int) -> DataFrame:
        """(by, page, y0, before): ranks after the rounds of ``moved``, and those of the round before."""
        shares = moved.groupBy(*by).agg(*[F.sum(f"y{i}").alias(f"e{i}") for i in range(1, rounds + 1)])
        shares = shares.join(masses, by) if by else shares.crossJoin(masses)  # one row each
        for i in range(1, rounds + 1):  # whatever a round does not move along the links it spreads evenly
            kept = F.col(f"e{i}") + sum((F.col(f"c{k}") * F.col(f"m{i - k}") for k in range(1, i)), F.lit(0.0))
            shares = shares.withColumn(f"c{i}", 1 - kept)
        shares = materialize(shares.select(*by, *[f"c{i}" for i in range(1, rounds + 1)]), "rank-shares")
        whole = moved.join(base, [*by, "page"])
        whole = whole.join(shares, by) if by else whole.crossJoin(shares)  # one row on the right
        at = lambda i: F.col(f"y{i}") + sum((F.col(f"c{k}") * F.col(f"v{i - k}") for k in range(1, i + 1)), F.lit(0.0))
        return whole.select(*by, "page", at(rounds).alias("y0"), (at(rounds - 1) if rounds > 1 else F.lit(None).cast("double")).alias("before"))

    rank, done, old = even, 0, None
    while done < steps:
        rounds = min(m, steps - done)
        moved = materialize(_spread(rank.select(*by, "page", "y0"), near, by, rounds, damping), "rank-moved") if done else first.drop("y0")
        rank, done = after(moved, rounds), done + rounds
        if old is not None:
            release(old)
        old = moved if done > rounds else None
        if tolerance is not None and rounds > 1:
            change = rank.groupBy(*by).agg(F.sum(F.abs(F.col("y0") - F.col("before"))).alias("moved"))
            if (change.agg(F.max("moved")).first()[0] or 0.0) < tolerance:
                break
    return rank.select(*by, "page", F.col("y0").alias("rank"))


def _over_budget(counts: DataFrame, budget: int) -> DataFrame:
    """The rows of ``counts`` (keyword, k) to drop, most shared first and then by keyword, until ``budget`` pairs hold the rest."""
    sizes = sorted(((r["k"], r["n"]) for r in counts.groupBy("k").agg(F.count("*").alias("n")).toLocalIterator()), reverse=True)
    pairs = sum(k * (k - 1) // 2 * n for k, n in sizes)
    for k, n in sizes:
        each = k * (k - 1) // 2
        if pairs <= budget:
            return counts.where(F.col("k") > k)
        if pairs - each * n <= budget:
            most = -(-(pairs - budget) // each)  # of this size, the first ones by keyword
            if most == n:
                return counts.where(F.col("k") >= k)
            ranked = counts.where(F.col("k") == k).select("keyword").orderBy("keyword").rdd.zipWithIndex()
            first_kept = ranked.filter(lambda x: x[1] == most).first()[0]["keyword"]
            return counts.where((F.col("k") > k) | ((F.col("k") == k) & (F.col("keyword") < F.lit(first_kept))))
        pairs -= each * n
    return counts.limit(0)


#: Pages of a keyword in one list; rows, and pairs of pages, of a task.
HOT, ROWS, PAIRS = 1024, 4_000_000, 4_000_000


def keyword_projection(rows: DataFrame, budget: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(a, b, shared): pages that share keywords; and (keyword, k): the keywords left out, with their pages.

    Without ``budget`` none is left out. With it, while keywords make more pairs of pages than
    that, the most shared is left out, ties by keyword.

    A keyword's pages are a list, and each of them takes the greater ones along to where its pairs are counted, so a pair
    becomes a row in the task that counts it. Tasks are as many as rows and pairs need; pages of very many pairs are dealt by both ends.
    """
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = lambda n, each: max(least, -(-int(n or 0) // each))
    part = rows.where("page is not null and keyword is not null").select("page", "keyword")
    part = materialize(part.repartition(tasks(part.count(), ROWS), "keyword", "page").distinct(), "projection-part")
    counts = materialize(part.groupBy("keyword").agg(F.count("*").alias("k")), "projection-keywords")
    dropped = counts.limit(0) if budget is None else materialize(_over_budget(counts, budget), "projection-dropped")
    part, counts = (part, counts) if budget is None else (x.join(dropped, "keyword", "left_anti") for x in (part, counts))
    size = counts.agg(F.sum("k").alias("rows"), F.sum(F.expr("k * cast(k - 1 as double) / 2")).alias("pairs"), F.max("k").alias("k")).first()
    # The pages of a hot keyword are dealt to several lists, and each of them meets every other.
    hot = counts.where(F.col("k") > HOT).select("keyword", F.ceil(F.col("k") / HOT).cast("int").alias("parts"))
    dealt = part.join(hot, "keyword", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("page"), F.col("parts")).cast("int")).repartition(tasks(size["rows"], ROWS), "keyword", "part")
    lists = dealt.groupBy("keyword", "part", "parts").agg(F.sort_array(F.collect_list("page")).alias("pages"))
    after = lists.where("parts = 1").select("pages", F.posexplode("pages").alias("at", "a")).select("a", F.expr("slice(pages, at + 2, size(pages))").alias("after"))
    if (size["k"] or 0) > HOT:
        one = lists.where("parts > 1").select("keyword", "pages", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        other = lists.where("parts > 1").select("keyword", "part", F.col("pages").alias("others"))
        met = one.repartition(tasks(size["pairs"], PAIRS), "keyword", "part").join(other, ["keyword", "part"]).select(F.explode("pages").alias("a"), "others")
        after = after.unionByName(met.select("a", F.filter("others", lambda b: b > F.col("a")).alias("after")))
    after = after.where("size(after) > 0")
    count = lambda x, *by: x.repartition(tasks(size["pairs"], PAIRS), *by).select("a", F.explode("after").alias("b")).groupBy("a", "b").agg(F.count("*").alias("shared"))
    most = part.groupBy("page").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most * (size["k"] or 0) <= PAIRS:
        return count(after, "a"), dropped
    wide = part.join(counts, "keyword").groupBy(F.col("page").alias("a")).agg(F.sum("k").alias("pairs")).where(F.col("pairs") > PAIRS).select("a")
    wide = materialize(wide, "projection-wide")
    spread = after.join(wide, "a", "left_semi").select("a", F.explode("after").alias("b")).select("a", F.array("b").alias("after"), "b")
    return count(after.join(wide, "a", "left_anti"), "a").unionByName(count(spread, "a", "b")), dropped


def unit_vector(vector: str) -> Column:
    """The vector over its length; a zero vector stays. The length is bound to a lambda's variable, since inside a lambda Spark would compute it for every element."""
    bound = F.array(F.struct(F.col(vector).alias("v"), norm(vector).alias("size")))
    return F.get(F.transform(bound, lambda b: F.when(b["size"] > 0, F.transform(b["v"], lambda x: x / b["size"])).otherwise(b["v"])), F.lit(0))


def _hub_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hub, at, x, n): sums of the unit vectors of a partition, per hub and place, given out when ``HUBS`` hubs are held and at the end."""
    held: dict[int, tuple[np.ndarray, int]] = {}

    def rows() -> pa.RecordBatch:
        hubs, width = list(held), [len(x) for x, _ in held.values()]
        out = np.repeat(np.array(hubs, np.int32), width), np.concatenate([np.arange(w, dtype=np.int32) for w in width]), np.concatenate([x for x, _ in held.values()]), np.repeat(np.array([n for _, n in held.values()], np.int64), width)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["hub", "at", "x", "n"])

    for batch in batches:
        hub, lists = batch.column("hub").to_numpy(), batch.column("vector")
        x = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(hub), -1)
        size = np.linalg.norm(x, axis=1)
        x = x / np.where(size > 0, size, 1)[:, None]
        for h in np.unique(hub).tolist():
            own = x[hub == h]
            total, n = held.get(h, (np.zeros(x.shape[1]), 0))
            held[h] = (total + own.sum(axis=0), n + len(own))
            if len(held) >= HUBS:
                yield rows()
    if held:
        yield rows()


#: Hubs whose sums a task holds at most.
HUBS = 4096


def hub_centroids(pages: DataFrame) -> DataFrame:
    """hub, centroid: the mean of the unit vectors of every hub's pages, as a unit vector. A task adds up its pages; one row per task, hub and place moves."""
    rows = pages.where("hub >= 0 and vector is not null").select(F.col("hub").cast("int").alias("hub"), F.col("vector").cast("array<double>").alias("vector"))
    parts = rows.mapInArrow(_hub_sums, "hub int, at int, x double, n bigint")
    means = parts.groupBy("hub", "at").agg((F.sum("x") / F.sum("n")).alias("m"))
    listed = means.groupBy("hub").agg(F.sort_array(F.collect_list(F.struct("at", "m"))).alias("c"))
    return listed.select("hub", F.transform("c", lambda x: x["m"]).alias("c")).select("hub", unit_vector("c").alias("centroid"))


def hub_pillars(pages: DataFrame, ranks: DataFrame | None = None, least: int = 1) -> DataFrame:
    """hub, page, cosine: the page nearest its hub's centroid, cosines rounded to 9 places; then the higher PageRank, then the smaller page.

    Hubs of fewer than ``least`` pages have none. One row a page is compared within its group by an aggregate.
    """
    size = pages.where("hub >= 0").groupBy("hub").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    near = pages.where("hub >= 0").join(size, "hub").join(hub_centroids(pages), "hub")
    near = near.select("hub", "page", F.round(dot(unit_vector("vector"), "centroid"), 9).alias("cosine"))
    near = near.join(ranks.select("page", "rank"), "page", "left") if ranks is not None else near.withColumn("rank", F.lit(0.0))
    best = near.groupBy("hub").agg(F.max(F.struct("cosine", F.coalesce("rank", F.lit(0.0)).alias("rank"), (-F.col("page")).alias("p"))).alias("b"))
    return best.select("hub", (-F.col("b.p")).alias("page"), F.col("b.cosine").alias("cosine"))
