"""Tables that stages leave in files, read with the checks that their readers rely on; what does not hold is refused, with how many rows.

A check is one aggregation over the columns that it names; rows never reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Refused(ValueError):
    """A table that breaks what its readers rely on."""


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def unique(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``rows``, refused if a key is null or comes twice."""
    per = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    lost = " or ".join(f"`{k}` is null" for k in keys)
    bad = per.agg(F.count_if(F.col("n") > 1).alias("twice"), F.coalesce(F.sum(F.when(F.expr(lost), F.col("n"))), F.lit(0)).alias("null")).first()
    if bad["twice"] or bad["null"]:
        raise Refused(f"{name}: {bad['twice']} keys {keys} come twice, {bad['null']} rows lack one")
    return rows


def ranked_pairs(spark: SparkSession, path: str, tenant: str) -> tuple[DataFrame, str]:
    """The ranked pairs of a tenant and their scorer; pairs of several scorers or of another tenant, and pairs that come twice, are refused."""
    rows = spark.read.parquet(path)
    seen = rows.agg(F.count("*").alias("n"), F.count_distinct(F.coalesce("scorer", F.lit("")), F.coalesce("tenant", F.lit(""))).alias("kinds"), F.min("scorer").alias("scorer"), F.min("tenant").alias("tenant")).first()
    if not seen["n"] or seen["kinds"] != 1 or seen["scorer"] is None or seen["tenant"] != tenant:
        raise Refused(f"ranked pairs of {tenant!r}: {seen['n']} rows of {seen['kinds']} scorers and tenants, the first {seen['scorer']!r} of {seen['tenant']!r}")
    return unique(rows, ["source", "target"], "ranked pairs"), seen["scorer"]


def anchor_files(spark: SparkSession, choices: str, unanchored: str) -> tuple[DataFrame, DataFrame]:
    """Choices by (source, target, rank) and unanchored pairs by (source, target); a pair in both is refused."""
    first = unique(spark.read.parquet(choices), ["source", "target", "rank"], "choices")
    rest = unique(spark.read.parquet(unanchored), ["source", "target"], "unanchored pairs")
    if both := first.select("source", "target").distinct().join(rest, ["source", "target"], "left_semi").count():
        raise Refused(f"{both} pairs have an anchor and none")
    return first, rest


def bridge_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(source, target, similarity) of the bridges on file; none before the first run."""
    schema = "source bigint, target bigint, similarity double"
    return spark.read.parquet(path).select("source", "target", "similarity") if exists(spark, path) else spark.createDataFrame([], schema)


def rounds(spark: SparkSession, paths: list[str], columns: list[str] | None = None) -> DataFrame:
    """The rows of several rounds under each other; rounds without one of the columns, and a round that is given twice, are refused."""
    out, known = None, set()
    for path in paths:
        rows = spark.read.parquet(path)
        wanted = columns or (out.columns if out is not None else rows.columns)
        if lost := [c for c in wanted if c not in rows.columns]:
            raise Refused(f"{path} lacks {lost}")
        own = {r[0] for r in rows.select("round").distinct().limit(len(paths) + 1).collect()} if "round" in rows.columns else set()
        if again := own & known:
            raise Refused(f"rounds {sorted(again)} are given twice")
        known |= own
        out = rows.select(*wanted) if out is None else out.unionByName(rows.select(*wanted))
    if out is None:
        raise Refused("no rounds")
    return out


def placements(choices: DataFrame) -> DataFrame:
    """(source, target, context_relevance, anchor_target_fit) of the first choices; all are refused if one is out of [0, 1] or a pair has two."""
    first = choices.where("rank = 1").select("source", "target", "context_relevance", "anchor_target_fit")
    wrong = lambda c: F.col(c).isNotNull() & (F.isnan(c) | (F.col(c) < 0) | (F.col(c) > 1))
    if bad := first.where(wrong("context_relevance") | wrong("anchor_target_fit")).count():
        raise Refused(f"{bad} placements are out of [0, 1]")
    return unique(first, ["source", "target"], "placements").where("context_relevance is not null or anchor_target_fit is not null")


def candidate_pool(ranked: DataFrame, choices: DataFrame, excluded: DataFrame, longest: int = 120) -> DataFrame:
    """Ranked pairs with their first choice, one to one: pairs that can be served and labelled. Excluded pages (page) and long phrases are out."""
    first = unique(choices.where(F.col("rank") == 1), ["source", "target"], "first choices").where(F.length("phrase") <= longest)
    pool = unique(ranked, ["source", "target"], "ranked pairs").join(first.select("source", "target", "phrase"), ["source", "target"])
    for end in ("source", "target"):
        pool = pool.join(excluded.select(F.col("page").alias(end)), end, "left_anti")
    return pool


def same_keys(a: DataFrame, b: DataFrame, key: str, names: tuple[str, str]) -> None:
    """Refuses two tables that do not describe the same keys."""
    left, right = (x.select(F.col(key).alias("k")).distinct().withColumn(n, F.lit(1)) for x, n in ((a, "l"), (b, "r")))
    lost = left.join(right, "k", "full").agg(F.count_if(F.col("r").isNull()).alias("only_a"), F.count_if(F.col("l").isNull()).alias("only_b")).first()
    if lost["only_a"] or lost["only_b"]:
        raise Refused(f"{lost['only_a']} of {names[0]} are not in {names[1]}, {lost['only_b']} the other way")


def still_scored(pairs: DataFrame, rescored: DataFrame, column: str, tolerance: float = 1e-9) -> DataFrame:
    """``pairs`` (source, target, ``column``), refused if scoring them again misses one or gives another value: the file is stale then."""
    again = rescored.select("source", "target", F.col(column).alias("_again"))
    both = pairs.join(again, ["source", "target"], "left")
    off = both.agg(F.count_if(F.col("_again").isNull() & F.col(column).isNotNull()).alias("lost"), F.count_if(F.abs(F.col(column) - F.col("_again")) > tolerance).alias("off")).first()
    if off["lost"] or off["off"]:
        raise Refused(f"{column} is stale: {off['lost']} pairs are gone, {off['off']} differ")
    return pairs


def vector_pool(rows: DataFrame, vector: str = "vector") -> DataFrame:
    """``rows``, refused unless all vectors have one length above 0 and finite numbers."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    seen = rows.agg(F.min(F.size(v)).alias("lo"), F.max(F.size(v)).alias("hi"), F.count_if(v.isNull() | F.coalesce(bad, F.lit(False))).alias("bad")).first()
    if seen["lo"] is not None and (seen["lo"] != seen["hi"] or seen["lo"] < 1) or seen["bad"]:
        raise Refused(f"vectors have {seen['lo']} to {seen['hi']} numbers, {seen['bad']} are null or not finite")
    return rows


def sample(rows: DataFrame, keys: list[str], count: int, seed: int) -> DataFrame:
    """``count`` rows, or all there are, drawn without replacement: those of the lowest seeded hash of their key, whatever the partitioning."""
    drawn = F.sha2(F.concat_ws("\t", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]), 256)
    return rows.withColumn("_drawn", drawn).orderBy("_drawn", *keys).limit(count).drop("_drawn")


def below(seed: int, key: str, share: float) -> Column:
    """Whether the seeded hash of a key lies in the first ``share`` of the hash range; hex digits of one length compare like numbers."""
    bound = f"{min(int(share * 2**256), 2**256 - 1):064x}"
    return F.sha2(F.concat_ws("\t", F.lit(str(seed)), F.col(key).cast("string")), 256) < bound


def split(rows: DataFrame, key: str, test: float, valid: float, seed: int) -> DataFrame:
    """``rows`` with fold test, valid or train by key: test by the seed, valid by the next one among the rest, so rows of a key stay together."""
    fold = F.when(below(seed, key, test), "test").when(below(seed + 1, key, valid), "valid").otherwise("train")
    return rows.withColumn("fold", fold)


def hidden_positions(links: DataFrame, hidden: DataFrame) -> DataFrame:
    """(source, position) of every link between the ends of a hidden pair (source, target)."""
    return links.join(hidden.select("source", "target").distinct(), ["source", "target"], "left_semi").select("source", "position")
