"""Checks of tables on file, and seeded draws."""

import hashlib

import pytest

from linkloom.sources import inputs as I

PAIRS = "source long, target long, score double, scorer string, tenant string"


def test_ranked_pairs(spark, tmp_path):
    def write(name, *rows):
        spark.createDataFrame(rows, PAIRS).write.parquet(f"{tmp_path}/{name}")
        return f"{tmp_path}/{name}"

    good = write("good", (1, 2, 0.5, "ranker", "t"), (1, 3, 0.4, "ranker", "t"))
    rows, scorer = I.ranked_pairs(spark, good, "t")
    assert rows.count() == 2 and scorer == "ranker"
    for name, bad in (("mixed", [(1, 2, 0.5, "a", "t"), (1, 3, 0.5, "b", "t")]), ("null", [(1, 2, 0.5, None, "t"), (1, 3, 0.5, "b", "t")]), ("twice", [(1, 2, 0.5, "a", "t")] * 2), ("none", []), ("open", [(1, None, 0.5, "a", "t")])):
        with pytest.raises(I.Refused):
            I.ranked_pairs(spark, write(name, *bad), "t")
    with pytest.raises(I.Refused, match="'t'"):
        I.ranked_pairs(spark, good, "other")


def test_anchor_files_and_rounds(spark, tmp_path):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    frame([(1, 2, 1, "a", 0.5, None), (1, 2, 2, "b", 2.0, None), (3, 4, 1, "c", None, None)], "source long, target long, rank int, phrase string, context_relevance double, anchor_target_fit double").write.parquet(f"{tmp_path}/c")
    frame([(5, 6)], "source long, target long").write.parquet(f"{tmp_path}/u")
    choices, rest = I.anchor_files(spark, f"{tmp_path}/c", f"{tmp_path}/u")
    assert choices.count() == 3 and rest.count() == 1 and [tuple(r) for r in I.placements(choices).collect()] == [(1, 2, 0.5, None)]
    frame([(1, 2)], "source long, target long").write.mode("append").parquet(f"{tmp_path}/u")
    with pytest.raises(I.Refused, match="an anchor and none"):
        I.anchor_files(spark, f"{tmp_path}/c", f"{tmp_path}/u")
    with pytest.raises(I.Refused, match="out of"):
        I.placements(choices.withColumn("rank", choices["rank"] - 1))
    assert I.bridge_pairs(spark, f"{tmp_path}/none").count() == 0
    for i in range(2):
        frame([(i, 1.0, "x")], "round int, v double, more string").write.parquet(f"{tmp_path}/r{i}")
    assert sorted(tuple(r) for r in I.rounds(spark, [f"{tmp_path}/r{i}" for i in range(2)], ["round", "v"]).collect()) == [(0, 1.0), (1, 1.0)]
    for paths, columns in (([f"{tmp_path}/r0"] * 2, None), ([f"{tmp_path}/r0"], ["gone"]), ([], None)):
        with pytest.raises(I.Refused):
            I.rounds(spark, paths, columns)
    pool = I.candidate_pool(frame([(1, 2, 0.5), (3, 4, 0.4), (7, 8, 0.1)], "source long, target long, score double"), choices, frame([(4,)], "page long"))
    assert [(r["source"], r["phrase"]) for r in pool.collect()] == [(1, "a")]


def test_tables_that_belong_together(spark):
    frame = lambda rows: spark.createDataFrame(rows, "source long, target long, x double")
    I.same_keys(frame([(1, 1, 0.0), (1, 2, 0.0)]), frame([(1, 9, 0.0)]), "source", ("a", "b"))
    with pytest.raises(I.Refused, match="1 of a are not in b, 2 the other way"):
        I.same_keys(frame([(1, 1, 0.0)]), frame([(2, 9, 0.0), (3, 9, 0.0)]), "source", ("a", "b"))
    assert I.still_scored(frame([(1, 1, 0.5), (1, 2, None)]), frame([(1, 1, 0.5 + 1e-12)]), "x").count() == 2
    for rows in ([(1, 1, 0.6)], []):
        with pytest.raises(I.Refused, match="stale"):
            I.still_scored(frame([(1, 1, 0.5)]), frame(rows), "x")
    vectors = lambda *x: spark.createDataFrame([(v,) for v in x], "vector array<double>")
    assert I.vector_pool(vectors([1.0, 2.0], [0.0, 0.0])).count() == 2 and I.vector_pool(vectors([1.0]).limit(0)).count() == 0
    for bad in (([1.0], [1.0, 2.0]), ([],), ([float("nan")],), ([None],), ([1.0], None)):
        with pytest.raises(I.Refused):
            I.vector_pool(vectors(*bad))


def test_draws_follow_from_seeds(spark):
    rows = spark.createDataFrame([(i,) for i in range(200)], "k long")
    low = lambda seed, k: int(hashlib.sha256(f"{seed}\t{k}".encode()).hexdigest(), 16) / 2**256
    got = [sorted(r["k"] for r in I.sample(rows.repartition(n), ["k"], 20, 5).collect()) for n in (1, 6)]
    assert got[0] == got[1] == sorted(sorted(range(200), key=lambda k: low(5, k))[:20]) and I.sample(rows, ["k"], 999, 5).count() == 200
    folds = {r["k"]: r["fold"] for r in I.split(rows, "k", 0.2, 0.25, 7).collect()}
    assert folds == {k: "test" if low(7, k) < 0.2 else "valid" if low(8, k) < 0.25 else "train" for k in range(200)}
    links = spark.createDataFrame([(1, 0, 2), (1, 1, 3), (1, 2, 2)], "source long, position int, target long")
    assert sorted(tuple(r) for r in I.hidden_positions(links, spark.createDataFrame([(1, 2), (1, 2), (9, 9)], "source long, target long")).collect()) == [(1, 0), (1, 2)]
