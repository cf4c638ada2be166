"""Tables written by key, commits of several tables, and vectors by content."""

import pytest
from pyspark.sql import functions as F

from linkloom.sources.keyed import KeyedTable
from linkloom.sources.store import Conflict, Store
from linkloom.sources.vectors import VectorStore, text_key

PAGES = "page bigint, title string, size int"


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def state(table):
    return sorted((tuple(r) for r in table.read().collect()), key=str)


def test_a_write_touches_the_buckets_of_its_keys(spark, tmp_path):
    t = KeyedTable(spark, f"file://{tmp_path}/t", PAGES, ["page"], 8)
    pages = lambda *x: spark.createDataFrame(x, PAGES)
    assert state(t) == []
    t.upsert(pages(*[(i, f"t{i}", i) for i in range(40)], (None, "none", 0)))
    before = files(tmp_path / "t")
    written = t.upsert(pages((3, "new", None), (41, "x", 1)), keep=["size"])
    after = files(tmp_path / "t")
    assert {k for k in before if after.get(k) != before[k]} == {k for k in before if any(k.startswith(f"bucket={b}/") for b in written)} and len(written) <= 2
    assert state(t) == sorted([*[(i, "new" if i == 3 else f"t{i}", i) for i in range(40)], (41, "x", 1), (None, "none", 0)], key=str)
    t.insert_missing(pages((3, "no", 9), (50, "y", 2), (50, "y", 2)))
    t.delete(pages((50, "", 0), (None, "", 0), (77, "", 0)))
    t.set_columns(spark.createDataFrame([(4, "four"), (99, "lost")], "page bigint, title string"), ["title"])
    assert {r[0]: r[1] for r in state(t)} == {**{i: {3: "new", 4: "four"}.get(i, f"t{i}") for i in range(40)}, 41: "x"}
    with pytest.raises(ValueError, match="twice"):
        t.upsert(pages((1, "a", 1), (1, "b", 1)))
    assert t.of(spark.createDataFrame([(3,), (4,), (500,)], "page bigint")).count() == 2
    plan = t._in([1, 2])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]


def test_groups_lie_together(spark, tmp_path):
    links = lambda *x: spark.createDataFrame(x, "source bigint, position int, target bigint")
    t = KeyedTable(spark, f"file://{tmp_path}/l", "source bigint, position int, target bigint", ["source", "position"], 4, group=["source"])
    t.replace_groups(links(*[(s, p, s + p) for s in range(10) for p in range(3)]))
    t.replace_groups(links((2, 0, 99)), spark.createDataFrame([(3,)], "source bigint"))
    assert [r[1:] for r in state(t) if r[0] == 2] == [(0, 99)] and not [r for r in state(t) if r[0] == 3] and len(state(t)) == 25
    t.set_columns(spark.createDataFrame([(5, 7)], "source bigint, target bigint"), ["target"])
    assert [r[2] for r in state(t) if r[0] == 5] == [7, 7, 7]
    t.delete(spark.createDataFrame([(s,) for s in range(10)], "source bigint"))
    assert state(t) == []


def test_two_writers(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/tenant")
    rows = lambda *x: spark.createDataFrame([(i,) for i in x], "page bigint")
    s.write_all({"pages": rows(1, 2), "links": rows(1)})
    first = s.snapshot()
    seen = []

    def slow(now):
        seen.append(now.number)
        if len(seen) == 1:  # another writer comes in between
            s.upsert("pages", rows(3), ["page"])
        return {"pages": now.read("pages").unionByName(rows(4))}

    s.change(slow)
    assert seen == [0, 1] and sorted(r[0] for r in s.read("pages").collect()) == [1, 2, 3, 4]
    with pytest.raises(Conflict, match="pages"):
        s.commit({"links": first.read("pages")}, first)
    assert s.snapshot().number == 2 and len(list((tmp_path / "tenant/links").iterdir())) == 1
    other = s.snapshot()
    other.read("links")
    s.write("pages", rows(9))
    s.commit({"links": rows(8)}, other)  # what it read is unchanged, so it goes on top
    assert [r[0] for r in s.read("links").collect()] == [8] and [r[0] for r in s.read("pages").collect()] == [9]
    assert not s._create(s.snapshot().number, {}) and not [p for p in (tmp_path / "tenant/_commits").iterdir() if ".new-" in p.name and not p.name.endswith(".crc")]


def test_a_reader_sees_one_commit(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/tenant")
    pair = lambda i: {t: spark.createDataFrame([(i,)], "n int") for t in ("a", "b")}
    s.write_all(pair(0))
    held = s.snapshot()
    for i in range(1, 4):
        s.write_all(pair(i))
        now = s.snapshot()
        assert now.read("a").first()[0] == now.read("b").first()[0] == i
    assert held.read("a").first()[0] == held.read("b").first()[0] == 0
    assert s.prune("a") == 3 and s.prune("a") == 0 and s.snapshot().read("a").first()[0] == 3
    s.forget()
    assert s.snapshot().read("b").first()[0] == 3


def test_vectors_by_content(spark, tmp_path):
    s = VectorStore(spark, f"file://{tmp_path}/v", 2, 4)
    rows = lambda *x: spark.createDataFrame(x, "key string, vector array<double>")
    wanted = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), ("d",), ("e",), (None,)], "key string")
    assert sorted(r[0] for r in s.missing(wanted, "m").collect()) == ["a", "b", "c", "d", "e"]
    assert s.add(rows(("a", [1.0, 0.0]), ("b", [1.0]), ("c", [float("nan"), 1.0]), ("d", None), ("e", [0.0, 0.0]), (None, [1.0, 1.0])), "m") == 5
    assert sorted(r[0] for r in s.missing(wanted, "m").collect()) == ["b", "c", "d", "e"]
    assert s.add(rows(("a", [9.0, 9.0]), ("b", [0.0, 1.0]), ("b", [5.0]), ("c", [None, 1.0])), "m") == 2
    assert s.add(rows(("a", [3.0, 4.0])), "other") == 1
    # Another writer added the same key without seeing this one's row: the first append counts.
    late = s._rows().where("key = 'a' and model = 'm'").withColumn("vector", F.lit([7.0, 7.0]).cast("array<float>")).withColumn("added", F.lit(99).cast("bigint"))
    late.write.mode("append").partitionBy("bucket").parquet(s.path)
    for _ in range(2):
        got = {r["key"]: r["vector"] for r in s.gathered(wanted, "m").collect()}
        assert got == {"a": [1.0, 0.0], "b": [0.0, 1.0], "c": None, "d": None, "e": None} | ({None: None} if None in got else {})
        assert s.gathered(wanted, "m").count() == 7 and s.gathered(wanted.where("key = 'a'"), "other").first()["vector"] == [3.0, 4.0]
        s.compact()
    assert s._rows().count() == 3
    assert text_key and spark.range(1).select(text_key(F.lit("abc"))).first()[0].startswith("ba7816bf")
