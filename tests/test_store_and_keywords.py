import pytest

from linkloom.operators import keywords
from linkloom.sources import store as S


def rows(store, table, *names):
    return sorted(tuple(r[n] for n in names) for r in store.read(table).collect())


def test_versions_of_a_table(spark, tmp_path):
    s = S.Store(spark, f"file://{tmp_path}/tenant")
    with pytest.raises(ValueError, match="no table"):
        s.read("pages")
    pages = lambda x: spark.createDataFrame(x, "page long, title string, hash string")
    s.upsert("pages", pages([(1, "a", "h1"), (2, "b", "h2")]), ["page"])
    s.upsert("pages", pages([(2, None, "h9"), (3, "c", "h3")]), ["page"], keep=["title"])
    assert rows(s, "pages", "page", "title", "hash") == [(1, "a", "h1"), (2, "b", "h9"), (3, "c", "h3")]
    with pytest.raises(ValueError, match="twice"):
        s.upsert("pages", pages([(1, "x", "y"), (1, "z", "y")]), ["page"])
    s.insert_missing("pages", pages([(1, "no", "no"), (4, None, None), (4, None, None)]), ["page"])
    assert [r[0] for r in rows(s, "pages", "page", "hash")[:4]] == [1, 2, 3, 4] and [r["page"] for r in s.page("pages", "page", 1, 2, ["page"]).collect()] == [2, 3]
    assert s.lookup("pages", spark.createDataFrame([(3,), (9,)], "page long"), "page").count() == 1 and s.missing("pages", spark.createDataFrame([(3,), (9,)], "page long"), "page").collect()[0][0] == 9
    s.delete("pages", spark.createDataFrame([(4,)], "page long"), ["page"])
    assert s.prune("pages") >= 3 and rows(s, "pages", "page", "title") == [(1, "a"), (2, "b"), (3, "c")]
    links = lambda x: spark.createDataFrame(x, "source long, position long, target long")
    s.replace_groups("links", links([(1, 0, 2), (1, 1, 3), (2, 0, 1)]), ["source"])
    s.replace_groups("links", links([(1, 0, 3)]), ["source"], spark.createDataFrame([(2,)], "source long"))
    assert rows(s, "links", "source", "position", "target") == [(1, 0, 3)]
    s.keep_only("pages", spark.createDataFrame([(1,), (2,)], "page long"), ["page"])
    s.set_columns("pages", spark.createDataFrame([(1, 7)], "page long, depth int"), ["page"], ["depth"])
    s.set_columns("pages", spark.createDataFrame([(2, 5)], "page long, depth int"), ["page"], ["depth"], clear=True)
    assert rows(s, "pages", "page", "depth") == [(1, None), (2, 5)]
    s.drop_tenant()
    assert s.version("pages") is None


def test_vectors_go_in_all_or_none(spark, tmp_path):
    s = S.Store(spark, f"file://{tmp_path}/t")
    s.write("pages", spark.createDataFrame([(1, "h1"), (2, "h2")], "page long, hash string"))
    vectors = lambda x: spark.createDataFrame(x, "page long, hash string, vector array<double>")
    for bad, word in (([(1, "old", [1.0, 0.0])], "changed"), ([(1, "h1", [1.0, 1.0])], "unfit"), ([(1, "h1", [1.0])], "unfit"), ([(1, "h1", [1.0, 0.0]), (1, "h1", [1.0, 0.0])], "twice"), ([(9, "h", [1.0, 0.0])], "changed")):
        with pytest.raises(ValueError, match=word):
            s.set_vectors("pages", vectors(bad), "page", "hash", "vector", 2)
    s.set_vectors("pages", vectors([(2, "h2", [0.6, 0.8])]), "page", "hash", "vector", 2)
    assert rows(s, "pages", "page", "hash") == [(1, "h1"), (2, "h2")] and s.read("pages").where("vector is not null").count() == 1


def test_hub_ids_are_never_given_twice(spark, tmp_path):
    s = S.Store(spark, f"file://{tmp_path}/t")
    hubs = lambda *x: spark.createDataFrame([(i,) for i in x], "hub long")
    assert s.next_id("hubs", "hub") == 0
    s.retire("hubs", hubs(0, 1), "hub")
    s.retire("hubs", hubs(1, 2), "hub")
    assert rows(s, "hubs", "hub", "retired") == [(0, True), (1, False), (2, False)] and s.next_id("hubs", "hub") == 3


def test_label_files(spark, tmp_path):
    pairs = spark.createDataFrame([("p1", "a", "b", "=SUM(1)"), ("p2", "a", "c", 'say "hi", ok'), ("p3", "d", "e", None)], "pair_id string, source string, target string, sentence string")
    S.label_file(pairs, f"{tmp_path}/out", ["pair_id", "source", "target", "sentence"], 3)
    text = next((tmp_path / "out").glob("*.csv")).read_text(encoding="utf-8")
    assert text.startswith('"﻿pair_id"') and "'=SUM(1)" in text
    filled = "﻿pair_id,source,target,label,reason\np1,a,b,Good,\np2,a,c,poor,\n,,,,\np3,d,x,good,\np9,a,b,good,\np4,d,e,fair,no\np4,d,e,fair,no\n"
    (tmp_path / "in.csv").write_text(filled, encoding="utf-8")
    got = S.checked_labels(S.read_label_file(spark, f"{tmp_path}/in.csv", ["pair_id", "label"]), pairs.unionByName(spark.createDataFrame([("p4", "d", "e", "")], pairs.schema)))
    assert sorted((r["pair_id"], r["problem"] or "", r["grade"]) for r in got.collect()) == [
        ("p1", "", 3), ("p2", "no_reason", None), ("p3", "pair_changed", None), ("p4", "pair_twice", None), ("p4", "pair_twice", None), ("p9", "unknown_pair", None),
    ]
    with pytest.raises(ValueError, match="lack"):
        S.read_label_file(spark, f"{tmp_path}/in.csv", ["pair_id", "anchor"])


def test_titles_without_brands():
    brands = frozenset({"acme", "acme shop"})
    assert keywords.clean_title("Trail  Shoes | ACME", brands) == "Trail Shoes" and keywords.clean_title("Acme Shop – Boots - Acme", brands) == "Boots"
    assert keywords.clean_title("A - B | Other", brands) == "A - B | Other" and keywords.clean_title("Acme", brands) == "Acme" and keywords.clean_title(" ", brands) is None and keywords.clean_title(None, brands) is None
    assert [keywords.rejection(t, frozenset({"acme"}), r) for t, r in ((None, False), ("---", False), ("Read more", True), ("WELCOME", False), ("Acme", True), ("Boots", True), ("Boots", False))] == ["missing", "generic", "generic", "generic", "brand", "repeated", None]
    assert keywords.is_long("a " * 13, "H1") and not keywords.is_long("a " * 13, "GSC") and keywords.anchor_vector_key("é" * 3000) == "é" * 2048
    assert keywords.anchor_matches(keywords.words("best trail shoes"), keywords.words("trail shoes")) and not keywords.anchor_matches(keywords.words("x"), keywords.words("y z"))


def test_the_chain_of_keywords(spark):
    schema = "page long, language string, h1 string, headings array<struct<level:int,text:string>>, meta_title string, body_hash string"
    head = lambda *x: [(1, t) for t in x]
    pages = spark.createDataFrame(
        [(1, "en", "One", [], "One | Acme", "b1"), (2, "en", "Two", [], None, "b2"), (3, "en", "Welcome", head("Welcome", "Muddy trails"), "x", "b3"), (4, "en", None, [(2, "Sub")], "Boots | Acme", "b4"), (5, "de", "Sale", [], "Sale", "b5"),
         (6, "en", "Sale", [], "Acme", "b6"), (7, "en", "sale", None, None, "b7")], schema)
    strategic = spark.createDataFrame([(1, " trail  shoes ", "en", 2, False), (1, "boots", "en", 5, False), (2, "", "en", 1, True)], "page long, keyword string, language string, priority int, is_primary boolean")
    queries = spark.createDataFrame([(1, "cheap boots", 9.0), (2, "red boots", 1.0), (2, "blue boots", 3.0), (2, "BLUE  boots", 2.0)], "page long, query string, opportunity double")
    got = keywords.resolve(pages, strategic, queries, ["Acme", None])
    assert {r["page"]: (r["keyword"], r["rung"], r["opportunity"]) for r in got.collect()} == {1: ("boots", "STRATEGIC", None), 2: ("blue boots", "GSC", 3.0), 3: ("Muddy trails", "H1", None), 4: ("Boots", "TITLE", None)}
    ranks = keywords.ranked_keywords(got, strategic, queries, 1)
    assert sorted((r["page"], r["rank"], r["keyword"], r["source"]) for r in ranks.where("page < 3").collect()) == [
        (1, 1, "boots", "RESOLVED"), (1, 2, "trail shoes", "STRATEGIC"), (1, 3, "cheap boots", "GSC"), (2, 1, "blue boots", "RESOLVED"), (2, 2, "red boots", "GSC"),
    ]
    reasons = {(r["page"], r["rung"]): r["reason"] for r in keywords.fallbacks(pages, ["Acme"]).where("page >= 5").collect()}
    assert reasons == {(5, "H1"): "repeated", (5, "TITLE"): "repeated", (6, "H1"): "repeated", (6, "TITLE"): "brand", (7, "H1"): "repeated"}
