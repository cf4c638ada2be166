"""Url keys and page kinds, by the rules; the fixed facts of the survey are marked."""

import pytest
from pyspark.sql import functions as F

from linkloom.functions import url as U


@pytest.mark.parametrize(
    ("url", "key"),
    [
        ("HTTPS://WWW.Shop.Test/Sale/", "shop.test/sale"),
        ("//cdn.shop.test/x", "cdn.shop.test/x"),
        ("http://me:secret@www7.shop.test:80/one/./two/../three//", "shop.test/one/three"),
        ("shop.test:8443/a", "shop.test:8443/a"),
        ("https://shop.test/area/default.aspx", "shop.test/area"),
        ("https://shop.test/list;view=all/item", "shop.test/list/item"),
        ("https://www.test/only", "www.test/only"),
        ("http://müller.test/Größe", "xn--mller-kva.test/gr%C3%B6%C3%9Fe"),
        ("http://shop.test/gr%C3%B6%C3%9Fe", "shop.test/gr%C3%B6%C3%9Fe"),
        ("http://shop.test/?ref=mail&utm_medium=x#part", "shop.test"),
        ("http://shop.test/?seite=1&start=0&pg=abc", "shop.test"),
        ("http://shop.test/?PG=3", "shop.test?pg=3"),
        ("http://shop.test/?page_id=00812", "shop.test?page_id=812"),
        ("http://shop.test/?post=7&limitstart=40&article=Ab-2", "shop.test?article=ab-2&limitstart=40&post=7"),
        ("http://shop.test/?id=4&id=9", "shop.test?id=4"),
    ],
)
def test_keys(url, key):
    assert U.normalise(url) == key and U.normalise(key) == key


@pytest.mark.parametrize("url", [None, "", "\t", "sms:123", "data:text/plain,x", "file:///tmp/x", "/about", "?q=1", "#top", "https://", "http://shop.test:70000/", "localhost/x"])
def test_no_keys(url):
    assert U.normalise(url) is None


def test_tenant_rules():
    keep, drop = frozenset({"colour"}), frozenset({"page"})
    assert U.normalise("http://shop.test/?colour=Red&page=3&size=9", keep, drop) == "shop.test?colour=red"
    assert U.is_kept("Colour", keep, drop) and not U.is_kept("page", keep, drop) and U.is_kept("offset") and not U.is_kept("size")


def test_kinds_of_pages(spark):
    rows = [
        ("http://sitemap.test/a", False, False), ("http://a.test/sitemap.xml", True, False), ("a.test/html-sitemap", True, False), ("/site-map/x", True, False), ("a.test/websitemaps", False, False),
        ("http://a.test/site_map_2.html", True, False), ("http://a.test/list?currentpage=", False, True), ("http://a.test/page/12/", False, True), ("a.test/p/3", False, True), ("http://a.test/page-9", False, True),
        ("http://a.test/page/about", False, False), ("http://page/3", False, False), ("http://a.test/x?q=page", False, False), ("http://a.test/x#page=2", False, False), ("http://a.test/?limitstart", False, True),
    ]
    got = spark.createDataFrame(rows, "url string, s boolean, p boolean").select("url", "s", "p", U.is_sitemap(F.col("url")).alias("gs"), U.is_pagination(F.col("url")).alias("gp")).collect()
    assert [(r["url"], r["gs"], r["gp"]) for r in got] == [(r["url"], r["s"], r["p"]) for r in got]


def test_paths(spark):
    rows = spark.createDataFrame([("http://a.test/Shop/Old/x",), ("a.test/shop",), ("http://a.test/shopping",), ("http://shop/",)], "url string")
    got = rows.select(U.under_paths(F.col("url"), ["/shop/"]).alias("u"), U.host_of(F.lit("a.test:81/x?y=1")).alias("h")).collect()
    assert [r["u"] for r in got] == [True, True, False, False] and got[0]["h"] == "a.test:81"
