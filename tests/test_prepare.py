"""The Markdown cleaner and the preparation of a crawl."""

import pytest

from linkloom.functions import markdown as M
from linkloom.operators import prepare

PAGE = """[Home](/) › [Shop](/shop)
› Trail

Big Title
=========
## Sub *head* ##
Read our **guide** to [trail shoes](/shoes "Shoes"). Then \\*rest\\* &amp; drink.
, and more
> - ^ item with `code` and [mail](mailto:a@b.c)
| a | **b** |
|---|---|
![logo](/x.png) [![pic](/p.png)](/ad)
See https://long.test/x and [https://shop.test/y](https://shop.test/y).
[out](https://other.test/a#frag) [self](https://shop.test/p) [two
lines](b.html)
---
;
Buy now at our great shop!
[Imprint](/imprint) footer line here
"""


def test_one_page():
    got = M.clean(PAGE, "https://WWW.shop.test/p#top".replace("WWW.", ""), frozenset({"Buy now at our great shop!", "[Imprint]() footer line here"}))
    assert got.h1 == "Big Title" and got.headings == [(1, "Big Title"), (2, "Sub head"), (2, "out self two lines")]
    assert got.body == "Big Title\nSub head\nRead our guide to trail shoes. Then *rest* & drink., and more\nitem with code and mail\na; b\nSee and .\nout self two lines"
    assert got.links == [
        ("https://shop.test/shoes", "trail shoes", "Read our guide to trail shoes.", True), ("https://shop.test/y", "https://shop.test/y", "See and .", True),
        ("https://other.test/a", "out", "out self two lines", False), ("https://shop.test/b.html", "two lines", "out self two lines", True),
    ]
    assert got.template == [("https://shop.test/", "menu"), ("https://shop.test/shop", "menu"), ("https://shop.test/imprint", "footer")]


def test_small_parts():
    assert M.template_key(" [a](/x) and ![b](/y \"t\") ") == "[a]() and ![b]()" and M.is_navigation("- item") and M.is_navigation("1. [a](b)") and not M.is_navigation("plain text")
    assert M.clean_meta(" A&amp;B ​ x ") == "A&B x" and M.clean_meta(" ") is None
    assert M.clean("", "http://a.test").body == "" and M.clean("a\n\n\n\nb\n.\n", "http://a.test").body == "a\n\nb"
    assert M.clean("5 steps to go", "http://a.test").body == "5 steps to go" and M.plain("snake_case_name and _em_ and __strong__") == "snake_case_name and em and strong"
    with pytest.raises(ValueError, match="no web address"):
        M.clean("x", "ftp://a.test")


def body(text, **known):
    return M.clean(text, "https://www.shop.test/blog/post/", **known).body


def test_blocks():
    assert body("Report\n======\n\nInside\n------\n\nText.\n\n* * *\n\n---\nEnd") == "Report\n\nInside\n\nText.\n\nEnd"
    assert M.clean("Report\n======\n\nInside\n------\n\n### Sub ###\nx\n\n---\n\ny", "https://a.test").headings == [(1, "Report"), (2, "Inside"), (3, "Sub")]
    assert body("*   *   Nested\n> “Quote”\n1. One\n- two\n^ up\n• dot\n☐ box\n– dash\n*   **Tools\n    ** – live") == "Nested\n“Quote”\nOne\ntwo\nup\ndot\nbox\ndash\nTools\nlive"
    assert body("|   |   |\n| --- | :---: |\n| a | **b** |\n|c|d|") == "a; b\nc; d"
    assert body("one\n\n\n\ntwo\n, three\n;\n.\n.NET four") == "one\n\ntwo, three\n.NET four"
    assert body("› trail\n\nBody\n#notag\n1984. was a year") == "Body\n#notag\n1984. was a year"


def test_inlines():
    assert body("**A**: the *k* __p__ and _n_, `%w%\\S\\x`<br>Set &amp; HK\\_L\\_M 2*3*4 x_y_z ***b*** **open") == "A: the k p and n, %w%\\S\\x Set & HK_L_M 2*3*4 x_y_z b open"
    assert body("See https://x.test/a?b=1 or <https://x.test> or www.x.test now, a < b > c") == "See or or now, a < b > c"
    assert body("In ![cover](/a.png) text\n[![icon](data:image/svg+xml,%3Csvg%20v='0%200'%3E)](/install/)\nstray tail]( ) here\npa\u200btch\ufeff \ufffdnow") == "In text\nstray tail here\npatch now"
    got = M.clean("Read [**Bold** guide](/g/#s) now. Then [t](https://w.test/P_(c) \"W\") [m](mailto:a@b.c) [top](#top) [a [in](/in) b](/out) [x][y] [open", "https://www.shop.test/p")
    assert got.body == "Read Bold guide now. Then t m top [a in b](/out) [x][y] [open"
    assert got.links == [
        ("https://www.shop.test/g/", "Bold guide", "Read Bold guide now.", True), ("https://w.test/P_(c)", "t", "Then t m top [a in b](/out) [x][y] [open", False), ("https://www.shop.test/in", "in", "Then t m top [a in b](/out) [x][y] [open", True),
    ]
    assert body("[[" * 20_000 + "x" + "](y)" * 20_000).startswith("[") and body("*" * 30_000 + "a_" * 30_000)
    text = body("# T\n\n**A** [b](/b/) ![i](/i.png) https://x.com\n\n| c | d |")
    assert body(text) == text


def test_template_lines_by_zone():
    root, banner, related = "[Home](https://www.shop.test/)", "**Try it free for 30 days.** [Sign up](/signup/)", "[New](/blog/) [Old](/blog/?page=2) [Partner](https://o.test/) [Mail](mailto:a@b.c) [](/e/) ![l](/l.png) [Top](#t)"
    page = "\n".join([root, " 5 [Blog](/blog/)", "› [Guides](/g/) › Guide", "", "# Guide", "Read [notes](/n/).", root, "Last words.", "", banner, related])
    got = M.clean(page, "https://www.shop.test/blog/post/", frozenset(M.template_key(x) for x in (root, banner, related)))
    assert got.body == "Guide\nRead notes.\nLast words."
    assert [(z, t.removeprefix("https://www.shop.test")) for t, z in got.template] == [("menu", "/"), ("menu", "/blog/"), ("menu", "/g/"), ("menu", "/"), ("footer", "/signup/"), ("footer", "/blog/"), ("footer", "/blog/?page=2")]
    assert {z for _, z in M.clean(root, "https://www.shop.test/x", frozenset({M.template_key(root)})).template} == {"menu"}
    assert [M.is_navigation(x) for x in ("*   [A](https://x.test/a/)", "5 [Blog](/b/)", "### By P", "- Topic", "A [link](/x) inside.", "Plain text.")] == [True] * 4 + [False] * 2


def test_a_crawl(spark):
    menu = "[Start page of shop](/) menu"
    rows = [(f"https://www.shop.test/p{i}", f"T{i}", f"{menu}\n# Page {i}\nText number {i} is here, see [next](/p{i + 1}).", 200, True) for i in range(6)]
    rows += [("http://shop.test/p1", "x", "# Other", 200, True), ("https://shop.test/p2/", "x", "gone", 404, True), ("https://shop.test/sitemap", "S", "list of pages", 200, True), ("https://shop.test/old/x", "O", "old text", 200, True)]
    rows += [("mailto:a@b.c", "", "x", 200, True), ("https://shop.test/e", "", " ", 200, True), ("https://shop.test/u", "", "x", 200, None), ("https://shop.test/l", "L", "\n".join(f"[word{i}](/w{i})" for i in range(6)), 200, True)]
    crawl = spark.createDataFrame(rows, "url string, title string, content string, status int, usable boolean")
    got = prepare.prepare(crawl, ("/old",), share=0.5)
    pages = {r["url_key"]: r for r in got["pages"].collect()}
    assert sorted(pages) == [f"shop.test/p{i}" for i in range(6)] and pages["shop.test/p1"]["h1"] == "Page 1"
    assert all("menu" not in r["body"] and r["words"] == 9 for r in pages.values())
    assert sorted((r["source"], r["target"], r["anchor"]) for r in got["links"].collect()) == [(f"shop.test/p{i}", f"shop.test/p{i + 1}", "next") for i in range(6)]
    assert {r["url_key"]: r["why"] for r in got["excluded"].collect()} == {"shop.test/sitemap": "sitemap", "shop.test/old/x": "tenant_path", "shop.test/l": "mostly_links"}
    assert {r["reason"]: r["rows"] for r in got["skipped"].collect()} == {"no_key": 1, "status": 1, "unusable": 1, "empty": 1}
