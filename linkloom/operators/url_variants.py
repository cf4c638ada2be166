"""What each query parameter of a site does to its content, from urls that differ in that parameter alone.

Every url meets its neighbours at its deletion keys: the url with one parameter left out. Urls that carry the parameter come
with its value, the url without it comes with none, so two urls at one key differ in exactly that parameter if their values
differ. Pairs are counted, never listed: of n urls at a key, c with a value and so on, there are n(n-1)/2 less c(c-1)/2 per
value. Counts per (key, value, content) are pre-aggregated, so a path with very many urls is spread over its values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.url import url_key


def parameters(url: Column) -> Column:
    """Sorted (name, value) of a url's query: decoded, names in lower case, blank values and parts without = left out, the last of a name kept."""
    raw = F.split(F.regexp_extract(url, "^[^?#]*\\?([^#]*)", 1), "&")
    decoded = lambda x: F.coalesce(F.try_url_decode(x), x)
    parts = F.filter(F.transform(raw, lambda x: F.struct(F.lower(decoded(F.substring_index(x, "=", 1))).alias("name"), decoded(F.regexp_extract(x, "^[^=]*=(.*)$", 1)).alias("value"))), lambda x: x["value"] != "")
    last = F.filter(parts, lambda x, i: ~F.exists(F.slice(parts, i + 2, F.size(parts) + 1), lambda y: y["name"] == x["name"]))
    return F.array_sort(last)


def without_query(url: Column) -> Column:
    """The key of a url without query and fragment."""
    return url_key(F.regexp_replace(url, "[?#].*$", ""))


def deletions(pages: DataFrame) -> DataFrame:
    """(base, rest, name, value, body, n) of ``pages`` (base, params, body): urls that carry a parameter, under their key without it; null value: the url that is that key."""
    same = pages.groupBy("base", "params", "body").agg(F.count("*").alias("n"))
    p = F.col("p")
    carry = same.select("base", "params", "body", "n", F.explode("params").alias("p")).select(
        "base", F.filter("params", lambda x: x["name"] != p["name"]).alias("rest"), p["name"].alias("name"), p["value"].alias("value"), "body", "n"
    )
    asked = carry.select("base", "rest", "name").distinct()
    bare = same.select(F.col("base").alias("b9"), F.col("params").alias("r9"), "body", "n")
    bare = asked.join(bare, (F.col("base") == F.col("b9")) & (F.col("rest") == F.col("r9"))).select("base", "rest", "name", F.lit(None).cast("string").alias("value"), "body", "n")
    return carry.unionByName(bare)


def evidence(crawl: DataFrame, base: Column | None = None) -> DataFrame:
    """name, urls, content_changed, content_same of every parameter of ``crawl`` (url, body: content hash or null).

    Pairs of urls that differ only in the parameter, with other and with equal content. Urls without a hash are counted in
    ``urls`` and not compared; a null url has no parameters. ``base`` defaults to the url's key without query.
    """
    rows = crawl.select((without_query(F.col("url")) if base is None else base).alias("base"), parameters(F.coalesce("url", F.lit(""))).alias("params"), "body")
    seen = rows.select(F.explode(F.transform("params", lambda x: x["name"])).alias("name")).groupBy("name").agg(F.count("*").alias("urls"))
    known = deletions(rows.where("base is not null and body is not null and body <> ''"))
    cells = known.groupBy("base", "rest", "name", "value", "body").agg(F.sum("n").alias("n"))
    pairs = lambda n: F.call_function("div", n * (n - 1), F.lit(2))
    signed = []
    for keys, changed, same in ((["value", "body"], 1, -1), (["value"], -1, 0), (["body"], -1, 1), ([], 1, 0)):
        counted = cells.groupBy("base", "rest", "name", *keys).agg(F.sum("n").alias("n")) if len(keys) < 2 else cells
        signed.append(counted.groupBy("name").agg((F.sum(pairs(F.col("n"))) * changed).alias("changed"), (F.sum(pairs(F.col("n"))) * same).alias("same")))
    total = signed[0]
    for other in signed[1:]:
        total = total.unionByName(other)
    total = total.groupBy("name").agg(F.sum("changed").alias("changed"), F.sum("same").alias("same"))
    return seen.join(total, "name", "left").select("name", "urls", F.coalesce("changed", F.lit(0)).alias("content_changed"), F.coalesce("same", F.lit(0)).alias("content_same"))
