"""The keyword of every page: strategic, then search queries, then H1, then title; further keywords in ranks behind it."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.terms import anchor, is_generic, term
from linkloom.operators.text_tables import merged_strategic

#: Headings that name no topic; bodies under one heading that make it a template; words of a long keyword; further queries.
PLACEHOLDERS = frozenset(
    "home|home page|homepage|welcome|untitled|index|page not found|404|not found|error|startseite|willkommen|herzlich willkommen|seite nicht gefunden|accueil|bienvenue|page introuvable|"
    "inicio|bienvenido|bienvenida|página no encontrada|benvenuto|benvenuti|pagina non trovata".split("|")
)
REPEATED, LONG, MORE = 3, 12, 4
_SEPARATOR = re.compile(r" (?:\||-|–|—|::) ")


def clean_title(title: str | None, brands: frozenset[str]) -> str | None:
    """A title without a brand segment at its end, then at its start; ``brands`` are keys. Null where nothing is left."""
    parts = _SEPARATOR.split(" ".join((title or "").split()))
    marks = _SEPARATOR.findall(" ".join((title or "").split()))
    if len(parts) > 1 and term(parts[-1]) in brands:
        parts.pop()
        marks.pop()
    if len(parts) > 1 and term(parts[0]) in brands:
        parts.pop(0)
        marks.pop(0)
    text = parts[0] + "".join(m + p for m, p in zip(marks, parts[1:], strict=True))
    return text.strip() or None


def rejection(text: str | None, brand_words: frozenset[str], repeated: bool, add: frozenset[str] = frozenset(), remove: frozenset[str] = frozenset()) -> str | None:
    """Why a cleaned heading or title can't be a keyword: missing, generic, brand or repeated, the first that holds."""
    if text is None:
        return "missing"
    key = term(text)
    if not any(c.isalpha() for c in text) or is_generic(text, add, remove) or (key in PLACEHOLDERS and key not in remove):
        return "generic"
    if brand_words and set(re.findall(r"\w+", key)) <= brand_words:
        return "brand"
    return "repeated" if repeated else None


def _texts(function: Callable[[str], str | None]) -> Callable:
    """A string function over Arrow batches; null stays null."""

    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else function(v) for v in values], dtype=object)

    return F.pandas_udf(run, "string")


def fallbacks(pages: DataFrame, affixes: list[str], add: frozenset[str] = frozenset(), remove: frozenset[str] = frozenset()) -> DataFrame:
    """(page, place, rung, text, reason): the H1, other level-1 headings and the title of every page in order, cleaned, with why each is rejected.

    Pages have page, h1, headings array<struct<level,text>>, meta_title and body_hash. A text over three different bodies is
    a template; bodies are counted per key.
    """
    brands = frozenset(term(a) for a in affixes if a)
    brand_words = frozenset(w for a in brands for w in re.findall(r"\w+", a))
    cleaned, key = _texts(lambda t: clean_title(t, brands)), _texts(term)

    def judge(text: pd.Series, repeated: pd.Series) -> pd.Series:
        return pd.Series([rejection(t, brand_words, bool(r), add, remove) for t, r in zip(text, repeated, strict=True)], dtype=object)

    shown = lambda c: F.trim(F.regexp_replace(c, "\\s+", " "))
    first = F.transform(F.filter("headings", lambda h: h["level"] == 1), lambda h: h["text"])
    heads = F.array_distinct(F.filter(F.transform(F.concat(F.array("h1"), F.coalesce(first, F.array().cast("array<string>"))), shown), lambda t: t.isNotNull() & (t != "")))
    title = F.filter(F.array(shown(F.col("meta_title"))), lambda t: t.isNotNull() & (t != ""))
    listed = F.concat(F.transform(heads, lambda t: F.struct(F.lit("H1").alias("rung"), t.alias("raw"))), F.transform(title, lambda t: F.struct(F.lit("TITLE").alias("rung"), t.alias("raw"))))
    rows = pages.select("page", "body_hash", F.posexplode_outer(listed).alias("place", "x")).select("page", "body_hash", "place", "x.*").where("raw is not null")
    rows = rows.withColumn("text", cleaned("raw")).withColumn("k", key("text"))
    spread = rows.where("k is not null").groupBy("k").agg(F.count_distinct("body_hash").alias("bodies")).where(F.col("bodies") >= REPEATED).select("k", F.lit(True).alias("again"))
    rows = rows.join(spread, "k", "left").withColumn("again", F.coalesce("again", F.lit(False)))
    return rows.select("page", "place", "rung", "text", F.pandas_udf(judge, "string")("text", "again").alias("reason"))


def resolve(pages: DataFrame, strategic: DataFrame, queries: DataFrame, affixes: list[str]) -> DataFrame:
    """page, keyword, language, rung, opportunity of every page that has one: the first rung that gives it, each a grouped minimum.

    ``queries`` are usable search rows with page, query and opportunity; pages need language beside what :func:`fallbacks` reads.
    """
    best = merged_strategic(strategic).where("rank = 1").select("page", F.col("keyword").alias("s_text"), F.col("language").alias("s_language"))
    ranked = _ranked(queries).where("place = 1").select("page", F.col("query").alias("q_text"), "opportunity")
    rest = fallbacks(pages, affixes).where("reason is null and text is not null").groupBy("page").agg(F.min(F.struct("place", "rung", "text")).alias("f"))
    rows = pages.select("page", "language").join(best, "page", "left").join(ranked, "page", "left").join(rest, "page", "left")
    rung = F.when(F.col("s_text").isNotNull(), "STRATEGIC").when(F.col("q_text").isNotNull(), "GSC").otherwise(F.col("f.rung"))
    rows = rows.select(
        "page", F.coalesce("s_text", "q_text", "f.text").alias("keyword"), F.coalesce("s_language", "language").alias("language"), rung.alias("rung"),
        F.when(F.col("s_text").isNull(), F.col("opportunity")).alias("opportunity"),
    )
    return rows.where("keyword is not null")


def _ranked(queries: DataFrame) -> DataFrame:
    key = _texts(term)
    shown = queries.select("page", F.trim(F.regexp_replace("query", "\\s+", " ")).alias("query"), "opportunity").withColumn("k", key("query"))
    return shown.withColumn("place", F.row_number().over(Window.partitionBy("page").orderBy(F.col("opportunity").desc(), "k", "query")))


def ranked_keywords(resolved: DataFrame, strategic: DataFrame, queries: DataFrame, most: int = MORE) -> DataFrame:
    """page, keyword, source, rank: the resolved keyword, then strategic ones, then up to ``most`` queries, no key twice."""
    key = _texts(term)
    one = resolved.select("page", "keyword", F.lit("RESOLVED").alias("source"), F.lit(0).alias("level"), F.lit(0).alias("place"))
    two = merged_strategic(strategic).select("page", "keyword", F.lit("STRATEGIC").alias("source"), F.lit(1).alias("level"), F.col("rank").alias("place"))
    three = _ranked(queries).select("page", F.col("query").alias("keyword"), F.lit("GSC").alias("source"), F.lit(2).alias("level"), "place")
    rows = one.unionByName(two).unionByName(three).join(resolved.select("page"), "page", "left_semi").withColumn("k", key("keyword"))
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("page", "k").orderBy("level", "place"))).where("n = 1")
    kept = first.withColumn("m", F.row_number().over(Window.partitionBy("page", "level").orderBy("place"))).where((F.col("level") < 2) | (F.col("m") <= most))
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("page").orderBy("level", "place"))).select("page", "keyword", "source", "rank")


def is_long(keyword: str, rung: str) -> bool:
    """Whether a heading or title reads as a sentence rather than a keyword."""
    return rung in ("H1", "TITLE") and len(re.findall(r"\w+", term(keyword))) > LONG


def words(text: str) -> frozenset[str]:
    """Words of two characters and more, as keys."""
    return frozenset(w for w in re.findall(r"\w+", term(text)) if len(w) >= 2)


def anchor_matches(anchor_words: frozenset[str], keyword_words: frozenset[str], least: float = 0.5) -> bool:
    """Whether an anchor names a keyword: one's words hold the other's, or half of them are common."""
    both = anchor_words & keyword_words
    return bool(both) and (both in (anchor_words, keyword_words) or len(both) / len(anchor_words | keyword_words) >= least)


def anchor_vector_key(text: str, most: int = 4096) -> str:
    """The key of an anchor, cut to that many bytes of UTF-8 at a character."""
    return anchor(text).encode()[:most].decode(errors="ignore")
