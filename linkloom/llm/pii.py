"""Personal data: fixed patterns, and terms that reveal the protected entities behind them.

Base spans are e-mail addresses, IP addresses, payment cards and phone numbers. All terms (words of three or more
letters) of every document that mentions an entity are counted with it, wherever they stand. With N documents,

    disclosure(t, e) = log(P(e | t) / P(e)) / log(1 / P(e)),   P(e | t) = joint(e, t) / df(t)

is the pointwise mutual information of term and entity over the information content of the entity: 1 if the term occurs
with that entity only. Pairs that meet in fewer than ``MIN_TEXTS`` different texts are not estimated. In documents that
mention the entity, a term at ``GENERALISE`` or more becomes ``[TERM]``, at ``REMOVE`` or more it is taken out. Documents
without protected entities are never changed.

Everything is built from column expressions. Positions are code points: pieces between matches and the matches
themselves are measured, so no text is walked twice per match. Runs are matched possessively and only from their start,
which keeps long runs linear. Defined cases: a null text counts as empty and stays null in the sanitised output; empty
texts have no spans; repeated rows and rows that share a doc_id get spans of their own text; documents without an id get
base spans only; other columns pass through the filter unchanged, and n_chars follows a changed text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.plans import bitmap
from linkloom.plans.scratch import materialize

MIN_TEXTS = 3
GENERALISE, REMOVE = 0.85, 0.95
_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = f"(?:(?<!{_LOCAL})|\\G){_LOCAL}++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++"
IP = "(?:(?<![0-9])|\\G)[0-9]++(?:\\.[0-9]++){3}"
CARD = "[0-9](?:[ -]?[0-9])++"
PHONE = "\\+[0-9][ ().0-9-]+[0-9]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
TERM = "(?<![\\p{L}\\p{N}])\\p{L}[\\p{L}\\p{N}]*+(?:['’-][\\p{L}\\p{N}]++)*+"
SPAN = "array<struct<start:int,end:int,value:string>>"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    at = F.sequence(F.lit(1), F.length(digits))
    back = F.reverse(digits)

    def value(i: Column) -> Column:
        d = F.substr(back, i, F.lit(1)).cast("int")
        doubled = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 0, doubled).otherwise(d)

    return F.aggregate(at, F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def _valid_card(match: Column) -> Column:
    digits = _digits(match)
    return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)


#: kind -> (pattern, a text without this has no match, what a match must hold, tag), in the order of the spans.
KINDS = {
    "email": (EMAIL, lambda t: F.instr(t, "@") > 0, lambda m: F.lit(True), "[EMAIL]"),
    "ip": (IP, lambda t: t.rlike("[0-9]\\.[0-9]"), lambda m: m.rlike(f"^{_PART}(?:\\.{_PART}){{3}}$"), "[IP]"),
    "card": (CARD, lambda t: t.rlike("[0-9](?:[ -]?[0-9]){12}"), _valid_card, "[CARD]"),
    "phone": (PHONE, lambda t: F.instr(t, "+") > 0, lambda m: F.length(_digits(m)).between(9, 15), "[PHONE]"),
}


#: Matches whose positions are summed in one piece.
PIECE = 256


def _spans(text: Column, pattern: Column) -> Column:
    """(start, end, value) of the leftmost matches that do not overlap; code points, end exclusive.

    Appending to an array copies it, so matches are listed in pieces of ``PIECE``, and the pieces joined at the end.
    """
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("match"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["pos"] + F.length(x["gap"])
        end = begin + F.coalesce(F.length(x["match"]), F.lit(0))
        one = F.array(F.struct(begin.alias("start"), end.alias("end"), x["match"].alias("value")))
        return F.struct(end.alias("pos"), F.when(x["match"].isNotNull(), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def piece(found: Column):
        def add(acc: Column, at: Column) -> Column:
            start = F.struct(acc["pos"].alias("pos"), F.array().cast(SPAN).alias("out"))
            own = F.aggregate(F.slice(found, at, F.lit(PIECE)), start, step)
            return F.aggregate(F.array(own), acc, lambda _, x: F.struct(x["pos"].alias("pos"), F.concat(acc["parts"], F.array(x["out"])).alias("parts")))

        return add

    def listed(found: Column) -> Column:
        start = F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<{SPAN}>").alias("parts"))
        return F.aggregate(F.sequence(F.lit(1), F.size(found), F.lit(PIECE)), start, piece(found), lambda acc: F.flatten(acc["parts"]))

    # The matches are an element of an array here, so that they are found once and not again for each piece.
    return F.get(F.transform(F.array(both), listed), 0)


def _kind_spans(text: Column, kind: str) -> Column:
    pattern, may, valid, _ = KINDS[kind]
    return F.when(may(text), F.filter(_spans(text, F.lit(pattern)), lambda s: valid(s["value"]))).otherwise(F.array().cast(SPAN)).alias(kind)


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, one array of spans per kind, and the text where there are any. No shuffle."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    text = F.col("_text")
    found = [_kind_spans(text, kind) for kind in KINDS]
    some = sum((F.size(k) for k in KINDS), F.lit(0)) > 0
    return rows.select("doc_id", "_text", *found).select("doc_id", *KINDS, F.when(some, F.col("_text")).alias("_text"))


def mentions(hits: DataFrame) -> DataFrame:
    """(doc_id, text hash, entities, terms): the distinct entities and terms of every document with entities, addresses blanked out."""
    normal = {"email": F.lower, "ip": lambda v: v, "card": _digits, "phone": _digits}

    def named(kind: str) -> Column:
        return F.transform(kind, lambda s: F.xxhash64(F.lit(kind), normal[kind](s["value"])))

    entities = F.array_distinct(F.concat(*[named(k) for k in KINDS]))
    terms = F.array_distinct(F.regexp_extract_all(F.regexp_replace("_text", EMAIL, " "), F.lit(TERM), F.lit(0)))
    rows = hits.where(F.col("_text").isNotNull() & F.col("doc_id").isNotNull())
    return rows.select("doc_id", F.xxhash64("_text").alias("body"), entities.alias("entities"), F.filter(terms, lambda t: F.length(t) >= 3).alias("terms"))


def disclosing(hits: DataFrame, told: DataFrame, docs: DataFrame) -> DataFrame:
    """(entity, term, disclosure) of pairs at ``GENERALISE`` or more; counts run over all documents."""
    total = float(hits.count())
    in_texts = lambda name: F.count_distinct("body").alias(name)
    named = told.select("doc_id", "body", F.explode("entities").alias("entity")).distinct()
    entities = named.groupBy("entity").agg(F.count_distinct("doc_id").alias("df_entity"), in_texts("texts")).where(F.col("texts") >= MIN_TEXTS)
    # A pair meets in no more documents than mention the entity, so a term in more than this many discloses too little.
    most = F.pow(F.col("df_entity"), F.lit(GENERALISE)) * total ** (1 - GENERALISE) * (1 + 1e-9)
    entities = materialize(entities.select("entity", "df_entity", most.alias("most")), "pii-entities")
    # A term is in at least as many documents as mention it with any entity; that bounds its disclosure from above, so
    # common words leave before they are paired and before the count over the corpus.
    words = told.select("doc_id", "body", F.explode("terms").alias("term")).distinct()
    words = words.groupBy("term").agg(F.count_distinct("doc_id").alias("least"), in_texts("texts")).where(F.col("texts") >= MIN_TEXTS)
    words = materialize(words.where(F.col("least") <= entities.agg(F.max("most")).scalar()).select("term", "least"), "pii-words")
    left = materialize(_of_entities(told, entities).join(_of_terms(told, words), ["doc_id", "body"]).where("least <= most"), "pii-meetings")
    info = F.log(total / F.col("df_entity"))
    disclosure = lambda df: F.when(info > 0, F.log(F.col("joint") * total / (F.col("df_entity") * F.col(df))) / info).otherwise(0.0)
    pairs = left.groupBy("entity", "term", "df_entity", "least").agg(F.count_distinct("doc_id").alias("joint"), in_texts("texts")).where(F.col("texts") >= MIN_TEXTS)
    pairs = materialize(pairs.where(disclosure("least") >= GENERALISE).select("entity", "term", "joint", "df_entity"), "pii-pairs")
    wanted = materialize(pairs.select("term").distinct(), "pii-terms")
    if wanted.isEmpty():
        return pairs.select("entity", "term", F.lit(0.0).alias("disclosure")).limit(0)
    # The outer form, since for the inner one Catalyst would run the pattern a second time as a filter.
    terms = docs.select(F.explode_outer(F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(TERM), F.lit(0)))).alias("term"))
    df = terms.join(wanted, "term").groupBy("term").agg(F.count("*").alias("df_term"))
    scored = pairs.join(df, "term").withColumn("disclosure", disclosure("df_term"))
    return scored.where(F.col("disclosure") >= GENERALISE).select("entity", "term", "disclosure")


def _of_entities(told: DataFrame, entities: DataFrame) -> DataFrame:
    """doc_id, body and entity of the mentions of ``entities``, with the columns of that; others leave at the scan."""
    rows = told.select("doc_id", "body", F.explode("entities").alias("entity")).where(bitmap.may_contain(entities, "entity", F.col("entity")))
    return rows.distinct().join(entities, "entity")


def _of_terms(told: DataFrame, words: DataFrame) -> DataFrame:
    """The same for the terms in ``words``."""
    rows = told.select("doc_id", "body", F.explode("terms").alias("term")).where(bitmap.may_contain(words, "term", F.col("term")))
    return rows.distinct().join(words, "term")


def document_terms(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """(doc_id, generalised, removed): the terms to treat in each document that mentions what they disclose."""
    told = materialize(mentions(hits), "pii-mentions")
    found = materialize(disclosing(hits, told, docs), "pii-disclosing")
    named = _of_entities(told, found.select("entity").distinct()).select("doc_id", "entity").distinct()
    words = _of_terms(told, found.select("term").distinct()).select("doc_id", "term").distinct()
    per = named.join(words, "doc_id").join(found, ["entity", "term"]).groupBy("doc_id", "term").agg(F.max("disclosure").alias("d"))
    pick = lambda keep: F.sort_array(F.collect_list(F.when(keep, F.col("term"))))
    out = per.groupBy("doc_id").agg(pick(F.col("d") < REMOVE).alias("generalised"), pick(F.col("d") >= REMOVE).alias("removed"))
    return materialize(out, "pii-document-terms")


def _pattern(terms: Column) -> Column:
    """Any of the terms as a whole word, the longest first."""
    longest = F.transform(F.sort_array(F.transform(terms, lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))), asc=False), lambda x: x["t"])
    return F.concat(F.lit("(?<![\\p{L}\\p{N}])(?:"), F.array_join(longest, "|"), F.lit(")(?![\\p{L}\\p{N}])"))


def find(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, base spans by kind, term spans, and the digests of the span list."""
    hits = materialize(base_spans(docs), "pii-base")
    rows = bitmap.left_join(hits, document_terms(docs, hits), "doc_id")
    terms = F.concat(F.coalesce("generalised", F.array().cast("array<string>")), F.coalesce("removed", F.array().cast("array<string>")))
    rows = rows.withColumn("_terms", terms)
    base = F.concat(*KINDS)
    free = lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    term = F.when((F.size("_terms") > 0) & F.col("_text").isNotNull(), F.filter(_spans(F.col("_text"), _pattern(F.col("_terms"))), free))
    rows = rows.withColumn("term", F.coalesce(term, F.array().cast(SPAN)))
    told = lambda k: F.transform(k, lambda s: F.concat_ws(":", F.lit(k), s["start"].cast("string"), s["end"].cast("string")))
    own = F.array_join(F.concat(*[told(k) for k in KINDS]), ",")
    return rows.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in [*KINDS, "term"]],
        F.sha2(own, 256).alias("base_sha256"),
        F.array_join(F.concat(*[told(k) for k in [*KINDS, "term"]]), ",").alias("spans"),
    )


def _tagged(text: Column, pattern: str, valid, tag: str) -> Column:
    """``text`` with valid matches replaced; others stay."""
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
    new = F.transform(both, lambda x: F.concat(x["gap"], F.when(x["match"].isNull(), "").when(valid(x["match"]), F.lit(tag)).otherwise(x["match"])))
    return F.array_join(new, "")


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with base spans replaced by tags and disclosing terms generalised or removed; columns as they were.

    Texts stay where they are: only those of documents with disclosing terms go through a join. The caller's columns
    travel in a struct, so they may have any name.
    """
    hits = materialize(base_spans(docs), "pii-base")
    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = bitmap.left_join(packed, document_terms(docs, hits), "doc_id")
    for kind in ("email", "phone", "card", "ip"):
        pattern, may, valid, tag = KINDS[kind]
        rows = rows.withColumn("text", F.when(may(F.col("text")), _tagged(F.col("text"), pattern, valid, tag)).otherwise(F.col("text")))
    for column, tag in (("generalised", "[TERM]"), ("removed", "")):
        rows = rows.withColumn("text", F.when(F.size(column) > 0, F.regexp_replace(F.col("text"), _pattern(F.col(column)), F.lit(tag))).otherwise(F.col("text")))

    def own(name: str) -> Column:
        old = F.col("row").getField(name)
        if name == "text":
            return F.col("text").alias(name)
        if name == "n_chars":
            changed = ~F.col("text").eqNullSafe(F.col("row").getField("text"))
            return F.when(changed, F.length("text").cast(docs.schema[name].dataType)).otherwise(old).alias(name)
        return old.alias(name)

    return rows.select(*[own(c) for c in docs.columns])
