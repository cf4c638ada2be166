"""DuckDB SQL of the queries that SQL can express, over the same whole tables.

Words are cut at space and U+0009 to U+000D as everywhere in this subpackage. The SQL states the rules again from their
definitions: window counts by joining windows, tails by summing binomial terms, links by counting common shingles of all
pairs that share one, walks by a recursion over their steps.
"""

from __future__ import annotations

from linkloom.llm import decontaminate, neardup, quality_rules, url_filter

#: The words of a text in DuckDB; empty for null.
_WORDS = "list_filter(regexp_split_to_array(coalesce({}, ''), '[ \\t-\\r]+'), lambda w: w <> '')"
#: A-Z alone in lower case, as the contract of op10 has it.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _shingles(table: str, key: str, name: str, lower: str, width: int = 5) -> str:
    """CTEs ``name`` (key, s): the distinct shingles of every row with a key; shorter texts are one shingle."""
    return f"""
{name}_words AS (SELECT row_number() OVER () AS row_id, {key}, {_WORDS.format(lower)} AS w FROM {table}),
{name} AS (
  SELECT DISTINCT row_id, {key}, array_to_string(list_slice(w, i, i + {width - 1}), ' ') AS s FROM (SELECT row_id, {key}, w, unnest(range(1, len(w) - {width - 2})) AS i FROM {name}_words WHERE len(w) >= {width})
  UNION ALL SELECT row_id, {key}, array_to_string(w, ' ') FROM {name}_words WHERE len(w) BETWEEN 1 AND {width - 1})"""


def quality(alpha: float = 0.03, delta: float = 0.05, good_weight: float = 10.0) -> str:
    rules = quality_rules.RULES
    letters = "len(regexp_replace(coalesce(text, ''), '[^{0}]+', '', 'g'))"
    share = lambda r: f"({r.top} / nullif({r.bottom}, 0))"
    rejects = lambda r, c: f"coalesce({share(r)} {'>=' if r.high else '<='} {c}, false)"
    grid = " UNION ALL ".join(f"SELECT {i} AS rule, {j} AS step, CAST({c} AS DOUBLE) AS cutoff" for i, r in enumerate(rules) for j, c in enumerate(r.cutoffs))
    hit = "CASE c.rule " + " ".join(f"WHEN {i} THEN {rejects(r, 'c.cutoff')}" for i, r in enumerate(rules)) + " END"
    failed = ", ".join(f"CASE WHEN {rejects(r, f'cut{i}')} THEN '{r.name}' END" for i, r in enumerate(rules))
    cuts = ", ".join(f"max(CASE WHEN rule = {i} THEN cutoff END) AS cut{i}" for i in range(len(rules)))
    p = alpha / len(rules)
    return f"""
WITH texts AS (SELECT row_number() OVER () AS row_id, doc_id, lang, text, {_WORDS.format('text')} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) AS lines FROM documents),
windows AS (SELECT row_id, i, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (SELECT row_id, w, unnest(range(1, len(w) - 3)) AS i FROM texts WHERE len(w) >= 5)),
twice AS (SELECT row_id, i FROM (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, s) AS n FROM windows) WHERE n > 1),
covered AS (SELECT row_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2), (3), (4)) AS v(k) GROUP BY row_id),
base AS (
  SELECT t.row_id, doc_id, lang, hash(coalesce(text, '')) AS body, len(w) AS n_words, CAST(len(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST({letters.format('#*$%&|<>')} AS BIGINT) AS n_symbols,
    CAST({letters.format('\\p{Lu}')} AS BIGINT) AS n_upper, len(list_distinct(w)) AS n_distinct_words, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM texts t LEFT JOIN covered c ON c.row_id = t.row_id),
measured AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base),
agreed AS (SELECT doc_id, min(quality) AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) = max(quality)),
trials AS (SELECT DISTINCT ON (m.lang, a.good, m.body) m.*, a.good FROM measured m JOIN agreed a ON a.doc_id = m.doc_id WHERE NOT m.base_failed),
grid AS ({grid}),
counted AS (SELECT t.lang, c.rule, c.step, c.cutoff, sum(CASE WHEN good = 1 THEN 1 ELSE 0 END) AS n, sum(CASE WHEN good = 1 AND {hit} THEN 1 ELSE 0 END) AS k, sum(CASE WHEN good = 0 AND {hit} THEN 1 ELSE 0 END) AS bad FROM trials t, grid c GROUP BY ALL),
tails AS (
  SELECT *, bad - {good_weight} * k AS gain, count(*) OVER (PARTITION BY rule, step) AS strata,
    CASE WHEN k < n * {p} THEN list_sum(list_transform(range(0, CAST(k AS BIGINT) + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p})))) ELSE 1.0 END AS tail FROM counted),
walked AS (SELECT *, bool_and(tail <= {delta} / ({len(rules)} * strata)) OVER (PARTITION BY lang, rule ORDER BY step) AS ok FROM tails),
best AS (SELECT lang, rule, cutoff FROM walked WHERE ok AND gain > 0 QUALIFY row_number() OVER (PARTITION BY lang, rule ORDER BY gain DESC, step) = 1),
cuts AS (SELECT lang, {cuts} FROM best GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND len(failed) = 0 AS kept, array_to_string(failed, ',') AS failed_rules FROM (
  SELECT m.*, list_filter([{failed}], lambda x: x IS NOT NULL) AS failed FROM measured m LEFT JOIN cuts c ON c.lang IS NOT DISTINCT FROM m.lang)"""


def urls(damping: float = 0.85, threshold: float = 0.5, steps: int = 120) -> str:
    host, path = "regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)", "regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    rules = ", ".join(f"('{v}', '{h}', '{p}', {i})" for i, (v, h, p) in enumerate(url_filter.RULES))
    return f"""
WITH RECURSIVE rules(verdict, h, p, i) AS (VALUES {rules}),
rows_ AS (SELECT row_number() OVER () AS row_id, page_id, {_LOWER.format(host)} AS host, {path} AS path, coalesce(html, '') AS html FROM pages),
fits AS (SELECT r.row_id, x.verdict, x.h || x.p AS rule FROM rows_ r JOIN rules x ON (r.host = x.h OR ends_with(r.host, '.' || x.h)) AND starts_with(r.path, x.p) QUALIFY row_number() OVER (PARTITION BY r.row_id ORDER BY length(x.h || x.p) DESC, x.i) = 1),
judged AS (SELECT r.*, f.verdict, f.rule FROM rows_ r LEFT JOIN fits f ON f.row_id = r.row_id),
balance AS (SELECT host, sum(CASE verdict WHEN 'allow' THEN 1 WHEN 'block' THEN -1 ELSE 0 END) / count(*) AS b FROM judged WHERE host <> '' GROUP BY host),
seeds AS (SELECT CASE WHEN b > 0 THEN 'trust' ELSE 'distrust' END AS kind, host, abs(b) AS mass FROM balance WHERE b <> 0),
hrefs AS (SELECT host, unnest(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']?((?:[a-z][a-z0-9+.-]*:)?//[^\\s"''<>]+)', 1)) AS href FROM rows_),
edges AS (SELECT host AS source, {_LOWER.format("regexp_extract(CASE WHEN starts_with(href, '//') THEN 'http:' || href ELSE href END, '^.*?://([^/?#]*)', 1)")} AS target FROM hrefs),
weights AS (SELECT source, target, count(*) AS weight FROM edges WHERE source <> '' AND target <> '' AND source <> target GROUP BY source, target),
ways AS (SELECT kind, host, to_, weight / sum(weight) OVER (PARTITION BY kind, host) AS share FROM (SELECT 'trust' AS kind, source AS host, target AS to_, weight FROM weights UNION ALL SELECT 'distrust', target, source, weight FROM weights)),
walk(step, kind, host, mass) AS (SELECT 0, kind, host, CAST(mass AS DOUBLE) FROM seeds UNION ALL SELECT any_value(w.step) + 1, w.kind, y.to_, sum({damping} * w.mass * y.share) FROM walk w JOIN ways y ON y.kind = w.kind AND y.host = w.host WHERE w.step < {steps} GROUP BY w.kind, y.to_),
blocked AS (SELECT host FROM walk GROUP BY host HAVING sum(CASE WHEN kind = 'distrust' THEN mass ELSE -mass END) > {threshold})
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN host IN (SELECT host FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict FROM judged"""


def containment(percent: int = decontaminate.PERCENT) -> str:
    return f"""
WITH {_shingles('documents', 'doc_id', 'd', 'lower(text)')}, {_shingles('benchmark', 'item_id', 'b', 'lower(text)')},
sizes AS (SELECT row_id, item_id, count(*) AS n FROM b WHERE item_id IS NOT NULL GROUP BY row_id, item_id),
shared AS (SELECT d.doc_id, d.row_id AS doc_row, b.item_id, b.row_id AS item_row, count(*) AS n_shared FROM d JOIN b ON b.s = d.s WHERE d.doc_id IS NOT NULL AND b.item_id IS NOT NULL GROUP BY ALL),
found AS (SELECT x.doc_id, x.item_id, z.n, x.n_shared FROM shared x JOIN sizes z ON z.row_id = x.item_row WHERE 100 * x.n_shared >= {percent} * z.n)
SELECT doc_id, item_id, max(n) AS n_item, max(n_shared) AS n_shared, max(n_shared) / max(n) AS containment FROM found GROUP BY doc_id, item_id"""


def archives(min_revisit: int = 100) -> str:
    return f"""
WITH payloads AS (SELECT page_id, url, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT payload_digest, min(page_id) AS first, count(*) AS n FROM payloads WHERE payload_bytes >= {min_revisit} GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN n > 1 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n > 1 AND page_id IS DISTINCT FROM first THEN first END AS refers_to, url
FROM payloads p LEFT JOIN firsts f ON f.payload_digest = p.payload_digest"""


def near_duplicates(percent: int = neardup.PERCENT) -> str:
    """All pairs that share a shingle, counted; components by spreading the smallest document until nothing changes."""
    return f"""
WITH RECURSIVE {_shingles('documents', 'doc_id', 'd', _LOWER.format("coalesce(text, '')"))},
sizes AS (SELECT w.row_id, any_value(w.doc_id) AS doc_id, count(d.s) AS n FROM d_words w LEFT JOIN d ON d.row_id = w.row_id GROUP BY w.row_id),
common AS (SELECT a.row_id AS x, b.row_id AS y, count(*) AS i FROM d a JOIN d b ON a.s = b.s AND a.row_id < b.row_id GROUP BY a.row_id, b.row_id),
links AS (SELECT x, y FROM common JOIN sizes p ON p.row_id = x JOIN sizes q ON q.row_id = y WHERE 100 * i >= {percent} * (p.n + q.n - i)),
ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(a, b) AS (SELECT row_id, row_id FROM sizes UNION SELECT r.a, w.y FROM reach r JOIN ways w ON w.x = r.b),
classes AS (SELECT r.a, min(s.doc_id) AS component_id FROM reach r JOIN sizes s ON s.row_id = r.b GROUP BY r.a)
SELECT s.doc_id, s.n AS n_shingles, c.component_id, s.doc_id IS NOT DISTINCT FROM c.component_id AS kept FROM sizes s JOIN classes c ON c.a = s.row_id"""


def filter_audit() -> str:
    """Every part, order and step by counting its documents; orders are five letters picked without repeats."""
    masks = " + ".join(f"CAST({x} AS INTEGER) * {1 << i}" for i, x in enumerate("abcde"))
    bits = lambda text: "(" + " + ".join(f"CASE WHEN contains({text}, '{x}') THEN {1 << i} ELSE 0 END" for i, x in enumerate("ABCDE")) + ")"
    return f"""
WITH texts AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, {_WORDS.format('text')} AS w FROM documents),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
firsts AS (SELECT text, min(doc_id) AS first FROM texts GROUP BY text),
failed AS (
  SELECT part, t.doc_id, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b, 100 * len(regexp_replace(t.text, '[^A-Z]+', '', 'g')) > 5 * len(t.text) AS c,
    regexp_matches(t.text, '[#$%&*|]') AS d, coalesce(t.doc_id > f.first, false) AS e FROM texts t JOIN firsts f ON f.text = t.text),
judged AS (SELECT part, {masks} AS mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM failed f LEFT JOIN marks m ON m.doc_id = f.doc_id),
counts AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM judged GROUP BY part, mask),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letter a, letter b, letter c, letter d, letter e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, step, {bits("substr(filter_order, step, 1)")} AS own, {bits("substr(filter_order, 1, step - 1)")} AS gone FROM orders, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)),
out_ AS (
  SELECT part, filter_order, step, own, sum(CASE WHEN mask & (own | gone) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & own <> 0 AND mask & gone = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & own <> 0 AND mask & gone <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & own <> 0 AND mask & gone = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & own <> 0 AND mask & gone = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM counts, steps GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM out_"""


def exact_top_k(k: int = 5, every: int = 50) -> str:
    """All inner products of the stated queries, sorted."""
    return f"""
WITH whole AS (SELECT row_number() OVER () AS row_id, vec_id, embedding AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
ints AS (SELECT row_id, vec_id, list_transform(v, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM whole),
scored AS (SELECT q.row_id, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM ints q JOIN ints c ON c.row_id <> q.row_id AND len(c.v) = len(q.v) WHERE q.vec_id % {every} = 0)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, vec_id) AS r FROM scored) WHERE r <= {k}"""


def ranked_search(k: int = 10) -> str:
    """The score of every document for every item by its definition."""
    terms = f"regexp_extract_all({_LOWER.format('text')}, '[0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]+')"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce({terms}, []) AS terms FROM documents),
items AS (SELECT row_number() OVER () AS item_row, item_id, unnest({terms}) AS term FROM benchmark),
totals AS (SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM docs WHERE len(terms) > 0),
counted AS (SELECT row_id, term, count(*) AS tf FROM (SELECT row_id, unnest(terms) AS term FROM docs) WHERE term IN (SELECT term FROM items) GROUP BY row_id, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counted, totals GROUP BY term, n_docs),
lengths AS (SELECT row_id, doc_id, 100 - 75 + (75 * len(terms) * n_docs) // n_terms AS m FROM docs, totals WHERE len(terms) > 0),
impacts AS (SELECT c.row_id, c.term, w * ((1000000000 * tf) // (1000 * tf + 8 * m)) AS impact FROM counted c JOIN weights USING (term) JOIN lengths l ON l.row_id = c.row_id),
scored AS (SELECT item_row, any_value(item_id) AS item_id, row_id, CAST(sum(impact) AS BIGINT) AS score FROM items JOIN impacts USING (term) GROUP BY item_row, row_id)
SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_row ORDER BY score DESC, doc_id NULLS LAST, s.row_id) AS r FROM scored s JOIN lengths l ON l.row_id = s.row_id WHERE score > 0) WHERE r <= {k}"""
