"""The queries as registered: against DuckDB where there is SQL, and their digests against plain Python where there is none."""

import hashlib
import re
import zlib

import duckdb
import pytest

from linkloom.llm import queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def key(row):
    return tuple((v is None, str(v)) for v in row)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_rows_match_sql(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    want = duck.sql(queries.oracle_sql()[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=key)


def test_scores_of_every_document(spark):
    ids = sorted(r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    for name, folds, rest, cut in (("op6_quality_scores", 5, 0, 0.3), ("op9_toxicity", 3, 1, 0.7)):
        rows = queries.queries()[name](spark, SF).collect()
        assert sorted(r["doc_id"] for r in rows) == ids
        for r in rows:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == rest)
            assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut)


def test_spans_of_every_document(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    rows = queries.queries()["op3_pii_spans"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        own = [s for s in r["spans"].split(",") if s and not s.startswith("term")]
        assert [s for s in own if s.startswith("email")] == [f"email:{m.start()}:{m.end()}" for m in email.finditer(texts[r["doc_id"]])]
        assert r["base_sha256"] == hashlib.sha256(",".join(own).encode()).hexdigest() and len(own) == r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"]


def test_mixed_words_meet_targets(spark):
    rows = queries.queries()["op8_source_mixing"](spark, SF).collect()
    texts = {r["doc_id"]: (r["source"], len(WORD.findall(r["text"] or ""))) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sizes = {s: sum(n for t, n in texts.values() if t == s) for s, _ in texts.values()}
    assert sum(r["target"] for r in {r["source"]: r for r in rows}.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for s, size in sizes.items():
        own = [r for r in rows if r["source"] == s]
        assert {r["source_size"] for r in own} == {size} and abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
        assert all(r["size"] == texts[r["doc_id"]][1] and r["taken"] <= 2 * r["size"] for r in own)
