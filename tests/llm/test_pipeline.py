"""The pipeline's stages against brute force on the smallest tables, and the entry point with and without the subpackage."""

import collections
import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import corpus_pipeline
from linkloom.plans.scratch import materialize, shared_root

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(text.lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, before = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "minhash_near_dedup", "benchmark_decontamination", "pii", "source_mixing"]
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), name)
        out[name] = {r["doc_id"]: r for r in docs.collect()}
        if name != "source_mixing":
            assert docs.columns == names
        assert set(out[name]) <= set(before)
        before = out[name]
    kept = {i: shingles(r["text"]) for i, r in out["minhash_near_dedup"].items()}
    for i, a in kept.items():
        assert not any(j < i and a and 100 * len(a & b) >= 75 * len(a | b) for j, b in kept.items())
    items = [shingles(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for i, a in kept.items():
        leaks = any(s and 100 * len(s & a) >= 75 * len(s) for s in items)
        assert leaks == (i not in out["benchmark_decontamination"])
    for i, r in out["pii"].items():
        old = out["benchmark_decontamination"][i]["text"]
        assert "@mail" not in r["text"] and (r["text"] == old) == (not re.search(r"\[(EMAIL|PHONE|CARD|IP|TERM)\]", r["text"]))
    assert docs.columns == [*names, "copy"]
    copies = collections.Counter(r["doc_id"] for r in docs.collect())
    assert set(copies) <= set(out["pii"]) and set(copies.values()) <= {1, 2}
    assert all(out["source_mixing"][i]["text"] == out["pii"][i]["text"] for i in copies)
    words = lambda rows: sum(len(WORD.findall(r["text"])) for r in rows)
    assert words(docs.collect()) == pytest.approx(1.5 * words(out["pii"].values()), rel=0.05)


def test_run_takes_odd_rows_and_leaves_one_table(spark, tmp_path):
    """Null ids, texts and sources, repeated rows and an empty table; afterwards only the result's folder is left."""
    plain = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "a b c d e f g h i j k l m", None, None, 25), (7, "", "en", "s", 0), (7, "", "en", "s", 0)], plain.schema)
    for t in ("labels", "benchmark"):
        shutil.copy(f"{SF}/{t}.parquet", tmp_path)
    for name, docs in (("some", plain.unionByName(odd)), ("none", plain.limit(0))):
        docs.coalesce(2).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        root = Path(shared_root(spark).removeprefix("file://")) / "linkloom"
        before = {f.name for f in root.iterdir()} if root.exists() else set()
        out = corpus_pipeline.run(spark, str(tmp_path))
        assert out.count() > 0 if name == "some" else out.count() == 0
        left = {f.name for f in root.iterdir()} - before
        assert len(left) == 1 and left.pop().startswith("source_mixing")


def test_the_rest_works_without_the_subpackage(tmp_path):
    for name in ("linkloom", "__spark_entry__.py"):
        source = ROOT / name
        shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if source.is_dir() else shutil.copy(source, tmp_path)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert 'candidate_retrieval' in q and 'pipeline' not in q and set(s) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})
