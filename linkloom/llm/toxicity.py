"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Texts are lower-cased, with a space on either side. Every n-gram of 3 to 5 characters sets one of 2**20 buckets,
present or not. On labelled texts, ``r = log((p / |p|) / (q / |q|))`` compares how often a bucket occurs in toxic and
clean documents (add-one smoothing); buckets whose ratio is at least ``sure`` standard errors from 0 stay. A
logistic regression is then trained on the values ``r`` of present buckets, and its weights times ``r`` score a text.

The model is fitted on at most ``sample`` labelled documents (a documented bound); scoring reads every whole text in
slices of bounded size, split at no document. Defined cases: null and empty texts score like a text without n-grams;
without both classes among the labels every score is the share of toxic labels (0 without labels); repeated rows score
alike; null ids stay null and ids keep all digits; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.arrow import map_text
from linkloom.llm.sampling import labelled_sample
from linkloom.plans.scratch import materialize

ORDERS, LOG_BUCKETS = (3, 4, 5), 20
_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], dtype=np.uint32)


def grams(texts: list[str], keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(index of the text, bucket) of the distinct buckets of every text; with ``keep`` only buckets marked there."""
    joined = "\0".join(f" {t.lower().replace(chr(0), ' ')} " for t in texts)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.cumsum(code == 0, dtype=np.int32)
    found = []
    for n in ORDERS:
        if len(code) < n:
            continue
        size = len(code) - n + 1
        h = np.full(size, n, dtype=np.uint32)
        for k in range(n):
            h = (h ^ code[k : k + size]) * _ODD[k]
            h ^= h >> np.uint32(15)
        bucket = h >> np.uint32(32 - LOG_BUCKETS)
        good = owner[:size] == owner[n - 1 :]
        good &= code[:size] != 0
        if keep is not None:
            good &= keep[bucket]
        found.append((owner[:size][good].astype(np.int64) << LOG_BUCKETS) | bucket[good])
    both = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
    return both >> LOG_BUCKETS, both & ((1 << LOG_BUCKETS) - 1)


def _sketch(texts: list[str]) -> list[list]:
    owner, bucket = grams(texts)
    parts = np.split(bucket.astype(np.int32), np.searchsorted(owner, np.arange(1, len(texts))))
    return [[p.tobytes() for p in parts]]


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros((2, 1 << LOG_BUCKETS), dtype=np.int64)
    for batch in batches:
        for y, g in zip(batch["y"], batch["grams"], strict=True):
            total[int(y == 1), np.frombuffer(g, dtype=np.int32)] += 1
    at = np.flatnonzero(total.sum(axis=0))
    yield pd.DataFrame({"bucket": at, "clean": total[0, at], "toxic": total[1, at]})


def _logistic(owner: np.ndarray, column: np.ndarray, value: np.ndarray, y: np.ndarray, width: int, steps: int, decay: float) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L2-penalised logistic regression on sparse rows, by full-batch Adam."""
    w, b, rows = np.zeros(width), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))), len(y)
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(owner, value * w[column], minlength=rows) + b
        gap = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        g = np.bincount(column, value * gap[owner], minlength=width) / rows + decay * w
        gb = gap.mean()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.03 * min(1.0, 2 * (1 - t / (steps + 1)))
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    return w, b


def fit(docs: DataFrame, labels: DataFrame, sample: int = 12_000, features: int = 20_000, least: int = 4, sure: float = 4.0, steps: int = 250, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray, float]:
    """(buckets, weights, intercept). Reaches the driver: bucket counts (2**20 at most) and sampled rows cut to the features."""
    sketched = labelled_sample(docs, labels, "toxic", sample).select("doc_id", F.col("y").cast("int").alias("y"), "text")
    sketched = materialize(map_text(sketched, "text", [("grams", "binary")], _sketch), "toxic-grams")
    sizes = {int(r["y"] == 1): r["n"] for r in sketched.groupBy((F.col("y") == 1).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not clean or not toxic:
        share = min(max(toxic / max(1, toxic + clean), 1e-9), 1 - 1e-9)
        return np.zeros(0, dtype=np.int64), np.zeros(0), float(np.log(share / (1 - share)))
    counted = sketched.mapInPandas(_counts, "bucket bigint, clean bigint, toxic bigint").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    table = counted.where(F.col("clean") + F.col("toxic") >= least).toPandas().sort_values("bucket")
    p, q = (table["toxic"].to_numpy() + 1) / (toxic + 2), (table["clean"].to_numpy() + 1) / (clean + 2)
    ratio = np.log(p / q)
    # In units of its standard error; below ``sure`` a ratio is noise that a regression would only memorise.
    strength = np.abs(ratio) / np.sqrt(1 / (table["toxic"].to_numpy() + 1) + 1 / (table["clean"].to_numpy() + 1))
    order = np.argsort(-strength, kind="stable")[:features]
    order = order[strength[order] >= sure]
    buckets, ratio = table["bucket"].to_numpy()[order], ratio[order]
    place = np.full(1 << LOG_BUCKETS, -1, dtype=np.int32)
    place[buckets] = np.arange(len(buckets))

    def cut(found: list[bytes]) -> list[list]:
        own = [place[np.frombuffer(g, dtype=np.int32)] for g in found]
        return [[c[c >= 0].tobytes() for c in own]]

    rows = map_text(sketched, "grams", [("grams", "binary")], cut).toPandas().sort_values("doc_id")
    columns = [np.frombuffer(g, dtype=np.int32) for g in rows["grams"]]
    owner, column = np.repeat(np.arange(len(rows)), [len(c) for c in columns]), np.concatenate(columns)
    w, b = _logistic(owner, column, ratio[column], (rows["y"].to_numpy() == 1).astype(float), len(buckets), steps, decay)
    return buckets, w * ratio, b


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """(doc_id, score) of every row."""
    buckets, weights, intercept = model

    def run(texts: list[str]) -> list[list]:
        table = np.zeros(1 << LOG_BUCKETS)
        table[buckets] = weights
        owner, bucket = grams(texts, table != 0)
        z = np.bincount(owner, table[bucket], minlength=len(texts)) + intercept
        return [1 / (1 + np.exp(-np.clip(z, -40, 40)))]

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return map_text(rows, "text", [("score", "double")], run)
