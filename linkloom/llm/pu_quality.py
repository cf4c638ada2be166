"""Quality scores by positive-unlabelled learning.

Trusted positives (labels with quality 1) and unlabelled documents of the corpus train a logistic model of text
statistics. With the class prior pi, the risk

    pi * E_P[l(f)] + max(0, E_U[l(-f)] - pi * E_P[l(-f)])

is minimised: the non-negative form of the unbiased risk (Kiryo et al., 2017), whose second part is ascended instead
where it falls below zero. Labels of negatives are not used. The prior is estimated from positives and unlabelled rows
alone: a first model tells one from the other, and on rows it has not seen the smallest ratio of the share of unlabelled
to the share of positive rows above a cutoff, with a margin for sampling, bounds pi (best bin estimation).

The model is fitted on at most ``positives`` and about ``unlabelled`` documents (documented bounds). Defined cases:
null and empty texts have zero statistics and a score; without positives every score is 0.5; with one positive or one
unlabelled row the prior is 0.5; repeated rows score alike;
null ids stay null and ids keep all digits; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import string
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.arrow import map_text
from linkloom.llm.sampling import labelled_sample, plain_sample

_MARKS = string.punctuation
WIDTH = 14 + len(_MARKS)


def statistics(text: str) -> list[float]:
    """Shape of one text: shares of character kinds, lengths, repetition. Every value is finite."""
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * WIDTH
    inked = sum(map(len, words))
    lengths = [len(w) for w in words]
    distinct, lines = len(set(words)), [x for x in text.split("\n") if x.strip()]
    common = Counter(words).most_common(1)[0][1]
    runs = Counter(zip(words, words[1:], words[2:], strict=False))
    repeated = sum(c for c in runs.values() if c > 1) / max(1, n - 2)
    lower, upper = sum(map(str.islower, text)), sum(map(str.isupper, text))
    digits = sum(map(str.isdigit, text))
    mean = inked / n
    spread = (sum((x - mean) ** 2 for x in lengths) / n) ** 0.5
    own = [
        np.log1p(n), mean / 10, spread / 10, max(lengths) / (max(lengths) + 50), distinct / n, np.log(distinct) / max(np.log(n), 1.0), common / n,
        repeated, 1 - len(set(lines)) / max(1, len(lines)), upper / max(1, upper + lower), (upper + lower) / inked, digits / inked, len(lines) / n, 1 - inked / chars,
    ]
    return own + [np.log1p(100 * text.count(c) / inked) for c in _MARKS]


def _features(texts: list[str]) -> list[list]:
    return [[r.tobytes() for r in np.array([statistics(t) for t in texts], dtype=np.float32).reshape(len(texts), WIDTH)]]


def _gather(rows: DataFrame) -> np.ndarray:
    """Statistics of sampled rows, in an order that no partitioning changes."""
    rows = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    found = map_text(rows, "text", [("x", "binary")], _features).toPandas().sort_values(["doc_id", "x"])
    return np.frombuffer(b"".join(found["x"]), dtype=np.float32).reshape(len(found), WIDTH).astype(float)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _descend(gradient, width: int, steps: int, rate: float = 0.05) -> np.ndarray:
    """Adam from zero with a falling rate."""
    w, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def estimate_prior(pos: np.ndarray, unl: np.ndarray, steps: int = 300, delta: float = 0.1) -> float:
    """Share of positives among the unlabelled rows, from alternate rows: half train, half estimate."""
    p, u, hp, hu = pos[::2], unl[::2], pos[1::2], unl[1::2]

    def gradient(w: np.ndarray) -> np.ndarray:
        return (-(p.T @ (1 - _sigmoid(p @ w))) / len(p) + u.T @ _sigmoid(u @ w) / len(u)) / 2 + 1e-3 * w

    w = _descend(gradient, pos.shape[1], steps)
    sp, su = np.sort(hp @ w), np.sort(hu @ w)
    cut = np.unique(sp)
    qp = 1 - np.searchsorted(sp, cut) / len(sp)
    qu = 1 - np.searchsorted(su, cut) / len(su)
    margin = np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(len(su)) + 1 / np.sqrt(len(sp)))
    best = int(np.argmin((qu + margin) / np.maximum(qp, 1e-9)))
    return float(np.clip(qu[best] / max(qp[best], 1e-9), 0.01, 0.99))


def train(pos: np.ndarray, unl: np.ndarray, prior: float, steps: int = 500, decay: float = 3e-4) -> np.ndarray:
    """Weights of the minimiser of the non-negative risk with logistic loss."""

    def gradient(w: np.ndarray) -> np.ndarray:
        zp, zu = pos @ w, unl @ w
        gain = -(pos.T @ (1 - _sigmoid(zp))) * prior / len(pos)
        rest = unl.T @ _sigmoid(zu) / len(unl) - prior * (pos.T @ _sigmoid(zp)) / len(pos)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean() < 0
        return (-rest if negative else gain + rest) + decay * w

    return _descend(gradient, pos.shape[1], steps)


def _design(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -8, 8)
    return np.hstack([np.ones((len(z), 1)), z, z * z / 4])


def fit(docs: DataFrame, labels: DataFrame, positives: int = 8_000, unlabelled: int = 16_000) -> dict:
    """Model as plain arrays, with the estimated prior under ``prior``."""
    good = labels.where("quality = 1 or quality = 0")
    known = labelled_sample(docs, good, "quality", positives)
    pos = _gather(known.where("y = 1").select("doc_id", "text"))
    unl = _gather(plain_sample(docs, unlabelled))
    if not len(pos) or not len(unl):
        return {"prior": 0.5}
    mean, scale = unl.mean(axis=0), unl.std(axis=0) + 1e-3
    xp, xu = _design(pos, mean, scale), _design(unl, mean, scale)
    prior = estimate_prior(xp, xu) if min(len(xp), len(xu)) > 1 else 0.5
    return {"prior": prior, "mean": mean, "scale": scale, "weights": train(xp, xu, prior)}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) of every row."""

    def run(texts: list[str]) -> list[list]:
        if "weights" not in model:
            return [[0.5] * len(texts)]
        x = np.array([statistics(t) for t in texts]).reshape(len(texts), WIDTH)
        return [_sigmoid(_design(x, model["mean"], model["scale"]) @ model["weights"])]

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return map_text(rows, "text", [("score", "double")], run)
