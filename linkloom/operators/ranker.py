"""A learned ranker: gradient boosted trees on LambdaRank gradients, with monotone features and early stopping.

Training rows of one tenant (labelled pairs, a few per source page) are gathered in the driver, up to ``MOST`` rows; scoring
runs over any table in Arrow batches. Without enough groups there is no model, and the baseline score stays in place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Training rows at most; groups below which no model is trained.
MOST, LEAST_TRAIN, LEAST_TEST = 2_000_000, 100, 30


@dataclass
class Tree:
    """Nodes in order: the feature (-1: leaf), the bin that goes left, whether a missing value does, the children, the value, the gain."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        for name, x in (("feature", -1), ("bin", 0), ("missing_left", False), ("left", -1), ("right", -1), ("value", value), ("gain", 0.0)):
            getattr(self, name).append(x)
        return len(self.value) - 1


@dataclass
class Model:
    columns: list[str]
    edges: list[np.ndarray]
    trees: list[Tree]
    rate: float

    def importance(self) -> dict[str, float]:
        """Share of each column in the gain of all splits."""
        total = dict.fromkeys(self.columns, 0.0)
        for t in self.trees:
            for f, g in zip(t.feature, t.gain, strict=True):
                if f >= 0:
                    total[self.columns[f]] += g
        every = sum(total.values())
        return {c: g / every if every else 0.0 for c, g in total.items()}

    def dominant(self, share: float = 0.6) -> str | None:
        """The column with more than that share of the gain."""
        return next((c for c, g in self.importance().items() if g > share), None)

    def predict(self, x: np.ndarray) -> np.ndarray:
        binned, out = _binned(x, self.edges), np.zeros(len(x))
        for t in self.trees:
            out += self.rate * _walk(t, binned)
        return out

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """Per row and column what its splits moved the score by, and a last column for the start: a row adds up to its score."""
        binned, out = _binned(x, self.edges), np.zeros((len(x), len(self.columns) + 1))
        for t in self.trees:
            node = np.zeros(len(x), dtype=int)
            value, feature = np.array(t.value), np.array(t.feature)
            out[:, -1] += self.rate * value[0]
            while (open_ := feature[node] >= 0).any():
                rows = np.flatnonzero(open_)
                after = _step(t, binned, node, rows)
                np.add.at(out, (rows, feature[node[rows]]), self.rate * (value[after] - value[node[rows]]))
                node[rows] = after
        return out


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin of every value; missing ones are -1."""
    out = np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)], axis=1) if len(edges) else np.zeros((len(x), 0), dtype=int)
    return np.where(np.isnan(x), -1, out)


def _step(t: Tree, binned: np.ndarray, node: np.ndarray, rows: np.ndarray) -> np.ndarray:
    at = node[rows]
    b = binned[rows, np.array(t.feature)[at]]
    goes = np.where(b < 0, np.array(t.missing_left)[at], b <= np.array(t.bin)[at])
    return np.where(goes, np.array(t.left)[at], np.array(t.right)[at])


def _walk(t: Tree, binned: np.ndarray) -> np.ndarray:
    node, feature = np.zeros(len(binned), dtype=int), np.array(t.feature)
    while (open_ := feature[node] >= 0).any():
        rows = np.flatnonzero(open_)
        node[rows] = _step(t, binned, node, rows)
    return np.array(t.value)[node]


def ndcg(label: np.ndarray, score: np.ndarray, sizes: np.ndarray, k: int = 10) -> float:
    """Mean NDCG at ``k`` of the groups with a relevant row."""
    found, start = [], 0
    for n in sizes.tolist():
        y, s = label[start : start + n], score[start : start + n]
        start += n
        if (y > 0).any():
            discount = 1 / np.log2(np.arange(2, min(k, n) + 2))
            gain = 2.0**y - 1
            order = np.argsort(-s, kind="stable")[:k]
            found.append((gain[order] * discount).sum() / (np.sort(gain)[::-1][:k] * discount).sum())
    return float(np.mean(found)) if found else 0.0


def _lambdas(label: np.ndarray, score: np.ndarray, sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of every row: pairs of a group, weighted by how much swapping them moves NDCG at ``k``."""
    grad, hess, start = np.zeros(len(label)), np.full(len(label), 1e-9), 0
    for n in sizes.tolist():
        at = slice(start, start + n)
        start += n
        y, s = label[at], score[at]
        gain = 2.0**y - 1
        best = (np.sort(gain)[::-1][:k] / np.log2(np.arange(2, min(k, n) + 2))).sum()
        if best <= 0 or (y == y[0]).all():
            continue
        rank = np.empty(n)
        rank[np.argsort(-s, kind="stable")] = np.arange(n)
        discount = np.where(rank < k, 1 / np.log2(rank + 2), 0.0)
        better = y[:, None] > y[None, :]
        weight = np.abs((gain[:, None] - gain[None, :]) * (discount[:, None] - discount[None, :])) / best
        miss = 1 / (1 + np.exp(np.clip(s[:, None] - s[None, :], -40, 40)))
        push, bend = np.where(better, weight * miss, 0.0), np.where(better, weight * miss * (1 - miss), 0.0)
        grad[at] += push.sum(axis=1) - push.sum(axis=0)
        hess[at] += bend.sum(axis=1) + bend.sum(axis=0)
    return grad, hess


def _grow(binned: np.ndarray, widths: list[int], grad: np.ndarray, hess: np.ndarray, leaves: int, least: int, signs: np.ndarray, soft: float) -> Tree:
    """One tree, the leaf of the greatest gain first; values stay between the bounds that monotone splits above set."""
    tree = Tree()
    value = lambda g, h, lo, hi: float(np.clip(g / (h + soft), lo, hi))

    def best(rows: np.ndarray, lo: float, hi: float) -> tuple | None:
        g, h = grad[rows].sum(), hess[rows].sum()
        found = None
        for f, width in enumerate(widths):
            b = binned[rows, f] + 1
            gs, hs, ns = (np.bincount(b, w, minlength=width + 2) for w in (grad[rows], hess[rows], None))
            for missing_left in (False, True) if ns[0] else (False,):
                gl, hl, nl = (np.cumsum(x[1:])[:-1] + (x[0] if missing_left else 0) for x in (gs, hs, ns))
                ok = (nl >= least) & (len(rows) - nl >= least)
                vl, vr = np.clip(gl / (hl + soft), lo, hi), np.clip((g - gl) / (h - hl + soft), lo, hi)
                if signs[f]:
                    ok &= signs[f] * (vr - vl) >= 0
                if ok.any():
                    gain = np.where(ok, gl**2 / (hl + soft) + (g - gl) ** 2 / (h - hl + soft) - g**2 / (h + soft), -np.inf)
                    i = int(np.argmax(gain))
                    if gain[i] > 1e-12 and (found is None or gain[i] > found[0]):
                        found = (float(gain[i]), f, i, missing_left)
        return found

    every = np.arange(len(grad))
    root = tree.add(value(grad.sum(), hess.sum(), -np.inf, np.inf))
    open_ = [(best(every, -np.inf, np.inf), root, every, -np.inf, np.inf)]
    for _ in range(leaves - 1):
        open_ = [x for x in open_ if x[0] is not None]
        if not open_:
            break
        open_.sort(key=lambda x: (x[0][0], -x[1]))
        (gain, f, cut, missing_left), node, rows, lo, hi = open_.pop()
        b = binned[rows, f]
        goes = np.where(b < 0, missing_left, b <= cut)
        parts = (rows[goes], rows[~goes])
        values = [value(grad[p].sum(), hess[p].sum(), lo, hi) for p in parts]
        mid = sum(values) / 2
        bounds = [(lo, hi), (lo, hi)]
        if signs[f]:
            bounds = [(lo, mid), (mid, hi)] if signs[f] > 0 else [(mid, hi), (lo, mid)]
        tree.feature[node], tree.bin[node], tree.missing_left[node], tree.gain[node] = f, cut, missing_left, gain
        for side, (p, v, (x, y)) in enumerate(zip(parts, values, bounds, strict=True)):
            child = tree.add(v)
            (tree.left if side == 0 else tree.right)[node] = child
            open_.append((best(p, x, y), child, p, x, y))
    return tree


def fit(
    train: pd.DataFrame, valid: pd.DataFrame, columns: list[str], group: str, label: str, monotone: dict[str, int] | None = None, trees: int = 300, leaves: int = 15, least: int = 20, rate: float = 0.1, bins: int = 63, stop: int = 30, k: int = 10, soft: float = 1e-3
) -> Model:
    """The model that ranks ``valid`` best; missing features go to the side that fits better. ``monotone`` maps a column to 1 or -1."""
    parts = []
    for frame in (train, valid):
        frame = frame.sort_values(group, kind="stable")
        sizes = frame.groupby(group, sort=True).size().to_numpy()
        parts.append((frame[columns].to_numpy(dtype=float, na_value=np.nan), frame[label].to_numpy(dtype=float), sizes))
    (x, y, sizes), (vx, vy, vsizes) = parts
    edges = [np.unique(np.quantile(c[~np.isnan(c)], np.arange(1, bins) / bins, method="lower")) if (~np.isnan(c)).any() else np.zeros(0) for c in x.T]
    binned, vbinned = _binned(x, edges), _binned(vx, edges)
    signs = np.array([(monotone or {}).get(c, 0) for c in columns])
    score, vscore, made, best = np.zeros(len(x)), np.zeros(len(vx)), [], (ndcg(vy, np.zeros(len(vx)), vsizes, k), 0)
    for _ in range(trees):
        grad, hess = _lambdas(y, score, sizes, k)
        tree = _grow(binned, [len(e) for e in edges], grad, hess, leaves, least, signs, soft)
        if len(tree.value) == 1:
            break
        made.append(tree)
        score += rate * _walk(tree, binned)
        vscore += rate * _walk(tree, vbinned)
        now = ndcg(vy, vscore, vsizes, k)
        if now > best[0] + 1e-12:
            best = (now, len(made))
        elif len(made) - best[1] >= stop:
            break
    return Model(columns, edges, made[: best[1]], rate)


def too_little(train_groups: int, test_groups: int, valid_groups: int) -> str | None:
    """Why no model is trained; null where there is enough."""
    if train_groups < LEAST_TRAIN:
        return f"{train_groups} groups to train on, fewer than {LEAST_TRAIN}"
    if test_groups < LEAST_TEST:
        return f"{test_groups} groups to test on, fewer than {LEAST_TEST}"
    return None if valid_groups else "no groups to stop on"


def gathered(rows: DataFrame, columns: list[str], group: str, label: str) -> pd.DataFrame:
    """Labelled rows of groups with a positive, in the driver; refused above ``MOST``."""
    kept = rows.join(rows.where(rows[label] > 0).select(group).distinct(), group, "left_semi").select(group, label, *columns)
    if (n := kept.count()) > MOST:
        raise ValueError(f"{n} labelled rows are more than {MOST}")
    return kept.toPandas()


def scores(rows: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """``keys`` and score of every row."""
    kept = rows.select(*keys, *model.columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.select(*keys).schema.fields) + ", score double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[keys].assign(score=model.predict(batch[model.columns].to_numpy(dtype=float, na_value=np.nan)))

    return kept.mapInPandas(run, schema)
