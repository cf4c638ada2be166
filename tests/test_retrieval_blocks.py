"""Blocks of exact retrieval: how many there are, and what is found where sources fill several pieces."""

import numpy as np
import pandas as pd

from linkloom.operators import retrieval


def test_blocks_of_a_large_language_do_not_grow_in_number(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 4)
    monkeypatch.setattr(retrieval, "LEAST", 1)
    pages = spark.range(200).selectExpr("id AS page", "IF(id < 190, 'en', 'de') AS language", "array(1.0D, 2.0D) AS vector")
    assert {r["l9"]: r["blocks"] for r in retrieval._blocks(pages).collect()} == {"en": retrieval.BLOCKS, "de": 3}
    monkeypatch.setattr(retrieval, "NUMBERS", 20)  # ten vectors of two numbers are all that a block may hold
    assert {r["l9"]: r["blocks"] for r in retrieval._blocks(pages).collect()} == {"en": 19, "de": 3}


def test_pieces_ties_and_ruled_pairs_as_from_all_cosines():
    rng, n, k = np.random.default_rng(7), 2 * retrieval.PIECE + 37, 10
    b = rng.normal(size=(n, 16))
    b[5000:5400] = b[3]  # more ties than the bound lets through
    b[[8, retrieval.PIECE, n - 1]] = b[1]
    a = np.vstack([b[[1, 3, 8, n - 1]], rng.normal(size=(retrieval.ROWS, 16)), np.zeros((1, 16))])
    pages = lambda x, start, side: pd.DataFrame({"page": np.arange(start, start + len(x)), "vector": list(x), "other": None, "side": side})
    links = pd.DataFrame({"page": [n, n, n + 1, n + 4], "vector": None, "other": [retrieval.PIECE, n - 1, 5000, 0], "side": 2})
    found = retrieval._top(k)(pd.concat([pages(a, n, 0), pages(b, 0, 1), links], ignore_index=True))
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
    cos = np.clip(unit(a) @ unit(b).T, -1, 1).round(6)
    cos[links["page"].to_numpy() - n, links["other"].to_numpy(dtype=int)] = -9
    want = {(n + i, int(j), float(row[j])) for i, row in enumerate(cos) for j in np.argsort(-row, kind="stable")[:k]}
    assert set(zip(found["target"], found["source"], found["similarity"])) == want
