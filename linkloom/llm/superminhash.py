"""SuperMinHash signatures (Ertl, 2017) of many sets at once.

Every element walks a random permutation of the signature positions; on level j it offers the value ``j + r`` to the
position it reaches. A position filled on some level cannot fall on a later one, so a set stops after the first level
that leaves no position empty. Ranks of one element are never drawn twice for one position, which is what lowers the
variance against MinHash. The walk runs level by level over whole arrays; permutations are only kept for the elements
of sets that need a second level.
"""

from __future__ import annotations

import numpy as np

EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _draw(element: np.ndarray, level: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The position drawn from level..size-1, and the value to offer (level in the top byte, random below it)."""
    bits = _mix(element + np.uint64((0x9E3779B97F4A7C15 * (2 * level + 1)) & 0xFFFFFFFFFFFFFFFF))
    value = (np.uint64(level) << np.uint64(56)) | (bits >> np.uint64(8))
    again = _mix(bits ^ np.uint64(0xD1B54A32D192ED03)) >> np.uint64(32)
    return level + ((again * np.uint64(size - level)) >> np.uint64(32)).astype(np.int64), value


def signatures(elements: np.ndarray, owner: np.ndarray, sets: int, size: int = 128) -> np.ndarray:
    """``sets`` x ``size`` values of the sets whose distinct elements and indexes are given; empty sets stay EMPTY.

    ``size`` is at most 255, so that a level fits into one byte.
    """
    out = np.full(sets * size, EMPTY, dtype=np.uint64)
    at, value = _draw(elements, 0, size)
    np.minimum.at(out, owner * size + at, value)
    used = np.bincount(owner, minlength=sets) > 0
    open_ = used & (out.reshape(sets, size) == EMPTY).any(axis=1)
    live = open_[owner]
    elements, owner, at = elements[live], owner[live], at[live]
    order = np.tile(np.arange(size, dtype=np.uint8), (len(elements), 1))
    rows = np.arange(len(elements))
    order[rows, at], order[:, 0] = 0, at
    for level in range(1, size):
        if not len(elements):
            break
        at, value = _draw(elements, level, size)
        here = order[rows, at]
        order[rows, at] = order[:, level]
        np.minimum.at(out, owner * size + here, value)
        open_ &= (out.reshape(sets, size) == EMPTY).any(axis=1)
        live = open_[owner]
        if live.mean() < 0.7:
            elements, owner, order = elements[live], owner[live], order[live]
            rows = np.arange(len(elements))
    return out.reshape(sets, size)


def band_keys(signature: np.ndarray, rows: int = 4) -> np.ndarray:
    """One 64-bit key per band of ``rows`` positions; the band's number goes into the key."""
    sets, size = signature.shape
    parts = signature.reshape(sets, size // rows, rows)
    key = np.broadcast_to(_mix(np.arange(1, size // rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)), (sets, size // rows)).copy()
    for k in range(rows):
        key = _mix(key * np.uint64(0x2545F4914F6CDD1D) + parts[:, :, k])
    return key.view(np.int64)
