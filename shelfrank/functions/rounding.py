"""Rounding inside NumPy kernels exactly as Spark's ``round(x, 4)`` does it.

Spark rounds the shortest decimal form of a double half away from zero. A kernel that keeps a
partial top-n must use the same rule, or it can drop a row that the final ranking wants.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np

SCALE = 10_000
#: A raw score this far below another one may still round to the same value.
SLACK = 1.01 / SCALE


def round_units(x: np.ndarray) -> np.ndarray:
    """``round(x, 4)`` in units of 0.0001, as integers."""
    y = np.asarray(x, np.float64) * SCALE
    low = np.floor(y)
    units = np.floor(y + 0.5).astype(np.int64)
    near = np.abs(y - low - 0.5) < 1e-6  # at a tie the decimal form decides
    if near.any():
        units[near] = [int(Decimal(repr(float(v))).scaleb(4).quantize(Decimal(1), ROUND_HALF_UP))
                       for v in np.asarray(x, np.float64)[near]]
    return units


def rank_cells(rows: np.ndarray, cols: np.ndarray, scores: np.ndarray, k, positive: bool = False) -> np.ndarray:
    """Which of the scattered cells are among their row's ``k`` (a number, or one per row) highest rounded
    scores, ties to the smaller column; in row and rank order. With ``positive`` only scores that round above 0."""
    units = round_units(scores)
    at = np.flatnonzero(units > 0) if positive else np.arange(len(units))
    if not len(at):
        return at
    at = at[np.lexsort((cols[at], -units[at], rows[at]))]
    own = rows[at]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    rank = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
    return at[rank < (k if np.ndim(k) == 0 else np.asarray(k)[own])]


def kth_best(scores: np.ndarray, k) -> np.ndarray:
    """Every row's k-th highest score; ``k`` is a number or one per row (0: infinite)."""
    width = scores.shape[1]
    k = np.minimum(np.broadcast_to(np.asarray(k), len(scores)), width)
    out = np.full(len(scores), np.inf)
    for n in np.unique(k[k > 0]):
        own = k == n
        part = scores if own.all() else scores[own]
        out[own] = np.partition(part, width - n, axis=1)[:, width - n]
    return out


def top_cells(scores: np.ndarray, k, positive: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the ``k`` highest rounded scores of every row, ties to the smaller column.

    ``k`` is a number or one per row. ``-inf`` never qualifies; with ``positive`` neither does a score that rounds to 0
    or less. Only cells within one unit of a row's k-th raw score can be among its k highest rounded ones, so only they
    are rounded.
    """
    kth = kth_best(scores, k)
    rows, cols = np.nonzero((scores >= (kth - SLACK)[:, None]) & (scores > (0.0 if positive else -np.inf)))
    keep = rank_cells(rows, cols, scores[rows, cols], k, positive)
    return rows[keep], cols[keep]
