"""Exact top-k inner products, pruned by segment means and deviations from coarse to fine.

Cut into segments of length n, with means m and deviations s, two vectors satisfy per segment
    n((m_q - m_x)^2 + (s_q - s_x)^2)  <=  squared distance
so the sum over segments is a lower bound of the squared distance, and with the norms
    q.x = (|q|^2 + |x|^2 - d^2) / 2  <=  sum of n(m_q m_x + s_q s_x)
an upper bound of the inner product. Splitting segments tightens it. Both sides are first turned so
that the queries' main directions come first, which changes no product, and segments are cut to
hold equal shares of the queries' energy: short ones where it lies. A level is one matrix product over
a tile; what the finest level leaves is computed exactly, by a product over the rows and columns left.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vector_blocks import PAIR_ROWS, Best, Kernel, search

#: Segments a vector is cut into, by level.
LEVELS = (4, 16, 32)


def whole_parts(x: np.ndarray) -> np.ndarray:
    """floor(256 x), as doubles (exact whole numbers)."""
    return np.floor(256.0 * x)


def statistics(x: np.ndarray, segments: int, edges: np.ndarray | None = None) -> np.ndarray:
    """Means and deviations of each segment, times the root of its length, side by side; segments of equal length unless given."""
    if edges is None:
        edges = np.unique(np.linspace(0, x.shape[1], min(segments, max(1, x.shape[1])) + 1).astype(int))
    out = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        part = x[:, a:b]
        mean = part.mean(axis=1)
        out += [mean * np.sqrt(b - a), np.sqrt(((part - mean[:, None]) ** 2).sum(axis=1))]
    return np.column_stack(out) if out else np.zeros((len(x), 0))


def directions(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """An orthonormal turn to the main directions of these rows, and by level the edges of segments of equal energy."""
    width = x.shape[1]
    with np.errstate(over="ignore", invalid="ignore"):
        moment = x.T @ x
    if not width or not np.isfinite(moment).all():
        turn, energy = np.eye(width), np.ones(width)
    else:
        energy, turn = np.linalg.eigh(moment)
        energy, turn = np.maximum(energy[::-1], 0), turn[:, ::-1]
    share = np.cumsum(energy) / max(energy.sum(), 1e-300) if energy.any() else np.linspace(0, 1, width + 1)[1:]
    edges = [np.unique([0, *(np.searchsorted(share, np.arange(1, n) / n - 1e-12) + 1).clip(0, width), width]) for n in LEVELS]
    return np.ascontiguousarray(turn), edges


@dataclass
class _Side:
    """Queries as whole numbers, their turn, segments and statistics by level, norms; left: pairs met, and left by each level."""

    whole: np.ndarray
    turn: np.ndarray
    edges: list[np.ndarray]
    levels: list[np.ndarray]
    norms: np.ndarray
    left: np.ndarray


def _prepare(x: np.ndarray) -> _Side:
    whole = whole_parts(x)
    turn, edges = directions(whole)
    turned = whole @ turn
    return _Side(whole, turn, edges, [statistics(turned, n, e) for n, e in zip(LEVELS, edges, strict=True)], np.sqrt((whole**2).sum(axis=1)), np.zeros(len(LEVELS) + 1))


def _scores(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact inner products of row pairs of whole numbers: as keys (negated doubles) and negated integers."""
    biggest = np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0) * max(1, a.shape[1])
    if biggest < 2**53:
        exact = -(a * b).sum(axis=1).astype(np.int64)
        return exact.astype(np.float64), exact
    top = 2**63 - 1
    sums = [sum(int(u) * int(v) for u, v in zip(p, q, strict=True)) for p, q in zip(a.tolist(), b.tolist(), strict=True)]
    exact = np.array([-max(-top, min(top, s)) for s in sums], dtype=np.int64)
    return exact.astype(np.float64), exact


def _run(side: _Side, ids: np.ndarray, x: np.ndarray, best: Best) -> None:
    x = whole_parts(x)
    turned, norms = x @ side.turn, np.sqrt((x**2).sum(axis=1))
    levels = [statistics(turned, n, e) for n, e in zip(LEVELS, side.edges, strict=True)]
    exact = np.abs(side.whole).max(initial=0.0) * np.abs(x).max(initial=0.0) * max(1, x.shape[1]) < 2**53
    for at in range(0, len(side.whole), 1024):
        part = slice(at, at + 1024)
        floor = -best.bound[part]
        alive = np.ones((len(floor), len(ids)), dtype=bool)
        side.left[0] += alive.size
        if not np.isinf(floor).all():  # before a query has k candidates nothing can be ruled out
            for n, (mine, theirs) in enumerate(zip(side.levels, levels, strict=True)):
                bound = mine[part] @ theirs.T + 1e-9 * side.norms[part, None] * norms
                # Written so that bounds that overflow keep their pair.
                alive &= ~(bound < floor[:, None])
                side.left[n + 1] += alive.sum()
        else:
            side.left[1:] += alive.size
        r, c = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
        if not len(r):
            continue
        if exact:
            score = np.where(alive[np.ix_(r, c)], side.whole[at + r] @ x[c].T, -np.inf)
            if len(c) > best.k:
                # Equal scores stay together, so that ties are left to the heaps.
                floor[r] = np.fmax(floor[r], np.partition(score, len(c) - best.k, axis=1)[:, len(c) - best.k])
            row, column = np.nonzero((score >= floor[r, None]) & np.isfinite(score))
            key = -score[row, column]
            best.merge(at + r[row], ids[c[column]], key, key.astype(np.int64))
        else:
            row, column = np.nonzero(alive)
            for a in range(0, len(row), PAIR_ROWS):
                some = slice(a, a + PAIR_ROWS)
                best.merge(at + row[some], ids[column[some]], *_scores(side.whole[at + row[some]], x[column[some]]))


def _own(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    whole = whole_parts(x)
    return _scores(whole, whole)


INNER = Kernel(keep=lambda x: np.ones(len(x), dtype=bool), prepare=_prepare, run=_run, own=_own)


def top_products(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """The k highest integer inner products of floor(256 x) for each row whose vec_id is divisible by `every`.

    Returns query_id, rank (from 1), vec_id, score (long), highest first, ties to the smaller
    vec_id; fewer rows where there are fewer candidates. Null ids, null vectors and those with
    null or non-finite components take no part; a zero vector does; vectors of unlike dimension
    are no candidates of each other. A score beyond the range of a long is held at its end.
    Rows with equal ids are rows of their own: a query finds the others, never itself. An
    empty table gives no rows; other columns are not read.
    """
    return search(vectors, every, k, INNER).select("query_id", "rank", "vec_id", (-F.col("whole")).alias("score"))
