"""Nearest neighbours by a block matrix join: int8 product tiles bound every distance, survivors are exact.

A vector x is scale * code + rest with an int8 code; the norm of `rest` is known exactly, so
a tile's int8 products give each inner product within |rest_q||x| + |scale_q code_q||rest_x|,
and with it a lower and an upper bound of the distance. A pair whose lower bound is above the
k-th smallest upper bound can't be among the k nearest; all others are computed again in double
precision. The result is therefore that of brute force.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vector_blocks import PAIR_ROWS, Best, Kernel, search


def quantize(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, norms of what they miss, norms of what they hold, squared norms."""
    scale = np.abs(x).max(axis=1, initial=0.0) / 127
    codes = np.rint(x / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
    held = codes * scale[:, None]
    rest = np.sqrt(((x - held) ** 2).sum(axis=1))
    return codes, scale, rest, np.sqrt((held**2).sum(axis=1)), (x**2).sum(axis=1)


def _prepare(x: np.ndarray):
    return x, quantize(x)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of row pairs; scaled where squares would overflow."""
    gap = a - b
    top = np.abs(gap).max(axis=1, initial=0.0)
    unit = np.where(top > 1e150, top, 1.0)[:, None]
    return np.sqrt(((gap / unit) ** 2).sum(axis=1)) * unit[:, 0]


def _run(side, ids: np.ndarray, x: np.ndarray, best: Best) -> None:
    q, (codes, scale, rest, held, square) = side
    xcodes, xscale, xrest, _, xsquare = quantize(x)
    # Products of int8 codes are whole numbers below 2**24 up to 1040 dimensions: exact in float32.
    kind = np.float32 if q.shape[1] <= 1040 else np.float64
    right, xnorm = xcodes.T.astype(kind), np.sqrt(xsquare)
    for at in range(0, len(q), 1024):
        part = slice(at, at + 1024)
        product = (codes[part].astype(kind) @ right).astype(np.float64) * scale[part, None] * xscale
        error = rest[part, None] * xnorm + held[part, None] * xrest
        middle = square[part, None] + xsquare - 2 * product
        slack = 1e-9 * (square[part, None] + xsquare) + 2 * error
        if len(ids) > best.k:
            upper = np.partition(middle + slack, best.k - 1, axis=1)[:, best.k - 1]
        else:
            upper = np.full(len(middle), np.inf)
        limit = np.fmin(upper, best.bound[part] ** 2 * (1 + 1e-9))
        # Written so that bounds that overflow keep their pair.
        row, column = np.nonzero(~(middle - slack > limit[:, None]))
        for a in range(0, len(row), PAIR_ROWS):
            r, c = row[a : a + PAIR_ROWS] + at, column[a : a + PAIR_ROWS]
            best.merge(r, ids[c], _distances(q[r], x[c]), np.zeros(len(r), dtype=np.int64))


EUCLID = Kernel(
    keep=lambda x: (x != 0).any(axis=1),
    prepare=_prepare,
    run=_run,
    own=lambda x: (np.zeros(len(x)), np.zeros(len(x), dtype=np.int64)),
)


def nearest_neighbours(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """The k rows nearest to each row whose vec_id is divisible by `every`, by Euclidean distance.

    Returns query_id, rank (from 1), vec_id, score (distance, double), nearest first, ties to the
    smaller vec_id; fewer rows where there are fewer candidates. Null ids, null or zero vectors
    and those with null or non-finite components take no part; vectors of unlike dimension
    are no candidates of each other. Rows with equal ids are rows of their own: a query finds
    the others, never itself. An empty table gives no rows; other columns are not read.
    """
    return search(vectors, every, k, EUCLID).select("query_id", "rank", "vec_id", F.col("key").alias("score"))
