"""Toxicity from confirmed toxic examples and unlabelled text: non-negative positive-unlabelled learning.

With class prior p, positives P and unlabelled U, the risk of a scorer f under the loss l is
    p E_P[l(f)] + max(0, E_U[l(-f)] - p E_P[l(-f)])
The second term estimates the risk on negatives without any negative label; where it would
fall below zero, the step ascends it instead (non-negative estimator). f is linear in the
presence of words. p is estimated from the words themselves, for the unlabelled population.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, record, slices, state_name, texts_of, tidy, worker_state

#: ASCII that isn't a letter parts words; other bytes belong to them.
_PARTS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def words_of(text: str) -> set[bytes]:
    """Distinct lower-cased words of a whole text."""
    return set(text.lower().encode("utf-8", "surrogatepass").translate(_PARTS).split())


def feature(word: bytes) -> int:
    """Number of a word, 32 bits of its hash."""
    return xxhash.xxh3_64_intdigest(word) >> 32


@dataclass(frozen=True)
class ToxicModel:
    """Weights of known words and a bias; other words weigh nothing."""

    weights: dict[int, float]
    bias: float


def _separation(positive: tuple[np.ndarray, np.ndarray], unlabelled: tuple[np.ndarray, np.ndarray], sizes: tuple[int, int], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shares of documents with each word on both sides, and how many deviations of chance lie between them.

    That is the root of the Poisson deviance of its count in positives from what the unlabelled let expect.
    """
    n, m = (np.bincount(col, minlength=words) for _, col in (positive, unlabelled))
    expected = sizes[0] * (m + 1) / (sizes[1] + 1)
    deviance = n * np.log(np.maximum(n, 1) / expected) - (n - expected)
    return n / sizes[0], m / sizes[1], np.sqrt(2 * np.maximum(deviance, 0))


def estimate_prior(p: np.ndarray, u: np.ndarray, apart: np.ndarray) -> float:
    """Share of positives among the unlabelled: how often these hold the words that set positives apart, against positives."""
    weight = np.where(p > u, apart**4, 0.0)
    return float(np.clip((weight * u * p).sum() / max((weight * p * p).sum(), 1e-300), 1e-3, 0.5))


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], rounds: int = 150, rate: float = 0.2, penalty: float = 0.015) -> ToxicModel:
    """Train on documents given as arrays of feature numbers; deterministic.

    Every word of either side takes part at first, under a penalty that falls with a high power of
    its separation; the words that keep a weight are then trained again without one.
    """
    if not positive or not unlabelled:
        return ToxicModel({}, -20.0)
    sizes = len(positive), len(unlabelled)
    flat = np.concatenate([*positive, *unlabelled])
    words = np.unique(flat)
    row, col = np.repeat(np.arange(sum(sizes), dtype=np.int32), [len(d) for d in (*positive, *unlabelled)]), np.searchsorted(words, flat).astype(np.int32)
    del flat
    cut = int(np.searchsorted(row, sizes[0]))
    sides = (row[:cut], col[:cut]), (row[cut:] - sizes[0], col[cut:])
    p, u, apart = _separation(*sides, sizes, len(words))
    prior = estimate_prior(p, u, apart)
    charge = penalty / 16 / np.maximum(apart / 4, 1e-2) ** 6
    # No gradient is larger than this, so a word under a larger penalty would never leave zero.
    moved = np.flatnonzero(charge < prior * p + u)
    sides = _restricted(sides, moved, len(words))
    first, _ = _descend(*sides, sizes, prior, charge[moved], rounds, rate)
    kept = np.flatnonzero(first)
    sides = _restricted(sides, kept, len(moved))
    kept = moved[kept]
    weights, bias = _descend(*sides, sizes, prior, np.full(len(kept), 1e-4), rounds, rate)
    return ToxicModel(dict(zip(words[kept].tolist(), weights.tolist(), strict=True)), bias)


def _restricted(sides, kept: np.ndarray, words: int):
    """Both sides with only these words, numbered anew."""
    number = np.full(words, -1, dtype=np.int32)
    number[kept] = np.arange(len(kept), dtype=np.int32)
    return tuple((r[at], c[at]) for r, c in ((r, number[c]) for r, c in sides) for at in [c >= 0])


def _descend(
    positive: tuple[np.ndarray, np.ndarray], unlabelled: tuple[np.ndarray, np.ndarray], sizes: tuple[int, int], prior: float, penalty: np.ndarray, rounds: int, rate: float
) -> tuple[np.ndarray, float]:
    """Weights and bias by proximal Adam steps on the non-negative risk; penalty: of each weight's absolute value."""
    (prow, pcol), (urow, ucol), (np_, nu), n = positive, unlabelled, sizes, len(penalty)
    w = np.zeros(n + 1)
    w[n] = np.log(prior / (1 - prior))
    first, second = np.zeros(n + 1), np.zeros(n + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    softplus = lambda z: np.logaddexp(0, z)

    def back(gp: np.ndarray, gu: np.ndarray) -> np.ndarray:
        out = np.bincount(pcol, weights=gp[prow], minlength=n) + np.bincount(ucol, weights=gu[urow], minlength=n)
        return np.append(out, gp.sum() + gu.sum())

    for step in range(1, rounds + 1):
        fp = np.bincount(prow, weights=w[pcol], minlength=np_) + w[n]
        fu = np.bincount(urow, weights=w[ucol], minlength=nu) + w[n]
        negative = softplus(fu).mean() - prior * softplus(fp).mean()
        gp_pos, gp_neg, gu_neg = -sigmoid(-fp) * prior / np_, -sigmoid(fp) * prior / np_, sigmoid(fu) / nu
        grad = back(gp_pos + gp_neg, gu_neg) if negative >= 0 else -back(gp_neg, gu_neg)
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        pace = rate * (0.1 if step > 0.7 * rounds else 1) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w -= pace * first / (1 - 0.9**step)
        w[:n] = np.sign(w[:n]) * np.maximum(np.abs(w[:n]) - pace[:n] * penalty, 0)
    return w[:n], float(w[n])


class _Scorer:
    """Scores texts; remembers the weights of up to `limit` words."""

    def __init__(self, model: ToxicModel, limit: int = 200_000):
        self.model, self.limit, self.known = model, limit, {}

    def scores(self, texts: Iterable[str]) -> np.ndarray:
        known, weights, out = self.known, self.model.weights, []
        for text in texts:
            total = self.model.bias
            words = words_of(text)
            fresh = words.difference(known)
            if fresh:
                if len(known) + len(fresh) > self.limit:
                    known.clear()
                    fresh = words
                known.update((w, weights.get(feature(w), 0.0)) for w in fresh)
            out.append(total + sum(sorted(x for x in map(known.__getitem__, words) if x)))
        return 1 / (1 + np.exp(-np.clip(np.array(out, dtype=float), -40, 40)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_positive: int = 4000, max_unlabelled: int = 12000, modulus: int = 4) -> ToxicModel:
    """Fit from labels whose id isn't held out, and text of documents that aren't.

    The fit sees at most `max_positive` confirmed toxic and `max_unlabelled` unlabelled
    documents, those first by a hash of their id; one row of each id, whole texts.
    """
    spark = docs.sparkSession
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    told = told.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"), modulus))
    def first_ids(df: DataFrame, n: int) -> list[int]:
        ids, total = df.select("doc_id", F.xxhash64("doc_id").alias("hash")), df.count()
        if total > 8 * n:
            # Tasks would each send n rows: a part of the hash that should hold twice as many does, unless ids repeat.
            few = ids.where(F.col("hash") < -(1 << 63) + (1 << 64) * 2 * n // total)
            ids = few if few.count() >= n else ids
        return [r[0] for r in ids.orderBy("hash", "doc_id").limit(n).collect()]

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), modulus))
    positive = set(first_ids(told.where("toxic = 1").select("doc_id").distinct(), max_positive))
    if not positive:
        return ToxicModel({}, -20.0)
    unlabelled = set(first_ids(rows, max_unlabelled))
    ids = spark.sparkContext.broadcast((positive, unlabelled))
    schema = pa.schema([("doc_id", pa.int64()), ("features", pa.binary())])

    def features(batches):
        wanted = ids.value[0] | ids.value[1]
        for batch in slices(batches):
            mask = np.array([d in wanted for d in batch.column(0).to_pylist()], dtype=bool)
            if mask.any():
                some = batch.filter(pa.array(mask))
                made = [np.unique(np.array([*map(feature, words_of(t))], dtype="<u4")).tobytes() for t in texts_of(some.column(1))]
                yield record(schema, [some.column(0), made])

    made = rows.mapInArrow(tidy(features), "doc_id long, features binary")
    got = sorted(made.groupBy("doc_id").agg(F.min("features").alias("features")).collect())
    pick = lambda wanted: [np.frombuffer(r["features"], "<u4") for r in got if r["doc_id"] in wanted]
    return fit_nnpu(pick(positive), pick(unlabelled))


def toxicity_column(model: ToxicModel, text: Column, spark) -> Column:
    """Score of a whole text (null: empty), 0 to 1, as a column."""
    shared = spark.sparkContext.broadcast(model)
    name = state_name("toxicity")

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        scorer = worker_state(name, lambda: _Scorer(shared.value))
        return pd.Series(scorer.scores("" if t is None else t for t in texts), index=texts.index)

    return score(F.coalesce(text.cast("string"), F.lit("")))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, modulus: int = 4) -> DataFrame:
    """Per document doc_id, held_out, score (0 to 1, higher: likelier toxic), predicted (score >= threshold).

    Null or empty text gets the score of no words; a null id is never held out nor learned
    from; repeated rows are scored each; without labels all scores are near zero; an empty
    table gives no rows. Other columns are not read.
    """
    model = fit_toxicity(docs, labels, modulus=modulus)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    scored = rows.select("doc_id", held_out(F.col("doc_id"), modulus).alias("held_out"), toxicity_column(model, F.col("text"), docs.sparkSession).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
