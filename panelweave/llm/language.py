"""Language identification by a byte convolutional network, trained and applied in numpy.

Filters of several widths slide over the bytes of a fixed-length window; each filter's largest
response feeds a softmax layer. On one-hot bytes a filter of width w is w tables of 256
weights, so two neighbouring bytes need one lookup in a table of 65,536 sums. A text is cut into
windows that overlap by the widest filter less one, so each run of bytes is seen; its
probabilities are the windows', weighted by their letters.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, materialize, record, slices, state_name, texts_of, tidy, worker_state

WIDTHS, FILTERS, WINDOW = (2, 3, 4), 8, 192
STEP = WINDOW - max(WIDTHS) + 1
_LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])


@dataclass(frozen=True)
class LanguageModel:
    """names: languages in the order of the outputs. filters[w]: w tables of 256 x FILTERS."""

    names: tuple[str, ...]
    filters: tuple[np.ndarray, ...]
    shift: np.ndarray
    dense: np.ndarray
    bias: np.ndarray


def windows_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A text's windows (zero-padded) and the letters in each."""
    raw = np.frombuffer(data, dtype=np.uint8)
    n = max(1, -(-(len(raw) - WINDOW) // STEP) + 1) if len(raw) > WINDOW else 1
    padded = np.zeros((n - 1) * STEP + WINDOW, dtype=np.uint8)
    padded[: len(raw)] = raw
    view = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STEP]
    return view, _LETTER[view].sum(axis=1)


def _responses(filters, x: np.ndarray) -> list[np.ndarray]:
    """Filter responses at every place of every window, by width."""
    out = []
    for table in filters:
        w = len(table)
        places = WINDOW - w + 1
        total = table[0][x[:, :places]]
        for k in range(1, w):
            total += table[k][x[:, k : k + places]]
        out.append(total)
    return out


def train(names: tuple[str, ...], x: np.ndarray, y: np.ndarray, epochs: int = 8, rate: float = 0.02, batch: int = 256, seed: int = 7) -> LanguageModel:
    """Softmax regression on max-pooled rectified filters, by Adam; deterministic."""
    rng = np.random.default_rng(seed)
    filters = [rng.normal(0, 0.3 / np.sqrt(w), (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    shift = np.zeros(FILTERS * len(WIDTHS), dtype=np.float32)
    dense = rng.normal(0, 0.3, (FILTERS * len(WIDTHS), len(names))).astype(np.float32)
    bias = np.zeros(len(names), dtype=np.float32)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (*filters, shift, dense, bias)]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            rows = order[at : at + batch]
            xb, yb, step = x[rows], y[rows], step + 1
            responses = _responses(filters, xb)
            where = [r.argmax(axis=1) for r in responses]
            pooled = np.concatenate([np.take_along_axis(r, a[:, None], 1)[:, 0] for r, a in zip(responses, where, strict=True)], axis=1) + shift
            hidden = np.maximum(pooled, 0)
            logits = hidden @ dense + bias
            prob = np.exp(logits - logits.max(axis=1, keepdims=True))
            prob /= prob.sum(axis=1, keepdims=True)
            prob[np.arange(len(yb)), yb] -= 1
            prob /= len(yb)
            back = (prob @ dense.T) * (pooled > 0)
            grads = []
            for i, w in enumerate(WIDTHS):
                g, part = np.zeros_like(filters[i]), back[:, i * FILTERS : (i + 1) * FILTERS]
                for k in range(w):
                    byte = np.take_along_axis(xb, where[i] + k, 1)
                    np.add.at(g[k], (byte, np.arange(FILTERS)[None, :]), part)
                grads.append(g)
            grads += [back.sum(axis=0), hidden.T @ prob, prob.sum(axis=0)]
            for p, g, (m, v) in zip((*filters, shift, dense, bias), grads, state, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return LanguageModel(names, tuple(filters), shift, dense, bias)


class Predictor:
    """Applies a model with tables for pairs of bytes."""

    def __init__(self, model: LanguageModel):
        self.model = model
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
        two, three, four = model.filters
        self.pairs = [pair(two[0], two[1]), pair(three[0], three[1]), pair(four[0], four[1]), pair(four[2], four[3])]
        self.single = three[2]

    def windows(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of each window."""
        code = x[:, :-1].astype(np.int32) << 8
        code |= x[:, 1:]
        n, places = code.shape
        flat = np.ascontiguousarray(code).ravel()
        look = lambda table, index: np.take(table, index, axis=0, mode="clip")
        pooled = [look(self.pairs[0], flat).reshape(n, places, FILTERS).max(axis=1)]
        three = look(self.pairs[1], flat).reshape(n, places, FILTERS)[:, : places - 1]
        three += look(self.single, x[:, 2:].ravel()).reshape(n, places - 1, FILTERS)
        pooled.append(three.max(axis=1))
        four = look(self.pairs[2], flat).reshape(n, places, FILTERS)[:, : places - 2]
        four += look(self.pairs[3], flat).reshape(n, places, FILTERS)[:, 2:]
        pooled.append(four.max(axis=1))
        logits = np.maximum(np.concatenate(pooled, axis=1) + self.model.shift, 0) @ self.model.dense + self.model.bias
        prob = np.exp(logits - logits.max(axis=1, keepdims=True))
        return prob / prob.sum(axis=1, keepdims=True)

    def predict(self, texts: list[str], block: int = 2048) -> tuple[list[str], np.ndarray]:
        """Language and its probability for each whole text; und and 0 where no letter is."""
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        if not self.model.names:
            return names, scores
        sums = np.zeros((len(texts), len(self.model.names)))
        block = max(32, min(block, (1 << 21) // len(self.model.names)))
        held, owner, weight, size = [], [], [], 0

        def flush():
            nonlocal held, owner, weight, size
            x, rows, letters = np.concatenate(held), np.concatenate(owner), np.concatenate(weight)
            for at in range(0, len(x), block):
                part = slice(at, at + block)
                np.add.at(sums, rows[part], self.windows(x[part]) * letters[part, None])
            held, owner, weight, size = [], [], [], 0

        for i, text in enumerate(texts):
            if any(map(str.isalpha, text)):
                x, letters = windows_of(text.encode("utf-8", "surrogatepass"))
                held.append(x), owner.append(np.full(len(x), i)), weight.append(letters)
                size += len(x)
                if size >= block:
                    flush()
        if held:
            flush()
        total = sums.sum(axis=1)
        best = sums.argmax(axis=1)
        for i in np.flatnonzero(total):
            names[i], scores[i] = self.model.names[best[i]], min(1.0, sums[i, best[i]] / total[i])
        return names, scores


def fit_language(docs: DataFrame, max_documents: int = 4000, modulus: int = 4, least: int = 50) -> LanguageModel:
    """Fit on labelled documents that aren't held out, first by a hash of their id within each language:
    an equal share of `max_documents` for each, `least` at any rate; one row of each id and language,
    all its windows. Every language whose documents have text to learn from is learned."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"), modulus))
    usable = rows.where(F.octet_length("text") >= WINDOW // 8).select("lang", "doc_id", F.xxhash64("doc_id").alias("hash"))
    usable = usable.withColumn("part", F.shiftright("hash", 46))
    counts = materialize(usable.groupBy("lang", "part").agg(F.count("*").alias("n")), "language-counts", narrow=True)
    languages = counts.select("lang").distinct().count()
    if not languages:
        return LanguageModel((), (), np.zeros(0), np.zeros(0), np.zeros(0))
    share = max(least, max_documents // languages)
    # Parts of the hash (2^18 of them) that hold the first documents of a language; at most one part of it is taken in vain.
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("part")) - F.col("n")
    parts = counts.withColumn("before", before).where(F.col("before") < share).select("lang", "part")
    first = usable.join(F.broadcast(parts), ["lang", "part"]).select("lang", "hash", "doc_id").collect()
    ids, taken = set(), Counter()
    for name, _, doc in sorted(first):
        taken[name] += 1
        if taken[name] <= share:
            ids.add((doc, name))
    shared = docs.sparkSession.sparkContext.broadcast(ids)
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("windows", pa.binary())])

    def cut(batches):
        for batch in slices(batches):
            mask = np.array([k in shared.value for k in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)], dtype=bool)
            if mask.any():
                some, made = batch.filter(pa.array(mask)), []
                for t in texts_of(some.column(1)):
                    x, letters = windows_of(t.encode("utf-8", "surrogatepass"))
                    made.append(x[letters >= WINDOW // 8].tobytes())
                yield record(schema, [some.column(0), some.column(2), made])

    made = rows.mapInArrow(tidy(cut), "doc_id long, lang string, windows binary").where(F.length("windows") > 0)
    got = sorted(made.groupBy("doc_id", "lang").agg(F.min("windows").alias("windows")).collect())
    if not got:
        return LanguageModel((), (), np.zeros(0), np.zeros(0), np.zeros(0))
    names = tuple(sorted({r["lang"] for r in got}))
    number = {name: i for i, name in enumerate(names)}
    x = [np.frombuffer(r["windows"], np.uint8).reshape(-1, WINDOW) for r in got]
    y = [np.full(len(w), number[r["lang"]]) for w, r in zip(x, got, strict=True)]
    return train(names, np.concatenate(x), np.concatenate(y))


def language_column(model: LanguageModel, text: Column, spark) -> Column:
    """Struct of lang_pred and score for a whole text, as a column."""
    shared = spark.sparkContext.broadcast(model)
    name = state_name("language")

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts):
        import pandas as pd

        predictor = worker_state(name, lambda: Predictor(shared.value) if shared.value.names else None)
        if predictor is None:
            return pd.DataFrame({"lang_pred": ["und"] * len(texts), "score": [0.0] * len(texts)})
        all_texts, names, scores = texts.tolist(), [], []
        for at in range(0, len(all_texts), 512):
            n, s = predictor.predict(["" if t is None else t for t in all_texts[at : at + 512]])
            names += n
            scores += s.tolist()
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return predict(F.coalesce(text.cast("string"), F.lit("")))


def identify_language(docs: DataFrame, modulus: int = 4) -> DataFrame:
    """Per document doc_id, held_out, lang_pred, score (its probability, 0 to 1).

    Null text and text without a letter: und with score 0, and so is everything where no row
    has a label to learn from. A null id is never held out nor learned from; repeated rows
    are predicted each; an empty table gives no rows. Only doc_id, text and (to learn) lang are read.
    """
    model = fit_language(docs, modulus=modulus)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    found = rows.select("doc_id", held_out(F.col("doc_id"), modulus).alias("held_out"), language_column(model, F.col("text"), docs.sparkSession).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")
