"""Best-fit packing of tokenized documents into fixed-length sequences.

The packing itself depends only on piece lengths, of which there are at most `max_tokens`
different ones. So Spark counts pieces by length, the driver packs those counts (bounded by
the sequence length, whatever the corpus), and the resulting plan is applied to every piece
by its running number among the pieces of its length.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, record, slices, texts_of, tidy
from .encoding import encoder


@dataclass(frozen=True)
class Capacity:
    """Limits of one sequence and how tightly each counts when a bin is chosen.

    tokens: ids in a sequence. documents: pieces in a sequence. attention: sum of squared
    piece lengths (None: what `tokens` implies). weights: of tokens, documents, attention.
    rule: "norm" takes the open bin with the smallest weighted residual norm after the piece
    is placed, "dot" the one whose residual has the smallest weighted dot product with the
    piece's demand. Both consider only bins that satisfy every limit.
    """

    tokens: int = 4096
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3)
    rule: str = "norm"

    def limits(self) -> np.ndarray:
        return np.array(
            [self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], dtype=np.int64
        )


def plan_bins(counts: dict[int, int], capacity: Capacity) -> dict[str, np.ndarray]:
    """Pack `counts[length]` pieces of each length, longest first, by vector best fit.

    Bins with equal content are one run of consecutive sequence numbers, so the work and the
    plan grow with the number of lengths and not with the number of pieces. Each returned row
    says: pieces number first..last (exclusive) of this length go `copies` to a sequence, from
    sequence `bin` on and from `offset` on within each.
    """
    limits = capacity.limits()
    weights = np.asarray(capacity.weights) / limits.astype(float) ** 2
    size, start, left, used = [np.zeros(0, dtype=np.int64) for _ in range(2)] + [np.zeros((0, 3), dtype=np.int64), np.zeros(0, dtype=np.int64)]
    rows, bins = [], 0
    for length in sorted(counts, reverse=True):
        demand = np.array([length, 1, length * length], dtype=np.int64)
        if (demand > limits).any():
            raise ValueError(f"a piece of {length} tokens does not fit into an empty sequence")
        todo, at = int(counts[length]), 0
        while todo:
            fits = np.flatnonzero((left >= demand).all(axis=1))
            if not len(fits):
                copies = int((limits // demand).min())
                n, k = -(-todo // copies), -1
                new_size, new_start, new_left, new_used = [n], [bins], [limits.copy()], [0]
                bins += n
                size, start, used = np.append(size, new_size), np.append(start, new_start), np.append(used, new_used)
                left = np.vstack([left, new_left])
                k = len(size) - 1
            else:
                room = left[fits].astype(float)
                if capacity.rule == "dot":
                    cost = room @ (weights * demand)
                else:
                    cost = ((room - demand) ** 2) @ weights
                k = int(fits[np.argmin(cost)])
            copies = int((left[k] // demand).min())
            full, rest = divmod(min(todo, copies * int(size[k])), copies)
            pieces = [(full, copies), (1, rest)] if rest else [(full, copies)]
            unused = int(size[k]) - full - bool(rest)
            first = int(start[k])
            parts = []
            for n, c in pieces:
                if n:
                    rows.append((length, at, at + n * c, first, c, int(used[k])))
                    parts.append((n, first, left[k] - c * demand, int(used[k]) + c * length))
                    at, first = at + n * c, first + n
            if unused:
                parts.append((unused, first, left[k].copy(), int(used[k])))
            size, start, used = np.delete(size, k), np.delete(start, k), np.delete(used, k)
            left = np.delete(left, k, axis=0)
            parts = [p for p in parts if (p[2] > 0).all()]
            if parts:
                size = np.append(size, [p[0] for p in parts])
                start = np.append(start, [p[1] for p in parts])
                used = np.append(used, [p[3] for p in parts])
                left = np.vstack([left, [p[2] for p in parts]])
            todo = int(counts[length]) - at
    rows.sort()
    names = ("length", "first", "last", "bin", "copies", "offset")
    table = np.array(rows, dtype=np.int64).reshape(-1, 6)
    return {n: table[:, i] for i, n in enumerate(names)} | {"bins": np.int64(bins)}


def place(plan: dict[str, np.ndarray], length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the pieces with these lengths and running numbers."""
    step = int(plan["last"].max(initial=0)) + 1
    row = np.searchsorted(plan["length"] * step + plan["first"], length * step + number, side="right") - 1
    nth = number - plan["first"][row]
    return plan["bin"][row] + nth // plan["copies"][row], plan["offset"][row] + nth % plan["copies"][row] * length


PIECES = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("nth", pa.int64())]
)


def pieces(docs: DataFrame, tokenizer: str, end_id: int, max_tokens: int, cache: int) -> DataFrame:
    """One row per piece of each document, with its running number among the task's pieces of its length."""

    def cut(batches):
        task, seen = TaskContext.get().partitionId(), np.zeros(max_tokens + 1, dtype=np.int64)
        end = int(end_id).to_bytes(4, "little")
        for batch in slices(batches):
            ids = encoder(tokenizer, cache).encode(texts_of(batch.column(1)))
            out = [[] for _ in PIECES]
            for doc, code in zip(batch.column(0).to_pylist(), ids, strict=True):
                code += end
                for n, at in enumerate(range(0, len(code), 4 * max_tokens)):
                    part = code[at : at + 4 * max_tokens]
                    length = len(part) // 4
                    for c, v in zip(out, (doc, n, at // 4, length, zlib.crc32(part), task, int(seen[length])), strict=True):
                        c.append(v)
                    seen[length] += 1
            yield record(PIECES, out)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        tidy(cut, keeps=True), "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"
    )


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: Capacity | None = None, cache: int = 96 << 20) -> DataFrame:
    """Pack all documents into sequences of at most `capacity.tokens` ids.

    A document is its text's ids and then `end_id`; only documents longer than a sequence are
    cut. Returns per piece doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    Null or empty text: the end id alone. Null or repeated ids: each row is a document of its
    own. An empty table gives no rows. Other columns of `docs` are not read. cache: bytes of
    encoded words that a worker may keep, twice.
    """
    capacity = capacity or Capacity()
    cut = materialize(pieces(docs, tokenizer, end_id, capacity.tokens, cache), "pieces")
    counted = materialize(cut.groupBy("task", "length").agg(F.count("*").alias("n")), "piece-counts", narrow=True)
    totals = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = docs.sparkSession.sparkContext.broadcast(plan_bins(totals, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    schema = pa.schema([*list(PIECES)[:5], ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def assign(batches):
        for batch in batches:
            length, number = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            bins, offset = place(plan.value, length, number)
            yield record(schema, [*batch.columns[:5], pa.array(bins), pa.array(offset)])

    numbered = cut.join(bases.hint("shuffle_merge"), ["task", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("number")
    )
    return numbered.mapInArrow(
        tidy(assign), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
