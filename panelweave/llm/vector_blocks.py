"""A block matrix join: blocks of query vectors against blocks of all vectors, what both searches share.

Queries are a stated set. Both sides are packed into tables of blocks; query block q and share v of
the vector blocks meet in the grid's cell (q, v), where tiles of products keep the k best of each
query in heaps. A cell's size is fixed, whatever the corpus; nothing passes through the driver.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, record, slices, tidy

#: Queries in a block, candidate rows in a tile, pairs recomputed at once.
QUERY_BLOCK, TILE_ROWS, PAIR_ROWS = 8192, 2048, 32768
#: Bytes of a block of vectors, and such blocks in a cell.
BLOCK_BYTES, CELL_BLOCKS = 4 << 20, 8

RESULT = pa.schema(
    [("block", pa.int32()), ("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("key", pa.float64()), ("whole", pa.int64()), ("own", pa.bool_())]
)


def usable(rows_ids: list, rows: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension: ids and float64 vectors, without null ids, null vectors or non-finite components."""
    groups: dict[int, tuple[list, list]] = {}
    for i, v in zip(rows_ids, rows, strict=True):
        if i is not None and v is not None and None not in v:
            ids, vectors = groups.setdefault(len(v), ([], []))
            ids.append(i)
            vectors.append(v)
    out = {}
    for n, (ids, vectors) in groups.items():
        x = np.array(vectors, dtype=np.float64).reshape(len(ids), n)
        ok = np.isfinite(x).all(axis=1)
        if ok.any():
            out[n] = np.array(ids, dtype=np.int64)[ok], x[ok]
    return out


def vectors_of(batch: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """usable() of an Arrow batch (id, vector), without Python objects where all is regular."""
    ids, column = batch.column(0), batch.column(1)
    if not batch.num_rows:
        return {}
    if ids.null_count == 0 and column.null_count == 0:
        flat, offsets = column.flatten(), np.asarray(column.offsets)
        lengths = np.diff(offsets)
        if flat.null_count == 0 and (lengths == lengths[0]).all():
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, int(lengths[0]))
            ok = np.isfinite(x).all(axis=1)
            return {int(lengths[0]): (ids.to_numpy()[ok], x[ok])} if ok.any() else {}
    return usable(ids.to_pylist(), column.to_pylist())


@dataclass
class Best:
    """For each query a heap of its best k candidates; order: small key, small whole, small vec_id.

    key is a double, whole an exact integer companion for keys that a double can't hold.
    """

    queries: int
    k: int
    heaps: list[list] = field(default_factory=list)

    def __post_init__(self):
        self.heaps = [[] for _ in range(self.queries)]
        self.bound = np.full(self.queries, np.inf)

    def merge(self, query: np.ndarray, ids: np.ndarray, key: np.ndarray, whole: np.ndarray) -> None:
        """Offer candidates; those that sort after a query's k-th are passed over."""
        order = np.lexsort((ids, whole, key, query))
        query, ids, key, whole = query[order], ids[order], key[order], whole[order]
        firsts = np.flatnonzero(np.diff(query, prepend=-1))
        nth = np.arange(len(query)) - np.repeat(firsts, np.diff(np.append(firsts, len(query))))
        keep = (nth < self.k) & (key <= self.bound[query])
        for q, i, d, w in zip(query[keep].tolist(), ids[keep].tolist(), key[keep].tolist(), whole[keep].tolist(), strict=True):
            heap, item = self.heaps[q], (-d, -w, -i)
            if len(heap) < self.k:
                heapq.heappush(heap, item)
            elif item > heap[0]:
                heapq.heapreplace(heap, item)
            if len(heap) == self.k:
                self.bound[q] = -heap[0][0]


@dataclass(frozen=True)
class Kernel:
    """A nearness. keep: mask of vectors that take part. prepare: what the query side needs in
    tiles. run: offers a tile's candidates, by a lower bound of the key, to the heaps. own: key
    and whole of vectors with themselves."""

    keep: Callable[[np.ndarray], np.ndarray]
    prepare: Callable[[np.ndarray], object]
    run: Callable[[object, np.ndarray, np.ndarray, Best], None]
    own: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


def _packed(rows: DataFrame) -> DataFrame:
    """task, seq, dim, ids, x: blocks of usable vectors of one dimension as doubles."""
    schema = pa.schema([("task", pa.int32()), ("seq", pa.int32()), ("dim", pa.int32()), ("ids", pa.binary()), ("x", pa.binary())])

    def pack(batches):
        task, seq, held = TaskContext.get().partitionId(), 0, {}

        def flush(n: int):
            nonlocal seq
            ids, x = (np.concatenate(part) for part in zip(*held.pop(n), strict=True))
            seq += 1
            return record(schema, [[task], [seq], [n], [ids.astype("<i8").tobytes()], [x.astype("<f8").tobytes()]])

        for batch in slices(batches, TILE_ROWS):
            for n, part in vectors_of(batch).items():
                held.setdefault(n, []).append(part)
                if sum(len(ids) for ids, _ in held[n]) * 8 * max(1, n) >= BLOCK_BYTES:
                    yield flush(n)
        for n in sorted(held):
            yield flush(n)

    return rows.mapInArrow(tidy(pack), "task int, seq int, dim int, ids binary, x binary")


def _side_by_dim(pdf, kernel: Kernel) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """ids and vectors that take part, by dimension, in the order of their blocks."""
    out = {}
    for n, part in pdf.sort_values(["dim", "seq"]).groupby("dim", sort=True):
        ids = np.concatenate([np.frombuffer(i, "<i8") for i in part["ids"]])
        x = np.concatenate([np.frombuffer(v, "<f8") for v in part["x"]]).reshape(len(ids), int(n))
        ok = kernel.keep(x)
        if ok.any():
            out[int(n)] = ids[ok], x[ok]
    return out


def search(vectors: DataFrame, every: int, k: int, kernel: Kernel) -> DataFrame:
    """The k best rows for each row whose vec_id is divisible by `every`, by ascending key.

    vectors: columns vec_id and embedding. Returns query_id, rank, vec_id, key, whole. A query
    never finds its own row, but another row with the same id.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("embedding"))
    wanted = rows.where(F.col("vec_id") % every == 0)
    parts = max(1, -(-wanted.count() // QUERY_BLOCK))
    queries = materialize(_packed(wanted.repartition(parts)), "query-blocks")
    blocks = materialize(_packed(rows), "vector-blocks")
    n, wide = blocks.count(), 2 * vectors.sparkSession.sparkContext.defaultParallelism
    shares = max(1, min(n, wide), -(-n // CELL_BLOCKS))
    left = queries.select(F.col("task").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("v"), "seq", "dim", "ids", "x")
    share = F.pmod(F.xxhash64("task", "seq"), F.lit(shares)).cast("int").alias("v")
    right = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("q"), share, "seq", "dim", "ids", "x")

    def cell(mine, theirs):
        import pandas as pd

        out = []
        if len(mine) and len(theirs):
            number, theirs = int(mine["q"].iloc[0]), theirs.sort_values(["dim", "seq"])
            for dim, (ids, x) in _side_by_dim(mine, kernel).items():
                side, best, (own_key, own_whole) = kernel.prepare(x), Best(len(ids), k + 1), kernel.own(x)
                for _, block in theirs[theirs["dim"] == dim].iterrows():
                    them = np.frombuffer(block["ids"], "<i8")
                    y = np.frombuffer(block["x"], "<f8").reshape(len(them), dim)
                    ok = kernel.keep(y)
                    them, y = them[ok], y[ok]
                    for at in range(0, len(them), TILE_ROWS):
                        kernel.run(side, them[at : at + TILE_ROWS], y[at : at + TILE_ROWS], best)
                out += [
                    (number, q + (dim << 20), int(ids[q]), -i, -d, -w, -i == ids[q] and -d == own_key[q] and -w == own_whole[q])
                    for q, heap in enumerate(best.heaps)
                    for d, w, i in heap
                ]
        return pd.DataFrame(out, columns=RESULT.names)

    kinds = "block int, query long, query_id long, vec_id long, key double, whole long, own boolean"
    best = left.groupBy("q", "v").cogroup(right.groupBy("q", "v")).applyInPandas(lambda a, b: cell(a, b), kinds)
    return _ranked(best, k)


def _ranked(best: DataFrame, k: int) -> DataFrame:
    """Merge the partitions' bests of each query: drop one row that is the query's own, rank the rest."""
    by = Window.partitionBy("block", "query").orderBy("key", "whole", "vec_id")
    first = best.withColumn("at", F.row_number().over(by)).where(F.col("at") <= k + 1)
    itself = F.min(F.when(F.col("own"), F.col("at"))).over(Window.partitionBy("block", "query"))
    rank = F.col("at") - F.when(F.col("at") > F.col("self_at"), 1).otherwise(0)
    others = first.withColumn("self_at", itself).where((F.col("at") != F.col("self_at")) | F.col("self_at").isNull())
    return others.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "key", "whole")
