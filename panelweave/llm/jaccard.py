"""Exact n-gram Jaccard join in the metric space of shingle sets.

Jaccard distance is a metric, and t = 1 - threshold is the join's radius. The space is cut into
regions around pivots, coarse to fine:

1. Single shingles are the first pivots. The distance of a set to {s} is below 1 only if it holds
   s, so a set's cells are those of its shingles; with shingles ordered by how few documents
   use them, the triangle inequality leaves a window: two sets within t share one of their
   first n - ceil(threshold n) + 1 shingles, and their sizes differ by the threshold at most.
   A set is replicated to the cells in its window. A sketch of each set, the parities of its counts in a
   table, bounds its difference from another from below: a set that no other one in its cells can be
   linked with goes, and cells that share a set that stays become one region. Chance meetings grow with
   the corpus, and without this they would join nearly all sets to one region.
2. Inside a region documents are pivots. |d(x,p) - d(y,p)| <= d(x,y) rules pairs out, sets
   within t of a pivot are linked at once, and a Voronoi cell holds its own sets and those within 2t of
   its border; cells are joined recursively, and only pairs that may join two components are compared.
   The recursion runs across tasks as long as a cell is too large for one, and then inside it.

Documents alone can't be the first pivots: nearly all lie at distance 1 of each other, so every set
would stand in every window. A single shingle is the pivot that tells such sets apart.

Equal sets are one class throughout. Classes are named by a 64-bit hash of their set, and
shingles are 64-bit hashes; links are decided on whole sets by integer arithmetic.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.accumulators import AccumulatorParam
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, grouped, materialize, pack_deltas, pack_varints, record, slices, texts_of, tidy, unpack_deltas, unpack_varints
from .components import connected_components

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class JaccardJoin:
    """words: of a shingle. percent: two sets link when 100 * intersection >= percent * union."""

    words: int = 4
    percent: int = 85

    def linked(self, both: int, a: int, b: int) -> bool:
        return 100 * both >= self.percent * (a + b - both)

    def may_link(self, apart, a, b):
        """Whether sets of sizes a and b that differ by `apart` shingles or more can be linked."""
        return (100 + self.percent) * apart <= (100 - self.percent) * (a + b)

    def probe_prefix(self, n: int) -> int:
        """Shingles, rarest first, of which a set shares one with any set it is linked to."""
        return n - -(-self.percent * n // 100) + 1

    def index_prefix(self, n: int) -> int:
        """As many do where the other set is at least as large."""
        return n - -(-2 * self.percent * n // (100 + self.percent)) + 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Shingle sets of texts as ascending arrays of 64-bit hashes."""

    def __init__(self, words: int, clear_at: int = 300_000):
        self.words, self.clear_at, self.known = words, clear_at, _Hashes()

    def set_of(self, text: str) -> np.ndarray:
        parts = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
        if len(self.known) > self.clear_at:
            self.known.clear()
        h = np.fromiter(map(self.known.__getitem__, parts), dtype=np.uint64, count=len(parts))
        if len(parts) < self.words:
            return h[:0] if not parts else np.array([xxhash.xxh3_64_intdigest(b" ".join(parts), len(parts))], dtype=np.uint64)
        n = len(h) - self.words + 1
        out = h[:n]
        for k in range(1, self.words):
            out = _mix(out * _SPREAD + h[k : k + n])
        out = np.sort(out)
        return out[np.append(True, out[1:] != out[:-1])]


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def key_of(shingles: np.ndarray) -> int:
    """Name of a set's class, a signed 64-bit number."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes()))))


# --- Sketches --------------------------------------------------------------------------------


def sketch_of(shingles: np.ndarray) -> bytes:
    """Parities of how many shingles fall into each of 0.6 to 1.2 places a shingle, a power of two."""
    places = max(8, 1 << math.ceil(math.log2(0.6 * len(shingles))))
    odd = np.bincount((shingles & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row of two tables of sketches, what their sets differ by at least: an odd place has one more shingle on one side.

    Halves of a longer sketch add up to the sketch of half its length.
    """
    width = min(a.shape[1], b.shape[1])
    while a.shape[1] > width:
        a = a[:, : a.shape[1] // 2] ^ a[:, a.shape[1] // 2 :]
    while b.shape[1] > width:
        b = b[:, : b.shape[1] // 2] ^ b[:, b.shape[1] // 2 :]
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def _table(sketches: list[bytes]) -> np.ndarray:
    """Sketches of one length as rows."""
    return np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), -1)


class Sketches:
    """Sketches side by side, so that one pass tells another one's least differences from all of them."""

    def __init__(self, sketches: list[bytes]):
        self.lengths = np.array([len(x) for x in sketches], dtype=np.int64)
        self.tables = {w: _table([x for x in sketches if len(x) == w]) for w in np.unique(self.lengths).tolist()}

    def apart(self, sketch: bytes) -> np.ndarray:
        out = np.zeros(len(self.lengths), dtype=np.int64)
        for w, table in self.tables.items():
            out[self.lengths == w] = least_difference(table, _table([sketch]))
        return out


# --- Frequencies of shingles -----------------------------------------------------------------

#: Bits of a shingle that tell its counter, and how many of the most frequent counters are kept.
COUNTER_BITS, COMMON = 34, 1 << 20

_FIRST = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("text_hash", pa.int64()), ("range", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])


def _sets(docs: DataFrame, join: JaccardJoin, bits: int, hold: int = 1 << 21) -> DataFrame:
    """kind 0: doc_id, set size, class, text_hash and (a) sketch of each document. kind 1: by range of shingles, counters and counts."""

    def read(batches):
        shingler, held, size = Shingler(join.words), [], 0

        def flush():
            counter, times = np.unique(np.concatenate(held) >> np.uint64(64 - COUNTER_BITS), return_counts=True)
            edges = np.searchsorted(counter >> np.uint64(COUNTER_BITS - bits), np.arange((1 << bits) + 1))
            some = [r for r in range(1 << bits) if edges[r] < edges[r + 1]]
            a = [pack_deltas(counter[edges[r] : edges[r + 1]]) for r in some]
            b = [pack_varints(times[edges[r] : edges[r + 1]]) for r in some]
            none = [None] * len(some)
            return record(_FIRST, [[1] * len(some), none, none, none, none, some, a, b])

        for batch in slices(batches):
            sets = [shingler.set_of(t) for t in texts_of(batch.column(1))]
            none = [None] * len(sets)
            sketches = [sketch_of(s) if len(s) else None for s in sets]
            yield record(_FIRST, [[0] * len(sets), batch.column(0), [len(s) for s in sets], [key_of(s) for s in sets], batch.column(2), none, sketches, none])
            held += [s for s in sets if len(s)]
            size += sum(map(len, sets))
            if size >= hold:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(tidy(read), "kind int, doc_id long, n long, key long, text_hash long, range int, a binary, b binary")


def _common(first: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent counters and their counts: COMMON of them at most, an equal share of each range."""
    share = max(1, COMMON >> bits)

    def add(pdf):
        import pandas as pd

        counter = np.concatenate([unpack_deltas(a) for a in pdf["a"]])
        times = np.concatenate([unpack_varints(b) for b in pdf["b"]]).astype(np.float64)
        every, place = np.unique(counter, return_inverse=True)
        total = np.bincount(place, weights=times).astype(np.int64)
        best = np.lexsort((every, -total))[:share]
        best = np.sort(best[total[best] >= 3])
        return pd.DataFrame({"range": [int(pdf["range"].iloc[0])], "a": [pack_deltas(every[best])], "b": [pack_varints(total[best])]})

    got = sorted(first.where("kind = 1").select("range", "a", "b").groupBy("range").applyInPandas(grouped(add), "range int, a binary, b binary").collect())
    if not got:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return np.concatenate([unpack_deltas(bytes(r["a"])) for r in got]), np.concatenate([unpack_varints(bytes(r["b"])) for r in got]).astype(np.int64)


class Rarity:
    """Orders shingles: those outside the common ones first, then by count; ties by hash."""

    def __init__(self, counters: np.ndarray, counts: np.ndarray):
        self.counters, self.counts = counters, counts
        self.maybe = np.zeros(1 << 22, dtype=bool)
        self.maybe[(counters >> np.uint64(COUNTER_BITS - 22)).astype(np.int64)] = True

    def order(self, shingles: np.ndarray) -> np.ndarray:
        level = np.zeros(len(shingles), dtype=np.int64)
        some = np.flatnonzero(self.maybe[(shingles >> np.uint64(42)).astype(np.int64)])
        if len(some):
            counter = shingles[some] >> np.uint64(64 - COUNTER_BITS)
            at = np.minimum(np.searchsorted(self.counters, counter), len(self.counters) - 1)
            level[some] = np.where(self.counters[at] == counter, self.counts[at], 0)
        return shingles[np.argsort(level, kind="stable")]


# --- Cells of single shingles ----------------------------------------------------------------

_CELLS = pa.schema([("range", pa.int32()), ("s", pa.binary()), ("key", pa.binary()), ("n", pa.binary())])


def thin_cells(s: np.ndarray, key: np.ndarray, n: np.ndarray, join: JaccardJoin) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What a task sends of its cells: their smallest and largest sets in each band of sizes, and links of the rest to them.

    Last, which of the sent sets stand for others of their band.

    A band is half as wide as the sizes that linked sets may differ by. So a set elsewhere that is
    in the size window of any member of a band is in that of its smallest or largest one, and a
    cell that very many sets share stays small. n holds sizes with the index flag in its low bit.
    """
    width = max(math.log(100 / join.percent) / 2, 1e-6)
    band = np.floor(np.log(n >> 1) / width).astype(np.int64)
    order = np.lexsort((key, n >> 1, band, s))
    s, key, n, band = s[order], key[order], n[order], band[order]
    fresh = np.append(True, (s[1:] != s[:-1]) | (band[1:] != band[:-1]))
    firsts = np.flatnonzero(fresh)
    group = np.cumsum(fresh) - 1
    keep = fresh | np.append(fresh[1:], True)
    n = (n & ~np.int64(1)) | np.maximum.reduceat(n & 1, firsts)[group]
    rest = ~keep & (key != key[firsts][group])
    pairs = np.unique(np.column_stack([key[firsts][group][rest], key[rest]]), axis=0)
    stands = (np.bincount(group) > 2)[group]
    return s[keep], key[keep], n[keep], pairs, stands[keep]


def _cells(docs: DataFrame, join: JaccardJoin, rarity: Rarity, bits: int, hold: int = 1 << 20) -> DataFrame:
    """By range of shingles: shingles of sets' windows (their next 32 bits), classes, sizes with two flags: stands for others, index.

    Rows without shingles hold links between classes that a task has found by itself.
    """
    shared = docs.sparkSession.sparkContext.broadcast(rarity)

    def read(batches):
        shingler, seen, size = Shingler(join.words), set(), 0
        shingles, keys, sizes = [], [], []

        def flush():
            s, k, n, pairs, stands = thin_cells(np.concatenate(shingles), np.concatenate(keys), np.concatenate(sizes), join)
            n = n >> 1 << 2 | stands << 1 | n & 1
            if len(pairs):
                spread = [int(pairs[0, 0]) & ((1 << bits) - 1)]
                yield record(_CELLS, [spread, [b""], [pairs[:, 0].astype("<i8").tobytes()], [pairs[:, 1].astype("<i8").tobytes()]])
            edges = np.searchsorted(s >> np.uint64(64 - bits), np.arange((1 << bits) + 1))
            some = [r for r in range(1 << bits) if edges[r] < edges[r + 1]]
            low = (s >> np.uint64(32 - bits)).astype("<u4")
            parts = [slice(edges[r], edges[r + 1]) for r in some]
            yield record(_CELLS, [some, [low[p].tobytes() for p in parts], [k[p].tobytes() for p in parts], [pack_varints(n[p]) for p in parts]])

        for batch in slices(batches):
            for text in texts_of(batch.column(0)):
                found = shingler.set_of(text)
                if not len(found):
                    continue
                key = key_of(found)
                if key in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(key)
                probe, index = join.probe_prefix(len(found)), join.index_prefix(len(found))
                first = shared.value.order(found)[:probe]
                shingles.append(first), keys.append(np.full(probe, key, dtype="<i8"))
                sizes.append(2 * len(found) + (np.arange(probe) < index))
                size += probe
                if size >= hold:
                    yield from flush()
                    shingles, keys, sizes, size = [], [], [], 0
        if shingles:
            yield from flush()

    return docs.mapInArrow(tidy(read), "range int, s binary, key binary, n binary")


#: A cell and size window of more sets is taken to be connected without a look at its sketches.
LISTED = 1024


def _neighbours(cells: DataFrame, join: JaccardJoin) -> DataFrame:
    """What meets in a cell and size window: links a, b that connect its classes where sure; else two classes, or more as keys."""

    def star(pdf):
        import pandas as pd

        told = pdf["s"].map(len) == 0
        ready = [np.column_stack([np.frombuffer(x, "<i8"), np.frombuffer(y, "<i8")]) for x, y in zip(pdf["key"][told], pdf["n"][told], strict=True)]
        pairs, two, more = np.concatenate([np.zeros((0, 2), dtype=np.int64), *ready]), np.zeros((0, 2), dtype=np.int64), []
        pdf = pdf[~told]
        if len(pdf):
            s = np.concatenate([np.frombuffer(x, "<u4") for x in pdf["s"]])
            key = np.concatenate([np.frombuffer(x, "<i8") for x in pdf["key"]])
            n = np.concatenate([unpack_varints(x) for x in pdf["n"]]).astype(np.int64)
            order = np.lexsort((key, n >> 2, s))
            s, key, n = s[order], key[order], n[order]
            size = n >> 2
            fresh = np.append(True, (s[1:] != s[:-1]) | (100 * size[:-1] < join.percent * size[1:]))
            run = np.cumsum(fresh) - 1
            new = fresh | np.append(True, key[1:] != key[:-1])
            many = np.bincount(run, weights=new)
            useful = (np.bincount(run, weights=n & 1) > 0) & (many > 1)
            sure = useful & ((np.bincount(run, weights=n >> 1 & 1) > 0) | (many > LISTED))
            first = key[np.flatnonzero(fresh)][run]
            keep = sure[run] & (first != key)
            a, b = np.minimum(first[keep], key[keep]), np.maximum(first[keep], key[keep])
            pairs = np.concatenate([np.column_stack([a, b]), pairs])
            keep = (useful & ~sure)[run] & new
            order = np.lexsort((key[keep], run[keep]))
            key, run = key[keep][order], run[keep][order]
            starts = np.flatnonzero(np.diff(run, prepend=-1))
            lengths = np.diff(np.append(starts, len(run)))
            at = starts[lengths == 2]
            two = np.unique(np.column_stack([key[at], key[at + 1]]), axis=0)
            more = list({key[i : i + m].tobytes(): key[i : i + m] for i, m in zip(starts[lengths > 2], lengths[lengths > 2], strict=True)}.values())
        pairs = np.unique(pairs, axis=0)
        none = [None] * len(more)
        a, b = ([*pairs[:, i].tolist(), *two[:, i].tolist(), *none] for i in range(2))
        short = [None] * (len(pairs) + len(two))
        return pd.DataFrame({"a": pd.array(a, dtype="Int64"), "b": pd.array(b, dtype="Int64"), "sure": np.arange(len(a)) < len(pairs), "keys": pd.Series([*short, *more], dtype=object)})

    return cells.groupBy("range").applyInPandas(grouped(star), "a long, b long, sure boolean, keys array<long>")


def sketched(sketches: list[bytes], sizes: np.ndarray, join: JaccardJoin) -> np.ndarray:
    """Root place of each set's component, of those that sketches leave possible; sizes ascend."""
    roots, lengths = Roots(len(sizes)), np.array([len(x) for x in sketches])
    tables = {w: _table([x for x in sketches if len(x) == w]) for w in np.unique(lengths).tolist()}
    row = np.zeros(len(sizes), dtype=np.int64)
    for w in tables:
        row[lengths == w] = np.arange((lengths == w).sum())
    for i in range(len(sizes) - 1):
        rest = np.arange(i + 1, len(sizes))
        rest = rest[(join.percent * sizes[rest] <= 100 * sizes[i]) & (roots.of[rest] != roots.of[i])]
        for w, table in tables.items():
            some = rest[lengths[rest] == w]
            if len(some):
                apart = least_difference(table[row[some]], _table([sketches[i]]))
                near = some[join.may_link(apart, sizes[i], sizes[some])]
                if len(near):
                    roots.link(i, near)
    return roots.of


def _near(lists: DataFrame, sketches: DataFrame, join: JaccardJoin, groups: int) -> DataFrame:
    """Links a, b of the classes in each list (keys): near, those that connect what sketches leave possible, and the others."""

    def work(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["cell", "n", "key"])
        cell, key, n, sketch = pdf["cell"].to_numpy(), pdf["key"].to_numpy(), pdf["n"].to_numpy(), pdf["sketch"].tolist()
        starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        lengths, width = np.diff(np.append(starts, len(cell))), np.array([len(x) for x in sketch])
        two = starts[lengths == 2]
        a, b, near = [key[two]], [key[two + 1]], np.zeros(len(two), dtype=bool)
        for x, y in set(zip(width[two].tolist(), width[two + 1].tolist(), strict=True)):
            some = np.flatnonzero((width[two] == x) & (width[two + 1] == y))
            at = two[some]
            apart = least_difference(_table([sketch[i] for i in at]), _table([sketch[i + 1] for i in at]))
            near[some] = join.may_link(apart, n[at], n[at + 1])
        near = [near]
        for i, m in zip(starts[lengths > 2], lengths[lengths > 2], strict=True):
            of, own = sketched(sketch[i : i + m], n[i : i + m], join), key[i : i + m]
            # Each set beside its root, and each root beside the first.
            inner, heads = np.flatnonzero(of != np.arange(m)), np.unique(of)[1:]
            a += [own[of[inner]], np.full(len(heads), own[0])]
            b += [own[inner], own[heads]]
            near += [np.ones(len(inner), dtype=bool), np.zeros(len(heads), dtype=bool)]
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b), "near": np.concatenate(near)})

    rows = lists.select(F.xxhash64("keys").alias("cell"), F.explode("keys").alias("key"))
    own = sketches.join(rows.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    rows = rows.join(own, "key").withColumn("g", F.pmod(F.xxhash64("cell"), F.lit(groups)))
    return rows.groupBy("g").applyInPandas(grouped(work), "a long, b long, near boolean")


def _regions(met: DataFrame, sketches: DataFrame, join: JaccardJoin, groups: int, most: int = 4096) -> DataFrame:
    """node, root: regions of the classes that may be linked with another one.

    Classes that meet are in one region, whether sketches leave their link possible or not; but for regions of over
    `most` classes, which fall into what possible links connect.
    """
    met = materialize(met, "jaccard-met-in-cells")
    lists = met.where("NOT sure").select(F.coalesce("keys", F.array("a", "b")).alias("keys")).distinct()
    links = materialize(_near(lists, sketches, join, groups).unionByName(met.where("sure").select("a", "b", F.lit(True).alias("near"))), "jaccard-near", narrow=True)
    discard(met)
    possible = links.where("near")
    stay = possible.select("a").union(possible.select("b")).distinct()
    both = links.join(stay, "a", "left_semi").join(stay.withColumnRenamed("a", "b"), "b", "left_semi")
    regions = connected_components(both.select("a", "b"))
    large = materialize(regions.groupBy("root").count().where(F.col("count") > most).select("root"), "jaccard-large-regions", narrow=True)
    if large.take(1):
        finer = connected_components(possible.select("a", "b")).withColumnRenamed("root", "finer")
        parted = regions.join(large, "root", "left_semi").join(finer, "node").select("node", F.col("finer").alias("root"))
        regions = regions.join(large, "root", "left_anti").select("node", "root").unionByName(parted)
    return regions


# --- Regions: document pivots ----------------------------------------------------------------


class Roots:
    """Components among places 0..n-1."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def link(self, i: int, others: np.ndarray) -> None:
        mine = np.unique(np.append(self.of[others], self.of[i]))
        if len(mine) > 1:
            self.of[np.isin(self.of, mine)] = mine[0]


class Sets:
    """Sets side by side, so that one pass meets all of them with a pivot."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)

    def shared(self, pivot: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of `pivot` with the sets at `places`."""
        if not len(places):
            return np.zeros(0, dtype=np.int64)
        flat = np.concatenate([self.sets[i] for i in places])
        at = np.minimum(np.searchsorted(pivot, flat), len(pivot) - 1)
        sizes = self.sizes[places]
        return np.add.reduceat((pivot[at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)


#: A set farther than this from every pivot of a cell belongs to none of them yet.
FAR = 0.6


def windows_of(table: np.ndarray, radius: float, slack: float = 1e-9) -> np.ndarray:
    """Which Voronoi cells hold a set, from its distances to the pivots; the last column is the rest, far from all of them.

    Of two sets within the radius, let x be the one nearer to its pivot, at distance m <= FAR. The other
    is within m + radius of that pivot, so within its own nearest distance + radius and within FAR +
    radius. Where both are farther than FAR from all pivots, both are in the rest. So they meet in one cell.
    """
    nearest = table.min(axis=1, keepdims=True)
    inside = table <= np.minimum(nearest, FAR) + radius + slack
    return np.column_stack([inside, nearest[:, 0] > FAR])


def join_region(sets: list[np.ndarray], join: JaccardJoin, seen: Counter | None = None, few: int = 3) -> np.ndarray:
    """Root place of each set's component in one region that fits into memory; sets are not empty.

    seen: counts regions, pivots met, cells by depth, and pairs compared.
    """
    all_sets, roots, seen = Sets(sets), Roots(len(sets)), Counter() if seen is None else seen
    seen["regions"] += 1
    radius, slack = 1 - join.percent / 100, 1e-9

    def meet(pivot: int, places: np.ndarray) -> np.ndarray:
        """Link what lies within the radius of a pivot; distances of the places from it."""
        both = all_sets.shared(sets[pivot], places)
        seen["pairs"] += len(places)
        union = all_sets.sizes[places] + len(sets[pivot]) - both
        roots.link(pivot, places[100 * both >= join.percent * union])
        return 1 - both / union

    def scan(places: np.ndarray, distances: list[np.ndarray]) -> None:
        """Test every pair that may join two components: one of its sets lies outside the largest."""
        while True:
            names, sizes = np.unique(roots.of[places], return_counts=True)
            if len(names) == 1:
                return
            outside = np.flatnonzero(roots.of[places] != names[np.argmax(sizes)])
            todo = outside[~done[places[outside]]]
            if not len(todo):
                return
            i = todo[0]
            p = places[i]
            near = (roots.of[places] != roots.of[p]) & (100 * all_sets.sizes[places] >= join.percent * all_sets.sizes[p]) & (join.percent * all_sets.sizes[places] <= 100 * all_sets.sizes[p])
            for d in distances:
                near &= np.abs(d - d[i]) <= radius + slack
            meet(p, places[near])
            done[p] = True

    def cells(places: np.ndarray, depth: int) -> None:
        if len(places) < 2 or len(np.unique(roots.of[places])) == 1:
            return
        if len(places) <= few or depth > 6:
            scan(places, [])
            return
        step = max(1, len(places) // min(8, math.isqrt(len(places))))
        pivots = places[::step]
        distances = [meet(p, places) for p in pivots]
        held = windows_of(np.column_stack(distances), radius)
        inside = [cell for cell in (places[held[:, c]] for c in range(held.shape[1])) if len(cell) > 1]
        seen["pivots_met"] += len(pivots) * len(places)
        if max(map(len, inside), default=0) > 0.7 * len(places):
            scan(places, distances)
            return
        seen[f"cells_at_depth_{depth + 1}"] += len(inside)
        for cell in inside:
            done[cell] = False
            cells(cell, depth + 1)

    done = np.zeros(len(sets), dtype=bool)
    cells(np.arange(len(sets)), 0)
    return roots.of


#: Bits of the filter that tells which documents' sets are wanted: 16 MB, whatever the corpus.
FILTER_BITS, FILTER_PART = 27, 16


def _places(text_hash: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
    """Filter places of (text, document)."""
    mixed = _mix(text_hash.astype(np.int64).view(np.uint64) * _SPREAD + _mix(doc_id.astype(np.int64).view(np.uint64)))
    return (mixed >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _filter(wanted: DataFrame) -> np.ndarray:
    """Packed bits of the rows (text_hash, rep) of `wanted`."""
    schema = pa.schema([("part", pa.int32()), ("bits", pa.binary())])

    def bits(batches):
        for batch in batches:
            at = np.unique(_places(batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            part = at >> FILTER_PART
            firsts = np.flatnonzero(np.diff(part, prepend=-1))
            low = (at & ((1 << FILTER_PART) - 1)).astype("<u2")
            cuts = np.append(firsts, len(at))
            yield record(schema, [part[firsts], [low[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]])

    def merge(pdf):
        import pandas as pd

        out = np.zeros(1 << FILTER_PART, dtype=bool)
        for b in pdf["bits"]:
            out[np.frombuffer(b, "<u2")] = True
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "bits": [np.packbits(out).tobytes()]})

    table = np.zeros((1 << (FILTER_BITS - FILTER_PART), 1 << (FILTER_PART - 3)), dtype=np.uint8)
    for r in wanted.select("text_hash", "rep").mapInArrow(tidy(bits), "part int, bits binary").groupBy("part").applyInPandas(grouped(merge), "part int, bits binary").collect():
        table[r["part"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return table.ravel()


def _members(docs: DataFrame, wanted: np.ndarray, join: JaccardJoin) -> DataFrame:
    """key and shingles of documents in the filter, read again from their text; no other text is cut into words."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)
    schema = pa.schema([("key", pa.int64()), ("shingles", pa.binary())])

    def read(batches):
        shingler = Shingler(join.words)
        for batch in slices(batches):
            at = _places(batch.column(2).to_numpy(), batch.column(0).to_numpy(zero_copy_only=False))
            hit = (shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
            if hit.any():
                sets = [s for t in texts_of(batch.column(1).filter(pa.array(hit.astype(bool)))) if len(s := shingler.set_of(t))]
                yield record(schema, [[key_of(s) for s in sets], [s.tobytes() for s in sets]])

    return docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(tidy(read), "key long, shingles binary")


def _leaves(members: DataFrame, join: JaccardJoin, groups: int, tally=None) -> DataFrame:
    """Links a, b (a class and its root) inside cells that fit into a task; many cells share a task."""

    def work(pdf):
        import pandas as pd

        a, b, seen = [], [], Counter()
        for _, cell in pdf.sort_values(["cell", "key"]).groupby("cell", sort=False):
            key = cell["key"].to_numpy()
            of = join_region([np.frombuffer(s, dtype=np.uint64) for s in cell["shingles"]], join, seen)
            a.append(key), b.append(key[of])
        if tally is not None:
            tally.add(seen)
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    spread = members.select("cell", "key", "shingles", F.pmod(F.xxhash64("cell"), F.lit(groups)).alias("g"))
    return spread.groupBy("g").applyInPandas(grouped(work), "a long, b long")


def _measured(chunks: DataFrame, pivots: DataFrame, join: JaccardJoin, tally=None) -> DataFrame:
    """One step of the recursion: links a, b of sets with pivots of their cell; and, where cell isn't null, the Voronoi
    cells (of parent) whose window holds a set, with its sum of distances to all pivots. A cell's rest is one of them.
    Windows name sets, their shingles stay behind: nearly all windows may hold a set.
    """
    radius = 1 - join.percent / 100
    schema = "a long, b long, cell long, parent long, rest boolean, key long, far double"

    def work(pdf):
        import pandas as pd

        here, centres = pdf[~pdf["pivot"]], pdf[pdf["pivot"]].sort_values("key")
        if not len(here):
            return pd.DataFrame(columns=names_of)
        sets, keys, every = Sets([np.frombuffer(s, dtype=np.uint64) for s in here["shingles"]]), here["key"].to_numpy(), np.arange(len(here))
        parent, table, links = int(here["cell"].iloc[0]), np.empty((len(here), len(centres))), []
        for c, (key, raw) in enumerate(zip(centres["key"], centres["shingles"], strict=True)):
            pivot = np.frombuffer(raw, dtype=np.uint64)
            both = sets.shared(pivot, every)
            union = sets.sizes + len(pivot) - both
            near = (100 * both >= join.percent * union) & (keys != key)
            links.append(np.column_stack([np.full(near.sum(), key), keys[near]]))
            table[:, c] = 1 - both / union
        links = np.concatenate(links)
        row, column = np.nonzero(windows_of(table, radius))
        names = [np.int64(np.uint64(xxhash.xxh3_64_intdigest(np.array([parent, *k], dtype="<i8").tobytes()))) for k in [*([k] for k in centres["key"]), []]]
        if tally is not None:
            tally.add(Counter(pivots_met=len(here) * len(centres), windows=len(row), split_across_tasks=len(here)))
        met = pd.DataFrame({"a": links[:, 0], "b": links[:, 1]}, dtype="Int64")
        cells = pd.DataFrame({"cell": np.array(names, dtype=np.int64)[column], "parent": parent, "key": keys[row]}, dtype="Int64")
        cells["rest"], cells["far"] = column == len(centres), table.sum(axis=1)[row]
        return pd.concat([met, cells], ignore_index=True)[names_of]

    names_of = [c.split()[0] for c in schema.split(", ")]
    columns = ["cell", "chunk", "pivot", "key", "shingles"]
    return chunks.select(*columns).unionByName(pivots.select(*columns)).groupBy("cell", "chunk").applyInPandas(grouped(work), schema)


def _against_chunks(members: DataFrame, roots: DataFrame, join: JaccardJoin, part_size: int = 512, part_shingles: int = 1 << 21, tally=None) -> DataFrame:
    """Links of cells that pivots don't part: each set outside a cell's largest component meets every chunk of its cell.

    A chunk moves once for every `part_size` of these sets, or `part_shingles` of their shingles. Pairs that sketches rule out aren't compared.
    """

    def work(pdf):
        import pandas as pd

        here, left = pdf[~pdf["pivot"]], pdf[pdf["pivot"]]
        sets, out = Sets([np.frombuffer(s, dtype=np.uint64) for s in here["shingles"]]), [np.zeros((0, 2), dtype=np.int64)]
        keys, every, sketches, seen = here["key"].to_numpy(), np.arange(len(here)), Sketches([sketch_of(s) for s in sets.sets]), Counter(sets_moved=len(pdf))
        for key, raw in zip(left["key"], left["shingles"], strict=True):
            one = np.frombuffer(raw, dtype=np.uint64)
            near = (100 * sets.sizes >= join.percent * len(one)) & (join.percent * sets.sizes <= 100 * len(one)) & (keys != key)
            near = every[near & join.may_link(sketches.apart(sketch_of(one)), sets.sizes, len(one))]
            seen["pairs"] += len(near)
            both = sets.shared(one, near)
            found = near[100 * both >= join.percent * (sets.sizes[near] + len(one) - both)]
            out.append(np.column_stack([np.full(len(found), key), keys[found]]))
        links = np.concatenate(out)
        if tally is not None:
            tally.add(seen)
        return pd.DataFrame({"a": links[:, 0], "b": links[:, 1]})

    named = members.join(roots, F.col("key") == F.col("node"), "left").select("cell", "key", "shingles", "chunk", "chunks", F.coalesce("root", "key").alias("root"))
    main = named.groupBy("cell", "root").agg(F.count("*").alias("n")).groupBy("cell").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
    left = named.join(main, "cell").where("root <> main")
    parts = F.greatest(F.ceil(F.count("*") / part_size), F.ceil(F.sum(F.octet_length("shingles") / 8) / part_shingles))
    parts = materialize(left.groupBy("cell").agg(parts.cast("int").alias("parts")), "jaccard-parts", narrow=True)
    left = left.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("key", F.lit(5)), F.col("parts")).cast("int"))
    left = left.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks").cast("long") - 1)))
    here = named.join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    columns = ["cell", "chunk", "part", "key", "shingles"]
    both = here.select(*columns, F.lit(False).alias("pivot")).unionByName(left.select(*columns, F.lit(True).alias("pivot")))
    return both.groupBy("cell", "chunk", "part").applyInPandas(grouped(work), "a long, b long")


def _recursion(members: DataFrame, join: JaccardJoin, region_sets: int, region_shingles: int, groups: int, tally=None, pivots: int = 48, central: int = 4, levels: int = 12) -> DataFrame:
    """Links that connect the classes of cells (cell, key, shingles): whatever a cell's size, by recursion across tasks.

    A cell that fits into a task is joined there. A larger one gets document pivots, about `pivots` by hash and those
    that were nearest to all pivots of the level before, as the middle of a cluster is; its sets go to the Voronoi cells
    whose windows hold them, but for cells that are connected already. Where a pivot's cell keeps
    over four fifths of its parent, or the cells together hold over four times its sets, the pivots
    tell too little apart; there, and beyond the last level, a cell's unconnected sets meet its chunks.
    """
    now, links = materialize(members.select("cell", "key", "shingles", F.lit(None).cast("double").alias("far")), "jaccard-cells"), []
    for level in range(levels + 1):
        sizes = now.groupBy("cell").agg(F.count("*").alias("sets"), F.sum(F.octet_length("shingles") / 8).alias("shingles"))
        sizes = sizes.select("cell", "sets", F.greatest(F.ceil(F.col("sets") / region_sets), F.ceil(F.col("shingles") / region_shingles)).alias("chunks"))
        sizes = materialize(sizes, "jaccard-sizes", narrow=True)
        links.append(materialize(_leaves(now.join(sizes.where("chunks = 1"), "cell"), join, groups, tally), "jaccard-links", narrow=True))
        large = now.join(sizes.where("chunks > 1"), "cell").withColumn("chunk", F.pmod(F.xxhash64("key", F.lit(77)), F.col("chunks")))
        large = materialize(large, "jaccard-large")
        discard(now)
        if not large.take(1):
            break
        if level == levels:
            links.append(materialize(_against_chunks(large, connected_components(_union(links)), join, tally=tally), "jaccard-links", narrow=True))
            break
        bucket = F.pmod(F.xxhash64("key", F.lit(level)), F.lit(central))
        nearest = [F.min(F.when(F.col("far").isNotNull() & (bucket == i), F.struct("far", "key")))["key"] for i in range(central)]
        some = F.array_compact(F.array(F.min_by("key", F.xxhash64("key", F.lit(level))), *nearest))
        picked = large.groupBy("cell", "chunks").agg(some.alias("keys")).select("cell", "chunks", F.explode("keys").alias("key"))
        by_hash = large.where(F.pmod(F.xxhash64("key", F.lit(100 + level)), F.ceil(F.col("sets") / pivots)) == 0)
        picked = materialize(picked.unionByName(by_hash.select("cell", "chunks", "key")).distinct(), "jaccard-pivots", narrow=True)
        centres = large.select("cell", "key", "shingles").join(picked, ["cell", "key"])
        centres = centres.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks").cast("long") - 1))).withColumn("pivot", F.lit(True))
        met = materialize(_measured(large.withColumn("pivot", F.lit(False)), centres, join, tally), "jaccard-met")
        links.append(met.where("cell IS NULL").select("a", "b"))
        roots = connected_components(_union(links))
        cells = met.where("cell IS NOT NULL").join(roots, F.col("key") == F.col("node"), "left").withColumn("root", F.coalesce("root", "key"))
        grown = cells.groupBy("parent", "cell", "rest").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
        grown = materialize(grown.join(sizes.select(F.col("cell").alias("parent"), "sets"), "parent"), "jaccard-grown", narrow=True)
        stuck = grown.groupBy("parent").agg(F.max(F.when(~F.col("rest"), F.col("n"))).alias("most"), F.sum("n").alias("held"), F.max("sets").alias("sets"))
        stuck = stuck.where("most > 0.8 * sets OR held > 4 * sets").select(F.col("parent").alias("cell"))
        links.append(materialize(_against_chunks(large.join(stuck, "cell", "left_semi"), roots, join, tally=tally), "jaccard-links", narrow=True))
        fresh = grown.join(stuck.withColumnRenamed("cell", "parent"), "parent", "left_anti").select("cell")
        held = cells.join(fresh, "cell", "left_semi").select("cell", "parent", "key", "far")
        now = held.join(large.select(F.col("cell").alias("parent"), "key", "shingles"), ["parent", "key"])
        now = materialize(now.select("cell", "key", "shingles", "far"), "jaccard-cells")
        discard(large, grown)
    return _union(links)


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def accumulator(spark):
    """Counts what the tasks of a join do; a task that runs twice counts twice."""
    return spark.sparkContext.accumulator(Counter(), _Tally())


class _Tally(AccumulatorParam):
    """Adds up counters of what tasks did."""

    def zero(self, value):
        return Counter()

    def addInPlace(self, a, b):
        a.update(b)
        return a


def jaccard_components(docs: DataFrame, join: JaccardJoin | None = None, region_sets: int = 256, region_shingles: int = 1 << 21, tally=None) -> DataFrame:
    """Per document doc_id, n_shingles, component_id, class_id, set_key, head_key, text_hash.

    Words are runs between ASCII white space, lower-cased A to Z; a document's set is its distinct
    shingles, or its whole sequence where that has fewer words. Documents link when their sets'
    Jaccard similarity reaches the join's percentage; component_id is the smallest doc_id that
    links reach, class_id the smallest with an equal set. set_key names the set, head_key the set of the
    component's first document, text_hash (xxhash64) a row's text. Null text and text without words have an empty set (n_shingles 0,
    keys null) and link with nothing. Repeated rows and ids keep a row each. A null id counts as the
    largest and is returned as null; an empty table gives no rows. Other columns are not read.
    tally: an accumulator() of this module that counts pivots, windows, cells and pairs.
    """
    join = join or JaccardJoin()
    last = (1 << 63) - 1
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(last)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    bits = max(6, math.ceil(math.log2(max(1, docs.count()) / 8000)))
    first = materialize(_sets(docs, join, bits), "jaccard-sets", ("kind",))
    rows = first.where("kind = 0").select("doc_id", "n", "key", "text_hash")
    classes = rows.where("n > 0").groupBy("key").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.max("n").alias("n"))
    classes = classes.select("key", F.col("first.doc_id").alias("rep"), F.col("first.text_hash").alias("text_hash"), "n")
    classes = materialize(classes, "jaccard-classes", narrow=True)
    rarity = Rarity(*_common(first, bits))
    discard(first, part="kind=1")
    shuffles = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sketches = first.where("kind = 0 AND n > 0").select("key", "n", F.col("a").alias("sketch"))
    regions = _regions(_neighbours(_cells(docs.select("text"), join, rarity, bits), join), sketches, join, 4 * shuffles)
    regions = materialize(regions.join(classes, F.col("node") == F.col("key")).select("key", F.col("root").alias("label"), "rep", "text_hash", "n"), "jaccard-regions", narrow=True)
    wanted = regions.select("key", F.col("label").alias("cell"))
    members = _members(docs, _filter(regions), join).join(wanted, "key").dropDuplicates(["key"])
    total = regions.agg(F.sum("n")).first()[0] or 0
    roots = connected_components(_recursion(members, join, region_sets, region_shingles, max(4 * shuffles, total // 500_000 + 1), tally))
    named = classes.join(roots, F.col("key") == F.col("node"), "left").select("key", "rep", F.coalesce("root", "key").alias("root"))
    named = materialize(named, "jaccard-roots", narrow=True)
    heads = named.groupBy("root").agg(F.min(F.struct("rep", "key")).alias("head"))
    named = named.join(heads, "root").select("key", "rep", F.col("head.rep").alias("component"), F.col("head.key").alias("head_key"))
    full = rows.where("n > 0").join(named, "key").select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("rep").alias("class_id"), F.col("key").alias("set_key"), "head_key", "text_hash")
    none = F.lit(None).cast("long")
    empty = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"), none.alias("set_key"), none.alias("head_key"), "text_hash")
    known = lambda c: F.when(F.col(c) != last, F.col(c)).alias(c)
    return full.unionByName(empty).select(known("doc_id"), "n_shingles", known("component_id"), known("class_id"), "set_key", "head_key", "text_hash")
