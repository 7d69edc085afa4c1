"""Token log-probabilities: exact corpus counts, and a log-bilinear model of every word seen twice.

Counting and looking counts up are one exchange of sorted blocks, not of words: a task cuts
its documents into blocks and sends each block's distinct words (64-bit hashes, with counts)
by range of hash; a range's reducer adds up and returns the totals in each block's own order.

The output is factored. The most frequent words and the end of the text are classes of their own;
the other words seen SUPPORT times fall into groups of words that stand beside like classes. Words
seen less often are one class, which so learns where unseen words stand. Level one predicts the class
from the two classes before it, score(c | a, b) = (A_a + B_b) . R_c + bias_c; level two the word in its
group from the class before it, score(w | b) = X_b . q_w + bias_w + log share_w, X being the main
directions of B. Both levels are trained by noise-contrastive estimation with sampled noise, level
one on the class trigram counts of the whole training text, level two, a vector for each word, on all
its places. Batched matrix products give both levels' normalisers, so scores are log-probabilities.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, grouped, held_out, materialize, pack_deltas, pack_varints, record, slices, texts_of, tidy, unpack_deltas, unpack_varints

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The end of a text, hashed like the word that no text can hold.
END = xxhash.xxh3_64_intdigest(b"")
#: Word classes, then: the end, rare words, before the beginning, groups of words.
WORDS, GROUPS = 253, 32
END_CLASS, OTHER, START, FIRST_GROUP = WORDS, WORDS + 1, WORDS + 2, WORDS + 3
CLASSES = FIRST_GROUP + GROUPS
#: Training places that make a word part of the vocabulary; numbers in the vectors for each side.
SUPPORT, SIDE = 2, 6
#: Numbers in a word's own vector besides its bias; steps of one in a stored number.
SIZE, STEPS_OF_ONE = 8, 24


class WordHashes(dict):
    """Hash of a word; remembers words until clear_at is passed."""

    def __init__(self, clear_at: int = 300_000):
        super().__init__()
        self.clear_at = clear_at

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, text: str) -> np.ndarray:
        """Hashes of the words of a text, lower-cased A to Z, and of the end after them."""
        words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
        words.append(b"")
        if len(self) > self.clear_at:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def _pack(array: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(array).tobytes())


def _unpack(data: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=dtype)


_BLOCKS = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("range", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])


def _blocks(docs: DataFrame, bits: int, block_tokens: int) -> DataFrame:
    """kind 0: a block's documents (ids, lengths and flags, words as places in its vocabulary).
    kind 1: one hash range of a block's vocabulary, ascending, with counts in training text."""

    def cut(batches):
        known, task, seq = WordHashes(), TaskContext.get().partitionId(), 0
        ids, flags, words, size = [], [], [], 0

        def flush():
            block = (task << 24) | seq
            lengths = np.array([len(w) for w in words], dtype="<u4")
            vocabulary, place = np.unique(np.concatenate(words), return_inverse=True)
            train = np.bincount(place[np.repeat(~np.array(flags, dtype=bool), lengths)], minlength=len(vocabulary))
            null = np.array([i is None for i in ids], dtype=np.uint8)
            head = np.array([0 if i is None else i for i in ids], dtype="<i8").tobytes()
            extra = null.tobytes() + np.array(flags, dtype=np.uint8).tobytes() + lengths.tobytes()
            yield record(_BLOCKS, [[0], [block], [-1], [head], [extra], [_pack(place.astype("<u4"))]])
            edges = np.searchsorted(vocabulary >> np.uint64(64 - bits), np.arange((1 << bits) + 1))
            some = [r for r in range(1 << bits) if edges[r] < edges[r + 1]]
            parts = [slice(edges[r], edges[r + 1]) for r in some]
            yield record(
                _BLOCKS,
                [[1] * len(some), [block] * len(some), some, [vocabulary[p].tobytes() for p in parts], [pack_varints(train[p]) for p in parts], [b""] * len(some)],
            )

        for batch in slices(batches):
            for doc, flag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2)), strict=True):
                ids.append(doc), flags.append(flag), words.append(known.of(text))
                size += len(words[-1])
                if size >= block_tokens:
                    yield from flush()
                    ids, flags, words, size, seq = [], [], [], 0, seq + 1
        if ids:
            yield from flush()

    return docs.mapInArrow(tidy(cut), "kind int, block long, range int, a binary, b binary, c binary")


def _totals(vocabulary: DataFrame, top: int) -> DataFrame:
    """Per block and range the training counts of its words; per range (block -1) its tokens, distinct words and most frequent words."""

    def add(pdf):
        import pandas as pd

        hashes = [np.frombuffer(a, dtype=np.uint64) for a in pdf["a"]]
        counts = [unpack_varints(b).astype(np.int64) for b in pdf["b"]]
        every, place = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(place, weights=np.concatenate(counts), minlength=len(every)).astype(np.int64)
        edges = np.cumsum([0] + [len(h) for h in hashes])
        back = [pack_varints(total[place[a:b]]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        best = np.lexsort((every, -total))[:top]
        best = best[total[best] > 0]
        r = int(pdf["range"].iloc[0])
        return pd.DataFrame(
            {
                "block": [*pdf["block"], -1],
                "range": [r] * (len(back) + 1),
                "a": [*back, every[best].tobytes()],
                "b": [b""] * len(back) + [total[best].tobytes()],
                "n": [0] * len(back) + [int(total.sum())],
                "v": [0] * len(back) + [int((total > 0).sum())],
            }
        )

    return vocabulary.groupBy("range").applyInPandas(grouped(add), "block long, range int, a binary, b binary, n long, v long")


def _most_frequent(totals: DataFrame, top: int) -> list[tuple[int, int]]:
    """The `top` most frequent words (hash, count) of all ranges."""
    schema = pa.schema([("word", pa.int64()), ("n", pa.int64())])

    def rows(batches):
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield record(schema, [np.frombuffer(a, "<i8"), np.frombuffer(b, "<i8")])

    found = totals.where("block = -1").select("a", "b").mapInArrow(tidy(rows), "word long, n long")
    found = found.orderBy(F.desc("n"), "word").limit(top).collect()
    return [(r["word"] & 0xFFFFFFFFFFFFFFFF, r["n"]) for r in found]


_PARTS = "kind int, block long, range int, a binary, b binary, c binary"


def _marks(vocabulary: DataFrame, frequent: list[int]) -> DataFrame:
    """kind 2: where the words with classes of their own stand in a block's range, and their classes."""
    every = np.array([*frequent, END], dtype=np.uint64)
    order = np.argsort(every)
    shared = vocabulary.sparkSession.sparkContext.broadcast((every[order], order.astype(np.uint8)))

    def find(batches):
        words, classes = shared.value
        for batch in batches:
            out = [[] for _ in range(6)]
            for block, r, a in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                hashes = np.frombuffer(a, dtype=np.uint64)
                at = np.searchsorted(hashes, words)
                ok = at < len(hashes)
                ok[ok] = hashes[at[ok]] == words[ok]
                if ok.any():
                    for column, v in zip(out, (2, block, r, at[ok].astype("<u4").tobytes(), classes[ok].tobytes(), b""), strict=True):
                        column.append(v)
            yield record(_BLOCKS, out)

    return vocabulary.select("block", "range", "a").mapInArrow(tidy(find), _PARTS)


def trigrams(classes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Code of each token's class and the two before it; texts begin after two START."""
    w = classes.astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    one, two = np.concatenate([[START], w[:-1]]), np.concatenate([[START, START], w[:-2]])[: len(w)]
    one[starts] = two[starts] = START
    second = starts[lengths > 1] + 1
    two[second] = START
    return (two * CLASSES + one) * CLASSES + w


class _Block:
    """A block's documents with the totals and classes of its words, from its rows of all kinds."""

    def __init__(self, pdf, words: int):
        head = pdf[pdf["kind"] == 0].iloc[0]
        ranges = pdf[pdf["kind"] == 1].sort_values("range")
        counts = [unpack_varints(a) for a in ranges["a"]]
        self.total = np.concatenate(counts).astype(np.int64)
        self.ranges = list(ranges["range"])
        self.edges = np.cumsum([0] + [len(c) for c in counts])
        first = dict(zip(self.ranges, self.edges[:-1], strict=True))
        self.class_of = np.full(len(self.total), OTHER, dtype=np.uint16)
        for r, a, b in pdf.loc[pdf["kind"] == 2, ["range", "a", "b"]].itertuples(index=False):
            self.class_of[first[r] + np.frombuffer(a, "<u4").astype(np.int64)] = _class_numbers(np.frombuffer(b, np.uint8), words)
        self.grouped = (self.class_of == OTHER) & (self.total >= SUPPORT)
        for r, a in pdf.loc[pdf["kind"] == 3, ["range", "a"]].itertuples(index=False):
            at = self.ranges.index(r)
            own = np.flatnonzero(self.grouped[self.edges[at] : self.edges[at + 1]]) + self.edges[at]
            self.class_of[own] = _unpack(a, np.uint8).astype(np.uint16) + FIRST_GROUP
        n = len(head["a"]) // 8
        self.ids, self.null, self.flags = head["a"], np.frombuffer(head["b"], np.uint8, n), np.frombuffer(head["b"], np.uint8, n, n)
        self.lengths = np.frombuffer(head["b"], "<u4", n, 2 * n).astype(np.int64)
        self.place = _unpack(head["c"], "<u4")
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.classes = self.class_of[self.place]
        self.train = np.repeat(self.flags == 0, self.lengths)

    def before(self) -> np.ndarray:
        """Class before each token."""
        out = np.concatenate([[START], self.classes[:-1]]).astype(np.int64)
        out[self.starts] = START
        return out


def _parts(blocks: DataFrame, totals: DataFrame, marks: DataFrame) -> DataFrame:
    back = totals.where("block >= 0").select(F.lit(1).alias("kind"), "block", "range", "a", F.lit(b"").alias("b"), F.lit(b"").alias("c"))
    return blocks.where("kind = 0").select("kind", "block", "range", "a", "b", "c").unionByName(back).unionByName(marks)


def _pairs(parts: DataFrame, words: int) -> np.ndarray:
    """How often a class stands before another in training text."""

    def count(pdf):
        import pandas as pd

        b = _Block(pdf, words)
        codes = (b.before() * FIRST_GROUP + b.classes)[b.train]
        pairs = np.bincount(codes, minlength=FIRST_GROUP**2).reshape(FIRST_GROUP, FIRST_GROUP)
        some = np.flatnonzero(pairs.any(axis=1))
        return pd.DataFrame({"one": some.astype(np.int32), "n": [pack_varints(pairs[i].astype(np.uint64)) for i in some]})

    def add(pdf):
        import pandas as pd

        total = sum(unpack_varints(n) for n in pdf["n"])
        return pd.DataFrame({"one": [int(pdf["one"].iloc[0])], "n": [pack_varints(total)]})

    out = np.zeros((FIRST_GROUP, FIRST_GROUP))
    counted = parts.groupBy("block").applyInPandas(grouped(count), "one int, n binary").groupBy("one").applyInPandas(grouped(add), "one int, n binary")
    for r in counted.collect():
        out[r["one"]] = unpack_varints(bytes(r["n"]))
    return out


def side_vectors(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of classes as the one before and as the one after, -1 to 1: main directions of what stands on their other side."""

    def main(table):
        share = np.sqrt(table / np.maximum(table.sum(axis=1, keepdims=True), 1))
        weight = np.sqrt(table.sum(axis=1) / max(1, table.sum()))
        centre = share - (weight**2) @ share
        _, _, directions = np.linalg.svd(weight[:, None] * centre, full_matrices=False)
        found = centre @ directions[:SIDE].T
        found[table.sum(axis=1) == 0] = 0
        return found / max(1e-9, np.abs(found).max())

    return main(pairs), main(pairs.T)


def _sketches(parts: DataFrame, vocabulary: DataFrame, words: int, sides: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Per block and range the words to be grouped: hashes, training counts, mean vectors of the classes at their sides."""
    hashes = vocabulary.select(F.lit(4).alias("kind"), "block", "range", "a", F.lit(b"").alias("b"), F.lit(b"").alias("c"))
    shared = vocabulary.sparkSession.sparkContext.broadcast(sides)

    def sketch(pdf):
        import pandas as pd

        b, (left, right) = _Block(pdf, words), shared.value
        number = np.cumsum(b.grouped) - 1
        size = int(b.grouped.sum())
        own = np.flatnonzero(b.grouped[b.place] & b.train)
        row = number[b.place[own]]
        # The end stands behind every word of a text.
        one, two = b.before()[own], b.classes[own + 1]
        n = np.bincount(row, minlength=size)
        means = np.column_stack([np.bincount(row, weights=v, minlength=size) for side, at in ((left, one), (right, two)) for v in side[at].T.astype(np.float32)])
        means = np.rint(127 * means / np.maximum(n, 1)[:, None]).astype(np.int8)
        word = dict(pdf.loc[pdf["kind"] == 4, ["range", "a"]].itertuples(index=False))
        out = {k: [] for k in ("block", "range", "a", "b", "c")}
        for r, i, j in zip(b.ranges, b.edges[:-1], b.edges[1:], strict=True):
            some = b.grouped[i:j]
            if some.any():
                at = number[i:j][some]
                for name, v in zip(out, (int(pdf["block"].iloc[0]), r, np.frombuffer(word[r], np.uint64)[some].tobytes(), pack_varints(n[at]), _pack(means[at])), strict=True):
                    out[name].append(v)
        return pd.DataFrame(out)

    return parts.unionByName(hashes).groupBy("block").applyInPandas(grouped(sketch), "block long, range int, a binary, b binary, c binary")


def _vectors(pdf) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a range's sketches: place of each row's words among the distinct words, edges of rows, counts, vectors (few places: nearer to none)."""
    hashes = [np.frombuffer(a, np.uint64) for a in pdf["a"]]
    every, place = np.unique(np.concatenate(hashes), return_inverse=True)
    weight = np.concatenate([unpack_varints(b) for b in pdf["b"]]).astype(np.float64)
    means = np.concatenate([_unpack(c, np.int8).reshape(-1, 2 * SIDE) for c in pdf["c"]]).astype(np.float32) / 127
    n = np.bincount(place, weights=weight, minlength=len(every))
    vectors = np.column_stack([np.bincount(place, weights=weight * m, minlength=len(every)) for m in means.T]) / (n + 2)[:, None]
    return place, np.cumsum([0] + [len(h) for h in hashes]), n, vectors


def nearest_centre(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = [((centres**2).sum(axis=1) - 2 * vectors[at : at + 65536] @ centres.T).argmin(axis=1) for at in range(0, len(vectors), 65536)]
    return np.concatenate(out)


_SUMS = pa.schema([("range", pa.int32()), ("sums", pa.binary())])


def _centres(sketches: DataFrame, rounds: int = 15, seed: int = 5) -> np.ndarray | None:
    """GROUPS centres of like vectors, or fewer, of all words by their places in training text; deterministic.

    The rounds begin with words from the most frequent ones of each range. In each, every word counts for the centre nearest to it.
    """

    def gather(pdf):
        import pandas as pd

        _, _, n, vectors = _vectors(pdf.sort_values("block"))
        best = np.argsort(-n, kind="stable")[:GROUPS]
        return pd.DataFrame({"range": [int(pdf["range"].iloc[0])], "v": [vectors.astype("<f4").tobytes()], "n": [n.astype("<i8").tobytes()], "first": [vectors[best].astype("<f4").tobytes()]})

    words = materialize(sketches.groupBy("range").applyInPandas(grouped(gather), "range int, v binary, n binary, first binary"), "lm-means")
    first = [np.frombuffer(r["first"], "<f4").reshape(-1, 2 * SIDE) for r in words.select("range", "first").orderBy("range").collect()]
    if not first:
        return None
    first = np.concatenate(first).astype(np.float64)
    centres = np.unique(first[np.random.default_rng(seed).permutation(len(first))[:GROUPS]], axis=0)
    for _ in range(rounds):
        shared = centres

        def add(batches, shared=shared):
            for batch in batches:
                for r, v, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    vectors, times = np.frombuffer(v, "<f4").reshape(-1, 2 * SIDE).astype(np.float64), np.frombuffer(n, "<i8").astype(np.float64)
                    near = nearest_centre(vectors, shared)
                    sums = np.column_stack([np.bincount(near, weights=times * x, minlength=len(shared)) for x in [*vectors.T, 1.0]])
                    yield record(_SUMS, [[r], [sums.tobytes()]])

        found = sorted((r["range"], bytes(r["sums"])) for r in words.select("range", "v", "n").mapInArrow(tidy(add), "range int, sums binary").collect())
        sums = sum(np.frombuffer(s, np.float64).reshape(len(centres), -1) for _, s in found)
        centres = np.where(sums[:, -1:] > 0, sums[:, :-1] / np.maximum(sums[:, -1:], 1), centres)
    discard(words)
    return centres


def _groups(sketches: DataFrame) -> DataFrame:
    """Per block and range the groups of its words; per range (block -1) the smoothed counts of each group."""
    shared = sketches.sparkSession.sparkContext.broadcast(_centres(sketches))

    def assign(pdf):
        import pandas as pd

        place, edges, n, vectors = _vectors(pdf)
        group = nearest_centre(vectors, shared.value).astype(np.uint8)
        mass = np.bincount(group, weights=n + 1, minlength=GROUPS).astype("<i8")
        back = [_pack(group[place[i:j]]) for i, j in zip(edges[:-1], edges[1:], strict=True)]
        return pd.DataFrame({"block": [*pdf["block"], -1], "range": [int(pdf["range"].iloc[0])] * (len(back) + 1), "a": [*back, mass.tobytes()]})

    return sketches.groupBy("range").applyInPandas(grouped(assign), "block long, range int, a binary")


_CLASSED = "kind int, block long, range int, a binary, b binary, c binary, d binary"


def _classed(parts: DataFrame, groups: DataFrame, words: int) -> DataFrame:
    """kind 0: a block's documents with their sums, and the classes of its words. kind 1: one range of its training
    trigram counts. kind 2: one range of its grouped words, with the classes before them in training text."""
    known = groups.where("block >= 0").select(F.lit(3).alias("kind"), "block", "range", "a", F.lit(b"").alias("b"), F.lit(b"").alias("c"))

    def join(pdf):
        import pandas as pd

        b, block = _Block(pdf, words), int(pdf["block"].iloc[0])
        mine = np.log10(b.total + 1.0)[b.place]
        shared = (b.classes == OTHER) | (b.classes >= FIRST_GROUP)
        sums = np.column_stack([np.add.reduceat(mine, b.starts), np.add.reduceat(np.where(shared, mine, 0.0), b.starts)])
        seen = (b.total > 0).astype(np.int64)[b.place]
        whole = np.column_stack([b.lengths, np.add.reduceat(seen, b.starts)])
        rows = [(0, block, -1, whole.astype("<i8").tobytes(), sums.astype("<f8").tobytes(), _pack(b.class_of), b"")]
        code, times = np.unique(trigrams(b.classes, b.lengths)[b.train], return_counts=True)
        edges = np.searchsorted(code >> 18, np.arange((CLASSES**3 >> 18) + 2))
        for r in np.flatnonzero(np.diff(edges)):
            part = slice(edges[r], edges[r + 1])
            rows.append((1, block, int(r), pack_deltas(code[part]), pack_varints(times[part]), b"", b""))
        own = np.flatnonzero(b.grouped[b.place] & b.train)
        number = np.cumsum(b.grouped) - 1
        code, times = np.unique(number[b.place[own]] * CLASSES + b.before()[own], return_counts=True)
        for r, i, j in zip(b.ranges, b.edges[:-1], b.edges[1:], strict=True):
            at = np.flatnonzero(b.grouped[i:j]) + i
            if len(at):
                low = int(number[at[0]]) * CLASSES
                part = slice(*np.searchsorted(code, [low, low + len(at) * CLASSES]))
                numbers = pack_varints(b.total[at]), (b.class_of[at] - FIRST_GROUP).astype(np.uint8).tobytes()
                rows.append((2, block, int(r), pack_deltas(code[part] - low), pack_varints(times[part]), *numbers))
        return pd.DataFrame(rows, columns=["kind", "block", "range", "a", "b", "c", "d"])

    return parts.unionByName(known).groupBy("block").applyInPandas(grouped(join), _CLASSED)


def _class_numbers(marked: np.ndarray, words: int) -> np.ndarray:
    """Places in the list of marked words as classes: the last one is the end."""
    return np.where(marked == words, END_CLASS, marked).astype(np.uint16)


def _trigram_counts(classed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """All training trigrams of classes and their counts: at most CLASSES ** 3, whatever the corpus."""

    def add(pdf):
        import pandas as pd

        codes = np.concatenate([unpack_deltas(a) for a in pdf["a"]])
        code, place = np.unique(codes, return_inverse=True)
        times = np.bincount(place, weights=np.concatenate([unpack_varints(b) for b in pdf["b"]]).astype(np.float64))
        return pd.DataFrame({"range": [int(pdf["range"].iloc[0])], "a": [pack_deltas(code)], "b": [pack_varints(times.astype(np.uint64))]})

    got = sorted(classed.where("kind = 1").select("range", "a", "b").groupBy("range").applyInPandas(grouped(add), "range int, a binary, b binary").collect())
    if not got:
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    return np.concatenate([unpack_deltas(bytes(r["a"])) for r in got]).astype(np.int64), np.concatenate([unpack_varints(bytes(r["b"])) for r in got]).astype(np.float64)


@dataclass(frozen=True)
class LogBilinear:
    """Vectors of the second and the first word before, of the predicted class, and biases."""

    two: np.ndarray
    one: np.ndarray
    word: np.ndarray
    bias: np.ndarray

    def normalisers(self, block: int = 4096) -> np.ndarray:
        """Logarithm of the sum over all classes after every context, by batched matrix products."""
        out = np.empty(CLASSES * CLASSES, dtype=np.float32)
        for at in range(0, len(out), block):
            context = np.arange(at, min(at + block, len(out)))
            score = (self.two[context // CLASSES] + self.one[context % CLASSES]) @ self.word.T + self.bias
            top = score.max(axis=1)
            out[at : at + block] = top + np.log(np.exp(score - top[:, None]).sum(axis=1))
        return out

    def table(self, block: int = 4096) -> np.ndarray:
        """log10 probability of every class after every context, flat by trigram code: 96 MB."""
        out, normalisers = np.empty((CLASSES * CLASSES, CLASSES), dtype=np.float32), self.normalisers()
        for at in range(0, len(out), block):
            context = np.arange(at, min(at + block, len(out)))
            score = (self.two[context // CLASSES] + self.one[context % CLASSES]) @ self.word.T + self.bias
            out[at : at + block] = (score - normalisers[context, None]) / math.log(10)
        return out.ravel()

    def log10(self, code: np.ndarray, normalisers: np.ndarray, block: int = 1 << 16) -> np.ndarray:
        """log10 probability of the classes of trigram codes; equal codes are computed once."""
        some, place = np.unique(code, return_inverse=True)
        out = np.empty(len(some))
        for at in range(0, len(some), block):
            context, word = some[at : at + block] // CLASSES, some[at : at + block] % CLASSES
            hidden = self.two[context // CLASSES] + self.one[context % CLASSES]
            out[at : at + block] = np.einsum("ij,ij->i", hidden, self.word[word]) + self.bias[word] - normalisers[context]
        return out[place] / math.log(10)

    def contexts(self, times: np.ndarray) -> np.ndarray:
        """Each class, seen `times`, as the one before a grouped word: its main directions and a one."""
        weight = np.sqrt(times / max(1.0, times.sum()))
        centred = self.one - (weight**2) @ self.one
        _, spread, directions = np.linalg.svd(weight[:, None] * centred, full_matrices=False)
        return np.column_stack([centred @ directions[:SIZE].T / max(float(spread[0]), 1e-6), np.ones(CLASSES)]).astype(np.float32)


def train_nce(code: np.ndarray, times: np.ndarray, size: int = 32, noise: float = 10.0, draws: int = 96, epochs: int = 12, rate: float = 0.03, batch: int = 1024, seed: int = 11) -> LogBilinear:
    """Noise-contrastive estimation on trigram counts; noise is drawn from the smoothed class distribution.

    For a context seen n times with counts c(w), the objective is
        sum c(w) log s(f(w) - log k q(w)) + sum over noise words v of log(1 - s(f(v) - log k q(v)))
    with s the logistic function, q the noise distribution and k = `noise`. Each step draws `draws` noise
    words for each of its contexts, which stand for k n. Deterministic.
    """
    rng = np.random.default_rng(seed)
    share = np.bincount(code % CLASSES, weights=times, minlength=CLASSES) + 0.5
    share[START] = 1e-6
    share /= share.sum()
    params = [rng.normal(0, 0.1, (CLASSES, size)).astype(np.float32) for _ in range(3)] + [np.log(share).astype(np.float32)]
    if not len(code):
        return LogBilinear(*params)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    context, first = np.unique(code // CLASSES, return_index=True)
    edges = np.append(first, len(code))
    totals = np.add.reduceat(times, first)
    logs, step = np.log(noise * share).astype(np.float32), 0
    steps = epochs * -(-len(context) // batch)
    cumulative = np.cumsum(share)
    for _ in range(epochs):
        order = rng.permutation(len(context))
        for at in range(0, len(order), batch):
            rows, step = order[at : at + batch], step + 1
            counts = np.zeros((len(rows), CLASSES), dtype=np.float32)
            for i, r in enumerate(rows):
                span = slice(edges[r], edges[r + 1])
                counts[i, code[span] % CLASSES] = times[span]
            drawn = np.minimum(np.searchsorted(cumulative, rng.random((len(rows), draws)) * cumulative[-1]), CLASSES - 1)
            drawn = np.bincount((np.arange(len(rows))[:, None] * CLASSES + drawn).ravel(), minlength=counts.size).reshape(counts.shape)
            false = (drawn * (noise / draws * totals[rows])[:, None]).astype(np.float32)
            two, one, word, bias = params
            a, b = context[rows] // CLASSES, context[rows] % CLASSES
            hidden = two[a] + one[b]
            chance = 1 / (1 + np.exp(-np.clip(hidden @ word.T + bias - logs, -30, 30)))
            grad = chance * (counts + false) - counts
            grad /= totals[rows].sum()
            back = grad @ word
            grads = [np.zeros_like(two), np.zeros_like(one), grad.T @ hidden, grad.sum(axis=0)]
            np.add.at(grads[0], a, back)
            np.add.at(grads[1], b, back)
            pace = rate * (1 - 0.9 * step / steps)
            for p, g, (m, v) in zip(params, grads, state, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return LogBilinear(*params)


@dataclass(frozen=True)
class WordContexts:
    """What level two is trained with: vectors of the class before, how often it stands before each group, words' mass by group."""

    vectors: np.ndarray
    before: np.ndarray
    mass: np.ndarray


def train_words(code: np.ndarray, times: np.ndarray, total: np.ndarray, group: np.ndarray, known: WordContexts, noise: float = 8.0, steps: int = 10, decay: float = 2.0, batch: int = 2048, seed: int = 13) -> np.ndarray:
    """Vectors and biases of words in steps of 1 / STEPS_OF_ONE, from sorted codes word * CLASSES + class before.

    Noise-contrastive: a word's places stand against noise places, drawn for it from those of its group
    by its share of the group; `decay` pulls vectors with few places to zero. Deterministic.
    """
    rng, out = np.random.default_rng(seed), np.zeros((len(total), SIZE + 1), dtype=np.int8)
    x, shift = known.vectors, np.float32(math.log(noise))
    square = (x**2).sum(axis=1)
    for at in range(0, len(total), batch):
        n = min(batch, len(total) - at)
        span = slice(*np.searchsorted(code, [at * CLASSES, (at + n) * CLASSES]))
        true = np.bincount(code[span] - at * CLASSES, weights=times[span], minlength=n * CLASSES).reshape(n, CLASSES).astype(np.float32)
        own = group[at : at + n]
        mean = known.before[own] * ((total[at : at + n] + 1) / np.maximum(known.mass[own], 1) * noise)[:, None]
        both = true + rng.poisson(mean).astype(np.float32)
        pace = (1 / (0.25 * both @ square + decay))[:, None]
        last = ahead = np.zeros((n, SIZE + 1), dtype=np.float32)
        for step in range(steps):
            chance = 1 / (1 + np.exp(np.clip(shift - ahead @ x.T, -30, 30)))
            new = ahead - pace * ((chance * both - true) @ x + decay * ahead)
            ahead, last = new + step / (step + 3) * (new - last), new
        out[at : at + n] = np.clip(np.rint(last * STEPS_OF_ONE), -127, 127)
    return out


def vector_scores(stored: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """Row by row X_b . q_w + bias_w."""
    return np.einsum("ij,ij->i", stored.astype(np.float32) / np.float32(STEPS_OF_ONE), contexts)


def _word_vectors(classed: DataFrame, sketches: DataFrame, known: WordContexts) -> DataFrame:
    """Per block and range the vectors of its grouped words; per range (block -1) its words: hashes, counts, groups and
    vectors, and by group and class before the sums of exp(score) over them."""
    hashes = sketches.select(F.lit(4).alias("kind"), "block", "range", "a", *(F.lit(b"").alias(c) for c in "bcd"))
    rows = classed.where("kind = 2").unionByName(hashes)
    shared = classed.sparkSession.sparkContext.broadcast(known)

    def learn(pdf):
        import pandas as pd

        word = dict(pdf.loc[pdf["kind"] == 4, ["block", "a"]].itertuples(index=False))
        own = pdf[pdf["kind"] == 2].sort_values("block")
        parts = [np.frombuffer(word[b], np.uint64) for b in own["block"]]
        every, place = np.unique(np.concatenate(parts), return_inverse=True)
        edges = np.cumsum([0] + [len(p) for p in parts])
        total, group = np.zeros(len(every), dtype=np.int64), np.zeros(len(every), dtype=np.uint8)
        total[place] = np.concatenate([unpack_varints(c) for c in own["c"]]).astype(np.int64)
        group[place] = np.concatenate([np.frombuffer(d, np.uint8) for d in own["d"]])
        codes, times = [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
        for a, b, i, j in zip(own["a"], own["b"], edges[:-1], edges[1:], strict=True):
            code = unpack_deltas(a).astype(np.int64)
            codes.append(place[i:j][code // CLASSES] * CLASSES + code % CLASSES), times.append(unpack_varints(b).astype(np.float64))
        code, at = np.unique(np.concatenate(codes), return_inverse=True)
        known, r = shared.value, int(pdf["range"].iloc[0])
        vectors = train_words(code, np.bincount(at, weights=np.concatenate(times), minlength=len(code)), total, group, known, seed=13 + r)
        sums = np.zeros((GROUPS, CLASSES))
        for at in range(0, len(every), 4096):
            part = slice(at, at + 4096)
            value = np.exp(vectors[part].astype(np.float32) / STEPS_OF_ONE @ known.vectors.T).astype(np.float64) * (total[part, None] + 1)
            np.add.at(sums, group[part], value)
        back = [vectors[place[i:j]].tobytes() for i, j in zip(edges[:-1], edges[1:], strict=True)]
        none = [b""] * len(back)
        last = every.tobytes(), pack_varints(total), group.tobytes(), vectors.tobytes(), sums.tobytes()
        return pd.DataFrame({"block": [*own["block"], -1], "range": [r] * (len(back) + 1)} | {c: [*(back if c == "d" else none), v] for c, v in zip("abcde", last, strict=True)})

    return rows.groupBy("range").applyInPandas(grouped(learn), "block long, range int, a binary, b binary, c binary, d binary, e binary")


@dataclass(frozen=True)
class Fitted:
    """A trained model and its training counts. words: vocabulary of level two, by range."""

    tokens: int
    distinct: int
    frequent: tuple[int, ...]
    classes: LogBilinear
    normalisers: np.ndarray
    contexts: WordContexts
    sums: np.ndarray
    rare_mass: int
    words: DataFrame
    tables: dict[str, DataFrame]

    def vocabulary(self) -> dict[int, tuple[int, int, np.ndarray]]:
        """Count, group, and vector with bias of each grouped word by its hash; for tests and small corpora."""
        out = {}
        for r in self.words.where("block = -1").collect():
            vectors = np.frombuffer(bytes(r["d"]), np.int8).reshape(-1, SIZE + 1) / STEPS_OF_ONE
            for h, n, g, q in zip(np.frombuffer(bytes(r["a"]), np.uint64).tolist(), unpack_varints(bytes(r["b"])).tolist(), r["c"], vectors, strict=True):
                out[h] = n, g, q
        return out


def _added(batches):
    """One row for a task: the sum of its rows' arrays."""
    out = np.zeros(GROUPS * CLASSES)
    for batch in slices(batches, 64):
        for e in batch.column(0):
            out += np.frombuffer(e.as_buffer(), "<f8")
    yield record(pa.schema([("e", pa.binary())]), [[out.tobytes()]])


def fit_language_model(docs: DataFrame, modulus: int = 7, block_tokens: int = 1 << 21) -> Fitted:
    """Count and train on all documents that aren't held out; blocks of all documents stay for scoring them."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), modulus).alias("flag"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(6, math.ceil(math.log2(max(1, size / (128 << 20)))))
    blocks = materialize(_blocks(rows, bits, block_tokens), "lm-blocks", ("kind",))
    totals = materialize(_totals(blocks.where("kind = 1").select("block", "range", "a", "b"), WORDS + 1), "lm-totals")
    sums = totals.where("block = -1").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    tokens, distinct = int(sums["n"] or 0), int(sums["v"] or 0)
    frequent = [(w, n) for w, n in _most_frequent(totals, WORDS + 1) if w != END][:WORDS]
    words, vocabulary = len(frequent), blocks.where("kind = 1")
    marks = materialize(_marks(vocabulary, [w for w, _ in frequent]), "lm-marks")
    parts = _parts(blocks, totals, marks)
    sketches = materialize(_sketches(parts, vocabulary, words, side_vectors(_pairs(parts, words))), "lm-sketches")
    groups = materialize(_groups(sketches), "lm-groups")
    classed = materialize(_classed(parts, groups, words), "lm-classed", ("kind",))
    mass = np.zeros(GROUPS, dtype=np.int64)
    for r in groups.where("block = -1").select("a").collect():
        mass += np.frombuffer(r["a"], "<i8")
    discard(totals, marks, groups)
    code, times = _trigram_counts(classed)
    ends = int(times[code % CLASSES == END_CLASS].sum())
    rare = tokens - sum(n for _, n in frequent) - ends + distinct - words - (ends > 0) + 1 - int(mass.sum())
    model = train_nce(code, times)
    before = np.bincount(code // CLASSES % CLASSES * CLASSES + code % CLASSES, weights=times, minlength=CLASSES**2).reshape(CLASSES, CLASSES)
    contexts = WordContexts(model.contexts(before.sum(axis=1)), np.ascontiguousarray(before[:, FIRST_GROUP:].T), mass)
    vectors = materialize(_word_vectors(classed, sketches, contexts), "lm-vectors")
    discard(sketches)
    sums = np.zeros((GROUPS, CLASSES))
    for r in vectors.where("block = -1").select("e").mapInArrow(tidy(_added), "e binary").collect():
        sums += np.frombuffer(bytes(r["e"]), "<f8").reshape(GROUPS, CLASSES)
    return Fitted(tokens, distinct, tuple(w for w, _ in frequent), model, model.normalisers(), contexts, sums, rare, vectors, {"blocks": blocks, "classed": classed})


def score_texts(docs: DataFrame, modulus: int = 7, block_tokens: int = 1 << 21) -> DataFrame:
    """Per document doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Tokens are words between ASCII white space, lower-cased A to Z, and then one end. Counts
    come from all documents that aren't held out. base_score smooths them by one; score is the
    neural model's. Null or empty text: the end alone. A null id is never held out; repeated
    rows are counted and scored each; without training text all counts are zero; an empty
    table gives no rows. Only doc_id and text are read.
    """
    fitted = fit_language_model(docs, modulus, block_tokens)
    tokens, unit = fitted.tokens, math.log10(fitted.tokens + fitted.distinct + 1)
    with np.errstate(divide="ignore"):
        group_sums = np.log10(np.maximum(fitted.sums, 1e-300))
    shared = docs.sparkSession.sparkContext.broadcast((fitted.classes, fitted.normalisers, fitted.contexts.vectors, group_sums, math.log10(max(1, fitted.rare_mass))))
    none = [F.lit(b"").alias(c) for c in "bcd"]
    texts = fitted.tables["blocks"].where("kind = 0").select("kind", "block", "range", "a", "b", "c", none[2])
    classes = fitted.tables["classed"].where("kind = 0").withColumn("kind", F.lit(1))
    vectors = fitted.words.where("block >= 0").select(F.lit(2).alias("kind"), "block", "range", F.col("d").alias("a"), *none)

    def score(pdf):
        import pandas as pd

        model, normalisers, contexts, group_sums, rare = shared.value
        head, whole = pdf[pdf["kind"] == 0].iloc[0], pdf[pdf["kind"] == 1].iloc[0]
        n = len(head["a"]) // 8
        null, flags = np.frombuffer(head["b"], np.uint8, n).astype(bool), np.frombuffer(head["b"], np.uint8, n, n).astype(bool)
        counts, sums = np.frombuffer(whole["a"], "<i8").reshape(n, 2), np.frombuffer(whole["b"], "<f8").reshape(n, 2)
        class_of, place, lengths = _unpack(whole["c"], np.uint16), _unpack(head["c"], "<u4"), counts[:, 0]
        classes, starts = class_of[place], np.cumsum(lengths) - lengths
        logs = model.log10(trigrams(classes, lengths), normalisers)
        logs[classes == OTHER] -= rare
        stored = b"".join(pdf[pdf["kind"] == 2].sort_values("range")["a"])
        stored, number = np.frombuffer(stored, np.int8).reshape(-1, SIZE + 1), np.cumsum(class_of >= FIRST_GROUP) - 1
        before = np.concatenate([[START], classes[:-1]]).astype(np.int64)
        before[starts] = START
        at = np.flatnonzero(classes >= FIRST_GROUP)
        for i in range(0, len(at), 1 << 16):
            some = at[i : i + (1 << 16)]
            inner = vector_scores(stored[number[place[some]]], contexts[before[some]]) / math.log(10)
            logs[some] += inner - group_sums[classes[some] - FIRST_GROUP, before[some]]
        total = np.add.reduceat(logs, starts) + sums[:, 1]
        ids = pd.array(np.frombuffer(head["a"], "<i8"), dtype="Int64")
        ids[null] = pd.NA
        columns = {"n_tokens": lengths, "n_known": counts[:, 1], "train_tokens": np.full(n, tokens), "base_score": sums[:, 0] - lengths * unit, "score": total}
        return pd.DataFrame({"doc_id": ids, "held_out": flags} | columns)

    rows = texts.unionByName(classes).unionByName(vectors)
    return rows.groupBy("block").applyInPandas(grouped(score), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
