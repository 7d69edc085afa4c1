"""Corpus operators against brute force, and on the troubles that tables have."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.llm import language_model, packing, pieces, pii, segment_search, token_files, vector_blocks
from panelweave.llm.common import pack_deltas, pack_varints, unpack_deltas, unpack_varints
from panelweave.llm.components import connected_components
from panelweave.llm.encoding import Encoder
from panelweave.llm.jaccard import JaccardJoin, jaccard_components, join_region, thin_cells
from panelweave.llm.language import identify_language
from panelweave.llm.nearest import nearest_neighbours, quantize
from panelweave.llm.segment_search import top_products
from panelweave.llm.toxicity import fit_nnpu, score_toxicity

public = pytest.importorskip("public_tokenizers")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
WORDS = "the quick brown fox jumps over a lazy dog while seven wizards brew potions near dark water every night".split()


def text(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) + rnd.choice(["", "", "", ",", "."]) for _ in range(n))


ODD = [None, "", " ", "\n\t ", "a", "Ab aB", "É ß 日本語 😀", "x" * 5000, "<|endoftext|> 's", "\x00\x1c y z"]


@pytest.fixture(scope="module")
def docs(spark):
    """Odd texts, near and exact copies, repeated rows, null ids, a long text, clashing columns."""
    base = [text(i, 60) for i in range(30)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(8):  # near copies
        words = base[i].split()
        words[3 * i % 50] = f"changed{i}"
        rows.append((100 + i, " ".join(words)))
    rows += [(200 + i, base[5].upper()) for i in range(6)]
    rows += [(300 + i, t) for i, t in enumerate(ODD)]
    rows += [(7, base[7]), (7, "another text with this id"), (None, base[9]), (None, None), (400, text(99, 9000))]
    made = [(d, t, "en" if d is None or d % 2 else "xx", f"s{(d or 0) % 3}", 0 if t is None else len(t), 1.5, 2, "q") for d, t in rows]
    return spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, set_key string").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def listed(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def bag(rows):
    return collections.Counter(rows)


# --- encoders --------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_library(name):
    tool = Encoder(public.path(name), limit=50)
    rnd = random.Random(4)
    parts = [" ", "  ", "\n", "\t", "a", "word", "Word's", "é", "É", "日", "1", "12", "...", "<|endoftext|>", " ", "ß", "I'll", "́", "ª", "İ", "ж"]
    texts = [t or "" for t in ODD] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(1500)]
    for at in range(0, len(texts), 100):
        assert tool.encode(texts[at : at + 100]) == tool._library(texts[at : at + 100])


def test_packing_places_every_piece_once(docs):
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    got = packing.pack_documents(docs, path, 1, packing.Capacity(tokens=512)).collect()
    want = []
    for d, t in listed(docs):
        ids = lib.encode(t, add_special_tokens=False).ids + [1]
        for n, at in enumerate(range(0, len(ids), 512)):
            part = ids[at : at + 512]
            want.append((d, n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert bag(want) == bag(tuple(r)[:5] for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 512
    assert len(by) <= -(-sum(r["length"] for r in got) // 512) + 1


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("limits", [{}, {"documents": 3}, {"attention": 5000}, {"documents": 4, "attention": 7000}])
def test_bins_respect_every_capacity(rule, limits):
    rng = np.random.default_rng(2)
    capacity = packing.Capacity(tokens=100, rule=rule, **limits)
    lengths = rng.integers(1, 70, 3000)
    counts = dict(zip(*map(list, np.unique(lengths, return_counts=True)), strict=True))
    plan = packing.plan_bins({int(k): int(v) for k, v in counts.items()}, capacity)
    seen, bins = collections.Counter(), collections.defaultdict(list)
    for length in lengths.tolist():
        b, o = packing.place(plan, np.array([length]), np.array([seen[length]]))
        bins[int(b[0])].append((int(o[0]), length))
        seen[length] += 1
    most = capacity.limits()
    for places in bins.values():
        sizes = np.array([x for _, x in places])
        assert sizes.sum() <= most[0] and len(sizes) <= most[1] and (sizes**2).sum() <= most[2]
        assert [o for o, _ in sorted(places)] == [0, *np.cumsum([x for _, x in sorted(places)])[:-1].tolist()]
    assert len(bins) == plan["bins"]
    with pytest.raises(ValueError):
        packing.plan_bins({101: 1}, capacity)


def test_token_files_round_trip(docs):
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    files = token_files.write_token_files(docs, path, 0, image_tokens=700)
    got = sorted(token_files.read_token_files(files).collect(), key=lambda r: r["start"])
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in got]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    want = bag((d, np.array(lib.encode(t, add_special_tokens=False).ids + [0], "<u4").tobytes()) for d, t in listed(docs))
    assert want == bag((r["doc_id"], bytes(r["ids"])) for r in got)
    digest = token_files.token_file_digest(docs, path).collect()
    assert bag((r["doc_id"], zlib.crc32(bytes(r["ids"]))) for r in got) == bag((r["doc_id"], r["ids_crc32"]) for r in digest)


def test_rank_coding_round_trips():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = (2 ** rng.uniform(0, 32, n)).astype("<u4")
        control, data = token_files.encode_ranks(ranks)
        assert (token_files.decode_ranks(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n) == ranks).all()
    values = np.sort(rng.integers(0, 2**63, 1000).astype(np.uint64))
    assert (unpack_deltas(pack_deltas(values)) == values).all() and (unpack_varints(pack_varints(values)) == values).all()


def brute_path(codec, segment):
    """Best total score over all segmentations of a short text."""
    scores = {p: s for p, s, k in codec.model.pieces if k == 1}
    best = [0.0] + [-math.inf] * len(segment)
    for e in range(1, len(segment) + 1):
        for s in range(max(0, e - 16), e):
            if segment[s:e] in scores:
                best[e] = max(best[e], best[s] + scores[segment[s:e]])
        if segment[e - 1] not in scores:
            best[e] = max(best[e], best[e - 1] + codec.penalty)
    return best[-1]


def test_piece_codec_finds_the_best_path():
    codec = pieces.PieceCodec(pieces.PieceModel.load(public.path("piece_bpe_32k.model")), limit=20)
    rnd = random.Random(6)
    parts = ["a", "the", " ", "  ", "\n", "é", "日", "😀", "er", "ing", "\t", "7", "▁"]
    for t in ["", *[x for x in ODD if x], *("".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(800))]:
        raw, score = codec.encode(t)
        ids = memoryview(raw).cast("I").tolist()
        assert codec.decode(ids) == t.replace("▁", " ")
        if len(t) < 200:
            assert score == brute_path(codec, codec.prepare(t).replace(" ", "▁"))


def test_pieces_over_a_table(docs, none):
    path = public.path("piece_bpe_32k.model")
    got = pieces.encode_pieces(docs, path)
    rows = got.collect()
    assert len(rows) == docs.count() and all(r["round_trip"] for r in rows)
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["n_pieces"] for r in rows)
    back = pieces.decode_pieces(got, path)
    assert bag((r["doc_id"], r["text"]) for r in back.collect()) == bag(listed(docs))
    assert pieces.encode_pieces(none, path).count() == 0


# --- vectors ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 12)).astype(np.float32)
    x[50:90] = x[10]  # one very common vector
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(500, None, 0), (None, x[0].tolist(), 0), (600, [0.0] * 12, 0), (700, [float("nan")] * 12, 0), (800, [1.0] * 5, 0), (900, [], 0), (1000, [2.0] * 5, 0)]
    rows += [(100, x[100].tolist(), 0), (100, x[3].tolist(), 0), (1100, [None] + [1.0] * 11, 0), (1200, [1e30] * 12, 0), (1300, [float("inf")] * 12, 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, query_id int").repartition(5)


def usable(vectors, zero_ok):
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    ok = lambda v: v is not None and None not in v and all(map(math.isfinite, v)) and (zero_ok or any(v))
    return [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and ok(v)]


@pytest.mark.parametrize("block", [8192, 2])
def test_nearest_equals_brute_force(vectors, block, monkeypatch):
    monkeypatch.setattr(vector_blocks, "QUERY_BLOCK", block)
    got = bag(tuple(r) for r in nearest_neighbours(vectors, every=50, k=6).collect())
    rows, want = usable(vectors, False), collections.Counter()
    for a, (q, x) in enumerate(rows):
        if q % 50 == 0:
            near = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for b, (i, y) in enumerate(rows) if b != a and len(x) == len(y))
            want.update((q, n + 1, i, d) for n, (d, i) in enumerate(near[:6]))
    round_ = lambda c: bag((q, n, i, float(f"{d:.12g}")) for (q, n, i, d), k in c.items() for _ in range(k))
    assert round_(got) == round_(want)


def test_top_products_equal_brute_force(vectors):
    got = bag(tuple(r) for r in top_products(vectors, every=50, k=5).collect())
    rows, want = usable(vectors, True), collections.Counter()
    for a, (q, x) in enumerate(rows):
        if q % 50 == 0:
            dot = lambda y: sum(int(math.floor(256 * u)) * int(math.floor(256 * v)) for u, v in zip(x.tolist(), y.tolist(), strict=True))  # noqa: E731, B023
            cut = lambda s: max(-(2**63 - 1), min(2**63 - 1, s))
            best = sorted((-cut(dot(y)), i) for b, (i, y) in enumerate(rows) if b != a and len(x) == len(y))
            want.update((q, n + 1, i, -s) for n, (s, i) in enumerate(best[:5]))
    assert got == want


def test_bounds_hold():
    rng = np.random.default_rng(8)
    q, x = rng.normal(size=(20, 32)), rng.normal(size=(50, 32))
    (qc, qs, qr, qh, _), (xc, xs, xr, _, x2) = quantize(q), quantize(x)
    gap = np.abs(q @ x.T - (qc.astype(float) @ xc.T.astype(float)) * qs[:, None] * xs)
    assert (gap <= qr[:, None] * np.sqrt(x2) + qh[:, None] * xr + 1e-12).all()
    last = None
    for n in segment_search.LEVELS:
        bound = segment_search.statistics(q, n) @ segment_search.statistics(x, n).T
        assert (bound >= q @ x.T - 1e-9).all()
        assert last is None or bound.sum() <= last
        last = bound.sum()


def test_empty_vectors(spark, vectors):
    assert nearest_neighbours(vectors.limit(0)).count() == 0 and top_products(vectors.limit(0)).count() == 0


# --- near copies -----------------------------------------------------------------------------


def shingles(t, k):
    w = t.encode().translate(LOWER).split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(sets, percent):
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("words, percent, region", [(4, 85, 256), (5, 80, 256), (2, 30, 2), (1, 50, 3)])
def test_jaccard_components_equal_brute_force(docs, words, percent, region):
    got = jaccard_components(docs, JaccardJoin(words, percent), region_sets=region).collect()
    rows = listed(docs)
    sets = [shingles(t, words) for _, t in rows]
    roots, least = brute_components(sets, percent), {}
    for (d, _), r in zip(rows, roots, strict=True):
        least[r] = min(least.get(r, math.inf), math.inf if d is None else d)
    known = lambda d: None if d == math.inf else d
    want = bag((d, len(s), known(least[r])) for (d, _), s, r in zip(rows, sets, roots, strict=True))
    assert want == bag((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got)
    heads = [r for r in got if r["set_key"] is not None and r["set_key"] == r["head_key"]]
    assert {r["component_id"] for r in got if r["set_key"] is not None} == {r["component_id"] for r in heads}


def test_one_region_with_many_near_copies():
    rng, join = np.random.default_rng(5), JaccardJoin(4, 85)
    sets, base = [], rng.choice(10**6, 300, replace=False).astype(np.uint64)
    for _ in range(150):
        s = base.copy()
        n = int(rng.integers(1, 45))
        s[rng.choice(300, n, replace=False)] = rng.integers(10**6, 10**9, n)
        sets.append(np.unique(s))
        if rng.random() < 0.05:
            base = s
    got, want = join_region(sets, join), brute_components([frozenset(s.tolist()) for s in sets], 85)
    pair = lambda roots: {(i, j) for i in range(150) for j in range(i) if roots[i] == roots[j]}
    assert pair(got) == pair(want)


def test_thinned_cells_keep_their_connections():
    """Chains by size window over all sets connect what they connect over the kept ones and the links."""
    rng = np.random.default_rng(12)
    for percent in (50, 85):
        join = JaccardJoin(4, percent)
        size = np.exp(rng.uniform(0, 7, 400)).astype(np.int64) + 1
        s, key = rng.integers(0, 6, 400).astype(np.uint64), np.arange(400)
        tasks = rng.integers(0, 5, 400)
        parts = [thin_cells(s[m], key[m], 2 * size[m] + 1, join) for m in (tasks == t for t in range(5))]
        kept_s, kept_key, kept_n = (np.concatenate([p[i] for p in parts]) for i in range(3))

        def chains(s, key, size, links, percent=percent):
            parent = list(range(400))

            def find(x):
                while parent[x] != x:
                    x = parent[x]
                return x

            for a, b in links:
                parent[find(a)] = find(b)
            order = np.lexsort((size, s))
            for i, j in zip(order[:-1], order[1:], strict=True):
                if s[i] == s[j] and 100 * size[i] >= percent * size[j]:
                    parent[find(int(key[i]))] = find(int(key[j]))
            return [find(k) for k in range(400)]

        links = [(int(a), int(b)) for p in parts for a, b in p[3]]
        want, got = chains(s, key, size, []), chains(kept_s, kept_key, kept_n >> 1, links)
        assert all((want[i] == want[j]) <= (got[i] == got[j]) for i in range(400) for j in range(i))
        assert len(kept_key) < 400


def test_prefixes_meet():
    for percent in (30, 80, 85, 100):
        join = JaccardJoin(4, percent)
        for n in range(1, 60):
            assert 1 <= join.index_prefix(n) <= join.probe_prefix(n) <= n


def test_components(spark):
    rnd = random.Random(2)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(60)] + [(rnd.randint(200, 400), rnd.randint(200, 400)) for _ in range(150)] + [(500, 500), (None, 3)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = {n: n for p in pairs if None not in p for n in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None:
            parent[find(a)] = find(b)
    assert set(got) == set(parent)
    groups = lambda root: {frozenset(n for n in parent if root(n) == r) for r in map(root, parent)}
    assert groups(got.get) == groups(find)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- personal data ---------------------------------------------------------------------------

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(t):
    out = {}
    for kind, rule in RULES.items():
        out[kind] = []
        for m in re.finditer(rule, t):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) * 2 - 9 * (int(c) > 4) if i % 2 else int(c) for i, c in enumerate(digits[::-1])) % 10 == 0
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(digits) <= 19 and luhn, "phone": 8 <= len(digits) <= 15}[kind]:
                out[kind].append(m.span())
    return out


def test_base_spans_equal_plain_rules():
    rnd = random.Random(9)
    parts = ["a", "1", "9", ".", "@", "-", "+", " ", "(", ")", "b.c", "@x.y", "4111111111111111", "1.2.3.4", "é", "_", "+1 (22) 333-4444"]
    for _ in range(8000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 22)))
        assert pii.base_spans(t) == plain_spans(t), t


def test_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"{text(i, 20)} mailto:user{i}@host{i}.example.com {text(i + 500, 20)}") for i in range(60)]
    rows += [(100, "write to mailto:root@localhost today"), (101, "the 12ab34 and the 77x"), (102, None), (None, "")]
    got = {r["doc_id"]: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100]["spans"] == "email:16:30" and got[100]["n_email"] == 0
    assert got[100]["base_sha256"] == hashlib.sha256(b"").hexdigest() == got[102]["base_sha256"]
    assert got[101]["spans"] == "" and got[3]["n_email"] == 1
    model = pii.ContextModel({"g:mailto:": "email"})
    assert pii.redact("write to mailto:root@localhost, a@b.co!", model) == "write to mailto:<email>, <email>!"


def test_contexts_of_small_sources_stay_beside_large_ones(spark):
    """Six seeds carry a pattern, however many other seeds the table has; also where the patterns take several passes."""
    rows = [(i, " ".join(f"contact u{i}x{j}@h{i}.example.com" for j in range(100))) for i in range(1300)]
    rows += [(5000 + i, f"{text(i, 5)} mailbox v{i}@w{i}.example.org {text(i, 5)} <addr:k{i}@m{i}.example.net> {text(i, 5)}") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = {"w:contact": "email", "w:mailbox": "email", "g:<addr:": "email"}
    assert pii.learn_contexts(docs).kinds == want == pii.learn_contexts(docs, at_once=1).kinds
    assert pii.redact("mailbox root@localhost", pii.ContextModel(want)) == "mailbox <email>"


def test_pii_over_a_table(docs, none):
    got = bag((r["doc_id"], r["base_sha256"]) for r in pii.find_pii(docs).collect())
    digest = lambda t: hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, s in plain_spans(t).items() for a, b in s).encode()).hexdigest()
    assert got == bag((d, digest(t)) for d, t in listed(docs))
    assert pii.find_pii(none).count() == 0


# --- models ----------------------------------------------------------------------------------


def test_language_model_counts(docs, none):
    got = language_model.score_texts(docs, block_tokens=500).collect()
    rows = listed(docs)
    tokens = lambda t: [*t.encode().translate(LOWER).split(), None]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    counts = collections.Counter(w for d, t in rows if not held(d) for w in tokens(t))
    n, unit = sum(counts.values()), sum(counts.values()) + len(counts) + 1
    want = bag((d, held(d), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(math.log10((counts[w] + 1) / unit) for w in tokens(t)), 6)) for d, t in rows)
    assert want == bag((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got)
    assert all(r["score"] < 0 for r in got)
    total = lambda c: sum(r[c] for r in got) / sum(r["n_tokens"] for r in got)
    assert total("score") > total("base_score")
    assert language_model.score_texts(none).count() == 0


def test_language_model_learns_words_beyond_the_most_frequent(spark):
    """Two kinds of text whose 1,200 words each all are rare but for the few they stand between."""
    rnd = random.Random(8)
    rows = []
    for i in range(1200):
        k, out = i % 2, []
        for _ in range(30):
            out += [f"{'ab'[k]}{rnd.randrange(8)}", f"w{rnd.randrange(1200) * 2 + k}"]
            out += [f"w{rnd.randrange(1200) * 2 + k}"]
        rows.append((i, " ".join(out)))
    got = [r for r in language_model.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), block_tokens=20_000).collect() if r["held_out"]]
    words = [w for i, t in rows for w in t.split()]
    assert len(set(words)) > 2000 and len(got) > 100
    # Knowing the kind of each word's neighbours is worth a factor of two for each of 90 words.
    rare = collections.Counter(w for _, t in rows for w in t.split() if w[0] == "w")
    ideal = 30 * math.log10(1 / 8) + 60 * math.log10(1 / 1200)
    assert len(rare) == 2400 and sum(r["score"] for r in got) / len(got) > ideal - 16


def test_language_model_is_normalised():
    rng = np.random.default_rng(3)
    model = language_model.train_nce(np.sort(rng.choice(language_model.CLASSES**3, 500, replace=False)), np.ones(500), epochs=1)
    table = model.table().reshape(-1, language_model.CLASSES)
    assert np.allclose((10 ** table[:: 997].astype(float)).sum(axis=1), 1, atol=1e-4)


def test_language_identification(spark, none):
    one, two = "abba cad beda fagad", "zorx quvy wixz oyux"
    rnd = random.Random(1)
    words = {"aa": one.split(), "zz": two.split()}
    rows = [(i, " ".join(rnd.choices(words[lang], k=40)), lang) for i in range(300) for lang in [("aa", "zz")[i % 2]]]
    rows += [(900, None, "aa"), (901, "123 !", "zz"), (None, one * 30, "aa"), (902, two, None)]
    got = identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"), modulus=4).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and by[900]["lang_pred"] == by[901]["lang_pred"] == "und"
    assert all(0 <= r["score"] <= 1 for r in got)
    held = [(r, rows[r["doc_id"]][2]) for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 300]
    assert held and all(r["lang_pred"] == lang for r, lang in held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    assert identify_language(none).count() == 0


def test_rare_languages_are_learned(spark):
    """A language of one row in 1,500 is known; one without usable text is not."""
    words = {"aa": "abba cad beda fagad".split(), "zz": "zorx quvy wixz oyux".split(), "ru": "вода земля огонь небо".split()}
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choices(words[lang], k=20)), lang) for i in range(60_000) for lang in ["ru" if i % 1500 == 7 else ("aa", "zz")[i % 2]]]
    rows += [(100_000 + i, "", "none") for i in range(5)]
    got = identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4), modulus=4)
    held = {r["doc_id"]: r for r in got.where("doc_id % 1500 IN (7, 8) AND doc_id < 60000").collect()}
    assert all(r["lang_pred"] == ("ru" if d % 1500 == 7 else ("aa", "zz")[d % 2]) and r["score"] > 0.4 for d, r in held.items())
    assert got.where("lang_pred = 'none'").count() == 0


def test_toxicity(spark, docs, none):
    rnd = random.Random(1)
    rows = [(i, text(i, 30) + (" " + rnd.choice(["vile", "rotten"]) + "!" if i % 6 == 0 else "")) for i in range(900)]
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(0, 900)] + [(None, 1), (5000, None)], "doc_id long, toxic int")
    got = score_toxicity(spark.createDataFrame([*rows, (None, None), (901, "")], "doc_id long, text string"), labels).collect()
    held = [r for r in got if r["held_out"]]
    assert held and all(r["predicted"] == int(r["doc_id"] % 6 == 0) for r in held if r["doc_id"] < 900)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got) and len(got) == 902
    assert score_toxicity(none, labels).count() == 0
    assert all(r["predicted"] == 0 for r in score_toxicity(docs, labels.limit(0)).collect())
    assert fit_nnpu([], [], 0.1).weights == {}


# --- the pipeline ----------------------------------------------------------------------------


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline as p

    rnd = random.Random(7)
    clean = [(1000 + i, text(5000 + i, 40), "en") for i in range(240)]
    toxic = [(2000 + i, text(9000 + i, 30) + f" {rnd.choice(['vile', 'rotten'])} {rnd.choice(['vile', 'rotten'])}", "en") for i in range(60)]
    extra = spark.createDataFrame([(d, t, lang, "s", len(t), 0.0, 0, "k") for d, t, lang in clean + toxic], docs.schema)
    every = docs.unionByName(extra)
    every.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, 0, 0) for d, *_ in clean] + [(d, 0, 1) for d, *_ in toxic], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows, got = every, {}
    for name, stage in p.STAGES[:-1]:
        rows = stage(spark, rows, str(tmp_path)).cache()
        assert rows.schema == every.schema or rows.columns == every.columns
        got[name] = [(r["doc_id"], r["text"]) for r in rows.collect()]
    kept = {d for d, _ in got["toxicity"]}
    assert not kept & {d for d, *_ in toxic} and kept >= {d for d, *_ in clean}
    assert all(t and any(map(str.isalpha, t)) for _, t in got["language"])
    left = [shingles(t, 5) for _, t in got["near_copies"]]
    assert len(set(brute_components(left, 80))) == len(left)
    before = [(d, shingles(t, 5)) for d, t in got["language"]]
    roots, least = brute_components([s for _, s in before], 80), {}
    for (d, _), r in zip(before, roots, strict=True):
        least[r] = min(least.get(r, math.inf), math.inf if d is None else d)
    assert bag(math.inf if d is None else d for d, _ in got["near_copies"]) == bag(least.values())
    packed = p.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {d for d, _ in got["personal_data"]}


def test_registered_queries():
    import __spark_entry__ as e

    names = set(e.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    assert set(e.oracle_sql()) <= names


def test_skewed_groups_stay_whole(spark):
    """A third of all rows are one text, another third near copies of it."""
    base = text(1, 80).split()
    rows = [(i, " ".join(base)) for i in range(150)]
    for i in range(150):
        w = list(base)
        w[i % 80] = f"w{i}"
        rows.append((1000 + i, " ".join(w)))
    rows += [(5000 + i, text(7000 + i, 50)) for i in range(150)]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), JaccardJoin(4, 85), region_sets=16)
    assert got.where(F.col("component_id") == 0).count() == 300 and got.select("component_id").distinct().count() == 151


def test_later_steps_of_token_files_leave_the_encoder_and_pack_nothing_twice(spark):
    """Byte-packed images are written with a light codec, and a worker that encoded still knows its words afterwards."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from panelweave.llm import common

    path = public.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(8)], "doc_id long, text string")
    files = token_files.write_token_files(docs, path)
    assert token_files.read_token_files(files).count() == 8
    found = pq.ParquetFile(files.images.inputFiles()[0].removeprefix("file://")).metadata.row_group(0).column(3).compression
    assert found.startswith("LZ4")

    def state(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"held": [any(k.startswith("encoder") for k in common._STATE)] * b.num_rows})

    held = spark.range(8).repartition(8).mapInArrow(state, "held boolean").collect()
    assert any(r["held"] for r in held)
