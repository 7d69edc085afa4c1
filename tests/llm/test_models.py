"""Trained operators against plain evaluations, and what bootstrapping finds."""

import collections
import gc
import math
import os
import random
import time
import zlib
from pathlib import Path

import numpy as np
import pytest
import xxhash

from panelweave.llm import common, language, language_model, pii, toxicity

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
WORDS = "amber birch cedar delta ember fjord grove heath inlet jetty knoll ledge marsh north ocean plain quay ridge shore trail".split()


def sentence(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


# --- language model --------------------------------------------------------------------------


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(21)
    rows = [(i, " ".join(f"{rnd.choice(WORDS)} w{int(rnd.expovariate(0.01))}" for _ in range(40))) for i in range(260)]
    rows += [(None, "amber w1 amber"), (900, None), (901, ""), (902, "never seen before"), (3, rows[3][1])]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_scores_equal_a_plain_evaluation(corpus):
    rows, docs = corpus
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    hashes = lambda t: [xxhash.xxh3_64_intdigest(w) for w in (t or "").encode().translate(LOWER).split()] + [language_model.END]
    counts = collections.Counter(h for d, t in rows if not held(d) for h in hashes(t))
    fitted = language_model.fit_language_model(docs, block_tokens=700)
    vocabulary, single = fitted.vocabulary(), {h: i for i, h in enumerate(fitted.frequent)}
    assert len(single) == language_model.WORDS and all(vocabulary[h][0] == n for h, n in counts.items() if n >= language_model.SUPPORT and h in vocabulary)
    assert {h for h, n in counts.items() if n >= language_model.SUPPORT} == {*single, *vocabulary, language_model.END} - ({language_model.END} if not counts[language_model.END] else set())
    rare = {h: n for h, n in counts.items() if h not in single and h not in vocabulary and h != language_model.END}
    assert fitted.rare_mass == sum(n + 1 for n in rare.values()) + 1 and vocabulary

    def class_of(h):
        if h == language_model.END:
            return language_model.END_CLASS
        return single.get(h, language_model.FIRST_GROUP + vocabulary[h][1] if h in vocabulary else language_model.OTHER)

    def softmax(two, one):
        score = (fitted.classes.two[two] + fitted.classes.one[one]) @ fitted.classes.word.T + fitted.classes.bias
        e = np.exp(score - score.max())
        return e / e.sum()

    members = collections.defaultdict(list)
    for h, (n, g, q) in vocabulary.items():
        members[g].append((h, n, q))

    def plain(t):
        two = one = language_model.START
        total = 0.0
        for h in hashes(t):
            c = class_of(h)
            total += math.log10(softmax(two, one)[c])
            if c == language_model.OTHER:
                total += math.log10((counts[h] + 1) / fitted.rare_mass)
            elif c >= language_model.FIRST_GROUP:
                x = fitted.contexts.vectors[one].astype(float)
                weight = {w: (n + 1) * math.exp(float(q @ x)) for w, n, q in members[c - language_model.FIRST_GROUP]}
                total += math.log10(weight[h] / sum(weight.values()))
            two, one = one, c
        return total

    got = collections.Counter((r["doc_id"], round(r["score"], 2)) for r in language_model.score_texts(docs, block_tokens=700).collect())
    want = [(d, plain(t)) for d, t in rows]
    assert sum(got.values()) == len(rows)
    for d, s in want:
        assert any(abs(s - v) < 0.02 for e, v in got if e == d), (d, s)


def test_word_vectors_learn_their_contexts():
    """Words of one group that follow different classes: the vectors raise each where it belongs."""
    rng = np.random.default_rng(2)
    x = np.zeros((language_model.CLASSES, language_model.SIZE + 1), dtype=np.float32)
    x[:, -1], x[0, 0], x[1, 0] = 1, 1, -1
    times = np.array([[40, 2], [2, 40], [20, 20], [2, 0]])
    before = np.zeros((language_model.GROUPS, language_model.CLASSES))
    before[3, :2] = times.sum(axis=0)
    total, group = times.sum(axis=1), np.full(4, 3, dtype=np.uint8)
    mass = np.zeros(language_model.GROUPS, dtype=np.int64)
    mass[3] = (total + 1).sum()
    code = np.array([w * language_model.CLASSES + a for w in range(4) for a in range(2) if times[w, a]])
    flat = np.array([times[w, a] for w in range(4) for a in range(2) if times[w, a]])
    known = language_model.WordContexts(x, before, mass)
    q = language_model.train_words(code, flat, total, group, known, steps=60)
    score = (total + 1)[:, None] * np.exp(q / language_model.STEPS_OF_ONE @ x[:2].T.astype(float))
    share = score / score.sum(axis=0)
    plain = (total + 1) / (total + 1).sum()
    truth = times / times.sum(axis=0)
    assert np.abs(share - truth)[:3].max() < 0.12 and share[0, 0] > 1.5 * plain[0] > 3 * share[0, 1]
    assert (q == language_model.train_words(code, flat, total, group, known, steps=60)).all() and rng is not None


# --- language --------------------------------------------------------------------------------


def test_predictor_equals_a_plain_convolution():
    rng = np.random.default_rng(4)
    f, n = language.FILTERS, language.FILTERS * len(language.WIDTHS)
    filters = tuple(rng.normal(size=(w, 256, f)).astype(np.float32) for w in language.WIDTHS)
    model = language.LanguageModel(("a", "b", "c"), filters, rng.normal(size=n).astype(np.float32), rng.normal(size=(n, 3)).astype(np.float32), rng.normal(size=3).astype(np.float32))
    texts = ["ab", "Größe 日本 " * 30, "x" * 191, "y" * 192, "z q " * 300, "123", ""]

    def plain(text):
        data, sums = text.encode(), np.zeros(3)
        starts = [0]
        while starts[-1] + language.WINDOW < len(data):
            starts.append(starts[-1] + language.STEP)
        for at in starts:
            window = data[at : at + language.WINDOW].ljust(language.WINDOW, b"\0")
            pooled = [max(sum(float(t[k][window[i + k], j]) for k in range(len(t))) for i in range(language.WINDOW - len(t) + 1)) for t in filters for j in range(f)]
            hidden = np.maximum(np.array(pooled) + model.shift, 0)
            e = np.exp(hidden @ model.dense + model.bias)
            sums += e / e.sum() * sum(b >= 128 or chr(b).isalpha() for b in window)
        return model.names[sums.argmax()], sums.max() / sums.sum()

    names, scores = language.Predictor(model).predict(texts, block=2)
    for t, name, score in zip(texts, names, scores, strict=True):
        if any(map(str.isalpha, t)):
            want = plain(t)
            assert name == want[0] and abs(score - want[1]) < 1e-4
        else:
            assert (name, score) == ("und", 0)


def test_long_and_repeated_rows_are_learned_whole(spark):
    """What tells the language stands at the very end of long texts; one id holds a third of all rows."""
    rnd = random.Random(3)
    tail = {"aa": "abba cad beda fagad " * 60, "zz": "zorx quvy wixz oyux " * 60}
    rows = [(i, sentence(rnd, 300) + " " + tail[lang], lang) for i in range(120) for lang in [("aa", "zz")[i % 2]]]
    rows += [(7, rows[7][1], "zz")] * 60
    model = language.fit_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    names, _ = language.Predictor(model).predict([tail["aa"], tail["zz"]])
    assert names == ["aa", "zz"]


# --- toxicity --------------------------------------------------------------------------------


def test_scorer_equals_the_plain_sum():
    model = toxicity.ToxicModel({toxicity.feature(w): x for w, x in ((b"vile", 2.5), (b"rotten", 1.25), (b"kind", -0.5))}, -2.0)
    texts = ["", "Vile, vile!", "rotten-kind VILE", "nothing here", "KIND é vile"]
    want = [1 / (1 + math.exp(-(-2.0 + sum(model.weights.get(toxicity.feature(w), 0.0) for w in toxicity.words_of(t))))) for t in texts]
    for limit in (200_000, 1):
        assert np.allclose(toxicity._Scorer(model, limit).scores(texts), want)
    assert toxicity.words_of("KIND é,vile") == {b"kind", "é".encode(), b"vile"}


def test_words_of_few_positives_are_learned():
    """Each toxic word stands in seven or eight of forty examples; a tenth of the unlabelled are toxic too."""
    rnd = random.Random(6)
    toxic = [f"bad{i}" for i in range(16)]

    def document(n, bad):
        return np.unique(np.array([toxicity.feature(w.encode()) for w in [f"w{int(rnd.expovariate(0.01))}" for _ in range(n)] + rnd.sample(toxic, 3) * bad], dtype=np.uint32))

    positive = [document(40, True) for _ in range(40)]
    kinds = [rnd.random() < 0.1 for _ in range(900)]
    model = toxicity.fit_nnpu(positive, [document(40, bad) for bad in kinds])
    assert sum(model.weights.get(toxicity.feature(w.encode()), 0) > 1 for w in toxic) >= 10
    score = lambda d: 1 / (1 + math.exp(-model.bias - sum(model.weights.get(int(w), 0) for w in d)))
    assert sum(score(document(40, True)) >= 0.3 for _ in range(100)) >= 95
    assert sum(score(document(40, False)) < 0.3 for _ in range(100)) >= 97


def test_the_prior_is_that_of_the_unlabelled():
    rng = np.random.default_rng(1)
    p, u = np.full(6, 0.4), np.full(6, 0.04)
    p[3:], u[3:] = 0.1, 0.1  # words of everybody
    assert abs(toxicity.estimate_prior(p, u, np.array([20.0] * 3 + [0.5] * 3)) - 0.1) < 0.01 and rng is not None


# --- personal data ---------------------------------------------------------------------------


def planted(seed):
    """Identifiers that the base rules find beside the same kind of identifiers that they miss; and numbers that are neither."""
    rnd, rows, truth = random.Random(seed), [], set()
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    for i in range(800):
        kind, body = rnd.choice(["phone", "email", "pair", "none"]), sentence(rnd, 8)
        found = None
        if kind == "phone":
            found = f"0{digits(3)} {digits(7)}" if i % 8 == 0 else None
            body += " tel: " + (found or f"+49 {digits(3)} {digits(7)}")
        elif kind == "email":
            found = f"u{digits(3)}@intern" if i % 8 == 0 else None
            body += " mailto:" + (found or f"u{digits(3)}@h{digits(2)}.example.org")
        elif kind == "pair":
            found = f"+1 ({digits(3)}) {digits(3)}-{digits(4)}" if i % 8 == 0 else None
            body += f" {rnd.choice(WORDS)} " + (f"{found} {digits(12)}" if found else f"+1 ({digits(3)}) {digits(3)}-{digits(4)} {rnd.choice(WORDS)}")
        else:
            body += f" in {rnd.randint(1500, 2000)} were {digits(5)} of {digits(2)}.{digits(4)} items v{digits(4)}"
        if found:
            at = body.index(found)
            truth.add((i, at, at + len(found)))
        rows.append((i, f"{body} {sentence(rnd, 4)}"))
    return rows, truth


def test_bootstrapping_finds_planted_identifiers(spark):
    rows, truth = planted(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    model = pii.learn_contexts(docs)
    assert model.kinds and model.forms and model.kinds["g:mailto:"] == "email"
    found = set()
    for i, t in rows:
        base = pii.base_spans(t)
        found |= {(i, a, b) for _, a, b in pii.more_spans(t, base, model)}
    hit = len(found & truth)
    assert len(truth) > 50 and hit / len(truth) >= 0.95 and hit / len(found) >= 0.95


def test_patterns_are_induced_from_accepted_instances(spark):
    """Seeds make "tel:" reliable, what it introduces makes its form reliable, and that form stands elsewhere alone."""
    rnd = random.Random(8)
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    rows = [(i, f"tel: +49 {digits(3)} {digits(7)} {sentence(rnd, 3)}") for i in range(80)]
    rows += [(100 + i, f"tel: 0{digits(3)}/{digits(7)} {sentence(rnd, 3)}") for i in range(12)]
    rows += [(200, "ring 0171/2345678 please"), (201, "ring 5 please")]
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == "phone:5:17" and got[200] == "phone:5:17"
    one = pii.learn_contexts(spark.createDataFrame(rows, "doc_id long, text string"), rounds=1)
    more = pii.learn_contexts(spark.createDataFrame(rows, "doc_id long, text string"), rounds=3)
    assert set(one.forms) < set(more.forms) and got[201] == ""


def test_parts_of_runs_and_overlaps():
    model = pii.ContextModel({}, {"f:+9 (999) 999-9999": "phone"})
    text = "call +1 (171) 555-2028 0810992847249404 or 12 +1 (171) 555-2029 a@b.co"
    spans = pii.more_spans(text, pii.base_spans(text), model)
    assert [text[a:b] for _, a, b in spans] == ["+1 (171) 555-2028", "+1 (171) 555-2029"] or [text[a:b] for _, a, b in spans] == ["+1 (171) 555-2028"]
    for odd in ("", "9" * 5000, "1 " * 4000, "x" * 9000 + "1", "a@" * 3000, "(" * 3000 + "1"):
        pii.more_spans(odd, pii.base_spans(odd), model)


def test_word_groups_follow_all_words(spark):
    """44,000 words of one range, of which the last 4,000 by hash stand beside other classes: the groups of one kind hold none of the other."""
    from panelweave.llm.common import pack_varints
    from panelweave.llm.language_model import SIDE, _groups, _pack, _unpack

    rng = np.random.default_rng(10)
    n, late = 44_000, 4_000
    means = rng.integers(20, 120, (n, 2 * SIDE)).astype(np.int8)
    means[-late:] *= -1
    hashes = np.arange(n, dtype=np.uint64)
    rows = [(b, 0, bytearray(hashes[p].tobytes()), bytearray(pack_varints(np.full(n // 2, 9))), bytearray(_pack(means[p]))) for b, p in enumerate((slice(0, n // 2), slice(n // 2, n)))]
    found = _groups(spark.createDataFrame(rows, "block long, range int, a binary, b binary, c binary"))
    group = np.concatenate([_unpack(bytes(r["a"]), np.uint8) for r in found.where("block >= 0").orderBy("block").collect()])
    assert len(group) == n and not set(group[-late:].tolist()) & set(group[:-late].tolist())


def test_places_leave_out_patterns_of_too_few_strings(spark):
    """Pattern a has three strings, b two: with a support of three only a's places stay, with all of their counts."""
    rows = [("a", 1, "ip", 2), ("a", 1, None, 1), ("a", 2, "ip", 1), ("a", 3, None, 4), ("b", 1, "ip", 1), ("b", 2, None, 9)]
    edges = spark.createDataFrame(rows, "pattern string, instance long, kind string, n long")
    places = pii.pattern_places(edges, 3)
    assert {(r["pattern"], r["instance"], r["n"], r["open"], r["total"]) for r in places.collect()} == {("a", 1, 3, True, 8), ("a", 2, 1, False, 8), ("a", 3, 4, True, 8)}
    accepted = spark.createDataFrame([(1, "ip", 1.0), (3, "ip", 0.5)], "instance long, kind string, ri double")
    assert [tuple(r) for r in pii.score_patterns(places, accepted).collect()] == [("a", "ip", 5 / 8, 2)]


def test_batches_that_are_read_are_small(spark):
    """Unless the session set its own size."""
    from panelweave.llm.common import READ_ROWS, ship

    size = "spark.sql.parquet.columnarReaderBatchSize"
    for own, want in (("4096", str(READ_ROWS)), ("100", "100")):
        spark.conf.set(size, own)
        ship(spark)
        assert spark.conf.get(size) == want
    spark.conf.unset(size)


def test_the_driver_hands_freed_memory_back(spark, monkeypatch):
    jvm = spark.sparkContext._jvm
    own = jvm.java.io.File("/proc/self").getCanonicalFile().getName()
    resident = lambda: int(Path(f"/proc/{own}/statm").read_text().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20
    held = jvm.java.util.ArrayList()
    for _ in range(1500):
        held.add(jvm.java.nio.ByteBuffer.allocateDirect(100_000))
    for i in range(1500):
        if i % 15:
            held.set(i, None)
    gc.collect()
    jvm.System.gc()
    time.sleep(1)
    before = resident()
    monkeypatch.setattr(common, "_RELIEF_DUE", [0.0], raising=False)
    table = common.materialize(spark.range(10), "small")
    assert table.count() == 10 and before - resident() > 75
    common.discard(table)
