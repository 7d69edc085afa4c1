"""The pipeline on tables with troubles, and end to end against plain code."""

import collections
import random

import pytest

import corpus_pipeline as p
from panelweave.llm import language, pii, toxicity
from panelweave.llm.encoding import Encoder

public = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_hash string, kept_id int"
WORDS = {"en": "river stone cloud meadow lantern winter harbour copper".split(), "de": "größe wasser straße nächte brücke höhe fluß zäune".split()}


def write(spark, folder, rows, labels):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def row(i, text, lang="en"):
    return i, text, lang, "s", None if text is None else len(text), "clash", 7


def sentence(rnd, n, lang="en"):
    return " ".join(rnd.choice(WORDS[lang]) + str(rnd.randrange(50)) * (rnd.random() < 0.5) for _ in range(n))


def test_every_stage_takes_an_empty_table(spark, tmp_path):
    docs = write(spark, tmp_path, [], [])
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")] and docs.count() == 0
    assert p.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0
    assert p.run(spark, str(tmp_path)).count() == 0


def test_stages_on_nulls_repeats_and_odd_texts(spark, tmp_path):
    rnd = random.Random(1)
    rows = [row(i, sentence(rnd, 30, ("en", "de")[i % 2]), ("en", "de")[i % 2]) for i in range(80)]
    rows += [row(None, rows[0][1]), row(None, None), row(4, None), row(5, ""), row(6, " \n"), rows[7], rows[7], row(7, "another text of the same id " * 3), row(88, rows[10][1].upper())]
    docs = write(spark, tmp_path, rows, [(1, 0, 0), (2, 0, 0)])
    assert p.drop_toxic(spark, docs, str(tmp_path)).count() == len(rows)  # no confirmed example: nothing goes
    kept = p.identify_languages(spark, docs, str(tmp_path))
    assert all((r["text"] or "").strip() for r in kept.collect())
    merged = collections.Counter((r["doc_id"], r["text"]) for r in p.merge_near_copies(spark, docs, str(tmp_path)).collect())
    assert merged[7, rows[7][1]] == 1 and merged[None, None] == 1 and merged[4, None] == 1 and merged[None, rows[0][1]] == 0 and merged[0, rows[0][1]] == 1
    assert merged[88, rows[10][1].upper()] == 0 and merged[10, rows[10][1]] == 1 and sum(merged.values()) == len(rows) - 4
    masked = p.mask_personal_data(spark, spark.createDataFrame([row(1, "mail a.b@c.example now"), row(2, None), (3, "x 10.0.0.1", "en", "s", None, "c", 1)], SCHEMA), str(tmp_path)).collect()
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in masked}
    assert got == {1: ("mail <email> now", 16), 2: (None, None), 3: ("x <ip>", None)}


def test_run_equals_plain_code(spark, tmp_path):
    """Each stage again in plain Python, with the models that Spark fitted on the same rows."""
    rnd = random.Random(2)
    rows = [row(i, sentence(rnd, 40, ("en", "de")[i % 2]), ("en", "de")[i % 2]) for i in range(260)]
    bad = [row(1000 + i, sentence(rnd, 25) + " vile rotten " + sentence(rnd, 5)) for i in range(60)]
    rows += bad + [row(2000 + i, rows[i][1] + " extra") for i in range(20)] + [row(3000, "1 2 3"), row(3001, None)]
    rows += [row(4000 + i, sentence(rnd, 20) + f" call +1 (415) 555-01{i:02d} " + sentence(rnd, 20)) for i in range(30)]
    docs = write(spark, tmp_path, rows, [(r[0], 0, int(r in bad)) for r in rows if r[0] is not None])
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    left = [r for r in rows if toxicity._Scorer(model).scores([r[1] or ""])[0] < p.TOXIC]
    assert not {r[0] for r in left} & {r[0] for r in bad}
    names, scores = language.Predictor(language.fit_language(spark.createDataFrame(left, SCHEMA))).predict([r[1] or "" for r in left])
    left = [r for r, n, s in zip(left, names, scores, strict=True) if n != "und" and s >= p.UNSURE]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in (r[1].lower().split() for r in left)]
    root = list(range(len(left)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(left):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    left = [r for i, r in enumerate(left) if r[0] == least[find(i)]]
    contexts = pii.learn_contexts(spark.createDataFrame(left, SCHEMA))
    texts = {r[0]: pii.redact(r[1], contexts) for r in left}
    assert sum("<phone>" in t for t in texts.values()) == 30
    codec = Encoder(public.path("word_bpe_49k.json"))
    want = {d: len(codec.encode([t])[0]) // 4 + 1 for d, t in texts.items()}
    got, places = collections.Counter(), collections.defaultdict(list)
    for r in p.run(spark, str(tmp_path)).collect():
        got[r["doc_id"]] += r["length"]
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    assert all(sum(n for _, n in s) <= 4096 and sorted(s)[0][0] == 0 for s in places.values()) and len(places) == -(-sum(want.values()) // 4096)


def test_chance_meetings_are_not_read_again(spark):
    """The pipeline's join on texts of ten words that share rare shingles: only copies reach the regions."""
    from panelweave.llm.jaccard import accumulator, jaccard_components

    rnd = random.Random(11)
    texts = [[f"w{rnd.randrange(10)}" for _ in range(60)] for _ in range(500)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(1000 + i, " ".join(texts[i][:-1] + ["end"])) for i in range(20)]
    tally = accumulator(spark)
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), p.NEAR, region_sets=40, tally=tally)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {d: d % 1000 for d, _ in rows}
    assert tally.value["split_across_tasks"] == 0 and 0 < tally.value["regions"] <= 20
