"""Regions that are larger than a task, and what the recursion counts."""

import random
from collections import Counter

import numpy as np

from panelweave.llm.jaccard import JaccardJoin, _measured, _regions, accumulator, jaccard_components, join_region, least_difference, sketch_of

JOIN = JaccardJoin(4, 85)


def words(rnd, n, kind="w"):
    return [f"{kind}{rnd.randrange(10**6)}" for _ in range(n)]


def changed(rnd, base, n, at=None):
    out = list(base)
    for i in range(at, at + n) if at is not None else rnd.sample(range(len(base)), n):
        out[i] = f"x{rnd.randrange(10**9)}"
    return out


def test_a_cluster_held_by_its_middle(spark):
    """500 copies of one text, changed in twenty places: those of unlike places are linked by the text alone."""
    rnd = random.Random(3)
    base = words(rnd, 200)
    rows = [(5, " ".join(base))] + [(1000 + i, " ".join(changed(rnd, base, 12, 9 * (i % 20)))) for i in range(500)]
    rows += [(9000 + i % 50, " ".join(words(rnd, 60))) for i in range(100)]
    tally = accumulator(spark)
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), JOIN, region_sets=32, tally=tally)
    by = Counter(r["component_id"] for r in got.collect())
    assert by[5] == 501 and len(by) == 1 + 50
    assert tally.value["split_across_tasks"] >= 501 and tally.value["pivots_met"] > 0


def test_cells_recurse_across_tasks_and_inside(spark):
    """Thirty clusters that share a rare phrase with the next: one region, which pivots part into its clusters."""
    rnd = random.Random(4)
    rows, phrases, want = [], [words(rnd, 5, "p") for _ in range(31)], {}
    for c in range(30):
        base = words(rnd, 240)
        copies = [base] + [changed(rnd, base, 3, 40 * i) for i in range(1, 6)]
        copies.append(phrases[c] + base[5:200] + phrases[c + 1] + base[205:])
        for i, text in enumerate(copies):
            rows.append((100 * c + i, " ".join(text)))
            want[100 * c + i] = 100 * c
    rnd.shuffle(rows)
    tally = accumulator(spark)
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), JOIN, region_sets=40, tally=tally)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == want
    assert tally.value["split_across_tasks"] >= 210 and tally.value["pairs"] + tally.value["pivots_met"] < 210 * 209 / 2


def test_sets_all_equally_far_are_told_apart(spark):
    """One template with a sixth of each text its own: no two linked, no pivot tells them apart."""
    rnd = random.Random(5)
    base = words(rnd, 150)
    rows = [(i, " ".join(changed(rnd, base, 12, 5 * (i % 25)))) for i in range(90)] + [(200 + i, " ".join(changed(rnd, base, 2))) for i in range(3)]
    for region in (16, 1000):
        got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), JOIN, region_sets=region).collect()
        sets = {d: {tuple(t.split()[i : i + 4]) for i in range(147)} for d, t in rows}
        root = {d: d for d in sets}

        def find(d, root=root):
            while root[d] != d:
                d = root[d]
            return d

        for a in sets:
            for b in sets:
                if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    one, two = sorted((find(a), find(b)))
                    root[two] = one
        assert {r["doc_id"]: r["component_id"] for r in got} == {d: find(d) for d in sets}


def test_small_regions_use_pivots_too():
    rng, seen = np.random.default_rng(6), Counter()
    centres = [rng.choice(10**6, 200, replace=False) for _ in range(6)]
    sets = []
    for c in centres:
        for _ in range(8):
            s = c.copy()
            s[rng.choice(200, 5, replace=False)] = rng.integers(10**6, 10**9, 5)
            sets.append(np.unique(s).astype(np.uint64))
    roots = join_region(sets, JOIN, seen)
    assert len(set(roots.tolist())) == 6 and all(len(set(roots[8 * i : 8 * i + 8].tolist())) == 1 for i in range(6))
    assert seen["cells_at_depth_1"] > 0 and seen["pairs"] < 48 * 47 / 2


def test_chance_meetings_make_no_region(spark):
    """Texts of twelve words that share rare shingles with many others: only sets that may be linked are read again."""
    rnd = random.Random(7)
    texts = [[f"w{rnd.randrange(12)}" for _ in range(60)] for _ in range(600)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(1000 + i, " ".join(texts[i][:-1] + ["end"])) for i in range(20)]
    tally = accumulator(spark)
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), JOIN, region_sets=40, tally=tally)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {d: d % 1000 for d, _ in rows}
    assert tally.value["split_across_tasks"] == 0 and 0 < tally.value["regions"] <= 20


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(8)
    for n in (1, 2, 5, 40, 41, 300, 2000):
        for m in (n, n + n // 6, max(1, n // 2)):
            a, b = (np.unique(rng.integers(0, 1 << 63, k).astype(np.uint64)) for k in (n, m))
            b = np.unique(np.concatenate([a[: rng.integers(0, n + 1)], b]))
            one, two = (np.frombuffer(sketch_of(x), np.uint8)[None, :] for x in (a, b))
            apart = len(np.setxor1d(a, b))
            assert least_difference(one, two)[0] <= apart and least_difference(one, one)[0] == 0
            assert JOIN.may_link(apart, len(a), len(b)) == JOIN.linked(len(np.intersect1d(a, b)), len(a), len(b))


def test_large_regions_fall_apart_by_sketches(spark):
    """Three sets in a cell of which two may be linked, and a fourth linked with the third: one region, or two where one is too large."""
    rng = np.random.default_rng(9)
    sets = [rng.integers(0, 1 << 63, 200).astype(np.uint64) for _ in range(2)]
    sets = [sets[0], np.append(sets[0][:-3], sets[1][:3]), sets[1], np.append(sets[1][:-3], sets[0][:3])]
    sketches = spark.createDataFrame([(i, 200, bytearray(sketch_of(s))) for i, s in enumerate(sets)], "key long, n long, sketch binary")
    met = spark.createDataFrame([(None, None, False, [0, 1, 2]), (2, 3, False, None)], "a long, b long, sure boolean, keys array<long>")
    for most, want in ((4096, 1), (3, 2)):
        roots = {r["node"]: r["root"] for r in _regions(met, sketches, JOIN, 4, most).collect()}
        assert set(roots) == {0, 1, 2, 3} and len(set(roots.values())) == want and roots[0] == roots[1] and roots[2] == roots[3]


def test_windows_that_hold_nearly_all_are_not_cut_again(spark):
    """Clusters of 150 copies, each changed by its own share, and texts between: windows overlap at every level; sets move few times."""
    rnd, rows = random.Random(1), []
    for c in range(3):
        base = words(rnd, 200)
        rows += [" ".join(x if rnd.random() > p else f"x{rnd.randrange(10**9)}" for x in base) for p in [rnd.expovariate(1 / 0.025) for _ in range(150)]]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, rows)]
    join, root = JaccardJoin(5, 80), list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and join.linked(len(sets[i] & sets[j]), len(sets[i]), len(sets[j])):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    tally = accumulator(spark)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_components(docs, join, region_sets=16, tally=tally).collect()}
    assert got == dict(enumerate(root))
    assert tally.value["split_across_tasks"] <= len(rows) and tally.value["pairs"] < len(rows) ** 2 / 4
    assert 0 < tally.value["sets_moved"] <= 8 * len(rows)


def test_windows_name_sets_without_their_shingles(spark):
    """Two sets and a pivot that one of them is linked with: what is written per window doesn't grow with the sets."""
    rng = np.random.default_rng(2)
    raw = [np.sort(rng.integers(0, 1 << 63, 5000).astype(np.uint64)) for _ in range(2)]
    row = lambda k, pivot: (1, 0, pivot, k, bytearray(raw[k].tobytes()))
    tables = [spark.createDataFrame(r, "cell long, chunk long, pivot boolean, key long, shingles binary") for r in ([row(0, False), row(1, False)], [row(0, True)])]
    met = [r.asDict() for r in _measured(*tables, JOIN).collect()]
    assert sorted((r["key"], r["rest"]) for r in met) == [(0, False), (1, True)]
    assert all(not isinstance(v, (bytes, bytearray)) for r in met for v in r.values())
