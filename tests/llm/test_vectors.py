"""The grid of blocks, and how much the levels of segments leave."""

import numpy as np

from panelweave.llm import segment_search, vector_blocks
from panelweave.llm.nearest import nearest_neighbours
from panelweave.llm.segment_search import top_products


def table(spark, x, partitions):
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(partitions)


def test_small_cells_give_the_same_result(spark, monkeypatch):
    """Tiny blocks, several query blocks, a third of all vectors equal, a third under one id."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 8))
    x[100:200] = x[0]
    docs = table(spark, x, 4).selectExpr("CASE WHEN vec_id >= 200 THEN 30 ELSE vec_id END AS vec_id", "embedding")
    kept = [
        {(r["query_id"], r["rank"], r["vec_id"], round(float(r["score"]), 5)) for r in f(docs, every=30, k=4).collect()}
        for f in (nearest_neighbours, top_products)
    ]
    monkeypatch.setattr(vector_blocks, "QUERY_BLOCK", 40)
    monkeypatch.setattr(vector_blocks, "BLOCK_BYTES", 700)
    monkeypatch.setattr(vector_blocks, "CELL_BLOCKS", 2)
    monkeypatch.setattr(vector_blocks, "TILE_ROWS", 16)
    for f, want in zip((nearest_neighbours, top_products), kept, strict=True):
        got = f(docs, every=30, k=4).collect()
        assert {(r["query_id"], r["rank"], r["vec_id"], round(float(r["score"]), 5)) for r in got} == want
        assert len(got) == 4 * (100 + 7)


def levels_left(x, queries, k=5):
    side, best = segment_search._prepare(x[:queries]), vector_blocks.Best(queries, k + 1)
    for at in range(0, len(x), 500):
        segment_search._run(side, np.arange(at, min(at + 500, len(x))), x[at : at + 500], best)
    return side.left[1:] / side.left[0]


def test_levels_prune_where_directions_differ():
    """With energy in few directions, turned at random, the coarse levels leave little; alike directions leave them nothing to tell."""
    rng = np.random.default_rng(7)
    turn, _ = np.linalg.qr(rng.normal(size=(64, 64)))
    falling = rng.normal(size=(4000, 64)) * np.exp(-np.arange(64) / 4) @ turn
    even = rng.normal(size=(4000, 64))
    left, plain = levels_left(falling, 60), levels_left(even, 60)
    assert (np.diff(left) <= 0).all() and (np.diff(plain) <= 0).all()
    assert left[1] < 0.3 and left[2] < 0.2 and plain[0] > 0.9


def test_turned_bounds_hold():
    rng = np.random.default_rng(5)
    q, x = rng.normal(size=(30, 20)) * np.arange(1, 21), rng.normal(size=(40, 20))
    turn, edges = segment_search.directions(q)
    assert np.allclose(turn.T @ turn, np.eye(20)) and all(set(a) <= set(b) for a, b in zip(edges[:-1], edges[1:], strict=True))
    for n, e in zip(segment_search.LEVELS, edges, strict=True):
        assert (segment_search.statistics(q @ turn, n, e) @ segment_search.statistics(x @ turn, n, e).T >= q @ x.T - 1e-6).all()
    for odd in (np.zeros((3, 4)), np.full((2, 3), 1e300), np.zeros((2, 0)), np.zeros((0, 3))):
        turn, edges = segment_search.directions(odd)
        assert turn.shape == (odd.shape[1],) * 2 and all(e[0] == 0 and e[-1] == odd.shape[1] for e in edges)
