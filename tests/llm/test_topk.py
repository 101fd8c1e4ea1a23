import random

import numpy as np

from tarnlake.llm import topk


def brute(rows, k=20, every=20):
    ok = [(i, v, [int(np.floor(64 * float(x))) for x in e]) for i, (v, e) in enumerate(rows) if e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for i, v, q in ok:
        if v is None or v % every:
            continue
        scores = sorted((-sum(a * b for a, b in zip(q, c, strict=False)), u if u is not None else 2**63, u) for j, u, c in ok if j != i)
        out += [(v, r + 1, u, -s) for r, (s, _, u) in enumerate(scores[:k])]
    return sorted(out, key=str)


def check(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.search(df, **more).collect()), key=str) == brute(rows)


def test_topk_small_blocks(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(spark, rows, block=90, together=1)
    check(spark, rows, block=90, most_ranges=0)


def test_topk_odd_rows(spark):
    rnd = random.Random(4)
    rows = [(k, [rnd.choice([-0.5, 0.0, 0.25, 0.5]) for _ in range(3)]) for k in range(120)]
    rows += [(20, [0.5, 0.5, 0.5])] * 3 + [(40, None), (60, [float("nan"), 0.0, 1.0]), (80, [None, 1.0, 1.0]), (None, [9.0, 9.0, 9.0]), (-20, [0.1, 0.1, 0.1]), (7, [1.0]), (1000, [])]
    check(spark, rows, block=50)
    check(spark, [(0, [1.0, 2.0])])
    check(spark, [])


def test_large_components_stay_exact(spark):
    check(spark, [(k, [3e5 + k, -2e5 * k, 1e6]) for k in range(30)])
    check(spark, [(0, [0.5, 0.25]), (1, [1e9, 0.0]), (2, [4e9, 0.0]), (3, [3e9, 5.0]), (20, [1e-3, 1e-3])])
    check(spark, [(0, [1.0, 3.0])] + [(k, [2.0**45 + 2.0**24 * k, float(-k)]) for k in range(1, 20)])  # products beyond 2**53


def test_queries_skip_blocks_that_cannot_reach_their_floor(spark):
    """Clusters far apart: a query meets its own block and hardly another; nothing is lost."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8)) * 50
    rows = [(k, [float(x) for x in np.float32(centres[k % 12] + rng.normal(size=8))]) for k in range(1200)]
    check(spark, rows, block=100)
    ints = np.floor(64 * np.array([e for _, e in rows]))
    pivots = topk.choose_pivots(ints[:256], 32)
    dist = np.sqrt(((ints[:, None] - pivots[None]) ** 2).sum(2))
    cell, norm2 = dist.argmin(1), (ints**2).sum(1)
    cells = np.unique(cell)
    ranges = {"cb": cells, "low": np.stack([dist[cell == c].min(0) for c in cells]), "high": np.stack([dist[cell == c].max(0) for c in cells]), "norm2": np.array([norm2[cell == c].max() for c in cells])}
    sent = 0
    for q in range(0, 1200, 20):
        scores = ints @ ints[q]
        scores[q] = -np.inf
        own = np.sort(scores[cell == cell[q]])[-20:]
        floor = own[0] if len(own) == 20 else -np.inf
        to = set(topk.blocks_to_meet(dist[q], norm2[q], floor, cell[q], ranges).tolist())
        sent += len(to)
        best = np.argsort(-scores)[:20]
        assert {c for c in cell[best]} <= to | {cell[q]}
    assert sent < 0.7 * 60 * (len(cells) - 1)


def test_cells_share_blocks_while_they_fit():
    first, blocks, n = topk.deal_cells({0: 40, 1: 50, 2: 20, 3: 250, 4: 10, 5: 90}, 100)
    assert (first, blocks, n) == ({0: 0, 1: 0, 2: 1, 3: 2, 4: 5, 5: 5}, {0: 1, 1: 1, 2: 1, 3: 3, 4: 1, 5: 1}, 6)
    assert topk.deal_cells({}, 100) == ({}, {}, 0)
