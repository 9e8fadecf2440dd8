"""Hard negatives against scoring every row in plain Python, and the bounds of the approximations."""

import math
import random

import numpy as np
import pytest

from tribuna.llm import hardneg

SCHEMA = "vec_id long, embedding array<float>, label int, row long, q string, id int, x string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, g, 0, "q", 1, "x") for i, v, g in rows], SCHEMA)


def plain(rows, every=100, n_pos=5, n_neg=10, low=30, high=90):
    own = []
    for i, v, g in rows:
        if g is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        own.append((i, g, [max(-(1 << 27), min(1 << 27, math.floor(256 * float(np.float32(x))))) for x in v]))
    out = []
    order = lambda j: (-score[j], own[j][0] is None, own[j][0] or 0)
    for k, (i, g, q) in enumerate(own):
        if i is None or i % every:
            continue
        score = {j: sum(a * b for a, b in zip(q, own[j][2])) for j in range(len(own)) if j != k}
        for j in sorted((j for j in score if own[j][1] == g), key=order)[:n_pos]:
            p = score[j]
            hits = sorted((m for m in score if own[m][1] != g and low * p <= 100 * score[m] <= high * p), key=order)[:n_neg]
            out += [(i, own[j][0], r, own[m][0], p, score[m]) for r, m in enumerate(hits, 1)]
    return sorted(out, key=repr)


def cases(n=900, dims=6):
    rnd = random.Random(n)
    center = [[rnd.gauss(0, 0.4) for _ in range(dims)] for _ in range(4)]
    rows = [(i, [c + rnd.gauss(0, 0.3) for c in center[i % 4]], i % 4 if rnd.random() < 0.9 else 9) for i in range(n)]
    hot = rows[5]
    rows += [(10_000 + i, list(hot[1]), hot[2]) for i in range(300)]  # one vector under many ids
    rows += [(100, list(rows[100][1]), rows[100][2])] * 2 + [(200, [0.5] * dims, 1), (300, [0.0] * dims, 2)]  # repeated rows, an id twice, the zero vector
    rows += [(None, list(hot[1]), 1), (None, list(hot[1]), 2), (2**53 + 1, list(hot[1]), 1), (2**53 + 2, list(hot[1]), 1)]
    rows += [(20_000, None, 1), (20_100, [], 1), (20_200, [None] * dims, 1), (20_300, [float("nan")] * dims, 0), (20_400, [float("inf")] + [0.1] * (dims - 1), 0), (20_500, [0.2] * dims, None)]
    rows += [(20_600, [0.7, 0.7], 3), (20_700, [1e30] + [0.0] * (dims - 1), 77), (20_801, [-1e30] * dims, 0)]
    return rows


@pytest.mark.parametrize("every,n_pos,n_neg,low,high", [(100, 5, 10, 30, 90), (50, 2, 3, 0, 100), (300, 400, 7, 50, 60)])
def test_against_plain(spark, every, n_pos, n_neg, low, high):
    got = hardneg.mine(vectors(spark, cases()).repartition(3), every, n_pos, n_neg, low, high).collect()
    assert sorted(map(tuple, got), key=repr) == plain(cases(), every, n_pos, n_neg, low, high)


def test_blocks_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "BLOCK_ROWS", 37)
    monkeypatch.setattr(hardneg, "BLOCK_ANCHORS", 3)
    rows = cases(300)
    got = hardneg.mine(vectors(spark, rows), 20).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows, 20)


def test_few_rows(spark):
    assert hardneg.mine(vectors(spark, [])).collect() == []
    assert hardneg.mine(vectors(spark, [(100, None, 1)])).collect() == []
    assert hardneg.mine(vectors(spark, [(100, [1.0], 1)])).collect() == []
    got = hardneg.mine(vectors(spark, [(100, [1.0], 1), (2, [1.0], 1), (3, [0.5], 2)])).collect()
    assert [tuple(r) for r in got] == [(100, 2, 1, 3, 65536, 32768)]


def test_folds(spark):
    df = hardneg.folded_labels(vectors(spark, [(7, [1.0], 9), (14, [1.0], 3), (8, [1.0], 9), (None, [1.0], 4), (21, [1.0], None)]))
    assert [(r.vec_id, r.label) for r in df.collect()] == [(7, 0), (14, 4), (8, 9), (None, 4), (21, None)]


def test_bounds_hold_and_prune(spark):
    """Every score lies in its bounds, and few rows are left to be scored."""
    rnd = np.random.default_rng(2)
    q = np.floor(rnd.normal(0, 32, (3000, 64))).astype(np.int64)
    df = spark.createDataFrame([(i, i, 0, x) for i, x in enumerate(q.tolist())], "row long, vec_id long, label long, q array<int>")
    edges = hardneg.cell_edges(df)
    low, high = hardneg.bounds(q[:20], hardneg.codes(q, edges), edges)
    score = q[:20] @ q.T
    assert (low <= score).all() and (score <= high).all()
    left = [(h >= np.sort(lo)[-5]).mean() for lo, h in zip(low, high)]
    assert max(left) < 0.05
