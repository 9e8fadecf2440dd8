"""Correlations in one pass: missing values by pairs, far from 0, against numpy; nothing is written."""

import numpy as np

from tribuna.operators import metrics as M


def test_pairs_with_missing_values(spark, monkeypatch):
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(500, 3)) + 1e6
    x[:, 2] += x[:, 0]
    rows = [tuple(None if rnd.random() < 0.2 else float(v) for v in r) + (7.0,) for r in x]
    monkeypatch.setattr(M, "materialise", lambda *a: 1 / 0, raising=False)
    got = {(r.a, r.b): r.r for r in M.correlations(spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(5), ["a", "b", "c", "d"]).collect()}
    for i, j in ((0, 1), (0, 2), (1, 2)):
        both = np.array([(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None])
        assert abs(got["abc"[i], "abc"[j]] - np.corrcoef(both.T)[0, 1]) < 1e-9
    assert got["a", "d"] is None
