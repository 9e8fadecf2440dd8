"""Fits over a large table rest on a bounded sample first, so few passes over all rows are left; they still rest over all rows."""

import numpy as np
import pytest

from tribuna.operators import lloyd, mixture


@pytest.fixture(scope="module")
def rows(spark):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(60_000, 3)) + np.array([[0, 0, 0], [2.2, 0, 0], [0, 2.2, 1]])[rnd.integers(0, 3, 60_000)]
    return x, lloyd.packed(spark.createDataFrame(list(zip(range(len(x)), x.tolist())), "k long, features array<double>"), key="k")


def counted(monkeypatch, module, name):
    calls, plain = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a, **k: calls.append(1) or plain(*a, **k))
    return calls


def test_kmeans(rows, monkeypatch):
    x, blocks = rows
    calls = counted(monkeypatch, lloyd, "_sums")
    starts = lambda: [lloyd.Start(3, s, share) for s in (1, 2) for share in (1000, 800)]
    plain = lloyd.fit(blocks, starts())
    before = len(calls)
    monkeypatch.setattr(lloyd, "MIDDLE", 14_000)
    got = lloyd.fit(blocks, starts())
    assert len(calls) - before < before
    for a, b in zip(plain, got):
        assert abs(a.cost / b.cost - 1) < 1e-4
    own = got[0]
    at, d = lloyd.nearest(x, own.centers)
    assert np.isclose(own.cost, d.sum())  # the cost is that of all rows
    moved = np.array([x[at == c].mean(0) for c in range(3)])
    assert ((moved - own.centers) ** 2).sum() <= 2 * lloyd.TOLERANCE * x.var(0).mean()


@pytest.mark.parametrize("full", [True, False])
def test_mixtures(rows, monkeypatch, full):
    x, blocks = rows
    calls = counted(monkeypatch, mixture, "_pass")
    plain = mixture.fit(blocks, [mixture.Mixture(3, 1, full), mixture.Mixture(2, 2, full, 800)], tolerance=1e-5)
    before = len(calls)
    monkeypatch.setattr(lloyd, "MIDDLE", 14_000)
    got = mixture.fit(blocks, [mixture.Mixture(3, 1, full), mixture.Mixture(2, 2, full, 800)], tolerance=1e-5)
    assert len(calls) - before < before
    for a, b in zip(plain, got):
        assert a.rows == b.rows and abs(a.likelihood - b.likelihood) < 1e-3
