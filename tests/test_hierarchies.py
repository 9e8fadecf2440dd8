"""Density clusters, Ward's tree and K-Means of many starts against plain versions."""

import math
import random

import numpy as np
import pytest

from tribuna.operators import agglomerate as A
from tribuna.operators import density as D
from tribuna.operators import lloyd as L


def points(seed, n=240, dims=3, copies=0):
    rnd = random.Random(seed)
    x = [[rnd.gauss(4 * (i % 3 == 0), 0.5 + 0.3 * (i % 3)) + 3 * (d == i % 3) for d in range(dims)] for i in range(n)]
    x += [[rnd.uniform(-12, 12) for _ in range(dims)] for _ in range(n // 8)]
    x += [list(x[3]) for _ in range(copies)]
    return x


def frame(spark, x):
    return spark.createDataFrame([(i, v, "e") for i, v in enumerate(x)], "_row_id long, features array<double>, other string").repartition(3)


def plain_tree(x, neighbours):
    """Prim's algorithm on all pairs, then edges by the same order."""
    n = len(x)
    d = [[math.dist(a, b) for b in x] for a in x]
    core = [sorted(row)[min(neighbours, n) - 1] for row in d]
    reach = lambda i, j: max(core[i], core[j], d[i][j])
    edges, inside, out = [], {0}, set(range(1, n))
    best = {j: (reach(0, j), 0, j) for j in out}
    while out:
        e = min(best[j] for j in out)
        new = e[2] if e[2] in out else e[1]
        edges.append(e)
        inside.add(new)
        out.discard(new)
        for j in out:
            best[j] = min(best[j], (reach(new, j), min(new, j), max(new, j)))
    return sorted(edges)


def plain_clusters(n, edges, least):
    """Recursive version: a cluster is a set of rows; splits into two large sets or loses rows, by removing the longest edges."""
    sides = {}

    def split(rows, tree):
        """(rows of two sides, trees) at the longest edge."""
        e = tree[-1]
        rest, side = tree[:-1], {e[1]}
        grown = True
        while grown:
            grown = False
            for _, a, b in rest:
                if (a in side) != (b in side):
                    side |= {a, b}
                    grown = True
        other = rows - side
        return e, (side, [t for t in rest if t[1] in side]), (other, [t for t in rest if t[1] in other])

    def grow(rows, tree, birth):
        stability, live = 0.0, len(rows)
        start, exits = rows, {}
        while tree:
            e, one, two = split(rows, tree)
            at = 1 / max(e[0], D.LEAST_DISTANCE)
            if len(one[0]) >= least and len(two[0]) >= least:
                kids = [grow(*one, at), grow(*two, at)]
                stability += len(rows) * (at - birth)
                own = {"rows": start, "stability": stability, "kids": kids}
                return own
            big = one if len(one[0]) >= least else two if len(two[0]) >= least else (set(), [])
            gone = rows - big[0]
            stability += len(gone) * (at - birth)
            rows, tree = big
        del live, exits
        return {"rows": start, "stability": stability, "kids": []}

    def choose(c):
        inner = [choose(k) for k in c["kids"]]
        total = sum(s for s, _ in inner)
        if total > c["stability"]:
            return total, [x for _, xs in inner for x in xs]
        return c["stability"], [c["rows"]]

    root = grow(set(range(n)), edges, 0.0)
    del sides
    return {frozenset(x) for k in root["kids"] for x in choose(k)[1]}


@pytest.mark.parametrize("seed,least,neighbours,copies", [(1, 20, 5, 0), (2, 8, 3, 0), (3, 25, 10, 0), (4, 15, 5, 40), (5, 200, 5, 0), (6, 5, 1, 3)])
def test_density_against_plain(spark, monkeypatch, seed, least, neighbours, copies):
    monkeypatch.setattr(D, "CHUNK", 50)
    x = points(seed, copies=copies)
    df = frame(spark, x)
    m = D.fit_density(df, least_size=least, neighbours=neighbours)
    assert len(m.x) == len(x)
    order = {tuple(v): i for i, v in enumerate(m.x.tolist())}
    edges = plain_tree(m.x.tolist(), neighbours)
    got = D.spanning_tree(spark, m.x, m.core)
    assert abs(sum(e[0] for e in edges) - sum(e[0] for e in got)) < 1e-8 and len(got) == len(x) - 1
    want = plain_clusters(len(x), edges, least)
    clusters = {frozenset(np.flatnonzero(m.label == c).tolist()) for c in range(m.clusters)}
    assert clusters == want
    labels = {r._row_id: r.cluster for r in D.predict_density(df, m).collect()}
    if not copies:
        assert [labels[i] for i in range(len(x))] == [int(m.label[order[tuple(v)]]) for v in x]
    assert (m.label == -1).any()


def test_density_of_other_rows(spark):
    x = points(7, 300)
    df = frame(spark, x)
    m = D.fit_density(df, least_size=20, neighbours=5, sample=200)
    assert len(m.x) == 200 and m.clusters >= 2
    got = {r._row_id: r.cluster for r in D.predict_density(df, m).collect()}
    assert len(got) == len(x) and set(got.values()) <= {-1, *range(m.clusters)}
    far = D.predict_density(frame(spark, [[500.0, 500.0, 500.0], m.x[np.flatnonzero(m.label == 0)[0]].tolist()]).withColumnRenamed("other", "o"), m).orderBy("_row_id").collect()
    assert [r.cluster for r in far][0] == -1
    assert D.fit_density(df.limit(0)).clusters == 0 and D.fit_density(df.limit(1)).label.tolist() == [-1]
    assert {r.cluster for r in D.predict_density(df, D.fit_density(df.limit(1))).collect()} == {-1}


def plain_ward(x, k):
    parts = [[i] for i in range(len(x))]
    mean = lambda p: [sum(x[i][d] for i in p) / len(p) for d in range(len(x[0]))]
    means = [mean(p) for p in parts]
    while len(parts) > k:
        _, a, b = min((len(p) * len(q) / (len(p) + len(q)) * math.dist(means[i], means[j]) ** 2, i, j) for i, p in enumerate(parts) for j, q in enumerate(parts) if i < j)
        parts[a] += parts.pop(b)
        means.pop(b)
        means[a] = mean(parts[a])
    return {frozenset(p) for p in parts}


def test_ward_against_plain(spark, monkeypatch):
    monkeypatch.setattr(D, "CHUNK", 16)
    x = np.array(points(8, 60))
    tree = A.merges(spark, x)
    assert len(tree) == len(x) - 1
    for k in (1, 2, 3, 5, 9, 30, len(x)):
        label, means = A.cut(x, tree, k)
        assert {frozenset(np.flatnonzero(label == c).tolist()) for c in range(k)} == plain_ward(x.tolist(), k)
        assert means.tolist() == sorted(means.tolist())


def test_ward_assigns_all_rows(spark):
    x = points(9, 150, copies=50)
    df = frame(spark, x)
    got = A.ward(df, 4, sample=120)
    assert got.count() == len(x) and {r.cluster for r in got.collect()} == {0, 1, 2, 3}
    assert A.ward(df.limit(0), 3).count() == 0 and len(A.ward_centers(df.limit(2), [5])[5]) <= 2
    same = frame(spark, [[1.0, 2.0]] * 30)
    assert {r.cluster for r in A.ward(same, 1).collect()} == {0}


def test_many_starts(spark):
    x = np.array(points(10, 300))
    blocks = L.packed(frame(spark, x.tolist()), key="_row_id")
    starts = L.fit(blocks, [L.Start(k, s) for k in (1, 2, 4) for s in (1, 2, 3)] + [L.Start(3, 5, 800)], tolerance=0.0)
    for s in starts[:-1]:
        at, d = L.nearest(x, s.centers)
        assert abs(d.sum() - s.cost) < 1e-6 * s.cost  # a settled fit: each centre is the mean of its rows
        assert all(np.allclose(s.centers[c], x[at == c].mean(0)) for c in set(at))
    assert np.allclose(starts[0].centers[0], x.mean(0))
    best = L.best_of(starts)
    assert best[4].cost == min(s.cost for s in starts if s.k == 4) and best[1].cost > best[2].cost > best[4].cost
    cells = L.contingency(blocks, best[4].centers, [best[4], best[2]])
    assert abs(L.rand_index(cells[0]) - 1.0) < 1e-12 and sum(cells[1].values()) == len(x)
    mean, std = L.stability(blocks, {2: best[2].centers}, rounds=4)[2]
    assert 0.5 < mean <= 1.0 and 0 <= std < 0.5
    seen = sum(L.contingency(blocks, None, [starts[-1]])[0].values())
    assert 0.7 * len(x) < seen < 0.9 * len(x)


def test_starts_of_no_rows(spark):
    df = spark.createDataFrame([], "_row_id long, features array<double>")
    assert [s.centers for s in L.fit(L.packed(df, key="_row_id"), [L.Start(3)])] == [None]
    one = L.fit(L.packed(frame(spark, [[1.0, 2.0]] * 5), key="_row_id"), [L.Start(3)])[0]
    assert one.cost == 0 and np.allclose(one.centers, [1.0, 2.0])


def test_measures_of_starts(spark):
    from tribuna.operators import cluster as K
    from tribuna.operators import metrics as M

    x = np.array(points(11, 200))
    df = frame(spark, x.tolist())
    blocks, scale = L.packed(df, key="_row_id"), np.array([1.0, 0.5, 2.0])
    starts = L.fit(blocks, [L.Start(3, 1), L.Start(4, 2, 1000, scale), L.Start(1, 3)], tolerance=0.0)
    got = L.measures(blocks, starts)
    weighted = frame(spark, (x * scale).tolist())
    labels = [L.nearest(x, starts[0].centers)[0], L.nearest(x * scale, starts[1].centers)[0]]
    found = L.silhouettes(spark, x, [(labels[0], None), (labels[1], scale), (np.zeros(len(x), int), None)])
    for i, (d, s) in enumerate(((df, starts[0]), (weighted, starts[1]))):
        c = K.nearest_two(d, s.centers.tolist()).select("_row_id", "features", "cluster")
        assert abs(got[i]["davies_bouldin"] - M.davies_bouldin(c, "cluster").first()[0]) < 1e-9
        assert abs(got[i]["calinski_harabasz"] / M.calinski_harabasz(c, "cluster").first()[0] - 1) < 1e-9
        want = M.silhouette(c, "cluster", "_row_id").collect()
        assert abs(found[i] - sum(r.n * r.silhouette for r in want) / len(x)) < 1e-9
        assert sorted(got[i]["sizes"]) == sorted(r.n for r in want)
    assert got[2]["davies_bouldin"] is None and found[2] is None and got[2]["sizes"] == [len(x)]


@pytest.mark.parametrize("full", [True, False])
def test_mixtures_against_plain(spark, full):
    from tribuna.operators import mixture as G

    x = np.array(points(12, 210))
    blocks = L.packed(frame(spark, x.tolist()), key="_row_id")
    fits = G.fit(blocks, [G.Mixture(k, s, full) for k in (1, 2, 3) for s in (1, 2)], tolerance=1e-6)
    # one component is the sample's own moments
    assert np.allclose(fits[0].means[0], x.mean(0)) and np.allclose(fits[0].covariances[0], (np.cov(x.T, bias=True) if full else x.var(0)) + (1e-6 * np.eye(3) if full else 1e-6))
    best = G.best_of(fits)
    for m in best.values():
        assert m.rows == len(x)
        dens = np.zeros(len(x))
        for w, mu, c in zip(m.weights, m.means, m.covariances):
            c = c if full else np.diag(c)
            z = x - mu
            dens += w * np.exp(-0.5 * (z @ np.linalg.inv(c) * z).sum(1)) / math.sqrt((2 * math.pi) ** 3 * np.linalg.det(c))
        assert abs(np.log(dens).mean() - m.likelihood) < 1e-4
        p, _ = m.posteriors(x)  # settled: a further step changes little
        assert np.allclose(p.sum(0) / len(x), m.weights, atol=0.02)
    assert best[1].likelihood < best[2].likelihood < best[3].likelihood
    d = 3
    assert best[2].parameters == 1 + 2 * d + (2 * d * (d + 1) / 2 if full else 2 * d)
    mean, std = G.stability(blocks, {2: best[2]}, rounds=3)[2]
    assert 0.3 < mean <= 1 and std >= 0
    same = G.fit(L.packed(frame(spark, [[1.0, 2.0]] * 6), key="_row_id"), [G.Mixture(2, 1, full)])[0]
    assert np.isfinite(same.likelihood)
