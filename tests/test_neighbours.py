"""Neighbour lists against distances to all rows, and the layout against the eigenvectors of the same walk."""

import numpy as np
from pyspark.sql import functions as F

from tribuna.operators import neighbours as N


def frame(spark, x):
    return spark.createDataFrame([(i, v) for i, v in enumerate(np.asarray(x, float).tolist())], "_row_id long, features array<double>").repartition(4)


def test_recall(spark):
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(900, 12)) + 4 * rnd.integers(0, 3, size=(900, 1))
    df = frame(spark, x)
    graph = N.neighbour_graph(df, k=10)
    counts = graph.groupBy("a").count().collect()
    assert len(counts) == 900 and {r["count"] for r in counts} == {10} and graph.where("a = b").count() == 0
    exact = N.exact_neighbours(df, list(range(0, 900, 9)), k=10)
    assert exact.join(graph.select("a", "b"), ["a", "b"]).count() / exact.count() >= 0.9
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    assert all(abs(d[r.a, r.b] - r.d) < 1e-9 for r in graph.limit(200).collect())


def test_layout_against_eigenvectors(spark):
    rnd = np.random.default_rng(3)
    x = np.concatenate([rnd.normal(size=(60, 3)) + c for c in (0, 2.2, 4.4)])
    graph = N.neighbour_graph(frame(spark, x), k=8).cache()
    rows = N.spectral_layout(graph, 2, 60).collect()
    n = len(x)
    w = np.zeros((n, n))
    spread = graph.agg(F.avg("d")).first()[0]
    for r in graph.collect():
        w[r.a, r.b] = w[r.b, r.a] = np.exp(-r.d**2 / (2 * spread**2))
    walk = w / w.sum(1, keepdims=True)
    values, vectors = np.linalg.eig(walk)
    lead = vectors[:, np.argsort(-values.real)[1:3]].real
    got = np.array([r.xy for r in sorted(rows, key=lambda r: r.id)])
    # the plane of the layout holds both leading directions
    g = w.sum(1)
    for v in lead.T:
        v = v - (g * v).sum() / g.sum()
        fit = np.linalg.lstsq(got * np.sqrt(g)[:, None], v * np.sqrt(g), rcond=None)[0]
        assert ((got @ fit - v) ** 2 * g).sum() / (v**2 * g).sum() < 0.05


def test_few_rows(spark):
    assert N.neighbour_graph(frame(spark, np.zeros((0, 2)))).count() == 0
    assert N.neighbour_graph(frame(spark, [[1.0, 2.0]])).count() == 0
    same = N.neighbour_graph(frame(spark, [[1.0, 2.0]] * 12), k=3)
    assert same.groupBy("a").count().where("count <> 3").count() == 0 and same.where("d <> 0").count() == 0
