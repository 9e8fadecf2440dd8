"""Neighbour lists of rows without structure: exact in one leaf, near it from many, and with equal rows beyond a leaf."""

import numpy as np

from tribuna.operators import neighbours as N


def test_lists_of_hard_rows(spark):
    x = np.random.default_rng(5).normal(size=(700, 24))
    df = spark.createDataFrame(list(enumerate(x.tolist())), "_row_id long, features array<double>").repartition(4)
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    exact = {(a, int(b)) for a in range(700) for b in np.argsort(d[a], kind="stable")[:10]}
    whole = {(r.a, r.b) for r in N.neighbour_graph(df, k=10).collect()}
    assert whole == exact
    parted = {(r.a, r.b) for r in N.neighbour_graph(df, k=10, leaf=200).collect()}
    assert len(parted) == 7000 and len(parted & exact) / 7000 >= 0.9
    assert {(r.a, r.b) for r in N.exact_neighbours(df, [3, 77], k=10).collect()} == {(a, b) for a, b in exact if a in (3, 77)}


def test_equal_rows_beyond_a_leaf(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0, float(i // 300)]) for i in range(301)], "_row_id long, features array<double>")
    graph = N.neighbour_graph(df, k=3, leaf=50, trees=2).where("a < 300")
    assert graph.groupBy("a").count().where("count = 3").count() == 300 and graph.where("d <> 0 AND b <> 300").count() == 0
