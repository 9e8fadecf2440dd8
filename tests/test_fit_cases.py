"""Cases of the advice of round 1."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tribuna.operators import cluster as K
from tribuna.plans import q_cluster, q_mining
from tribuna.plans.domain import inventory
from tribuna.sources import io, score
from tribuna.sources.score import reject_reasons

DIR = "/root/testdata/sf0.001"


def test_all_events_are_scored(spark):
    rows = inventory(spark, DIR)
    checked = reject_reasons(io.event_rows(q_mining._documents(spark, DIR, "true")))
    assert checked.count() == rows.count()
    # rows that break the contract or the filter are left out, in every event alike
    valid = score.clean_rows(score.with_row_id(checked.where("reject IS NULL").drop("reject")))
    want = {str(r[0]): r[1] for r in valid.groupBy("t_performance_id").count().collect()}
    got = {r[0]: r[1] for r in q_mining.score_event_json(spark, DIR).groupBy("t_performance_id").count().collect()}
    assert got == want and len(want) > rows.select("t_performance_id").distinct().count() // 50 + 1


def test_mixture_and_prototypes_settle(spark):
    rnd = random.Random(3)
    data = [(i, [rnd.gauss(2.5 * (i % 3), 1.0), rnd.gauss(0, 1 + i % 3), rnd.gauss(-(i % 3), 1.0)], "ab"[i % 2]) for i in range(600)]
    df = spark.createDataFrame(data, "id long, features array<double>, cat string").repartition(2)
    start = [data[i][1] for i in (0, 3, 6)]

    def likelihood(steps):
        fit = K.fit_diagonal_mixture(df, start, steps=steps)
        return fit, df.select(F.avg(K.log_density(F.col("features"), *fit))).first()[0]

    fit, reached = likelihood(100)
    w, m, v = fit
    plain = sum(math.log(sum(p * math.prod(math.exp(-((x - a) ** 2) / (2 * s)) / math.sqrt(2 * math.pi * s) for x, a, s in zip(row[1], mu, var)) for p, mu, var in zip(w, m, v))) for row in data) / len(data)
    assert abs(plain - reached) < 1e-9
    assert likelihood(2)[1] < reached - 1e-3
    rows = K.mixed_distance_clusters(df, "features", ["cat"], 3, 0.1).select("features", "cat", "cluster").collect()
    protos = {}
    for c in {r.cluster for r in rows}:
        own = [r for r in rows if r.cluster == c]
        cats = sorted(r.cat for r in own)
        protos[c] = ([sum(x) / len(own) for x in zip(*(r.features for r in own))], max(sorted(set(cats)), key=cats.count))
    cost = lambda r, c: math.dist(r.features, protos[c][0]) ** 2 + 0.1 * (r.cat != protos[c][1])
    assert all(cost(r, r.cluster) <= min(cost(r, c) for c in protos) + 1e-9 for r in rows)


def test_vector_queries_read_all_dimensions(spark):
    rows = spark.read.parquet(f"{DIR}/embeddings.parquet").collect()
    assert {len(r.features) for r in q_cluster.vectors(spark, DIR).collect()} == {len(rows[0].embedding)} == {64}
    x = np.array([r.embedding for r in rows], dtype=float)
    var = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    got = q_cluster.pca_project(spark, DIR).first()
    assert abs(got.var1 - var[0]) < 2e-6 and abs(got.var2 - var[1]) < 2e-6
    assert [r.k for r in q_cluster.auto_k(spark, DIR).collect()] == [3, 4, 5, 6, 7]
