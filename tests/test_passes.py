"""Fits and measures that go over the rows a bounded number of times, against plain versions."""

import glob

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tribuna.operators import cluster as K
from tribuna.operators import hierarchy as H
from tribuna.operators import lloyd
from tribuna.operators import metrics as M


def points(spark, n=3000, d=4, seed=1):
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(n, d)) + 6 * rnd.integers(0, 3, size=(n, 1))
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "_row_id long, features array<double>")


def test_blocks_lie_in_small_files(spark, monkeypatch):
    monkeypatch.setattr(lloyd, "BLOCK", 10)
    _, df = points(spark, 1000)
    files = [f.removeprefix("file://") for f in lloyd.packed(df.coalesce(1)).inputFiles()]
    assert sum(pq.read_metadata(f).num_rows for f in files) == 100
    assert max(pq.read_metadata(f).num_rows for f in files) <= lloyd.BLOCKS_A_FILE


def test_sums_of_many_starts(spark):
    x, _ = points(spark, 500)
    ids, scale = np.arange(500), np.array([1.0, 0.5, 0.0, 2.0])
    starts = [lloyd.Start(3, 1, 1000, None, x[:3]), lloyd.Start(2, 2, 600, scale, x[5:7] * scale), lloyd.Start(4, 3, 300, None, x[10:14])]
    total = lloyd.Sums(starts)
    total.add(ids[:200], x[:200])
    total.add(ids[200:], x[200:])
    for s, (n, sums, cost) in zip(starts, total.parts()):
        own = s.rows(ids, x)
        d = ((own[:, None] - s.centers) ** 2).sum(2)
        at = d.argmin(1)
        assert n.tolist() == np.bincount(at, minlength=s.k).tolist()
        assert np.allclose(sums, [own[at == c].sum(0) for c in range(s.k)]) and np.isclose(cost, d.min(1).sum())


def test_sample_of_rows_is_bounded(spark):
    x, df = points(spark, 1000)
    blocks = lloyd.packed(df, key="_row_id")
    assert len(lloyd.row_sample(blocks, 50)) <= 50
    assert len(lloyd.row_sample(blocks, 5000)) == 1000
    same = lloyd.packed(df.withColumn("features", F.array(F.lit(1.0), F.lit(2.0))))
    assert 0 < len(lloyd.row_sample(same, 50)) <= 50


def test_mixture_takes_packed_blocks(spark):
    x, df = points(spark)
    blocks = lloyd.packed(df)
    centers, cost = K.fit_kmeans(df, 3, seeds=(1, 2), blocks=blocks)
    weights, means, variances = K.fit_diagonal_mixture(df.limit(0), centers, blocks=blocks)
    assert np.isclose(sum(weights), 1) and np.allclose(sorted(m[0] for m in means), sorted(c[0] for c in centers), atol=0.2)
    assert np.allclose(variances, 1, atol=0.25)


def test_centroids_with_nulls_and_uneven_vectors(spark):
    rows = [("a", [1.0, 2.0]), ("a", [3.0, None]), (None, [5.0]), ("b", None), (None, [7.0, 1.0, 2.0])]
    got = {r.c: (r.n, r.centroid) for r in M.centroids(spark.createDataFrame(rows, "c string, features array<double>"), "c").collect()}
    assert got == {"a": (2, [2.0, 2.0]), None: (2, [6.0, 1.0, 2.0])}


def test_names_stand_for_their_rows(spark):
    rows = [(i, [float(i % 3 * 10), float(i % 2)], ["palco norte", "vip", None][i % 3], i % 2, 1 - i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "_row_id long, features array<double>, texto_limpio string, tag_palco int, tag_vip int")
    names = H.name_counts(df, {"cluster": [[0.0, 0.5], [10.0, 0.5], [20.0, 0.5]]}, ["tag_palco", "tag_vip"])
    near = K.nearest_two(df, [[0.0, 0.5], [10.0, 0.5], [20.0, 0.5]])
    for weight, x in (("n", names), (None, near)):
        assert sorted(map(tuple, H.catalogue(x, "cluster", ["tag_palco", "tag_vip"], ["norte", "vip"], rollup="texto_limpio", weight=weight).collect()), key=repr) == sorted(
            map(tuple, H.catalogue(near, "cluster", ["tag_palco", "tag_vip"], ["norte", "vip"], rollup="texto_limpio").collect()), key=repr
        )
    assert names.count() == 6


def test_silhouette_of_more_rows_than_a_sample(spark):
    x, _ = points(spark, 2300)
    rows = [(i, i % 3, v.tolist()) for i, v in enumerate(x)] + [(9001, None, [0.0] * 4), (9002, 1, None), (9003, 7, [1.0] * 4)]
    df = spark.createDataFrame(rows, "id long, label long, features array<double>")
    got = {r.label: (r.n, r.silhouette) for r in M.silhouette_of_all(df, "label", "id").collect()}
    y = np.concatenate([x, [[1.0] * 4]])
    label = np.array([i % 3 for i in range(2300)] + [3])
    d = np.sqrt(((y[:, None] - y) ** 2).sum(2))
    sums = np.stack([d[:, label == c].sum(1) for c in range(4)], 1)
    n = np.bincount(label)
    at = np.arange(len(y))
    a, other = sums[at, label] / np.maximum(n[label] - 1, 1), sums / n
    other[at, label] = np.inf
    b = other.min(1)
    s = np.where(n[label] > 1, (b - a) / np.maximum(a, b), 0.0)
    assert {k: v[0] for k, v in got.items()} == {0: 767, 1: 768, 2: 766, 7: 1, None: 1}
    for c, name in enumerate((0, 1, 2, 7)):
        assert np.isclose(got[name][1], s[label == c].sum() / got[name][0])
    assert got[None][1] == 0.0


def test_ids_of_cards_pass_64_bits(spark, monkeypatch):
    from tribuna.plans import q_reports

    row = [(70000000000, 9_000_000, "s", "p", "Palco", 5, 5, 10.0, 1.0, 1.0)]
    schema = "_row_id long, t_performance_id long, site string, product string, logical_seat_category string, dn_quota long, performance_quota long, med_base_unit_amt_itx double, net_sold_p_qty double, net_sold_c_qty double"
    monkeypatch.setattr(q_reports, "inventory", lambda *_: spark.createDataFrame(row, schema))
    assert [int(r.id) for r in q_reports.cluster_representatives(spark, "").collect()] == [9_000_000 * 10**13 + 70000000000]


def test_full_mixtures_share_their_products():
    from tribuna.operators import mixture as X

    rnd = np.random.default_rng(0)
    x, seen = rnd.normal(size=(400, 5)) @ rnd.normal(size=(5, 5)), rnd.random(400) < 0.8
    fits = [X.Mixture(k, weights=np.full(k, 1 / k), means=rnd.normal(size=(k, 5)), covariances=np.array([np.cov(x.T) * (c + 0.5) for c in range(k)])) for k in (3, 2)]
    q = X.quadratic(x)
    got = X._full_sums(fits, np.concatenate([m.linear() for m in fits]), q, [None, seen.astype(float)])
    for m, own, flat in zip(fits, (x, x[seen]), got):
        assert np.allclose(q @ m.linear().T, m.log_terms(x))
        p, ll = m.posteriors(own)
        assert np.allclose(flat, np.concatenate([[ll.sum(), len(own)], p.sum(0), (p.T @ own).ravel(), np.array([(own * p[:, c, None]).T @ own for c in range(m.k)]).ravel()]))


def test_shares_of_a_shadow_run_round_as_sql_does():
    from tribuna.sources import shadow

    assert [shadow.half_up(x, n) for x, n in ((21.845, 2), (100 * (13107 / 60000), 2), (-0.00005, 4), (2.0, 2), (1e-9, 4))] == [21.85, 21.85, -0.0001, 2.0, 0.0]
