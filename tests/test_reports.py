"""Operators of reports, bounded picks, long phrases and saved sub-models."""

import numpy as np
import pytest

from tribuna.operators import cluster as K
from tribuna.operators import metrics as M
from tribuna.operators import phrases as X
from tribuna.operators import selection as S
from tribuna.operators import venue as V
from tribuna.operators.hierarchy import SubModel, predict_hierarchy
from tribuna.operators.space import Space
from tribuna.sources import io


def test_representative_falls_back_to_the_border(spark):
    rows = [("a", 1, 0.9, True), ("a", 2, 0.5, False), ("b", 3, 0.4, True), ("b", 4, 0.6, True), ("c", 5, None, None)]
    df = spark.createDataFrame(rows, "g string, id int, s double, f boolean")
    assert sorted(r.id for r in S.representatives(df, "g", "s", "f", "id").collect()) == [2, 4, 5]


def test_gallery_caps_and_special_cards(spark):
    rows = [(i, f"n{i // 6 % 3}", c, "hibrido" if i == 5 else "palco", i / 1000, i % 50 == 0) for i, c in enumerate(list(S.PREMIUM * 6) + list(S.MASS * 6) + ["AU-0"] * 5 + ["PPF-2"])]
    df = spark.createDataFrame(rows, "_row_id int, logical_seat_category string, micro_cluster_id string, label_auto string, score_confianza double, es_frontera boolean")
    got = [(r.grupo, r.caso) for r in S.gallery(df).collect()]
    assert {k: got.count(k) for k in set(got)} == {("premium", "representante"): 8, ("masivos", "representante"): 12, ("especiales", "representante"): 2, ("especiales", "frontera"): 2, ("especiales", "hibrido"): 1}
    assert S.gallery(df.where("false")).count() == 0
    assert all(r.micro_cluster_id != "VIP-0" for r in S.gallery(df, excluded=["VIP-0"]).collect())


def test_dear_general_leaves_single_zones_and_null_text(spark):
    rows = [(1, "teatro", "GENERAL NORTE", 0.7, 0), (2, "teatro", "GENERAL", 0.7, -1), (3, "teatro", "GENERALES", 0.7, 0), (4, "bar", "GENERAL", 0.9, 0), (5, "auditorio", None, 0.9, 0), (6, "auditorio", "LA GENERAL", 0.6, 0)]
    df = spark.createDataFrame(rows, "id int, type_site string, texto_limpio string, percentil_precio_absoluto_dentro_tipo double, cluster int")
    assert [r.id for r in S.dear_general(df).collect()] == [1]


def test_name_matches_in_either_case(spark):
    df = spark.createDataFrame([("Piso 2",), ("PALCO",), (None,)], "n string")
    assert [r.n for r in S.name_matches(df, "n", "palco").collect()] == ["PALCO"]


def test_cumulative_variance_and_correlations(spark):
    df = spark.createDataFrame([(0, 6.0), (1, 3.0), (2, 1.0)], "i int, v double")
    assert [(round(r.cumulative, 6), r.is_enough) for r in M.cumulative_variance(df, "i", "v", 0.9).orderBy("i").collect()] == [(0.6, False), (0.9, True), (1.0, True)]
    xs = spark.createDataFrame([(1.0, 2.0, 3.0), (2.0, 4.0, 1.0), (3.0, 6.0, None)], "a double, b double, c double")
    assert {(r.a, r.b): round(r.r, 6) for r in M.correlations(xs, ["a", "b", "c"]).collect()} == {("a", "b"): 1.0, ("a", "c"): -1.0, ("b", "c"): -1.0}


def test_phrases_of_any_length(spark):
    long = " ".join(f"W{i}" for i in range(15))
    d = spark.createDataFrame([(long, "TEATRO", 0)], "site string, type_site string, _ord long")
    df = spark.createDataFrame([(f"GRAN {long} SUR",), (long[3:],), (None,)], "site string")
    assert sorted((r.dictionary_type or "-") for r in V.dictionary_types(df, d).collect()) == ["-", "-", "TEATRO"]
    c = spark.createDataFrame([(long, 15, 9, 9), (long[3:], 14, 5, 5), ("W3 W5", 2, 4, 4)], "ngram string, n_tokens int, frecuencia long, n_eventos long")
    assert {r.ngram: r.subsumidos for r in X.subsume(c).collect()} == {long: 1, "W3 W5": 0}


def test_compression_counts(spark):
    c = spark.createDataFrame([("A B", 2, 9, 30), ("A", 1, 8, 25), ("C", 1, 3, 4)], "ngram string, n_tokens int, frecuencia long, n_eventos long")
    k = spark.createDataFrame([("calendario", 40), ("ciudad", 2)], "tipo string, n_eventos long")
    r = X.compression(c, k, 20, 1).first()
    assert (r.brutos, r.tras_subsumcion, r.tras_clases, r.final) == (3, 1, 2, 1)


def test_review_coverage(spark):
    look = spark.createDataFrame([("a", "PARQUE", 0.7, "x"), ("b", "MUSEO", 0.7, "x")], "site string, type_site string, confianza double, fuente string")
    review = spark.createDataFrame([("a", " TEATRO "), ("c", "ARENA"), ("d", "nada")], "site string, type_final string")
    done = V.consolidate_review(look, review)
    assert sorted((r.site, r.type_site, r.confianza) for r in done.collect()) == [("a", "TEATRO", 1.0), ("b", "MUSEO", 0.7), ("c", "ARENA", 1.0)]
    assert V.coverage(done, spark.createDataFrame([("a",), ("b",), ("c",), ("d",), (None,)], "site string")).first().pct == 75.0
    assert V.coverage(done, look.where("false").select("site")).first().pct is None


def test_hierarchy_round_trip(spark, tmp_path):
    space = Space(numeric=("ratio_precio_max",), tags=("tag_palco",), type_weight=0.0, text_weight=0.0, centers={"ratio_precio_max": 0.5}, scales={"ratio_precio_max": 0.1}, idf={})
    models = {"VIP / Palcos / Premium": SubModel("VIP", space, [[0.0, 0.0], [1.0, 1.0]], ["palco", "hibrido_k1"])}
    io.save_hierarchy(spark, models, str(tmp_path / "h"), {"VIP-0": 0.25, "VIP-1": 0.75})
    got, reference = io.load_hierarchy(spark, str(tmp_path / "h"))
    assert got == models and reference == {"VIP-0": 0.25, "VIP-1": 0.75}
    with pytest.warns(UserWarning):
        io.load_hierarchy(spark, str(tmp_path / "h"), "0")
    rows = spark.createDataFrame([(1, "VIP / Palcos / Premium", 0.6, 1, "PALCO", "TEATRO"), (2, "otro", 0.5, 0, None, None)], "_row_id int, arquetipo_demanda string, ratio_precio_max double, tag_palco int, texto_limpio string, type_site string")
    ids = lambda m: [(r._row_id, r.micro_cluster_id) for r in predict_hierarchy(rows, m).orderBy("_row_id").collect()]
    assert ids(got) == ids(models) and ids(got)[0] == (1, "VIP-1")


def test_stop_patterns_never_raise(spark, tmp_path):
    (tmp_path / "s.csv").write_text("patron\nA\nB\n")
    assert io.stop_patterns(spark, str(tmp_path / "none.csv"), None, str(tmp_path / "s.csv")) == ["A", "B"]
    (tmp_path / "bad.parquet").write_text("x")
    assert len(io.stop_patterns(spark, str(tmp_path / "absent"))) > 5


def test_sweeps(spark):
    points = [(i, [float(i % 3 * 10 + i / 100), float(i % 3 * 10 - i / 90)]) for i in range(90)]
    df = spark.createDataFrame(points, "id int, features array<double>")
    rows = {r["k"]: r for r in K.sweep_kmeans(df, "id", (2, 3, 4))}
    x, labels = np.array([p[1] for p in points]), np.array([i % 3 for i in range(90)])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    s = []
    for i in range(90):
        inside = [d[i, j] for j in range(90) if labels[j] == labels[i] and j != i]
        a, b = np.mean(inside), min(np.mean([d[i, j] for j in range(90) if labels[j] == g]) for g in {0, 1, 2} - {labels[i]})
        s.append((b - a) / max(a, b))
    centers = np.array([x[labels == g].mean(0) for g in range(3)])
    within = sum(((x[labels == g] - centers[g]) ** 2).sum() for g in range(3))
    between = sum(30 * ((centers[g] - x.mean(0)) ** 2).sum() for g in range(3))
    assert abs(rows[3]["silhouette"] - np.mean(s)) < 1e-9 and abs(rows[3]["inertia"] - within) < 1e-6
    assert abs(rows[3]["calinski_harabasz"] - (between / 2) / (within / 87)) < 1e-5
    assert max(rows.values(), key=lambda r: r["silhouette"])["k"] == 3

    two = K.sweep_mixture(df, (2, 3))
    for r, parameters in zip(two, (11, 17)):
        assert abs(r["bic"] - (parameters * np.log(90) - 2 * r["log_likelihood"])) < 1e-6
        assert abs(r["aic"] - (2 * parameters - 2 * r["log_likelihood"])) < 1e-6
