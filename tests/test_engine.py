"""Text, venues, percentiles, relative metrics, drift, phrases, labels, documents: hand-made values."""

import json
import math

import pytest
from pyspark.sql import functions as F

from tribuna.functions import rules
from tribuna.functions import text as T
from tribuna.operators import cluster as K
from tribuna.operators import drift as D
from tribuna.operators import hierarchy as H
from tribuna.operators import metrics as M
from tribuna.operators import percentile as P
from tribuna.operators import phrases as X
from tribuna.operators import relative as R
from tribuna.operators import selection as S
from tribuna.operators import venue as V
from tribuna.sources import io


def values(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_clean_names(spark):
    df = spark.createDataFrame([("Palco Despecho - Sende Tour",), ("PLATEA CENTRAL",), (None,), ("  balcón  301 - 306 (  ) ",)], "s string")
    assert [r[0] for r in df.select(T.clean_seat_name(F.col("s"))).collect()] == ["PALCO DESPECHO", "PLATEA CENTRAL", "", "BALCON"]


def test_tags(spark):
    df = spark.createDataFrame([("Palco VIP Occidental",), ("Platea piso 2",), ("Paltea",)], "s string")
    rows = T.with_text_features(df, "s").collect()
    assert [(r.tag_palco, r.tag_vip, r.tag_occidental, r.tag_platea, r.tag_piso_alto) for r in rows] == [(1, 1, 1, 0, 0), (0, 0, 0, 1, 1), (0, 0, 0, 0, 0)]


def test_terms_and_coverage(spark):
    df = spark.createDataFrame([("A b-c",), ("",)], "s string")
    assert [r[0] for r in df.select(T.terms(F.col("s"))).collect()] == [["a", "b", "c", "a b", "b c"], []]
    assert [r[0] for r in df.select(T.token_coverage(F.col("s"), ["a"])).collect()] == [0.5, 0.0]


def test_relative_metrics(spark):
    rows = [(1, 50, 100, 10.0, 40.0, 10.0), (1, 50, 100, 20.0, 0.0, 0.0), (1, 50, 100, None, 60.0, 0.0), (2, 5, 0, 0.0, 1.0, 1.0)]
    df = R.relative_metrics(spark.createDataFrame(rows, "t_performance_id long, dn_quota long, performance_quota long, med_base_unit_amt_itx double, net_sold_p_qty double, net_sold_c_qty double"))
    got = {(r.t_performance_id, r.med_base_unit_amt_itx): r for r in df.collect()}
    assert got[1, 10.0].ratio_precio_max == 0.5 and got[1, 10.0].percentil_precio_evento == 0.5 and got[1, 20.0].percentil_precio_evento == 1.0
    assert got[1, None].ratio_precio_max is None and got[1, None].percentil_precio_evento is None and got[1, None].tasa_ocupacion == 1.0
    assert got[1, 10.0].ratio_cortesias == 0.2 and got[1, 20.0].ratio_cortesias == 0.0
    assert got[2, 0.0].peso_aforo == 1.0 and got[2, 0.0].ratio_precio_max == 0.0 and got[2, 0.0].ratio_precio_mean == 1.0


def test_split(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 0.5), (2, 0.5), (3, 0.995), (3, 0.005)], "t_performance_id long, peso_aforo double")
    one, many = R.split_events(df)
    assert sorted(r.t_performance_id for r in one.collect()) == [1, 3, 3] and many.count() == 2


def test_lookup(spark):
    look = spark.createDataFrame([("Teatro  Colón", "PARQUE", 0), ("TEATRO COLON", "TEATRO", 1), ("", "ARENA", 2)], "site string, type_site string, _ord int")
    df = spark.createDataFrame([("  teatro   colón",), ("Nowhere",), (None,)], "site string")
    assert values(V.venue_types(df, look), "type_site", "flag_site_desconocido") == [("TEATRO", 0), ("desconocido", 1), ("desconocido", 1)]


@pytest.mark.parametrize("name,quota,a", [("SALA 2", 100, "OTROS_RECINTOS"), ("VIA 40 BARRANQUILLA", 100, "PARQUE"), ("PARKING NORTE", 100, "PARQUEADERO"), ("BIBLOS CAR WASH", 100, "OTROS_RECINTOS"), ("X", 15000, "ESTADIO"), ("CASA X", 100, "RESTAURANTE")])
def test_rules_a(spark, name, quota, a):
    df = spark.createDataFrame([(name, quota)], "site string, aforo_max int")
    assert V.classify_venues(df).select("a.type").first()[0] == a


def test_dictionary_never_matches_the_other_way(spark):
    d = spark.createDataFrame([("SALA 2 CINEMATECA", "CINEMATECA", 0)], "site string, type_site string, _ord int")
    df = spark.createDataFrame([("SALA 2",), ("LA SALA 2 CINEMATECA SUR",)], "site string")
    assert sorted(values(V.dictionary_types(df, d), "site", "dictionary_type")) == [("LA SALA 2 CINEMATECA SUR", "CINEMATECA"), ("SALA 2", None)]


def test_type_percentile_training_and_inference_agree(spark):
    rows = [(i, f"S{i}", "N", "TEATRO", 20000.0 + i * 2911.0) for i in range(80)] + [(99, "C", "N", "ARENA", 5.0)]
    df = spark.createDataFrame(rows, "t_performance_id long, site string, logical_seat_category string, type_site string, med_base_unit_amt_itx double")
    train = {r.t_performance_id: r for r in P.type_percentile(df).collect()}
    infer = {r.t_performance_id: r for r in P.percentile_of(df, P.reference_prices(df), P.percentile_reference(df)).collect()}
    for i in range(80):
        assert abs(train[i].percentil_precio_absoluto_dentro_tipo - infer[i].percentil_precio_absoluto_dentro_tipo) < 1e-9
    assert (train[99].percentil_precio_absoluto_dentro_tipo, train[99].flag_cold_start_tipo) == (0.5, 1)


def test_frequencies(spark):
    df = spark.createDataFrame([("s", "TEATRO")] * 75 + [("t", "ARENA")] * 25, "site string, type_site string")
    r = {x.type_site: x for x in V.type_frequencies(df).collect()}
    assert len(r) == 11 and r["TEATRO"].is_dominant and r["ARENA"].is_cold and r["MUSEO"].is_empty


def test_psi_of_equal_histograms(spark):
    h = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (4, 40)], "bin int, n long")
    assert D.psi(h, h, "bin").first()["psi"] == 0.0


def test_drift_without_reference_says_so(spark):
    lot = spark.createDataFrame([(1.0,)], "x double")
    assert D.drift_report(None, lot, ["x"]).first()["state"] == D.NO_REFERENCE


def test_micro_drift(spark):
    exp = spark.createDataFrame([(f"c{i}", 0.05) for i in range(20)], "c string, share double")
    even = spark.createDataFrame([(f"c{i}",) for i in range(20)] * 5, "c string")
    skew = spark.createDataFrame([("c0",)] * 90 + [("c1",)] * 10, "c string")
    assert not D.micro_drift(even, "c", exp).first()["active"] and D.micro_drift(skew, "c", exp).first()["active"]


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (1.01,)], "x double").select(D.bin_of(F.col("x"), F.lit(0.0), F.lit(1.0)))
    assert [r[0] for r in df.collect()] == [1, 10, None]


def test_labels():
    shares = {"tag_palco": 0.9, "tag_occidental": 0.7, "tag_piso_alto": 0.65}
    assert H.auto_label(0, {"tag_palco": 0.9, "tag_occidental": 0.8}, "alto", 0.9, 0.5) == "Palco Occidental Alto"
    assert H.auto_label(0, {"tag_balcon": 0.9, "tag_piso_alto": 0.8}, "balcon", 0.9, 0.9) == "Balcón Piso Alto"
    assert H.auto_label(3, shares, "x", 0.5, 0.5) == "hibrido_k3"
    assert H.auto_label(3, shares, "ninguno", 0.9, 0.5) == "hibrido_k3"


def test_assignment():
    assert K.assign_one_to_one([[1.0, 9.0], [9.0, 1.0]]) == [0, 1]
    assert K.assign_one_to_one([[1.0, 2.0], [1.0, 5.0]]) == [1, 0]
    assert sorted(K.assign_one_to_one([[1.0], [0.5], [3.0]])) == [-1, -1, 0]


def test_blobs_are_found(spark):
    rows = [(i, [float(i % 3) * 50 + (i % 7) * 0.1, float(i % 5) * 0.1], i % 3) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, features array<double>, truth int")
    centers, _ = K.fit_kmeans(df, 3)
    assert M.adjusted_rand(K.nearest_two(df, centers), "cluster", "truth").first()["ari"] == 1.0
    mean, std = H.bootstrap_stability(K.nearest_two(df, centers), "id", "cluster", lambda d, s: K.fit_kmeans(d, 3, seeds=(s,))[0], rounds=2)
    assert mean > 0.9 and std < 0.1


def test_posterior(spark):
    df = spark.createDataFrame([([0.0],)], "v array<double>").select(K.posterior(F.col("v"), [0.5, 0.5], [[0.0], [2.0]], [[1.0], [1.0]]))
    assert abs(df.first()[0][0] - 1 / (1 + math.exp(-2))) < 1e-12


def test_purity_and_crosstab(spark):
    df = spark.createDataFrame([("a", 1, 0, "palco norte"), ("a", 1, 0, "palco"), ("b", 1, 0, "x"), ("b", 0, 1, "palco")], "c string, tag_palco int, tag_vip int, texto_limpio string")
    r = {x.c: x for x in M.purity(df, "c", ["tag_palco", "tag_vip"], ["palco", "norte"]).collect()}
    assert (r["a"].purity_tag, r["a"].tag_dominante, r["a"].purity_term) == (1.0, "tag_palco", 1.0)
    assert (r["b"].purity_tag, r["b"].tag_dominante, r["b"].purity_term, r["b"].purity_naming) == (0.5, "tag_palco", 0.5, 0.5)
    cells = {(x.c, x.tag_vip, x.level): x.n for x in M.crosstab(df, "c", "tag_vip").collect()}
    assert cells["a", 0, 0] == 2 and cells[None, None, 3] == 4 and cells["b", None, 1] == 2


def test_subsumption(spark):
    rows = [("A B C", 3, 50, 50), ("A B", 2, 50, 50), ("B C", 2, 50, 50), ("A", 1, 50, 50), ("B", 1, 50, 50)]
    got = X.subsume(spark.createDataFrame(rows, "ngram string, n_tokens int, frecuencia long, n_eventos long")).collect()
    assert [(r.ngram, r.subsumidos) for r in got] == [("A B C", 4)]


def test_phrase_classes(spark):
    df = spark.createDataFrame([("Show Enero", 1), ("Show Mayo", 2), ("Show ABRIL", 3), (None, 4)], "product string, t_performance_id long")
    r = [x for x in X.phrase_classes(df).collect() if x.tipo == "calendario"]
    assert len(r) == 1 and r[0].n_eventos == 3 and r[0].frecuencia == 3


def test_queue_has_a_top(spark):
    df = spark.createDataFrame([(f"W{i:03d}", 200 - i, 30) for i in range(150)], "ngram string, frecuencia long, n_eventos long")
    r = dict((x.queue, x.n) for x in X.review_queue(df, 100).groupBy("queue").agg(F.count("*").alias("n")).collect())
    assert r == {"review": 100, "observe": 50}


def test_strata_pick(spark):
    rows = [(i, "p", f"s{i}", float(q), 4) for i, q in enumerate([240, 1650, 6435, 12979, 44586, 300])]
    got = S.pick_strata(spark.createDataFrame(rows, "t_performance_id long, product string, site string, performance_quota double, n_localidades int")).collect()
    assert len(got) == 5 and len({r.site for r in got}) == 5


def test_event_documents(spark):
    doc = {"t_performance_id": 7, "venue_name": "V", "localidades": [{"logical_seat_category": "A", "dn_quota": 10, "precio": 5.0}, {"dn_quota": 20, "med_base_unit_amt_itx": 6.0, "performance_quota": 99}]}
    flat = {"site": "W", "logical_seat_category": "B", "dn_quota": 3, "precio": 1.0}
    df = spark.createDataFrame([(json.dumps(doc),), (json.dumps(flat),)], "document string")
    got = sorted(values(io.event_rows(df), "t_performance_id", "site", "logical_seat_category", "dn_quota", "performance_quota", "med_base_unit_amt_itx"))
    assert got == [("0", "W", "B", 3.0, 3.0, 1.0), ("7", "V", "A", 10.0, 30.0, 5.0), ("7", "V", "GENERAL", 20.0, 99.0, 6.0)]


def test_replies(spark):
    df = spark.createDataFrame([('```json\n{"type_site": "TEATRO", "confianza": 1.5}\n```',), ('{"type_site": "X", "confianza": 0.9}',)], "r string")
    assert values(io.coerce_reply(df, "r", rules.VENUE_TYPES), "type_site", "confianza") == [("TEATRO", 0.99), ("desconocido", 0.5)]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    io.write_csv(df, f"{tmp_path}/t.csv")
    io.write_table(df, f"{tmp_path}/t.parquet")
    assert io.any_table(spark, f"{tmp_path}/t.csv").collect() == io.any_table(spark, f"{tmp_path}/t.parquet").collect() == df.collect()
    assert io.lookup_table(spark, f"{tmp_path}/none.csv").count() == 0
    assert io.stop_patterns(spark, None, f"{tmp_path}/none.csv") == T.STOP_PATTERNS
    with pytest.raises(ValueError):
        io.require_setting("k", "<key>")
