"""The model as a stage of a pipeline: saved, loaded in another session, with its references."""

import warnings

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from tribuna.functions import text as T
from tribuna.operators import percentile as P
from tribuna.operators import relative as R
from tribuna.operators import stage as S
from tribuna.plans.q_venue import typed

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return T.with_text_features(P.type_percentile(R.relative_metrics(typed(spark, DIR)))).persist()


@pytest.fixture(scope="module")
def saved(rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("model") / "p")
    model = Pipeline(stages=[S.ArchetypeClusterer(k=4, textWeight=0.3)]).fit(rows)
    model.save(path)
    return model, path


def digest(df):
    return sorted(map(tuple, df.groupBy("arquetipo_demanda").agg(F.count("*"), F.sum(F.xxhash64("_row_id", "arquetipo_demanda", "cluster").cast("decimal(38,0)")), F.round(F.sum("score_confianza"), 6)).collect()))


def test_saved_and_loaded(spark, rows, saved):
    model, path = saved
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        loaded = PipelineModel.load(path)
    a, b = model.stages[0], loaded.stages[0]
    assert isinstance(b, S.ArchetypeModel) and b.fitted == a.fitted and b.uid == a.uid
    assert b.getOrDefault("k") == 4 and b.getOrDefault("textWeight") == 0.3
    assert digest(loaded.transform(rows)) == digest(model.transform(rows))
    for t in S.ArchetypeModel.TABLES:
        assert sorted(map(repr, getattr(b, t).select(sorted(getattr(b, t).columns)).collect())) == sorted(map(repr, getattr(a, t).select(sorted(getattr(a, t).columns)).collect()))


def test_references_of_a_loaded_model(rows, saved):
    stage = PipelineModel.load(saved[1]).stages[0]
    # rows without percentiles get them from the saved prices
    bare = rows.drop(S.PERCENTILE, "flag_cold_start_tipo")
    got = stage.transform(bare)
    want = P.percentile_of(bare, P.reference_prices(rows, S.PRICE), P.percentile_reference(rows, S.PRICE), S.PRICE)
    both = got.select("t_performance_id", "_row_id", F.col(S.PERCENTILE).alias("a")).join(want.select("t_performance_id", "_row_id", F.col(S.PERCENTILE).alias("b")), ["t_performance_id", "_row_id"])
    assert both.count() == rows.count() and both.where("abs(a - b) > 1e-9").count() == 0
    same = {r.variable: r for r in stage.drift(stage.transform(rows)).collect()}
    assert set(same) == {*S.MONITORED, "arquetipo_demanda"} and all(abs(r.psi) < 1e-9 and r.state == "ESTABLE" for r in same.values())
    moved = rows.withColumn("ratio_precio_max", F.col("ratio_precio_max") / 4)
    changed = {r.variable: r for r in stage.drift(stage.transform(moved)).collect()}
    assert changed["ratio_precio_max"].state == "ALERTA"


def test_versions_and_no_references(rows, tmp_path):
    model = S.ArchetypeClusterer(k=3, references=False).fit(rows)
    assert [r.state for r in model.drift(model.transform(rows)).collect()] == ["NO_REFERENCE"]
    model.version = "0"
    model.write().overwrite().save(str(tmp_path / "m"))
    with pytest.warns(UserWarning, match="version 0"):
        old = S.ArchetypeModel.load(str(tmp_path / "m"))
    assert old.histograms is None and old.fitted == model.fitted and old.version == "0"
    est = S.ArchetypeClusterer(k=7)
    est.write().overwrite().save(str(tmp_path / "e"))
    assert S.ArchetypeClusterer.load(str(tmp_path / "e")).getOrDefault("k") == 7
