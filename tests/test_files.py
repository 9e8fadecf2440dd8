"""Files, models and small functions that no query reaches."""

import json
import os
import warnings

import pytest
from pyspark.sql import functions as F

from tribuna.operators import cluster as K
from tribuna.operators import phrases as X
from tribuna.operators import quality as Q
from tribuna.operators.space import Space, align
from tribuna.sources import io


def test_lake_and_parts(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "i long, s string")
    df.repartition(2).write.parquet(str(tmp_path / "lake"))
    assert io.lake_table(spark, str(tmp_path / "lake")).count() == 2
    with pytest.raises(ValueError):
        io.lake_table(spark, str(tmp_path / "lake"), {"fs.key": "<your-key>"})
    df.where("i = 1").write.parquet(str(tmp_path / "many/x=1/part"))
    df.where("i = 2").write.parquet(str(tmp_path / "many/deep/er"))
    (tmp_path / "many/notes.txt").write_text("no table")
    assert sorted(r.i for r in io.parts_table(spark, str(tmp_path / "many")).collect()) == [1, 2]
    with pytest.raises(Exception):
        io.parts_table(spark, str(tmp_path / "none")).count()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "i long, s string")
    for _ in range(2):  # written over
        io.write_table(df, str(tmp_path / "t"))
        io.write_csv(df, str(tmp_path / "c"))
        io.write_report(df, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    assert {(r.i, r.s) for r in spark.read.csv(str(tmp_path / "c"), header=True).collect()} == {("1", "a,b"), ("2", None)}
    assert len([f for f in os.listdir(tmp_path / "r") if f.startswith("part")]) == 1
    assert io.append_audit(df, str(tmp_path / "a")) and io.append_audit(df.limit(1), str(tmp_path / "a"))
    assert spark.read.json(str(tmp_path / "a")).count() == 3
    (tmp_path / "file").write_text("x")
    with pytest.warns(UserWarning, match="audit log"):
        assert not io.append_audit(df, str(tmp_path / "file" / "under"))


def test_model_round_trip(spark, tmp_path):
    space = Space(centers={"a": 1.0}, scales={"a": 2.0}, idf={"palco": 1.5, "norte": 1.1})
    model = K.Model(space, [[0.0, 1.0], [2.0, 3.0]], ["x", "y"], [0.5, 0.5], [[0.0, 1.0], [2.0, 3.0]], [[1.0, 1.0], [1.0, 2.0]])
    io.save_model(spark, model, str(tmp_path / "m"))
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert io.load_model(spark, str(tmp_path / "m")) == model
    with pytest.warns(UserWarning, match="version 1, not 2"):
        io.load_model(spark, str(tmp_path / "m"), "2")
    assert io.model_vocabulary(model, ["VIP"]) == ["NORTE", "PALCO", "VIP"] and io.model_vocabulary(None) == []


def test_names_by_rank(spark):
    rows = [(0, 0.9, 1.0, 0.0, 0.0, 0.2), (1, 0.1, 0.0, 1.0, 1.0, 0.9), (2, 0.2, 0.0, 0.0, 0.0, 0.8), (3, 0.2, 0.0, 0.0, 0.0, 0.5), (4, 0.2, 0.0, 0.0, 0.0, 0.1), (-1, 1.0, 0.0, 0.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "cluster int, peso_aforo double, tag_general double, tag_palco double, tag_vip double, ratio_precio_max double")
    got = {r.cluster: r.arquetipo_demanda for r in K.name_by_rank(df).collect()}
    assert got == {0: "Grada General / Masiva", 1: "VIP / Palcos / Premium", 2: "Preferencial / Platea Frontal", 3: "Platea General / Intermedia", 4: "Popular / Balcón / Visibilidad Parcial", -1: K.SINGLE}
    four = {r.cluster: r.arquetipo_demanda for r in K.name_by_rank(df.where("cluster <> 3")).collect()}
    assert four[4] == "Popular / Visibilidad Parcial / Balcón"


def test_align_and_domain(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "v array<double>")
    assert df.select(align(F.col("v"), ["a", "b", "c"], ["c", "z", "a"]).alias("x")).first().x == [3.0, 0.0, 1.0]
    types = spark.createDataFrame([("A",), ("B",)], "t string")
    assert Q.valid_domain(types, "t", ["A", "B"]).count() == 2
    with pytest.raises(ValueError, match="'B'"):
        Q.valid_domain(types, "t", ["A"])


def test_phrases_keep_what_is_no_tag_word():
    words = X.forbidden_words(["extra"])
    assert "PRIMERA" not in words and "PRIMER" in words and {"FILA", "SILLA", "MESAS", "BOGOTA", "MAYO", "DIR", "EXTRA"} <= set(words)


def test_names_of_tests_are_unique():
    """Test files of one name in two folders are not both collected."""
    here = os.path.dirname(os.path.abspath(__file__))
    names = [f for _, _, files in os.walk(here) for f in files if f.endswith(".py")]
    assert len(names) == len(set(names)), json.dumps(sorted(names))
