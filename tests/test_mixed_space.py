"""mixed_space_long gives each seat row's whole vector."""

from pyspark.sql import functions as F

from tribuna.operators import space as S
from tribuna.plans.catalogue import QUERIES
from tribuna.plans.q_cluster import metrics

DIR = "/root/testdata/sf0.001"


def test_a_row_for_every_seat_row_and_dimension(spark):
    got, rows = QUERIES["mixed_space_long"](spark, DIR), metrics(spark, DIR)
    assert got.columns == ["t_performance_id", "_row_id", "dim", "value"]
    space = S.fit_space(rows)
    per = got.groupBy("dim").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).collect()
    assert {r["dim"] for r in per} == set(space.names) and {r["n"] for r in per} == {rows.count()}
    want = S.with_features(rows, space).agg(*[F.avg(F.col("features")[i]).alias(n) for i, n in enumerate(space.names)]).first()
    assert all(abs(r["mean"] - want[r["dim"]]) < 2e-6 for r in per)
    keys = ["t_performance_id", "_row_id"]
    one = S.with_features(rows, space).select(*keys, F.posexplode("features").alias("i", "x")).where("i < 4").select(*keys, F.array(*[F.lit(n) for n in space.names])[F.col("i")].alias("dim"), F.round("x", 6).alias("want"))
    assert got.join(one, [*keys, "dim"]).where("abs(value - want) > 1.5e-6").count() == 0
