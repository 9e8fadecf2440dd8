"""The pool of events is made once."""

from pyspark.sql import functions as F

from tribuna.operators import selection as S


def test_events_of_strata_are_summed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        seen.add(1)
        return x

    events = spark.createDataFrame([(i, f"p{i}", f"s{i}", float(30 * i + 10), 5) for i in range(6)], "t_performance_id long, product string, site string, performance_quota double, n_localidades long")
    events = events.withColumn("t_performance_id", counted("t_performance_id"))
    assert S.pick_strata(events, strata=(("a", 40), ("b", 80), ("c", None))).count() == 3
    assert seen.value == 6
