"""Words of products are cut on counted rows."""

from tribuna.operators import phrases as X


def test_products_are_counted_before_words_are_cut(spark):
    rows = [("GIRA NACIONAL", e) for e in range(300)] + [("GIRA GIRA", 7), ("GIRA NACIONAL", 7), ("GIRA NACIONAL", None), ("GIRA GIRA", None)]
    df = spark.createDataFrame(rows, "product string, t_performance_id long")
    assert X._by_product(df, "product", "t_performance_id").count() == 5  # all lone events are one row
    got = {r["ngram"]: (r["frecuencia"], r["n_eventos"]) for r in X.phrase_candidates(df).collect()}
    assert got["GIRA"] == (301 + 2 * 2, 300) and got["NACIONAL"] == (301, 300) and got["GIRA GIRA"] == (2, 1)


def test_classes_with_events_of_several_products(spark):
    df = spark.createDataFrame([("Gira Mayo", 1), ("GIRA  MAYO", 1), ("Gira Mayo", 2), ("mayo MAYO", 2), ("Gira Mayo", None), ("gira mayo", None)], "product string, t_performance_id long")
    r = X.phrase_classes(df).first()
    assert (r["frecuencia"], r["n_eventos"], r["subsumidos"], r["ejemplo_producto"]) == (1 + 1 + 2 + 1, 2, 1, "GIRA MAYO | MAYO MAYO")
