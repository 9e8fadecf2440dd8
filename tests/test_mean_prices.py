"""Means do not depend on the order of their rows."""

from tribuna.operators import percentile as P


def test_equal_prices_have_equal_means_in_any_order(spark):
    prices = {"a": [0.1, 0.2, 0.3], "b": [0.3, 0.2, 0.1], "c": [0.2], "d": [None], "e": [1e300, None], "f": [1e-9, 3e-9], "g": [float("nan"), 1.0]}
    df = spark.createDataFrame([(s, "x", "t", p) for s, ps in prices.items() for p in ps], "site string, logical_seat_category string, type_site string, p double").coalesce(1)
    got = {r["site"]: r["mean_price"] for r in P.mean_prices(df, "p").collect()}
    assert got["a"] == got["b"] == got["c"] == 0.2 and got["d"] is None and got["e"] == 1e300
    assert abs(got["f"] - 2e-9) < 1e-24 and got["g"] != got["g"]
