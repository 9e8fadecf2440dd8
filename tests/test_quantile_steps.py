"""Wanted quantiles are found by counting."""

import random

import pytest

from tribuna.operators import ranks


@pytest.mark.parametrize("values", [[1.0], [2.0, 2.0, 2.0], [1.0, 1e300, -1e300, 5.0], [0.1 * i for i in range(1000)], [float("inf"), 1.0, float("-inf"), 2.0], [float("nan"), 3.0, 4.0, 4.0]])
def test_wanted_quantiles_are_those_of_all_positions(spark, values):
    df = spark.createDataFrame([(g, v) for g in ("a", None) for v in values] + [("a", None)], "g string, v double")
    some = {(r["g"], r["i"]): (r["n"], str(r["q"])) for r in ranks.quantiles(df, ["g"], "v", 4, (1, 2, 3)).collect()}
    every = {(r["g"], r["i"]): (r["n"], str(r["q"])) for r in ranks.quantiles(df, ["g"], "v", 4).collect() if r["i"] in (1, 2, 3)}
    assert some == every and len(some) == 6


def test_few_values_are_sorted_for_a_median(spark, monkeypatch):
    seen, whole = [], ranks.positions
    monkeypatch.setattr(ranks, "positions", lambda df, *a, **k: seen.append(df.count()) or whole(df, *a, **k))
    rnd = random.Random(1)
    values = sorted(rnd.random() for _ in range(20_001))
    got = ranks.quantiles(spark.createDataFrame([(v,) for v in values], "v double"), [], "v", 2, (1,)).first()["q"]
    assert got == values[10_000] and seen[0] < 100
