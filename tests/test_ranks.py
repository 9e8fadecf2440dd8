"""Distributed ranks and percentiles against sorting."""

import random

import numpy as np
import pytest

from tribuna.operators import ranks


def data(kind):
    rnd = random.Random(kind)
    rows = [("a", rnd.choice([1.0, 2.0, 2.0, 7.5])) for _ in range(400)] + [("b", rnd.gauss(0, 1)) for _ in range(301)] + [(None, float(rnd.randrange(20))) for _ in range(57)]
    rows += [("one", 3.0), ("two", 1.0), ("two", 2.0), ("same", 4.0), ("same", 4.0), ("none", None), ("b", None)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("n_ranges", [1, 3, 16])
def test_positions(spark, n_ranges):
    rows = data(n_ranges)
    got = {(r.g, r.v): (r.k, r.below, r.n) for r in ranks.positions(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", ranges=n_ranges).collect()}
    want = {}
    for g, v in rows:
        own = [x for h, x in rows if h == g and x is not None]
        if v is not None:
            want[(g, v)] = (own.count(v), sum(x < v for x in own), len(own))
    assert got == want


@pytest.mark.parametrize("parts,wanted", [(100, None), (200, [199, 0, 200, 1]), (4, [1, 2, 3]), (7, None)])
def test_quantiles(spark, parts, wanted):
    rows = data(parts)
    got = {(r.g, r.i): (r.n, r.q) for r in ranks.quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", parts, wanted).collect()}
    want = {}
    for g in {g for g, v in rows if v is not None}:
        own = np.array([x for h, x in rows if h == g and x is not None])
        for i in wanted or range(parts + 1):
            want[(g, i)] = (len(own), np.quantile(own, i / parts))
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_global_rank_and_empty(spark):
    df = spark.createDataFrame([("b",), ("a",), ("é",), ("b",), ("Z",), (None,)], "s string")
    assert {r.s: r.rank for r in ranks.global_rank(df, "s").collect()} == {"Z": 1, "a": 2, "b": 3, "é": 4}
    assert ranks.global_rank(df.limit(0), "s").collect() == [] and ranks.quantiles(df.limit(0).selectExpr("s", "1.0D AS v"), ["s"], "v").collect() == []


def test_no_group_in_one_task(spark):
    """The window's partitioning names the range before the group."""
    df = spark.range(1000).selectExpr("'a' AS g", "CAST(id AS DOUBLE) AS v")
    plan = ranks.positions(df, ["g"], "v", ranges=5)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_range" in plan and "SinglePartition" not in plan and "hashpartitioning(g" not in plan
