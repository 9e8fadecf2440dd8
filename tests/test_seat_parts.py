"""Seat rows are dealt by their number."""

import math

from tribuna.plans import domain


def test_seat_rows_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(domain, "ROWS_A_TASK", 500)
    parts = domain.inventory(spark, "/root/testdata/sf0.001").select("t_performance_id", "performance_quota").rdd.getNumPartitions()
    assert parts == math.ceil(6000 / 500)
