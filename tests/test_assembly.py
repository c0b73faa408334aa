"""Irregular sources on one calendar, by hand."""

import datetime as dt

import pytest

from seriesloom.functions.bonds import bond_returns
from seriesloom.sources import assembly


def day(n):
    return dt.date(2024, 1, n)


def test_last_known_values_go_stale(spark):
    calendar = spark.createDataFrame([(day(n), n) for n in (2, 3, 8, 9)], "dt date, k int")
    a = spark.createDataFrame([(day(1), 1.0), (day(3), 3.0), (day(5), None), (None, 9.0)], "dt date, value double")
    b = spark.createDataFrame([(day(8), 8.0)], "dt date, value double")
    got = [tuple(r) for r in assembly.as_of_all(calendar, {"a": a, "b": b}, 5).orderBy("dt").collect()]
    assert got == [(day(2), 2, 1.0, None), (day(3), 3, 3.0, None), (day(8), 8, 3.0, 8.0), (day(9), 9, None, 8.0)]
    assert assembly.as_of_all(calendar.limit(0), {"a": a}).count() == 0


def test_assembly_by_hand(spark):
    factors = spark.createDataFrame([(day(n), name, r) for n, o in ((2, 0.01), (3, -0.02), (4, 0.0)) for name, r in (("RF", 0.001), ("Mkt-RF", o))], "dt date, name string, r double")
    sectors = spark.createDataFrame([(day(2), "S", 0.5), (day(9), "S", 0.7)], "dt date, name string, r double")
    yields = spark.createDataFrame([(day(1), 0.03), (day(3), 0.031)], "dt date, value double")
    prices = spark.createDataFrame([(day(2), 100.0), (day(4), 110.0)], "dt date, value double")
    got = {(r["dt"].day, r["name"]): r["r"] for r in assembly.assemble(factors, sectors, yields, prices, day(3)).collect()}
    assert len(got) == 9 and got[2, "Mkt"] == pytest.approx(0.011) and got[3, "Mkt"] == pytest.approx(-0.019) and got[2, "S"] == 0.5
    assert got[2, "Bond"] is None and got[2, "Gold"] is None and got[3, "Gold"] == 0.0
    want = bond_returns(spark.createDataFrame([("s", 0, day(2), 0.03), ("s", 1, day(3), 0.031)], "series_id string, seq int, dt date, y double")).first()["r"]
    assert got[3, "Bond"] == pytest.approx(want)
