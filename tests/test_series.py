"""Hand-made fixtures, and no look-ahead: a series cut short gives the same rows as the whole one."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from seriesloom.functions.scans import with_ewm
from seriesloom.functions.windows import clip_high, clip_low
from seriesloom.operators import chains, portfolio, regimes


def series(spark, values, name="r", start=dt.date(2024, 1, 1)):
    days, d = [], start
    while len(days) < len(values):
        if d.weekday() < 5:
            days.append(d)
        d += dt.timedelta(days=1)
    return spark.createDataFrame([("s", i, day, v) for i, (day, v) in enumerate(zip(days, values, strict=True))], f"series_id string, seq int, dt date, {name} {'int' if name == 'state' else 'double'}")


def column(df, name):
    return [r[name] for r in df.orderBy("seq").collect()]


def test_constant_returns_give_constant_volatility(spark):
    got = column(regimes.volatility(series(spark, [0.01] * 50)), "vol")
    assert got == pytest.approx([math.log(1.01) * math.sqrt(252)] * 50, abs=1e-11)


def test_fold_equals_recursion_and_skips_nulls(spark):
    x = [None, 1.0, 4.0, None, 9.0]
    got = column(with_ewm(series(spark, x), "r", 0.9, "v"), "v")
    assert got == pytest.approx([None, 1.0, 1.3, 1.3, 2.07])


def test_matrix_by_hand(spark):
    got = regimes.transition_matrix(regimes.transition_counts(series(spark, [0, 0, 1, 1, 1, 0], "state"))).orderBy(F.desc("seq")).first()
    want = {"p00": 2 / 5, "p01": 2 / 5, "p02": 1 / 5, "p10": 2 / 6, "p11": 3 / 6, "p12": 1 / 6, "p20": 1 / 3, "p22": 1 / 3}
    assert {k: got[k] for k in want} == pytest.approx(want)


def test_future_variance_by_hand(spark):
    got = column(regimes.future_variance(regimes.volatility(series(spark, [0.0, 0.1, 0.0, 0.2, 0.0, 0.0])), 2), "future_x2")
    assert got[0] == pytest.approx(math.log(1.1) ** 2 / 2) and got[-2:] == [None, None]


def test_run_length_by_hand(spark):
    assert column(regimes.persistence(series(spark, [None, 1, 1, 2, 2, 2, 1], "state")), "run") == [None, 1, 2, 1, 2, 3, 1]


def test_order_test(spark):
    cyclic = chains.order_test(series(spark, [0, 1, 2] * 200, "state")).first()
    assert cyclic["lr"] == pytest.approx(0, abs=1e-9) and cyclic["p_value"] > 0.99
    two = chains.order_test(series(spark, [0, 0, 1, 1] * 300, "state")).first()
    assert two["lr"] > 100 and two["p_value"] < 1e-6


def test_survival_by_hand(spark):
    got = {(r["state"], r["k"]): r["share"] for r in chains.run_survival(series(spark, [0, 0, 0, 1, 1, 0, 0, 0, 0, 2], "state"), (2, 4)).collect()}
    assert got[0, 2] == 1.0 and got[0, 4] == 0.5 and got[1, 2] == 1.0
    geo = {(r["state"], r["k"]): r["share"] for r in chains.geometric_survival(series(spark, [0] * 5 + [1, 0, 1, 2, 2, 1], "state"), (1, 3)).collect()}
    assert geo[0, 1] == 1 and geo[0, 3] == pytest.approx(4 / 9)


def test_week_ends(spark):
    got = portfolio.period_ends(series(spark, [0.0] * 12), "week").where("is_end").select("dt").collect()
    assert sorted(r["dt"] for r in got) == [dt.date(2024, 1, 5), dt.date(2024, 1, 12)][: len(got)] and dt.date(2024, 1, 5) in {r["dt"] for r in got}


def targets(spark, returns, w, decide):
    rows = [("run", k, i, float(x), w[k], i in decide) for k in returns for i, x in enumerate(returns[k])]
    return spark.createDataFrame(rows, "run_id string, instrument string, seq int, r double, w double, decide boolean")


def test_orders_fill_a_day_later_and_cost(spark):
    got = portfolio.simulate(targets(spark, {"a": [0.01] * 10}, {"a": 0.5}, {5}), cash=0.0001, cost=0.001).orderBy("seq").collect()
    assert [r["ret"] for r in got[:6]] == pytest.approx([0.0001] * 6)
    assert got[6]["turnover"] == pytest.approx(0.5) and got[6]["ret"] == pytest.approx(0.0001 - 0.0005)
    assert got[7]["ret"] == pytest.approx(0.5 * 0.01 + 0.5 * 0.0001) and got[7]["exposure"] == pytest.approx(0.5)


def test_simulator_equals_the_day_by_day_loop(spark):
    rng = random.Random(3)
    n, names, cash, cost = 120, "abc", 0.0001, 0.0005
    returns = {k: [rng.gauss(0, 0.02) for _ in range(n)] for k in names}
    w, decide = {"a": 0.5, "b": 0.2, "c": 0.1}, {i for i in range(n) if rng.random() < 0.2}
    got = portfolio.simulate(targets(spark, returns, w, decide), cash, cost).orderBy("seq").collect()
    held, pending = dict.fromkeys(names, 0.0), False
    for i, row in enumerate(got):
        assert row["exposure"] == pytest.approx(sum(held.values()), abs=1e-12)
        gross = sum(held[k] * returns[k][i] for k in names) + (1 - sum(held.values())) * cash
        held = {k: held[k] * (1 + returns[k][i]) / (1 + gross) for k in names}
        turnover = sum(abs(w[k] - held[k]) for k in names) if pending else 0.0
        if pending:
            held = dict(w)
        assert (row["turnover"], row["ret"]) == pytest.approx((turnover, gross - cost * turnover), abs=1e-12)
        pending = i in decide


def test_clip_keeps_nulls(spark):
    row = spark.range(1).select(clip_low(F.lit(None).cast("double"), 1.0).alias("a"), clip_high(F.lit(None).cast("double"), 1.0).alias("b")).first()
    assert row["a"] is None and row["b"] is None


def test_no_look_ahead(spark):
    rng = random.Random(5)
    values = [rng.gauss(0, 0.02 if i // 60 % 2 else 0.006) for i in range(330)]

    def run(v):
        s = regimes.states(regimes.volatility(series(spark, v)), history=50)
        p = regimes.stress_probability(regimes.transition_matrix(regimes.transition_counts(s)))
        return [(r["vol"], r["state"], r["p_stress"]) for r in p.orderBy("seq").collect()]

    whole = run(values)
    assert whole[:250] == run(values[:250]) and whole[:250] == run(values[:250] + [0.5] * 20)[:250]
