"""Fits and recursions against plain numpy and pandas versions, and file sources on hand-made files."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import models, multiscale, regimes, strategies
from seriesloom.sources import files


def daily(spark, values):
    start = dt.date(1997, 1, 1)
    return spark.createDataFrame([("s", i, start + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)], "series_id string, seq int, dt date, r double")


def test_sectioned_returns_and_prices(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Note\n\nAverage Value Weighted Returns -- Daily\n,AAA,BBB\n20200102, 1.00,-99.99\n20200103,2.00, 0.50\n\nAverage Equal Weighted Returns -- Daily\n,AAA,BBB\n20200102,9.00,9.00\nCopyright\n")
    got = {(r["name"], r["dt"].day): r["r"] for r in files.sectioned_returns(spark, str(tmp_path / "a.csv")).collect()}
    assert got == {("AAA", 2): 0.01, ("BBB", 2): None, ("AAA", 3): 0.02, ("BBB", 3): 0.005}
    (tmp_path / "b.csv").write_text("<DATE>,<CLOSE>\n20200102,5.5\n")
    assert files.prices(spark, str(tmp_path / "b.csv")).first().asDict() == {"date": dt.date(2020, 1, 2), "close": 5.5}
    (tmp_path / "c.csv").write_text("Date,7Yr\n2020-01-02,1.50\n")
    assert files.yields(spark, str(tmp_path / "c.csv")).first()["7Yr"] == pytest.approx(0.015)


def test_har_equals_least_squares(spark):
    r = np.random.default_rng(4).normal(0, 0.01, 320)
    got = [x["f_har"] for x in multiscale.har(regimes.volatility(daily(spark, r)), least=100).orderBy("seq").collect()]
    x2 = pd.Series(np.log1p(r) ** 2)
    x = np.column_stack([np.ones(320), x2, x2.rolling(5).mean(), x2.rolling(22).mean()])
    y = x2.rolling(5).mean().shift(-5).to_numpy()
    for t in (150, 250, 319):
        use = slice(21, t - 4)
        want = x[t] @ np.linalg.lstsq(x[use] * 1e4, y[use] * 1e4, rcond=None)[0]
        assert got[t] == pytest.approx(max(want, 1e-10), rel=1e-6)
    assert got[100] is None


def test_adaptive_weights_equal_pandas(spark):
    rng = np.random.default_rng(2)
    loss = pd.DataFrame(rng.uniform(0, 1, (40, 3)))
    loss.iloc[:5, 1], loss.iloc[20:24, 2] = None, None
    rows = [(f"s#{k}", "s", k, i, None if pd.isna(loss.iloc[i, k]) else float(loss.iloc[i, k])) for i in range(40) for k in range(3)]
    df = spark.createDataFrame(rows, "series_id string, series string, scale int, seq int, loss double")
    got = multiscale.adaptive_weights(df, 3, 10.0, 0.9).toPandas().pivot(index="seq", columns="scale", values="weight")
    mean = loss.ewm(alpha=0.1, adjust=False, ignore_na=True).mean().shift(3).ffill()
    mean = mean.apply(lambda row: row.fillna(row.mean()), axis=1)
    e = np.exp(-10 * mean.sub(mean.min(axis=1), axis=0))
    want = e.div(e.sum(axis=1), axis=0).fillna(1 / 3)
    assert np.allclose(got.to_numpy(), want.to_numpy(), atol=1e-12)


def _losses_of_two_series(spark):
    rng = np.random.default_rng(6)
    known = rng.uniform(0, 1, (2, 30, 3))
    known[0, :4, 1], known[1, 10:14, 2], known[1, 20] = np.nan, np.nan, np.nan
    rows = [(f"{s}#{k}", s, k, i, None if np.isnan(known[j, i, k]) else float(known[j, i, k])) for j, s in enumerate("ab") for i in range(30) for k in range(3)]
    return spark.createDataFrame(rows, "series_id string, series string, scale int, seq int, loss double")


def test_pairs_of_rate_and_discount_weigh_as_each_alone(spark):
    df, rates, discounts = _losses_of_two_series(spark), (5.0, 20.0), (0.9, 0.99)
    got = multiscale.reweighted(df, rates, discounts, 3)
    assert sorted(got.columns) == sorted([*df.columns, "rate", "discount", "weight"])
    keys = ["series", "scale", "seq"]
    for rate in rates:
        for discount in discounts:
            own = got.where((F.col("rate") == rate) & (F.col("discount") == discount)).toPandas().sort_values(keys)
            alone = multiscale.adaptive_weights(df, 3, rate, discount).toPandas().sort_values(keys)
            assert own[keys].to_numpy().tolist() == alone[keys].to_numpy().tolist()
            assert np.allclose(own["weight"], alone["weight"], rtol=1e-12, atol=0)
    assert got.count() == 4 * df.count()


def test_further_rates_add_no_windows_and_no_pair_reads_the_losses_anew(spark):
    df = _losses_of_two_series(spark)

    def plan(rates, discounts):
        return multiscale.reweighted(df, rates, discounts, 3)._jdf.queryExecution().optimizedPlan().toString()

    one, four, all_nine = plan((5.0,), (0.9,)), plan((5.0, 10.0, 20.0, 40.0), (0.9,)), plan((5.0, 10.0, 20.0), (0.9, 0.95, 0.99))
    assert four.count("Window [") == one.count("Window [")
    assert all_nine.count("LogicalRDD") == one.count("LogicalRDD") == 1 and "Union" not in all_nine


def test_logistic_sees_no_future(spark):
    rng = np.random.default_rng(5)
    r = np.concatenate([rng.normal(0, 0.02 if i % 3 == 2 else 0.006, 60) for i in range(9)])

    def run(values):
        states = regimes.states(regimes.volatility(daily(spark, values)), history=50)
        return {x["seq"]: x["p_logistic"] for x in models.walk_forward_logistic(states, step=60, least=120).collect()}

    whole, cut = run(r), run(r[:400])
    assert cut and all(whole[k] == pytest.approx(cut[k], abs=1e-9) for k in cut) and all(0 <= p <= 1 for p in whole.values())


def test_hidden_states_see_no_future_and_find_the_wide_one(spark):
    rng = np.random.default_rng(3)
    wide = np.arange(900) // 90 % 3 == 2
    r = rng.normal(0, np.where(wide, 0.025, 0.005))
    run = lambda v: [x["p_hidden"] for x in models.walk_forward_hidden(daily(spark, v)).orderBy("seq").collect()]
    whole, cut = run(r), run(r[:800])
    assert whole[:800] == pytest.approx(cut, abs=1e-12)
    known = [(p, w) for p, w in zip(whole, wide, strict=True) if p is not None]
    assert np.mean([p for p, w in known if w]) > np.mean([p for p, w in known if not w]) + 0.2


def test_shifts_keep_the_signal_and_selection_breaks_ties(spark):
    days = spark.createDataFrame([(i, None if i < 2 else float(i)) for i in range(8)], "seq int, p_stress double")
    moved = strategies.cyclic_shifts(days, spark.createDataFrame([("s0", 0), ("s1", 2), ("s2", 4)], "run_id string, step long")).toPandas()
    own = moved[moved.run_id == "s0"].sort_values("seq").p_stress.tolist()
    assert own[2:] == [2.0, 3.0, 4.0, 5.0, 6.0, 7.0] and (moved.groupby("run_id").p_stress.sum() == 27).all() and len(moved) == 24
    table = spark.createDataFrame([("b", 1.0, 2.0), ("a", 0.99, 1.0), ("c", 0.5, 0.1)], "run_id string, sharpe double, turnover double")
    assert strategies.choose(table).select(F.col("run_id")).first()["run_id"] == "a"


def test_hidden_chain_equals_a_plain_recursion():
    rng = np.random.default_rng(0)
    x = rng.normal(0, np.where(np.arange(80) // 20 % 2, 0.02, 0.005))
    chain = models.Chain.guess(x)
    density = np.exp(-((x[:, None] - chain.mean) ** 2) / (2 * chain.var)) / np.sqrt(2 * np.pi * chain.var)
    ahead, back = [chain.first * density[0]], [np.ones(3)]
    for d in density[1:]:
        ahead.append(ahead[-1] @ chain.moves * d)
    for d in density[:0:-1]:
        back.append(chain.moves @ (d * back[-1]))
    ahead, back = np.array(ahead), np.array(back[::-1])
    whole = ahead[-1].sum()
    moved = sum(np.outer(ahead[t], density[t + 1] * back[t + 1]) * chain.moves / whole for t in range(len(x) - 1)) + 1e-6
    state = ahead * back / whole
    got, level = chain.improved(x)
    assert level == pytest.approx(np.log(whole)) and np.allclose(got.moves, moved / moved.sum(axis=1, keepdims=True))
    assert np.allclose(got.mean, x @ state / state.sum(axis=0)) and np.allclose(chain.filtered(x), ahead / ahead.sum(axis=1, keepdims=True))


def test_folds_fit_as_each_alone(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2)) * [1, 5] + [0, 3]
    y = (rng.uniform(size=400) < 1 / (1 + np.exp(0.5 - x[:, 0]))).astype(float)
    rows = spark.createDataFrame([(name, i, float(y[i]), float(x[i, 0]), float(x[i, 1])) for name in "st" for i in range(400)], "series_id string, seq int, y double, one double, two double")
    folds = spark.createDataFrame([("s", 0, 149), ("s", 1, 399), ("t", 0, 250)], "series_id string, fold long, upto long")
    got = {(r["series_id"], r["fold"]): r for r in models.fold_coefficients(rows, folds, ("one", "two")).collect()}
    for key, n in ((("s", 0), 150), (("s", 1), 400), (("t", 0), 251)):
        z = np.column_stack([np.ones(n), (x[:n] - x[:n].mean(axis=0)) / x[:n].std(axis=0)])
        b = np.zeros(3)
        for _ in range(20000):  # plain ascent on the penalised likelihood
            b += 0.01 * (z.T @ (y[:n] - 1 / (1 + np.exp(-z @ b))) - [0, *b[1:]])
        assert [got[key][f"b{i}"] for i in range(3)] == pytest.approx(b.tolist(), abs=1e-7)
        assert [got[key][f"m{i}"] for i in (1, 2)] == pytest.approx(x[:n].mean(axis=0).tolist())


def test_hidden_chain_in_blocks_equals_plain_fits(spark, monkeypatch):
    rng = np.random.default_rng(6)
    monkeypatch.setattr(models, "ROUNDS", 3)
    monkeypatch.setattr(models, "REFIT_ROWS", 100)
    rows = [(name, i, dt.date(1997, 9, 1) + dt.timedelta(days=i), None if i == 7 else float(v)) for name, n in (("a", 530), ("b", 170), ("c", 40)) for i, v in enumerate(rng.normal(0, np.where(np.arange(n) // 30 % 2, 0.02, 0.005)))]
    df = spark.createDataFrame(rows, "series_id string, seq int, dt date, r double")
    known = df.where("r is not null")
    # the limit on rounds is passed along: a fit ends after three here as there
    blocks = {(r["series_id"], r["seq"]): r["p_hidden"] for r in models.hidden_in_blocks(known, 64, 3).collect()}
    for name, part in known.toPandas().groupby("series_id"):
        want = models._hidden(part)
        assert [blocks[name, k] for k in want["seq"]] == [None if p is None else pytest.approx(p, abs=1e-9) for p in want["p_hidden"]]
    assert sum(p is not None for p in blocks.values()) > 400 and models.hidden_in_blocks(known.limit(0)).count() == 0
