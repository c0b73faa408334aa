"""The side-by-side simulator, the bootstrap by blocks, selection by years, verdicts, and results that are written once."""

import concurrent.futures
import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import inference, portfolio, strategies, study
from seriesloom.sources import results


def panel(spark, days=160):
    """Three instruments whose returns are waves of different length, and equal weights from day 6 on."""
    first = datetime.date(2010, 1, 4)
    move = lambda i, t: 0.001 * (i + 1) * math.sin(t * (1.7 + i)) + 0.0002 * ((t * 7 + i) % 5 - 2)
    return spark.createDataFrame([(str(i + 1), t, first + datetime.timedelta(t), move(i, t), 1 / 3 if t > 5 else None) for t in range(days) for i in range(3)], "instrument string, seq int, dt date, r double, w double")


def levels(spark, days=160):
    rows = [(f"x{k}", t, None if t == 40 else 0.2 + 0.1 * k + 0.001 * t, t % 7 == k) for k in range(5) for t in range(days)]
    return spark.createDataFrame(rows, "run_id string, seq int, level double, decide boolean")


def test_levels_simulate_as_targets_do(spark):
    p, lv = panel(spark), levels(spark)
    scaled = p.join(lv, "seq").select("run_id", "instrument", "seq", "r", (F.col("w") * F.col("level")).alias("w"), "decide")
    one = portfolio.simulate(scaled).toPandas().sort_values(["run_id", "seq"]).reset_index(drop=True)
    two = portfolio.simulate_levels(p, lv).toPandas().sort_values(["run_id", "seq"]).reset_index(drop=True)
    assert len(one) == len(two) == 800
    for c in ("ret", "turnover", "exposure"):
        assert np.allclose(one[c], two[c], atol=1e-12)


def test_equal_exposure_meets_its_target(spark):
    p = panel(spark)
    days = spark.createDataFrame([(t, 0.1, 0.1 + 0.0005 * t, t % 5 == 0 and t > 10) for t in range(160)], "seq int, reference double, core_vol double, decide boolean")
    targets = spark.createDataFrame([("a", 0.4), ("b", 0.25)], "strategy string, target double")
    found = study.equal_exposures(p, days, targets, first=20, parts=8, rounds=4).collect()
    runs = spark.createDataFrame([(x["strategy"], x["m"], 0.0) for x in found], "run_id string, m double, react double")
    got = study.window(portfolio.simulate_levels(p, strategies.run_levels(days.withColumn("p_stress", F.lit(0.0)), runs)), 20).groupBy("run_id").agg(F.avg("exposure").alias("x")).collect()
    assert {x["run_id"]: x["x"] for x in got} == pytest.approx({"a": 0.4, "b": 0.25}, abs=1e-6)


def test_blocks_draw_as_rows_do(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, *map(float, rng.normal(0, 0.01, 2))) for i in range(90)], "seq int, a double, b double")
    want = {r["measure"]: r for r in inference.paired_bootstrap(df, 150).collect()}
    got = {r["measure"]: r for r in inference.bootstrap_against(df, "a", ["b"], 150).collect()}
    for measure, r in want.items():
        assert all(got[measure][c] == pytest.approx(r[c], abs=1e-10) for c in ("point", "low", "high", "share_below"))


def test_power_grows_with_the_difference(spark):
    rng = np.random.default_rng(6)
    b = rng.normal(0.0003, 0.01, 300)
    df = spark.createDataFrame([(i, float(x + e), float(x)) for i, (x, e) in enumerate(zip(b, rng.normal(0, 0.001, 300), strict=True))], "seq int, a double, b double")
    got = {r["delta"]: r for r in inference.power_study(df, (0.0, 2.0), 12, 60, 200).collect()}
    assert got[2.0]["power"] > 0.9 and got[0.0]["power"] < 0.5 and got[2.0]["share_positive"] == 1.0


def test_missing_return_in_the_window_is_an_error(spark, monkeypatch):
    df = spark.createDataFrame([("1", 0, None), ("1", 1, 0.1), ("1", 2, None)], "instrument string, seq int, r double")
    assert study.complete(df.where("seq < 2"), 1).count() == 2
    with pytest.raises(Exception, match="missing return"):
        study.complete(df, 1).collect()
    # and in a registered query
    from seriesloom import catalogue
    from seriesloom.sources import tables

    whole = tables.panel
    monkeypatch.setattr(tables, "panel", lambda *a: whole(*a).withColumn("r", F.when((F.col("seq") != 600) | (F.col("instrument") != "3"), F.col("r"))))
    with pytest.raises(Exception, match="missing return in the evaluation window: 3, day 600"):
        catalogue.QUERIES["full_grid"](spark, "/root/testdata/sf0.001").collect()


def test_expected_maximum_and_verdicts(spark):
    assert study.expected_max_sharpe(1, 0.1) == 0
    assert study.expected_max_sharpe(100, 1.0) == pytest.approx(2.53, abs=0.02)
    names = ["drawdown", "sharpe", "least_drawdown", "best_sharpe", "low", "point", "at_cost", "before", "after"]
    rows = [(-0.1, 1.0, -0.2, 0.9, 0.1, 0.2, 0.1, 0.1, 0.1), (-0.3, 1.0, -0.2, 0.9, -0.1, 0.2, 0.1, 0.1, 0.1), (-0.1, 0.8, -0.2, 0.9, -0.3, -0.1, 0.1, 0.1, 0.1), (-0.1, 1.0, -0.2, 0.9, 0.1, 0.2, 0.1, -0.1, 0.1)]
    got = study.verdict(spark.createDataFrame(rows, names)).collect()
    assert [(r["level_1"], r["level_2"]) for r in got] == [(True, "evidence"), (False, "weak"), (False, "none"), (True, "none")]


def test_a_year_is_chosen_by_the_years_before_it(spark):
    rows = [(run, i, datetime.date(2000 + i // 50, 1, 1) + datetime.timedelta(i % 50), float(mean + 0.01 * ((i % 2) - 0.5)), 0.1) for run, mean in (("a", 0.001), ("b", 0.002)) for i in range(150)]
    rows = [(*r[:3], -r[3] if r[0] == "b" and r[1] >= 50 else r[3], r[4]) for r in rows]
    got = study.yearly_choice(spark.createDataFrame(rows, "run_id string, seq int, dt date, ret double, turnover double"), 2001, 2003).collect()
    assert {r["year"]: r["run_id"] for r in got} == {2001: "b", 2002: "a", 2003: "a"}


def test_results_are_written_once(spark, tmp_path):
    base = f"file://{tmp_path}"
    table = spark.createDataFrame([("multi", 0.9, None), ("vol", float("nan"), 0.8)], "strategy string, q double, m double")
    for kind in results.FORMATS:
        results.write_table(table.where("strategy = 'multi'"), f"{base}/{kind}", kind)
        assert [tuple(r) for r in results.read_table(spark, f"{base}/{kind}", table.schema, kind).collect()] == [("multi", 0.9, None)]
        with pytest.raises(Exception, match="(?i)exists"):
            results.write_table(table, f"{base}/{kind}", kind)
    assert sorted(r["config"] for r in results.chosen_as_json(table, ["q", "m"]).collect()) == ['{"q":0.9,"m":null}', '{"q":null,"m":0.8}']
    with pytest.raises(FileNotFoundError):
        results.guard(spark, {}, f"{base}/frozen", f"{base}/record")
    results.freeze(spark, {"m": 0.8, "q": None}, f"{base}/frozen")
    with pytest.raises(FileExistsError):
        results.freeze(spark, {}, f"{base}/frozen")
    with pytest.raises(ValueError, match="frozen"):
        results.guard(spark, {"m": 1.0}, f"{base}/frozen", f"{base}/record")
    results.guard(spark, {"m": 0.8, "q": None}, f"{base}/frozen", f"{base}/record")
    results.record(spark, ["one", "two"], f"{base}/record")
    with pytest.raises(FileExistsError):
        results.guard(spark, {"m": 0.8, "q": None}, f"{base}/frozen", f"{base}/record")
    with pytest.raises(FileNotFoundError, match="absent"):
        results.require(spark, [f"{base}/absent", f"{base}/record"])


def test_of_sessions_that_write_at_once_one_wins(spark, tmp_path):
    base = f"file://{tmp_path}/deep"
    with results.claimed(spark, f"{base}/frozen"):
        for write in (lambda: results.freeze(spark, {}, f"{base}/frozen"), lambda: results.record(spark, [], f"{base}/frozen")):
            with pytest.raises(FileExistsError, match="another session"):
                write()
    threads = 6

    def tried(i):
        try:
            results.freeze(spark.newSession(), {"m": i}, f"{base}/frozen")
        except FileExistsError:
            return None
        return i

    with concurrent.futures.ThreadPoolExecutor(threads) as pool:
        won = [i for i in pool.map(tried, range(threads)) if i is not None]
    assert len(won) == 1 and results.frozen(spark, f"{base}/frozen") == {"m": won[0]}


def test_normal_inverse_and_charts(spark):
    from statistics import NormalDist

    from seriesloom.functions.normal import normal_inverse
    from seriesloom.operators import charts

    p = [1e-9, 0.025, 0.5, 0.8, 1 - 1 / 192, 1 - 1e-12]
    got = spark.createDataFrame([(x,) for x in [*p, 0.0, 1.0, None]], "p double").select(normal_inverse(F.col("p")).alias("z")).collect()
    assert [r["z"] for r in got[:-1]][: len(p) - 1] == pytest.approx([NormalDist().inv_cdf(x) for x in p[:-1]], abs=1e-6) and [r["z"] for r in got[len(p) :]] == [None] * 3
    points = spark.createDataFrame([("a", i, None if i == 3 else float((i * 7) % 10)) for i in range(10)], "name string, seq int, value double")
    rows = [tuple(r) for r in charts.reduced(points, ("name",), 2).orderBy("bucket").collect()]
    assert rows == [("a", 0, 0.0, 0.0, 8.0, 8.0), ("a", 1, 5.0, 2.0, 9.0, 3.0)]
