"""Discounted sums and order statistics against plain recursions and sorted prefixes."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesloom.functions import scans
from seriesloom.operators import regimes


def two_series(spark, values):
    """Series a as given, series b backwards."""
    rows = [(name, i, None if v is None else float(v)) for name, x in (("a", values), ("b", values[::-1])) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "series_id string, seq int, x double")


def by_name(df, *columns):
    got = df.toPandas().sort_values(["series_id", "seq"])
    return {name: part[list(columns)].to_numpy(float) for name, part in got.groupby("series_id")}


@pytest.mark.parametrize("decay", [0.2, 0.94])
def test_discounted_sums_over_many_blocks(spark, decay):
    rng = np.random.default_rng(1)
    values = [None if rng.uniform() < 0.1 else v for v in rng.normal(1, 5, 900)]
    values[:3] = [None] * 3
    values[400:] = [0.0] * 200 + values[600:]
    # with a decay of 0.2 a block has some 140 known rows
    for name, got in by_name(scans.with_ewm(two_series(spark, values), "x", decay, "v"), "v").items():
        x = pd.Series(values if name == "a" else values[::-1], dtype=float)
        want = x.ewm(alpha=1 - decay, adjust=False, ignore_na=True).mean()
        assert np.allclose(got[:, 0], want, rtol=1e-11, atol=1e-250, equal_nan=True)


@pytest.mark.parametrize("together", [1 << 20, 1])
def test_quantiles_of_prefixes(spark, together):
    rng = np.random.default_rng(2)
    values = [None if rng.uniform() < 0.1 else v for v in rng.integers(0, 60, 300)]  # ties
    got = by_name(scans.expanding_quantiles(two_series(spark, values), "x", {"p": 0.4, "q": 0.9, "top": 1.0}, 20, together=together), "p", "q", "top")
    for name, rows in got.items():
        x = pd.Series(values if name == "a" else values[::-1], dtype=float)
        want = np.column_stack([x.expanding(20).quantile(q) for q in (0.4, 0.9, 1.0)])
        assert np.allclose(rows, want, atol=1e-12, equal_nan=True)


def test_one_row_no_rows_and_no_values(spark):
    for together in (1 << 20, 0):
        run = lambda x: [r["q"] for r in scans.expanding_quantiles(spark.createDataFrame(x, "series_id string, seq int, x double"), "x", {"q": 0.5}, together=together).orderBy("seq").collect()]  # noqa: B023, E731
        assert run([]) == [] and run([("a", 0, 2.0)]) == [2.0] and run([("a", 0, None), ("a", 1, None)]) == [None, None]


def test_states_at_several_quantiles_are_the_states_at_each(spark):
    rng = np.random.default_rng(3)
    r = rng.normal(0, np.where(np.arange(400) // 50 % 2, 0.02, 0.005))
    vols = regimes.volatility(spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(r)], "series_id string, seq int, r double"))
    every = regimes.states_at(vols, (0.8, 0.9), history=60)
    for high in (0.8, 0.9):
        one = regimes.states(vols, high=high, history=60).select("seq", "low", "high", "state")
        assert one.exceptAll(every.where(F.col("series_id") == f"s#{high:.2f}").select("seq", "low", "high", "state")).isEmpty()
