"""Parameter grids, selection, costs and placebo runs: every run is a partition of one simulation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import portfolio

#: Fixed values of the grid: multipliers and reactions to stress.
MULTIPLIERS, REACTIONS = (0.8, 1.0, 1.2), (0.25, 0.50)
WARM_UP, BAND = 504, 0.02


def grid(spark: SparkSession) -> DataFrame:
    """(run_id, m, react): six rows, whatever the data."""
    cells = [(m, react) for m in MULTIPLIERS for react in REACTIONS]
    return spark.createDataFrame([(f"c{i}", m, react) for i, (m, react) in enumerate(cells)], "run_id string, m double, react double")


def signal_days(core: DataFrame, signal: DataFrame, warm_up: int = WARM_UP) -> DataFrame:
    """(seq, dt, core_vol, p_stress, reference, decide) by day; the reference is the median volatility of the warm-up, one number."""
    reference = core.where(F.col("seq").between(portfolio.CORE_DAYS - 1, warm_up - 1)).agg(F.median("core_vol").alias("reference"))
    days = portfolio.period_ends(core.withColumn("series_id", F.lit("core")), "week").withColumn("decide", F.col("is_end") & (F.col("seq") >= warm_up))
    return days.join(signal.select("dt", "p_stress"), "dt", "left").crossJoin(F.broadcast(reference)).drop("series_id", "is_end")


def run_levels(days: DataFrame, runs: DataFrame) -> DataFrame:
    """days for each of runs (run_id, m, react), with the level of exposure: days has one row a seq, or one for each run_id and seq. runs is a parameter table of few rows."""
    return portfolio.exposure(days.join(runs, "run_id") if "run_id" in days.columns else days.crossJoin(F.broadcast(runs)))


def choose(table: DataFrame, keys: tuple[str, ...] = (), band: float = BAND) -> DataFrame:
    """One run for each key: of those within `band` of the best Sharpe ratio the one with the least turnover; ties by run_id."""
    near = table.withColumn("best", F.max("sharpe").over(Window.partitionBy(*keys))).where(F.col("sharpe") >= F.col("best") - band)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("turnover", "run_id"))
    return near.withColumn("place", place).where("place = 1").drop("place", "best")


def at_costs(days: DataFrame, costs: tuple[float, ...], paid: float = portfolio.COST) -> DataFrame:
    """Simulated days again at other costs: trading doesn't depend on the cost, so no run is repeated."""
    each = days.withColumn("cost", F.explode(F.array(*(F.lit(c) for c in costs))))
    return each.withColumn("ret", F.col("ret") + (F.lit(paid) - F.col("cost")) * F.col("turnover"))


def cyclic_shifts(days: DataFrame, steps: DataFrame) -> DataFrame:
    """days once for each of steps (run_id, step), with p_stress moved round its known rows by that many."""
    known = days.where("p_stress is not null").withColumn("ord", F.row_number().over(Window.orderBy("seq")) - 1)
    size = known.agg(F.count(F.lit(1)).alias("n"))
    each = known.select("ord", "p_stress").crossJoin(F.broadcast(size)).crossJoin(F.broadcast(steps))
    moved = each.select("run_id", F.pmod(F.col("ord") + F.col("step"), "n").alias("ord"), "p_stress")
    placed = known.drop("p_stress").join(moved, "ord").drop("ord")
    rest = days.where("p_stress is null").crossJoin(F.broadcast(steps.select("run_id")))
    return placed.unionByName(rest)
