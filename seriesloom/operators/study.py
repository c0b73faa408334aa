"""All strategies of a study as runs of one simulation, and what is said about their results."""

from __future__ import annotations

import math
from datetime import date
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normal import normal_inverse
from ..functions.windows import by_series
from ..sources.shared import kept
from . import portfolio, strategies

#: The bond-and-market mix, bounds of the equal-exposure multiplier and the constant of the expected maximum.
MARKET, BOND, MIX = "2", "4", 0.6
LEAST_M, MOST_M, EULER = 0.05, 3.0, 0.5772156649015329


def complete(panel: DataFrame, first: int = strategies.WARM_UP) -> DataFrame:
    """The panel, to be simulated: a missing return from seq `first` on is an error, raised as it is met."""
    missing = F.raise_error(F.concat(F.lit("missing return in the evaluation window: "), F.col("instrument"), F.lit(", day "), F.col("seq").cast("string"))).cast("double")
    return panel.withColumn("r", F.when(F.col("r").isNull() & (F.col("seq") >= first), missing).otherwise(F.col("r")))


def window(df: DataFrame, first: int = strategies.WARM_UP) -> DataFrame:
    """The rows of the evaluation: from seq `first` on."""
    return df.where(F.col("seq") >= first)


def strategy_table(spark: SparkSession, runs: list[tuple[str, str, float, float]], targets: DataFrame) -> DataFrame:
    """(run_id, signal, m, react, fixed) of all strategies: runs (run_id, signal, m, react), signal 'none' for a chance of 0; the fixed ones; and, by
    targets (m, target) of one row, volatility targeting and a constant level of the same mean exposure."""
    schema = "run_id string, signal string, m double, react double, fixed double"
    plain = spark.createDataFrame([(*x, None) for x in runs] + [(name, "none", 0.0, 0.0, 1.0) for name in ("static", "trend", "market", "60_40")], schema)
    number = lambda x, name: F.lit(x).cast("double").alias(name) if not isinstance(x, str) else F.col(x).alias(name)
    row = lambda name, m, fixed: F.struct(F.lit(name).alias("run_id"), F.lit("none").alias("signal"), number(m, "m"), number(0.0, "react"), number(fixed, "fixed"))
    found = targets.select(F.explode_outer(F.array(row("vol_target_equal", "m", None), row("constant", 0.0, "target"))).alias("x"))
    return plain.unionByName(found.select("x.*"))


def all_targets(weighted: DataFrame, days: DataFrame, signals: DataFrame, table: DataFrame, first: int = strategies.WARM_UP, n: int = portfolio.TREND_DAYS) -> DataFrame:
    """Targets of all strategies of strategy_table() in one pass over the days: runs differ by expressions only.

    signals: (signal, dt, p_stress). static: the core in full. trend: core weights of the instruments above their mean price, the rest in
    cash. market: one order on the first day of the evaluation. 60_40: monthly orders from then on.
    """
    months = portfolio.period_ends(days.withColumn("series_id", F.lit("core")), "month").withColumn("month_end", F.col("is_end") & (F.col("seq") >= first)).drop("series_id", "is_end")
    each = months.crossJoin(F.broadcast(table)).join(signals, ["signal", "dt"], "left")
    levels = portfolio.exposure(each.withColumn("p_stress", F.when(F.col("signal") == "none", 0.0).otherwise(F.col("p_stress"))))
    order = F.when(F.col("run_id") == "market", F.col("seq") == first).when(F.col("run_id") == "60_40", F.col("month_end")).otherwise(F.col("decide"))
    levels = levels.select("run_id", "seq", F.coalesce("fixed", "level").alias("level"), order.alias("decide"))
    rows = portfolio.day_table(weighted, n).join(levels, "seq")
    scaled = F.transform("w", lambda x: x * F.col("level"))
    rule = lambda f: F.transform("names", f)
    target = F.when(F.col("run_id") == "market", rule(lambda x: (x == MARKET).cast("double"))).when(F.col("run_id") == "60_40", rule(lambda x: F.when(x == MARKET, MIX).when(x == BOND, 1 - MIX).otherwise(0.0)))
    target = target.when(F.col("run_id") == "trend", F.zip_with("w", "above", lambda w, up: w * up)).otherwise(scaled)
    return rows.select("run_id", "seq", target.alias("target"), "decide", "g", "g0")


def equal_exposures(weighted: DataFrame, days: DataFrame, targets: DataFrame, first: int = strategies.WARM_UP, parts: int = 32, rounds: int = 5) -> DataFrame:
    """(strategy, m, target): for each of targets (strategy, target) the multiplier of volatility targeting whose mean exposure in the evaluation is the target.

    Each round simulates `parts` multipliers inside every strategy's bracket, all as runs of one simulation, and narrows all brackets to
    the two neighbours of their target; the last two are joined by a line. Days and brackets are tables in the shared folder, so a round's plan is as
    short as the first one's and nothing comes to the driver. targets is a parameter table of few rows.
    """
    rows = portfolio.day_table(weighted).join(days.select("seq", "decide", (F.col("reference") / F.col("core_vol")).alias("unit")), "seq").select("seq", "w", "g", "g0", "decide", "unit")
    rows = kept(rows, "days")
    nothing = F.lit(None).cast("double")
    bracket = kept(targets, "targets").select("strategy", "target", F.lit(LEAST_M).alias("low"), F.lit(MOST_M).alias("high"), nothing.alias("under"), nothing.alias("over"))
    # a bracket travels with the runs that it makes
    held = ("strategy", "target", "low", "high", "under", "over")
    step = (F.col("high") - F.col("low")) / (parts + 1)
    for _ in range(rounds):
        tried = bracket.withColumn("part", F.explode(F.sequence(F.lit(1), F.lit(parts))))
        each = rows.crossJoin(F.broadcast(tried))
        level = F.when(F.col("unit").isNotNull(), F.least((F.col("low") + step * F.col("part")) * F.col("unit"), F.lit(1.0)))
        run = each.withColumn("level", level).withColumn("sought", F.col("target")).withColumn("target", F.transform("w", lambda x: x * F.col("level")))
        keys = tuple("sought" if c == "target" else c for c in held)
        means = window(portfolio.filled_orders(run, keys=(*keys, "part")), first).groupBy(*keys, "part").agg(F.avg("exposure").alias("mean"))
        below = F.col("mean") <= F.col("sought")
        found = means.groupBy(*keys).agg(F.count_if(below).alias("n"), F.max(F.when(below, F.col("mean"))).alias("new_under"), F.min(F.when(~below, F.col("mean"))).alias("new_over"))
        found = found.select("strategy", F.col("sought").alias("target"), (F.col("low") + step * F.col("n")).alias("low"), (F.col("low") + step * (F.col("n") + 1)).alias("high"), F.coalesce("new_under", "under").alias("under"), F.coalesce("new_over", "over").alias("over"))
        bracket = kept(found, "bracket")
    share = F.coalesce(F.try_divide(F.col("target") - F.col("under"), F.col("over") - F.col("under")), F.lit(0.5))
    return bracket.select("strategy", (F.col("low") + (F.col("high") - F.col("low")) * share).alias("m"), "target")


def sharpe(x):
    """Yearly Sharpe ratio of excess returns, as an aggregate."""
    return F.try_divide(F.avg(x), F.stddev_samp(x)) * F.sqrt(F.lit(252))


def subperiods(days: DataFrame, split: date, cash: float = portfolio.CASH) -> DataFrame:
    """(run_id, part, sharpe): before the split and from it on."""
    part = F.when(F.col("dt") < F.lit(split), "before").otherwise("after")
    return days.groupBy("run_id", part.alias("part")).agg(sharpe(F.col("ret") - cash).alias("sharpe"))


def expected_max_sharpe(trials: int, variance: float) -> float:
    """Of that many independent trials whose true ratio is 0; daily, as the variance is."""
    if trials <= 1:
        return 0.0
    inverse = NormalDist().inv_cdf
    return math.sqrt(variance) * ((1 - EULER) * inverse(1 - 1 / trials) + EULER * inverse(1 - 1 / (trials * math.e)))


def expected_max_factor(trials: int) -> float:
    """expected_max_sharpe for a variance of 1."""
    return expected_max_sharpe(trials, 1.0)


def expected_max(trials: Column) -> Column:
    """expected_max_sharpe() of a variance of 1, for a column of trials."""
    n = trials.cast("double")
    high = (1 - EULER) * normal_inverse(1 - 1 / n) + EULER * normal_inverse(1 - 1 / (n * math.e))
    return F.when(n > 1, high).otherwise(0.0)


def deflated_sharpe(days: DataFrame, variance: DataFrame, trials: DataFrame | int, cash: float = portfolio.CASH, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """(keys, trials, sr, threshold, z): z is the normal score of the chance that the true daily ratio is above the threshold of so many trials.

    variance: one row (v), the variance of daily ratios across the trials. trials: a number, or a table of them.
    """
    if isinstance(trials, int):
        trials = days.sparkSession.createDataFrame([(trials,)], "trials long")
    x = days.select(*keys, (F.col("ret") - cash).alias("x"))
    moments = x.groupBy(*keys).agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.count("x").alias("n"))
    u = (F.col("x") - F.col("mean")) / F.col("sd")
    shaped = x.join(moments, list(keys)).groupBy(*keys).agg(F.first(F.col("mean") / F.col("sd")).alias("sr"), F.first("n").alias("n"), F.avg(u * u * u).alias("g3"), F.avg(u * u * u * u).alias("g4"))
    bent = F.sqrt(F.greatest(1 - F.col("g3") * F.col("sr") + (F.col("g4") - 1) / 4 * F.col("sr") ** 2, F.lit(1e-12)))
    # one row, and a few
    limits = trials.crossJoin(F.broadcast(variance)).select("trials", (F.sqrt("v") * expected_max(F.col("trials"))).alias("threshold"))
    return shaped.crossJoin(F.broadcast(limits)).select(*keys, "trials", "sr", "threshold", ((F.col("sr") - F.col("threshold")) * F.sqrt(F.col("n") - 1) / bent).alias("z"))


def yearly_choice(days: DataFrame, first_year: int, last_year: int, cash: float = portfolio.CASH, band: float = strategies.BAND) -> DataFrame:
    """(year, run_id): for each year the run that its past rows choose. days: (run_id, seq, dt, ret, turnover).

    A year's past is a sum over the years before it, so each day is read once, whatever the number of years.
    """
    x = F.col("ret") - cash
    yearly = days.groupBy("run_id", F.year("dt").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("s1"), F.sum(x * x).alias("s2"), F.sum("turnover").alias("t"))
    each = yearly.withColumn("of", F.explode(F.sequence(F.greatest(F.col("year") + 1, F.lit(first_year).cast("long")), F.greatest(F.col("year") + 1, F.lit(last_year + 1).cast("long"))))).where(F.col("of") <= last_year)
    past = each.groupBy("run_id", F.col("of").alias("year")).agg(*(F.sum(c).alias(c) for c in ("n", "s1", "s2", "t")))
    variance = (F.col("s2") - F.col("s1") * F.col("s1") / F.col("n")) / (F.col("n") - 1)
    table = past.select("year", "run_id", F.try_divide(F.col("s1") / F.col("n") * F.sqrt(F.lit(252)), F.sqrt(variance)).alias("sharpe"), (F.col("t") / F.col("n") * 252).alias("turnover"))
    return strategies.choose(table, ("year",), band).select("year", "run_id", "sharpe", "turnover")


def verdict(table: DataFrame) -> DataFrame:
    """Adds level_1 and level_2 to rows of (drawdown, sharpe, least_drawdown, best_sharpe, low, point, at_cost, before, after).

    Level 1: a shallower fall and no worse ratio than each plain rival. Level 2: evidence, weak indication or none.
    """
    useful = (F.col("drawdown") > F.col("least_drawdown")) & (F.col("sharpe") >= F.col("best_sharpe"))
    same = (F.col("at_cost") > 0) & (F.col("before") > 0) & (F.col("after") > 0)
    level = F.when((F.col("low") > 0) & same, "evidence").when((F.col("point") > 0) & (F.col("low") <= 0), "weak").otherwise("none")
    return table.withColumns({"level_1": useful, "level_2": level})


def smoothed_weights(weighted: DataFrame, n: int = 20) -> DataFrame:
    """Adds smooth: mean weight of the last n rows, of fewer at the start."""
    return weighted.withColumn("smooth", F.avg("w").over(by_series("instrument").rowsBetween(-(n - 1), 0)))


def largest_gaps(a: DataFrame, b: DataFrame, on: str, value: str, n: int = 10) -> DataFrame:
    """The n rows where two series differ most; ties by `on`."""
    gap = a.select(on, F.col(value).alias("a")).join(b.select(on, F.col(value).alias("b")), on).withColumn("gap", F.abs(F.col("a") - F.col("b")))
    return gap.orderBy(F.desc("gap"), on).limit(n)


def stitched(days: DataFrame, chosen: DataFrame) -> DataFrame:
    """Each year's rows of the run that the year chose."""
    return days.withColumn("year", F.year("dt").cast("long")).join(F.broadcast(chosen.select("year", "run_id")), ["year", "run_id"])


def highest(table: DataFrame, by: str, value: str) -> DataFrame:
    return table.groupBy(by).agg(F.max(value).alias(value))


def placebo_steps(n: int, shifts: int, edge: int = 252) -> list[int]:
    """Steps of a cyclic shift in [edge, n - edge), drawn by the counter-based generator of the bootstrap."""
    from .inference import MODULUS, MULTIPLIER, STEP_REP, STEP_SALT

    out = []
    for i in range(shifts):
        x = (i * STEP_REP + 3 * STEP_SALT + 1) % MODULUS
        for _ in range(2):
            x = (x * x % MODULUS * MULTIPLIER + 11) % MODULUS
        out.append(edge + x % max(1, n - 2 * edge))
    return out


