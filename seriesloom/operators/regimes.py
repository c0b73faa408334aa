"""Volatility, as-of regime states, day-by-day transition matrices and what they forecast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scans import expanding_quantiles, with_ewm
from ..functions.windows import by_series, clip_low, guarded, last_rows, run_length, running, settled

DECAY, LOW, HIGH, HISTORY, HORIZON, PRIOR = 0.94, 0.40, 0.90, 252, 5, 1.0
STATES = (0, 1, 2)
FLOOR = 1e-10


def volatility(returns: DataFrame, decay: float = DECAY) -> DataFrame:
    """Adds x2 (squared log return) and vol (annualised, exponentially weighted; rounded so that both sides of a threshold agree)."""
    known = with_ewm(returns.withColumn("x2", F.pow(F.log1p("r"), 2)), "x2", decay, "v")
    return known.withColumn("vol", F.round(F.sqrt(252 * F.col("v")), 12)).drop("v")


def states(vols: DataFrame, low: float = LOW, high: float = HIGH, history: int = HISTORY) -> DataFrame:
    """Adds low, high (quantiles of all volatility so far) and state: 2 above high, else 0 up to low, else 1; null before `history` rows."""
    q = expanding_quantiles(vols, "vol", {"low": low, "high": high}, history)
    return _classified(q.withColumns({"low": F.round("low", 12), "high": F.round("high", 12)}))


def _classified(q: DataFrame) -> DataFrame:
    state = F.when(F.col("low").isNull(), None).when(F.col("vol") > F.col("high"), 2).when(F.col("vol") <= F.col("low"), 0).otherwise(1)
    return q.withColumn("state", state.cast("int"))


def states_at(vols: DataFrame, highs: tuple[float, ...], low: float = LOW, history: int = HISTORY) -> DataFrame:
    """states() at each of several high quantiles, from one pass: adds high_q, and series_id becomes series_id#high_q, so that every later window runs on all of them."""
    q = expanding_quantiles(vols, "vol", {"low": low, **{f"high_{100 * h:.0f}": h for h in highs}}, history)
    each = q.withColumn("at", F.explode_outer(F.array(*(F.struct(F.lit(h).alias("high_q"), F.lit(f"{h:.2f}").alias("name"), F.col(f"high_{100 * h:.0f}").alias("high")) for h in highs))))
    named = each.withColumn("series_id", F.concat_ws("#", "series_id", "at.name"))
    kept = [c for c in vols.columns if c != "series_id"]
    return _classified(named.select("series_id", *kept, "at.high_q", F.round("low", 12).alias("low"), F.round("at.high", 12).alias("high")))


def regimes(returns: DataFrame, **options) -> DataFrame:
    return states(volatility(returns), **options)


def transition_counts(df: DataFrame, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """Adds c00..c22: transitions between rows next to one another, up to and with each row."""
    w = by_series(*keys)
    before = df.withColumn("previous", F.lag("state").over(w))
    return before.withColumns({f"c{i}{j}": F.sum(F.when((F.col("previous") == i) & (F.col("state") == j), 1).otherwise(0)).over(running(w)) for i in STATES for j in STATES}).drop("previous")


def transition_matrix(counts: DataFrame, prior: float = PRIOR) -> DataFrame:
    """Adds p00..p22: rows of counts plus a prior, divided by their sums."""
    row = lambda i: sum((F.col(f"c{i}{j}") for j in STATES), F.lit(0.0)) + 3 * prior
    return counts.withColumns({f"p{i}{j}": (F.col(f"c{i}{j}") + prior) / row(i) for i in STATES for j in STATES})


def _of_state(name: str) -> Column:
    return F.when(F.col("state") == 0, F.col(name.format(0))).when(F.col("state") == 1, F.col(name.format(1))).when(F.col("state") == 2, F.col(name.format(2)))


def _first_step(df: DataFrame) -> DataFrame:
    """Adds h0..h2: the current state's row of the matrix."""
    return df.withColumns({f"h{j}": _of_state("p{}" + str(j)) for j in STATES})


def _next_step(df: DataFrame) -> DataFrame:
    """Multiplies h0..h2 by the matrix; no power of the matrix is formed."""
    step = {f"next{j}": sum((F.col(f"h{i}") * F.col(f"p{i}{j}") for i in STATES), F.lit(0.0)) for j in STATES}
    return df.withColumns(step).drop("h0", "h1", "h2").withColumnsRenamed({f"next{j}": f"h{j}" for j in STATES})


def stress_probability(matrices: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Adds p_stress: the chance of state 2 `horizon` days ahead, from the current state and matrix."""
    ahead = _first_step(matrices)
    for _ in range(horizon - 1):
        ahead = _next_step(ahead)
    return settled(ahead.withColumn("p_stress", F.col("h2")).drop("h0", "h1", "h2"), "p_stress")


def conditional_variance(df: DataFrame) -> DataFrame:
    """Adds v0..v2: mean of x2 in each state so far; null until the state is first seen."""
    w = running(by_series())
    return df.withColumns({f"v{j}": F.avg(F.when(F.col("state") == j, F.col("x2"))).over(w) for j in STATES})


def chain_variance(df: DataFrame, horizon: int = HORIZON, floor: float = FLOOR) -> DataFrame:
    """Adds f_chain: mean over the next days of the state-weighted variance; needs p.. and v..; null until all states are seen."""
    dot = lambda: sum((F.col(f"h{j}") * F.col(f"v{j}") for j in STATES), F.lit(0.0))
    out = _first_step(df).withColumn("acc", dot())
    for _ in range(horizon - 1):
        out = _next_step(out).withColumn("acc", F.col("acc") + dot())
    return settled(out.withColumn("f_chain", clip_low(F.col("acc") / horizon, floor)).drop("acc", "h0", "h1", "h2"), "f_chain")


def future_variance(df: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Adds future_x2, a label: mean of x2 over the next rows; null in the last `horizon` ones."""
    frame = by_series().rowsBetween(1, horizon)
    return df.withColumn("future_x2", guarded(F.avg("x2").over(frame), F.col("x2"), frame, horizon))


def mean_variance(df: DataFrame) -> DataFrame:
    return df.withColumn("f_mean", clip_low(F.avg("x2").over(running(by_series())), FLOOR))


def stress_frequency(df: DataFrame) -> DataFrame:
    """Adds freq: share of stress among the known states so far."""
    return df.withColumn("freq", F.avg(F.when(F.col("state").isNotNull(), (F.col("state") == 2).cast("double"))).over(running(by_series())))


def rolling_vol(df: DataFrame, n: int) -> DataFrame:
    frame = last_rows(by_series(), n)
    return df.withColumn(f"vol_{n}", guarded(F.sqrt(252 * F.avg("x2").over(frame)), F.col("x2"), frame, n))


def persistence(df: DataFrame, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    return run_length("state", by_series(*keys), keys)(df)
