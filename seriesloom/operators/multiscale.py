"""Chains at several memories, combined by weights that follow the losses known so far."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.linear import with_solution
from ..functions.scans import with_ewm
from ..functions.windows import by_series, clip_low, guarded, last_rows, running
from . import regimes, scores

#: Memories in days, the one whose stress is the common event, learning rate and discount.
MEMORIES, COMMON, RATE, DISCOUNT = (5, 15, 42), 15, 10.0, 0.99


def per_scale(returns: DataFrame, memories: tuple[int, ...] = MEMORIES, highs: tuple[float, ...] = (), **options) -> DataFrame:
    """Matrices of each memory; series_id is series and memory, so that every later window runs on all at once.

    With highs, each of these high quantiles is a series of its own too: series becomes series#quantile.
    """
    parts = [regimes.volatility(returns.withColumns({"series": F.col("series_id"), "scale": F.lit(n), "series_id": F.concat_ws("#", "series_id", F.lit(n))}), 1 - 2 / (n + 1)) for n in memories]
    every = functools.reduce(DataFrame.unionByName, parts)
    if highs:
        known = regimes.states_at(every, highs, **options).withColumn("series", F.concat_ws("#", "series", F.format_string("%.2f", "high_q")))
    else:
        known = regimes.states(every, **options)
    return regimes.transition_matrix(regimes.transition_counts(known))


def _with_known(df: DataFrame, discount: float, horizon: int, name: str) -> DataFrame:
    """Adds name: the discounted mean loss of each scale, as known `horizon` rows later."""
    w = by_series()
    late = with_ewm(df, "loss", discount, "mean").withColumn("late", F.lag("mean", horizon).over(w))
    return late.withColumn(name, F.last("late", ignorenulls=True).over(running(w))).drop("mean", "late")


def _with_weight(df: DataFrame, rate: Column, keys: tuple[str, ...]) -> DataFrame:
    """Replaces known by weight: the softmax of minus rate times known over the scales of one day; keys name a day."""
    day = Window.partitionBy(*keys)
    filled = df.withColumn("filled", F.coalesce("known", F.avg("known").over(day)))
    raised = filled.withColumn("e", F.exp(-rate * (F.col("filled") - F.min("filled").over(day))))
    return raised.withColumn("weight", F.coalesce(F.col("e") / F.sum("e").over(day), 1 / F.count(F.lit(1)).over(day))).drop("known", "filled", "e")


def adaptive_weights(df: DataFrame, horizon: int = regimes.HORIZON, rate: float = RATE, discount: float = DISCOUNT) -> DataFrame:
    """Adds weight from loss: softmax of minus the discounted mean loss, as known `horizon` rows later.

    A scale without a known loss gets the mean of the others; where none is known, weights are equal.
    """
    return _with_weight(_with_known(df, discount, horizon, "known"), F.lit(rate), ("series", "seq"))


def reweighted(df: DataFrame, rates: tuple[float, ...], discounts: tuple[float, ...], horizon: int = regimes.HORIZON) -> DataFrame:
    """adaptive_weights() for each pair of learning rate and discount: adds rate, discount and weight.

    One plan for all pairs: a discount is a column, a pair is rows. A union of one plan a pair would run all of them in one task, as
    they are partitioned alike.
    """
    known = df
    for i, discount in enumerate(discounts):
        known = _with_known(known, discount, horizon, f"known {i}")
    pairs = (F.struct(F.lit(rate).alias("rate"), F.lit(discount).alias("discount"), F.col(f"known {i}").alias("known")) for i, discount in enumerate(discounts) for rate in rates)
    each = known.withColumn("pair", F.explode(F.array(*pairs))).select(*(F.col(f"`{c}`") for c in df.columns), "pair.*")
    return _with_weight(each, F.col("rate"), ("series", "seq", "rate", "discount"))


def _combined(weighted: DataFrame, value: str, name: str) -> DataFrame:
    all_known = F.count(value) == F.count(F.lit(1))
    sums = weighted.groupBy(F.col("series").alias("series_id"), "seq", "dt").agg(F.when(all_known, F.sum(F.col(value) * F.col("weight"))).alias(name), *(F.max(F.when(F.col("scale") == n, F.col("weight"))).alias(f"w{n}") for n in MEMORIES))
    return sums


def stress_losses(returns: DataFrame, horizon: int = regimes.HORIZON, **options) -> DataFrame:
    """Each scale's p_stress and its log score on stress of the common scale `horizon` rows ahead, y."""
    p = regimes.stress_probability(per_scale(returns, **options), horizon).withColumn("ahead", F.lead("state", horizon).over(by_series()))
    event = F.max(F.when(F.col("scale") == COMMON, (F.col("ahead") == 2).cast("double"))).over(Window.partitionBy("series", "seq"))
    return p.withColumn("y", event).withColumn("loss", scores.log_score(F.col("p_stress"), F.col("y")))


def stress_probability(returns: DataFrame, horizon: int = regimes.HORIZON, **options) -> DataFrame:
    """(series_id, seq, dt, p_stress, w5, w15, w42): the scales' probabilities, weighted by their log scores."""
    return _combined(adaptive_weights(stress_losses(returns, horizon, **options), horizon), "p_stress", "p_stress")


def variance_losses(returns: DataFrame, horizon: int = regimes.HORIZON, **options) -> DataFrame:
    """Each scale's f_chain and its QLIKE loss."""
    f = regimes.future_variance(regimes.chain_variance(regimes.conditional_variance(per_scale(returns, **options)), horizon), horizon)
    return f.withColumn("loss", scores.qlike(F.col("future_x2"), F.col("f_chain")))


def variance(returns: DataFrame, horizon: int = regimes.HORIZON, **options) -> DataFrame:
    """(series_id, seq, dt, f_multi, w5, w15, w42): the scales' variance forecasts, weighted by their QLIKE losses."""
    return combined_variance(variance_losses(returns, horizon, **options), horizon)


def combined_variance(losses: DataFrame, horizon: int = regimes.HORIZON) -> DataFrame:
    """variance() of variance_losses()."""
    return _combined(adaptive_weights(losses, horizon), "f_chain", "f_multi")


def har(vols: DataFrame, horizon: int = regimes.HORIZON, least: int = 250) -> DataFrame:
    """Adds f_har: future variance by least squares on x2 and its means of 5 and 22 rows, over examples whose future is past."""
    w, scale = by_series(), 1e4
    mean = lambda n: guarded(F.avg("x2").over(last_rows(w, n)), F.col("x2"), last_rows(w, n), n)
    x = regimes.future_variance(vols, horizon).withColumns({"h0": F.lit(1.0), "h1": F.col("x2") * scale, "h2": mean(5) * scale, "h3": mean(22) * scale})
    names = [f"h{i}" for i in range(4)]
    whole = F.col("future_x2").isNotNull()
    for c in names:
        whole = whole & F.col(c).isNotNull()
    past = w.rowsBetween(Window.unboundedPreceding, -horizon)
    total = lambda v: F.sum(F.when(whole, v).otherwise(0.0)).over(past)
    n = F.count(F.when(whole, 1)).over(past)
    sums = {f"a{i}{j}": total(F.col(names[i]) * F.col(names[j])) for i in range(4) for j in range(i, 4)} | {f"b{i}": total(F.col(names[i]) * F.col("future_x2") * scale) for i in range(4)}
    ready = x.withColumns({"n": n, **sums})
    ready = ready.withColumns({c: F.when(F.col("n") >= least, F.col(c)) for c in sums})
    fitted = with_solution(ready, 4, "a", "b", "beta")
    forecast = sum((F.col(f"beta{i}") * F.col(c) for i, c in enumerate(names)), F.lit(0.0)) / scale
    return fitted.withColumn("f_har", clip_low(forecast, regimes.FLOOR)).drop("n", *sums, *(f"beta{i}" for i in range(4)), *names)
