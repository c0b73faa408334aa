"""Queries that compare forecasts: losses, tests of their difference, probabilities of stress, weights' sensitivity, and the gate."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import DIGITS, LOSSES, RETURNS, _forecasts, _har_sql, _out, query, r, scales_sql
from .functions.windows import by_series, clip_low
from .operators import multiscale, regimes, scores
from .sources import tables
from .sources.shared import kept

MODELS, LAGS = ("multi", "base", "ewma", "har"), 2 * regimes.HORIZON
#: Fixed values of the sensitivity grid and of the gate: rates, discounts, and the score that counts as better.
RATES, DISCOUNTS, BETTER = (5.0, 10.0, 20.0), (0.98, 0.99, 0.995), -2.0

_Q = lambda f: f"CASE WHEN bs.future_x2 > 0 THEN bs.future_x2 / {f} - ln(bs.future_x2 / {f}) - 1 END"
BLOCK = f"""bs AS MATERIALIZED (SELECT seq, f_chain, future_x2, greatest(pow(vol, 2) / 252, 1e-10) AS f_ewma FROM (WITH RECURSIVE {LOSSES} SELECT * FROM ff)), fm AS MATERIALIZED {scales_sql("variance")},
 hr AS MATERIALIZED (SELECT seq, f FROM (WITH {RETURNS}, {_har_sql()} SELECT seq, f FROM har)),
 fb AS (SELECT bs.seq, {_Q("CASE WHEN fm.value IS NOT NULL THEN greatest(fm.value, 1e-10) END")} AS multi, {_Q("f_chain")} AS base, {_Q("f_ewma")} AS ewma, {_Q("hr.f")} AS har FROM bs JOIN fm USING (seq) JOIN hr USING (seq)),
 fc AS MATERIALIZED (SELECT * FROM fb WHERE multi IS NOT NULL AND base IS NOT NULL AND ewma IS NOT NULL AND har IS NOT NULL)"""


def _t_sql(a: str, b: str) -> str:
    """(mean_difference, t) of two columns of fc."""
    total = " + ".join(f"2 * {1 - k / (LAGS + 1)}::DOUBLE * sum(u * u{k}) / count(*)" for k in range(1, LAGS + 1))
    return f"""(SELECT avg(d) AS mean_difference, CASE WHEN sum(u * u) / count(*) + {total} > 0 THEN avg(d) / sqrt((sum(u * u) / count(*) + {total}) / count(*)) END AS t
 FROM (SELECT *, {", ".join(f"lag(u, {k}) OVER (ORDER BY seq) AS u{k}" for k in range(1, LAGS + 1))} FROM (SELECT seq, {a} - {b} AS d, {a} - {b} - avg({a} - {b}) OVER () AS u FROM fc)))"""


def _losses(spark, sf_dir, scales: DataFrame | None = None) -> DataFrame:
    """(series_id, seq, multi, base, ewma, har): QLIKE losses on the days for which all models have one. scales: variance_losses() if at hand."""
    market = tables.market(spark, sf_dir)
    base = _forecasts(spark, sf_dir).select("series_id", "seq", "future_x2", F.col("f_chain").alias("base"), clip_low(F.col("vol") * F.col("vol") / 252, regimes.FLOOR).alias("ewma"))
    multi = multiscale.combined_variance(multiscale.variance_losses(market) if scales is None else scales).select("series_id", "seq", clip_low(F.col("f_multi"), regimes.FLOOR).alias("multi"))
    har = multiscale.har(regimes.volatility(market)).select("series_id", "seq", F.col("f_har").alias("har"))
    both = base.join(multi, ["series_id", "seq"]).join(har, ["series_id", "seq"])
    return kept(both.select("series_id", "seq", *(scores.qlike(F.col("future_x2"), F.col(m)).alias(m) for m in MODELS)).dropna(), "losses")


@query(f"WITH {BLOCK} SELECT model, count(*) AS n, {r('avg(loss)', 'qlike')} FROM (UNPIVOT fc ON {', '.join(MODELS)} INTO NAME model VALUE loss) GROUP BY 1")
def forecast_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean QLIKE of each model's variance forecast, on common days."""
    long = _losses(spark, sf_dir).unpivot(["seq"], list(MODELS), "model", "loss")
    return _out(long.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.avg("loss").alias("qlike")), "model", "n", "qlike")


def _tests(losses: DataFrame) -> DataFrame:
    parts = [scores.diebold_mariano(losses, "multi", m, LAGS).withColumn("rival", F.lit(m)) for m in MODELS[1:]]
    return functools.reduce(DataFrame.unionByName, parts)


@query(f"WITH {BLOCK} " + " UNION ALL ".join(f"SELECT '{m}' AS rival, {r('mean_difference')}, round(t, 6) AS t FROM {_t_sql('multi', m)}" for m in MODELS[1:]))
def forecast_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scales' combined forecast against each rival: mean difference of losses, and its score with Bartlett weights."""
    return _tests(_losses(spark, sf_dir)).select("rival", F.round("mean_difference", DIGITS).alias("mean_difference"), F.round("t", 6).alias("t"))


@query(f"""WITH {BLOCK}, ml AS (SELECT avg(multi) AS multi, avg(base) AS base FROM fc)
 SELECT {r('multi', 'qlike_multi')}, {r('base', 'qlike_base')}, round(t, 6) AS t, (multi < base AND t <= {BETTER})::INT::BIGINT AS advances FROM ml, {_t_sql('multi', 'base')}""")
def forecast_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule fixed beforehand: the scales replace the single chain if their loss is lower and the test's score is BETTER or less."""
    losses = _losses(spark, sf_dir)
    mean = losses.agg(F.avg("multi").alias("qlike_multi"), F.avg("base").alias("qlike_base"))
    t = scores.diebold_mariano(losses, "multi", "base", LAGS).select(F.round("t", 6).alias("t"))
    got = mean.crossJoin(F.broadcast(t))  # one row each
    advances = (F.col("qlike_multi") < F.col("qlike_base")) & (F.col("t") <= BETTER)
    return _out(got.withColumn("advances", F.coalesce(advances, F.lit(False))), "qlike_multi", "qlike_base", "advances").crossJoin(F.broadcast(t))


_CLIP = "greatest(least(p, 0.99::DOUBLE), 0.01::DOUBLE)"
_COMMON = LOSSES.replace("0.94::DOUBLE", f"{1 - 2 / (multiscale.COMMON + 1)!r}::DOUBLE")


@query(f"""WITH pm AS MATERIALIZED {scales_sql("stress")}, st AS MATERIALIZED (SELECT seq, state FROM (WITH RECURSIVE {_COMMON} SELECT seq, state FROM ff)),
 oc AS (SELECT seq, CASE WHEN lead(state, 5) OVER (ORDER BY seq) IS NOT NULL THEN (lead(state, 5) OVER (ORDER BY seq) = 2)::INT::DOUBLE END AS y, CASE WHEN state IS NOT NULL THEN (state = 2)::INT::DOUBLE END AS persistence,
 avg(CASE WHEN state IS NOT NULL THEN (state = 2)::INT::DOUBLE END) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS frequency FROM st),
 lg AS (SELECT 'multi' AS model, value AS p, y FROM oc JOIN pm USING (seq) UNION ALL SELECT 'persistence', persistence, y FROM oc UNION ALL SELECT 'frequency', frequency, y FROM oc)
 SELECT model, count(*) AS n, {r('avg(pow(p - y, 2))', 'brier')}, {r(f'avg(-(y * ln({_CLIP}) + (1 - y) * ln(1 - {_CLIP})))', 'log_score')} FROM lg WHERE p IS NOT NULL AND y IS NOT NULL GROUP BY 1""")
def probability_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stress of the common scale five days ahead, as the scales see it, as it is today, and as often as it was so far."""
    market = tables.market(spark, sf_dir)
    states = regimes.stress_frequency(regimes.states(regimes.volatility(market, 1 - 2 / (multiscale.COMMON + 1))))
    known = states.select("series_id", "seq", (F.lead("state", regimes.HORIZON).over(by_series()) == 2).cast("double").alias("y"), (F.col("state") == 2).cast("double").alias("persistence"), F.col("freq").alias("frequency"))
    multi = multiscale.stress_probability(market).select("series_id", "seq", F.col("p_stress").alias("multi"))
    long = known.join(multi, ["series_id", "seq"]).unpivot(["y"], ["multi", "persistence", "frequency"], "model", "p").dropna()
    got = long.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.avg(scores.brier(F.col("p"), F.col("y"))).alias("brier"), F.avg(scores.log_score(F.col("p"), F.col("y"))).alias("log_score"))
    return _out(got, "model", "n", "brier", "log_score")


def _sensitivity_sql() -> str:
    cells = [f"SELECT {rate}::DOUBLE AS rate, {d}::DOUBLE AS discount, seq, value FROM {scales_sql('variance', rate=rate, discount=d)}" for rate in RATES for d in DISCOUNTS]
    return f"""WITH {BLOCK}, cells AS ({" UNION ALL ".join(cells)}) SELECT rate, discount, count(*) AS n, {r(f'avg({_Q("CASE WHEN cells.value IS NOT NULL THEN greatest(cells.value, 1e-10) END")})', 'qlike')} FROM cells JOIN bs USING (seq) JOIN fc USING (seq) GROUP BY 1, 2"""


@query(_sensitivity_sql())
def weight_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean QLIKE of the combined forecast for nine pairs of learning rate and discount, on the common days."""
    scales = kept(multiscale.variance_losses(tables.market(spark, sf_dir)).select("series", "series_id", "scale", "seq", "dt", "f_chain", "future_x2", "loss"), "scales")
    each = multiscale.reweighted(scales, RATES, DISCOUNTS)
    sums = each.groupBy("rate", "discount", F.col("series").alias("series_id"), "seq").agg(F.when(F.count("f_chain") == F.count(F.lit(1)), F.sum(F.col("f_chain") * F.col("weight"))).alias("f"), F.first("future_x2").alias("future_x2"))
    common = _losses(spark, sf_dir, scales).select("series_id", "seq")
    loss = sums.join(common, ["series_id", "seq"]).withColumn("loss", scores.qlike(F.col("future_x2"), clip_low(F.col("f"), regimes.FLOOR)))
    return _out(loss.groupBy("rate", "discount").agg(F.count("loss").alias("n"), F.avg("loss").alias("qlike")), "rate", "discount", "n", "qlike")
