"""Queries of a whole study: every strategy and every cell of the grid is a run of one simulation."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import CORE_VOL, DIGITS, ORACLE_SQL, PANEL, QUERIES, RETURNS, STATES, STRESS, WEIGHTS, _MEASURES, _metrics_sql, _out, query, r, scales_sql, weights_and_core
from .functions.normal import normal_cdf, two_sided_p
from .functions.windows import by_series
from .operators import charts, inference, models, multiscale, portfolio, regimes, strategies, study
from .sources import tables
from .sources.shared import kept

HIGHS, VOL_MULTIPLIERS = (0.80, 0.90), (0.8, 1.0, 1.2)
FIRST, SPLIT, YEARS = strategies.WARM_UP, date(1999, 7, 1), (1998, 2001)
CELLS = [(f"{s}_{q:.2f}", m, react) for s in ("base", "state", "multi") for q in HIGHS for m in strategies.MULTIPLIERS for react in strategies.REACTIONS]
CELLS += [("vol_target", m, 0.0) for m in VOL_MULTIPLIERS]
#: Trials that the deflated ratio allows for: the cells of this grid; and fixed values, all cells and windows ever tried, and a cautious number.
TRIALS, DECLARED = len(CELLS), (60, 192)
_K = range(1, 6)


def run_id(signal: str, m: float, react: float) -> str:
    return f"{signal}_{m:.1f}" + ("" if signal == "vol_target" else f"_{react:.2f}")


def _wide(name: str, targets: str) -> str:
    columns = ", ".join(f"max(r) FILTER (instrument = '{i}') AS r{i}, max(w) FILTER (instrument = '{i}') AS w{i}" for i in _K)
    return f"{name} AS MATERIALIZED (SELECT run_id, seq, any_value(dt) AS dt, bool_or(ord) AND count(w) = 5 AS ord, {columns} FROM {targets} GROUP BY run_id, seq)"


def _simulated(name: str, runs: str) -> str:
    """A recursion over days with one holding for each instrument, for all runs side by side."""
    gross = " + ".join(f"s.h{i} * p.r{i}" for i in _K)
    total = " + ".join(f"s.h{i}" for i in _K)
    drift = {i: f"(s.h{i} * (1 + p.r{i}) / (1 + ({gross} + (1 - ({total})) * 0.00005::DOUBLE)))" for i in _K}
    turn = " + ".join(f"abs(s.t{i} - {drift[i]})" for i in _K)
    return f"""{name} AS (SELECT DISTINCT run_id, -1::BIGINT AS seq, NULL::DATE AS dt, false AS pending, 0::DOUBLE AS ret, 0::DOUBLE AS turnover, 0::DOUBLE AS exposure, {", ".join(f"0::DOUBLE AS h{i}, 0::DOUBLE AS t{i}" for i in _K)} FROM {runs}
 UNION ALL SELECT p.run_id, p.seq, p.dt, p.ord, ({gross} + (1 - ({total})) * 0.00005::DOUBLE) - CASE WHEN s.pending THEN 0.0005::DOUBLE * ({turn}) ELSE 0 END,
 CASE WHEN s.pending THEN {turn} ELSE 0 END, {total}, {", ".join(f"CASE WHEN s.pending THEN s.t{i} ELSE {drift[i]} END, coalesce(p.w{i}, 0)" for i in _K)} FROM {name} s JOIN {runs} p ON p.seq = s.seq + 1 AND p.run_id = s.run_id)"""


def _signal_sql(high: float) -> str:
    return f"SELECT dt, p_stress, CASE WHEN state IS NOT NULL THEN (state = 2)::INT::DOUBLE END AS stays FROM (WITH RECURSIVE {STRESS.replace('quantile_cont(vol, 0.9)', f'quantile_cont(vol, {high})')} SELECT dt, state, p_stress FROM ps)"


DAYS = f"""{CORE_VOL}, reference AS (SELECT median(core_vol) AS reference FROM core WHERE seq BETWEEN 59 AND 503), {", ".join(f"sg{round(q * 100)} AS MATERIALIZED ({_signal_sql(q)}), sm{round(q * 100)} AS MATERIALIZED {scales_sql('stress', q)}" for q in HIGHS)},
 dy AS (SELECT seq, dt, core_vol, reference, coalesce(date_trunc('week', dt) <> lead(date_trunc('week', dt)) OVER (ORDER BY seq), false) AND seq >= {FIRST} AS week_end,
 coalesce(date_trunc('month', dt) <> lead(date_trunc('month', dt)) OVER (ORDER BY seq), false) AND seq >= {FIRST} AS month_end FROM core, reference)"""
_SIGNALS = " UNION ALL ".join(f"SELECT '{name}_{q:.2f}' AS signal, dt, {column} AS p FROM sg{round(q * 100)}" for q in HIGHS for name, column in (("base", "p_stress"), ("state", "stays")))
_SIGNALS += "".join(f" UNION ALL SELECT 'multi_{q:.2f}', dt, value FROM sm{round(q * 100)}" for q in HIGHS)


def _level_targets(cells: list[tuple[str, str, float, float]]) -> str:
    values = ", ".join(f"('{name}', '{signal}', {m}::DOUBLE, {react}::DOUBLE)" for name, signal, m, react in cells)
    return f"""SELECT c.run_id, t.instrument, dy.seq, dy.dt, t.r, CASE WHEN x IS NOT NULL THEN t.w * least(x, 1) END AS w, dy.week_end AS ord
 FROM (SELECT c.run_id, d.seq, c.m * d.reference * (1 - (1 - c.react) * CASE WHEN c.signal = 'vol_target' THEN 0 ELSE s.p END) / d.core_vol AS x
 FROM dy d CROSS JOIN (VALUES {values}) c(run_id, signal, m, react) LEFT JOIN ({_SIGNALS}) s ON s.dt = d.dt AND s.signal = c.signal) c JOIN dy USING (seq) JOIN wt t USING (seq)"""


_GRID = f"""{DAYS}, tg AS ({_level_targets([(run_id(*c), *c) for c in CELLS])}), {_wide("runs", "tg")}, {_simulated("sim", "runs")}, win AS (SELECT * FROM sim WHERE seq >= {FIRST})"""
_CHOSEN = [("base", "base_0.90", 0.8, 0.25), ("state", "state_0.90", 0.8, 0.25), ("multi", "multi_0.90", 0.8, 0.25), ("vol_target", "vol_target", 0.8, 0.0)]
_CHOSEN_FITTED = [("hmm", "hmm", 0.8, 0.25), ("logistic", "logistic_0.90", 0.8, 0.25)]
#: The strategy whose mean exposure sets that of the constant level and of the equal volatility target.
MAIN = "multi"
_PARTS, _ROUNDS = 32, 5


def _equal_sql(source: str) -> str:
    """CTEs up to eq (strategy, m, target): multipliers by narrowing brackets, each round a recursion over days for all multipliers tried."""
    parts = [f"br0 AS (SELECT strategy, target, {study.LEAST_M}::DOUBLE AS low, {study.MOST_M}::DOUBLE AS high, NULL::DOUBLE AS under, NULL::DOUBLE AS over FROM {source})"]
    for k in range(1, _ROUNDS + 1):
        parts.append(f"""tr{k} AS MATERIALIZED (SELECT strategy, strategy || '#' || i AS run_id, low + (high - low) / {_PARTS + 1} * i AS m FROM br{k - 1}, range(1, {_PARTS + 1}) t(i)),
 te{k} AS (SELECT run_id, instrument, dy.seq, dy.dt, r, w * least(m * reference / core_vol, 1) AS w, week_end AS ord FROM dy JOIN wt USING (seq), tr{k}), {_wide(f"rune{k}", f"te{k}")}, {_simulated(f"sime{k}", f"rune{k}")},
 ex{k} AS MATERIALIZED (SELECT strategy, avg(exposure) AS mean FROM sime{k} JOIN tr{k} USING (run_id) WHERE seq >= {FIRST} GROUP BY strategy, run_id),
 fo{k} AS MATERIALIZED (SELECT strategy, count(*) FILTER (mean <= target) AS n, max(mean) FILTER (mean <= target) AS u, min(mean) FILTER (mean > target) AS o FROM ex{k} JOIN br{k - 1} USING (strategy) GROUP BY 1),
 br{k} AS MATERIALIZED (SELECT strategy, target, low + (high - low) / {_PARTS + 1} * n AS low, low + (high - low) / {_PARTS + 1} * (n + 1) AS high, coalesce(u, under) AS under, coalesce(o, over) AS over FROM br{k - 1} JOIN fo{k} USING (strategy))""")
    return ", ".join(parts) + f", eq AS MATERIALIZED (SELECT strategy, low + (high - low) * coalesce((target - under) / (over - under), 0.5) AS m, target FROM br{_ROUNDS})"


_TREND = f"""tr AS (SELECT instrument, seq, CASE WHEN price > mean THEN 1 WHEN mean IS NOT NULL THEN 0 END AS above FROM (SELECT *, CASE WHEN count(price) OVER w = 200 THEN avg(price) OVER w END AS mean
 FROM (SELECT instrument, seq, product(1 + r) OVER (PARTITION BY instrument ORDER BY seq ROWS UNBOUNDED PRECEDING) AS price FROM panel) WINDOW w AS (PARTITION BY instrument ORDER BY seq ROWS 199 PRECEDING)))"""
_MEANS = f"""sig AS MATERIALIZED ({_level_targets(_CHOSEN)}), {_wide("runs0", "(SELECT * FROM sig WHERE run_id <> 'vol_target')")}, {_simulated("sim0", "runs0")},
 mean AS MATERIALIZED (SELECT run_id AS strategy, avg(exposure) AS target FROM sim0 WHERE seq >= {FIRST} GROUP BY 1)"""
_ALL = f"""{DAYS}, {_TREND}, {_MEANS}, main AS (SELECT * FROM mean WHERE strategy = '{MAIN}'), {_equal_sql("main")},
 tg AS (SELECT * FROM sig UNION ALL SELECT 'constant', instrument, dy.seq, dy.dt, r, w * target, week_end FROM dy JOIN wt USING (seq), main UNION ALL SELECT 'static', instrument, dy.seq, dy.dt, r, w, week_end FROM dy JOIN wt USING (seq)
 UNION ALL SELECT 'vol_target_equal', instrument, dy.seq, dy.dt, r, w * least(m * reference / core_vol, 1), week_end FROM dy JOIN wt USING (seq), eq
 UNION ALL SELECT 'trend', wt.instrument, dy.seq, dy.dt, r, w * above, week_end FROM dy JOIN wt USING (seq) JOIN tr ON tr.seq = wt.seq AND tr.instrument = wt.instrument
 UNION ALL SELECT 'market', instrument, dy.seq, dy.dt, r, (instrument = '2')::INT::DOUBLE, dy.seq = {FIRST} FROM dy JOIN wt USING (seq)
 UNION ALL SELECT '60_40', instrument, dy.seq, dy.dt, r, CASE instrument WHEN '2' THEN 0.6::DOUBLE WHEN '4' THEN 1 - 0.6::DOUBLE ELSE 0 END, month_end FROM dy JOIN wt USING (seq)),
 {_wide("runs", "tg")}, {_simulated("sim", "runs")}, win AS (SELECT * FROM sim WHERE seq >= {FIRST})"""


def _base(spark, sf_dir):
    """(weights, days): days has the core's volatility, its reference and who may decide."""
    weighted, core = weights_and_core(spark, sf_dir)
    nothing = core.select("dt").withColumn("p_stress", F.lit(None).cast("double"))
    return weighted, kept(strategies.signal_days(core, nothing).drop("p_stress"), "days")


def _signals(spark, sf_dir, highs=HIGHS):
    """(signal, dt, p_stress): the chain's chance of stress, the indicator of today's state and the scales' combined chance, at each high quantile."""
    market = tables.market(spark, sf_dir)
    scales = multiscale.stress_probability(market, highs=highs).select(F.concat(F.lit("multi_"), F.substring_index("series_id", "#", -1)).alias("signal"), "dt", "p_stress")
    states = regimes.states_at(regimes.volatility(market), highs)
    p = regimes.stress_probability(regimes.transition_matrix(regimes.transition_counts(states)))
    at = F.format_string("%.2f", "high_q")
    kinds = F.array(F.struct(F.concat(F.lit("base_"), at).alias("signal"), F.col("p_stress").alias("p")), F.struct(F.concat(F.lit("state_"), at).alias("signal"), (F.col("state") == 2).cast("double").alias("p")))
    # the outer form adds no filter, which would repeat the whole chain of expressions
    each = p.select("dt", F.explode_outer(kinds).alias("x")).select("x.signal", "dt", F.col("x.p").alias("p_stress")).unionByName(scales)
    return kept(each, "signals")


def _grid_days(spark, sf_dir, cells=None, signals=None):
    """Simulated days of all cells in the evaluation window."""
    weighted, days = _base(spark, sf_dir)
    cells = spark.createDataFrame([(run_id(*c), *c) for c in cells or CELLS], "run_id string, signal string, m double, react double")
    each = days.crossJoin(F.broadcast(cells)).join(signals or _signals(spark, sf_dir), ["signal", "dt"], "left")
    each = each.withColumn("p_stress", F.when(F.col("signal") == "vol_target", 0.0).otherwise(F.col("p_stress")))
    got = portfolio.simulate_levels(weighted, portfolio.exposure(each))
    return kept(study.window(got).join(F.broadcast(days.select("seq", "dt")), "seq"), "simulated")


def _mean_exposures(weighted, days, signals, names):
    """(strategy, target): mean exposures in the evaluation of the named strategies."""
    spark = weighted.sparkSession
    runs = spark.createDataFrame([x for x in _CHOSEN if x[0] in names], "run_id string, signal string, m double, react double")
    each = days.crossJoin(F.broadcast(runs)).join(signals, ["signal", "dt"], "left")
    got = study.window(portfolio.simulate_levels(weighted, portfolio.exposure(each)))
    return got.groupBy(F.col("run_id").alias("strategy")).agg(F.avg("exposure").alias("target"))


def _fitted_signals(spark, sf_dir, highs=HIGHS):
    """(signal, dt, p_stress) of what is fitted as time goes on: the hidden chain, and the logistic regression at each high quantile, whose folds are fitted together."""
    market = kept(tables.market(spark, sf_dir), "market")
    hidden = models.walk_forward_hidden(market).select(F.lit("hmm").alias("signal"), "dt", F.col("p_hidden").alias("p_stress"))
    logistic = models.walk_forward_logistic(regimes.states_at(regimes.volatility(market), highs))
    logistic = logistic.join(market.select("seq", "dt"), "seq").select(F.concat(F.lit("logistic_"), F.substring_index("series_id", "#", -1)).alias("signal"), "dt", F.col("p_logistic").alias("p_stress"))
    return kept(hidden.unionByName(logistic), "signals")


def _all_days(spark, sf_dir, fitted: DataFrame | None = None):
    """Simulated days of all strategies in the evaluation window; with the fitted signals, of theirs too."""
    weighted, days = _base(spark, sf_dir)
    signals = _signals(spark, sf_dir, (0.90,))
    equal = study.equal_exposures(weighted, days, _mean_exposures(weighted, days, signals, (MAIN,)))
    chosen = _CHOSEN if fitted is None else _CHOSEN + _CHOSEN_FITTED
    runs = [(name, "none" if signal == "vol_target" else signal, m, react) for name, signal, m, react in chosen]
    known = signals if fitted is None else signals.unionByName(fitted)
    got = portfolio.filled_orders(study.all_targets(weighted, days, known, study.strategy_table(spark, runs, equal)))
    return kept(study.window(got).join(F.broadcast(days.select("seq", "dt")), "seq"), "simulated")


@query(f"WITH RECURSIVE {_GRID}, {_metrics_sql('win', 'run_id')} SELECT run_id, {', '.join(r(c) for c in _MEASURES)} FROM me")
def full_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cells of the chain, of the state and of volatility targeting, over the evaluation."""
    return _out(portfolio.metrics(_grid_days(spark, sf_dir)), "run_id", *_MEASURES)


@query(f"WITH RECURSIVE {_GRID}, {_metrics_sql('win', 'run_id')} SELECT run_id, {', '.join(r(c) for c in _MEASURES)} FROM me WHERE run_id LIKE 'multi%'")
def multiscale_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve cells of the multi-scale signal."""
    return _out(portfolio.metrics(_grid_days(spark, sf_dir, [c for c in CELLS if c[0].startswith("multi")])), "run_id", *_MEASURES)


_OF = "split_part(run_id, '_', 1)"


@query(f"""WITH RECURSIVE {_GRID}, {_metrics_sql('win', 'run_id')}, pk AS (SELECT {_OF} AS strategy, *, max(sharpe) OVER (PARTITION BY {_OF}) AS best FROM me)
 SELECT strategy, run_id, {r('sharpe')}, {r('turnover')} FROM pk WHERE sharpe >= best - 0.02::DOUBLE QUALIFY row_number() OVER (PARTITION BY strategy ORDER BY turnover, run_id) = 1""")
def chosen_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = portfolio.metrics(_grid_days(spark, sf_dir)).withColumn("strategy", F.substring_index("run_id", "_", 1))
    return _out(strategies.choose(table, ("strategy",)), "strategy", "run_id", "sharpe", "turnover")


@query(f"WITH RECURSIVE {_GRID}, {_metrics_sql('win', 'run_id')} SELECT {_OF} AS strategy, {r('max(exposure)', 'exposure')} FROM me GROUP BY 1")
def highest_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = portfolio.metrics(_grid_days(spark, sf_dir)).withColumn("strategy", F.substring_index("run_id", "_", 1))
    return _out(study.highest(table, "strategy", "exposure"), "strategy", "exposure")


@query(f"WITH RECURSIVE {_ALL}, {_metrics_sql('win', 'run_id')} SELECT run_id, {', '.join(r(c) for c in _MEASURES)} FROM me")
def all_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals, volatility targeting, constant and full exposure, trend, the market alone and a fixed mix."""
    return _out(portfolio.metrics(_all_days(spark, sf_dir)), "run_id", *_MEASURES)


@query(f"""WITH RECURSIVE {_ALL} SELECT run_id, CASE WHEN dt < DATE '{SPLIT}' THEN 'before' ELSE 'after' END AS part, {r("avg(ret - 0.00005::DOUBLE) / stddev_samp(ret - 0.00005::DOUBLE) * sqrt(252)", "sharpe")} FROM win GROUP BY 1, 2""")
def subperiod_sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(study.subperiods(_all_days(spark, sf_dir), SPLIT), "run_id", "part", "sharpe")


@query(f"""WITH RECURSIVE {_GRID}, {_metrics_sql('win', 'run_id')}, tv AS (SELECT var_samp(sharpe / sqrt(252)) AS v FROM me),
 mo AS (SELECT run_id, avg(ret - 0.00005::DOUBLE) AS m, stddev_samp(ret) AS sd, count(*) AS n FROM win GROUP BY 1),
 sh AS (SELECT run_id, any_value(m / sd) AS sr, any_value(n) AS n, avg(pow((ret - 0.00005::DOUBLE - m) / sd, 3)) AS g3, avg(pow((ret - 0.00005::DOUBLE - m) / sd, 4)) AS g4 FROM win JOIN mo USING (run_id) GROUP BY 1)
 SELECT run_id, {r('sr')}, {r(f'sqrt(v) * {study.expected_max_factor(TRIALS)!r}::DOUBLE', 'threshold')}, round((sr - sqrt(v) * {study.expected_max_factor(TRIALS)!r}::DOUBLE) * sqrt(n - 1) / sqrt(greatest(1 - g3 * sr + (g4 - 1) / 4 * sr * sr, 1e-12)), 6) AS z FROM sh, tv""")
def deflated_sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each cell: its daily ratio, the threshold that so many trials set, and the normal score of being above it."""
    days = _grid_days(spark, sf_dir)
    variance = portfolio.metrics(days).agg(F.var_samp(F.col("sharpe") / F.sqrt(F.lit(252))).alias("v"))
    got = study.deflated_sharpe(days, variance, TRIALS)
    return got.select("run_id", F.round("sr", DIGITS).alias("sr"), F.round("threshold", DIGITS).alias("threshold"), F.round("z", 6).alias("z"))


_PAST = f"""yr AS (SELECT y.year, w.run_id, avg(ret - 0.00005::DOUBLE) / stddev_samp(ret) * sqrt(252) AS sharpe, sum(turnover) / count(*) * 252 AS turnover
 FROM win w JOIN (SELECT unnest(range({YEARS[0]}, {YEARS[1] + 1}))::BIGINT AS year) y ON year(w.dt) < y.year GROUP BY 1, 2),
 pick AS (SELECT * FROM (SELECT *, max(sharpe) OVER (PARTITION BY year) AS best FROM yr) WHERE sharpe >= best - 0.02::DOUBLE QUALIFY row_number() OVER (PARTITION BY year ORDER BY turnover, run_id) = 1)"""


@query(f"WITH RECURSIVE {_GRID}, {_PAST} SELECT year, run_id, round(sharpe, 6) AS sharpe, {r('turnover')} FROM pick")
def yearly_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = study.yearly_choice(_grid_days(spark, sf_dir), *YEARS)
    return got.select("year", "run_id", F.round("sharpe", 6).alias("sharpe"), F.round("turnover", DIGITS).alias("turnover"))


@query(f"""WITH RECURSIVE {_GRID}, {_PAST} SELECT p.year, p.run_id, count(*) AS days, {r("product(1 + ret) - 1", "growth")} FROM win w JOIN pick p ON p.run_id = w.run_id AND p.year = year(w.dt) GROUP BY 1, 2""")
def reselected_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each year's chosen cell earned in that year."""
    days = _grid_days(spark, sf_dir)
    got = study.stitched(days, study.yearly_choice(days, *YEARS)).groupBy("year", "run_id").agg(F.count(F.lit(1)).alias("days"), (F.product(1 + F.col("ret")) - 1).alias("growth"))
    return _out(got, "year", "run_id", "days", "growth")


@query(f"WITH {WEIGHTS} SELECT instrument, dt, {r('avg(w) OVER (PARTITION BY instrument ORDER BY seq ROWS 19 PRECEDING)', 'smooth')} FROM wt")
def smoothed_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(study.smoothed_weights(portfolio.core_weights(tables.panel(spark, sf_dir))), "instrument", "dt", "smooth")


@query(f"WITH {PANEL} SELECT a.dt, {r('a.r', 'a')}, {r('b.r', 'b')}, {r('abs(a.r - b.r)', 'gap')} FROM panel a JOIN panel b USING (dt) WHERE a.instrument = '1' AND b.instrument = '2' ORDER BY abs(a.r - b.r) DESC, a.dt LIMIT 10")
def largest_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.panel(spark, sf_dir)
    return _out(study.largest_gaps(p.where("instrument = '1'"), p.where("instrument = '2'"), "dt", "r"), "dt", "a", "b", "gap")


@query(f"WITH RECURSIVE {DAYS}, {_MEANS}, {_equal_sql('mean')} SELECT strategy, round(m, 6) AS m, {r('target', 'exposure')} FROM eq")
def equal_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each signal's strategy the volatility multiplier of the same mean exposure, and that exposure."""
    weighted, days = _base(spark, sf_dir)
    means = _mean_exposures(weighted, days, _signals(spark, sf_dir, (0.90,)), ("base", "state", "multi"))
    got = study.equal_exposures(weighted, days, means)
    return got.select("strategy", F.round("m", 6).alias("m"), F.round("target", DIGITS).alias("exposure"))


def _side_by_side(days, names):
    """A column of returns for each of the named strategies."""
    return days.groupBy("seq").agg(*(F.max(F.when(F.col("run_id") == n, F.col("ret"))).alias(n) for n in names))


@query()
def bootstrap_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main strategy against each of the eleven others, 10,000 replicates that all pairs share."""
    rivals = ["vol_target_equal", "hmm", "logistic", "constant", "vol_target", "state", "base", "trend", "static", "market", "60_40"]
    df = _side_by_side(_all_days(spark, sf_dir, _fitted_signals(spark, sf_dir, (0.90,))), [MAIN, *rivals])
    return _out(inference.bootstrap_against(df, MAIN, rivals, 10_000), "rival", "measure", "point", "low", "high", "share_below")


@query()
def power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six true differences, 300 repetitions of each, 400 inner replicates, at the evaluation's length."""
    df = _side_by_side(_all_days(spark, sf_dir), [MAIN, "vol_target_equal"])
    pair = df.select("seq", (F.col(MAIN) - portfolio.CASH).alias("a"), (F.col("vol_target_equal") - portfolio.CASH).alias("b"))
    return _out(inference.power_study(pair, (0.0, 0.05, 0.10, 0.15, 0.20, 0.30), 300, 400, pair.count()), "delta", "power", "share_positive")


def _normal_sql(z: str) -> str:
    """The distribution function as a sum of 120 terms, with double factorials from the logarithm of the gamma function."""
    k = "CAST(k AS DOUBLE)"
    term = f"sign({z}) * exp((2 * {k} + 1) * ln(greatest(abs({z}), 1e-300)) - (lgamma(2 * {k} + 2) - {k} * ln(2::DOUBLE) - lgamma({k} + 1)))"
    total = f"(SELECT sum({term}) FROM range(0, 121) t(k))"
    return f"CASE WHEN {z} > 8 THEN 1 WHEN {z} < -8 THEN 0 ELSE 0.5 + {total} * exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) END"


@query(f"WITH {RETURNS}, zs AS (SELECT dt, round((r - avg(r) OVER ()) / stddev_samp(r) OVER (), 9) AS z FROM base) SELECT dt, z, round({_normal_sql('z')}, 7) AS p FROM zs")
def normal_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How usual each day's return would be if returns were normal."""
    market = tables.market(spark, sf_dir)
    moments = market.agg(F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"))
    # one row
    z = market.crossJoin(F.broadcast(moments)).select("dt", F.round((F.col("r") - F.col("mean")) / F.col("sd"), 9).alias("z"))
    return z.select("dt", "z", F.round(normal_cdf(F.col("z")), 7).alias("p"))


_DEFLATED = ORACLE_SQL["deflated_sharpe"]


@query(f"SELECT run_id, round({_normal_sql('z')}, 5) AS probability FROM ({_DEFLATED})")
def deflated_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chance that each cell's true ratio is above the threshold of all trials."""
    return deflated_sharpe(spark, sf_dir).select("run_id", F.round(normal_cdf(F.col("z")), 5).alias("probability"))


_TRIED = (TRIALS, *DECLARED)
_MAIN_CELL = run_id("multi_0.90", 0.8, 0.25)


@query(f"""WITH RECURSIVE {_GRID}, {_metrics_sql('win', 'run_id')}, tv AS (SELECT var_samp(sharpe / sqrt(252)) AS v FROM me), tn AS (SELECT unnest([{", ".join(map(str, _TRIED))}])::BIGINT AS trials),
 wanted AS (SELECT trials, unnest([1 - 1 / trials::DOUBLE, 1 - 1 / (trials * exp(1))]) AS p, unnest([1, 2]) AS part FROM tn),
 bi AS (SELECT trials, part, p, 0 AS k, -8::DOUBLE AS low, 8::DOUBLE AS high FROM wanted UNION ALL
 SELECT trials, part, p, k + 1, CASE WHEN c < p THEN middle ELSE low END, CASE WHEN c < p THEN high ELSE middle END FROM (SELECT *, (low + high) / 2 AS middle, {_normal_sql('((low + high) / 2)')} AS c FROM bi WHERE k < 50)),
 zv AS (SELECT trials, max((low + high) / 2) FILTER (part = 1) AS z1, max((low + high) / 2) FILTER (part = 2) AS z2 FROM bi WHERE k = 50 GROUP BY 1),
 th AS (SELECT trials, sqrt(v) * ((1 - {study.EULER}::DOUBLE) * z1 + {study.EULER}::DOUBLE * z2) AS threshold FROM zv, tv),
 mw AS (SELECT ret - 0.00005::DOUBLE AS x FROM win WHERE run_id = '{_MAIN_CELL}'), mo AS (SELECT avg(x) AS m, stddev_samp(x) AS sd, count(*) AS n FROM mw),
 sh AS (SELECT any_value(m / sd) AS sr, any_value(n) AS n, avg(pow((x - m) / sd, 3)) AS g3, avg(pow((x - m) / sd, 4)) AS g4 FROM mw, mo),
 zz AS (SELECT trials, sr, threshold, (sr - threshold) * sqrt(n - 1) / sqrt(greatest(1 - g3 * sr + (g4 - 1) / 4 * sr * sr, 1e-12)) AS z FROM sh, th)
 SELECT trials, {r('sr')}, {r('threshold')}, round({_normal_sql('z')}, 6) AS probability FROM zz""")
def deflated_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main strategy's ratio, deflated for several numbers of trials, with the variance over the whole grid."""
    days = _grid_days(spark, sf_dir)
    variance = portfolio.metrics(days).agg(F.var_samp(F.col("sharpe") / F.sqrt(F.lit(252))).alias("v"))
    trials = spark.createDataFrame([(n,) for n in _TRIED], "trials long")
    got = study.deflated_sharpe(days.where(F.col("run_id") == _MAIN_CELL), variance, trials)
    return got.select("trials", F.round("sr", DIGITS).alias("sr"), F.round("threshold", DIGITS).alias("threshold"), F.round(normal_cdf(F.col("z")), 6).alias("probability"))


# ---- the main strategy against its rivals


_AGAINST = lambda rival: f"two AS MATERIALIZED (SELECT a.seq, a.ret - 0.00005::DOUBLE AS a, b.ret - 0.00005::DOUBLE AS b FROM win a JOIN win b USING (seq) WHERE a.run_id = '{MAIN}' AND b.run_id = '{rival}')"


def _alpha_sql(lags: int) -> str:
    """Least squares of a on b in `two`, and the score of the intercept with Bartlett weights."""
    sums = [f"sum({i} * {j})" + "".join(f" + {1 - k / (lags + 1)}::DOUBLE * (sum({i} * {j}_{k}) + sum({j} * {i}_{k}))" for k in range(1, lags + 1)) for i, j in (("g0", "g0"), ("g0", "g1"), ("g1", "g1"))]
    return f"""(WITH fit AS (SELECT regr_slope(a, b) AS beta, regr_intercept(a, b) AS alpha, count(*) AS n, sum(b) AS sx, sum(b * b) AS sxx FROM two),
 g AS (SELECT seq, a - alpha - beta * b AS g0, (a - alpha - beta * b) * b AS g1 FROM two, fit), gl AS (SELECT *, {", ".join(f"lag({c}, {k}) OVER (ORDER BY seq) AS {c}_{k}" for c in ("g0", "g1") for k in range(1, lags + 1))} FROM g),
 s AS (SELECT {sums[0]} AS s00, {sums[1]} AS s01, {sums[2]} AS s11 FROM gl)
 SELECT {lags}::BIGINT AS lags, {r('alpha * 252', 'alpha')}, {r('beta')}, round(alpha / sqrt((sxx * sxx * s00 - 2 * sxx * sx * s01 + sx * sx * s11) / pow(n * sxx - sx * sx, 2)), 6) AS t FROM fit, s)"""


def _pair_of(days: DataFrame, rival: str, cash: float = portfolio.CASH) -> DataFrame:
    """(seq, a, b): excess returns of the main strategy and of a rival."""
    of = lambda run, name: F.max(F.when(F.col("run_id") == run, F.col("ret") - cash)).alias(name)
    return days.where(F.col("run_id").isin(MAIN, rival)).groupBy("seq").agg(of(MAIN, "a"), of(rival, "b"))


@query(f"WITH RECURSIVE {_ALL}, {_AGAINST('static')} " + " UNION ALL ".join(f"SELECT * FROM {_alpha_sql(n)}" for n in (20, 60)))
def strategy_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the main strategy earns beyond its share of the core, with errors that allow for 20 and for 60 days of dependence."""
    pair = kept(_pair_of(_all_days(spark, sf_dir), "static").select(F.lit("pair").alias("series_id"), "seq", F.col("a").alias("y"), F.col("b").alias("x")), "pair")
    parts = [inference.newey_west(pair, n).withColumn("lags", F.lit(n).cast("long")) for n in (20, 60)]
    return parts[0].unionByName(parts[1]).select("lags", F.round(F.col("alpha") * 252, DIGITS).alias("alpha"), F.round("beta", DIGITS).alias("beta"), F.round("t_alpha", 6).alias("t"))


_GAMMAS = (1.0, 5.0, 10.0)


@query(f"""WITH RECURSIVE {_ALL}, {_AGAINST('vol_target_equal').replace(" - 0.00005::DOUBLE", "")}, k AS (SELECT gamma, gamma / (2 * (1 + gamma)) AS k FROM (SELECT unnest([{", ".join(f"{g}::DOUBLE" for g in _GAMMAS)}]) AS gamma)),
 m AS (SELECT gamma, k, avg(1 + a) AS mean, avg(1 + a - k * pow(1 + a, 2)) AS ua, avg(1 + b - k * pow(1 + b, 2)) AS ub FROM two, k GROUP BY 1, 2),
 q AS (SELECT gamma, k, 1 - 2 * k * mean AS slope, pow(1 - 2 * k * mean, 2) - 4 * k * (ub - ua) AS disc FROM m)
 SELECT gamma, CASE WHEN disc >= 0 THEN round((sqrt(disc) - slope) / (2 * k) * 252, {DIGITS}) END AS fee FROM q""")
def strategy_fees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What investors of three aversions would pay a year to hold the main strategy instead of the volatility target of equal exposure."""
    pair = kept(_pair_of(_all_days(spark, sf_dir), "vol_target_equal", 0.0), "pair")
    parts = [inference.performance_fee(pair, g).withColumn("gamma", F.lit(g)) for g in _GAMMAS]
    return _out(parts[0].unionByName(parts[1]).unionByName(parts[2]), "gamma", "fee")


_SR = "avg(x) / stddev_samp(x) * sqrt(252)"
_COSTS = (0.0, 0.001, 0.0025)


@query(f"""WITH RECURSIVE {_ALL}, priced AS (SELECT cost, run_id, ret + (0.0005::DOUBLE - cost) * turnover - 0.00005::DOUBLE AS x FROM win, (SELECT unnest([{", ".join(f"{c}::DOUBLE" for c in _COSTS)}]) AS cost)),
 sr AS (SELECT cost, run_id, {_SR} AS sharpe FROM priced GROUP BY 1, 2) SELECT m.cost, o.run_id AS rival, {r('m.sharpe - o.sharpe', 'difference')} FROM sr m JOIN sr o ON m.cost = o.cost AND m.run_id = '{MAIN}' AND o.run_id <> '{MAIN}'""")
def strategy_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of Sharpe ratios between the main strategy and each other one, at three other costs."""
    priced = strategies.at_costs(_all_days(spark, sf_dir), _COSTS)
    each = kept(priced.groupBy("cost", "run_id").agg(study.sharpe(F.col("ret") - portfolio.CASH).alias("sharpe")), "ratios")
    own = each.where(F.col("run_id") == MAIN).select("cost", F.col("sharpe").alias("own"))
    got = each.where(F.col("run_id") != MAIN).join(F.broadcast(own), "cost")  # one row a cost
    return _out(got.select("cost", F.col("run_id").alias("rival"), (F.col("own") - F.col("sharpe")).alias("difference")), "cost", "rival", "difference")


_FITTED = [("hmm", m, react) for m in strategies.MULTIPLIERS for react in strategies.REACTIONS] + [(f"logistic_{q:.2f}", m, react) for q in HIGHS for m in strategies.MULTIPLIERS for react in strategies.REACTIONS]


@query()
def fitted_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 18 cells of the fitted signals: the hidden chain's, and the logistic regression's at both high quantiles."""
    return _out(portfolio.metrics(_grid_days(spark, sf_dir, _FITTED, _fitted_signals(spark, sf_dir))), "run_id", *_MEASURES)


@query()
def study_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All twelve strategies, those of the fitted signals too: measures, ratios of both subperiods, and the ratio at a cost of 0.1 %."""
    days = _all_days(spark, sf_dir, _fitted_signals(spark, sf_dir, (0.90,)))
    parts = study.subperiods(days, SPLIT).groupBy("run_id").agg(*(F.max(F.when(F.col("part") == p, F.col("sharpe"))).alias(f"sharpe_{p}") for p in ("before", "after")))
    costly = strategies.at_costs(days, (0.001,)).groupBy("run_id").agg(study.sharpe(F.col("ret") - portfolio.CASH).alias("sharpe_at_cost"))
    # a row for each strategy
    got = portfolio.metrics(days).join(F.broadcast(parts), "run_id").join(F.broadcast(costly), "run_id")
    return _out(got, "run_id", *_MEASURES, "sharpe_before", "sharpe_after", "sharpe_at_cost")


@query()
def deflated_whole_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of the grid's 57 cells, fitted signals included: its ratio deflated for 57 trials, and for the declared numbers, by the variance over the same 57."""
    signals = _signals(spark, sf_dir).unionByName(_fitted_signals(spark, sf_dir))
    cells = CELLS + _FITTED
    days = _grid_days(spark, sf_dir, cells, signals)
    variance = portfolio.metrics(days).agg(F.var_samp(F.col("sharpe") / F.sqrt(F.lit(252))).alias("v"))
    trials = spark.createDataFrame([(n,) for n in (len(cells), *DECLARED)], "trials long")
    got = study.deflated_sharpe(days, variance, trials)
    return got.select("run_id", "trials", F.round("sr", DIGITS).alias("sr"), F.round("threshold", DIGITS).alias("threshold"), F.round(normal_cdf(F.col("z")), 6).alias("probability"))


@query()
def study_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule fixed beforehand: is the main strategy useful, and is there evidence that its signal adds to a volatility target of equal exposure?"""
    days = _all_days(spark, sf_dir)
    rival, cash = "vol_target_equal", portfolio.CASH
    of = lambda name: F.max(F.when(F.col("run_id") == name, F.col("sharpe")))
    plain = F.col("run_id").isin("market", "60_40", "static")
    measures = portfolio.metrics(days).agg(
        F.max(F.when(F.col("run_id") == MAIN, F.col("drawdown"))).alias("drawdown"), of(MAIN).alias("sharpe"), F.max(F.when(plain, F.col("drawdown"))).alias("least_drawdown"), F.max(F.when(plain, F.col("sharpe"))).alias("best_sharpe")
    )
    costly = strategies.at_costs(days, (0.001,)).groupBy("run_id").agg(study.sharpe(F.col("ret") - cash).alias("sharpe")).agg((of(MAIN) - of(rival)).alias("at_cost"))
    parts = study.subperiods(days, SPLIT).groupBy("part").agg((of(MAIN) - of(rival)).alias("d")).agg(*(F.max(F.when(F.col("part") == p, F.col("d"))).alias(p) for p in ("before", "after")))
    side = lambda name: F.max(F.when(F.col("run_id") == name, F.col("ret"))).alias(name)
    drawn = inference.bootstrap_against(days.groupBy("seq").agg(side(MAIN), side(rival)), MAIN, [rival], 10_000).where("measure = 'sharpe'").select("low", "point")
    # one row each
    table = measures.crossJoin(F.broadcast(costly)).crossJoin(F.broadcast(parts)).crossJoin(F.broadcast(drawn))
    return _out(study.verdict(table), *table.columns, "level_1", "level_2")


_TESTS = ORACLE_SQL["forecast_tests"]


@query(f"SELECT rival, round(2 * (1 - ({_normal_sql('abs(score)')})), 5) AS p_value FROM (SELECT rival, t AS score FROM ({_TESTS}))")
def forecast_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How likely so large a difference of losses would be between forecasts of equal worth."""
    return QUERIES["forecast_tests"](spark, sf_dir).select("rival", F.round(two_sided_p(F.col("t")), 5).alias("p_value"))


# ---- data of charts


PIXELS = 200


def _reduced_sql(source: str, names: str, value: str) -> str:
    """First, least, greatest and last value of each of PIXELS stretches of the days."""
    return f"""SELECT {names}, bucket, {r(f"arg_min({value}, seq)", "first")}, {r(f"min({value})", "low")}, {r(f"max({value})", "high")}, {r(f"arg_max({value}, seq)", "last")}
 FROM (SELECT *, ((seq - min(seq) OVER ()) * {PIXELS} // (max(seq) OVER () - min(seq) OVER () + 1))::BIGINT AS bucket FROM {source} WHERE {value} IS NOT NULL) GROUP BY {names}, bucket"""


@query(f"""WITH RECURSIVE {_GRID}, cap AS (SELECT *, product(1 + ret) OVER (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS capital FROM win WHERE run_id IN ({", ".join(repr(run_id(*c[1:])) for c in _CHOSEN)})),
 fl AS (SELECT *, capital / max(capital) OVER (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING) - 1 AS fall FROM cap),
 lg AS (SELECT 'capital' AS chart, run_id, seq, capital AS value FROM fl UNION ALL SELECT 'drawdown', run_id, seq, fall FROM fl UNION ALL SELECT 'exposure', run_id, seq, exposure FROM fl)
 {_reduced_sql("lg", "chart, run_id", "value")}""")
def chart_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capital, distance from its maximum and exposure of the chosen cells, as many points as a chart has pixels."""
    curves = charts.curves(_grid_days(spark, sf_dir, [c[1:] for c in _CHOSEN]))
    return _out(charts.reduced(curves, ("chart", "run_id"), PIXELS), "chart", "run_id", "bucket", "first", "low", "high", "last")


@query(f"WITH RECURSIVE {STATES}, lg AS (SELECT 'vol' AS chart, seq, vol AS value FROM st UNION ALL SELECT 'stress', seq, (state = 2)::INT::DOUBLE FROM st WHERE state IS NOT NULL) {_reduced_sql('lg', 'chart', 'value')}")
def chart_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The market's volatility, and whether a stretch has days of stress."""
    s = regimes.regimes(tables.market(spark, sf_dir)).withColumn("stress", (F.col("state") == 2).cast("double"))
    return _out(charts.reduced(s.unpivot(["seq"], ["vol", "stress"], "chart", "value"), ("chart",), PIXELS), "chart", "bucket", "first", "low", "high", "last")


_SMOOTH = ", ".join(f"avg(w{n}) OVER (ORDER BY seq ROWS 19 PRECEDING) AS w{n}" for n in multiscale.MEMORIES)


@query(f"WITH sw AS (SELECT seq, {_SMOOTH} FROM {scales_sql('stress')}), lg AS (UNPIVOT sw ON {', '.join(f'w{n}' for n in multiscale.MEMORIES)} INTO NAME scale VALUE value) {_reduced_sql('lg', 'scale', 'value')}")
def chart_scale_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scales' weights, smoothed over 20 days."""
    w = multiscale.stress_probability(tables.market(spark, sf_dir))
    names = [f"w{n}" for n in multiscale.MEMORIES]
    smooth = w.withColumns({c: F.avg(c).over(by_series().rowsBetween(-19, 0)) for c in names})
    return _out(charts.reduced(smooth.unpivot(["seq"], names, "scale", "value"), ("scale",), PIXELS), "scale", "bucket", "first", "low", "high", "last")


_NATIONS = """nc AS (SELECT c_nationkey::VARCHAR AS series_id, o_orderdate::DATE AS dt, sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT AS c FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
 nr AS (SELECT series_id, dt, row_number() OVER w - 2 AS seq, 0.02::DOUBLE * (c - lag(c) OVER w)::DOUBLE / (c + lag(c) OVER w)::DOUBLE AS r FROM nc WINDOW w AS (PARTITION BY series_id ORDER BY dt)),
 nb AS (SELECT *, pow(ln(1 + r), 2) AS x2 FROM nr WHERE seq >= 0),
 ne AS (SELECT series_id, seq, x2 AS v FROM nb WHERE seq = 0 UNION ALL SELECT b.series_id, b.seq, 0.94::DOUBLE * e.v + b.x2 * (1 - 0.94::DOUBLE) FROM ne e JOIN nb b ON b.series_id = e.series_id AND b.seq = e.seq + 1),
 nq AS (SELECT nb.*, round(sqrt(252 * v), 12) AS vol FROM nb JOIN ne USING (series_id, seq)),
 nw AS (SELECT *, count(*) OVER w AS n, round(quantile_cont(vol, 0.4) OVER w, 12) AS lo, round(quantile_cont(vol, 0.9) OVER w, 12) AS hi FROM nq WINDOW w AS (PARTITION BY series_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
 ns AS (SELECT *, CASE WHEN n < 252 THEN NULL WHEN vol > hi THEN 2 WHEN vol <= lo THEN 0 ELSE 1 END AS state FROM nw)"""


@query(f"WITH RECURSIVE {_NATIONS} SELECT series_id, dt, {r('vol')}, state::BIGINT AS state FROM ns")
def nation_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volatility and states of 25 series side by side, a partition each."""
    return _out(regimes.regimes(tables.nations(spark, sf_dir)), "series_id", "dt", "vol", "state")


@query(f"""WITH RECURSIVE {_NATIONS}, np AS (SELECT series_id, lag(state) OVER (PARTITION BY series_id ORDER BY seq) AS previous, state FROM ns)
 SELECT series_id, previous::BIGINT AS previous, state::BIGINT AS state, count(*) AS n FROM np WHERE previous IS NOT NULL AND state IS NOT NULL GROUP BY ALL""")
def nation_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = regimes.regimes(tables.nations(spark, sf_dir)).withColumn("previous", F.lag("state").over(by_series())).where("previous is not null and state is not null")
    return _out(s.groupBy("series_id", "previous", "state").agg(F.count(F.lit(1)).alias("n")), "series_id", "previous", "state", "n")


@query()
def nation_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hidden chain's stress chance of each nation's series."""
    return _out(models.walk_forward_hidden(tables.nations(spark, sf_dir)), "series_id", "dt", "p_hidden")
