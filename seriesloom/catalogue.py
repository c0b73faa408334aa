"""Named queries over the provided tables, and the SQL that must give the same rows.

Results are rounded to 8 decimals on both sides, as sums of doubles depend on their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import bonds
from .operators import chains, inference, models, multiscale, portfolio, regimes, scores, strategies, study
from .sources import tables
from .sources.shared import kept

DIGITS = 8
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _out(df: DataFrame, *columns: str) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*(F.round(c, DIGITS).alias(c) if kinds[c] == "double" else F.col(c).cast("long").alias(c) if kinds[c] in ("int", "boolean") else F.col(c) for c in columns))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add




def r(expression: str, name: str | None = None) -> str:
    return f"round(({expression})::DOUBLE, {DIGITS}) AS {name or expression}"


CENTS = "cents AS (SELECT o_orderdate::DATE AS dt, sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT AS c FROM orders GROUP BY 1)"
RETURNS = f"""{CENTS}, changes AS (SELECT dt, row_number() OVER (ORDER BY dt) - 2 AS seq,
 0.02::DOUBLE * (c - lag(c) OVER (ORDER BY dt))::DOUBLE / (c + lag(c) OVER (ORDER BY dt))::DOUBLE AS r FROM cents),
 base AS (SELECT seq, dt, r, pow(ln(1 + r), 2) AS x2 FROM changes WHERE seq >= 0)"""
VOL = f"""{RETURNS}, e AS (SELECT seq, x2 AS v FROM base WHERE seq = 0 UNION ALL
 SELECT b.seq, 0.94::DOUBLE * e.v + b.x2 * (1 - 0.94::DOUBLE) FROM e JOIN base b ON b.seq = e.seq + 1),
 vols AS (SELECT b.*, round(sqrt(252 * e.v), 12) AS vol FROM base b JOIN e USING (seq))"""
STATES = f"""{VOL}, q AS (SELECT *, count(*) OVER w AS n, round(quantile_cont(vol, 0.4) OVER w, 12) AS lo, round(quantile_cont(vol, 0.9) OVER w, 12) AS hi
 FROM vols WINDOW w AS (ORDER BY seq ROWS UNBOUNDED PRECEDING)),
 st AS (SELECT seq, dt, r, x2, vol, CASE WHEN n >= 252 THEN lo END AS low, CASE WHEN n >= 252 THEN hi END AS high,
 CASE WHEN n < 252 THEN NULL WHEN vol > hi THEN 2 WHEN vol <= lo THEN 0 ELSE 1 END::BIGINT AS state FROM q)"""
_C = ", ".join(f"sum(CASE WHEN previous = {i} AND state = {j} THEN 1 ELSE 0 END) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING)::BIGINT AS c{i}{j}" for i in range(3) for j in range(3))
_P = ", ".join(f"(c{i}{j} + 1.0::DOUBLE) / (c{i}0 + c{i}1 + c{i}2 + 3)::DOUBLE AS p{i}{j}" for i in range(3) for j in range(3))
MATRIX = f"""{STATES}, pr AS (SELECT *, lag(state) OVER (ORDER BY seq) AS previous FROM st), cn AS (SELECT *, {_C} FROM pr), mx AS (SELECT *, {_P} FROM cn)"""


def _power_sql(name: str, rows: str, steps: int) -> str:
    """CTEs name1..nameN with h0..h2 after each step."""
    first = ", ".join(f"CASE state WHEN 0 THEN p0{j} WHEN 1 THEN p1{j} WHEN 2 THEN p2{j} END AS h{j}" for j in range(3))
    parts = [f"{name}1 AS (SELECT *, {first} FROM {rows})"]
    for k in range(2, steps + 1):
        step = ", ".join(" + ".join(f"h{i} * p{i}{j}" for i in range(3)) + f" AS h{j}" for j in range(3))
        parts.append(f"{name}{k} AS (SELECT * EXCLUDE (h0, h1, h2), {step} FROM {name}{k - 1})")
    return ", ".join(parts)


STRESS = f"{MATRIX}, {_power_sql('a', 'mx', 5)}, ps AS (SELECT *, h2 AS p_stress FROM a5)"
OUTCOME = f"{STRESS}, oc AS (SELECT *, CASE WHEN lead(state, 5) OVER (ORDER BY seq) IS NOT NULL THEN (lead(state, 5) OVER (ORDER BY seq) = 2)::INT::DOUBLE END AS y, CASE WHEN state IS NOT NULL THEN (state = 2)::INT::DOUBLE END AS stays, avg(CASE WHEN state IS NOT NULL THEN (state = 2)::INT::DOUBLE END) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS freq FROM ps)"
W5 = "OVER (ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)"
LOSSES = f"""{MATRIX}, cv AS (SELECT *, {", ".join(f"avg(CASE WHEN state = {j} THEN x2 END) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS v{j}" for j in range(3))},
 avg(x2) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS fm, CASE WHEN count(x2) {W5} = 5 THEN avg(x2) {W5} END AS future_x2 FROM mx),
 {_power_sql('b', 'cv', 5)}, fc AS (SELECT cv.*, {" + ".join(f"(b{k}.h0 * b{k}.v0 + b{k}.h1 * b{k}.v1 + b{k}.h2 * b{k}.v2)" for k in range(1, 6))} AS acc
 FROM cv {" ".join(f"JOIN b{k} ON b{k}.seq = cv.seq" for k in range(1, 6))}),
 ff AS (SELECT *, CASE WHEN acc IS NOT NULL THEN greatest(acc / 5, 1e-10::DOUBLE) END AS f_chain, greatest(fm, 1e-10::DOUBLE) AS f_mean FROM fc)"""


def _regimes(spark, sf_dir):
    return regimes.regimes(tables.market(spark, sf_dir))


def _matrices(spark, sf_dir):
    return regimes.transition_matrix(regimes.transition_counts(_regimes(spark, sf_dir)))


def _forecasts(spark, sf_dir):
    return regimes.mean_variance(regimes.future_variance(regimes.chain_variance(regimes.conditional_variance(_matrices(spark, sf_dir)))))


@query(f"WITH {RETURNS} SELECT dt, {r('r')}, {r('x2')} FROM base")
def market_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(regimes.volatility(tables.market(spark, sf_dir)), "dt", "r", "x2")


@query(f"WITH RECURSIVE {VOL} SELECT dt, {r('vol')} FROM vols")
def ewma_vol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(regimes.volatility(tables.market(spark, sf_dir)), "dt", "vol")


@query(f"WITH RECURSIVE {STATES} SELECT dt, {r('vol')}, {r('low')}, {r('high')}, state FROM st")
def regime_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(_regimes(spark, sf_dir), "dt", "vol", "low", "high", "state")


_NAMES = [f"{i}{j}" for i in range(3) for j in range(3)]


@query(f"WITH RECURSIVE {MATRIX} SELECT dt, state, {', '.join(f'c{k}' for k in _NAMES)}, {', '.join(r(f'p{k}') for k in _NAMES)} FROM mx")
def transition_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(_matrices(spark, sf_dir), "dt", "state", *(f"c{k}" for k in _NAMES), *(f"p{k}" for k in _NAMES))


@query(f"WITH RECURSIVE {STRESS} SELECT dt, {r('vol')}, state, {r('p_stress')} FROM ps")
def stress_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(regimes.stress_probability(_matrices(spark, sf_dir)), "dt", "vol", "state", "p_stress")


@query(f"WITH RECURSIVE {LOSSES} SELECT dt, {r('f_chain * 1e4', 'f_chain')}, {r('f_mean * 1e4', 'f_mean')}, {r('future_x2 * 1e4', 'future_x2')} FROM ff")
def chain_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = _forecasts(spark, sf_dir)
    return _out(scaled.withColumns({c: F.col(c) * 1e4 for c in ("f_chain", "f_mean", "future_x2")}), "dt", "f_chain", "f_mean", "future_x2")


def _losses(spark, sf_dir):
    f = _forecasts(spark, sf_dir)
    return f.withColumns({"l_chain": scores.qlike(F.col("future_x2"), F.col("f_chain")), "l_mean": scores.qlike(F.col("future_x2"), F.col("f_mean"))}).dropna(subset=["l_chain", "l_mean"])


_QL = ", ".join(f"future_x2 / f_{m} - ln(future_x2 / f_{m}) - 1 AS l_{m}" for m in ("chain", "mean"))
QLIKE = f"{LOSSES}, ql AS (SELECT seq, {_QL} FROM ff WHERE f_chain IS NOT NULL AND future_x2 > 0)"


@query(f"WITH RECURSIVE {QLIKE} SELECT count(*) AS n, {r('avg(l_chain)', 'chain')}, {r('avg(l_mean)', 'mean')} FROM ql")
def qlike_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(_losses(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.avg("l_chain").alias("chain"), F.avg("l_mean").alias("mean")), "n", "chain", "mean")


_DM = " + ".join(f"2 * {1 - k / 11}::DOUBLE * sum(u * u{k}) / count(*)" for k in range(1, 11))


@query(f"""WITH RECURSIVE {QLIKE}, d AS (SELECT seq, l_chain - l_mean AS d FROM ql), u AS (SELECT seq, d - (SELECT avg(d) FROM d) AS u FROM d),
 g AS (SELECT *, {", ".join(f"lag(u, {k}) OVER (ORDER BY seq) AS u{k}" for k in range(1, 11))} FROM u),
 s AS (SELECT sum(u * u) / count(*) + {_DM} AS s, count(*) AS n FROM g)
 SELECT {r('(SELECT avg(d) FROM d)', 'mean_difference')}, CASE WHEN s > 0 THEN round((SELECT avg(d) FROM d) / sqrt(s / n), 6) END AS t FROM s""")
def diebold_mariano(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scores.diebold_mariano(_losses(spark, sf_dir), "l_chain", "l_mean", 10)
    return got.select(F.round("mean_difference", DIGITS).alias("mean_difference"), F.round("t", 6).alias("t"))


_SC = lambda p: f"pow({p} - y, 2) AS b_{p}, -(y * ln(greatest(least({p}, 0.99::DOUBLE), 0.01::DOUBLE)) + (1 - y) * ln(1 - greatest(least({p}, 0.99::DOUBLE), 0.01::DOUBLE))) AS g_{p}"


@query(f"""WITH RECURSIVE {OUTCOME}, sc AS (SELECT {", ".join(_SC(p) for p in ("p_stress", "stays", "freq"))} FROM oc WHERE y IS NOT NULL AND p_stress IS NOT NULL)
 SELECT {", ".join(r(f"avg({k}_{p})", f"{k}_{p}") for p in ("p_stress", "stays", "freq") for k in "bg")} FROM sc""")
def brier_log_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = regimes.stress_frequency(regimes.stress_probability(_matrices(spark, sf_dir)))
    from .functions.windows import by_series

    ahead = F.lead("state", 5).over(by_series())
    p = p.withColumns({"y": (ahead == 2).cast("double"), "stays": (F.col("state") == 2).cast("double")}).where("y is not null and p_stress is not null")
    names = ("p_stress", "stays", "freq")
    got = p.agg(*(f(F.avg(g(F.col(n), F.col("y")))).alias(f"{k}_{n}") for n in names for k, g, f in (("b", scores.brier, lambda x: x), ("g", scores.log_score, lambda x: x))))
    return _out(got, *got.columns)


EVENTS = """ev AS (SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq,
 CASE WHEN event_type IN ('view', 'click') THEN 0 WHEN event_type IN ('signup', 'purchase') THEN 1 ELSE 2 END AS state FROM events)"""
LAGS = f"{EVENTS}, lg AS (SELECT *, lag(state) OVER w AS s1, lag(state, 2) OVER w AS s2 FROM ev WINDOW w AS (PARTITION BY series_id ORDER BY seq))"
_Z = " + ".join(["1"] + [f"pow(lr / 2, {i}) / {__import__('math').factorial(i)}" for i in range(1, 6)])


@query(f"""WITH {LAGS}, n2 AS (SELECT series_id, s2, s1, state, count(*) AS n FROM lg WHERE s2 IS NOT NULL GROUP BY ALL),
 n1 AS (SELECT series_id, s1, state, sum(n) AS n FROM n2 GROUP BY ALL),
 t2 AS (SELECT series_id, sum(n * ln(n / w)) AS ll2 FROM (SELECT *, (sum(n) OVER (PARTITION BY series_id, s2, s1))::DOUBLE AS w FROM n2) GROUP BY 1),
 t1 AS (SELECT series_id, sum(n * ln(n / w)) AS ll1 FROM (SELECT *, (sum(n) OVER (PARTITION BY series_id, s1))::DOUBLE AS w FROM n1) GROUP BY 1),
 l AS (SELECT series_id, 2 * (ll2 - ll1) AS lr FROM t2 JOIN t1 USING (series_id))
 SELECT series_id, {r('lr')}, 12::BIGINT AS freedom, {r(f"CASE WHEN lr <= 0 THEN 1 ELSE exp(-lr / 2) * ({_Z}) END", 'p_value')} FROM l""")
def order_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(chains.order_test(tables.event_states(spark, sf_dir)), "series_id", "lr", "freedom", "p_value")


ISLANDS = f"""{LAGS}, il AS (SELECT *, sum(CASE WHEN s1 IS NOT DISTINCT FROM state AND seq > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY series_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM lg)"""


@query(f"WITH {ISLANDS} SELECT series_id, seq::BIGINT AS seq, state::BIGINT AS state, row_number() OVER (PARTITION BY series_id, island ORDER BY seq) AS run FROM il")
def run_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(regimes.persistence(tables.event_states(spark, sf_dir)), "series_id", "seq", "state", "run")


@query(f"""WITH {ISLANDS}, rs AS (SELECT series_id, island, state, count(*) AS days FROM il GROUP BY ALL), dn AS (SELECT *, max(island) OVER (PARTITION BY series_id) AS last FROM rs)
 SELECT state::BIGINT AS state, k::BIGINT AS k, {r("avg((days >= k)::INT)", "share")} FROM dn, (VALUES (2), (5), (10)) v(k) WHERE island < last GROUP BY 1, 2""")
def run_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(chains.run_survival(tables.event_states(spark, sf_dir)), "state", "k", "share")


@query(f"WITH {LAGS}, n AS (SELECT s1, count(*) AS n, sum((state = s1)::INT) AS stay FROM lg WHERE s1 IS NOT NULL GROUP BY 1) SELECT s1::BIGINT AS state, k::BIGINT AS k, {r('pow(stay / n, k - 1)', 'share')} FROM n, (VALUES (2), (5), (10)) v(k)")
def geometric_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(chains.geometric_survival(tables.event_states(spark, sf_dir)), "state", "k", "share")


@query(f"WITH {RETURNS} SELECT dt, {', '.join(f'coalesce(date_trunc({u!r}, dt) <> lead(date_trunc({u!r}, dt)) OVER (ORDER BY seq), false)::INT::BIGINT AS {u}_end' for u in ('week', 'month'))} FROM base")
def decision_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = portfolio.period_ends(tables.market(spark, sf_dir), "week").withColumnRenamed("is_end", "week_end")
    return _out(portfolio.period_ends(days, "month").withColumnRenamed("is_end", "month_end"), "dt", "week_end", "month_end")


@query(f"""WITH {RETURNS}, pc AS (SELECT *, product(1 + r) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS price FROM base),
 mn AS (SELECT *, CASE WHEN count(*) OVER w = 200 THEN avg(price) OVER w END AS mean FROM pc WINDOW w AS (ORDER BY seq ROWS 199 PRECEDING))
 SELECT dt, {r('price')}, CASE WHEN price > mean THEN 1 WHEN mean IS NOT NULL THEN 0 END::BIGINT AS above FROM mn""")
def trend_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(portfolio.trend(tables.market(spark, sf_dir)), "dt", "price", "above")


PANEL_CENTS = """own AS (SELECT left(o_orderpriority, 1) AS instrument, o_orderdate::DATE AS dt, sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT AS c FROM orders GROUP BY 1, 2),
 grid AS (SELECT dt, instrument FROM (SELECT DISTINCT o_orderdate::DATE AS dt FROM orders), (SELECT DISTINCT instrument FROM own)),
 pcents AS (SELECT g.instrument, g.dt, o.c FROM grid g ASOF LEFT JOIN own o ON g.instrument = o.instrument AND g.dt >= o.dt)"""
PANEL = f"""{PANEL_CENTS}, pch AS (SELECT *, 0.02::DOUBLE * (c - lag(c) OVER w)::DOUBLE / (c + lag(c) OVER w)::DOUBLE AS r FROM pcents WINDOW w AS (PARTITION BY instrument ORDER BY dt)),
 start AS (SELECT min(dt) AS s FROM (SELECT dt FROM pch GROUP BY dt HAVING count(r) = count(*))),
 panel AS (SELECT instrument, dt, r, row_number() OVER (PARTITION BY instrument ORDER BY dt) - 1 AS seq FROM pch WHERE dt >= (SELECT s FROM start))"""
WEIGHTS = f"""{PANEL}, iv AS (SELECT *, CASE WHEN count(r) OVER w = 60 AND stddev_samp(r) OVER w > 0 THEN 1 / stddev_samp(r) OVER w END AS inv FROM panel WINDOW w AS (PARTITION BY instrument ORDER BY seq ROWS 59 PRECEDING)),
 wt AS (SELECT instrument, seq, dt, r, inv / sum(inv) OVER (PARTITION BY seq) AS w FROM iv)"""


@query(f"WITH {PANEL_CENTS} SELECT instrument, dt, c FROM pcents")
def asof_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.panel_cents(spark, sf_dir).select("instrument", "dt", "c")


@query(f"WITH {PANEL_CENTS} SELECT g.instrument, count(*) AS missing, min(g.dt) AS first_missing FROM grid g ANTI JOIN own o ON g.instrument = o.instrument AND g.dt = o.dt GROUP BY 1")
def calendar_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.substring("o_orderpriority", 1, 1).alias("instrument"), F.to_date("o_orderdate").alias("dt")).distinct()
    grid = orders.select("dt").distinct().crossJoin(F.broadcast(orders.select("instrument").distinct()))
    return grid.join(orders, ["instrument", "dt"], "left_anti").groupBy("instrument").agg(F.count(F.lit(1)).alias("missing"), F.min("dt").alias("first_missing"))


@query(f"WITH {WEIGHTS} SELECT instrument, dt, {r('w')} FROM wt")
def core_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(portfolio.core_weights(tables.panel(spark, sf_dir)), "instrument", "dt", "w")


CORE_VOL = f"""{WEIGHTS}, cp AS (SELECT a.seq, a.dt, a.w AS wi, b.w AS wj, CASE WHEN count(a.r) OVER w = 60 THEN covar_samp(a.r, b.r) OVER w END AS c
 FROM wt a JOIN wt b ON a.seq = b.seq WINDOW w AS (PARTITION BY a.instrument, b.instrument ORDER BY a.seq ROWS 59 PRECEDING)),
 core AS (SELECT seq, dt, CASE WHEN count(wi) = count(*) THEN sqrt(252 * sum(wi * wj * c)) END AS core_vol FROM cp GROUP BY seq, dt)"""


@query(f"WITH {CORE_VOL} SELECT dt, {r('core_vol')} FROM core")
def core_vol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(portfolio.core_volatility(portfolio.core_weights(tables.panel(spark, sf_dir))), "dt", "core_vol")


@query(f"WITH {PANEL} SELECT a.instrument AS i, b.instrument AS j, {r('corr(a.r, b.r)', 'corr')} FROM panel a JOIN panel b USING (seq) GROUP BY 1, 2")
def correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.panel(spark, sf_dir)
    two = p.select("seq", F.col("instrument").alias("j"), F.col("r").alias("rj"))
    return _out(p.join(two, "seq").groupBy(F.col("instrument").alias("i"), "j").agg(F.corr("r", "rj").alias("corr")), "i", "j", "corr")


def _sim_sql() -> str:
    """The simulator as a recursion over days, with one holding for each instrument: independent of the windows that it checks."""
    k = range(1, 6)
    wide = ", ".join(f"max(r) FILTER (instrument = '{i}') AS r{i}, max(w) FILTER (instrument = '{i}') AS w{i}" for i in k)
    gross = " + ".join(f"s.h{i} * p.r{i}" for i in k)
    total = " + ".join(f"s.h{i}" for i in k)
    drift = {i: f"(s.h{i} * (1 + p.r{i}) / (1 + ({gross} + (1 - ({total})) * 0.00005::DOUBLE)))" for i in k}
    turn = " + ".join(f"abs(s.t{i} - {drift[i]})" for i in k)
    return f"""{WEIGHTS}, pv AS MATERIALIZED (SELECT seq, any_value(dt) AS dt, {wide}, coalesce(date_trunc('week', any_value(dt)) <> lead(date_trunc('week', any_value(dt))) OVER (ORDER BY seq), false) AND count(w) = 5 AS ord FROM wt GROUP BY seq),
 sim AS (SELECT -1::BIGINT AS seq, false AS pending, 0::DOUBLE AS ret, 0::DOUBLE AS turnover, 0::DOUBLE AS exposure, {", ".join(f"0::DOUBLE AS h{i}, 0::DOUBLE AS t{i}" for i in k)}
 UNION ALL SELECT p.seq, p.ord, ({gross} + (1 - ({total})) * 0.00005::DOUBLE) - CASE WHEN s.pending THEN 0.0005::DOUBLE * ({turn}) ELSE 0 END,
 CASE WHEN s.pending THEN {turn} ELSE 0 END, {total}, {", ".join(f"CASE WHEN s.pending THEN s.t{i} ELSE {drift[i]} END, coalesce(p.w{i}, 0)" for i in k)} FROM sim s JOIN pv p ON p.seq = s.seq + 1)"""


def _core_run(spark, sf_dir):
    weighted = portfolio.core_weights(tables.panel(spark, sf_dir))
    days = portfolio.period_ends(weighted.select("seq", "dt").distinct().withColumn("series_id", F.lit("core")), "week").select("seq", F.col("is_end").alias("decide"))
    return portfolio.simulate(weighted.join(days, "seq").withColumn("run_id", F.lit("core")))


@query(f"WITH RECURSIVE {_sim_sql()} SELECT seq, {r('ret')}, {r('turnover')}, {r('exposure')} FROM sim WHERE seq >= 0")
def simulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(_core_run(spark, sf_dir).withColumn("seq", F.col("seq").cast("long")), "seq", "ret", "turnover", "exposure")


@query(f"""WITH RECURSIVE {_sim_sql()}, cap AS (SELECT *, product(1 + ret) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS capital FROM sim WHERE seq >= 0),
 fl AS (SELECT *, capital / greatest(1, max(capital) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING)) - 1 AS fall FROM cap)
 SELECT {r("avg(ret - 0.00005::DOUBLE) / stddev_samp(ret - 0.00005::DOUBLE) * sqrt(252)", "sharpe")}, {r("pow(product(1 + ret), 252 / count(*)) - 1", "growth")}, {r("stddev_samp(ret) * sqrt(252)", "vol")},
 {r("min(fall)", "drawdown")}, {r("sum(turnover) / (count(*) / 252)", "turnover")}, {r("avg(exposure)", "exposure")} FROM fl""")
def strategy_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = portfolio.metrics(_core_run(spark, sf_dir))
    return _out(got, *(c for c in got.columns if c != "run_id"))


@query(f"WITH {RETURNS} SELECT count(*) AS n, count(*) FILTER (abs(r) > 0.015) AS outliers, min(dt) AS first_day, {r('avg(r) * 252', 'mean')}, {r('stddev_samp(r) * sqrt(252)', 'deviation')}, {r('min(r)', 'least')}, {r('max(r)', 'greatest')} FROM base")
def data_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = tables.market(spark, sf_dir).agg(F.count("r").alias("n"), F.count_if(F.abs("r") > 0.015).alias("outliers"), F.min("dt").alias("first_day"), (F.avg("r") * 252).alias("mean"), (F.stddev_samp("r") * F.sqrt(F.lit(252))).alias("deviation"), F.min("r").alias("least"), F.max("r").alias("greatest"))
    return _out(got, *got.columns)


@query(f"""WITH RECURSIVE {STATES}, pv AS (SELECT *, lag(state) OVER (ORDER BY seq) AS before FROM st)
 SELECT before::BIGINT AS state, {r("count(*) / (SELECT count(before) FROM pv)", "share")}, {r("avg(r - 0.00005::DOUBLE) * 252", "mean_excess")}, {r("stddev_samp(r - 0.00005::DOUBLE) * sqrt(252)", "deviation")} FROM pv WHERE before IS NOT NULL GROUP BY 1""")
def regime_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .functions.windows import by_series

    s = _regimes(spark, sf_dir).withColumn("before", F.lag("state").over(by_series())).where("before is not null")
    got = s.groupBy(F.col("before").alias("state")).agg(F.count(F.lit(1)).alias("n"), (F.avg(F.col("r") - 0.00005) * 252).alias("mean_excess"), (F.stddev_samp(F.col("r") - 0.00005) * F.sqrt(F.lit(252))).alias("deviation"))
    # three rows
    return _out(got.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy())), "state", "share", "mean_excess", "deviation")


# ---- grids, costs and placebo runs

_CELLS = ", ".join(f"('c{i}', {m}::DOUBLE, {react}::DOUBLE)" for i, (m, react) in enumerate((m, react) for m in strategies.MULTIPLIERS for react in strategies.REACTIONS))


def _grid_sql() -> str:
    """All cells' simulations as one recursion over days."""
    k = range(1, 6)
    wide = ", ".join(f"max(r) FILTER (instrument = '{i}') AS r{i}, max(w) FILTER (instrument = '{i}') AS w{i}" for i in k)
    gross = " + ".join(f"s.h{i} * p.r{i}" for i in k)
    total = " + ".join(f"s.h{i}" for i in k)
    drift = {i: f"(s.h{i} * (1 + p.r{i}) / (1 + ({gross} + (1 - ({total})) * 0.00005::DOUBLE)))" for i in k}
    turn = " + ".join(f"abs(s.t{i} - {drift[i]})" for i in k)
    return f"""{STRESS}, {CORE_VOL}, reference AS (SELECT median(core_vol) AS reference FROM core WHERE seq BETWEEN 59 AND 503),
 cells(run_id, m, react) AS (VALUES {_CELLS}),
 pv AS (SELECT seq, any_value(dt) AS dt, {wide}, count(w) = 5 AS whole FROM wt GROUP BY seq),
 od AS (SELECT *, coalesce(date_trunc('week', dt) <> lead(date_trunc('week', dt)) OVER (ORDER BY seq), false) AND seq >= 504 AS week_end FROM pv),
 raw AS (SELECT run_id, od.*, m * reference * (1 - (1 - react) * p_stress) / core_vol AS x FROM od JOIN core USING (seq) LEFT JOIN ps ON ps.dt = od.dt, reference, cells),
 runs AS MATERIALIZED (SELECT * EXCLUDE ({", ".join(f"w{i}" for i in k)}), {", ".join(f"CASE WHEN x IS NOT NULL THEN w{i} * least(x, 1) END AS w{i}" for i in k)} FROM raw),
 sim AS (SELECT run_id, -1::BIGINT AS seq, false AS pending, 0::DOUBLE AS ret, 0::DOUBLE AS turnover, 0::DOUBLE AS exposure, {", ".join(f"0::DOUBLE AS h{i}, 0::DOUBLE AS t{i}" for i in k)} FROM cells
 UNION ALL SELECT p.run_id, p.seq, p.week_end AND p.whole AND p.x IS NOT NULL, ({gross} + (1 - ({total})) * 0.00005::DOUBLE) - CASE WHEN s.pending THEN 0.0005::DOUBLE * ({turn}) ELSE 0 END,
 CASE WHEN s.pending THEN {turn} ELSE 0 END, {total}, {", ".join(f"CASE WHEN s.pending THEN s.t{i} ELSE {drift[i]} END, coalesce(p.w{i}, 0)" for i in k)} FROM sim s JOIN runs p ON p.seq = s.seq + 1 AND p.run_id = s.run_id)"""


def _metrics_sql(source: str, key: str) -> str:
    return f"""cap AS (SELECT *, product(1 + ret) OVER (PARTITION BY {key} ORDER BY seq ROWS UNBOUNDED PRECEDING) AS capital FROM {source} WHERE seq >= 0),
 fl AS (SELECT *, capital / greatest(1, max(capital) OVER (PARTITION BY {key} ORDER BY seq ROWS UNBOUNDED PRECEDING)) - 1 AS fall FROM cap),
 me AS (SELECT {key}, avg(ret - 0.00005::DOUBLE) / stddev_samp(ret - 0.00005::DOUBLE) * sqrt(252) AS sharpe, pow(product(1 + ret), 252 / count(*)) - 1 AS growth,
 stddev_samp(ret) * sqrt(252) AS vol, min(fall) AS drawdown, sum(turnover) / (count(*) / 252) AS turnover, avg(exposure) AS exposure FROM fl GROUP BY 1)"""


_MEASURES = ("sharpe", "growth", "vol", "drawdown", "turnover", "exposure")


def weights_and_core(spark, sf_dir):
    """The panel's core weights and the core's volatility: written once, as all that is simulated reads them several times."""
    weighted = kept(portfolio.core_weights(study.complete(tables.panel(spark, sf_dir))), "weights")
    return weighted, kept(portfolio.core_volatility(weighted), "core")


def _grid_runs(spark, sf_dir):
    weighted, core = weights_and_core(spark, sf_dir)
    return weighted, kept(strategies.signal_days(core, regimes.stress_probability(_matrices(spark, sf_dir))), "days")


def _grid_levels(spark, sf_dir):
    weighted, days = _grid_runs(spark, sf_dir)
    return weighted, strategies.run_levels(days, strategies.grid(spark))


@query(f"WITH RECURSIVE {_grid_sql()}, {_metrics_sql('sim', 'run_id')} SELECT run_id, {', '.join(r(c) for c in _MEASURES)} FROM me")
def grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(portfolio.metrics(portfolio.simulate_levels(*_grid_levels(spark, sf_dir))), "run_id", *_MEASURES)


@query(f"WITH RECURSIVE {_grid_sql()}, {_metrics_sql('sim', 'run_id')} SELECT run_id, {r('sharpe')}, {r('turnover')} FROM (SELECT * FROM me WHERE sharpe >= (SELECT max(sharpe) FROM me) - 0.02) QUALIFY row_number() OVER (ORDER BY turnover, run_id) = 1")
def chosen_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = portfolio.metrics(portfolio.simulate_levels(*_grid_levels(spark, sf_dir)))
    return _out(strategies.choose(table), "run_id", "sharpe", "turnover")


@query(f"""WITH RECURSIVE {_sim_sql()}, priced AS (SELECT cost, seq, ret + (0.0005::DOUBLE - cost) * turnover AS ret, turnover, exposure FROM sim, (VALUES (0::DOUBLE), (0.001::DOUBLE), (0.0025::DOUBLE)) c(cost)),
 {_metrics_sql('priced', 'cost')} SELECT cost, {', '.join(r(c) for c in _MEASURES)} FROM me""")
def cost_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(portfolio.metrics(strategies.at_costs(_core_run(spark, sf_dir), (0.0, 0.001, 0.0025)), keys=("cost",)), "cost", *_MEASURES)


#: Placebo runs.
PLACEBOS = 1000


@query()
def placebo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signal's Sharpe ratio in the evaluation, and the share of its cyclic shifts that do as well."""
    weighted, days = _grid_runs(spark, sf_dir)
    known = days.where("p_stress is not null").count()
    drawn = [("s0", 0)] + [(f"s{i + 1}", step) for i, step in enumerate(study.placebo_steps(known, PLACEBOS))]
    shifted = strategies.cyclic_shifts(days, spark.createDataFrame(drawn, "run_id string, step long"))
    levels = portfolio.exposure(shifted.withColumns({"m": F.lit(0.8), "react": F.lit(0.25)}))
    got = study.window(portfolio.simulate_levels(weighted, levels)).groupBy("run_id").agg(study.sharpe(F.col("ret") - portfolio.CASH).alias("sharpe"))
    # a row for each run
    own = F.max(F.when(F.col("run_id") == "s0", F.col("sharpe"))).over(Window.partitionBy())
    each = got.withColumn("own", own).where("run_id <> 's0'")
    return _out(each.agg(F.first("own").alias("sharpe"), F.avg((F.col("sharpe") >= F.col("own")).cast("double")).alias("share_as_good")), "sharpe", "share_as_good")


# ---- inference

PAIR = f"{PANEL}, two AS (SELECT a.seq, a.r AS a, b.r AS b FROM panel a JOIN panel b ON a.seq = b.seq WHERE a.instrument = '1' AND b.instrument = '2')"


def _pair(spark, sf_dir):
    p = tables.panel(spark, sf_dir)
    return p.where("instrument = '1'").select("seq", F.col("r").alias("a")).join(p.where("instrument = '2'").select("seq", F.col("r").alias("b")), "seq")


_LAGS = 20
_NW = {(i, j): f"sum({i} * {j})" + "".join(f" + {1 - k / (_LAGS + 1)}::DOUBLE * (sum({i} * {j}_{k}) + sum({j} * {i}_{k}))" for k in range(1, _LAGS + 1)) for i, j in (("g0", "g0"), ("g0", "g1"), ("g1", "g1"))}


@query(f"""WITH {PAIR}, fit AS (SELECT regr_slope(a, b) AS beta, regr_intercept(a, b) AS alpha, count(*) AS n, sum(b) AS sx, sum(b * b) AS sxx FROM two),
 g AS (SELECT seq, a - alpha - beta * b AS g0, (a - alpha - beta * b) * b AS g1 FROM two, fit),
 gl AS (SELECT *, {", ".join(f"lag({c}, {k}) OVER (ORDER BY seq) AS {c}_{k}" for c in ("g0", "g1") for k in range(1, _LAGS + 1))} FROM g),
 s AS (SELECT {_NW["g0", "g0"]} AS s00, {_NW["g0", "g1"]} AS s01, {_NW["g1", "g1"]} AS s11 FROM gl),
 v AS (SELECT *, sqrt((sxx * sxx * s00 - 2 * sxx * sx * s01 + sx * sx * s11) / pow(n * sxx - sx * sx, 2)) AS se FROM fit, s)
 SELECT {r('alpha * 252', 'alpha')}, {r('beta')}, round(alpha / se, 6) AS t_alpha FROM v""")
def newey_west(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = inference.newey_west(_pair(spark, sf_dir).select(F.lit("pair").alias("series_id"), "seq", F.col("a").alias("y"), F.col("b").alias("x")), _LAGS)
    return got.select(F.round(F.col("alpha") * 252, DIGITS).alias("alpha"), F.round("beta", DIGITS).alias("beta"), F.round("t_alpha", 6).alias("t_alpha"))


_K = 5 / 12


@query(f"""WITH {PAIR}, m AS (SELECT avg(1 + a) AS mean, avg(1 + a - {_K}::DOUBLE * pow(1 + a, 2)) AS ua, avg(1 + b - {_K}::DOUBLE * pow(1 + b, 2)) AS ub FROM two),
 q AS (SELECT 1 - 2 * {_K}::DOUBLE * mean AS slope, pow(1 - 2 * {_K}::DOUBLE * mean, 2) - 4 * {_K}::DOUBLE * (ub - ua) AS disc FROM m)
 SELECT CASE WHEN disc >= 0 THEN round((sqrt(disc) - slope) / (2 * {_K}::DOUBLE) * 252, {DIGITS}) END AS fee FROM q""")
def performance_fee(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(inference.performance_fee(_pair(spark, sf_dir), 5.0), "fee")


#: Replicates of the bootstrap query that SQL repeats; bootstrap_study draws all 10,000, for all rivals.
REPLICATES = 200


def _draw_sql(salt: int) -> str:
    x = f"((rep * {inference.STEP_REP} + pos * {inference.STEP_POS} + {salt * inference.STEP_SALT + 1}) % {inference.MODULUS})"
    for _ in range(2):
        x = f"((({x} * {x}) % {inference.MODULUS} * {inference.MULTIPLIER} + 11) % {inference.MODULUS})"
    return x


@query(f"""WITH {PAIR}, sz AS (SELECT count(*)::BIGINT AS n FROM two), cells AS (SELECT rep::BIGINT AS rep, pos::BIGINT AS pos, n FROM sz, range({REPLICATES}) t(rep), range((SELECT n FROM sz)) p(pos)),
 begun AS (SELECT rep, pos, n, CASE WHEN pos = 0 OR {_draw_sql(1)} * 20 < {inference.MODULUS} THEN pos END AS head, {_draw_sql(2)} % n AS spot FROM cells),
 filled AS (SELECT rep, pos, n, last_value(head IGNORE NULLS) OVER w AS head, last_value(CASE WHEN head IS NOT NULL THEN spot END IGNORE NULLS) OVER w AS spot FROM begun WINDOW w AS (PARTITION BY rep ORDER BY pos ROWS UNBOUNDED PRECEDING)),
 drawn AS (SELECT rep, pos, a, b FROM filled JOIN two ON two.seq = (spot + pos - head) % n UNION ALL SELECT -1, seq, a, b FROM two),
 val AS (SELECT *, product(1 + a) OVER w AS va, product(1 + b) OVER w AS vb FROM drawn WINDOW w AS (PARTITION BY rep ORDER BY pos ROWS UNBOUNDED PRECEDING)),
 low AS (SELECT *, va / greatest(1, max(va) OVER w) - 1 AS fa, vb / greatest(1, max(vb) OVER w) - 1 AS fb FROM val WINDOW w AS (PARTITION BY rep ORDER BY pos ROWS UNBOUNDED PRECEDING)),
 each AS (SELECT rep, (avg(a - 0.00005::DOUBLE) / stddev_samp(a - 0.00005::DOUBLE) - avg(b - 0.00005::DOUBLE) / stddev_samp(b - 0.00005::DOUBLE)) * sqrt(252) AS sharpe, min(fa) - min(fb) AS drawdown FROM low GROUP BY 1),
 long AS (SELECT rep, 'sharpe' AS measure, sharpe AS value FROM each UNION ALL SELECT rep, 'drawdown', drawdown FROM each)
 SELECT measure, {r("max(value) FILTER (rep < 0)", "point")}, {r("quantile_cont(value, 0.025) FILTER (rep >= 0)", "low")}, {r("quantile_cont(value, 0.975) FILTER (rep >= 0)", "high")},
 {r("avg((value <= 0)::INT) FILTER (rep >= 0)", "share_below")} FROM long GROUP BY 1""")
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(inference.paired_bootstrap(_pair(spark, sf_dir), REPLICATES), "measure", "point", "low", "high", "share_below")


# ---- further forecasts; recursions and fits that SQL doesn't express are held against plain versions in tests


def scales_sql(kind: str, high: float = regimes.HIGH, rate: float = multiscale.RATE, discount: float = multiscale.DISCOUNT) -> str:
    """A query (seq, dt, value, w5, w15, w42) of the scales' combined forecasts: kind is stress or variance."""
    source, value = (STRESS, "p_stress") if kind == "stress" else (LOSSES, "f_chain")
    each = lambda n: f"SELECT seq, dt, state, {value} AS p, {'NULL' if kind == 'stress' else 'future_x2'} AS realised FROM (WITH RECURSIVE {source.replace('0.94::DOUBLE', f'{1 - 2 / (n + 1)!r}::DOUBLE').replace('quantile_cont(vol, 0.9)', f'quantile_cont(vol, {high})')} SELECT * FROM {'ps' if kind == 'stress' else 'ff'})"
    clipped = "greatest(least(p, 0.99::DOUBLE), 0.01::DOUBLE)"
    loss = f"-(y * ln({clipped}) + (1 - y) * ln(1 - {clipped}))" if kind == "stress" else "CASE WHEN realised > 0 THEN realised / p - ln(realised / p) - 1 END"
    scales = multiscale.MEMORIES
    return f"""(WITH RECURSIVE {", ".join(f"sc{n} AS MATERIALIZED ({each(n)})" for n in scales)}, sc AS ({" UNION ALL ".join(f"SELECT {n} AS scale, * FROM sc{n}" for n in scales)}),
 ev AS (SELECT seq, CASE WHEN lead(state, 5) OVER (ORDER BY seq) IS NOT NULL THEN (lead(state, 5) OVER (ORDER BY seq) = 2)::INT::DOUBLE END AS y FROM sc{multiscale.COMMON}),
 ls AS MATERIALIZED (SELECT scale, seq, dt, p, {loss} AS loss FROM sc JOIN ev USING (seq)), kn AS (SELECT scale, seq, loss, row_number() OVER (PARTITION BY scale ORDER BY seq) - 1 AS k FROM ls WHERE loss IS NOT NULL),
 em AS (SELECT scale, seq, k, loss AS m FROM kn WHERE k = 0 UNION ALL SELECT kn.scale, kn.seq, kn.k, {discount}::DOUBLE * em.m + (1 - {discount}::DOUBLE) * kn.loss FROM em JOIN kn ON kn.scale = em.scale AND kn.k = em.k + 1),
 mm AS (SELECT ls.*, last_value(m IGNORE NULLS) OVER (PARTITION BY ls.scale ORDER BY ls.seq) AS mean FROM ls LEFT JOIN em ON em.scale = ls.scale AND em.seq = ls.seq),
 lt AS (SELECT *, lag(mean, 5) OVER (PARTITION BY scale ORDER BY seq) AS late FROM mm), ff AS (SELECT *, last_value(late IGNORE NULLS) OVER (PARTITION BY scale ORDER BY seq) AS late_known FROM lt),
 fl AS (SELECT *, coalesce(late_known, avg(late_known) OVER (PARTITION BY seq)) AS filled FROM ff), ex AS (SELECT *, exp(-{rate}::DOUBLE * (filled - min(filled) OVER (PARTITION BY seq))) AS e FROM fl),
 wg AS (SELECT *, coalesce(e / sum(e) OVER (PARTITION BY seq), 1 / {len(scales)}::DOUBLE) AS weight FROM ex)
 SELECT seq, dt, CASE WHEN count(p) = {len(scales)} THEN sum(p * weight) END AS value, {", ".join(f"max(weight) FILTER (scale = {n}) AS w{n}" for n in scales)} FROM wg GROUP BY seq, dt)"""


_SCALE_WEIGHTS = ", ".join(r(f"w{n}") for n in multiscale.MEMORIES)


@query(f"SELECT dt, {r('value', 'p_stress')}, {_SCALE_WEIGHTS} FROM {scales_sql('stress')}")
def multiscale_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(multiscale.stress_probability(tables.market(spark, sf_dir)), "dt", "p_stress", "w5", "w15", "w42")


@query(f"SELECT dt, {r('value * 1e4', 'f_multi')}, {_SCALE_WEIGHTS} FROM {scales_sql('variance')}")
def multiscale_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(multiscale.variance(tables.market(spark, sf_dir)).withColumn("f_multi", F.col("f_multi") * 1e4), "dt", "f_multi", "w5", "w15", "w42")


def _har_sql() -> str:
    """CTEs up to har (seq, dt, f): normal equations as running sums, solved by elimination."""
    h = [f"h{i}" for i in range(4)]
    past = "OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 5 PRECEDING)"
    sums = [f"sum(CASE WHEN whole THEN h{i} * h{j} ELSE 0 END) {past} AS a0_{i}_{j}" for i in range(4) for j in range(4)] + [f"sum(CASE WHEN whole THEN h{i} * label * 1e4 ELSE 0 END) {past} AS b0_{i}" for i in range(4)]
    parts = [f"""hx AS (SELECT seq, dt, x2, CASE WHEN count(x2) {W5} = 5 THEN avg(x2) {W5} END AS label, 1::DOUBLE AS h0, x2 * 1e4 AS h1,
 {", ".join(f"CASE WHEN count(x2) OVER (ORDER BY seq ROWS {n - 1} PRECEDING) = {n} THEN avg(x2) OVER (ORDER BY seq ROWS {n - 1} PRECEDING) * 1e4 END AS h{i}" for i, n in ((2, 5), (3, 22)))} FROM base)""",
        f"hw AS (SELECT *, label IS NOT NULL AND h3 IS NOT NULL AS whole FROM hx)", f"e0 AS (SELECT *, count(*) FILTER (whole) {past} AS n, {', '.join(sums)} FROM hw)"]
    for k in range(3):
        rest = [f"a{k}_{i}_{j} - a{k}_{i}_{k} / a{k}_{k}_{k} * a{k}_{k}_{j} AS a{k + 1}_{i}_{j}" for i in range(k + 1, 4) for j in range(k + 1, 4)]
        parts.append(f"e{k + 1} AS (SELECT *, {', '.join(rest + [f'b{k}_{i} - a{k}_{i}_{k} / a{k}_{k}_{k} * b{k}_{k} AS b{k + 1}_{i}' for i in range(k + 1, 4)])} FROM e{k})")
    for k in reversed(range(4)):
        parts.append(f"s{k} AS (SELECT *, (b{k}_{k}{''.join(f' - a{k}_{k}_{j} * x_{j}' for j in range(k + 1, 4))}) / a{k}_{k}_{k} AS x_{k} FROM {'e3' if k == 3 else f's{k + 1}'})")
    whole = " * ".join(f"(a{k}_{k}_{k} / a0_{k}_{k})" for k in range(4))
    parts.append(f"har AS (SELECT seq, dt, CASE WHEN n >= 250 AND abs({whole}) > 1e-14 AND h3 IS NOT NULL THEN greatest(({' + '.join(f'x_{i} * {c}' for i, c in enumerate(h))}) / 1e4, 1e-10) END AS f FROM s0)")
    return ", ".join(parts)


@query(f"WITH {RETURNS}, {_har_sql()} SELECT dt, {r('f * 1e4', 'f_har')} FROM har")
def har_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(multiscale.har(regimes.volatility(tables.market(spark, sf_dir))).withColumn("f_har", F.col("f_har") * 1e4), "dt", "f_har")


@query()
def logistic_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(models.walk_forward_logistic(_regimes(spark, sf_dir)), "seq", "p_logistic")


@query()
def hidden_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(models.walk_forward_hidden(tables.market(spark, sf_dir)), "dt", "p_hidden")


def _price_sql(y: str) -> str:
    return f"(y0 / ({y}) * (1 - pow(1 / (1 + ({y}) / 2), 14)) + pow(1 / (1 + ({y}) / 2), 14))"


_UP, _DOWN = _price_sql("y0 + 0.0001::DOUBLE"), _price_sql("y0 - 0.0001::DOUBLE")


@query(f"""WITH {CENTS}, yd AS (SELECT dt, 0.02::DOUBLE + 0.03::DOUBLE * (c % 1000) / 1000 AS y FROM cents),
 yl AS (SELECT dt, y, lag(y) OVER (ORDER BY dt) AS y0, date_diff('day', lag(dt) OVER (ORDER BY dt), dt) AS days FROM yd)
 SELECT dt, round(y0 * days / 365 - ({_DOWN} - {_UP}) / 0.0002::DOUBLE * (y - y0) + ({_UP} - 2 + {_DOWN}) / 0.00000001::DOUBLE / 2 * (y - y0) * (y - y0), 7) AS r FROM yl WHERE y0 IS NOT NULL""")
def bond_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = tables.market_cents(spark, sf_dir).select("series_id", F.row_number().over(Window.partitionBy("series_id").orderBy("dt")).alias("seq"), "dt", (F.lit(0.02) + F.lit(0.03) * (F.col("c") % 1000) / 1000).alias("y"))
    return bonds.bond_returns(y).select("dt", F.round("r", 7).alias("r"))


from . import catalogue_forecasts, catalogue_sources, catalogue_study  # noqa: E402, F401  add their queries to the two tables above
