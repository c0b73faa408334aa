"""Inference on return series: robust regression and the stationary bootstrap."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import running

DAYS = 252
#: Fixed values of the counter-based generator: a prime modulus and the multipliers of its rounds.
MODULUS, STEP_REP, STEP_POS, STEP_SALT, MULTIPLIER = 2147483647, 2654435, 40503, 104729, 48271


def newey_west(df: DataFrame, lags: int, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """(keys, alpha, beta, se_alpha, t_alpha): least squares of y on x, errors with Bartlett weights and no correction for freedom."""
    w, by = Window.partitionBy(*keys).orderBy("seq"), Window.partitionBy(*keys)
    known = df.where("x is not null and y is not null").withColumns({"mx": F.avg("x").over(by), "my": F.avg("y").over(by)})
    fit = known.groupBy(*keys).agg((F.covar_pop("x", "y") / F.var_pop("x")).alias("beta"), F.first("mx").alias("mx"), F.first("my").alias("my"), F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"))
    fit = fit.withColumn("alpha", F.col("my") - F.col("beta") * F.col("mx")).drop("mx", "my")
    g = known.drop("mx", "my").join(fit.select(*keys, "alpha", "beta"), list(keys)).withColumn("g0", F.col("y") - F.col("alpha") - F.col("beta") * F.col("x")).withColumn("g1", F.col("g0") * F.col("x"))
    g = g.withColumns({f"{c}_{k}": F.lag(c, k).over(w) for c in ("g0", "g1") for k in range(1, lags + 1)})

    def total(i: str, j: str) -> Column:
        s = F.sum(F.col(i) * F.col(j))
        for k in range(1, lags + 1):
            both = F.sum(F.col(i) * F.col(f"{j}_{k}")) + F.sum(F.col(j) * F.col(f"{i}_{k}"))
            s = s + (1 - k / (lags + 1)) * F.coalesce(both, F.lit(0.0))
        return s

    s = g.groupBy(*keys).agg(total("g0", "g0").alias("s00"), total("g0", "g1").alias("s01"), total("g1", "g1").alias("s11"))
    c = F.col
    det = c("n") * c("sxx") - c("sx") * c("sx")
    variance = (c("sxx") ** 2 * c("s00") - 2 * c("sxx") * c("sx") * c("s01") + c("sx") ** 2 * c("s11")) / det**2
    return fit.join(s, list(keys)).select(*keys, "alpha", "beta", F.sqrt(variance).alias("se_alpha"), (c("alpha") / F.sqrt(variance)).alias("t_alpha"))


def performance_fee(df: DataFrame, gamma: float, days: int = DAYS) -> DataFrame:
    """(fee): what a quadratic investor of aversion gamma would pay a year to swap returns b for a; null where no fee balances them."""
    k = gamma / (2 * (1 + gamma))
    use = lambda c: F.avg(1 + F.col(c) - k * F.pow(1 + F.col(c), 2))
    m = df.agg(F.avg(1 + F.col("a")).alias("mean"), use("a").alias("ua"), use("b").alias("ub"))
    slope = 1 - 2 * k * F.col("mean")
    disc = slope * slope - 4 * k * (F.col("ub") - F.col("ua"))
    return m.select(F.when(disc >= 0, (F.sqrt(disc) - slope) / (2 * k) * days).alias("fee"))


def draw(rep: Column, pos: Column, salt: int) -> Column:
    """A whole number in [0, MODULUS) for each replicate, position and salt: two squaring rounds, so any engine can repeat it."""
    x = (rep * STEP_REP + pos * STEP_POS + salt * STEP_SALT + 1) % MODULUS
    for _ in range(2):
        x = ((x * x) % MODULUS * MULTIPLIER + 11) % MODULUS
    return x


def bootstrap_indices(df: DataFrame, n: int, block: int = 20, modulo: int | None = None) -> DataFrame:
    """(rep, pos, idx) for replicates (rep): blocks of geometric length, mean `block`, from uniform starts, round the end of the series."""
    modulo = modulo or n
    rows = df.select("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("pos"))
    new = (F.col("pos") == 0) | (draw(F.col("rep"), F.col("pos"), 1) * block < MODULUS)
    begun = rows.withColumn("start", F.when(new, F.struct("pos", (draw(F.col("rep"), F.col("pos"), 2) % modulo).alias("at"))))
    last = begun.withColumn("start", F.last("start", ignorenulls=True).over(running(Window.partitionBy("rep").orderBy("pos"))))
    return last.select("rep", "pos", ((F.col("start.at") + F.col("pos") - F.col("start.pos")) % modulo).alias("idx"))


def paired_bootstrap(df: DataFrame, replicates: int, block: int = 20, cash: float = 0.00005, level: float = 0.95) -> DataFrame:
    """(measure, point, low, high, share_below): differences of Sharpe ratios and of deepest falls of a and b, both on the same draws.

    Replicate -1 is the series itself. The length is the one number that goes through the driver.
    """
    n = df.count()
    sampled = bootstrap_indices(df.sparkSession.range(replicates).select(F.col("id").alias("rep")), n, block)
    rows = sampled.join(df.select(F.col("seq").alias("idx"), "a", "b"), "idx").select("rep", "pos", "a", "b")
    rows = rows.unionByName(df.select(F.lit(-1).cast("long").alias("rep"), F.col("seq").cast("long").alias("pos"), "a", "b"))
    w = running(Window.partitionBy("rep").orderBy("pos"))
    for c in "ab":
        rows = rows.withColumn(f"v{c}", F.product(1 + F.col(c)).over(w))
        rows = rows.withColumn(f"f{c}", F.col(f"v{c}") / F.greatest(F.lit(1.0), F.max(f"v{c}").over(w)) - 1)
    sharpe = lambda c: F.avg(F.col(c) - cash) / F.stddev_samp(F.col(c) - cash) * F.sqrt(F.lit(DAYS))
    each = rows.groupBy("rep").agg((sharpe("a") - sharpe("b")).alias("sharpe"), (F.min("fa") - F.min("fb")).alias("drawdown"))
    long = each.unpivot("rep", ["sharpe", "drawdown"], "measure", "value")
    drawn = F.when(F.col("rep") >= 0, F.col("value"))
    tail = (1 - level) / 2
    got = long.groupBy("measure").agg(F.max(F.when(F.col("rep") < 0, F.col("value"))).alias("point"), F.percentile(drawn, F.array(F.lit(tail), F.lit(1 - tail))).alias("q"), F.avg((drawn <= 0).cast("double")).alias("share_below"))
    return got.select("measure", "point", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "share_below")


#: Replicates that one row of the block-wise bootstrap stands for.
TOGETHER = 100


def _draws(rep: np.ndarray, pos: np.ndarray, salt: int) -> np.ndarray:
    """draw() for arrays."""
    x = (rep[:, None] * STEP_REP + pos[None, :] * STEP_POS + salt * STEP_SALT + 1) % MODULUS
    for _ in range(2):
        x = ((x * x) % MODULUS * MULTIPLIER + 11) % MODULUS
    return x


def index_blocks(rep: np.ndarray, n: int, block: int, modulo: int) -> np.ndarray:
    """Indices of replicates, a row each: the same as bootstrap_indices() draws."""
    pos = np.arange(n)
    new = (_draws(rep, pos, 1) * block < MODULUS) | (pos == 0)
    head = np.maximum.accumulate(np.where(new, pos, 0), axis=1)
    spot = np.take_along_axis(_draws(rep, pos, 2) % modulo, head, axis=1)
    return (spot + pos - head) % modulo


def ratio_and_fall(x: np.ndarray, cash: float) -> tuple[np.ndarray, np.ndarray]:
    """Yearly Sharpe ratio and deepest fall along the last axis; the starting capital counts."""
    value = np.cumprod(1 + x, axis=-1)
    fall = (value / np.maximum(np.maximum.accumulate(value, axis=-1), 1) - 1).min(axis=-1)
    return (x - cash).mean(axis=-1) / (x - cash).std(axis=-1, ddof=1) * np.sqrt(DAYS), fall


def bootstrap_against(df: DataFrame, own: str, rivals: list[str], replicates: int, block: int = 20, cash: float = 0.00005, level: float = 0.95) -> DataFrame:
    """(rival, measure, point, low, high, share_below) for column `own` of df (seq, one column a strategy) against each rival.

    All pairs share the draws, so a replicate gathers every column once. The series travel as one row of arrays (the calendar's
    length), to tasks that each take some hundreds of replicates; only differences come back.
    """
    names = [own, *rivals]
    series = df.agg(*(F.transform(F.sort_array(F.collect_list(F.struct("seq", F.col(c).alias("x")))), lambda v: v["x"]).alias(f"c{i}") for i, c in enumerate(names)))
    blocks = df.sparkSession.range(0, replicates, TOGETHER, max(1, replicates // TOGETHER // 4)).crossJoin(F.broadcast(series))

    def run(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                x = np.stack([np.asarray(c, float) for c in row[1:]])
                rep = np.arange(row[0], min(row[0] + TOGETHER, replicates))
                drawn = [(rep, index_blocks(rep, x.shape[1], block, x.shape[1]))]
                if row[0] == 0:
                    drawn.append((np.array([-1]), np.arange(x.shape[1])[None, :]))
                for reps, index in drawn:
                    ratios, falls = zip(*(ratio_and_fall(c[index], cash) for c in x), strict=True)
                    for i, rival in enumerate(rivals, 1):
                        yield pd.DataFrame({"rep": reps, "rival": rival, "sharpe": ratios[0] - ratios[i], "drawdown": falls[0] - falls[i]})

    each = blocks.mapInPandas(run, "rep long, rival string, sharpe double, drawdown double").unpivot(["rep", "rival"], ["sharpe", "drawdown"], "measure", "value")
    drawn = F.when(F.col("rep") >= 0, F.col("value"))
    tail = (1 - level) / 2
    got = each.groupBy("rival", "measure").agg(F.max(F.when(F.col("rep") < 0, F.col("value"))).alias("point"), F.percentile(drawn, F.array(F.lit(tail), F.lit(1 - tail))).alias("q"), F.avg((drawn <= 0).cast("double")).alias("share_below"))
    return got.select("rival", "measure", "point", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "share_below")


def power_study(df: DataFrame, deltas: tuple[float, ...], repetitions: int, inner: int, length: int, block: int = 20, level: float = 0.95) -> DataFrame:
    """(delta, power, share_positive): how often the interval of the bootstrap lies above 0 where the true difference of ratios is delta.

    df: (seq, a, b), excess returns. a is moved so that its ratio is b's plus delta, both are resampled to `length` on the same draws,
    and each sample gets a bootstrap of its own. (delta, repetition) are rows dealt over tasks; no sample leaves its task.
    """
    spark = df.sparkSession
    pair = df.agg(*(F.transform(F.sort_array(F.collect_list(F.struct("seq", F.col(c).alias("x")))), lambda v: v["x"]).alias(c) for c in "ab"))
    grid = spark.range(len(deltas) * repetitions).select((F.col("id") % repetitions).alias("rep"), F.get(F.array(*map(F.lit, deltas)), (F.col("id") / repetitions).cast("int")).alias("delta"))
    tail = (1 - level) / 2

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                a, b = np.asarray(row.a, float), np.asarray(row.b, float)
                moved = a + (b.mean() / b.std(ddof=1) * np.sqrt(DAYS) + row.delta) * a.std(ddof=1) / np.sqrt(DAYS) - a.mean()
                index = index_blocks(np.array([row.rep]), length, block, len(a))[0]
                x, y = moved[index], b[index]
                differences = []
                for first in range(0, inner, TOGETHER):
                    at = index_blocks((row.rep + 1) * inner + np.arange(first, min(first + TOGETHER, inner)), length, block, length)
                    differences.append(ratio_and_fall(x[at], 0.0)[0] - ratio_and_fall(y[at], 0.0)[0])
                point = ratio_and_fall(x, 0.0)[0] - ratio_and_fall(y, 0.0)[0]
                out.append((row.delta, float(np.quantile(np.concatenate(differences), tail) > 0), float(point > 0)))
            yield pd.DataFrame(out, columns=["delta", "above", "positive"])

    tried = grid.repartition(max(1, len(deltas) * repetitions // 16), "rep").crossJoin(F.broadcast(pair)).mapInPandas(run, "delta double, above double, positive double")
    return tried.groupBy("delta").agg(F.avg("above").alias("power"), F.avg("positive").alias("share_positive"))
