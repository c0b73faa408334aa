"""Forecast losses and the comparison of two forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import by_series

CLIP = 0.01


def qlike(realised: Column, forecast: Column) -> Column:
    ratio = F.try_divide(realised, forecast)
    return ratio - F.log(ratio) - 1


def brier(p: Column, y: Column) -> Column:
    return F.pow(p - y, 2)


def log_score(p: Column, y: Column, clip: float = CLIP) -> Column:
    q = F.when(p.isNotNull(), F.greatest(F.least(p, F.lit(1 - clip)), F.lit(clip)))
    return -(y * F.log(q) + (1 - y) * F.log(1 - q))


def diebold_mariano(df: DataFrame, a: str, b: str, lags: int) -> DataFrame:
    """(series_id, mean_difference, t): mean loss difference over its long-run deviation with Bartlett weights; null if that isn't positive."""
    known = df.select("series_id", "seq", (F.col(a) - F.col(b)).alias("d")).where("d is not null")
    mean = known.groupBy("series_id").agg(F.avg("d").alias("mean"))
    u = known.join(mean, "series_id").withColumn("u", F.col("d") - F.col("mean"))
    w = by_series()
    lagged = u.withColumns({f"u{k}": F.lag("u", k).over(w) for k in range(1, lags + 1)})
    n = F.count(F.lit(1))
    s = F.sum(F.col("u") * F.col("u")) / n
    for k in range(1, lags + 1):
        s = s + 2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(F.col("u") * F.col(f"u{k}")), F.lit(0.0)) / n
    got = lagged.groupBy("series_id").agg(F.first("mean").alias("mean_difference"), s.alias("s"), n.alias("n"))
    return got.select("series_id", "mean_difference", F.when(F.col("s") > 0, F.col("mean_difference") / F.sqrt(F.col("s") / F.col("n"))).alias("t"))
