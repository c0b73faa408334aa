"""Observed state chains: counts of order one and two, the order test, and how long runs last."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import by_series
from .regimes import persistence

ORDER_FREEDOM = 12


def pairs(df: DataFrame) -> DataFrame:
    """(series_id, s2, s1, state) of consecutive known states: unknown ones are dropped before pairing."""
    w = by_series()
    return df.where("state is not null").select("series_id", F.lag("state", 2).over(w).alias("s2"), F.lag("state").over(w).alias("s1"), "state")


def order_test(df: DataFrame) -> DataFrame:
    """(series_id, lr, freedom, p_value): likelihood ratio of order two against order one.

    The survival function of chi-square with an even number of degrees of freedom is a finite sum, so it stays in the plan.
    """
    n2 = pairs(df).where("s2 is not null").groupBy("series_id", "s2", "s1", "state").agg(F.count(F.lit(1)).alias("n"))
    n1 = n2.groupBy("series_id", "s1", "state").agg(F.sum("n").alias("n"))
    two = n2.withColumn("row", F.sum("n").over(Window.partitionBy("series_id", "s2", "s1"))).groupBy("series_id").agg(F.sum(F.col("n") * F.log(F.col("n") / F.col("row"))).alias("ll2"))
    one = n1.withColumn("row", F.sum("n").over(Window.partitionBy("series_id", "s1"))).groupBy("series_id").agg(F.sum(F.col("n") * F.log(F.col("n") / F.col("row"))).alias("ll1"))
    lr = two.join(one, "series_id").select("series_id", (2 * (F.col("ll2") - F.col("ll1"))).alias("lr"))
    z, term, total = F.col("lr") / 2, F.lit(1.0), F.lit(1.0)
    for i in range(1, ORDER_FREEDOM // 2):
        term = term * z / i
        total = total + term
    return lr.select("series_id", "lr", F.lit(ORDER_FREEDOM).alias("freedom"), F.when(F.col("lr") <= 0, 1.0).otherwise(F.exp(-z) * total).alias("p_value"))


def run_survival(df: DataFrame, lengths: tuple[int, ...] = (2, 5, 10)) -> DataFrame:
    """(state, k, share): share of completed runs of a state that last k days or more; the last run of a series isn't complete."""
    runs = persistence(df.where("state is not null")).groupBy("series_id", "island", "state").agg(F.count(F.lit(1)).alias("days"))
    done = runs.withColumn("last", F.max("island").over(Window.partitionBy("series_id"))).where("island < last")
    each = done.withColumn("k", F.explode(F.array(*(F.lit(k) for k in lengths))))
    return each.groupBy("state", "k").agg(F.avg((F.col("days") >= F.col("k")).cast("double")).alias("share"))


def geometric_survival(df: DataFrame, lengths: tuple[int, ...] = (2, 5, 10)) -> DataFrame:
    """(state, k, share): what a chain's own staying probability would give, p ** (k - 1)."""
    n = pairs(df).where("s1 is not null").groupBy("s1").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("state") == F.col("s1")).cast("int")).alias("stay"))
    each = n.withColumn("k", F.explode(F.array(*(F.lit(k) for k in lengths))))
    return each.select(F.col("s1").alias("state"), "k", F.pow(F.col("stay") / F.col("n"), F.col("k") - 1).alias("share"))
