"""Window building blocks over (series_id, seq): every frame ends at the current row or earlier, but for labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_series(*keys: str) -> WindowSpec:
    return Window.partitionBy(*(keys or ("series_id",))).orderBy("seq")


def running(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def last_rows(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def guarded(value: Column, of: Column, frame: WindowSpec, n: int) -> Column:
    """value, but null until the frame holds n rows where `of` is not null."""
    return F.when(F.count(of).over(frame) >= n, value)


def clip_low(x: Column, low: float) -> Column:
    """The greater of x and low; null stays null (greatest alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(low)))


def clip_high(x: Column, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(x, F.lit(high)))


def settled(df: DataFrame, *columns: str) -> DataFrame:
    """df with columns that are computed once: filters on them aren't pushed below this point, where each would repeat the chain of expressions behind them."""
    once = df.withColumn("settled", F.explode_outer(F.array(F.struct(*columns))))
    return once.select(*(F.col(f"`{c}`") for c in df.columns if c not in columns), *(F.col(f"settled.{c}").alias(c) for c in columns))


def run_length(state: str, w: WindowSpec, keys: tuple[str, ...] = ("series_id",)):
    """A function DataFrame -> DataFrame that adds island (number of the run) and run (days in it so far; null where state is null)."""

    def add(df: DataFrame) -> DataFrame:
        change = F.when(F.col(state).eqNullSafe(F.lag(state).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
        islands = df.withColumn("change", change).withColumn("island", F.sum("change").over(running(w))).drop("change")
        within = Window.partitionBy(*keys, "island").orderBy("seq")
        return islands.withColumn("run", F.when(F.col(state).isNotNull(), F.row_number().over(within)))

    return add


def as_of(left: DataFrame, right: DataFrame, on: str, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """left with the last `value` of right at or before each of its rows: one sort of both sides together, no range join."""
    both = left.select(*keys, on, F.lit(1).alias("side"), F.lit(None).cast(right.schema[value].dataType).alias(value)).unionByName(right.where(F.col(value).isNotNull()).select(*keys, on, F.lit(0).alias("side"), value))
    w = Window.partitionBy(*keys).orderBy(on, "side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).where("side = 1").drop("side")
