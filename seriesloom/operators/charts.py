"""What a chart shows of long series: a few rows for each of its pixels, made where the series are."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import running


def curves(days: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """(chart, keys, seq, value): capital, distance from its maximum so far, and exposure, of simulated days."""
    w = running(Window.partitionBy(*keys).orderBy("seq"))
    grown = days.withColumn("capital", F.product(1 + F.col("ret")).over(w))
    fallen = grown.withColumn("drawdown", F.col("capital") / F.max("capital").over(w) - 1)
    return fallen.unpivot([*keys, "seq"], ["capital", "drawdown", "exposure"], "chart", "value")


def reduced(points: DataFrame, keys: tuple[str, ...], pixels: int) -> DataFrame:
    """(keys, bucket, first, low, high, last) of points (keys, seq, value): the days of all curves are cut into `pixels` equal stretches.

    First, least, greatest and last value draw the same line in a stretch of one pixel as all its points do. Unknown values are left out.
    """
    known = points.where("value is not null")
    ends = known.agg(F.min("seq").alias("from"), F.max("seq").alias("to"))
    place = F.floor((F.col("seq") - F.col("from")) * pixels / (F.col("to") - F.col("from") + 1))
    # one row
    each = known.crossJoin(F.broadcast(ends)).withColumn("bucket", place)
    return each.groupBy(*keys, "bucket").agg(F.min_by("value", "seq").alias("first"), F.min("value").alias("low"), F.max("value").alias("high"), F.max_by("value", "seq").alias("last"))
