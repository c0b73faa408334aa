"""The normal distribution in column expressions: Spark has no error function."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TERMS, FAR, HALVINGS = 120, 8.0, 52


def normal_cdf(z: Column) -> Column:
    """P(Z <= z): 1/2 plus the density times the sum of z^(2k+1) / (1 * 3 * ... * (2k+1)); beyond FAR it is 0 or 1 to double precision."""
    start = F.struct(z.alias("term"), z.alias("sum"))
    step = lambda acc, k: F.struct((acc["term"] * z * z / (2 * k + 1)).alias("term"), (acc["sum"] + acc["term"] * z * z / (2 * k + 1)).alias("sum"))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda acc: acc["sum"])
    near = F.lit(0.5) + total * F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    return F.when(z > FAR, 1.0).when(z < -FAR, 0.0).when(z.isNotNull(), near)


def normal_inverse(p: Column) -> Column:
    """z with P(Z <= z) = p, by halving [-FAR, FAR] until a double can't tell; null outside (0, 1)."""
    start = F.struct(F.lit(-FAR).alias("low"), F.lit(FAR).alias("high"))

    def halved(acc: Column, _: Column) -> Column:
        middle = (acc["low"] + acc["high"]) / 2
        under = normal_cdf(middle) < p
        return F.struct(F.when(under, middle).otherwise(acc["low"]).alias("low"), F.when(under, acc["high"]).otherwise(middle).alias("high"))

    return F.when((p > 0) & (p < 1), F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, halved, lambda acc: (acc["low"] + acc["high"]) / 2))


def two_sided_p(t: Column) -> Column:
    """Chance of a normal score at least as far from 0 as t."""
    return 2 * (1 - normal_cdf(F.abs(t)))
