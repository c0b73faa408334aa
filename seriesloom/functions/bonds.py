"""Bond arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import by_series

BUMP = 1e-4


def par_price(y: Column, coupon: Column, years: int) -> Column:
    """Price of 1 of face at yield y, with coupons twice a year."""
    paid = F.pow(1 / (1 + y / 2), F.lit(2 * years))
    return coupon / y * (1 - paid) + paid


def bond_returns(yields: DataFrame, years: int = 7) -> DataFrame:
    """(series_id, seq, dt, r) from (series_id, seq, dt, y): carry, duration and convexity of a par bond of the day before."""
    w = by_series()
    before = yields.withColumns({"y0": F.lag("y").over(w), "days": F.datediff("dt", F.lag("dt").over(w))}).where("y0 is not null")
    up, down = (par_price(F.col("y0") + s * BUMP, F.col("y0"), years) for s in (1, -1))
    moved = F.col("y") - F.col("y0")
    r = F.col("y0") * F.col("days") / 365 - (down - up) / (2 * BUMP) * moved + (up - 2 + down) / BUMP**2 / 2 * moved * moved
    return before.select("series_id", "seq", "dt", r.alias("r"))
