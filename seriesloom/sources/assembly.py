"""Series of different sources on one trading calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bonds

#: Days after which a source's last value no longer counts as known.
STALE = 10


def as_of_all(calendar: DataFrame, sources: dict[str, DataFrame], stale: int = STALE) -> DataFrame:
    """calendar (dt, ...) with a column for each source (dt, value): its last known value at or before the day, null if that is more than `stale` days old.

    All sources are united with the calendar and sorted once; no range join.
    """
    names = list(sources)
    rest = [c for c in calendar.columns if c != "dt"]
    both = calendar.select("dt", F.struct(*rest).alias("own") if rest else F.lit(True).alias("own"), F.lit(1).alias("side"), *(F.lit(None).cast("struct<dt: date, value: double>").alias(n) for n in names))
    for name, source in sources.items():
        known = source.where(F.col("value").isNotNull() & F.col("dt").isNotNull())
        one = known.select("dt", F.lit(0).alias("side"), F.struct("dt", F.col("value").cast("double").alias("value")).alias(name))
        both = both.unionByName(one, allowMissingColumns=True)
    # the order of one market's days is one sort
    w = Window.partitionBy(F.lit("market")).orderBy("dt", "side").rowsBetween(Window.unboundedPreceding, 0)
    last = both.withColumns({n: F.last(n, ignorenulls=True).over(w) for n in names}).where("side = 1")
    fresh = lambda n: F.when(F.datediff("dt", F.col(f"{n}.dt")) <= stale, F.col(f"{n}.value"))
    return last.select("dt", *((F.col(f"own.{c}").alias(c)) for c in rest), *(fresh(n).alias(n) for n in names))


def assemble(factors: DataFrame, sectors: DataFrame, yields: DataFrame, prices: DataFrame, end=None, years: int = 7, stale: int = STALE) -> DataFrame:
    """(dt, name, r): daily returns of all instruments on the calendar of factors, up to and with `end`.

    factors and sectors are (dt, name, r) in decimals; factors has RF and Mkt-RF, and its days are the calendar. yields is (dt, value) of
    one maturity, prices (dt, value). Bonds earn carry, duration and convexity between the days on which a yield is known; gold earns the
    change of its price. Days without a value give null.
    """
    wide = factors.groupBy("dt").agg(*(F.max(F.when(F.col("name") == n, F.col("r"))).alias(a) for n, a in (("RF", "rf"), ("Mkt-RF", "over"))))
    calendar = wide.where(F.col("dt") <= F.lit(end)) if end is not None else wide
    days = as_of_all(calendar, {"y": yields, "close": prices}, stale)
    order = Window.partitionBy("series_id").orderBy("dt")
    named = days.withColumn("series_id", F.lit("market"))
    bond = bonds.bond_returns(named.where("y is not null").select("series_id", F.row_number().over(order).alias("seq"), "dt", "y"), years).select("dt", F.col("r").alias("bond"))
    gold = F.try_divide(F.col("close"), F.lag("close").over(order)) - 1
    joined = named.withColumn("gold", gold).join(bond, "dt", "left")
    own = joined.select("dt", F.explode_outer(F.array(*(F.struct(F.lit(n).alias("name"), c.alias("r")) for n, c in (("RF", F.col("rf")), ("Mkt", F.col("over") + F.col("rf")), ("Bond", F.col("bond")), ("Gold", F.col("gold")))))).alias("x"))
    return own.select("dt", "x.name", "x.r").unionByName(sectors.join(calendar.select("dt"), "dt", "left_semi").select("dt", "name", "r"))
