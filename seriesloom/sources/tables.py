"""Ordered series derived from the provided tables. Sums are of integer cents, so they don't depend on the order of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.windows import as_of


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(c: str):
    return F.sum(F.round(F.col(c) * 100).cast("long"))


def _change(c: str, before):
    return F.lit(0.02) * (F.col(c) - before).cast("double") / (F.col(c) + before).cast("double")


def market_cents(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    return orders.groupBy(F.to_date("o_orderdate").alias("dt")).agg(_cents("o_totalprice").alias("c")).withColumn("series_id", F.lit("market"))


def to_returns(cents: DataFrame, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """(keys, seq, dt, r): bounded changes of c in date order, without the first row."""
    w = Window.partitionBy(*keys).orderBy("dt")
    r = cents.withColumn("seq", F.row_number().over(w) - 2).withColumn("r", _change("c", F.lag("c").over(w)))
    return r.where("seq >= 0").select(*keys, "seq", "dt", "r")


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_returns(market_cents(spark, sf_dir))


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series for each nation's customers."""
    orders, customer = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return to_returns(joined.groupBy(F.col("c_nationkey").cast("string").alias("series_id"), F.to_date("o_orderdate").alias("dt")).agg(_cents("o_totalprice").alias("c")))


def panel_cents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(instrument, dt, c) on every order date: the last known value of each instrument."""
    orders = _table(spark, sf_dir, "orders")
    own = orders.groupBy(F.substring("o_orderpriority", 1, 1).alias("instrument"), F.to_date("o_orderdate").alias("dt")).agg(_cents("o_totalprice").alias("c"))
    # the dates and the few instruments span the panel
    calendar = orders.select(F.to_date("o_orderdate").alias("dt")).distinct()
    grid = calendar.crossJoin(F.broadcast(own.select("instrument").distinct()))
    return as_of(grid, own, "dt", "c", ("instrument",))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(instrument, seq, dt, r) from the first date on which all instruments have a return; seq counts dates."""
    cents = panel_cents(spark, sf_dir)
    w = Window.partitionBy("instrument").orderBy("dt")
    r = cents.withColumn("r", _change("c", F.lag("c").over(w)))
    known = r.groupBy("dt").agg(F.count("r").alias("n"), F.count(F.lit(1)).alias("k")).where("n = k").select("dt")
    start = known.agg(F.min("dt").alias("start"))
    return r.crossJoin(F.broadcast(start)).where("dt >= start").withColumn("seq", F.row_number().over(w) - 1).select("instrument", "seq", "dt", "r")


def event_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, seq, state): each user's events as states 0 (view, click), 1 (signup, purchase), 2 (error)."""
    events = _table(spark, sf_dir, "events")
    state = F.when(F.col("event_type").isin("view", "click"), 0).when(F.col("event_type").isin("signup", "purchase"), 1).otherwise(2)
    w = Window.partitionBy("series_id").orderBy("ts", "event_id")
    return events.select(F.col("user_id").alias("series_id"), "ts", "event_id", state.alias("state")).withColumn("seq", F.row_number().over(w) - 1).select("series_id", "seq", "state")
