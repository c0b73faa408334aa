"""Text sources of daily series: sectioned return tables, price files and yield tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values that mark a missing return.
MISSING = (-99.99, -999.0)


def sectioned_returns(spark: SparkSession, path: str, section: str = "Average Value Weighted Returns") -> DataFrame:
    """(path, dt, name, r) in decimals from a file of titled sections in percent; sentinels are null.

    The section starts at the first line that holds its title (else at the first line), its header is the next line that starts
    with a comma, and its rows end at the first line without a date. A file is one row here: order within it is part of its format.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", r"\r?\n")).alias("at", "line"))
    title = F.coalesce(F.min(F.when(F.col("line").contains(section), F.col("at"))), F.lit(0))
    starts = whole.groupBy("path").agg(title.alias("title"))
    below = whole.join(starts, "path").where("at >= title")
    header = below.where(F.col("line").startswith(",")).groupBy("path").agg(F.min("at").alias("head"), F.min_by("line", "at").alias("names"))
    body = below.join(header, "path").where("at > head")
    dated = F.trim(F.split("line", ",")[0]).rlike("^[0-9]{8}$")
    ends = body.where(~dated).groupBy("path").agg(F.min("at").alias("end"))
    rows = body.join(ends, "path", "left").where("end is null or at < end")
    cells = rows.select("path", F.try_to_date(F.trim(F.split("line", ",")[0]), "yyyyMMdd").alias("dt"), F.posexplode(F.arrays_zip(F.split("names", ",").alias("name"), F.split("line", ",").alias("cell"))).alias("place", "pair")).where("place > 0")
    value = F.trim("pair.cell").try_cast("double")
    return cells.select("path", "dt", F.trim("pair.name").alias("name"), F.when(~value.isin(*MISSING), value / 100).alias("r"))


def prices(spark: SparkSession, path: str) -> DataFrame:
    """(date, close) from a price file whose headers are in angle brackets."""
    raw = spark.read.csv(path, header=True)
    named = raw.toDF(*(c.strip("<>").lower() for c in raw.columns))
    return named.select(F.to_date("date", "yyyyMMdd").alias("date"), F.col("close").try_cast("double").alias("close"))


def yields(spark: SparkSession, path: str) -> DataFrame:
    """dt and each maturity in decimals, from a table in percent whose first column is the date."""
    raw = spark.read.csv(path, header=True)
    first, *rest = raw.columns
    return raw.select(F.to_date(first).alias("dt"), *((F.col(f"`{c}`").try_cast("double") / 100).alias(c) for c in rest))
