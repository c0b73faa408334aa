"""A query over text files: the series are written in the sources' formats, read back, and put on one calendar."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import PANEL, RETURNS, query
from .functions.bonds import BUMP
from .sources import assembly, files, tables
from .sources.shared import shared_folder

CASH, STALE, YEARS = 0.005, 5, 7
SECTION = "Average Value Weighted Returns"


def _write_lines(lines: DataFrame, path: str) -> str:
    """One file of lines (at, line): their order is part of its format, so they go through one task; a file is some thousands of days."""
    lines.coalesce(1).sortWithinPartitions("at").select("line").write.text(path)
    return path


def _percent(c) -> Column:
    return F.format_string("%.6f", F.col(c) * 100) if isinstance(c, str) else F.format_string("%.6f", c * 100)


def _head(spark, *lines: str) -> DataFrame:
    return spark.createDataFrame([(-len(lines) + i, line) for i, line in enumerate(lines)], "at long, line string")


def write_sources(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """Paths of a factor file and a sector file (two sections each), a table of yields and a price file, made of the orders."""
    base = f"{shared_folder(spark)}/sources-{uuid.uuid4().hex[:12]}"
    market, cents = tables.market(spark, sf_dir), tables.market_cents(spark, sf_dir)
    day = F.date_format("dt", "yyyyMMdd")
    at = F.datediff("dt", F.lit("1970-01-01")).cast("long").alias("at")
    tail = spark.createDataFrame([(10**6, ""), (10**6 + 1, "Average Equal Weighted Returns"), (10**6 + 2, ",x"), (10**6 + 3, "19920101, 9.99")], "at long, line string")
    factors = market.select(at, F.concat_ws(",", day, F.concat(F.lit(" "), _percent(F.col("r") - CASH)), F.lit(f"{CASH * 100:.6f}")).alias("line"))
    panel = tables.panel(spark, sf_dir).where("instrument in ('1', '5')").groupBy("dt").agg(*(F.max(F.when(F.col("instrument") == i, F.col("r"))).alias(f"s{i}") for i in ("1", "5")))
    sector = lambda c: F.when(F.col(c).isNull() | (F.col(c) == 0), "-99.99").otherwise(_percent(c))
    sectors = panel.select(at, F.concat_ws(",", day, sector("s1"), sector("s5")).alias("line"))
    # yields on other days than prices, and neither on all days of the calendar
    rates = cents.where(F.dayofmonth("dt") % 3 != 0).select(at, F.concat_ws(",", F.date_format("dt", "yyyy-MM-dd"), F.format_string("%.2f", 2 + (F.col("c") % 300) / 100)).alias("line"))
    gold = cents.where(F.dayofmonth("dt") % 7 < 4).select(at, F.concat_ws(",", day, F.format_string("%.2f", F.lit(100) + F.col("c") % 1000 / 100)).alias("line"))
    return {
        "factors": _write_lines(_head(spark, "made of orders", SECTION, ",Mkt-RF,RF").unionByName(factors).unionByName(tail), f"{base}/factors"),
        "sectors": _write_lines(_head(spark, SECTION, ",One,Five").unionByName(sectors).unionByName(tail), f"{base}/sectors"),
        "yields": _write_lines(_head(spark, f"Date,{YEARS}Yr").unionByName(rates), f"{base}/yields"),
        "prices": _write_lines(_head(spark, "<DATE>,<CLOSE>").unionByName(gold), f"{base}/prices"),
    }


_PRICE = lambda y: f"(y0 / ({y}) * (1 - pow(1 / (1 + ({y}) / 2), {2 * YEARS})) + pow(1 / (1 + ({y}) / 2), {2 * YEARS}))"
_UP, _DOWN = _PRICE(f"y0 + {BUMP}::DOUBLE"), _PRICE(f"y0 - {BUMP}::DOUBLE")


@query(f"""WITH {RETURNS}, {PANEL.replace("own AS", "pown AS").replace("FROM own", "FROM pown").replace("JOIN own", "JOIN pown")}, cal AS (SELECT dt, round((r - {CASH}::DOUBLE) * 100, 6) / 100 AS over, {CASH}::DOUBLE AS rf FROM base),
 ys AS (SELECT dt AS ydt, round(2 + (c % 300) / 100, 2) / 100 AS y FROM cents WHERE day(dt) % 3 <> 0), gs AS (SELECT dt AS gdt, round(100 + (c % 1000) / 100, 2) AS close FROM cents WHERE day(dt) % 7 < 4),
 kn AS (SELECT cal.*, CASE WHEN date_diff('day', ydt, cal.dt) <= {STALE} THEN y END AS y, CASE WHEN date_diff('day', gdt, cal.dt) <= {STALE} THEN close END AS close FROM cal ASOF LEFT JOIN ys ON cal.dt >= ys.ydt ASOF LEFT JOIN gs ON cal.dt >= gs.gdt),
 bd AS (SELECT dt, y0 * days / 365 - ({_DOWN} - {_UP}) / {2 * BUMP}::DOUBLE * (y - y0) + ({_UP} - 2 + {_DOWN}) / {BUMP**2}::DOUBLE / 2 * (y - y0) * (y - y0) AS r
 FROM (SELECT dt, y, lag(y) OVER (ORDER BY dt) AS y0, date_diff('day', lag(dt) OVER (ORDER BY dt), dt) AS days FROM kn WHERE y IS NOT NULL) WHERE y0 IS NOT NULL),
 lg AS (SELECT dt, 'RF' AS name, rf AS r FROM kn UNION ALL SELECT dt, 'Mkt', over + rf FROM kn UNION ALL SELECT kn.dt, 'Bond', bd.r FROM kn LEFT JOIN bd ON bd.dt = kn.dt UNION ALL SELECT dt, 'Gold', close / lag(close) OVER (ORDER BY dt) - 1 FROM kn
 UNION ALL SELECT p.dt, CASE instrument WHEN '1' THEN 'One' ELSE 'Five' END, CASE WHEN r <> 0 THEN round(r * 100, 6) / 100 END FROM panel p SEMI JOIN cal ON cal.dt = p.dt WHERE instrument IN ('1', '5'))
 SELECT dt, name, round(r::DOUBLE, 8) + 0 AS r FROM lg""")
def assembled_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cash, market, bond, gold and two sectors on one calendar, from four text files; values older than STALE days aren't carried on."""
    paths = write_sources(spark, sf_dir)
    sectioned = lambda name: files.sectioned_returns(spark, paths[name], SECTION).select("dt", "name", "r")
    yields = files.yields(spark, paths["yields"]).select("dt", F.col(f"{YEARS}Yr").alias("value"))
    prices = files.prices(spark, paths["prices"]).select(F.col("date").alias("dt"), F.col("close").alias("value"))
    got = assembly.assemble(sectioned("factors"), sectioned("sectors"), yields, prices, years=YEARS, stale=STALE)
    return got.select("dt", "name", (F.round("r", 8) + F.lit(0.0)).alias("r"))
