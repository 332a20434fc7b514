"""Market tables derived from the test tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import new_folder

_written: ContextVar[dict[tuple[str, str], DataFrame] | None] = ContextVar("written", default=None)


@contextmanager
def written_once() -> Iterator[None]:
    """Within this, the tables below are computed and written to the shared folder at their first use, and read from there at each use."""
    token = _written.set({})
    try:
        yield
    finally:
        _written.reset(token)


def shared(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(f)
    def get(spark: SparkSession, sf_dir: str) -> DataFrame:
        known, key = _written.get(), (f.__name__, sf_dir)
        if known is None:
            return f(spark, sf_dir)
        if key not in known:
            path = new_folder(spark, f.__name__)
            df = f(spark, sf_dir)
            df.write.parquet(path)
            known[key] = spark.read.schema(df.schema).parquet(path)
        return known[key]

    return get


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@shared
def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of each brand: one shuffle on (symbol, date) with partial aggregation."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    rows = line.join(part, line.l_partkey == part.p_partkey).withColumn("price", F.col("l_extendedprice") / F.col("l_quantity"))
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price", "l_quantity")
    return rows.groupBy(F.col("p_brand").alias("symbol"), F.to_date("l_shipdate").alias("date")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("l_quantity").alias("volume"), F.sum("l_extendedprice").alias("amount")
    )


_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, price, l_quantity"
BARS = f"""bars AS MATERIALIZED (SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS date, first(price ORDER BY {_ORDER}) AS open,
 max(price) AS high, min(price) AS low, last(price ORDER BY {_ORDER}) AS close, sum(l_quantity) AS volume, sum(l_extendedprice) AS amount
 FROM (SELECT *, l_extendedprice / l_quantity AS price FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1, 2)"""


def resampled(daily: DataFrame, unit: str) -> DataFrame:
    """Bars of a week, month or quarter, dated by its first day."""
    return daily.groupBy("symbol", F.to_date(F.date_trunc(unit, "date")).alias("date")).agg(
        F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "date").alias("close"), F.sum("volume").alias("volume"), F.sum("amount").alias("amount")
    )


def resampled_sql(name: str, unit: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT symbol, CAST(date_trunc('{unit}', date) AS DATE) AS date, arg_min(open, date) AS open, max(high) AS high,
 min(low) AS low, arg_max(close, date) AS close, sum(volume) AS volume, sum(amount) AS amount FROM bars GROUP BY 1, 2)"""


@shared
def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(bars(spark, sf_dir), "week")


WEEKLY = BARS + ", " + resampled_sql("bars_w", "week")
MONTHLY = BARS + ", " + resampled_sql("bars_m", "month")


def brand_number(symbol: str = "symbol") -> F.Column:
    return F.regexp_extract(symbol, "[0-9]+", 0).cast("int")


@shared
def raw_fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly reports per brand, with some missing or impossible publication dates and a later duplicate."""
    line = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    q = line.groupBy(F.col("p_brand").alias("symbol"), F.to_date(F.date_trunc("quarter", "l_shipdate")).alias("q")).agg(
        F.avg("l_extendedprice").alias("p"), F.avg("l_quantity").alias("n"), F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"), F.avg("p_size").alias("z"), F.sum("l_quantity").alias("s")
    )
    k = brand_number()
    report = F.expr("date_sub(add_months(q, 3), 1)")
    month = F.month("q")
    return q.select(
        "symbol",
        report.alias("report_date"),
        F.when((k + month) % 11 == 0, None).when((k + month) % 13 == 0, F.date_sub(report, 5)).otherwise(F.date_add(report, 30 + k % 60)).alias("available_date"),
        (F.col("p") / 1500).alias("pe"),
        (F.col("n") / 10).alias("pb"),
        F.when(k % 5 == 0, F.col("d") * 100).otherwise(F.col("d")).alias("dividend_yield"),
        (F.col("t") * 4).alias("roe"),
        F.when(k % 7 == 0, None).otherwise(F.col("d") * 8).alias("gross_margin"),
        (F.col("t") * 3).alias("net_margin"),
        (F.col("z") / 60).alias("debt_ratio"),
        (F.col("s") * 1.1).alias("operating_cash_flow"),
        F.when(k % 9 == 0, F.lit(0.0)).otherwise(F.col("s")).alias("net_profit"),
    )


RAW_FUNDAMENTALS = """raw_fundamentals AS MATERIALIZED (SELECT symbol, report_date,
 CASE WHEN (k + m) % 11 = 0 THEN NULL WHEN (k + m) % 13 = 0 THEN report_date - 5 ELSE report_date + CAST(30 + k % 60 AS INTEGER) END AS available_date,
 p / 1500 AS pe, n / 10 AS pb, CASE WHEN k % 5 = 0 THEN d * 100 ELSE d END AS dividend_yield, t * 4 AS roe,
 CASE WHEN k % 7 = 0 THEN NULL ELSE d * 8 END AS gross_margin, t * 3 AS net_margin, z / 60 AS debt_ratio, s * 1.1::DOUBLE AS operating_cash_flow,
 CASE WHEN k % 9 = 0 THEN 0.0::DOUBLE ELSE s END AS net_profit
 FROM (SELECT *, CAST(q + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS report_date, CAST(regexp_extract(symbol, '[0-9]+') AS INTEGER) AS k, month(q) AS m
 FROM (SELECT p_brand AS symbol, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS q, avg(l_extendedprice) AS p, avg(l_quantity) AS n, avg(l_discount) AS d,
 avg(l_tax) AS t, avg(p_size) AS z, sum(l_quantity) AS s FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)))"""


@shared
def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly macro indicators from orders, published ten days after the month; some are missing."""
    o = table(spark, sf_dir, "orders")
    share = lambda c, v: F.avg((F.col(c) == v).cast("double"))
    m = o.groupBy(F.last_day("o_orderdate").alias("date")).agg(
        F.count("*").alias("n"), F.avg("o_totalprice").alias("p"), share("o_orderstatus", "F").alias("f"), share("o_orderstatus", "P").alias("w"), share("o_orderpriority", "1-URGENT").alias("u"), share("o_orderpriority", "5-LOW").alias("l")
    )
    k = F.month("date")
    return m.select(
        "date",
        F.date_add("date", 10).alias("available_date"),
        F.when(k == 3, None).otherwise(45 + F.col("f") * 20).alias("pmi"),
        F.when(k == 5, None).otherwise(F.col("u") * 15).alias("cpi_yoy"),
        (F.col("l") * 20 - 2).alias("ppi_yoy"),
        (5 + F.col("w") * 15).alias("m2_yoy"),
        F.when(k == 7, None).otherwise(5 + F.col("f") * 18).alias("social_financing_yoy"),
        (2 + F.col("u") * 5).alias("ten_year_yield"),
        F.lit(7.0).alias("usd_cny"),
        (F.col("l") * 250).alias("policy_score"),
        (F.col("p") / 5000).alias("external_risk_score"),
    )


MACRO = """macro AS MATERIALIZED (SELECT date, date + 10 AS available_date, CASE WHEN k = 3 THEN NULL ELSE 45 + f * 20 END AS pmi,
 CASE WHEN k = 5 THEN NULL ELSE u * 15 END AS cpi_yoy, l * 20 - 2 AS ppi_yoy, 5 + w * 15 AS m2_yoy,
 CASE WHEN k = 7 THEN NULL ELSE 5 + f * 18 END AS social_financing_yoy, 2 + u * 5 AS ten_year_yield, 7.0::DOUBLE AS usd_cny, l * 250 AS policy_score, p / 5000 AS external_risk_score
 FROM (SELECT *, month(date) AS k FROM (SELECT CAST(last_day(o_orderdate) AS DATE) AS date, count(*) AS n, avg(o_totalprice) AS p,
 avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0 END) AS f, avg(CASE WHEN o_orderstatus = 'P' THEN 1.0::DOUBLE ELSE 0 END) AS w,
 avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0::DOUBLE ELSE 0 END) AS u, avg(CASE WHEN o_orderpriority = '5-LOW' THEN 1.0::DOUBLE ELSE 0 END) AS l FROM orders GROUP BY 1)))"""

MACRO_FIELDS = ("pmi", "cpi_yoy", "ppi_yoy", "m2_yoy", "social_financing_yoy", "ten_year_yield", "usd_cny", "policy_score", "external_risk_score")


@shared
def signal_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first bar date of each quarter."""
    days = bars(spark, sf_dir).select("date").distinct()
    return days.groupBy(F.date_trunc("quarter", "date").alias("q")).agg(F.min("date").alias("date")).select("date")


SIGNAL_DATES = "signal_dates AS MATERIALIZED (SELECT min(date) AS date FROM bars GROUP BY date_trunc('quarter', date))"

#: Strategies hold five brands each, starting at every fifth.
STRATEGIES = 5


def strategy_members(symbols: DataFrame) -> DataFrame:
    """(strategy_id, symbol, weight, industry): brands 1-5 are strategy 0, and so on; weights .15 to .23."""
    k = brand_number() - 1
    return symbols.select("symbol").distinct().select(F.floor(k / 5).cast("int").alias("strategy_id"), "symbol", (0.15 + (k % 5) * 0.02).alias("weight"), F.concat(F.lit("industry_"), (k % 3).cast("string")).alias("industry"))


MEMBERS = """members AS MATERIALIZED (SELECT CAST(floor(k / 5) AS INTEGER) AS strategy_id, symbol, 0.15::DOUBLE + (k % 5) * 0.02::DOUBLE AS weight, 'industry_' || (k % 3) AS industry
 FROM (SELECT DISTINCT symbol, CAST(regexp_extract(symbol, '[0-9]+') AS INTEGER) - 1 AS k FROM bars))"""


def equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(strategy_id, date, equity): a brand's weekly closes as an equity curve."""
    return weekly(spark, sf_dir).select(F.col("symbol").alias("strategy_id"), "date", F.col("close").alias("equity"))


EQUITY = WEEKLY + ", equity AS MATERIALIZED (SELECT symbol AS strategy_id, date, close AS equity FROM bars_w)"


def numbered(df: DataFrame, *by: str, order: str = "date", name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(order)))
