"""Performance metrics of equity tables (strategy_id, date, equity)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

YEAR = 252


def _w():
    return W.partitionBy("strategy_id").orderBy("date")


def daily_returns(equity: DataFrame) -> DataFrame:
    """Change on the row before, 0 on the first row."""
    return equity.withColumn("daily_return", F.coalesce(F.col("equity") / F.lag("equity").over(_w()) - 1, F.lit(0.0)))


def drawdowns(equity: DataFrame) -> DataFrame:
    return equity.withColumn("drawdown", F.col("equity") / F.max("equity").over(_w().rowsBetween(W.unboundedPreceding, 0)) - 1)


def summary(equity: DataFrame, risk_free: float = 0.0) -> DataFrame:
    """All scalars of each strategy: two windows over one sort, one aggregate."""
    df = drawdowns(daily_returns(equity))
    first, last = F.min_by("equity", "date"), F.max_by("equity", "date")
    sd = F.stddev_samp("daily_return")
    out = df.groupBy("strategy_id").agg(
        F.count("*").alias("n"), F.when(first != 0, last / first - 1).otherwise(0.0).alias("total_return"), F.min("drawdown").alias("max_drawdown"),
        F.coalesce(sd * F.sqrt(F.lit(float(YEAR))), F.lit(0.0)).alias("volatility"), F.when(sd > 0, (F.avg("daily_return") - risk_free / YEAR) / sd * F.sqrt(F.lit(float(YEAR)))).otherwise(0.0).alias("sharpe_ratio"),
    )
    gross = 1 + F.col("total_return")
    out = out.withColumn("annualized_return", F.when(F.col("n") < 2, 0.0).when(gross <= 0, -1.0).otherwise(F.pow(gross, YEAR / F.col("n")) - 1))
    return out.withColumn("calmar_ratio", F.when(F.col("max_drawdown") != 0, F.col("annualized_return") / F.abs("max_drawdown")).otherwise(0.0))


def annual_returns(equity: DataFrame) -> DataFrame:
    """Year-end to year-end; the first year from its first point, if it has two. Years without data repeat the last value."""
    per = equity.groupBy("strategy_id", F.year("date").alias("year")).agg(F.max_by("equity", "date").alias("last"), F.min_by("equity", "date").alias("first"), F.count("*").alias("n"))
    span = per.groupBy("strategy_id").agg(F.min("year").alias("a"), F.max("year").alias("b")).select("strategy_id", F.explode(F.sequence("a", "b")).alias("year"))
    w = W.partitionBy("strategy_id").orderBy("year")
    df = span.join(per, ["strategy_id", "year"], "left").withColumn("filled", F.last("last", ignorenulls=True).over(w))
    df = df.withColumns({"_before": F.lag("filled").over(w), "_rank": F.row_number().over(w)})
    value = F.when(F.col("_rank") == 1, F.when((F.col("n") >= 2) & (F.col("first") != 0), F.col("last") / F.col("first") - 1)).otherwise(F.col("filled") / F.col("_before") - 1)
    return df.withColumn("annual_return", value).where(F.col("annual_return").isNotNull()).select("strategy_id", "year", "annual_return")


def monthly_returns(equity: DataFrame) -> DataFrame:
    """Month-end to month-end, the first month dropped."""
    per = equity.groupBy("strategy_id", F.to_date(F.date_trunc("month", "date")).alias("month")).agg(F.max_by("equity", "date").alias("last"))
    w = W.partitionBy("strategy_id").orderBy("month")
    bounds = per.groupBy("strategy_id").agg(F.min("month").alias("a"), F.max("month").alias("b")).select("strategy_id", F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("month"))
    df = bounds.join(per, ["strategy_id", "month"], "left").withColumn("filled", F.last("last", ignorenulls=True).over(w))
    df = df.withColumn("monthly_return", F.col("filled") / F.lag("filled").over(w) - 1)
    return df.where(F.col("monthly_return").isNotNull()).select("strategy_id", "month", "monthly_return")


def period_returns(equity: DataFrame, excluded_years: DataFrame) -> DataFrame:
    """Annual returns as a map by year, without the years of ``excluded_years`` (strategy_id, year)."""
    kept = annual_returns(equity).join(excluded_years, ["strategy_id", "year"], "left_anti")
    return kept.groupBy("strategy_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("year").cast("string"), F.round("annual_return", 6)))))).alias("annual_returns"))


def benchmark_curve(prices: DataFrame, capital: float = 100_000.0) -> DataFrame:
    """Close over its first close, times capital, for benchmarks (benchmark, date, close)."""
    w = W.partitionBy("benchmark").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    return prices.withColumn("equity", F.col("close") / F.first("close").over(w) * capital)
