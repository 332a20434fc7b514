"""Point-in-time joins: what was public on a date, and nothing later.

Facts and signal dates go into one table, ordered by the day from which each counts, and a running maximum gives every
signal date the latest fact: one shuffle by key, and no fact meets more than the dates of its key's window. Signal dates are
days of a calendar, so that their number does not grow with the facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def validate_fundamentals(df: DataFrame) -> DataFrame:
    """A publication before the report is unknown; of equal (symbol, report, publication) the greatest (fetched_at, source)
    stays, a missing fetched_at being the greatest."""
    df = df.withColumn("available_date", F.when(F.col("available_date") >= F.col("report_date"), F.col("available_date")))
    keys = ["symbol", "report_date", "available_date"]
    w = W.partitionBy(*keys).orderBy(F.col("fetched_at").desc_nulls_first(), F.col("source").desc_nulls_last())
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def eligible(df: DataFrame, cutoff: Column) -> DataFrame:
    return df.where((F.col("available_date") <= cutoff) & (F.col("report_date") <= cutoff))


def asof(facts: DataFrame, signals: DataFrame, by: list[str], available: str = "available_date", observed: str = "report_date") -> DataFrame:
    """Latest fact by (available, observed) of each key and signal date (column signal_date), if any is public."""
    values = [c for c in facts.columns if c not in by]
    known = facts.where(F.col(available).isNotNull() & F.col(observed).isNotNull())
    rows = known.select(*by, F.greatest(available, observed).alias("_day"), F.lit(None).cast("date").alias("signal_date"), F.struct(*values).alias("_v"), F.struct(available, observed).alias("_order"))
    asked = known.select(*by).distinct().crossJoin(signals.select("signal_date"))  # a row for each key and signal date is what is asked for
    asked = asked.select(*by, F.col("signal_date").alias("_day"), "signal_date", F.lit(None).cast(rows.schema["_v"].dataType).alias("_v"), F.lit(None).cast(rows.schema["_order"].dataType).alias("_order"))
    so_far = W.partitionBy(*by).orderBy("_day").rangeBetween(W.unboundedPreceding, W.currentRow)
    latest = rows.union(asked).withColumn("v", F.max_by("_v", "_order").over(so_far)).where(F.col("signal_date").isNotNull() & F.col("v").isNotNull())
    return latest.select("signal_date", *by, "v.*")


def rejected_counts(facts: DataFrame, signals: DataFrame) -> DataFrame:
    """Per symbol and signal date: facts without publication, published later, about a later period.

    Facts are counted once a day and symbol; running sums up to each signal date are taken off the totals.
    """
    event = lambda day, a, r: facts.where(F.col(day).isNotNull()).select("symbol", F.col(day).alias("day"), F.lit(None).cast("date").alias("signal_date"), F.lit(a).alias("a"), F.lit(r).alias("r"), F.lit(0).alias("m"))
    unknown = facts.where(F.col("available_date").isNull()).select("symbol", F.lit(None).cast("date"), F.lit(None).cast("date"), F.lit(0), F.lit(0), F.lit(1))
    daily = event("available_date", 1, 0).union(event("report_date", 0, 1)).union(unknown).groupBy("symbol", "day", "signal_date").agg(*[F.sum(c).alias(c) for c in "arm"])
    asked = facts.select("symbol").distinct().crossJoin(signals.select("signal_date"))  # as in asof
    rows = daily.union(asked.select("symbol", F.col("signal_date").alias("day"), "signal_date", *[F.lit(0).cast("long").alias(c) for c in "arm"]))
    every = W.partitionBy("symbol")
    so_far = every.orderBy("day").rangeBetween(W.unboundedPreceding, W.currentRow)
    out = rows.withColumns({"missing_available": F.sum("m").over(every), "published_later": F.sum("a").over(every) - F.sum("a").over(so_far), "future_report": F.sum("r").over(every) - F.sum("r").over(so_far)})
    return out.where(F.col("signal_date").isNotNull()).select("symbol", "signal_date", "missing_available", "published_later", "future_report")


def macro_asof(macro: DataFrame, signals: DataFrame) -> DataFrame:
    """Latest public macro row of each signal date (nulls where none is), with the rows passed over.

    A sweep over days: a row becomes public on the later of its date and its publication. What happens on a day is one row, and a
    signal date sees the running maximum and counts up to it.
    """
    values = [c for c in macro.columns if c not in ("date", "available_date")]
    row = F.struct("available_date", "date", *values)
    kind = dict(macro.select(row.alias("v")).dtypes)["v"]
    none, no, one = F.lit(None).cast(kind), F.lit(0), F.lit(1)
    signal = F.lit(None).cast("date").alias("signal_date")
    public = macro.where("date is not null and available_date is not null").select(F.greatest("date", "available_date").alias("day"), signal, row.alias("v"), one.alias("e"), no.alias("a"), no.alias("m"))
    published = macro.select(F.col("available_date").alias("day"), signal, none, no, F.col("available_date").isNotNull().cast("int"), F.col("available_date").isNull().cast("int"))
    asked = signals.select(F.col("signal_date").alias("day"), "signal_date", none, no, no, no)
    days = public.union(published).union(asked).groupBy("day", "signal_date").agg(F.max("v").alias("v"), *[F.sum(c).alias(c) for c in "eam"])
    every = W.partitionBy()  # days of a calendar
    so_far = every.orderBy("day").rangeBetween(W.unboundedPreceding, W.currentRow)
    out = days.withColumns({"v": F.max("v").over(so_far), "eligible": F.sum("e").over(so_far), "published_later": F.sum("a").over(every) - F.sum("a").over(so_far), "missing_available": F.sum("m").over(every)})
    return out.where("signal_date is not null").select("signal_date", F.col("v.date").alias("macro_date"), *[F.col(f"v.{c}").alias(c) for c in values], "published_later", "missing_available", "eligible")


def signal_date_by(executions: DataFrame, dates: DataFrame, by: str) -> DataFrame:
    """The last date of a ``by`` strictly before each of its execution dates; null where there is none."""
    before = dates.select(by, "date", F.lag("date").over(W.partitionBy(by).orderBy("date")).alias("signal_date"))
    return executions.join(before, [by, "date"], "left")
