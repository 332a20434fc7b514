"""Data quality: one aggregate per symbol, ordered reasons as a chain of conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_GAP = 8
MIN_RATIO = 0.8
MAX_EDGE_GAP = 5
#: Macro indicators and valuation metrics that records may carry (fixed values).
INDICATORS = ("pmi", "cpi_yoy", "ppi_yoy", "m2_yoy", "social_financing_yoy", "ten_year_yield", "usd_cny", "policy_score", "external_risk_score")
METRICS = ("pe_ttm", "pb", "ps_ttm", "dividend_yield", "market_cap")
SOURCE = r"^[A-Za-z0-9][A-Za-z0-9_.-]{0,127}$"
ISO_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def weekdays(start: Column, end: Column) -> Column:
    """Mondays to Fridays in [start, end), in closed form."""
    d = F.weekday(start)
    n = F.datediff(end, start)
    rest = n % 7
    # Of the days after whole weeks, those on Saturday (5) or Sunday (6).
    weekend = F.greatest(F.lit(0), F.least(d + rest, F.lit(7)) - F.greatest(d, F.lit(5))) + F.greatest(F.lit(0), F.least(d + rest - 7, F.lit(7)) - F.lit(5))
    return F.floor(n / 7) * 5 + rest - weekend


def prices(bars: DataFrame) -> DataFrame:
    """Errors and warnings of each symbol's bars, passed, first and last date."""
    w = W.partitionBy("symbol").orderBy("date")
    df = bars.withColumn("_before", F.lag("date").over(w))
    gap = F.when(F.col("_before").isNotNull() & (F.col("date") > F.col("_before")), weekdays(F.col("_before"), F.col("date")) - 1)
    g = df.withColumn("_gap", gap).groupBy("symbol").agg(
        F.count("*").alias("n"), F.count_if(F.col("date").isNull()).alias("no_date"), F.count_if(F.col("date") == F.col("_before")).alias("twice"), F.max("_gap").alias("gap"),
        F.count_if((F.col("high") < F.greatest("open", "low", "close")) | (F.col("low") > F.least("open", "high", "close"))).alias("ohlc"), F.count_if(F.col("close") <= 0).alias("close"), F.count_if(F.col("volume") < 0).alias("volume"), F.count("volume").alias("volumes"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
    )
    errors = [(F.col("no_date") > 0, "invalid_dates"), (F.col("twice") > 0, "duplicate_dates"), (F.col("ohlc") > 0, "inconsistent_ohlc"), (F.col("close") > 0, "non_positive_close"), (F.col("volume") > 0, "negative_volume")]
    warnings = [(F.col("gap") > MAX_GAP, "date_gaps"), (F.col("volumes") == 0, "volume_missing")]
    listed = lambda cases: F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in cases]))
    g = g.withColumns({"errors": listed(errors), "warnings": listed(warnings)})
    return g.select("symbol", (F.size("errors") == 0).alias("passed"), F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"), "first_date", "last_date")


def benchmarks(rows: DataFrame, start: str, end: str, ratio: float = MIN_RATIO, requested: DataFrame | None = None) -> DataFrame:
    """First reason why a (symbol, source)'s rows (date and close as text) are not fit, else success.

    A pair of ``requested`` (symbol, source) without rows is an empty response; one whose rows have no date or no close at all lacks that column.
    """
    a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
    df = rows.withColumns({"_date": F.expr("try_cast(date AS date)"), "_close": F.expr("try_cast(close AS double)")})
    days = df.groupBy("symbol", "source", "_date").count().groupBy("symbol", "source").agg(F.coalesce(F.sum(F.when((F.col("count") > 1) & F.col("_date").isNotNull(), F.col("count"))), F.lit(0)).alias("twice"))
    c = F.col("_close")
    infinite = F.isnan(c) | (F.abs(c) == float("inf"))
    g = df.groupBy("symbol", "source").agg(
        F.count("*").alias("rows"), F.count("close").alias("closes"), F.count("date").alias("n"), F.count_if(F.col("_date").isNull() & F.col("date").isNotNull()).alias("unread"), F.count_if(~F.col("_date").between(a, b)).alias("outside"), F.count_if(c.isNull()).alias("missing"),
        F.count_if(infinite).alias("infinite"), F.count_if(c <= 0).alias("negative"), F.min("_date").alias("first_date"), F.max("_date").alias("last_date"),
    )
    g = g.join(days, ["symbol", "source"])
    if requested is not None:
        g = requested.select("symbol", "source").distinct().join(g, ["symbol", "source"], "left").fillna(0, ["rows", "closes", "n", "unread", "outside", "missing", "infinite", "negative", "twice"])
    g = g.withColumn("days", F.greatest(weekdays(a, F.date_add(b, 1)), F.lit(1)))
    g = g.withColumn("least", F.when(F.col("days") == 1, 1).otherwise(F.greatest(F.lit(2), F.ceil(F.col("days") * ratio))))
    edge = F.least(F.lit(MAX_EDGE_GAP), F.greatest(F.col("days") - F.col("least") - 1, F.lit(0)))
    covered = F.least(F.col("n") / F.col("days"), F.lit(1.0))
    reason = (
        F.when(F.col("rows") == 0, "empty_response")
        .when((F.col("n") == 0) | (F.col("closes") == 0), "invalid_schema")
        .when(F.col("unread") > 0, "invalid_dates")
        .when(F.col("outside") > 0, "invalid_dates")
        .when(F.col("missing") > 0, "missing_close")
        .when(F.col("infinite") > 0, "non_finite_close")
        .when(F.col("negative") > 0, "non_positive_close")
        .when(F.col("twice") > 0, "duplicate_dates")
        .when(F.col("n") < F.col("least"), "insufficient_coverage")
        .when((weekdays(a, F.col("first_date")) > edge) | (weekdays(F.date_add("last_date", 1), F.date_add(b, 1)) > edge), "insufficient_coverage")
        .otherwise("success")
    )
    return g.select("symbol", "source", "n", "first_date", "last_date", covered.alias("coverage_ratio"), reason.alias("reason"))


def window(bars: DataFrame, start: str, end: str, slack: int = 14) -> DataFrame:
    """First and last bar inside a window, and whether each is within ``slack`` days of its end."""
    a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
    g = bars.where(F.col("date").between(a, b)).groupBy("symbol").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("n"))
    return g.withColumns({"covers_start": F.datediff("first_date", a) <= slack, "covers_end": F.datediff(b, "last_date") <= slack})


def state(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.count_if(F.col("close").isNull()).alias("missing_close"), F.count_if(F.col("volume") <= 0).alias("zero_volume"))


def tradability(orders: DataFrame, bars: DataFrame) -> DataFrame:
    """Why an order (symbol, date) cannot trade; null if it can."""
    df = orders.join(bars.select("symbol", "date", F.lit(True).alias("_bar"), "volume"), ["symbol", "date"], "left")
    return df.select("symbol", "date", F.when(F.col("_bar").isNull(), "no_bar").when(F.col("volume").isNull(), "volume_missing").when(F.col("volume") <= 0, "zero_volume").alias("reason"))


def aligned_dates(bars: DataFrame, members: DataFrame) -> DataFrame:
    """Dates of each strategy on which all its symbols have a real bar."""
    size = members.groupBy("strategy_id").agg(F.count("*").alias("want"))
    have = members.select("strategy_id", "symbol").join(bars.where(F.col("close").isNotNull()).select("symbol", "date"), "symbol").groupBy("strategy_id", "date").agg(F.count_distinct("symbol").alias("have"))
    return have.join(size, "strategy_id").where("have = want").select("strategy_id", "date")


def alignment(bars: DataFrame, members: DataFrame, limit: int = 5) -> DataFrame:
    """Per strategy: values carried on, values that stay missing, dates with all real bars."""
    rows = members.select("strategy_id", "symbol").join(bars.select("symbol", "date", "close"), "symbol")
    grid = rows.select("strategy_id", "date").distinct().join(members.select("strategy_id", "symbol"), "strategy_id").join(rows, ["strategy_id", "symbol", "date"], "left")
    w = W.partitionBy("strategy_id", "symbol").orderBy("date").rowsBetween(-limit, 0)
    grid = grid.withColumn("filled", F.last("close", ignorenulls=True).over(w))
    per = grid.groupBy("strategy_id", "date").agg(F.count_if(F.col("close").isNull() & F.col("filled").isNotNull()).alias("f"), F.count_if(F.col("filled").isNull()).alias("u"), F.count_if(F.col("close").isNull()).alias("m"))
    return per.groupBy("strategy_id").agg(F.sum("f").alias("filled"), F.sum("u").alias("unresolved"), F.count_if(F.col("m") == 0).alias("common_dates"))


def macro_long(wide: DataFrame, default_source: str = "macro") -> DataFrame:
    """Wide macro rows as observations (indicator, observation_date, available_date, value, source); nulls dropped."""
    fields = [c for c in INDICATORS if c in wide.columns]
    source = F.coalesce("source", F.lit(default_source)) if "source" in wide.columns else F.lit(default_source)
    return wide.withColumn("source", source).unpivot(["date", "available_date", "source"], fields, "indicator", "value").where("value is not null").withColumnRenamed("date", "observation_date")


def iso(c: str) -> Column:
    return F.when(F.col(c).rlike(ISO_DATE), F.expr(f"try_cast({c} AS date)"))


def macro_reason(raw: DataFrame) -> DataFrame:
    """First reason against each raw observation (dates and value as text), null if none."""
    seen, public, v = iso("observation_date"), iso("available_date"), F.expr("try_cast(value AS double)")
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    reason = (
        F.when(blank("indicator"), "missing_indicator")
        .when(~F.col("indicator").isin(*INDICATORS), "invalid_schema")
        .when(blank("observation_date"), "missing_observation_date")
        .when(seen.isNull(), "invalid_observation_date")
        .when(blank("available_date"), "missing_available_date")
        .when(public.isNull(), "invalid_available_date")
        .when(public < seen, "available_before_observation")
        .when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), "non_finite_value")
        .when(~F.coalesce(F.col("source").rlike(SOURCE), F.lit(False)), "invalid_schema")
    )
    if "revision" in raw.columns:  # an integer or text that is not blank
        kind = dict(raw.dtypes)["revision"]
        odd = F.trim("revision") == "" if kind == "string" else F.lit(kind not in ("tinyint", "smallint", "int", "bigint", "void"))
        reason = reason.when(F.col("revision").isNotNull() & odd, "invalid_schema")
    for c in {"unit", "frequency"} & set(raw.columns):  # text
        reason = reason.when(F.col(c).isNotNull() & F.lit(dict(raw.dtypes)[c] not in ("string", "void")), "invalid_schema")
    return raw.withColumn("reason", reason)


def macro_dedupe(obs: DataFrame) -> DataFrame:
    """Reason of each accepted observation (with ordinal, revision_type, revision): exact copies keep the first; several rows
    of an (indicator, observation_date) stay only if all have different revisions."""
    same = W.partitionBy("indicator", "observation_date", "available_date", "revision_type", "revision", "value", "source").orderBy("ordinal")
    df = obs.withColumn("_copy", F.row_number().over(same) > 1)
    kept = ~F.col("_copy")
    group = W.partitionBy("indicator", "observation_date")
    n = F.count_if(kept).over(group)
    revisions = F.size(F.collect_set(F.when(kept, F.struct("revision_type", "revision"))).over(group))
    missing = F.count_if(kept & F.col("revision").isNull()).over(group)
    df = df.withColumn("_bad", (n > 1) & ((missing > 0) | (revisions < n)))
    return df.withColumn("reason", F.when(F.col("_copy"), "duplicate_version").when(F.col("_bad"), "duplicate_observation")).drop("_copy", "_bad")


def macro_summary(judged: DataFrame) -> DataFrame:
    """One row: counts, ratio, status, and whether observation dates came out of order (by ordinal)."""
    top = F.max("observation_date").over(W.partitionBy("indicator").orderBy("ordinal").rowsBetween(W.unboundedPreceding, -1))
    df = judged.withColumn("_late", F.coalesce(F.col("observation_date") < top, F.lit(False)))
    g = df.agg(F.count("*").alias("raw"), F.count_if(F.col("reason").isNull()).alias("valid"), F.count_if(F.col("_late")).alias("late"))
    status = F.when(F.col("raw") == 0, "empty").when(F.col("valid") == F.col("raw"), "valid").when(F.col("valid") > 0, "partial").otherwise("invalid")
    return g.select("raw", "valid", (F.col("raw") - F.col("valid")).alias("rejected"), F.when(F.col("raw") > 0, F.col("valid") / F.col("raw")).alias("coverage_ratio"), status.alias("status"), (F.col("late") > 0).alias("unsorted_dates"))


def macro_indicators(judged: DataFrame) -> DataFrame:
    ok = F.col("reason").isNull()
    return judged.groupBy("indicator").agg(
        F.count("*").alias("raw_rows"), F.count_if(ok).alias("valid_rows"), F.count_distinct(F.when(ok, F.struct("observation_date", F.coalesce("revision_type", F.lit("")), F.coalesce("revision", F.lit(""))))).alias("versions"),
        F.min(F.when(ok, F.col("observation_date"))).alias("first_observation"), F.max(F.when(ok, F.col("observation_date"))).alias("last_observation"), F.min(F.when(ok, F.col("available_date"))).alias("first_available"), F.max(F.when(ok, F.col("available_date"))).alias("last_available"),
    )


def macro_pit(valid: DataFrame, signals: DataFrame) -> DataFrame:
    """How many signal dates find all, some or none of the indicators public, and how many look past a record.

    A sweep over days, one row each: the indicators (a bit each) that become public on it, and the records observed but not yet
    public that begin and end. A signal date sees the running OR of the bits and the running number of such records.
    """
    o, a = F.col("observation_date"), F.col("available_date")
    bit = F.call_function("shiftleft", F.lit(1), F.array_position(F.array(*map(F.lit, INDICATORS)), F.col("indicator")).cast("int") - 1)
    waits = F.coalesce(o < a, F.lit(False)).cast("int")
    moments = F.array(*[F.struct(day.alias("day"), bits.alias("bits"), waiting.alias("waiting"), seen.alias("seen")) for day, bits, waiting, seen in ((F.when(o.isNotNull() & a.isNotNull(), F.greatest(o, a)), bit, F.lit(0), o), (o, F.lit(0), waits, o), (a, F.lit(0), -waits, o))])
    happened = valid.select(F.inline(moments)).withColumn("asked", F.lit(0)).where("day is not null")
    asked = signals.select(F.col("signal_date").alias("day"), F.lit(0), F.lit(0), F.lit(None).cast("date"), F.lit(1))
    days = happened.union(asked).groupBy("day").agg(F.bit_or("bits").alias("bits"), F.sum("waiting").alias("waiting"), F.max("seen").alias("seen"), F.sum("asked").alias("asked"))
    every = W.partitionBy()  # days of a calendar
    so_far = every.orderBy("day").rangeBetween(W.unboundedPreceding, W.currentRow)
    rows = days.withColumns({"have": F.bit_or("bits").over(so_far), "want": F.bit_or("bits").over(every), "open": F.sum("waiting").over(so_far), "last": F.max("seen").over(every)}).where("asked > 0")
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("asked"))), F.lit(0)).cast("long")
    have, want = F.col("have"), F.col("want")
    return rows.agg(F.coalesce(F.sum("asked"), F.lit(0)).cast("long").alias("signal_dates"), n(have == want).alias("fully_available"), n((have != 0) & (have != want)).alias("partially_available"), n(have == 0).alias("unavailable"), n(F.col("last") > F.col("day")).alias("future_observation"), n(F.col("open") > 0).alias("future_available_date"))


def valuation_reason(raw: DataFrame) -> DataFrame:
    """First reason against each valuation record (dates and value as text), null if none."""
    seen, public, v = iso("observation_date"), iso("available_date"), F.expr("try_cast(value AS double)")
    reason = (
        F.when(~F.coalesce(F.col("symbol").rlike("^[0-9]{6}$"), F.lit(False)) | ~F.coalesce(F.col("metric").isin(*METRICS), F.lit(False)) | seen.isNull(), "invalid_schema")
        .when(F.col("available_date").isNull(), "missing_available_date")
        .when(public.isNull() | (public < seen), "invalid_schema")
        .when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), "non_finite_value")
        .when(~F.coalesce(F.col("source").rlike(SOURCE), F.lit(False)) | F.col("unit").isNull() | (F.trim("unit") == ""), "invalid_schema")
    )
    return raw.withColumn("reason", reason)


def valuation_availability(records: DataFrame, requested: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Per requested symbol and as-of date: metrics at hand and missing, status and reason."""
    asked = requested.crossJoin(cutoffs)  # a row for each pair is what is asked for
    df = asked.join(records.select("symbol", "metric", "available_date"), ["symbol", "metric"], "left")
    public = F.col("available_date") <= F.col("as_of")
    g = df.groupBy("symbol", "as_of").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(public, F.col("metric")))), ",").alias("available_metrics"), F.count_distinct("metric").alias("want"), F.count_distinct(F.when(public, F.col("metric"))).alias("have"),
        F.count_if(public).alias("accepted"), F.count_if(F.col("available_date") > F.col("as_of")).alias("rejected"), F.array_sort(F.collect_set("metric")).alias("_all"), F.collect_set(F.when(public, F.col("metric"))).alias("_have"),
    )
    status = F.when(F.col("have") == F.col("want"), "available").when(F.col("have") > 0, "partial").otherwise("unavailable")
    reason = F.when(F.col("have") == F.col("want"), "success").when(F.col("rejected") > 0, "future_available_date").when(F.col("have") > 0, "historical_valuation_unavailable").otherwise("empty_response")
    return g.select("symbol", "as_of", status.alias("status"), reason.alias("reason"), "available_metrics", F.array_join(F.array_except("_all", "_have"), ",").alias("missing_metrics"), "accepted", "rejected", (F.col("have") / F.col("want")).alias("coverage_ratio"))


def benchmark_coverage(requested: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row: status and symbol lists of requested benchmarks that have metrics."""
    df = requested.join(metrics.select("symbol").distinct().withColumn("_has", F.lit(True)), "symbol", "left").withColumn("_has", F.coalesce("_has", F.lit(False)))
    names = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("symbol")))), ",")
    g = df.agg(names(F.col("_has")).alias("available"), names(~F.col("_has")).alias("unavailable"), F.count_if("_has").alias("n"), F.count("*").alias("want"))
    return g.select(F.when(F.col("n") == 0, "unavailable").when(F.col("n") < F.col("want"), "partial").otherwise("available").alias("status"), "available", "unavailable")


def run_coverage(requested: DataFrame, prices: DataFrame, fundamentals: DataFrame, holdings: DataFrame, benchmark: DataFrame, macro_rows: DataFrame, factor_overall: DataFrame) -> DataFrame:
    """One row per run_id: symbols requested, found and failed, ratios, holdings, benchmark status, factor coverage."""
    r = requested.join(prices.select("run_id", "symbol").distinct().withColumn("_p", F.lit(1)), ["run_id", "symbol"], "left").join(fundamentals.select("run_id", "symbol").distinct().withColumn("_f", F.lit(1)), ["run_id", "symbol"], "left")
    names = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("symbol")))), ",")
    has, miss = F.col("_p").isNotNull(), F.col("_p").isNull()
    g = r.groupBy("run_id").agg(F.count("*").alias("requested"), F.count_if(has).alias("successful_prices"), names(miss).alias("failed_prices"), (F.count_if(has) / F.count("*")).alias("price_coverage_ratio"), names(has & F.col("_f").isNull()).alias("failed_fundamentals"))
    h = holdings.groupBy("run_id", "date").agg(F.count_if(F.col("weight") > 0).alias("n")).groupBy("run_id").agg(F.count("*").alias("rebalance_count"), F.min("n").alias("least_holdings"))
    f = factor_overall.groupBy("run_id").agg(F.min("coverage_ratio").alias("least_factor_coverage"))
    m = macro_rows.groupBy("run_id").agg(F.count("*").alias("macro_observations"))
    out = g.join(h, "run_id", "left").join(benchmark.select("run_id", F.col("status").alias("benchmark_status")), "run_id", "left").join(m, "run_id", "left").join(f, "run_id", "left")
    return out.fillna(0, ["rebalance_count", "macro_observations"]).fillna("unavailable", ["benchmark_status"])


def run_status(coverage: DataFrame, min_holdings: int, threshold: float = MIN_RATIO) -> DataFrame:
    """failed, partial_success or success with the reasons."""
    reasons = F.array_compact(
        F.array(
            F.when(F.col("failed_prices") != "", F.lit("candidate_prices_unavailable")),
            F.when(F.col("benchmark_status") != "available", F.lit("benchmarks_unavailable")),
            F.when(F.col("macro_observations") == 0, F.lit("macro_neutral")),
            F.when(F.col("least_holdings") < min_holdings, F.lit("below_min_holdings")),
            F.when(F.col("least_factor_coverage") < threshold, F.lit("insufficient_factor_coverage")),
        )
    )
    failed = (F.col("successful_prices") == 0) | (F.col("rebalance_count") == 0)
    return coverage.select("run_id", F.when(failed, "failed").when(F.size(reasons) > 0, "partial_success").otherwise("success").alias("status"), F.when(failed, "no_price_or_rebalance_coverage").otherwise(F.array_join(reasons, ",")).alias("reasons"))
