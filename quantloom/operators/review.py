"""Review tables over runs: warnings, lists of runs, evidence, risk flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Categories in order, with words one of which a warning holds (fixed values).
CATEGORIES = {
    "benchmark": ("benchmark",),
    "price_provider": ("price provider", "price endpoint"),
    "price_quality": ("price quality", "zero-volume", "no bar on rebalance", "suspended", "untradeable", "date has gaps"),
    "macro_data": ("macro", "neutral multiplier"),
    "universe_bias": ("universe", "survivorship"),
    "portfolio_constraints": ("min_holdings", "max_position_weight", "max_industry_weight", "cash_weight", "industry classification", "unallocated equity", "target holdings"),
    "point_in_time": ("point-in-time", "available_date", "published after", "future-report"),
    "fundamental_data": ("fundamental", "historical pe", "historical pb", "dividend_yield"),
    "factor_coverage": ("factor warning", "excluded unavailable factors", "missing pe", "missing pb", "missing roe", "beta scoring", "factor coverage"),
}
#: Severities and scopes of a warning, forms of its source and of the artifacts that it names, and the names of those (fixed values).
SEVERITIES = ("info", "warning", "error")
SCOPES = ("price_provider", "benchmark", "fundamental", "macro", "universe", "factor", "portfolio")
SOURCE = r"^[a-z][a-z0-9_.-]*$"
ARTIFACT = r"^[A-Za-z0-9][A-Za-z0-9_.-]*\.(?:json|parquet)(?:#(?:/[^#]*)?)?$"
ARTIFACTS = (
    "config.json", "run_manifest.json", "metrics.json", "benchmark_metrics.json", "benchmark_diagnostics.json", "warnings.json",
    "equity_curve.parquet", "benchmark_curve.parquet", "holdings.parquet", "trades.parquet", "factor_snapshots.parquet",
)


def dedupe(warnings: DataFrame) -> DataFrame:
    """(run_id, message) once, at its first place."""
    return warnings.groupBy("run_id", "message").agg(F.min("seq").alias("seq"))


def categorize(warnings: DataFrame) -> DataFrame:
    text, out = F.lower("message"), F.lit("system")
    for name, words in reversed(CATEGORIES.items()):
        out = F.when(reduce(lambda a, b: a | b, (text.contains(w) for w in words)), name).otherwise(out)
    return warnings.withColumn("category", out)


def summarize(warnings: DataFrame, k: int = 3) -> DataFrame:
    """Per run and category: total, the first k messages, whether more were left out."""
    w = W.partitionBy("run_id", "category").orderBy("seq")
    df = warnings.withColumn("_k", F.row_number().over(w))
    g = df.groupBy("run_id", "category").agg(F.count("*").alias("total"), F.array_sort(F.collect_list(F.when(F.col("_k") <= k, F.struct("_k", "message")))).alias("s"))
    return g.select("run_id", "category", "total", F.array_join(F.transform("s", lambda x: x["message"]), " | ").alias("samples"), (F.col("total") > k).alias("truncated"))


def totals(warnings: DataFrame) -> DataFrame:
    """(run_id, dimension, value, total): warnings of each run by every category, severity and scope, also where there are none.

    Categories count all warnings; severities and scopes those that are well formed (``reason`` null).
    """
    names = {"category": (*CATEGORIES, "system"), "severity": SEVERITIES, "scope": SCOPES}
    pair = lambda d, v: F.struct(F.lit(d).alias("dimension"), v.alias("value"))
    good = F.col("reason").isNull()
    seen = warnings.select("run_id", F.inline(F.array(*[F.struct(F.lit(d).alias("dimension"), (F.col(d) if d == "category" else F.when(good, F.col(d))).alias("value")) for d in names]))).where("value is not null")
    every = warnings.select("run_id").distinct().select("run_id", F.inline(F.array(*[pair(d, F.lit(v)) for d, values in names.items() for v in values])))
    counted = seen.groupBy("run_id", "dimension", "value").agg(F.count("*").alias("total"))
    return every.join(counted, ["run_id", "dimension", "value"], "left").fillna(0, ["total"])


def validate(warnings: DataFrame) -> DataFrame:
    """First reason against each warning, null if none: severity, scope, message, source, then the artifacts it names (an array, may be null)."""
    unknown = lambda c, names: ~F.coalesce(F.col(c).isin(*names), F.lit(False))
    bad = F.exists(F.coalesce("artifact_refs", F.array().cast("array<string>")), lambda r: r.isNull() | ~r.rlike(ARTIFACT) | ~F.substring_index(r, "#", 1).isin(*ARTIFACTS))
    reason = (
        F.when(unknown("severity", SEVERITIES), "invalid_severity")
        .when(unknown("scope", SCOPES), "invalid_scope")
        .when(F.trim(F.coalesce("message", F.lit(""))) == "", "empty_message")
        .when(~F.coalesce(F.col("source").rlike(SOURCE), F.lit(False)), "invalid_source")
        .when(bad, "invalid_artifact_reference")
    )
    return warnings.withColumn("reason", reason)


def runs(table: DataFrame, limit: int = 20) -> DataFrame:
    return table.orderBy(F.desc("run_time"), F.desc("run_id")).limit(limit)


def numeric_summary(df: DataFrame, value: str, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(value).alias("count"), F.min(value).alias("min"), F.avg(value).alias("mean"), F.max(value).alias("max"))


def holdings_evidence(holdings: DataFrame) -> DataFrame:
    """Per run: rebalances, latest date, holdings and cash weight there, range of cash weights."""
    d = holdings.groupBy("run_id", "date").agg(F.count_if(F.col("weight") > 0).alias("n"), F.max("cash_weight").alias("cash"))
    return d.groupBy("run_id").agg(F.count("*").alias("rebalances"), F.max("date").alias("latest"), F.max_by("n", "date").alias("latest_holdings"), F.max_by("cash", "date").alias("latest_cash"), F.min("cash").alias("least_cash"), F.max("cash").alias("most_cash"))


def factor_evidence(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy("run_id").agg(F.count("*").alias("rows"), F.count_distinct("symbol").alias("symbols"), F.max("date").alias("latest"), F.count_if("selected").alias("selected"), F.min("score").alias("least"), F.max("score").alias("most"))


def trade_evidence(trades: DataFrame) -> DataFrame:
    return trades.groupBy("run_id").agg(F.count("*").alias("trades"), F.count_if(F.col("side") == "buy").alias("buys"), F.count_if(F.col("side") == "sell").alias("sells"), F.sum("trade_value").alias("value"), F.sum("cost").alias("cost"), F.max("date").alias("latest"))


def holdings_long(wide: DataFrame, keys: tuple[str, ...], date: str | None = None) -> DataFrame:
    """(keys, symbol, weight) of a wide table with a column a symbol; positive weights only, of one date if given."""
    df = wide.where(F.col("date") == F.lit(date).cast("date")) if date else wide
    return df.unpivot(list(keys), [c for c in df.columns if c not in keys], "symbol", "weight").where("weight > 0")


def latest_rows(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The n newest rows of each run."""
    w = W.partitionBy("run_id").orderBy(F.desc("date"), *order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def downsample(curve: DataFrame, k: int, by: str = "strategy_id") -> DataFrame:
    """k evenly spaced rows of each curve with both ends; positions round half to even."""
    df = curve.withColumns({"_i": F.row_number().over(W.partitionBy(by).orderBy("date")) - 1, "_n": F.count("*").over(W.partitionBy(by))})
    at = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / (k - 1)).cast("long"))
    return df.where((F.col("_n") <= k) | F.array_contains(at, F.col("_i").cast("long"))).drop("_i", "_n")


#: Limits of the flags (fixed values): warnings and price coverage of a run; drawdown (medium, high), largest weight, cash.
MANY_WARNINGS, LITTLE_COVERAGE = 100, 0.5
DRAWDOWN, CONCENTRATION, MUCH_CASH = (-0.2, -0.35), 0.12, 0.3


def _fired(df: DataFrame, name: str, rules: dict[str, tuple[Column, Column | str]], otherwise: str | None = None) -> DataFrame:
    """(run_id, name, severity) of the rules {value: (condition, severity)} that hold in each row; ``otherwise`` with severity low if none does."""
    pair = lambda value, severity: F.struct(F.lit(value).alias(name), severity.alias("severity"))
    flags = F.array_compact(F.array(*[F.when(when, pair(value, F.lit(severity) if isinstance(severity, str) else severity)) for value, (when, severity) in rules.items()]))
    if otherwise:
        flags = F.when(F.size(flags) > 0, flags).otherwise(F.array(pair(otherwise, F.lit("low"))))
    return df.select("run_id", F.explode(flags).alias("f")).select("run_id", "f.*")


def risk_flags(coverage: DataFrame, min_holdings: int = 3, threshold: float = 0.8) -> DataFrame:
    """(run_id, code, severity) of runs' coverage rows with run_status, warning_count and reported_warning_count."""
    c = F.col
    high_if = lambda x: F.when(x, "high").otherwise("medium")
    return _fired(coverage, "code", {
        "run_not_complete": (c("run_status") != "success", high_if(c("run_status") == "failed")),
        "benchmark_not_available": (c("benchmark_status") != "available", "medium"),
        "persisted_warnings": (c("warning_count") > 0, high_if(c("warning_count") >= MANY_WARNINGS)),
        "warning_count_mismatch": (c("reported_warning_count") != c("warning_count"), "medium"),
        "incomplete_price_coverage": (c("price_coverage_ratio") < 1, high_if(c("price_coverage_ratio") < LITTLE_COVERAGE)),
        "macro_neutral_fallback": (c("macro_observations") == 0, "medium"),
        "holdings_below_minimum": (c("least_holdings") < min_holdings, "medium"),
        "insufficient_factor_coverage": (c("least_factor_coverage") < threshold, "medium"),
    })


def metric_flags(metrics: DataFrame) -> DataFrame:
    """(run_id, category, severity) by drawdown, largest weight, cash and warnings of a run; general if none fires."""
    d, t = F.col("max_drawdown"), F.col("top_weight")
    return _fired(metrics, "category", {
        "drawdown": (d.isNotNull(), F.when(d <= DRAWDOWN[1], "high").when(d <= DRAWDOWN[0], "medium").otherwise("low")),
        "concentration": (t.isNotNull(), F.when(t >= CONCENTRATION, "medium").otherwise("low")),
        "cash_weight": (F.col("cash_weight") >= MUCH_CASH, "medium"),
        "pipeline_warnings": (F.col("warning_count") > 0, "medium"),
    }, "general_review")


def consistency(weights: DataFrame, selected: DataFrame, curve: DataFrame) -> DataFrame:
    """Per run: weights sum to at most 1, every selected symbol has a weight, the curve is not empty."""
    total = weights.groupBy("run_id", "date").agg(F.sum("weight").alias("t")).groupBy("run_id").agg((F.max("t") <= 1 + 1e-9).alias("weights_ok"))
    lacking = selected.join(weights, ["run_id", "date", "symbol"], "left_anti").groupBy("run_id").agg(F.count("*").alias("lacking"))
    points = curve.groupBy("run_id").agg(F.count("*").alias("points"))
    df = total.join(lacking, "run_id", "left").join(points, "run_id", "left").fillna(0, ["lacking", "points"])
    return df.select("run_id", "weights_ok", (F.col("lacking") == 0).alias("selected_ok"), (F.col("points") > 0).alias("curve_ok"))
