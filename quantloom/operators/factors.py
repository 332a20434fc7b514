"""Factor scores per symbol and as-of date. Missing components leave the mean; no component at all scores 50."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scores import average_available, center, higher, lower
from ..functions.windows import by, full, guard, lag, last_rows, sma

#: Least observations of each component (fixed values).
READINESS = {
    "momentum_6m_ex_1m": 148,
    "momentum_12m_ex_1m": 274,
    "annualized_volatility": 253,
    "max_drawdown": 253,
    "rsi": 15,
    "bollinger_position": 20,
    "short_term_return": 21,
    "volume_ratio": 60,
}
#: Raw fields of each factor that make it available.
FIELDS = {
    "value": ("pe", "pb", "dividend_yield", "valuation_percentile"),
    "quality": ("roe", "gross_margin", "net_margin", "operating_cash_flow_quality", "debt_ratio"),
    "momentum": ("momentum_6m", "momentum_12m"),
    "low_vol": ("annualized_volatility", "max_drawdown"),
    "obos": ("rsi", "bollinger_position", "short_term_return", "volume_ratio_60"),
}
WEIGHTS = {"value": 0.25, "quality": 0.25, "momentum": 0.2, "low_vol": 0.15, "obos": 0.15}


def positive(c: str) -> Column:
    return F.when(F.col(c) > 0, F.col(c))


def inputs(df: DataFrame) -> DataFrame:
    """Cash-flow quality: operating cash flow over a net profit that is not 0."""
    return df.withColumn("operating_cash_flow_quality", F.when(F.col("net_profit") != 0, F.col("operating_cash_flow") / F.col("net_profit")))


def metric(df: DataFrame, name: str, aliases: tuple[str, ...]) -> DataFrame:
    """The first of several columns that holds a number."""
    return df.withColumn(name, F.coalesce(*[F.expr(f"try_cast(`{a}` AS double)") for a in aliases if a in df.columns]))


def value(df: DataFrame) -> DataFrame:
    pct = F.col("valuation_percentile") if "valuation_percentile" in df.columns else F.lit(None).cast("double")
    return df.withColumn("value_score", average_available(lower(positive("pe"), 8, 60), lower(positive("pb"), 0.8, 8), higher(F.col("dividend_yield"), 0.0, 0.06), lower(pct, 0.1, 0.9)))


def quality(df: DataFrame) -> DataFrame:
    c = F.col
    return df.withColumn("quality_score", average_available(higher(c("roe"), 0.0, 0.25), higher(c("gross_margin"), 0.1, 0.6), higher(c("net_margin"), 0.02, 0.25), higher(c("operating_cash_flow_quality"), 0.5, 1.5), lower(c("debt_ratio"), 0.2, 0.8)))


def momentum(bars: DataFrame) -> DataFrame:
    """6 and 12 month momentum without the last month, on every row."""
    past = lambda n: F.when(lag("close", n) > 0, lag("close", 21) / lag("close", n) - 1)
    df = bars.withColumns({"momentum_6m": past(147), "momentum_12m": past(273)})
    return df.withColumn("momentum_score", average_available(higher(F.col("momentum_6m"), -0.2, 0.5), higher(F.col("momentum_12m"), -0.3, 0.8)))


def sliding_drawdown(close: str, place: str, n: int) -> tuple[dict[str, Column], dict[str, Column], Column]:
    """The largest drawdown inside the last n closes (positive ones), from states of blocks of n rows that merge.

    The state of some rows in order is their highest and lowest close and their worst drop; two states merge into the higher and lower of these, and the worst
    of both drops and of the later low against the earlier top. The last n rows are the end of one block and the beginning of
    the next, so running states forward and backward in a block give each window by one merge, whatever n is.
    Two steps of columns to add, and the drawdown; ``place`` numbers a symbol's rows from 0.
    """
    block = F.floor(F.col(place) / n)
    forward = W.partitionBy("symbol", block).orderBy(place).rowsBetween(W.unboundedPreceding, 0)
    backward = W.partitionBy("symbol", block).orderBy(F.desc(place)).rowsBetween(W.unboundedPreceding, 0)
    x = F.col(close)
    first = {"_top": F.max(x).over(forward), "_low": F.min(x).over(forward), "_top_on": F.max(x).over(backward), "_low_on": F.min(x).over(backward)}
    second = {"_drop": F.min(x / F.col("_top") - 1).over(forward), "_drop_on": F.min(F.col("_low_on") / x - 1).over(backward)}
    start = lambda c: lag(c, n - 1)
    merged = F.least("_drop", start("_drop_on"), F.col("_low") / start("_top_on") - 1)
    return first, second, F.when(F.col(place) % n == n - 1, F.col("_drop")).otherwise(merged)


def low_vol(bars: DataFrame, n: int = READINESS["max_drawdown"], at: DataFrame | None = None) -> DataFrame:
    """Annualised deviation of n - 1 returns and the drawdown inside the last n closes, on every row or on the rows ``at`` (symbol, date)."""
    df = bars.withColumns({"_r": F.col("close") / lag("close") - 1, "_rn": F.row_number().over(by()) - 1, "_have": F.count("close").over(last_rows(n))})
    vol = F.when(F.col("_rn") >= n - 1, full(F.stddev_samp, "_r", n - 1) * F.sqrt(F.lit(252.0)))
    first, second, worst = sliding_drawdown("close", "_rn", n)
    df = df.withColumn("annualized_volatility", vol).withColumns(first).withColumns(second).withColumn("max_drawdown", F.when(F.col("_have") == n, worst))
    if at is not None:
        df = df.join(at.select("symbol", "date").distinct(), ["symbol", "date"], "left_semi")
    return df.withColumn("low_vol_score", average_available(lower(F.col("annualized_volatility"), 0.12, 0.6), lower(F.abs("max_drawdown"), 0.08, 0.5))).drop("_r", "_rn", "_have", *first, *second)


def obos(bars: DataFrame) -> DataFrame:
    """RSI with its first change unknown, Bollinger position, 20-row return and volume ratio, on every row."""
    step = F.col("close") - lag("close")
    df = bars.withColumns({"_gain": F.greatest(step, F.lit(0.0)), "_loss": F.greatest(-step, F.lit(0.0)), "_has": step.isNotNull()})
    df = df.withColumns({"_gain": F.when(F.col("_has"), F.col("_gain")), "_loss": F.when(F.col("_has"), F.col("_loss"))}).withColumns({"_g": sma("_gain", 14), "_l": sma("_loss", 14), "_mid": sma("close", 20), "_sd": full(F.stddev_samp, "close", 20), "_base": lag("close", 20), "_vol": sma("volume", 60)})
    df = df.withColumns(
        {
            "rsi": F.when(F.col("_l") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("_g") / guard(F.col("_l")))),
            "bollinger_position": F.when(F.col("_sd") == 0, 0.5).otherwise((F.col("close") - (F.col("_mid") - 2 * F.col("_sd"))) / (4 * guard(F.col("_sd")))),
            "short_term_return": F.when(F.col("_base") > 0, F.col("close") / F.col("_base") - 1),
            "volume_ratio_60": F.when(F.col("_vol") > 0, F.col("volume") / F.col("_vol")),
        }
    )
    score = average_available(center(F.col("rsi"), 50, 35), center(F.col("bollinger_position"), 0.5, 0.5), center(F.col("short_term_return"), 0.0, 0.25), lower(F.abs(F.col("volume_ratio_60") - 1), 0, 2))
    return df.withColumn("obos_score", score).drop("_gain", "_loss", "_has", "_g", "_l", "_mid", "_sd", "_base", "_vol")


def readiness(counts: DataFrame) -> DataFrame:
    """Of observation counts (symbol, observations): each component, its minimum, whether it is ready, and a message."""
    need = F.explode(F.create_map(*[F.lit(x) for k, n in READINESS.items() for x in (k, n)])).alias("component", "minimum")
    df = counts.select("symbol", "observations", need)
    message = F.concat(F.lit("insufficient "), "component", F.lit(" observations: "), F.col("observations").cast("string"), F.lit(" available, "), F.col("minimum").cast("string"), F.lit(" required"))
    return df.withColumn("ready", F.col("observations") >= F.col("minimum")).withColumn("message", F.when(~F.col("ready"), message))


def availability(df: DataFrame) -> DataFrame:
    """<factor>_fields: raw fields at hand; <factor>_available: any."""
    out = {}
    for factor, fields in FIELDS.items():
        n = reduce(lambda a, b: a + b, (F.col(f).isNotNull().cast("int") if f in df.columns else F.lit(0) for f in fields))
        out |= {f"{factor}_fields": n, f"{factor}_available": n > 0}
    return df.withColumns(out)


def composite(df: DataFrame, weights: dict[str, float] | None = None, only_available: bool = False) -> DataFrame:
    """Weighted mean of the factor scores; with ``only_available`` over available factors, null if there is none."""
    weights = WEIGHTS if weights is None else weights
    if any(w < 0 for w in weights.values()) or not sum(weights.values()):
        raise ValueError("weights must not be negative and must not sum to 0")
    on = lambda k: F.when(F.col(f"{k}_available"), F.lit(w)).otherwise(0.0) if only_available else F.lit(w)
    total, score = F.lit(0.0), F.lit(0.0)
    for k, w in weights.items():
        total, score = total + on(k), score + on(k) * F.coalesce(f"{k}_score", F.lit(0.0))
    return df.withColumn("composite_score", F.when(total > 0, score / total))


def buckets(scores: DataFrame, by: str) -> DataFrame:
    c = F.col("composite_score")
    return scores.groupBy(by).agg(F.count_if(c >= 80).alias("high"), F.count_if((c >= 60) & (c < 80)).alias("middle"), F.count_if(c < 60).alias("low"), F.avg(c).alias("mean"), F.min(c).alias("min"), F.max(c).alias("max"))


def coverage(scores: DataFrame) -> DataFrame:
    """Available and missing symbols per factor and date, and (date null) per factor over all dates."""
    long = F.explode(F.array(*[F.struct(F.lit(k).alias("factor"), F.col(f"{k}_available").alias("available")) for k in FIELDS])).alias("x")
    df = scores.select("signal_date", long).select("signal_date", "x.*")
    out = df.rollup("factor", "signal_date").agg(F.count_if("available").alias("available"), F.count("*").alias("total"), F.grouping_id().alias("g")).where("g < 3")
    return out.select("factor", "signal_date", "available", (F.col("total") - F.col("available")).alias("missing"), (F.col("available") / F.col("total")).alias("coverage_ratio"))
