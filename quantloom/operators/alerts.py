"""Alert rules on the rows of each symbol: on the last one, on every one, or on a stream of them.

Rules: (rule_id, symbol, kind, direction, threshold, active); kinds price, pct, volume, macd. Alerts: (rule_id, symbol, date, kind,
severity, value). A state row has what the rules need of a bar or tick and those before it; a rule fires on a state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.windows import by, lag
from .indicators import ewm

KINDS = ("price", "pct", "volume", "macd")
#: What a rule looks at: this row's and the one before's price and MACD, the mean of the 19 volumes before, and the rows so far.
STATE = ("symbol", "date", "close", "volume", "before", "macd", "macd_signal", "macd1", "signal1", "mean19", "rows")
#: Rules that are sent to all tasks of a stream; more of them meet its states by a shuffle.
SENT = 100_000


def states(bars: DataFrame, block: Column | None = None) -> DataFrame:
    """The state of every bar; ``block`` as for ``ewm``."""
    mean = F.avg("volume").over(by().rowsBetween(-19, -1))
    df = ewm(bars, block).withColumns({"before": lag("close"), "macd1": lag("macd"), "signal1": lag("macd_signal"), "mean19": mean, "rows": F.row_number().over(by())})
    return df.select(*STATE)


def latest(bars: DataFrame) -> DataFrame:
    """Each symbol's last state; symbols with fewer than two rows have none."""
    return states(bars).withColumn("_k", F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("date")))).where("_k = 1 and rows >= 2").select(*STATE)


def _over(x: Column, y: Column) -> Column:
    """x / y, by a y of zero infinite or NaN, as floats divide elsewhere; Spark ends the job there."""
    return F.when(y == 0, x * F.pow(y, F.lit(-1.0))).otherwise(x / F.nullif(y, F.lit(0.0)))


def _tests() -> dict[str, tuple[Column, Column, Column]]:
    """By kind: whether a rule fires on a state, its value and its severity."""
    t, d = F.col("threshold"), F.col("direction")
    price, change, times = F.col("close"), (_over(F.col("close"), F.col("before")) - 1) * 100, _over(F.col("volume"), F.col("mean19"))
    golden = (F.col("macd1") <= F.col("signal1")) & (F.col("macd") > F.col("macd_signal"))
    death = (F.col("macd1") >= F.col("signal1")) & (F.col("macd") < F.col("macd_signal"))
    return {
        "price": (((d == "above") & (price > t)) | ((d == "below") & (price < t)), price, F.lit("warning")),
        "pct": (((d == "up") & (change >= t)) | ((d == "down") & (change <= -t)) | ((d == "any") & (F.abs(change) >= t)), change, F.when(F.abs(change) >= 10, "critical").otherwise("warning")),
        "volume": ((F.col("rows") >= 20) & (F.col("mean19") > 0) & (times > t), times, F.lit("info")),
        "macd": ((golden & d.isin("golden", "any")) | (death & d.isin("death", "any")), F.col("macd") - F.col("macd_signal"), F.when(golden, "info").otherwise("warning")),
    }


def fired(rules: DataFrame, on: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Alerts of the active rules of some kinds on states: one join by symbol, in a stream with the rules as its static side."""
    tests = _tests()
    fires = value = severity = F.when(F.lit(False), None)
    for k in kinds:
        fires, value, severity = (out.when(F.col("kind") == k, x) for out, x in zip((fires, value, severity), tests[k], strict=True))
    active = rules.where(F.col("active") & F.col("kind").isin(*kinds)).select("rule_id", "symbol", "kind", "direction", "threshold")
    if on.isStreaming:
        # A batch without new ticks looks empty to Spark, which would send all the states that it gives out through the driver.
        active = F.broadcast(active) if active.limit(SENT + 1).count() <= SENT else active.hint("merge")
    return on.where("rows >= 2").join(active, "symbol").where(fires).select("rule_id", "symbol", "date", "kind", severity.alias("severity"), value.cast("double").alias("value"))


def price(rules: DataFrame, on: DataFrame) -> DataFrame:
    return fired(rules, on, ("price",))


def pct(rules: DataFrame, on: DataFrame) -> DataFrame:
    return fired(rules, on, ("pct",))


def volume(rules: DataFrame, on: DataFrame) -> DataFrame:
    return fired(rules, on, ("volume",))


def macd_cross(rules: DataFrame, on: DataFrame) -> DataFrame:
    return fired(rules, on, ("macd",))


def every(rules: DataFrame, bars: DataFrame) -> DataFrame:
    """Alerts of all kinds on each symbol's last bar."""
    return fired(rules, latest(bars))


def history(rules: DataFrame, bars: DataFrame) -> DataFrame:
    """Alerts of all kinds on every bar that has one before it."""
    return fired(rules, states(bars))
