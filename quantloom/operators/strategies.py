"""Strategy signals as windows, and the single-asset backtest without a loop.

State machines become "the side last taken": a signal fires where the side differs from the last one taken before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.windows import by, lag, sma, so_far
from .indicators import simple_rsi


def _row(df: DataFrame) -> DataFrame:
    return df.withColumns({"_rn": F.row_number().over(by()), "_n": F.count("*").over(W.partitionBy("symbol"))})


def buy_hold(bars: DataFrame) -> DataFrame:
    """Buy the first row, sell the last."""
    signal = F.when(F.col("_rn") == F.col("_n"), "sell").when(F.col("_rn") == 1, "buy").otherwise("hold")
    return _row(bars).select("symbol", "date", "close", signal.alias("signal"))


def from_side(df: DataFrame) -> DataFrame:
    """Signals from a side of 1, -1 or null a row: enter on 1, leave on -1, leave on the last row when still in."""
    before = F.last("side", ignorenulls=True).over(by().rowsBetween(W.unboundedPreceding, -1))
    df = df.withColumn("_before", before)
    fire = F.when((F.col("side") == 1) & (F.coalesce("_before", F.lit(-1)) != 1), "buy").when((F.col("side") == -1) & (F.col("_before") == 1), "sell")
    now = F.last("side", ignorenulls=True).over(so_far())
    df = df.withColumns({"_fire": fire, "_now": now})
    signal = F.when((F.col("_rn") == F.col("_n")) & (F.col("_now") == 1), "sell").otherwise(F.coalesce("_fire", F.lit("hold")))
    return df.select("symbol", "date", "close", signal.alias("signal"))


def sma_cross(bars: DataFrame) -> DataFrame:
    """In while the 20-row mean is above the 60-row mean, from row 61 on."""
    df = _row(bars).withColumns({"_fast": sma("close", 20), "_slow": sma("close", 60)})
    side = F.when(F.col("_rn") > 60, F.when(F.col("_fast") > F.col("_slow"), 1).when(F.col("_fast") < F.col("_slow"), -1))
    return from_side(df.withColumn("side", side))


def rsi(bars: DataFrame) -> DataFrame:
    """In below 30, out above 70, from row 15 on."""
    gain, loss = simple_rsi()
    df = _row(bars).withColumns({"_gain": gain, "_loss": loss})
    value = 100 - 100 / (1 + sma("_gain", 14) / (sma("_loss", 14) + 1e-10))
    df = df.withColumn("_rsi", value)
    return from_side(df.withColumn("side", F.when(F.col("_rn") > 14, F.when(F.col("_rsi") < 30, 1).when(F.col("_rsi") > 70, -1))))


def dual_ma(bars: DataFrame) -> DataFrame:
    """Crossings of the 10-row and 30-row means, from row 31 on."""
    df = _row(bars).withColumns({"_fast": sma("close", 10), "_slow": sma("close", 30)}).withColumns({"_fast1": lag("_fast"), "_slow1": lag("_slow")})
    f, s, f1, s1 = (F.col(c) for c in ("_fast", "_slow", "_fast1", "_slow1"))
    signal = F.when((f1 <= s1) & (f > s), "buy").when((f1 >= s1) & (f < s), "sell")
    return df.select("symbol", "date", "close", F.coalesce(F.when(F.col("_rn") > 30, signal), F.lit("hold")).alias("signal"))


STRATEGIES = {"buy_hold": buy_hold, "sma_cross": sma_cross, "rsi": rsi, "dual_ma": dual_ma}


def signals(bars: DataFrame, strategy: str) -> DataFrame:
    """Signals of a strategy by name; unknown names buy and hold."""
    return STRATEGIES.get(strategy, buy_hold)(bars)


def backtest(signals: DataFrame, capital: float = 100_000.0, commission: float = 0.001) -> DataFrame:
    """All-in, all-out on signals (symbol, date, close, signal): adds executed, entry, equity and, on sells, the trade's result.

    A buy while in and a sell while out are ignored, so what executes is what differs from the last signal that was not
    hold. Equity is the product of the trades' factors, marked at the close while in.
    """
    before = W.partitionBy("symbol").orderBy("date").rowsBetween(W.unboundedPreceding, -1)
    acted = F.when(F.col("signal") != "hold", F.col("signal"))
    df = signals.withColumn("_last", F.coalesce(F.last(acted, ignorenulls=True).over(before), F.lit("sell")))
    df = df.withColumn("executed", F.when((F.col("signal") == "buy") & (F.col("_last") != "buy"), "buy").when((F.col("signal") == "sell") & (F.col("_last") == "buy"), "sell"))
    entry = F.last(F.when(F.col("executed") == "buy", F.col("close")), ignorenulls=True).over(so_far())
    df = df.withColumns({"entry": entry, "_in": F.last("executed", ignorenulls=True).over(so_far()) == "buy"})
    cost = F.col("entry") * (1 + commission)
    df = df.withColumn("_log", F.when(F.col("executed") == "sell", F.ln(F.col("close") * (1 - commission) / cost)).otherwise(0.0))
    df = df.withColumn("_cash", capital * F.exp(F.sum("_log").over(so_far())))
    df = df.withColumn("equity", F.when(F.coalesce("_in", F.lit(False)), F.col("_cash") * F.col("close") / cost).otherwise(F.col("_cash")))
    sold = F.col("executed") == "sell"
    shares = F.when(sold, F.col("equity") / (F.col("close") * (1 - commission))).when(F.col("executed") == "buy", F.col("_cash") / cost)
    df = df.withColumn("shares", shares)
    return df.withColumns(
        {
            "pnl": F.when(sold, F.col("equity") - F.col("entry") * F.col("shares")),
            "pnl_net": F.when(sold, F.col("equity") - cost * F.col("shares")),
            "return_pct": F.when(sold, (F.col("close") / F.col("entry") - 1) * 100),
            "cost": F.col("shares") * F.col("close") * commission,
        }
    ).drop("_last", "_in", "_log", "_cash")


def trades(tested: DataFrame) -> DataFrame:
    return tested.where(F.col("executed").isNotNull()).select("symbol", "date", F.col("executed").alias("type"), F.col("close").alias("price"), "shares", "cost", "equity", "pnl", "pnl_net", "return_pct")


def metrics(tested: DataFrame, capital: float = 100_000.0) -> DataFrame:
    """Per symbol: returns, positive drawdown, Sharpe ratio by the population deviation, win rate, trades."""
    df = tested.withColumns({"_peak": F.max("equity").over(so_far()), "_r": F.col("equity") / lag("equity") - 1})
    total = F.max_by("equity", "date") / capital - 1
    sd = F.stddev_pop("_r")
    out = df.groupBy("symbol").agg(
        total.alias("total_return"), F.count("*").alias("n"), F.max((F.col("_peak") - F.col("equity")) / F.col("_peak")).alias("max_drawdown"), F.when(sd > 0, F.avg("_r") * 252 / (sd * F.sqrt(F.lit(252.0)))).otherwise(0.0).alias("sharpe_ratio"),
        F.count_if(F.col("executed") == "sell").alias("trade_count"), F.count_if(F.col("pnl") > 0).alias("_wins"), F.max_by("equity", "date").alias("final_equity"),
    )
    annual: Column = F.when((F.col("n") > 1) & (F.col("total_return") > -1), F.pow(1 + F.col("total_return"), 252 / F.col("n")) - 1).otherwise(F.col("total_return"))
    return out.select("symbol", "total_return", annual.alias("annualized_return"), "max_drawdown", "sharpe_ratio", F.when(F.col("trade_count") > 0, F.col("_wins") / F.col("trade_count")).otherwise(0.0).alias("win_rate"), "trade_count", "final_equity")
