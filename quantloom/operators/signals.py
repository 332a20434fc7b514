"""Rule signals on indicator rows, agents' signals, and the weighted vote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scores import clip
from ..functions.windows import lag, last_rows, so_far

AGENT_WEIGHTS = {"technical": 0.35, "fundamental": 0.35, "sentiment": 0.30}
OTHER_WEIGHT = 0.33


def _rule(df: DataFrame, name: str, *cases: tuple[Column, str, int]) -> DataFrame:
    """Columns <name>_signal and <name>_confidence: the first case that holds, else hold 50."""
    signal, confidence = F.lit("hold"), F.lit(50)
    for condition, s, c in reversed(cases):
        hit = F.coalesce(condition, F.lit(False))
        signal, confidence = F.when(hit, s).otherwise(signal), F.when(hit, c).otherwise(confidence)
    return df.withColumns({f"{name}_signal": signal, f"{name}_confidence": confidence})


def macd(df: DataFrame) -> DataFrame:
    m, s, h = (F.col(c) for c in ("macd", "macd_signal", "macd_hist"))
    return _rule(df, "sig_macd", ((m > s) & (h > 0) & (h > lag("macd_hist")), "buy", 75), ((m < s) & (h < 0) & (h < lag("macd_hist")), "sell", 75))


def rsi(df: DataFrame) -> DataFrame:
    r = F.col("rsi14")
    return _rule(df, "sig_rsi", (r < 30, "buy", 70), (r > 70, "sell", 70), (r.between(40, 60), "hold", 60))


def boll(df: DataFrame) -> DataFrame:
    p = F.col("boll_pos")
    return _rule(df, "sig_boll", ((p < 0.1) & (lag("boll_pos") < p), "buy", 65), ((p > 0.9) & (lag("boll_pos") > p), "sell", 65), ((F.col("boll_width") > 0) & (p > 0.5), "hold", 55))


def kdj(df: DataFrame) -> DataFrame:
    k, d, j = (F.col(f"kdj_{c}") for c in "kdj")
    k0, d0 = lag("kdj_k"), lag("kdj_d")
    return _rule(df, "sig_kdj", ((k > d) & (k0 <= d0) & (k < 80), "buy", 70), ((k < d) & (k0 >= d0) & (k > 20), "sell", 70), (j > 100, "sell", 60), (j < 0, "buy", 60))


def moving_averages(df: DataFrame) -> DataFrame:
    c, a, b, e = (F.col(x) for x in ("close", "ma5", "ma20", "ma60"))
    return _rule(df, "sig_ma", ((c > a) & (a > b) & (b > e), "buy", 80), ((c < a) & (a < b) & (b < e), "sell", 80), ((c > b) & (a > b), "buy", 60), ((c < b) & (a < b), "sell", 60))


RULES = ("sig_macd", "sig_rsi", "sig_boll", "sig_kdj", "sig_ma")


def technical(df: DataFrame) -> DataFrame:
    """The five rules' majority, on indicator rows; before 60 rows hold 30."""
    for rule in (macd, rsi, boll, kdj, moving_averages):
        df = df.transform(rule)
    votes = lambda s: sum((F.when(F.col(f"{r}_signal") == s, 1).otherwise(0) for r in RULES), F.lit(0))
    df = df.withColumns({"_n": F.count("*").over(so_far()), "buys": votes("buy"), "sells": votes("sell")})
    mean = sum((F.col(f"{r}_confidence") for r in RULES), F.lit(0)) / 5
    short = F.col("_n") < 60
    signal = F.when(short, "hold").when((F.col("buys") > F.col("sells")) & (F.col("buys") >= 3), "buy").when((F.col("sells") > F.col("buys")) & (F.col("sells") >= 3), "sell").otherwise("hold")
    agree = F.greatest("buys", "sells") >= 4
    confidence = F.when(short, 30.0).when(agree, F.least(F.lit(95.0), mean + 10)).otherwise(mean)
    df = df.withColumns({"signal": signal, "confidence": confidence})
    return _targets(df, "technical", F.col("close") * 1.08, F.col("close") * 0.95, F.col("close") * 0.92, F.col("close") * 1.05)


def _targets(df: DataFrame, agent: str, buy: Column, buy_stop: Column, sell: Column, sell_stop: Column) -> DataFrame:
    s = F.col("signal")
    return df.select("symbol", "date", F.lit(agent).alias("agent"), "signal", "confidence", F.when(s == "buy", buy).when(s == "sell", sell).alias("target_price"), F.when(s == "buy", buy_stop).when(s == "sell", sell_stop).alias("stop_loss"))


def fundamental(scored: DataFrame) -> DataFrame:
    """Signal of rows with close, pe and overall_score."""
    o, c, pe = F.col("overall_score"), F.col("close"), F.col("pe")
    df = scored.withColumns({"signal": F.when(o >= 70, "buy").when(o <= 30, "sell").otherwise("hold"), "confidence": F.when(o >= 70, F.least(F.lit(95.0), o)).when(o <= 30, F.least(F.lit(95.0), 100 - o)).otherwise(50.0)})
    return _targets(df, "fundamental", F.when((pe > 0) & (pe < 50), c * 25 / pe).otherwise(c * 1.15), c * 0.90, c * 0.85, c * 1.10)


def sentiment_indicators(bars: DataFrame) -> DataFrame:
    """Price momentum, volume trend and volatility state blended into overall_sentiment, per row."""
    df = bars.withColumns({"_n": F.count("*").over(so_far()), "_r": F.col("close") / lag("close") - 1, "returns_5d": (F.col("close") / lag("close", 4) - 1) * 100, "returns_10d": (F.col("close") / lag("close", 9) - 1) * 100})
    df = df.withColumn("momentum", (F.col("returns_5d") + F.col("returns_10d")) / 2)
    slow = F.avg("volume").over(last_rows(20))
    df = df.withColumns({"volume_ratio": F.when(slow > 0, F.avg("volume").over(last_rows(5)) / slow).otherwise(1.0), "volatility": F.stddev_samp("_r").over(so_far()) * 100})
    ratio, vol, m = F.col("volume_ratio"), F.col("volatility"), F.col("momentum")
    df = df.withColumns({"volume_trend": F.when(ratio > 1.3, "high").when(ratio < 0.7, "low").otherwise("normal"), "volatility_state": F.when(vol > 3, "high").when(vol < 1, "low").otherwise("normal")})
    volume_score = F.when(F.col("volume_trend") == "high", F.when(m > 0, 70).otherwise(30)).when(F.col("volume_trend") == "low", 40).otherwise(50)
    state_score = F.when(F.col("volatility_state") == "high", 40).when(F.col("volatility_state") == "low", 60).otherwise(50)
    return df.withColumn("overall_sentiment", clip(50 + 2 * m) * 0.4 + volume_score * 0.3 + state_score * 0.3)


def sentiment(df: DataFrame) -> DataFrame:
    s, m, c = F.col("overall_sentiment"), F.col("momentum"), F.col("close")
    short = F.col("_n") < 20
    buy, sell = (s > 70) & (m > 0), (s < 30) & (m < 0)
    df = df.withColumns({"signal": F.when(short, "hold").when(buy, "buy").when(sell, "sell").otherwise("hold"), "confidence": F.when(short, 30.0).when(buy, s).when(sell, 100 - s).otherwise(50.0)})
    return _targets(df, "sentiment", c * (1 + F.abs(m) / 100), c * 0.93, c * (1 - F.abs(m) / 100), c * 1.07)


def vote(signals: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted vote per (symbol, date): scores of buy, sell and hold, the winner (ties in that order), mean targets."""
    weights = AGENT_WEIGHTS if weights is None else weights
    weight = F.lit(OTHER_WEIGHT)
    for agent, w in weights.items():
        weight = F.when(F.col("agent") == agent, w).otherwise(weight)
    df = signals.withColumn("_w", weight)
    score = lambda s: F.sum(F.when(F.col("signal") == s, F.col("_w") * F.col("confidence") / 100).otherwise(0.0)) / F.sum("_w")
    mean = lambda c, s: F.avg(F.when((F.col("signal") == s) & (F.col(c) != 0), F.col(c)))
    out = df.groupBy("symbol", "date").agg(*[score(s).alias(f"{s}_score") for s in ("buy", "sell", "hold")], *[mean(c, s).alias(f"_{c}_{s}") for c in ("target_price", "stop_loss") for s in ("buy", "sell", "hold")])
    b, s, h = (F.col(f"{x}_score") for x in ("buy", "sell", "hold"))
    out = out.withColumn("decision", F.when((b >= s) & (b >= h), "buy").when(s >= h, "sell").otherwise("hold"))
    pick = lambda c: F.when(F.col("decision") == "buy", F.col(f"_{c}_buy")).when(F.col("decision") == "sell", F.col(f"_{c}_sell")).otherwise(F.col(f"_{c}_hold"))
    return out.select("symbol", "date", "decision", (F.greatest("buy_score", "sell_score", "hold_score") * 100).alias("confidence"), "buy_score", "sell_score", "hold_score", pick("target_price").alias("target_price"), pick("stop_loss").alias("stop_loss"))


def confidence_weighted(df: DataFrame, by: str, value: str, weight: str) -> DataFrame:
    """Weighted mean clipped to 0-100 per group, 50 where the weights sum to nothing."""
    total = F.sum(F.when(F.col(value).isNotNull(), F.col(weight)))
    return df.groupBy(by).agg(F.coalesce(clip(F.when(total != 0, F.sum(F.col(value) * F.col(weight)) / total)), F.lit(50.0)).alias("weighted_confidence"))


Agent = Callable[[DataFrame], DataFrame]


def with_plugins(bars: DataFrame, agents: dict[str, tuple[Agent, float]], base: DataFrame | None = None) -> tuple[DataFrame, dict[str, float]]:
    """Signals of own agents (functions from bars to signal rows) beside others, and the weights for the vote."""
    out, weights = base, dict(AGENT_WEIGHTS)
    for name, (agent, weight) in agents.items():
        rows = agent(bars).select("symbol", "date", F.lit(name).alias("agent"), "signal", F.col("confidence").cast("double").alias("confidence"), F.col("target_price").cast("double").alias("target_price"), F.col("stop_loss").cast("double").alias("stop_loss"))
        out = rows if out is None else out.unionByName(rows)
        weights[name] = weight
    return out, weights


def recommendations(decisions: DataFrame) -> DataFrame:
    """Rank of each decision within its class by confidence, with the size of the class."""
    w = W.partitionBy("date", "decision")
    return decisions.select("date", "decision", F.row_number().over(w.orderBy(F.desc("confidence"), "symbol")).alias("rank"), "symbol", "confidence", F.count("*").over(w).alias("class_size"))


def market_overview(bars: DataFrame) -> DataFrame:
    """Last close of each index, its change on the row before in percent, volume."""
    df = bars.withColumns({"_last": F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("date"))), "change_pct": (F.col("close") / lag("close") - 1) * 100})
    return df.where("_last = 1").select("symbol", "date", "close", "change_pct", "volume")


def holdings_valuation(holdings: DataFrame, prices: DataFrame) -> DataFrame:
    """Value, cost, gain and return of holdings (account, symbol, quantity, cost_basis) at given prices, with totals per account."""
    df = holdings.join(prices, "symbol").withColumns({"value": F.col("quantity") * F.col("close"), "cost": F.col("quantity") * F.col("cost_basis")})
    df = df.withColumns({"gain": F.when(F.col("cost") > 0, F.col("value") - F.col("cost")).otherwise(0.0), "return_pct": F.when(F.col("cost") > 0, (F.col("value") / F.col("cost") - 1) * 100).otherwise(0.0)})
    w = W.partitionBy("account")
    total_cost = F.sum("cost").over(w)
    return df.withColumns({"account_value": F.sum("value").over(w), "account_return_pct": F.when(total_cost > 0, (F.sum("value").over(w) / total_cost - 1) * 100).otherwise(0.0)})
