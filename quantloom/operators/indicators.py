"""Technical indicators: bars (symbol, date, open, high, low, close, volume) with columns added.

Everything is native. Indicators over the last n rows share one window sort per symbol; exponential averages are a scan over blocks of a symbol's rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scores import clip
from ..functions.windows import change, full, guard, lag, sma, so_far

EWM = ("ema12", "ema26", "macd", "macd_signal", "macd_hist", "kdj_k", "kdj_d", "kdj_j")


#: Smoothing of the averages of MACD and of KDJ's %K and %D, and the rows of KDJ's range.
FAST, SLOW, SIGNAL, SMOOTH = 2 / 13, 2 / 27, 2 / 10, 1 / 3
RANGE = 9


def ewm(bars: DataFrame, block: Column | None = None) -> DataFrame:
    """EMA 12 and 26, MACD with its signal line and histogram, and KDJ, as a parallel scan over blocks.

    Each of them is a linear recurrence y -> (1 - s) * y + s * x, started at its first x. A symbol's rows are cut into blocks, by default of a calendar year (``block`` must
    not fall in order of date, and a block have fewer than 1,500 rows, for powers to stay within range). A block's part that comes from its own rows is a running sum, and what it makes of the values it starts from is a closed form
    of the number of rows; so a block is summed up in one row, the maps of a symbol's blocks are composed in order of
    time (a row a year), and each block is finished from the values that reach it. No task needs more of a symbol than a year.
    A row without a close keeps the averages, one without a full range of RANGE highs and lows those of KDJ; before the first value they are null.
    """
    keys = ["symbol", "_block"]
    rows = bars.withColumn("_block", (F.coalesce(F.year("date"), F.lit(-1)) if block is None else block).cast("int"))
    inside = W.partitionBy(*keys).orderBy("date")
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    before = RANGE - 1
    # The last highs and lows before a block: at most RANGE - 1 of them, from as many blocks.
    ends = rows.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list(F.struct("date", "low", "high")), asc=False), 1, before).alias("ends"))
    back = W.partitionBy("symbol").orderBy(F.desc("_block")).rowsBetween(1, before)
    ends = ends.select(*keys, F.slice(F.flatten(F.collect_list("ends").over(back)), 1, before).alias("_ends"))
    at = F.row_number().over(inside)
    last = inside.rowsBetween(-before, 0)
    rows = rows.join(ends, keys).withColumns({"_at": at, "_lows": F.count("low").over(last), "_highs": F.count("high").over(last), "_low": F.min("low").over(last), "_high": F.max("high").over(last)})
    more = F.when(F.col("_at") < RANGE, F.slice("_ends", 1, F.greatest(F.lit(0), F.lit(RANGE) - F.col("_at"))))

    def spread(name: str, least: Callable[..., Column], of: Callable[[Column], Column]) -> Column:
        old = F.filter(F.transform(more, lambda e: e[name]), lambda v: v.isNotNull())
        n = F.col(f"_{name}s") + F.coalesce(F.size(old), F.lit(0))
        return F.when(n == RANGE, F.coalesce(least(F.col(f"_{name}"), of(old)), F.col(f"_{name}")))

    low, high = spread("low", F.least, F.array_min), spread("high", F.greatest, F.array_max)
    rows = rows.withColumns({"_low": low, "_high": high})
    rows = rows.withColumn("_rsv", (F.col("close") - F.col("_low")) / guard(F.col("_high") - F.col("_low")) * 100).drop("_ends", "_lows", "_highs", "_low", "_high", "_at")
    rows = rows.withColumns({"_n": F.count("close").over(upto), "_m": F.count("_rsv").over(upto), "_f": F.first("close", ignorenulls=True).over(upto), "_g": F.first("_rsv", ignorenulls=True).over(upto)})
    # Running sums of s * x / keep ** place; times keep ** place they are the values of a recurrence that starts from 0. The x are taken
    # less the block's first one, which is added again in the end: a recurrence that starts there starts without any rounding.
    keep = {"ema12": 1 - FAST, "ema26": 1 - SLOW, "signal": 1 - SIGNAL, "k": 1 - SMOOTH}

    def power(name: str, n: str) -> Column:
        return F.pow(F.lit(keep[name]), F.col(n).cast("double"))

    def own(x: Column, name: str, n: str) -> Column:
        return F.coalesce(F.sum((1 - keep[name]) * x / power(name, n)).over(upto), F.lit(0.0)) * power(name, n)

    rows = rows.withColumns({"_ema12": own(F.col("close") - F.col("_f"), "ema12", "_n"), "_ema26": own(F.col("close") - F.col("_f"), "ema26", "_n"), "_k": own(F.col("_rsv") - F.col("_g"), "k", "_m")})
    rows = rows.withColumns({"_signal": own(F.when(F.col("close").isNotNull(), F.col("_ema12") - F.col("_ema26")), "signal", "_n"), "_d": own(F.when(F.col("_rsv").isNotNull(), F.col("_k")), "k", "_m")})
    parts = ("_n", "_m", "_f", "_g", "_ema12", "_ema26", "_signal", "_k", "_d")
    blocks = rows.groupBy(*keys).agg(F.max_by(F.struct(*parts), "date").alias("end")).select(*keys, "end.*")

    def reached(start: Column, own_part: Callable[[str], Column]) -> list[Column]:
        """Values after the rows of a block up to some row, from those at its start and the block's own parts."""
        n, m = own_part("_n").cast("double"), own_part("_m").cast("double")
        p = {c: F.pow(F.lit(v), m if c == "k" else n) for c, v in keep.items()}
        # What reaches the signal line from an average at the start: the sum of keep ** rows of both, a geometric series; %K and %D share theirs.
        series = {c: SIGNAL * keep[c] / (keep[c] - keep["signal"]) * (p[c] - p["signal"]) for c in ("ema12", "ema26")}
        f, g = F.coalesce(own_part("_f"), F.lit(0.0)), F.coalesce(own_part("_g"), F.lit(0.0))
        fast, slow, k, d = start["ema12"] - f, start["ema26"] - f, start["k"] - g, start["d"] - g
        return [
            (f + (p["ema12"] * fast + own_part("_ema12"))).alias("ema12"),
            (f + (p["ema26"] * slow + own_part("_ema26"))).alias("ema26"),
            (p["signal"] * start["signal"] + own_part("_signal") + (series["ema12"] * fast - series["ema26"] * slow)).alias("signal"),
            (g + (p["k"] * k + own_part("_k"))).alias("k"),
            (g + (p["k"] * (d + SMOOTH * m * k) + own_part("_d"))).alias("d"),
        ]

    none = F.lit(None).cast("double")
    state = "struct<ema12:double,ema26:double,signal:double,k:double,d:double>"
    start = F.struct(*[none.alias(c) for c in ("ema12", "ema26", "signal", "k", "d")]).cast(state)

    def entered(now: Column, block: Column) -> Column:
        """The values at a block's start: a recurrence that has none yet starts from the block's first value, as its average of one."""
        price, rsv = block["_f"], block["_g"]
        return F.struct(F.coalesce(now["ema12"], price).alias("ema12"), F.coalesce(now["ema26"], price).alias("ema26"), F.coalesce(now["signal"], price * 0).alias("signal"), F.coalesce(now["k"], rsv).alias("k"), F.coalesce(now["d"], rsv).alias("d"))

    def step(acc: Column, block: Column) -> Column:
        begin = entered(acc["now"], block)
        after = F.struct(*[F.coalesce(v, acc["now"][c]).alias(c) for v, c in zip(reached(begin, lambda c: block[c]), ("ema12", "ema26", "signal", "k", "d"), strict=True)])
        out = F.struct(block["_block"].alias("_block"), begin.cast(state).alias("_start"), acc["now"]["ema12"].isNotNull().alias("_priced"), acc["now"]["k"].isNotNull().alias("_ranged"))
        return F.struct(after.cast(state).alias("now"), F.array_append(acc["out"], out).alias("out"))

    empty = F.array().cast(f"array<struct<_block:int,_start:{state},_priced:boolean,_ranged:boolean>>")
    of_symbol = blocks.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("_block", *parts))).alias("blocks"))
    starts = of_symbol.select("symbol", F.inline(F.aggregate("blocks", F.struct(start.alias("now"), empty.alias("out")), step, lambda acc: acc["out"])))
    values = dict(zip(("ema12", "ema26", "macd_signal", "kdj_k", "kdj_d"), reached(F.col("_start"), F.col), strict=True))
    # A block's start has the first value already for rows before it, which have none of their own.
    seen = {c: F.when((F.col("_m") > 0) | F.col("_ranged") if c.startswith("kdj") else (F.col("_n") > 0) | F.col("_priced"), v) for c, v in values.items()}
    done = rows.join(starts, keys).withColumns(seen)
    done = done.withColumns({"macd": F.col("ema12") - F.col("ema26"), "macd_hist": F.col("ema12") - F.col("ema26") - F.col("macd_signal"), "kdj_j": 3 * F.col("kdj_k") - 2 * F.col("kdj_d")})
    return done.select(*bars.columns, *EWM)


#: Columns of an indicator by layer: those of one layer use the layers before it. Names that start with "_" do not stay.
Layers = tuple[dict[str, Column], ...]


def layered(bars: DataFrame, *indicators: Layers) -> DataFrame:
    """bars with the indicators' columns. Layers of the same depth are added together, so that all indicators pass the rows through as many
    window steps as the deepest one has layers."""
    rows, made = bars, []
    for depth in range(max(map(len, indicators))):
        columns = {name: column for layers in indicators if depth < len(layers) for name, column in layers[depth].items()}
        made += columns
        rows = rows.withColumns(columns)
    return rows.drop(*[name for name in made if name.startswith("_")])


def ma_layers(spans: tuple[int, ...] = (5, 10, 20, 60)) -> Layers:
    return ({f"ma{n}": sma("close", n) for n in spans},)


def simple_rsi(close: str = "close", n: int = 14) -> tuple[Column, Column]:
    """Gain and loss of each step; the first counts as none, so that a simple-mean RSI starts on row n."""
    step = F.col(close) - lag(close)
    gain = F.coalesce(F.greatest(step, F.lit(0.0)), F.lit(0.0))
    loss = F.coalesce(F.greatest(-step, F.lit(0.0)), F.lit(0.0))
    return gain, loss


def rsi_layers(n: int = 14) -> Layers:
    gain, loss = simple_rsi(n=n)
    return {"_gain": gain, "_loss": loss}, {f"rsi{n}": 100 - 100 / (1 + sma("_gain", n) / guard(sma("_loss", n)))}


def boll_layers(n: int = 20) -> Layers:
    width = F.col("boll_upper") - F.col("boll_lower")
    return (
        {"boll_mid": sma("close", n), "_sd": full(F.stddev_samp, "close", n)},
        {"boll_upper": F.col("boll_mid") + 2 * F.col("_sd"), "boll_lower": F.col("boll_mid") - 2 * F.col("_sd")},
        {"boll_width": width / F.col("boll_mid"), "boll_pos": F.when(width != 0, (F.col("close") - F.col("boll_lower")) / width)},
    )


def volume_layers() -> Layers:
    return {"volume_ma5": sma("volume", 5), "volume_ma20": sma("volume", 20)}, {"volume_ratio": F.col("volume") / F.when(F.col("volume_ma20") != 0, F.col("volume_ma20"))}


def obv_layers() -> Layers:
    step = F.col("close") - lag("close")
    signed = F.when(step.isNull(), F.col("volume")).when(step > 0, F.col("volume")).when(step < 0, -F.col("volume")).otherwise(0.0)
    return {"_signed": signed}, {"obv": F.sum("_signed").over(so_far())}


def true_range() -> Column:
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - lag("close")), F.abs(F.col("low") - lag("close")))


def atr_layers(n: int = 14) -> Layers:
    return {"tr": true_range()}, {"atr14": sma("tr", n)}


def dmi_layers(n: int = 14) -> Layers:
    """+DI, -DI and ADX; the first row has no direction, so they start a row after the ATR."""
    up, down = F.col("high") - lag("high"), lag("low") - F.col("low")
    total = guard(F.col("plus_di") + F.col("minus_di"))
    return (
        {"_range": true_range(), "_up": F.when(up.isNotNull(), F.when((up > down) & (up > 0), up).otherwise(0.0)), "_down": F.when(down.isNotNull(), F.when((down > up) & (down > 0), down).otherwise(0.0))},
        {f"{side}_di": 100 * sma(way, n) / guard(sma("_range", n)) for side, way in (("plus", "_up"), ("minus", "_down"))},
        {"_dx": 100 * F.abs(F.col("plus_di") - F.col("minus_di")) / total},
        {"adx": sma("_dx", n)},
    )


def cci_layers(n: int = 20) -> Layers:
    spread = sum((F.abs(lag("_tp", k) - F.col("_mean")) for k in range(n)), F.lit(0.0)) / n
    return (
        {"_tp": (F.col("high") + F.col("low") + F.col("close")) / 3},
        {"_mean": sma("_tp", n)},
        {"_md": spread},
        {"cci": F.when(F.col("_mean").isNotNull(), (F.col("_tp") - F.col("_mean")) / (0.015 * guard(F.col("_md"))))},
    )


def wr_layers(n: int = 14) -> Layers:
    return {"_top": full(F.max, "high", n), "_floor": full(F.min, "low", n)}, {"wr14": -100 * (F.col("_top") - F.col("close")) / guard(F.col("_top") - F.col("_floor"))}


def psy_layers(n: int = 12) -> Layers:
    return {"_rose": F.coalesce((F.col("close") > lag("close")).cast("double"), F.lit(0.0))}, {"psy12": full(F.sum, "_rose", n) / n * 100}


def ma(bars: DataFrame, spans: tuple[int, ...] = (5, 10, 20, 60)) -> DataFrame:
    return layered(bars, ma_layers(spans))


def rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    return layered(bars, rsi_layers(n))


def boll(bars: DataFrame, n: int = 20) -> DataFrame:
    return layered(bars, boll_layers(n))


def volume(bars: DataFrame) -> DataFrame:
    return layered(bars, volume_layers())


def obv(bars: DataFrame) -> DataFrame:
    return layered(bars, obv_layers())


def atr(bars: DataFrame, n: int = 14) -> DataFrame:
    return layered(bars, atr_layers(n))


def dmi(bars: DataFrame, n: int = 14) -> DataFrame:
    return layered(bars, dmi_layers(n))


def cci(bars: DataFrame, n: int = 20) -> DataFrame:
    return layered(bars, cci_layers(n))


def wr(bars: DataFrame, n: int = 14) -> DataFrame:
    return layered(bars, wr_layers(n))


def psy(bars: DataFrame, n: int = 12) -> DataFrame:
    return layered(bars, psy_layers(n))


def everything(bars: DataFrame) -> DataFrame:
    """All indicators; the recursion comes first and keeps the partitioning by symbol that the windows need, the others share their window steps."""
    return layered(ewm(bars), ma_layers(), rsi_layers(), boll_layers(), volume_layers(), obv_layers(), atr_layers(), dmi_layers(), cci_layers(), wr_layers(), psy_layers())


def valuation_scores(df: DataFrame) -> DataFrame:
    """pe, pb and dividend scores (50 where pe or pb is not positive) and their mean."""
    pe = F.when(F.col("pe") > 0, clip(100 - 2 * F.col("pe"))).otherwise(50.0)
    pb = F.when(F.col("pb") > 0, clip(100 - 15 * F.col("pb"))).otherwise(50.0)
    dy = F.least(F.lit(100.0), F.coalesce(F.col("dividend_yield"), F.lit(0.0)) * 1000)
    return df.withColumns({"pe_score": pe, "pb_score": pb, "dividend_score": dy}).withColumn("valuation_score", (F.col("pe_score") + F.col("pb_score") + F.col("dividend_score")) / 3)


def growth(bars: DataFrame) -> DataFrame:
    """Returns against the 20th and 60th last close, a trend label and a score, on each symbol's last row."""
    rows = bars.withColumns({"_n": F.count("*").over(so_far()), "_last": F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("date"))), "return_1m": F.col("close") / lag("close", 19) - 1, "return_3m": F.col("close") / lag("close", 59) - 1})
    rows = rows.where((F.col("_last") == 1) & (F.col("_n") >= 60))
    m, q = F.col("return_1m") * 100, F.col("return_3m") * 100
    trend = F.when((m > 5) & (q > 10), "strong_uptrend").when(m > 0, "uptrend").when((m < -5) & (q < -10), "strong_downtrend").when(m < 0, "downtrend").otherwise("sideways")
    return rows.select("symbol", "date", "close", m.alias("return_1m"), q.alias("return_3m"), trend.alias("trend"), clip(50 + 2 * q).alias("growth_score"))


def ml_features(bars: DataFrame) -> DataFrame:
    """18 price features."""
    out = ewm(bars).transform(ma).transform(rsi)
    sd = full(F.stddev_samp, "close", 20)
    out = out.withColumns({"_sd": sd, "return_1": change("close"), "volume_change": F.col("volume") / F.when(lag("volume") != 0, lag("volume")) - 1, "volume_ma5": sma("volume", 5)})
    low, high = full(F.min, "low", 20), full(F.max, "high", 20)
    out = out.withColumns({"volatility_20": full(F.stddev_samp, "return_1", 20), "_low": low, "_high": high})
    lower = F.col("ma20") - 2 * F.col("_sd")
    return out.withColumns(
        {
            "bb_position": (F.col("close") - lower) / guard(4 * F.col("_sd")),
            "volume_ratio": F.col("volume") / guard(F.col("volume_ma5")),
            "momentum_5": change("close", 5),
            "momentum_10": change("close", 10),
            "momentum_20": change("close", 20),
            "price_position": (F.col("close") - F.col("_low")) / guard(F.col("_high") - F.col("_low")),
        }
    ).drop("_sd", "_low", "_high")


ML_FEATURES = ("ma5", "ma10", "ma20", "ma60", "rsi14", "macd", "macd_signal", "macd_hist", "bb_position", "volatility_20", "volume_change", "volume_ma5", "volume_ratio", "momentum_5", "momentum_10", "momentum_20", "return_1", "price_position")
