"""Queries on indicators, signals and the vote."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import indicators as ind
from ..operators import signals as sig
from .adapters import BARS, RAW_FUNDAMENTALS, bars, brand_number, raw_fundamentals
from .registry import query, select


def win(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


ALL = "(PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def full(agg: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {win(n)} = {n} THEN {agg}({x}) OVER {win(n)} END"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER (PARTITION BY symbol ORDER BY date)"


def guard(x: str) -> str:
    return f"(CASE WHEN {x} = 0 THEN 1e-10 ELSE {x} END)"


# One table with everything native, one with the recursions; the queries pick from them.
STEP = f"""step AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn, {lag('close')} AS c1, (high + low + close) / 3 AS tp,
 high - {lag('high')} AS up0, {lag('low')} - low AS down0 FROM bars)"""
STEP2 = """step2 AS MATERIALIZED (SELECT *, coalesce(greatest(close - c1, 0), 0) AS gain, coalesce(greatest(c1 - close, 0), 0) AS loss,
 greatest(high - low, coalesce(abs(high - c1), high - low), coalesce(abs(low - c1), high - low)) AS tr,
 CASE WHEN up0 IS NULL THEN NULL WHEN up0 > down0 AND up0 > 0 THEN up0 ELSE 0 END AS up, CASE WHEN up0 IS NULL THEN NULL WHEN down0 > up0 AND down0 > 0 THEN down0 ELSE 0 END AS down,
 CASE WHEN close > c1 THEN 1.0::DOUBLE ELSE 0 END AS rose, CASE WHEN c1 IS NULL OR close > c1 THEN volume WHEN close < c1 THEN -volume ELSE 0 END AS signed FROM step)"""
NATIVE = f"""native AS MATERIALIZED (SELECT *, {', '.join(f"{full('avg', 'close', n)} AS ma{n}" for n in (5, 10, 20, 60))},
 {full('avg', 'gain', 14)} AS g14, {full('avg', 'loss', 14)} AS l14, {full('stddev_samp', 'close', 20)} AS sd20, {full('avg', 'volume', 5)} AS volume_ma5, {full('avg', 'volume', 20)} AS volume_ma20,
 sum(signed) OVER {ALL} AS obv, {full('avg', 'tr', 14)} AS atr14, {full('avg', 'up', 14)} AS up14, {full('avg', 'down', 14)} AS down14, {full('avg', 'tp', 20)} AS tp20,
 list(tp) OVER {win(20)} AS tps, {full('max', 'high', 14)} AS h14, {full('min', 'low', 14)} AS lo14, {full('sum', 'rose', 12)} AS rose12, {full('min', 'low', 9)} AS lo9, {full('max', 'high', 9)} AS h9,
 {full('min', 'low', 20)} AS lo20, {full('max', 'high', 20)} AS h20, close / c1 - 1 AS return_1 FROM step2)"""
DERIVED = f"""derived AS MATERIALIZED (SELECT *, 100 - 100 / (1 + g14 / {guard('l14')}) AS rsi14, ma20 AS boll_mid, ma20 + 2 * sd20 AS boll_upper, ma20 - 2 * sd20 AS boll_lower,
 4 * sd20 / ma20 AS boll_width, CASE WHEN sd20 <> 0 THEN (close - (ma20 - 2 * sd20)) / ((ma20 + 2 * sd20) - (ma20 - 2 * sd20)) END AS boll_pos, volume / nullif(volume_ma20, 0) AS volume_ratio,
 100 * up14 / {guard('atr14')} AS plus_di, 100 * down14 / {guard('atr14')} AS minus_di,
 CASE WHEN tp20 IS NOT NULL THEN (tp - tp20) / (0.015 * {guard('(list_sum(list_transform(tps, lambda x: abs(x - tp20))) / 20)')}) END AS cci,
 -100 * (h14 - close) / {guard('(h14 - lo14)')} AS wr14, rose12 / 12 * 100 AS psy12, (close - lo9) / {guard('(h9 - lo9)')} * 100 AS rsv FROM native)"""
DX = f"dx AS MATERIALIZED (SELECT *, 100 * abs(plus_di - minus_di) / {guard('(plus_di + minus_di)')} AS dx0 FROM derived)"
ADX = f"wide AS MATERIALIZED (SELECT *, {full('avg', 'dx0', 14)} AS adx FROM dx)"
WIDE = f"{BARS}, {STEP}, {STEP2}, {NATIVE}, {DERIVED}, {DX}, {ADX}"
EWM = """rec AS (SELECT symbol, rn, close AS ema12, close AS ema26, 0.0::DOUBLE AS sg, NULL::DOUBLE AS k, NULL::DOUBLE AS d FROM wide WHERE rn = 1
 UNION ALL SELECT w.symbol, w.rn, 2.0::DOUBLE / 13 * w.close + 11.0::DOUBLE / 13 * r.ema12, 2.0::DOUBLE / 27 * w.close + 25.0::DOUBLE / 27 * r.ema26,
 0.2::DOUBLE * ((2.0::DOUBLE / 13 * w.close + 11.0::DOUBLE / 13 * r.ema12) - (2.0::DOUBLE / 27 * w.close + 25.0::DOUBLE / 27 * r.ema26)) + 0.8::DOUBLE * r.sg,
 CASE WHEN r.k IS NULL THEN w.rsv ELSE w.rsv / 3 + r.k * 2 / 3 END,
 CASE WHEN r.d IS NULL THEN w.rsv ELSE (w.rsv / 3 + r.k * 2 / 3) / 3 + r.d * 2 / 3 END
 FROM rec r JOIN wide w ON w.symbol = r.symbol AND w.rn = r.rn + 1),
 ind AS MATERIALIZED (SELECT w.*, ema12, ema26, ema12 - ema26 AS macd, sg AS macd_signal, ema12 - ema26 - sg AS macd_hist, k AS kdj_k, d AS kdj_d, 3 * k - 2 * d AS kdj_j FROM wide w JOIN rec USING (symbol, rn))"""
IND = f"WITH RECURSIVE {WIDE}, {EWM}"
KEYS = "symbol, date"


def simple(name: str, columns: str, step, base: str = "native") -> None:
    """A query of one indicator step: keys and its columns."""
    names = columns.split("; ")
    sql = (IND if base == "ind" else f"WITH {WIDE}") + " " + select(KEYS, columns, f"FROM {'ind' if base == 'ind' else 'wide'}")
    query(name, sql)(lambda spark, d: bars(spark, d).transform(step).select("symbol", "date", *names))


simple("ind_ma", "ma5; ma10; ma20; ma60", ind.ma)
simple("ind_ema", "ema12; ema26", ind.ewm, "ind")
simple("ind_macd", "macd; macd_signal; macd_hist", ind.ewm, "ind")
simple("ind_rsi", "rsi14", ind.rsi)
simple("ind_boll", "boll_mid; boll_upper; boll_lower; boll_width; boll_pos", ind.boll)
simple("ind_kdj", "kdj_k; kdj_d; kdj_j", ind.ewm, "ind")
simple("ind_volume", "volume_ma5; volume_ma20; volume_ratio", ind.volume)
simple("ind_obv", "obv", ind.obv)
simple("ind_atr", "tr; atr14", ind.atr)
simple("ind_dmi", "plus_di; minus_di; adx", ind.dmi)
simple("ind_cci", "cci", ind.cci)
simple("ind_wr", "wr14", ind.wr)
simple("ind_psy", "psy12", ind.psy)
simple("ind_full", "ma5; ma10; ma20; ma60; ema12; ema26; macd; macd_signal; macd_hist; rsi14; boll_mid; boll_upper; boll_lower; boll_width; boll_pos; kdj_k; kdj_d; kdj_j; volume_ma5; volume_ma20; volume_ratio; obv; tr; atr14; plus_di; minus_di; adx; cci; wr14; psy12", ind.everything, "ind")

query("ind_ma_app", f"WITH {BARS} " + select(KEYS, f"{full('avg', 'close', 20)} AS ma20; {full('avg', 'close', 50)} AS ma50", "FROM bars"))(lambda s, d: ind.ma(bars(s, d), (20, 50)).select("symbol", "date", "ma20", "ma50"))

VALUATION = """valuation AS (SELECT symbol, report_date, pe, pb, dividend_yield, CASE WHEN pe > 0 THEN greatest(0, least(100, 100 - 2 * pe)) ELSE 50 END AS pe_score,
 CASE WHEN pb > 0 THEN greatest(0, least(100, 100 - 15 * pb)) ELSE 50 END AS pb_score, least(100, coalesce(dividend_yield, 0) * 1000) AS dividend_score FROM raw_fundamentals)"""
query("val_scores", f"WITH {RAW_FUNDAMENTALS}, {VALUATION} " + select("symbol, report_date", "pe_score; pb_score; dividend_score; (pe_score + pb_score + dividend_score) / 3 AS valuation_score", "FROM valuation"))(
    lambda s, d: ind.valuation_scores(raw_fundamentals(s, d)).select("symbol", "report_date", "pe_score", "pb_score", "dividend_score", "valuation_score")
)
GROWTH = f"""ago AS (SELECT symbol, date, close, count(*) OVER (PARTITION BY symbol) AS n, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS last,
 (close / {lag('close', 19)} - 1) * 100 AS m, (close / {lag('close', 59)} - 1) * 100 AS q FROM bars),
 growth AS (SELECT symbol, date, close, m AS return_1m, q AS return_3m, CASE WHEN m > 5 AND q > 10 THEN 'strong_uptrend' WHEN m > 0 THEN 'uptrend' WHEN m < -5 AND q < -10 THEN 'strong_downtrend'
 WHEN m < 0 THEN 'downtrend' ELSE 'sideways' END AS trend, greatest(0, least(100, 50 + 2 * q)) AS growth_score FROM ago WHERE last = 1 AND n >= 60)"""
query("growth_score", f"WITH {BARS}, {GROWTH} " + select("symbol, date, trend", "close; return_1m; return_3m; growth_score", "FROM growth"))(lambda s, d: ind.growth(bars(s, d)))


def overall(spark, sf_dir):
    """Growth of each symbol with the valuation of its latest report."""
    scored = ind.valuation_scores(raw_fundamentals(spark, sf_dir))
    last = scored.groupBy("symbol").agg(F.max_by(F.struct("pe", "valuation_score"), "report_date").alias("v")).select("symbol", "v.*")
    return ind.growth(bars(spark, sf_dir)).join(last, "symbol").withColumn("overall_score", (F.col("valuation_score") + F.col("growth_score")) / 2)


OVERALL = """overall AS (SELECT g.*, v.pe, v.score AS valuation_score, (v.score + growth_score) / 2 AS overall_score FROM growth g
 JOIN (SELECT symbol, arg_max(pe, report_date) AS pe, arg_max((pe_score + pb_score + dividend_score) / 3, report_date) AS score FROM valuation GROUP BY 1) v USING (symbol))"""
query("fundamental_overall", f"WITH {BARS}, {RAW_FUNDAMENTALS}, {VALUATION}, {GROWTH}, {OVERALL} " + select("symbol", "valuation_score; growth_score; overall_score", "FROM overall"))(
    lambda s, d: overall(s, d).select("symbol", "valuation_score", "growth_score", "overall_score")
)
_ML = f"""ml AS (SELECT *, {full('stddev_samp', 'return_1', 20)} AS volatility_20, volume / nullif({lag('volume')}, 0) - 1 AS volume_change, close / {lag('close', 5)} - 1 AS momentum_5,
 close / {lag('close', 10)} - 1 AS momentum_10, close / {lag('close', 20)} - 1 AS momentum_20, (close - (ma20 - 2 * sd20)) / {guard('(4 * sd20)')} AS bb_position,
 volume / {guard('volume_ma5')} AS vratio, (close - lo20) / {guard('(h20 - lo20)')} AS price_position FROM ind)"""
query("ml_features", f"{IND}, {_ML} " + select(KEYS, "; ".join("vratio AS volume_ratio" if c == "volume_ratio" else c for c in ind.ML_FEATURES), "FROM ml"))(lambda s, d: ind.ml_features(bars(s, d)).select("symbol", "date", *ind.ML_FEATURES))

# Rule signals

CASES = {
    "macd": "WHEN macd > macd_signal AND macd_hist > 0 AND macd_hist > {h} THEN ('buy', 75) WHEN macd < macd_signal AND macd_hist < 0 AND macd_hist < {h} THEN ('sell', 75)".format(h="h1"),
    "rsi": "WHEN rsi14 < 30 THEN ('buy', 70) WHEN rsi14 > 70 THEN ('sell', 70) WHEN rsi14 BETWEEN 40 AND 60 THEN ('hold', 60)",
    "boll": "WHEN boll_pos < 0.1 AND p1 < boll_pos THEN ('buy', 65) WHEN boll_pos > 0.9 AND p1 > boll_pos THEN ('sell', 65) WHEN boll_width > 0 AND boll_pos > 0.5 THEN ('hold', 55)",
    "kdj": "WHEN kdj_k > kdj_d AND k1 <= d1 AND kdj_k < 80 THEN ('buy', 70) WHEN kdj_k < kdj_d AND k1 >= d1 AND kdj_k > 20 THEN ('sell', 70) WHEN kdj_j > 100 THEN ('sell', 60) WHEN kdj_j < 0 THEN ('buy', 60)",
    "ma": "WHEN close > ma5 AND ma5 > ma20 AND ma20 > ma60 THEN ('buy', 80) WHEN close < ma5 AND ma5 < ma20 AND ma20 < ma60 THEN ('sell', 80) WHEN close > ma20 AND ma5 > ma20 THEN ('buy', 60) WHEN close < ma20 AND ma5 < ma20 THEN ('sell', 60)",
}


def _split(name: str, cases: str) -> str:
    signal, confidence = (cases, cases)
    for c in (75, 70, 65, 80, 60, 55):
        for s in ("buy", "sell", "hold"):
            signal, confidence = signal.replace(f"('{s}', {c})", f"'{s}'"), confidence.replace(f"('{s}', {c})", str(c))
    return f"CASE {signal} ELSE 'hold' END AS sig_{name}_signal, CASE {confidence} ELSE 50 END AS sig_{name}_confidence"


BEFORE = f"before AS MATERIALIZED (SELECT *, {lag('macd_hist')} AS h1, {lag('boll_pos')} AS p1, {lag('kdj_k')} AS k1, {lag('kdj_d')} AS d1 FROM ind)"
SIGS = f"{IND}, {BEFORE}, sigs AS MATERIALIZED (SELECT *, {', '.join(_split(n, c) for n, c in CASES.items())} FROM before)"
for _name, _rule in (("macd", sig.macd), ("rsi", sig.rsi), ("boll", sig.boll), ("kdj", sig.kdj), ("ma", sig.moving_averages)):
    _cols = [f"sig_{_name}_signal", f"sig_{_name}_confidence"]
    _prepare = {"macd": ind.ewm, "rsi": ind.rsi, "boll": ind.boll, "kdj": ind.ewm, "ma": ind.ma}[_name]
    query(f"sig_{_name}", f"{SIGS} SELECT symbol, date, {', '.join(_cols)} FROM sigs")(lambda s, d, p=_prepare, r=_rule, c=tuple(_cols): bars(s, d).transform(p).transform(r).select("symbol", "date", *c))

_N = ("macd", "rsi", "boll", "kdj", "ma")
_count = lambda s: " + ".join(f"(sig_{n}_signal = '{s}')::INTEGER" for n in _N)
_MEAN = "(" + " + ".join(f"sig_{n}_confidence" for n in _N) + ") / 5.0::DOUBLE"
TECHNICAL = f"""counted AS (SELECT *, {_count('buy')} AS buys, {_count('sell')} AS sells, {_MEAN} AS mean FROM sigs),
 technical AS MATERIALIZED (SELECT symbol, date, 'technical' AS agent, CASE WHEN rn < 60 THEN 'hold' WHEN buys > sells AND buys >= 3 THEN 'buy' WHEN sells > buys AND sells >= 3 THEN 'sell' ELSE 'hold' END AS signal,
 CASE WHEN rn < 60 THEN 30 WHEN greatest(buys, sells) >= 4 THEN least(95, mean + 10) ELSE mean END AS confidence, close, rn FROM counted)"""


def targets(table: str, buy: str, buy_stop: str, sell: str, sell_stop: str, name: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT symbol, date, agent, signal, confidence::DOUBLE AS confidence, CASE signal WHEN 'buy' THEN {buy} WHEN 'sell' THEN {sell} END AS target_price,
 CASE signal WHEN 'buy' THEN {buy_stop} WHEN 'sell' THEN {sell_stop} END AS stop_loss FROM {table})"""


T = targets("technical", "close * 1.08::DOUBLE", "close * 0.95::DOUBLE", "close * 0.92::DOUBLE", "close * 1.05::DOUBLE", "t_signals")
AGENT = ("symbol, date, agent, signal", "confidence; target_price; stop_loss")
query("sig_technical", f"{SIGS}, {TECHNICAL}, {T} " + select(*AGENT, "FROM t_signals"))(lambda s, d: sig.technical(ind.everything(bars(s, d))))

FUNDAMENTAL = f"{GROWTH}, {VALUATION}, {OVERALL}, " + """fundamental AS (SELECT *, 'fundamental' AS agent, CASE WHEN overall_score >= 70 THEN 'buy' WHEN overall_score <= 30 THEN 'sell' ELSE 'hold' END AS signal,
 CASE WHEN overall_score >= 70 THEN least(95, overall_score) WHEN overall_score <= 30 THEN least(95, 100 - overall_score) ELSE 50 END AS confidence FROM overall), """ + targets(
    "fundamental", "CASE WHEN pe > 0 AND pe < 50 THEN close * 25 / pe ELSE close * 1.15::DOUBLE END", "close * 0.90::DOUBLE", "close * 0.85::DOUBLE", "close * 1.10::DOUBLE", "f_signals"
)
query("sig_fundamental", f"WITH {BARS}, {RAW_FUNDAMENTALS}, {FUNDAMENTAL} " + select(*AGENT, "FROM f_signals"))(lambda s, d: sig.fundamental(overall(s, d)))

SENT = f"""s0 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS n, close / {lag('close')} - 1 AS r, (close / {lag('close', 4)} - 1) * 100 AS returns_5d, (close / {lag('close', 9)} - 1) * 100 AS returns_10d FROM bars),
 s1 AS (SELECT *, (returns_5d + returns_10d) / 2 AS momentum, CASE WHEN avg(volume) OVER {win(20)} > 0 THEN avg(volume) OVER {win(5)} / avg(volume) OVER {win(20)} ELSE 1 END AS volume_ratio, stddev_samp(r) OVER {ALL} * 100 AS volatility FROM s0),
 s2 AS (SELECT *, CASE WHEN volume_ratio > 1.3 THEN 'high' WHEN volume_ratio < 0.7 THEN 'low' ELSE 'normal' END AS volume_trend, CASE WHEN volatility > 3 THEN 'high' WHEN volatility < 1 THEN 'low' ELSE 'normal' END AS volatility_state FROM s1),
 s3 AS MATERIALIZED (SELECT *, CASE WHEN momentum IS NULL THEN NULL ELSE greatest(0, least(100, 50 + 2 * momentum)) END * 0.4::DOUBLE
 + CASE volume_trend WHEN 'high' THEN CASE WHEN momentum > 0 THEN 70 ELSE 30 END WHEN 'low' THEN 40 ELSE 50 END * 0.3::DOUBLE + CASE volatility_state WHEN 'high' THEN 40 WHEN 'low' THEN 60 ELSE 50 END * 0.3::DOUBLE AS overall_sentiment FROM s2)"""
query("ind_sentiment", f"WITH {BARS}, {SENT} " + select("symbol, date, volume_trend, volatility_state", "momentum; volume_ratio; volatility; overall_sentiment", "FROM s3"))(
    lambda s, d: sig.sentiment_indicators(bars(s, d)).select("symbol", "date", "volume_trend", "volatility_state", "momentum", "volume_ratio", "volatility", "overall_sentiment")
)
SENTIMENT = f"{SENT}, " + """sentiment AS (SELECT *, 'sentiment' AS agent, CASE WHEN n < 20 THEN 'hold' WHEN overall_sentiment > 70 AND momentum > 0 THEN 'buy' WHEN overall_sentiment < 30 AND momentum < 0 THEN 'sell' ELSE 'hold' END AS signal,
 CASE WHEN n < 20 THEN 30 WHEN overall_sentiment > 70 AND momentum > 0 THEN overall_sentiment WHEN overall_sentiment < 30 AND momentum < 0 THEN 100 - overall_sentiment ELSE 50 END AS confidence FROM s3), """ + targets(
    "sentiment", "close * (1 + abs(momentum) / 100)", "close * 0.93::DOUBLE", "close * (1 - abs(momentum) / 100)", "close * 1.07::DOUBLE", "m_signals"
)
query("sig_sentiment", f"WITH {BARS}, {SENTIMENT} " + select(*AGENT, "FROM m_signals"))(lambda s, d: sig.sentiment(sig.sentiment_indicators(bars(s, d))))


def every_agent(spark, sf_dir):
    b = bars(spark, sf_dir)
    out = sig.technical(ind.everything(b)).unionByName(sig.sentiment(sig.sentiment_indicators(b)))
    return out.unionByName(sig.fundamental(overall(spark, sf_dir)))


def vote_sql(source: str, extra: str = "") -> str:
    w = f"CASE agent WHEN 'technical' THEN 0.35 WHEN 'fundamental' THEN 0.35 WHEN 'sentiment' THEN 0.30 {extra} ELSE 0.33 END::DOUBLE"
    score = lambda s: f"sum(CASE WHEN signal = '{s}' THEN w * confidence / 100 ELSE 0 END) / sum(w) AS {s}_score"
    mean = lambda c, s: f"avg(CASE WHEN signal = '{s}' AND {c} <> 0 THEN {c} END) AS {c}_{s}"
    cols = [score(s) for s in ("buy", "sell", "hold")] + [mean(c, s) for c in ("target_price", "stop_loss") for s in ("buy", "sell", "hold")]
    pick = lambda c: f"CASE decision WHEN 'buy' THEN {c}_buy WHEN 'sell' THEN {c}_sell ELSE {c}_hold END AS {c}"
    return f"""v0 AS (SELECT symbol, date, {', '.join(cols)} FROM (SELECT *, {w} AS w FROM {source}) GROUP BY 1, 2),
 v1 AS (SELECT *, CASE WHEN buy_score >= sell_score AND buy_score >= hold_score THEN 'buy' WHEN sell_score >= hold_score THEN 'sell' ELSE 'hold' END AS decision, greatest(buy_score, sell_score, hold_score) * 100 AS confidence FROM v0),
 decisions AS MATERIALIZED (SELECT symbol, date, decision, confidence, buy_score, sell_score, hold_score, {pick('target_price')}, {pick('stop_loss')} FROM v1)"""


EVERY = f"{SIGS}, {TECHNICAL}, {T}, {RAW_FUNDAMENTALS}, {FUNDAMENTAL}, {SENTIMENT}, every AS (SELECT * FROM t_signals UNION ALL SELECT * FROM f_signals UNION ALL SELECT * FROM m_signals)"
VOTE = ("symbol, date, decision", "confidence; buy_score; sell_score; hold_score; target_price; stop_loss")
query("vote_weighted", f"{EVERY}, {vote_sql('every')} " + select(*VOTE, "FROM decisions"))(lambda s, d: sig.vote(every_agent(s, d)))
query("reco_rank", f"{EVERY}, {vote_sql('every')} " + select("date, decision, CAST(row_number() OVER (PARTITION BY date, decision ORDER BY round(confidence, 4) DESC, symbol) AS INTEGER) AS rank, symbol, count(*) OVER (PARTITION BY date, decision) AS class_size", "round(confidence, 4) AS confidence", "FROM decisions"))(
    lambda s, d: sig.recommendations(sig.vote(every_agent(s, d)).withColumn("confidence", F.round("confidence", 4)))
)
query("confidence_weighted", f"WITH {BARS}, {SENTIMENT} " + select("symbol", "coalesce(greatest(0, least(100, sum(confidence * volume) / nullif(sum(volume), 0))), 50) AS weighted_confidence", "FROM m_signals JOIN bars USING (symbol, date) GROUP BY 1"))(
    lambda s, d: sig.confidence_weighted(sig.sentiment(sig.sentiment_indicators(bars(s, d))).join(bars(s, d).select("symbol", "date", "volume"), ["symbol", "date"]), "symbol", "confidence", "volume")
)


def gap_agent(b):
    """An own agent: buys where the day opened below half of its range."""
    low = F.col("open") < (F.col("high") + F.col("low")) / 2
    return b.select("symbol", "date", F.when(low, "buy").otherwise("hold").alias("signal"), F.when(low, 55.0).otherwise(45.0).alias("confidence"), F.when(low, F.col("high")).alias("target_price"), F.when(low, F.col("low")).alias("stop_loss"))


def plugin(spark, sf_dir):
    b = bars(spark, sf_dir)
    rows, weights = sig.with_plugins(b, {"gap": (gap_agent, 0.2)}, sig.sentiment(sig.sentiment_indicators(b)))
    return sig.vote(rows, weights)


GAP = """gap AS (SELECT symbol, date, 'gap' AS agent, CASE WHEN open < (high + low) / 2 THEN 'buy' ELSE 'hold' END AS signal, CASE WHEN open < (high + low) / 2 THEN 55.0 ELSE 45.0 END::DOUBLE AS confidence,
 CASE WHEN open < (high + low) / 2 THEN high END AS target_price, CASE WHEN open < (high + low) / 2 THEN low END AS stop_loss FROM bars), both_agents AS (SELECT * FROM m_signals UNION ALL SELECT * FROM gap)"""
query("signal_plugin", f"WITH {BARS}, {SENTIMENT}, {GAP}, {vote_sql('both_agents', 'WHEN ' + chr(39) + 'gap' + chr(39) + ' THEN 0.2')} " + select(*VOTE, "FROM decisions"))(plugin)
query("market_overview", f"WITH {BARS} " + select("symbol, date", "close; change_pct; volume", f"FROM (SELECT *, (close / {lag('close')} - 1) * 100 AS change_pct, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS last FROM bars) WHERE last = 1"))(
    lambda s, d: sig.market_overview(bars(s, d))
)


def holdings(spark, sf_dir):
    b = bars(spark, sf_dir)
    own = b.groupBy("symbol").agg(F.min_by("close", "date").alias("first"), F.count("*").alias("n")).select("symbol", F.concat(F.lit("account_"), (brand_number() % 4).cast("string")).alias("account"), F.col("n").cast("double").alias("quantity"), F.when(brand_number() % 6 == 0, 0.0).otherwise(F.col("first")).alias("cost_basis"))
    return sig.holdings_valuation(own, b.groupBy("symbol").agg(F.max_by("close", "date").alias("close"))).select("account", "symbol", "quantity", "value", "cost", "gain", "return_pct", "account_value", "account_return_pct")


query(
    "holdings_valuation",
    f"""WITH {BARS}, h AS (SELECT symbol, 'account_' || (k % 4) AS account, n::DOUBLE AS quantity, n * c AS value, CASE WHEN k % 6 = 0 THEN 0 ELSE n * f END AS cost FROM (
 SELECT symbol, CAST(regexp_extract(symbol, '[0-9]+') AS INTEGER) AS k, count(*) AS n, arg_min(close, date) AS f, arg_max(close, date) AS c FROM bars GROUP BY 1)) """
    + select("account, symbol", "quantity; value; cost; CASE WHEN cost > 0 THEN value - cost ELSE 0 END AS gain; CASE WHEN cost > 0 THEN (value / cost - 1) * 100 ELSE 0 END AS return_pct; sum(value) OVER (PARTITION BY account) AS account_value; (sum(value) OVER (PARTITION BY account) / nullif(sum(cost) OVER (PARTITION BY account), 0) - 1) * 100 AS account_return_pct", "FROM h"),
)(holdings)
