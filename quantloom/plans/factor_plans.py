"""Queries on point-in-time joins, factor and macro scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import factors as fa
from ..operators import macro as mc
from ..operators import pit
from ..operators import portfolio as pf
from ..sources.normalize import normalize_fundamentals
from .adapters import BARS, MACRO, MEMBERS, RAW_FUNDAMENTALS, SIGNAL_DATES, bars, macro, raw_fundamentals, shared, signal_dates, strategy_members
from .indicator_plans import full, lag
from .portfolio_plans import LIMITS, poured
from .registry import query, select

AVERAGE = lambda *p: f"CASE WHEN {' + '.join(f'({x} IS NOT NULL)::INTEGER' for x in p)} > 0 THEN ({' + '.join(f'coalesce({x}, 0)' for x in p)}) / ({' + '.join(f'({x} IS NOT NULL)::INTEGER' for x in p)}) ELSE 50 END"
CLIP = lambda x: f"CASE WHEN ({x}) IS NOT NULL THEN greatest(0.0::DOUBLE, least(100.0::DOUBLE, {x})) END"
HIGHER = lambda x, a, b: CLIP(f"({x} - {a}) / ({b}::DOUBLE - {a}::DOUBLE) * 100")
LOWER = lambda x, a, b: CLIP(f"({b} - {x}) / ({b}::DOUBLE - {a}::DOUBLE) * 100")
CENTER = lambda x, m, t: CLIP(f"(1 - abs({x} - {m}) / {t}::DOUBLE) * 100")


def twice(spark, sf_dir):
    """Reports with their fetch time and source; every seventh brand's come a second time, sometimes without fetch time."""
    k = F.regexp_extract("symbol", "[0-9]+", 0).cast("int")
    once = raw_fundamentals(spark, sf_dir).withColumns({"source": F.lit("a"), "fetched_at": F.to_timestamp(F.lit("2020-01-01"))})
    again = once.where(k % 7 == 1).withColumns({"source": F.lit("b"), "fetched_at": F.when(k % 2 == 0, F.to_timestamp(F.lit("2020-01-02"))), "pe": F.col("pe") + 1})
    return normalize_fundamentals(once.unionByName(again))


TWICE = f"""{RAW_FUNDAMENTALS}, t0 AS (SELECT *, 'a' AS source, TIMESTAMP '2020-01-01' AS fetched_at FROM raw_fundamentals),
 t1 AS (SELECT * FROM t0 UNION ALL SELECT * REPLACE (pe + 1 AS pe, 'b' AS source, CASE WHEN CAST(regexp_extract(symbol, '[0-9]+') AS INTEGER) % 2 = 0 THEN TIMESTAMP '2020-01-02' END AS fetched_at) FROM t0 WHERE CAST(regexp_extract(symbol, '[0-9]+') AS INTEGER) % 7 = 1),
 twice AS MATERIALIZED (SELECT * REPLACE ({', '.join(f'CASE WHEN abs({c}) <= 1 THEN {c} ELSE {c} / 100 END AS {c}' for c in ('dividend_yield', 'roe', 'gross_margin', 'net_margin', 'debt_ratio'))}) FROM t1),
 clean AS MATERIALIZED (SELECT * FROM (SELECT * REPLACE (CASE WHEN available_date >= report_date THEN available_date END AS available_date) FROM twice)
 QUALIFY row_number() OVER (PARTITION BY symbol, report_date, available_date ORDER BY fetched_at DESC NULLS FIRST, source DESC NULLS LAST) = 1)"""
_F = "pe; pb; dividend_yield; roe; gross_margin; net_margin; debt_ratio"
_FK = ("symbol", "report_date", "available_date", "source", "pe", "pb", "dividend_yield", "roe", "gross_margin", "net_margin", "debt_ratio")
query("fundamentals_normalize", f"WITH {TWICE} " + select("symbol, report_date, available_date, source, available_date IS NOT NULL AS point_in_time", _F, "FROM twice"))(lambda s, d: twice(s, d).select(*_FK[:4], "point_in_time", *_FK[4:]))


def clean(spark, sf_dir):
    return pit.validate_fundamentals(twice(spark, sf_dir))


def signals(spark, sf_dir):
    return signal_dates(spark, sf_dir).select(F.col("date").alias("signal_date"))


query("fundamentals_validate", f"WITH {TWICE} " + select("symbol, report_date, available_date, source", _F, "FROM clean"))(lambda s, d: clean(s, d).select(*_FK))
query("fundamentals_eligible", f"WITH {TWICE} " + select("symbol, report_date, available_date, source", _F, "FROM clean WHERE available_date <= DATE '1999-06-30' AND report_date <= DATE '1999-06-30'"))(
    lambda s, d: pit.eligible(clean(s, d), F.lit("1999-06-30").cast("date")).select(*_FK)
)
ASOF = f"""{SIGNAL_DATES}, fa0 AS MATERIALIZED (SELECT d.date AS signal_date, c.* FROM signal_dates d JOIN clean c ON c.available_date <= d.date AND c.report_date <= d.date
 QUALIFY row_number() OVER (PARTITION BY d.date, c.symbol ORDER BY c.available_date DESC, c.report_date DESC) = 1)"""


@shared
def fundamentals(spark, sf_dir):
    return pit.asof(clean(spark, sf_dir), signals(spark, sf_dir), ["symbol"])


query("fundamentals_asof", f"WITH {BARS}, {TWICE}, {ASOF} " + select("signal_date, symbol, report_date, available_date", _F, "FROM fa0"))(lambda s, d: fundamentals(s, d).select("signal_date", "symbol", "report_date", "available_date", *_FK[4:]))
query(
    "fundamentals_rejected_counts",
    f"""WITH {BARS}, {TWICE}, {SIGNAL_DATES} SELECT symbol, d.date AS signal_date, count(*) FILTER (available_date IS NULL) AS missing_available, count(*) FILTER (available_date > d.date) AS published_later,
 count(*) FILTER (report_date > d.date) AS future_report FROM clean CROSS JOIN signal_dates d GROUP BY 1, 2""",
)(lambda s, d: pit.rejected_counts(clean(s, d), signals(s, d)))

# Macro

_MF = "pmi; cpi_yoy; ppi_yoy; m2_yoy; social_financing_yoy; ten_year_yield; usd_cny; policy_score; external_risk_score"
MASOF = f"""{BARS}, {MACRO}, {SIGNAL_DATES}, ma AS MATERIALIZED (SELECT d.date AS signal_date, arg_max(m.date, (available_date, m.date)) FILTER (available_date <= d.date AND m.date <= d.date) AS macro_date,
 count(*) FILTER (available_date > d.date) AS published_later, count(*) FILTER (available_date IS NULL) AS missing_available, count(*) FILTER (available_date <= d.date AND m.date <= d.date) AS eligible FROM signal_dates d CROSS JOIN macro m GROUP BY 1),
 masof AS MATERIALIZED (SELECT ma.*, m.* EXCLUDE (date, available_date) FROM ma LEFT JOIN macro m ON m.date = ma.macro_date)"""
query("macro_asof", f"WITH {MASOF} " + select("signal_date, macro_date, published_later, missing_available, eligible", _MF, "FROM masof"))(lambda s, d: pit.macro_asof(macro(s, d), signals(s, d)))


def mscores(source: str) -> str:
    n = " + ".join(f"({x} IS NULL)::INTEGER" for x in mc.INPUTS)
    return f"""ms AS MATERIALIZED (SELECT *, coalesce({CLIP('(pmi - 45) * 10')}, 50) AS growth_score, {AVERAGE(f"({CENTER('cpi_yoy', 2.2, 4.5)})", f"({CENTER('ppi_yoy', 1.5, 7.0)})")} AS inflation_score,
 {AVERAGE(f"({CLIP('(m2_yoy - 5) / 8 * 100')})", f"({CLIP('(4.5 - ten_year_yield) / 2.5 * 100')})")} AS liquidity_score, coalesce({CLIP('(social_financing_yoy - 5) * 10')}, 50) AS credit_score,
 coalesce({CLIP('policy_score')}, 50) AS policy, coalesce({CLIP('external_risk_score')}, 50) AS external_risk, {n} AS missing_inputs FROM {source}),
 mr AS MATERIALIZED (SELECT *, CASE WHEN missing_inputs >= 5 THEN 'uncertain' WHEN growth_score < 35 AND credit_score < 45 THEN 'recession' WHEN growth_score < 45 AND inflation_score < 40 THEN 'stagflation'
 WHEN growth_score < 50 AND (liquidity_score < 50 OR credit_score < 50) THEN 'slowdown' WHEN growth_score >= 45 AND growth_score < 60 AND (liquidity_score >= 55 OR credit_score >= 55) THEN 'recovery'
 WHEN growth_score >= 60 AND inflation_score >= 45 AND liquidity_score >= 45 THEN 'expansion' ELSE 'uncertain' END AS regime FROM ms),
 mb AS (SELECT *, CASE regime WHEN 'recession' THEN 0.6 WHEN 'slowdown' THEN 0.8 WHEN 'stagflation' THEN 0.75 WHEN 'recovery' THEN 1.0 WHEN 'expansion' THEN 1.1 ELSE 0.9 END::DOUBLE
 - CASE WHEN external_risk < 35 THEN 0.1 ELSE 0 END::DOUBLE + CASE WHEN policy > 75 THEN 0.05 ELSE 0 END::DOUBLE AS base FROM mr),
 mm AS MATERIALIZED (SELECT *, greatest(0.6::DOUBLE, least(1.2::DOUBLE, CASE WHEN regime = 'expansion' AND least(growth_score, inflation_score, liquidity_score, credit_score, policy, external_risk) >= 80 THEN greatest(base, 1.2) ELSE base END)) AS multiplier FROM mb)"""


_MS = "growth_score; inflation_score; liquidity_score; credit_score; policy; external_risk"
query("macro_scores", f"WITH {MACRO}, {mscores('macro')} " + select("date, missing_inputs", _MS, "FROM ms"))(lambda s, d: mc.scores(macro(s, d)).select("date", "missing_inputs", *mc.DIMENSIONS))
query("macro_regime", f"WITH {MACRO}, {mscores('macro')} SELECT date, regime FROM mr")(lambda s, d: mc.regime(mc.scores(macro(s, d))).select("date", "regime"))
query("macro_multiplier", f"WITH {MACRO}, {mscores('macro')} " + select("date, regime", "multiplier", "FROM mm"))(lambda s, d: mc.multiplier(mc.regime(mc.scores(macro(s, d)))).select("date", "regime", "multiplier"))
query("macro_at_signal", f"WITH {MASOF}, {mscores('masof')} " + select("signal_date, macro_date, regime", "CASE WHEN macro_date IS NULL THEN 1.0 ELSE multiplier END AS multiplier", "FROM mm"))(lambda s, d: mc.at_signals(pit.macro_asof(macro(s, d), signals(s, d))).select("signal_date", "macro_date", "regime", "multiplier"))

# Factors

VALUE = AVERAGE(f"({LOWER('CASE WHEN pe > 0 THEN pe END', 8, 60)})", f"({LOWER('CASE WHEN pb > 0 THEN pb END', 0.8, 8)})", f"({HIGHER('dividend_yield', 0.0, 0.06)})")
QUALITY = AVERAGE(f"({HIGHER('roe', 0.0, 0.25)})", f"({HIGHER('gross_margin', 0.1, 0.6)})", f"({HIGHER('net_margin', 0.02, 0.25)})", f"({HIGHER('operating_cash_flow_quality', 0.5, 1.5)})", f"({LOWER('debt_ratio', 0.2, 0.8)})")
FF = f"ff AS MATERIALIZED (SELECT *, {VALUE} AS value_score, {QUALITY} AS quality_score FROM (SELECT *, CASE WHEN net_profit <> 0 THEN operating_cash_flow / net_profit END AS operating_cash_flow_quality FROM fa0))"
FSQL = f"WITH {BARS}, {TWICE}, {ASOF}, {FF} "


def fundamental_factors(spark, sf_dir):
    return fa.quality(fa.value(fa.inputs(fundamentals(spark, sf_dir))))


query("factor_inputs", FSQL + select("signal_date, symbol", "operating_cash_flow_quality", "FROM ff"))(lambda s, d: fa.inputs(fundamentals(s, d)).select("signal_date", "symbol", "operating_cash_flow_quality"))
query("factor_value", FSQL + select("signal_date, symbol", "value_score", "FROM ff"))(lambda s, d: fundamental_factors(s, d).select("signal_date", "symbol", "value_score"))
query("factor_quality", FSQL + select("signal_date, symbol", "quality_score", "FROM ff"))(lambda s, d: fundamental_factors(s, d).select("signal_date", "symbol", "quality_score"))
query("metric_alias", f"WITH {RAW_FUNDAMENTALS} " + select("symbol, report_date", "coalesce(gross_margin, roe, pe) AS margin", "FROM raw_fundamentals"))(
    lambda s, d: fa.metric(raw_fundamentals(s, d).withColumn("text", F.lit("n/a")), "margin", ("absent", "text", "gross_margin", "roe", "pe")).select("symbol", "report_date", "margin")
)
_SC = {"higher": HIGHER("pe", 8, 60), "lower": LOWER("pe", 8, 60), "center": CENTER("pe", 30, 20)}


def components(spark, sf_dir):
    from ..functions import scores as sc

    pe, gm = F.col("pe"), F.col("gross_margin")
    df = raw_fundamentals(spark, sf_dir).withColumns({"higher": sc.higher(pe, 8, 60), "lower": sc.lower(pe, 8, 60), "center": sc.center(pe, 30, 20), "clipped": sc.clip_score(gm * 300), "flat": sc.higher(gm, 1, 1)})
    return df.withColumn("mean", sc.average_available(F.col("higher"), F.col("flat")))


_COMP = f"WITH {RAW_FUNDAMENTALS}, x AS (SELECT symbol, report_date, {', '.join(f'{v} AS {k}' for k, v in _SC.items())}, coalesce({CLIP('gross_margin * 300')}, 0) AS clipped, CASE WHEN gross_margin IS NOT NULL THEN 50.0::DOUBLE END AS flat FROM raw_fundamentals) "
for _name, _c in (("score_higher", "higher"), ("score_lower", "lower"), ("score_center", "center"), ("clip_score", "clipped")):
    query(_name, _COMP + select("symbol, report_date", _c, "FROM x"))(lambda s, d, c=_c: components(s, d).select("symbol", "report_date", c))
query("average_available", _COMP + select("symbol, report_date", f"{AVERAGE('higher', 'flat')} AS mean", "FROM x"))(lambda s, d: components(s, d).select("symbol", "report_date", "mean"))


_PAST = lambda n: f"CASE WHEN {lag('close', n)} > 0 THEN {lag('close', 21)} / {lag('close', n)} - 1 END"
_GUARD = lambda x: f"(CASE WHEN {x} = 0 THEN 1e-10 ELSE {x} END)"
PRICES = f"""p0 AS MATERIALIZED (SELECT *, {_PAST(147)} AS momentum_6m, {_PAST(273)} AS momentum_12m, close - {lag('close')} AS step, close / {lag('close')} - 1 AS r, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn, {lag('close', 20)} AS base FROM bars),
 p1 AS MATERIALIZED (SELECT *, CASE WHEN step IS NOT NULL THEN greatest(step, 0) END AS g0, CASE WHEN step IS NOT NULL THEN greatest(-step, 0) END AS l0 FROM p0),
 p2 AS MATERIALIZED (SELECT *, {full('avg', 'g0', 14)} AS g, {full('avg', 'l0', 14)} AS l, {full('avg', 'close', 20)} AS mid, {full('stddev_samp', 'close', 20)} AS sd, {full('avg', 'volume', 60)} AS vol60,
 CASE WHEN rn >= 253 THEN {full('stddev_samp', 'r', 252)} * sqrt(252) END AS annualized_volatility FROM p1),
 dd AS (SELECT symbol, rn, min(c / peak - 1) AS max_drawdown FROM (SELECT a.symbol, a.rn, b.close AS c, max(b.close) OVER (PARTITION BY a.symbol, a.rn ORDER BY b.rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak
 FROM p2 a JOIN p2 b ON b.symbol = a.symbol AND b.rn BETWEEN a.rn - 252 AND a.rn WHERE a.rn >= 253 AND a.date IN (SELECT date FROM asof_rows WHERE symbol = a.symbol)) GROUP BY 1, 2),
 p3 AS MATERIALIZED (SELECT p2.*, max_drawdown, CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / {_GUARD('l')}) END AS rsi, CASE WHEN sd = 0 THEN 0.5 ELSE (close - (mid - 2 * sd)) / (4 * {_GUARD('sd')}) END AS bollinger_position,
 CASE WHEN base > 0 THEN close / base - 1 END AS short_term_return, CASE WHEN vol60 > 0 THEN volume / vol60 END AS volume_ratio_60 FROM p2 LEFT JOIN dd USING (symbol, rn)),
 px AS MATERIALIZED (SELECT *, {AVERAGE(f"({HIGHER('momentum_6m', -0.2, 0.5)})", f"({HIGHER('momentum_12m', -0.3, 0.8)})")} AS momentum_score, {AVERAGE(f"({LOWER('annualized_volatility', 0.12, 0.6)})", f"({LOWER('abs(max_drawdown)', 0.08, 0.5)})")} AS low_vol_score,
 {AVERAGE(f"({CENTER('rsi', 50, 35)})", f"({CENTER('bollinger_position', 0.5, 0.5)})", f"({CENTER('short_term_return', 0.0, 0.25)})", f"({LOWER('abs(volume_ratio_60 - 1)', 0, 2)})")} AS obos_score FROM p3)"""
ROWS = """asof_rows AS MATERIALIZED (SELECT d.date AS signal_date, b.symbol, max(b.date) AS date FROM signal_dates d JOIN bars b ON b.date <= d.date GROUP BY 1, 2)"""
query("factor_momentum", f"WITH {BARS}, {SIGNAL_DATES}, {ROWS}, {PRICES} " + select("symbol, date", "momentum_6m; momentum_12m; momentum_score", "FROM px"))(lambda s, d: fa.momentum(bars(s, d)).select("symbol", "date", "momentum_6m", "momentum_12m", "momentum_score"))
query("factor_obos", f"WITH {BARS}, {SIGNAL_DATES}, {ROWS}, {PRICES} " + select("symbol, date", "rsi; bollinger_position; short_term_return; volume_ratio_60; obos_score", "FROM px"))(lambda s, d: fa.obos(bars(s, d)).select("symbol", "date", "rsi", "bollinger_position", "short_term_return", "volume_ratio_60", "obos_score"))


def last_rows(spark, sf_dir, b):
    """(signal_date, symbol, date): a symbol's last row at or before each signal date."""
    return pit.asof(b.select("symbol", "date"), signals(spark, sf_dir), ["symbol"], "date", "date")


def asof_prices(spark, sf_dir, step):
    """Price factors on the last row at or before each signal date; ``step`` takes the bars and those rows."""
    b = bars(spark, sf_dir)
    last = last_rows(spark, sf_dir, b)
    return last.join(step(b, last), ["symbol", "date"])


query("factor_low_vol", f"WITH {BARS}, {SIGNAL_DATES}, {ROWS}, {PRICES} " + select("signal_date, symbol", "annualized_volatility; max_drawdown; low_vol_score", "FROM asof_rows JOIN px USING (symbol, date)"))(
    lambda s, d: asof_prices(s, d, lambda b, at: fa.low_vol(b, at=at)).select("signal_date", "symbol", "annualized_volatility", "max_drawdown", "low_vol_score")
)
query(
    "factor_readiness",
    f"""WITH {BARS}, n AS (SELECT symbol, count(*) AS observations FROM bars WHERE date < DATE '1995-12-31' GROUP BY 1), need(component, minimum) AS (VALUES {', '.join(f"('{k}', {v})" for k, v in fa.READINESS.items())})
 SELECT symbol, observations, component, minimum, observations >= minimum AS ready, CASE WHEN observations < minimum THEN 'insufficient ' || component || ' observations: ' || observations || ' available, ' || minimum || ' required' END AS message FROM n CROSS JOIN need""",
)(lambda s, d: fa.readiness(bars(s, d).where(F.col("date") < F.lit("1995-12-31").cast("date")).groupBy("symbol").agg(F.count("*").alias("observations"))))


@shared
def all_factors(spark, sf_dir):
    """Fundamental and price factors of every symbol with prices at each signal date."""
    f = fundamental_factors(spark, sf_dir)
    step = lambda b, at: fa.low_vol(b.transform(fa.momentum).transform(fa.obos), at=at)
    df = asof_prices(spark, sf_dir, step).join(f.drop("available_date", "source", "fetched_at", "point_in_time"), ["signal_date", "symbol"], "left")
    return fa.composite(fa.availability(df), only_available=True)


_NN = lambda *c: " + ".join(f"({x} IS NOT NULL)::INTEGER" for x in c)
_FIELDS = {k: tuple(c for c in v if c != "valuation_percentile") for k, v in fa.FIELDS.items()}
_W = " + ".join(f"CASE WHEN {k}_fields > 0 THEN {w} ELSE 0 END" for k, w in fa.WEIGHTS.items())
_S = " + ".join(f"CASE WHEN {k}_fields > 0 THEN {w} * coalesce({k}_score, 0) ELSE 0 END" for k, w in fa.WEIGHTS.items())
ALLF = f"""{BARS}, {TWICE}, {ASOF}, {FF}, {ROWS}, {PRICES}, af0 AS (SELECT r.signal_date, r.symbol, px.* EXCLUDE (symbol, date), r.date, ff.* EXCLUDE (signal_date, symbol) FROM asof_rows r JOIN px USING (symbol, date) LEFT JOIN ff ON ff.symbol = r.symbol AND ff.signal_date = r.signal_date),
 af1 AS (SELECT *, {', '.join(f'{_NN(*v)} AS {k}_fields' for k, v in _FIELDS.items())} FROM af0),
 af AS MATERIALIZED (SELECT *, ({_S}) / nullif({_W}, 0) AS composite_score FROM af1)"""
_AV = ", ".join(f"{k}_fields, {k}_fields > 0 AS {k}_available" for k in fa.FIELDS)
query("factor_availability", f"WITH {ALLF} SELECT signal_date, symbol, {_AV} FROM af")(lambda s, d: all_factors(s, d).select("signal_date", "symbol", *[x for k in fa.FIELDS for x in (f"{k}_fields", f"{k}_available")]))
_SCORES = "; ".join(f"{k}_score" for k in fa.FIELDS)
query("factor_composite_avail", f"WITH {ALLF} " + select("signal_date, symbol", f"composite_score; {_SCORES}", "FROM af"))(lambda s, d: all_factors(s, d).select("signal_date", "symbol", "composite_score", *[f"{k}_score" for k in fa.FIELDS]))
_ALLW = " + ".join(f"{w} * coalesce({k}_score, 0)" for k, w in fa.WEIGHTS.items())
query("factor_composite", f"WITH {ALLF} " + select("signal_date, symbol", f"({_ALLW}) / {sum(fa.WEIGHTS.values())}::DOUBLE AS composite_score", "FROM af"))(lambda s, d: fa.composite(all_factors(s, d).drop("composite_score")).select("signal_date", "symbol", "composite_score"))
query("factor_buckets", f"WITH {ALLF} " + select("signal_date, count(*) FILTER (composite_score >= 80) AS high, count(*) FILTER (composite_score >= 60 AND composite_score < 80) AS middle, count(*) FILTER (composite_score < 60) AS low", "avg(composite_score) AS mean; min(composite_score) AS min; max(composite_score) AS max", "FROM af GROUP BY signal_date"))(
    lambda s, d: fa.buckets(all_factors(s, d), "signal_date")
)
query(
    "factor_coverage",
    f"WITH {ALLF}, lf AS ({' UNION ALL '.join(f'''SELECT '{k}' AS factor, signal_date, {k}_fields > 0 AS available FROM af''' for k in fa.FIELDS)}) "
    + select("factor, signal_date, count(*) FILTER (available) AS available, count(*) FILTER (NOT available) AS missing", "count(*) FILTER (available) / count(*) AS coverage_ratio", "FROM lf GROUP BY GROUPING SETS ((factor, signal_date), (factor))"),
)(lambda s, d: fa.coverage(all_factors(s, d)))
query("universe_fixed", f"WITH {BARS} SELECT DISTINCT symbol, false AS point_in_time FROM bars WHERE symbol IN ('Brand#1', 'Brand#3', 'Brand#25')")(
    lambda s, d: __import__("quantloom.sources.normalize", fromlist=["x"]).universe_fixed(s, ["Brand#1 ", "", "Brand#3", "Brand#25", "Brand#3", "Brand#99"]).join(bars(s, d), "symbol", "left_semi")
)


@shared
def snapshot(spark, sf_dir):
    """One row per signal date and symbol: scores, availability, the macro regime, target weight or rejection."""
    scored = all_factors(spark, sf_dir).join(strategy_members(bars(spark, sf_dir)).select("symbol", "industry"), "symbol")
    ranked = pf.rank_candidates(scored.where(F.col("composite_score").isNotNull()).select(F.col("signal_date").cast("string").alias("portfolio"), "symbol", F.round("composite_score", 6).alias("score"), "industry", F.regexp_extract("symbol", "[0-9]+", 0).cast("int").alias("ordinal")), LIMITS)
    regime = mc.at_signals(pit.macro_asof(macro(spark, sf_dir), signals(spark, sf_dir))).select(F.col("signal_date").cast("string").alias("portfolio"), "regime", "multiplier")
    return pf.build(pf.equity_budget(ranked.join(regime, "portfolio"), LIMITS), LIMITS)


SNAPSHOT = f"""{ALLF}, {MACRO}, {MEMBERS}, {MASOF.replace(BARS + ", ", "").replace(MACRO + ", ", "").replace(SIGNAL_DATES + ", ", "")}, {mscores('masof')},
 n0 AS (SELECT CAST(signal_date AS VARCHAR) AS portfolio, symbol, round(composite_score, 6) AS score, industry, CAST(regexp_extract(symbol, '[0-9]+') AS INTEGER) AS ordinal FROM af JOIN members USING (symbol) WHERE composite_score IS NOT NULL),
 n1 AS (SELECT *, CASE WHEN score >= 40 THEN CAST(row_number() OVER (PARTITION BY portfolio ORDER BY score >= 40 DESC, score DESC, ordinal) AS INTEGER) END AS rank FROM n0),
 n2 AS MATERIALIZED (SELECT n1.*, regime, CASE WHEN macro_date IS NULL THEN 1.0 ELSE multiplier END AS multiplier, CASE WHEN score < 40 THEN 'score below threshold 40.00' WHEN rank > 8 THEN 'outside top 8 by composite_score' END AS reason FROM n1 JOIN mm ON CAST(mm.signal_date AS VARCHAR) = portfolio),
 {poured('n2', 'greatest(1 - 0.4::DOUBLE, least(1 - 0.05::DOUBLE, greatest(0, least(1, multiplier))))')}"""
query("factor_snapshot", f"WITH RECURSIVE {SNAPSHOT} " + select("portfolio, symbol, rank, selected, reason, regime", "score; target_weight; 1 - invested_weight AS cash_weight; multiplier", "FROM built"))(
    lambda s, d: snapshot(s, d).select("portfolio", "symbol", "score", "rank", "selected", "reason", "target_weight", "cash_weight", "regime", "multiplier")
)


def weight_schedule(spark, sf_dir):
    """Weights by execution date: each signal date's portfolio is traded on the next bar date."""
    days = bars(spark, sf_dir).select("date").distinct()
    after = signals(spark, sf_dir).join(days, F.col("date") > F.col("signal_date")).groupBy("signal_date").agg(F.min("date").alias("execution_date"))  # days of a calendar
    rows = snapshot(spark, sf_dir).where("target_weight > 0").join(after.select(F.col("signal_date").cast("string").alias("portfolio"), "execution_date"), "portfolio")
    return rows.select("execution_date", "portfolio", "symbol", "target_weight")


query(
    "weight_schedule",
    f"WITH RECURSIVE {SNAPSHOT}, after AS (SELECT CAST(s.date AS VARCHAR) AS portfolio, min(b.date) AS execution_date FROM signal_dates s JOIN (SELECT DISTINCT date FROM bars) b ON b.date > s.date GROUP BY 1) "
    + select("execution_date, portfolio, symbol", "target_weight", "FROM built JOIN after USING (portfolio) WHERE target_weight > 0"),
)(weight_schedule)
query(
    "signal_date",
    f"WITH {BARS}, {MEMBERS}, t AS (SELECT DISTINCT strategy_id, date FROM bars JOIN members USING (symbol)) SELECT strategy_id, date, lag(date) OVER (PARTITION BY strategy_id ORDER BY date) AS signal_date FROM t",
)(lambda s, d: (lambda t: pit.signal_date_by(t, t, "strategy_id"))(bars(s, d).join(strategy_members(bars(s, d)), "symbol").select("strategy_id", "date").distinct()))
