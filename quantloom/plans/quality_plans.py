"""Queries on data quality, normalisation and coverage."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.windows import sma
from ..operators import quality as q
from ..sources import normalize as no
from ..sources import provider as pv
from ..sources.shared import new_folder
from .adapters import BARS, MACRO, MEMBERS, SIGNAL_DATES, WEEKLY, bars, macro, signal_dates, strategy_members, table, weekly
from .portfolio_plans import GRID, schedule
from .registry import query, select

K = "CAST(regexp_extract(symbol, '[0-9]+') AS INTEGER)"


def brand(c: str = "symbol"):
    return F.regexp_extract(c, "[0-9]+", 0).cast("int")


def flawed(spark, sf_dir):
    """Bars with a flaw by brand number: 1 negative volume, 2 close of 0 in January, 3 high below low, 4 no volume."""
    k, jan = brand(), F.month("date") == 1
    return bars(spark, sf_dir).withColumns({"volume": F.when(k == 1, -F.col("volume")).when(k == 4, None).otherwise(F.col("volume")), "close": F.when((k == 2) & jan, 0.0).otherwise(F.col("close")), "high": F.when((k == 3) & jan, F.col("low") - 1).otherwise(F.col("high"))})


FLAWED = f"{BARS}, flawed AS MATERIALIZED (SELECT * REPLACE (CASE WHEN {K} = 1 THEN -volume WHEN {K} = 4 THEN NULL ELSE volume END AS volume, CASE WHEN {K} = 2 AND month(date) = 1 THEN 0 ELSE close END AS close, CASE WHEN {K} = 3 AND month(date) = 1 THEN low - 1 ELSE high END AS high) FROM bars)"
DAYS = lambda a, b: f"(SELECT count(*) FROM range({a}::TIMESTAMP, {b}::TIMESTAMP, INTERVAL 1 DAY) t(x) WHERE isodow(x) <= 5)"
query(
    "dq_prices",
    f"""WITH {FLAWED}, cal AS MATERIALIZED (SELECT CAST(x AS DATE) AS day, sum(CASE WHEN isodow(x) <= 5 THEN 1 ELSE 0 END) OVER (ORDER BY x) - CASE WHEN isodow(x) <= 5 THEN 1 ELSE 0 END AS before FROM range(TIMESTAMP '1990-01-01', TIMESTAMP '2010-01-01', INTERVAL 1 DAY) t(x)),
 g0 AS (SELECT f.*, lag(date) OVER (PARTITION BY symbol ORDER BY date) AS prior FROM flawed f), g1 AS (SELECT g0.*, b.before - a.before - 1 AS gap FROM g0 LEFT JOIN cal a ON a.day = prior LEFT JOIN cal b ON b.day = date),
 g AS (SELECT symbol, count(*) FILTER (high < greatest(open, low, close) OR low > least(open, high, close)) AS o, count(*) FILTER (close <= 0) AS c, count(*) FILTER (volume < 0) AS v, count(volume) AS n, max(gap) AS gap, min(date) AS first_date, max(date) AS last_date FROM g1 GROUP BY 1)
 SELECT symbol, o = 0 AND c = 0 AND v = 0 AS passed, concat_ws(',', CASE WHEN o > 0 THEN 'inconsistent_ohlc' END, CASE WHEN c > 0 THEN 'non_positive_close' END, CASE WHEN v > 0 THEN 'negative_volume' END) AS errors,
 concat_ws(',', CASE WHEN gap > 8 THEN 'date_gaps' END, CASE WHEN n = 0 THEN 'volume_missing' END) AS warnings, first_date, last_date FROM g""",
)(lambda s, d: q.prices(flawed(s, d)))
START, END = "1996-01-01", "1999-12-31"


def benchmark_rows(spark, sf_dir):
    """Daily closes as text from two sources, with flaws of the first by brand: 2 unread dates, 3 closes missing, 4 not finite, 5 negative, 6 twice, 7 half of the days, 8 no closes at all."""
    k = brand()
    b = bars(spark, sf_dir).where(F.col("date").between(START, END)).withColumn("k", k)
    first = F.dayofmonth("date") == 1
    close = F.when(first & (F.col("k") == 3), None).when(first & (F.col("k") == 4), "NaN").when(first & (F.col("k") == 5), "-1").when(F.col("k") != 8, F.col("close").cast("string"))
    day = F.when(first & (F.col("k") == 2), "never").otherwise(F.col("date").cast("string"))
    rows = b.select("symbol", F.lit("a").alias("source"), day.alias("date"), close.alias("close"), "k", F.col("date").alias("d"))
    rows = rows.where((F.col("k") != 7) | (F.dayofmonth("d") > 15))
    again = rows.where(first_of("k = 6", "d")).union(b.where("k > 1").select("symbol", F.lit("b"), F.col("date").cast("string"), F.col("close").cast("string"), "k", "date"))
    return rows.union(again).drop("k", "d")


def first_of(condition: str, day: str):
    return F.expr(f"{condition} AND dayofmonth({day}) = 2")


BROWS = f"""{BARS}, b0 AS (SELECT *, {K} AS k FROM bars WHERE date BETWEEN DATE '{START}' AND DATE '{END}'),
 b1 AS (SELECT symbol, 'a' AS source, CASE WHEN day(date) = 1 AND k = 2 THEN 'never' ELSE CAST(date AS VARCHAR) END AS date, CASE WHEN day(date) = 1 AND k = 3 THEN NULL WHEN day(date) = 1 AND k = 4 THEN 'NaN' WHEN day(date) = 1 AND k = 5 THEN '-1' WHEN k <> 8 THEN CAST(close AS VARCHAR) END AS close, k, date AS d FROM b0 WHERE k <> 7 OR day(date) > 15),
 brows AS MATERIALIZED (SELECT * FROM b1 UNION ALL SELECT * FROM b1 WHERE k = 6 AND day(d) = 2 UNION ALL SELECT symbol, 'b', CAST(date AS VARCHAR), CAST(close AS VARCHAR), k, date FROM b0 WHERE k > 1),
 bq0 AS (SELECT symbol, source, count(*) AS n, count(close) AS closes, count(*) FILTER (try_cast(date AS DATE) IS NULL) AS unread, count(*) FILTER (close IS NULL) AS missing, count(*) FILTER (NOT isfinite(try_cast(close AS DOUBLE))) AS infinite, count(*) FILTER (try_cast(close AS DOUBLE) <= 0) AS negative,
 count(*) - count(DISTINCT date) AS twice, min(try_cast(date AS DATE)) AS first_date, max(try_cast(date AS DATE)) AS last_date, {DAYS(f"DATE '{START}'", f"(DATE '{END}' + 1)")} AS days FROM brows GROUP BY 1, 2),
 cal AS MATERIALIZED (SELECT CAST(x AS DATE) AS day FROM range(TIMESTAMP '{START}', TIMESTAMP '2000-01-01', INTERVAL 1 DAY) t(x) WHERE isodow(x) <= 5),
 bq1 AS (SELECT bq0.*, (SELECT count(*) FROM cal WHERE day < first_date) AS head, (SELECT count(*) FROM cal WHERE day > last_date) AS tail, greatest(2, ceil(days * 0.8)) AS least FROM bq0),
 bq AS MATERIALIZED (SELECT symbol, source, n, first_date, last_date, least(n / days, 1.0::DOUBLE) AS coverage_ratio, CASE WHEN closes = 0 THEN 'invalid_schema' WHEN unread > 0 THEN 'invalid_dates' WHEN missing > 0 THEN 'missing_close' WHEN infinite > 0 THEN 'non_finite_close' WHEN negative > 0 THEN 'non_positive_close'
 WHEN twice > 0 THEN 'duplicate_dates' WHEN n < least THEN 'insufficient_coverage' WHEN greatest(head, tail) > least(5, greatest(days - least - 1, 0)) THEN 'insufficient_coverage' ELSE 'success' END AS reason FROM bq1)"""
#: Every brand is asked of three sources; the third answers nothing, the second nothing for brand 1.
_ASKED = "FROM (SELECT DISTINCT symbol FROM bars) CROSS JOIN (VALUES ('a'), ('b'), ('c')) v(source) LEFT JOIN bq USING (symbol, source)"


def asked(spark, sf_dir):
    return bars(spark, sf_dir).select("symbol").distinct().select("symbol", F.explode(F.array(*map(F.lit, "abc"))).alias("source"))


query("dq_benchmark", f"WITH {BROWS} " + select("symbol, source, coalesce(n, 0) AS n, first_date, last_date, coalesce(reason, 'empty_response') AS reason", "coalesce(coverage_ratio, 0) AS coverage_ratio", _ASKED))(
    lambda s, d: q.benchmarks(benchmark_rows(s, d), START, END, requested=asked(s, d))
)


def chosen(spark, sf_dir):
    priority = spark.createDataFrame([("a", 1), ("b", 2)], "source string, priority int")
    rows = benchmark_rows(spark, sf_dir)
    return no.select_source(q.benchmarks(rows, START, END, 0.5), priority, rows)[1].select("symbol", "source", "reason", "chosen", "attempt")


query("source_priority_select", f"WITH {BROWS.replace('0.8)', '0.5)')} SELECT symbol, source, reason, reason = 'success' AND row_number() OVER (PARTITION BY symbol, reason = 'success' ORDER BY source) = 1 AS chosen, CAST(row_number() OVER (PARTITION BY symbol ORDER BY source) AS INTEGER) AS attempt FROM bq")(chosen)
query("dq_price_window", f"WITH {BARS} SELECT symbol, min(date) AS first_date, max(date) AS last_date, count(*) AS n, min(date) - DATE '{START}' <= 14 AS covers_start, DATE '{END}' - max(date) <= 14 AS covers_end FROM bars WHERE date BETWEEN DATE '{START}' AND DATE '{END}' GROUP BY 1")(lambda s, d: q.window(bars(s, d), START, END))
query("dq_price_state", f"WITH {FLAWED} SELECT symbol, count(*) FILTER (close IS NULL) AS missing_close, count(*) FILTER (volume <= 0) AS zero_volume FROM flawed GROUP BY 1")(lambda s, d: q.state(flawed(s, d)))


def orders(spark, sf_dir):
    b = flawed(spark, sf_dir)
    return b.select("symbol").distinct().crossJoin(signal_dates(spark, sf_dir))


query("dq_tradability", f"WITH {FLAWED}, {SIGNAL_DATES} SELECT s.symbol, d.date, CASE WHEN f.symbol IS NULL THEN 'no_bar' WHEN volume IS NULL THEN 'volume_missing' WHEN volume <= 0 THEN 'zero_volume' END AS reason FROM (SELECT DISTINCT symbol FROM bars) s CROSS JOIN signal_dates d LEFT JOIN flawed f ON f.symbol = s.symbol AND f.date = d.date")(
    lambda s, d: q.tradability(orders(s, d), flawed(s, d))
)
query("aligned_dates", f"WITH {WEEKLY}, {MEMBERS} SELECT strategy_id, date FROM members JOIN bars_w USING (symbol) GROUP BY 1, 2 HAVING count(*) = 5")(lambda s, d: q.aligned_dates(weekly(s, d), strategy_members(bars(s, d))))
query(
    "price_alignment_summary",
    f"""WITH {BARS}, {MEMBERS}, g0 AS (SELECT strategy_id, symbol, date, close FROM members JOIN bars USING (symbol)),
 g1 AS (SELECT m.strategy_id, m.symbol, t.date, g0.close FROM (SELECT DISTINCT strategy_id, date FROM g0) t JOIN members m USING (strategy_id) LEFT JOIN g0 ON g0.strategy_id = m.strategy_id AND g0.symbol = m.symbol AND g0.date = t.date),
 g2 AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY strategy_id, symbol ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS f FROM g1)
 SELECT strategy_id, count(*) FILTER (close IS NULL AND f IS NOT NULL) AS filled, count(*) FILTER (f IS NULL) AS unresolved, count(DISTINCT date) - count(DISTINCT CASE WHEN close IS NULL THEN date END) AS common_dates FROM g2 GROUP BY 1""",
)(lambda s, d: q.alignment(bars(s, d), strategy_members(bars(s, d))))

# Macro observations: raw text rows with flaws by month

LONG = f"{MACRO}, long AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT '{c}' AS indicator, date AS observation_date, available_date, {c} AS value, 'macro' AS source FROM macro WHERE {c} IS NOT NULL" for c in q.INDICATORS) + ")"
query("macro_unpivot", f"WITH {LONG} " + select("indicator, observation_date, available_date, source", "value", "FROM long"))(lambda s, d: q.macro_long(macro(s, d)).select("indicator", "observation_date", "available_date", "source", "value"))


def raw_observations(spark, sf_dir):
    m, i = F.month("observation_date"), F.col("indicator")
    df = q.macro_long(macro(spark, sf_dir))
    return df.select(
        F.when((m == 1) & (i == "pmi"), None).when((m == 1) & (i == "ppi_yoy"), "gdp").otherwise(i).alias("indicator"),
        F.when((m == 2) & (i == "pmi"), None).when((m == 2) & (i == "ppi_yoy"), F.lit("soon")).otherwise(F.col("observation_date").cast("string")).alias("observation_date"),
        F.when((m == 3) & (i == "m2_yoy"), None).when((m == 4) & (i == "m2_yoy"), F.lit("1999/01/01")).when((m == 5) & (i == "m2_yoy"), F.lit("1980-01-01")).otherwise(F.col("available_date").cast("string")).alias("available_date"),
        F.when((m == 6) & (i == "m2_yoy"), F.lit("NaN")).when((m == 7) & (i == "m2_yoy"), F.lit("high")).otherwise(F.round("value", 4).cast("string")).alias("value"),
        F.when((m == 8) & (i == "m2_yoy"), F.lit("a b")).otherwise(F.col("source")).alias("source"),
        F.when(m % 2 == 0, F.when((m == 10) & (i == "m2_yoy"), F.lit("  ")).otherwise(F.concat(F.lit("r"), m.cast("string")))).alias("revision"),
        F.lit("percent").alias("unit"),
    )


_R = lambda cond, then: f"WHEN {cond} THEN {then}"
RAW = f"""{LONG}, raw AS MATERIALIZED (SELECT CASE WHEN m = 1 AND indicator = 'pmi' THEN NULL WHEN m = 1 AND indicator = 'ppi_yoy' THEN 'gdp' ELSE indicator END AS indicator,
 CASE WHEN m = 2 AND indicator = 'pmi' THEN NULL WHEN m = 2 AND indicator = 'ppi_yoy' THEN 'soon' ELSE CAST(observation_date AS VARCHAR) END AS observation_date,
 CASE WHEN m = 3 AND indicator = 'm2_yoy' THEN NULL WHEN m = 4 AND indicator = 'm2_yoy' THEN '1999/01/01' WHEN m = 5 AND indicator = 'm2_yoy' THEN '1980-01-01' ELSE CAST(available_date AS VARCHAR) END AS available_date,
 CASE WHEN m = 6 AND indicator = 'm2_yoy' THEN 'NaN' WHEN m = 7 AND indicator = 'm2_yoy' THEN 'high' ELSE 'x' END AS value, CASE WHEN m = 8 AND indicator = 'm2_yoy' THEN 'a b' ELSE source END AS source, CASE WHEN m = 10 AND indicator = 'm2_yoy' THEN '  ' WHEN m % 2 = 0 THEN 'r' || m END AS revision FROM (SELECT *, month(observation_date) AS m FROM long)),
 judged AS (SELECT indicator, observation_date, available_date, CASE WHEN indicator IS NULL THEN 'missing_indicator' WHEN indicator NOT IN ({', '.join(f"'{c}'" for c in q.INDICATORS)}) THEN 'invalid_schema' WHEN observation_date IS NULL THEN 'missing_observation_date'
 WHEN NOT regexp_matches(observation_date, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN 'invalid_observation_date' WHEN available_date IS NULL THEN 'missing_available_date' WHEN NOT regexp_matches(available_date, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN 'invalid_available_date'
 WHEN available_date < observation_date THEN 'available_before_observation' WHEN value IN ('NaN', 'high') THEN 'non_finite_value' WHEN source = 'a b' OR trim(revision) = '' THEN 'invalid_schema' END AS reason FROM raw)"""
query("macro_obs_reason", f"WITH {RAW} SELECT * FROM judged")(lambda s, d: q.macro_reason(raw_observations(s, d)).select("indicator", "observation_date", "available_date", "reason"))


def versions(spark, sf_dir):
    """Observations with revisions: pmi exactly twice, cpi with two revisions, ppi twice with one revision, the rest once; ordinals by date, downwards for m2."""
    df = q.macro_long(macro(spark, sf_dir)).withColumns({"value": F.round("value", 4), "revision_type": F.lit("int"), "revision": F.lit("1")})
    days = F.datediff("observation_date", F.lit("1990-01-01"))
    df = df.withColumn("ordinal", F.when(F.col("indicator") == "m2_yoy", -days).otherwise(days))
    pmi = df.where("indicator = 'pmi'").withColumn("ordinal", F.col("ordinal") + 100_000)
    cpi = df.where("indicator = 'cpi_yoy'").withColumns({"revision": F.lit("2"), "ordinal": F.col("ordinal") + 100_000})
    ppi = df.where("indicator = 'ppi_yoy'").withColumns({"value": F.col("value") + 1, "ordinal": F.col("ordinal") + 100_000})
    return df.unionByName(pmi).unionByName(cpi).unionByName(ppi)


VERS = f"""{LONG}, v0 AS (SELECT indicator, observation_date, available_date, source, '1' AS revision, (observation_date - DATE '1990-01-01') * CASE WHEN indicator = 'm2_yoy' THEN -1 ELSE 1 END AS ordinal, 0 AS copy FROM long),
 versions AS MATERIALIZED (SELECT * FROM v0 UNION ALL SELECT * REPLACE (CASE WHEN indicator = 'cpi_yoy' THEN '2' ELSE revision END AS revision, ordinal + 100000 AS ordinal, 1 AS copy) FROM v0 WHERE indicator IN ('pmi', 'cpi_yoy', 'ppi_yoy')),
 deduped AS MATERIALIZED (SELECT *, CASE WHEN indicator = 'pmi' AND copy = 1 THEN 'duplicate_version' WHEN indicator = 'ppi_yoy' THEN 'duplicate_observation' END AS reason FROM versions)"""
query("macro_obs_dedupe", f"WITH {VERS} SELECT indicator, observation_date, CAST(ordinal AS INTEGER) AS ordinal, revision, reason FROM deduped")(lambda s, d: q.macro_dedupe(versions(s, d)).select("indicator", "observation_date", "ordinal", "revision", "reason"))
query("macro_obs_summary", f"WITH {VERS} " + select("count(*) AS raw, count(*) FILTER (reason IS NULL) AS valid, count(reason) AS rejected, 'partial' AS status, true AS unsorted_dates", "count(*) FILTER (reason IS NULL) / count(*) AS coverage_ratio", "FROM deduped"))(lambda s, d: q.macro_summary(q.macro_dedupe(versions(s, d))))
query(
    "macro_indicator_diag",
    f"""WITH {VERS} SELECT indicator, count(*) AS raw_rows, count(*) FILTER (reason IS NULL) AS valid_rows, count(DISTINCT CASE WHEN reason IS NULL THEN observation_date || revision END) AS versions, min(CASE WHEN reason IS NULL THEN observation_date END) AS first_observation,
 max(CASE WHEN reason IS NULL THEN observation_date END) AS last_observation, min(CASE WHEN reason IS NULL THEN available_date END) AS first_available, max(CASE WHEN reason IS NULL THEN available_date END) AS last_available FROM deduped GROUP BY 1""",
)(lambda s, d: q.macro_indicators(q.macro_dedupe(versions(s, d))))
query(
    "macro_pit_summary",
    f"""WITH {BARS}, {LONG}, {SIGNAL_DATES}, p AS (SELECT d.date, count(DISTINCT CASE WHEN observation_date <= d.date AND available_date <= d.date THEN indicator END) AS have, max(observation_date > d.date) AS future, max(observation_date <= d.date AND available_date > d.date) AS unpublished FROM signal_dates d CROSS JOIN long GROUP BY 1)
 SELECT count(*) AS signal_dates, count(*) FILTER (have = 9) AS fully_available, count(*) FILTER (have > 0 AND have < 9) AS partially_available, count(*) FILTER (have = 0) AS unavailable, count(*) FILTER (future) AS future_observation, count(*) FILTER (unpublished) AS future_available_date FROM p""",
)(lambda s, d: q.macro_pit(q.macro_long(macro(s, d)), signal_dates(s, d).select(F.col("date").alias("signal_date"))))

# Valuations


def valuations(spark, sf_dir):
    """A record per supplier and order month as text, with flaws by number."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey")
    k = F.col("s_suppkey")
    return s.select(
        F.when(k % 17 == 0, F.lit("12")).otherwise(F.lpad((600000 + k % 40).cast("string"), 6, "0")).alias("symbol"),
        F.when(k % 19 == 0, F.lit("beta")).otherwise(F.element_at(F.array(*[F.lit(m) for m in q.METRICS]), (k % 5 + 1).cast("int"))).alias("metric"),
        F.date_add(F.lit("2020-01-01").cast("date"), (k % 700).cast("int")).cast("string").alias("observation_date"),
        F.when(k % 23 == 0, None).otherwise(F.date_add(F.lit("2020-01-01").cast("date"), (k % 700 + k % 90 - 2).cast("int")).cast("string")).alias("available_date"),
        F.when(k % 29 == 0, F.lit("none")).otherwise(F.col("s_acctbal").cast("string")).alias("value"),
        F.when(k % 31 == 0, F.lit("?")).otherwise(F.lit("feed")).alias("source"),
        F.lit("ratio").alias("unit"),
        k.alias("id"),
    )


VAL = f"""val AS MATERIALIZED (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 17 = 0 THEN '12' ELSE CAST(600000 + s_suppkey % 40 AS VARCHAR) END AS symbol, CASE WHEN s_suppkey % 19 = 0 THEN 'beta' ELSE list_extract(['{"', '".join(q.METRICS)}'], s_suppkey % 5 + 1) END AS metric,
 DATE '2020-01-01' + CAST(s_suppkey % 700 AS INTEGER) AS o, CASE WHEN s_suppkey % 23 = 0 THEN NULL ELSE DATE '2020-01-01' + CAST(s_suppkey % 700 + s_suppkey % 90 - 2 AS INTEGER) END AS a, s_suppkey % 29 = 0 AS unread, s_suppkey % 31 = 0 AS odd FROM supplier),
 vj AS MATERIALIZED (SELECT *, CASE WHEN symbol = '12' OR metric = 'beta' THEN 'invalid_schema' WHEN a IS NULL THEN 'missing_available_date' WHEN a < o THEN 'invalid_schema' WHEN unread THEN 'non_finite_value' WHEN odd THEN 'invalid_schema' END AS reason FROM val)"""
query("valuation_validate", f"WITH {VAL} SELECT id, symbol, metric, reason FROM vj")(lambda s, d: q.valuation_reason(valuations(s, d)).select("id", "symbol", "metric", "reason"))


def availability(spark, sf_dir):
    ok = q.valuation_reason(valuations(spark, sf_dir)).where("reason is null").withColumn("available_date", F.col("available_date").cast("date"))
    requested = ok.select("symbol").distinct().crossJoin(spark.createDataFrame([(m,) for m in q.METRICS[:3]], "metric string"))
    cutoffs = spark.createDataFrame([("2020-03-01",), ("2021-06-30",)], "as_of string").select(F.col("as_of").cast("date").alias("as_of"))
    return q.valuation_availability(ok, requested, cutoffs)


query(
    "valuation_availability",
    f"""WITH {VAL}, ok AS (SELECT symbol, metric, a FROM vj WHERE reason IS NULL), asked AS (SELECT symbol, m.metric, c.as_of FROM (SELECT DISTINCT symbol FROM ok) CROSS JOIN (VALUES ('pe_ttm'), ('pb'), ('ps_ttm')) m(metric) CROSS JOIN (VALUES (DATE '2020-03-01'), (DATE '2021-06-30')) c(as_of)),
 j AS (SELECT k.symbol, k.as_of, k.metric, count(*) FILTER (a <= as_of) AS acc, count(*) FILTER (a > as_of) AS rej FROM asked k LEFT JOIN ok ON ok.symbol = k.symbol AND ok.metric = k.metric GROUP BY 1, 2, 3),
 g AS (SELECT symbol, as_of, count(*) FILTER (acc > 0) AS have, sum(acc)::BIGINT AS accepted, sum(rej)::BIGINT AS rejected, coalesce(string_agg(CASE WHEN acc > 0 THEN metric END, ',' ORDER BY metric), '') AS available_metrics, coalesce(string_agg(CASE WHEN acc = 0 THEN metric END, ',' ORDER BY metric), '') AS missing_metrics FROM j GROUP BY 1, 2) """
    + select("symbol, as_of, CASE have WHEN 3 THEN 'available' WHEN 0 THEN 'unavailable' ELSE 'partial' END AS status, CASE WHEN have = 3 THEN 'success' WHEN rejected > 0 THEN 'future_available_date' WHEN have > 0 THEN 'historical_valuation_unavailable' ELSE 'empty_response' END AS reason, available_metrics, missing_metrics, accepted, rejected", "have / 3.0::DOUBLE AS coverage_ratio", "FROM g"),
)(availability)

# Sources and identifiers


def raw_bars(spark, sf_dir):
    """Bars under source names, with text that cannot be read and without some columns."""
    b = bars(spark, sf_dir)
    return b.select("symbol", F.col("date").cast("string").alias("日期"), F.col("open").cast("string").alias("Open"), F.when(F.dayofmonth("date") == 3, F.lit("--")).otherwise(F.col("close").cast("string")).alias("收盘"), F.col("volume").alias("成交量"), F.lit(1).alias("unknown"))


query("bars_normalize", f"WITH {BARS} " + select("symbol, date, NULL::DOUBLE AS high", "open; CASE WHEN day(date) <> 3 THEN close END AS close; volume", "FROM bars"))(lambda s, d: no.normalize_bars(raw_bars(s, d)).select("symbol", "date", "high", "open", "close", "volume"))
query("bars_rollup", f"WITH {BARS} " + select("symbol, CAST(date_trunc('month', date) AS DATE) AS period", "arg_min(open, date) AS open; max(high) AS high; min(low) AS low; arg_max(close, date) AS close; sum(volume) AS volume", "FROM bars GROUP BY symbol, date_trunc('month', date)"))(lambda s, d: no.rollup(bars(s, d), "month"))
_END = "1998-06-30"
_LOOK = {"1mo": 30, "6mo": 180, "2y": 730, "unknown": 365}


def periods(spark, sf_dir):
    out = None
    for name in (*_LOOK, "ytd"):
        rows = no.period_filter(bars(spark, sf_dir), name, _END).groupBy("symbol").agg(F.count("*").alias("n"), F.min("date").alias("first_date")).withColumn("period", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


query("bars_period_filter", f"WITH {BARS} " + " UNION ALL ".join(f"SELECT symbol, count(*) AS n, min(date) AS first_date, '{k}' AS period FROM bars WHERE date BETWEEN {f'DATE {chr(39)}{_END}{chr(39)} - {n}' if n else 'DATE ' + chr(39) + '1998-01-01' + chr(39)} AND DATE '{_END}' GROUP BY 1" for k, n in {**_LOOK, "ytd": 0}.items()))(periods)


def codes(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit(" "), F.lpad((k * 7919 % 1000000).cast("string"), 6, "0"), F.element_at(F.array(F.lit(".sh"), F.lit(".SZ"), F.lit(""), F.lit(".bj ")), (k % 4 + 1).cast("int"))).alias("raw"))


_CODE = "lpad(CAST(c_custkey * 7919 % 1000000 AS VARCHAR), 6, '0')"
query("symbol_normalize", f"SELECT c_custkey, {_CODE} AS symbol, CASE WHEN {_CODE} LIKE '4%' OR {_CODE} LIKE '8%' OR {_CODE} LIKE '92%' THEN 'BJ' WHEN {_CODE} LIKE '5%' OR {_CODE} LIKE '6%' OR {_CODE} LIKE '9%' THEN 'SH' ELSE 'SZ' END AS exchange FROM customer")(
    lambda s, d: codes(s, d).select("c_custkey", no.normalize_symbol(F.col("raw")).alias("symbol"), no.exchange(F.col("raw")).alias("exchange"))
)
_NAMES = ("沪深300", "sh000905", " 399001.SZ ", "创业板指", "SPX", "000852")
query("index_symbol_canonical", "SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN '000300' WHEN 1 THEN '000905' WHEN 2 THEN '399001' WHEN 3 THEN '399006' WHEN 5 THEN '000852' END AS canonical, CASE WHEN c_custkey % 6 = 4 THEN 'unsupported_symbol' END AS reason FROM customer")(
    lambda s, d: no.canonical_index(table(s, d, "customer").select("c_custkey", F.element_at(F.array(*[F.lit(x) for x in _NAMES]), (F.col("c_custkey") % 6 + 1).cast("int")).alias("symbol"))).select("c_custkey", "canonical", "reason")
)
query("asset_class", "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'crypto' WHEN 3 THEN 'crypto' ELSE 'stock' END AS asset_class FROM customer")(
    lambda s, d: table(s, d, "customer").select("c_custkey", no.asset_class(F.element_at(F.array(*[F.lit(x) for x in ("BTCUSDT", "AAPL", "600519.SS", "solbtc", "BTC")]), (F.col("c_custkey") % 5 + 1).cast("int"))).alias("asset_class"))
)
query("macro_latest", f"WITH {MACRO} " + select("date", "pmi; ppi_yoy; policy_score", "FROM macro ORDER BY date DESC LIMIT 1"))(lambda s, d: no.latest(macro(s, d)).select("date", "pmi", "ppi_yoy", "policy_score"))
query("price_frame_prepare", f"WITH {BARS} " + select("symbol, date", "close", f"FROM bars WHERE date BETWEEN DATE '{START}' AND DATE '{END}' AND {K} <> 2 UNION ALL " + select("symbol, date", "close + 1 AS close", f"FROM bars WHERE date BETWEEN DATE '{START}' AND DATE '{END}' AND {K} = 2")))(
    lambda s, d: (lambda b: no.prepare_prices(b.withColumn("ordinal", F.lit(1)).unionByName(b.where(brand() == 2).withColumns({"ordinal": F.lit(2), "close": F.col("close") + 1})), START, END).select("symbol", "date", "close"))(bars(s, d))
)


# Tables written and read back


def macro_file(spark, sf_dir):
    """The macro table as CSV, with a comment line in each file, scanned."""
    path = new_folder(spark, "macro")
    fields = ["date", "available_date", *no.MACRO_FIELDS, "source"]
    m = macro(spark, sf_dir).withColumn("source", F.lit("orders"))
    line = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields])
    text = m.select(F.explode(F.array(F.lit("# a comment"), line)).alias("value"))
    text.write.text(path)
    return no.scan_macro_csv(spark, path, header=False)


query("macro_csv_scan", f"WITH {MACRO} " + select("date, available_date, 'orders' AS source", "; ".join(no.MACRO_FIELDS), "FROM macro"))(macro_file)


def stored(spark, sf_dir):
    path = new_folder(spark, "bars")
    no.write_bars(bars(spark, sf_dir), path, "qfq", 16)
    return path


_BARS = "open; high; low; close; volume; amount"
query("bars_sink", f"WITH {BARS} " + select("symbol, date", _BARS, "FROM bars"))(lambda s, d: no.scan_bars(s, stored(s, d), "qfq", buckets=16))
query("bars_scan", f"WITH {BARS} " + select("symbol, date", _BARS, "FROM bars WHERE symbol IN ('Brand#4', 'Brand#17')"))(lambda s, d: no.scan_bars(s, stored(s, d), "qfq", ["Brand#4", "Brand#17"], 16))


def provided(spark, sf_dir):
    """Bars of some symbols and years from a provider that reads a vendor's folder of files, here written from the bars."""
    path = new_folder(spark, "vendor")
    bars(spark, sf_dir).withColumn("volume", F.col("volume").cast("double")).repartition("symbol").write.partitionBy("symbol").parquet(path)
    vendor = pv.read_provider(spark, lambda: pv.FolderProvider(path), 4, push_filters=True)
    return vendor.where(F.col("symbol").isin("Brand#4", "Brand#17", "Brand#21") & (F.col("date") >= F.lit("1996-01-01").cast("date")) & (F.col("date") < F.lit("1998-01-01").cast("date"))).select("symbol", "date", "open", "high", "low", "close")


query("bars_provider", f"WITH {BARS} " + select("symbol, date", "open; high; low; close", "FROM bars WHERE symbol IN ('Brand#4', 'Brand#17', 'Brand#21') AND date >= DATE '1996-01-01' AND date < DATE '1998-01-01'"))(provided)


def from_table(spark, sf_dir):
    """A mean over 20 rows of each symbol of one market, from a bucketed table of all."""
    name = f"bars_{uuid.uuid4().hex}"
    market = lambda c: F.concat(F.lit("market_"), F.floor((brand(c) - 1) / 5).cast("string")).alias("market")
    no.save_bars(bars(spark, sf_dir).select("*", market("symbol")), name, new_folder(spark, name))
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("symbol"), market("p_brand")).distinct()
    return no.of_universe(spark, name, brands.where(brand().between(6, 10))).select("symbol", "date", sma("close", 20).alias("ma20"))


query("bars_table", f"WITH {BARS} " + select("symbol, date", "CASE WHEN count(*) OVER w = 20 THEN avg(close) OVER w END AS ma20", "FROM bars WHERE CAST(regexp_extract(symbol, '[0-9]+') AS INTEGER) BETWEEN 6 AND 10 WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"))(from_table)


def stored_runs(spark, sf_dir):
    """Two runs of two tables each, read back; a run that is there is refused."""
    path, b = new_folder(spark, "runs"), bars(spark, sf_dir).select("symbol", "date", "close")
    for run in ("r1", "r2"):
        no.write_run({"bars": b, "last": b.groupBy("symbol").agg(F.max("date").alias("date"))}, path, run)
    try:
        no.write_run({"bars": b}, path, "r2")
    except FileExistsError:
        refused = True
    else:
        refused = False
    rows = spark.read.parquet(f"{path}/bars").groupBy("run_id", "symbol").agg(F.count("*").alias("n"), F.sum("close").alias("total"))
    return rows.join(spark.read.parquet(f"{path}/last"), ["run_id", "symbol"]).withColumn("refused", F.lit(refused))


query("run_tables_sink", f"WITH {BARS} " + select("run_id, symbol, n, date, true AS refused", "total", "FROM (SELECT symbol, count(*) AS n, sum(close) AS total, max(date) AS date FROM bars GROUP BY 1) CROSS JOIN (VALUES ('r1'), ('r2')) r(run_id)"))(stored_runs)


def bench_cover(spark, sf_dir):
    """Every brand is asked for; brands with a number of 2 modulo 5 have no metrics."""
    b = bars(spark, sf_dir).select("symbol").distinct()
    return q.benchmark_coverage(b, b.where(brand() % 5 != 2))


query(
    "benchmark_coverage",
    f"""WITH b AS (SELECT DISTINCT p_brand AS symbol FROM lineitem JOIN part ON l_partkey = p_partkey), c AS (SELECT symbol, {K} % 5 <> 2 AS has FROM b)
 SELECT CASE WHEN count(*) FILTER (has) = 0 THEN 'unavailable' WHEN count(*) FILTER (has) < count(*) THEN 'partial' ELSE 'available' END AS status, coalesce(string_agg(symbol, ',' ORDER BY symbol) FILTER (has), '') AS available,
 coalesce(string_agg(symbol, ',' ORDER BY symbol) FILTER (NOT has), '') AS unavailable FROM c""",
)(bench_cover)


def run_tables(spark, sf_dir):
    """Coverage of five runs, one a strategy: run 1 lacks prices, 2 fundamentals, 3 a benchmark, 4 everything."""
    m = strategy_members(bars(spark, sf_dir)).withColumnRenamed("strategy_id", "run_id")
    k = brand()
    prices = m.where((F.col("run_id") != 4) & ~((F.col("run_id") == 1) & (k % 5 == 0)))
    fundamentals = prices.where(~((F.col("run_id") == 2) & (k % 5 < 2)))
    holdings = schedule(spark, sf_dir).withColumnRenamed("strategy_id", "run_id").where("run_id <> 4")
    runs = m.select("run_id").distinct()
    benchmark = runs.withColumn("status", F.when(F.col("run_id") == 3, "partial").otherwise("available"))
    macro_rows = runs.where("run_id <> 3").crossJoin(macro(spark, sf_dir).select("date"))
    factor = runs.withColumn("coverage_ratio", 0.71 + F.col("run_id") / 10)
    return q.run_coverage(m, prices, fundamentals, holdings, benchmark, macro_rows, factor)


COVERAGE = f"""{MACRO}, {GRID}, c0 AS (SELECT strategy_id AS run_id, symbol, strategy_id <> 4 AND NOT (strategy_id = 1 AND {K} % 5 = 0) AS has FROM members),
 c1 AS (SELECT *, has AND NOT (run_id = 2 AND {K} % 5 < 2) AS funded FROM c0), c2 AS (SELECT strategy_id AS run_id, date FROM (SELECT strategy_id, min(date) AS date FROM grid WHERE strategy_id <> 4 GROUP BY strategy_id, date_trunc('quarter', date))),
 c3 AS (SELECT run_id, count(*) AS rebalances, min(n) AS least FROM (SELECT run_id, date, count(*) AS n FROM c2 JOIN members ON strategy_id = run_id WHERE weight > 0 GROUP BY 1, 2) GROUP BY 1),
 cover AS MATERIALIZED (SELECT c1.run_id, count(*) AS requested, count(*) FILTER (has) AS successful_prices, coalesce(string_agg(symbol, ',' ORDER BY symbol) FILTER (NOT has), '') AS failed_prices, count(*) FILTER (has) / count(*) AS price_coverage_ratio,
 coalesce(string_agg(symbol, ',' ORDER BY symbol) FILTER (has AND NOT funded), '') AS failed_fundamentals, coalesce(any_value(rebalances), 0) AS rebalance_count, any_value(least) AS least_holdings, CASE WHEN c1.run_id = 3 THEN 'partial' ELSE 'available' END AS benchmark_status,
 CASE WHEN c1.run_id = 3 THEN 0 ELSE (SELECT count(*) FROM macro) END AS macro_observations, 0.71::DOUBLE + c1.run_id / 10 AS least_factor_coverage FROM c1 LEFT JOIN c3 USING (run_id) GROUP BY c1.run_id),
 runs AS MATERIALIZED (SELECT *, CASE WHEN successful_prices = 0 OR rebalance_count = 0 THEN 'failed' WHEN reasons <> '' THEN 'partial_success' ELSE 'success' END AS status FROM (SELECT *, concat_ws(',', CASE WHEN failed_prices <> '' THEN 'candidate_prices_unavailable' END,
 CASE WHEN benchmark_status <> 'available' THEN 'benchmarks_unavailable' END, CASE WHEN macro_observations = 0 THEN 'macro_neutral' END, CASE WHEN least_holdings < 3 THEN 'below_min_holdings' END, CASE WHEN least_factor_coverage < 0.8 THEN 'insufficient_factor_coverage' END) AS reasons FROM cover))"""
query("run_coverage_summary", f"WITH {COVERAGE} " + select("run_id, requested, successful_prices, failed_prices, failed_fundamentals, rebalance_count, least_holdings, benchmark_status, macro_observations", "price_coverage_ratio; least_factor_coverage", "FROM cover"))(run_tables)
query("run_status", f"WITH {COVERAGE} SELECT run_id, status, CASE WHEN status = 'failed' THEN 'no_price_or_rebalance_coverage' ELSE reasons END AS reasons FROM runs")(lambda s, d: q.run_status(run_tables(s, d), 3))
