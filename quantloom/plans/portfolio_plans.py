"""Queries on strategies, metrics, rebalancing and portfolio construction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as m
from ..operators import portfolio as pf
from ..operators import strategies as st
from .adapters import BARS, EQUITY, MEMBERS, WEEKLY, bars, equity, shared, strategy_members, weekly
from .indicator_plans import full, lag
from .registry import query, select

SYMBOL = "PARTITION BY symbol ORDER BY date"
SO_FAR = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"

ROWS = f"""r0 AS MATERIALIZED (SELECT *, row_number() OVER ({SYMBOL}) AS rn, count(*) OVER (PARTITION BY symbol) AS n, {lag('close')} AS c1, {full('avg', 'close', 10)} AS a10, {full('avg', 'close', 20)} AS a20,
 {full('avg', 'close', 30)} AS a30, {full('avg', 'close', 60)} AS a60 FROM bars),
 r1 AS MATERIALIZED (SELECT *, coalesce(greatest(close - c1, 0), 0) AS gain, coalesce(greatest(c1 - close, 0), 0) AS loss FROM r0),
 r2 AS MATERIALIZED (SELECT *, 100 - 100 / (1 + {full('avg', 'gain', 14)} / ({full('avg', 'loss', 14)} + 1e-10)) AS rsi, {lag('a10')} AS b10, {lag('a30')} AS b30 FROM r1)"""


def from_side(side: str) -> str:
    return f"""{ROWS}, s0 AS (SELECT *, {side} AS side FROM r2),
 s1 AS (SELECT *, last_value(side IGNORE NULLS) OVER ({SYMBOL} {BEFORE}) AS prior, last_value(side IGNORE NULLS) OVER ({SYMBOL} {SO_FAR}) AS now FROM s0),
 signals AS MATERIALIZED (SELECT symbol, date, close, CASE WHEN rn = n AND now = 1 THEN 'sell' WHEN side = 1 AND coalesce(prior, -1) <> 1 THEN 'buy' WHEN side = -1 AND prior = 1 THEN 'sell' ELSE 'hold' END AS signal FROM s1)"""


SIGNALS = {
    "buy_hold": f"{ROWS}, signals AS (SELECT symbol, date, close, CASE WHEN rn = n THEN 'sell' WHEN rn = 1 THEN 'buy' ELSE 'hold' END AS signal FROM r0)",
    "sma_cross": from_side("CASE WHEN rn > 60 AND a20 > a60 THEN 1 WHEN rn > 60 AND a20 < a60 THEN -1 END"),
    "rsi": from_side("CASE WHEN rn > 14 AND rsi < 30 THEN 1 WHEN rn > 14 AND rsi > 70 THEN -1 END"),
    "dual_ma": f"{ROWS}, signals AS (SELECT symbol, date, close, CASE WHEN rn <= 30 THEN 'hold' WHEN b10 <= b30 AND a10 > a30 THEN 'buy' WHEN b10 >= b30 AND a10 < a30 THEN 'sell' ELSE 'hold' END AS signal FROM r2)",
}
for _name, _sql in SIGNALS.items():
    query(f"strat_{_name}", f"WITH {BARS}, {_sql} SELECT symbol, date, signal FROM signals")(lambda s, d, k=_name: st.signals(bars(s, d), k).select("symbol", "date", "signal"))

TESTED = f"""e0 AS (SELECT *, coalesce(last_value(CASE WHEN signal <> 'hold' THEN signal END IGNORE NULLS) OVER ({SYMBOL} {BEFORE}), 'sell') AS prior0 FROM signals),
 e1 AS (SELECT *, CASE WHEN signal = 'buy' AND prior0 <> 'buy' THEN 'buy' WHEN signal = 'sell' AND prior0 = 'buy' THEN 'sell' END AS executed FROM e0),
 e2 AS (SELECT *, last_value(CASE WHEN executed = 'buy' THEN close END IGNORE NULLS) OVER ({SYMBOL} {SO_FAR}) AS entry, coalesce(last_value(executed IGNORE NULLS) OVER ({SYMBOL} {SO_FAR}) = 'buy', false) AS inside FROM e1),
 e3 AS (SELECT *, 100000 * exp(sum(CASE WHEN executed = 'sell' THEN ln(close * 0.999::DOUBLE / (entry * 1.001::DOUBLE)) ELSE 0 END) OVER ({SYMBOL} {SO_FAR})) AS cash FROM e2),
 e4 AS (SELECT *, CASE WHEN inside THEN cash * close / (entry * 1.001::DOUBLE) ELSE cash END AS equity FROM e3),
 e5 AS (SELECT *, CASE executed WHEN 'sell' THEN equity / (close * 0.999::DOUBLE) WHEN 'buy' THEN cash / (entry * 1.001::DOUBLE) END AS shares FROM e4),
 tested AS MATERIALIZED (SELECT *, CASE WHEN executed = 'sell' THEN equity - entry * shares END AS pnl, CASE WHEN executed = 'sell' THEN equity - entry * 1.001::DOUBLE * shares END AS pnl_net,
 CASE WHEN executed = 'sell' THEN (close / entry - 1) * 100 END AS return_pct, shares * close * 0.001::DOUBLE AS cost FROM e5)"""
CROSS = f"WITH {BARS}, {SIGNALS['sma_cross']}, {TESTED}"
query("bt_single", f"{CROSS} " + select("symbol, date, executed", "equity", "FROM tested"))(lambda s, d: st.backtest(st.sma_cross(bars(s, d))).select("symbol", "date", "executed", "equity"))
query("bt_single_trades", f"{CROSS} " + select("symbol, date, executed AS type", "close AS price; shares; cost; equity; pnl; pnl_net; return_pct", "FROM tested WHERE executed IS NOT NULL"))(lambda s, d: st.trades(st.backtest(st.sma_cross(bars(s, d)))))
query(
    "bt_single_metrics",
    f"""{CROSS}, t1 AS (SELECT *, max(equity) OVER ({SYMBOL} {SO_FAR}) AS peak, equity / {lag('equity')} - 1 AS r FROM tested),
 t2 AS (SELECT symbol, arg_max(equity, date) / 100000 - 1 AS total_return, count(*) AS n, max((peak - equity) / peak) AS max_drawdown, CASE WHEN stddev_pop(r) > 0 THEN avg(r) * 252 / (stddev_pop(r) * sqrt(252)) ELSE 0 END AS sharpe_ratio,
 count(*) FILTER (executed = 'sell') AS trade_count, count(*) FILTER (pnl > 0) AS wins, arg_max(equity, date) AS final_equity FROM t1 GROUP BY 1) """
    + select("symbol, trade_count", "total_return; CASE WHEN n > 1 AND total_return > -1 THEN pow(1 + total_return, 252.0::DOUBLE / n) - 1 ELSE total_return END AS annualized_return; max_drawdown; sharpe_ratio; CASE WHEN trade_count > 0 THEN wins / trade_count ELSE 0 END AS win_rate; final_equity", "FROM t2"),
)(lambda s, d: st.metrics(st.backtest(st.sma_cross(bars(s, d)))))

# Metrics

SID = "PARTITION BY strategy_id ORDER BY date"
CURVE = f"""WITH {EQUITY}, q0 AS (SELECT *, coalesce(equity / lag(equity) OVER ({SID}) - 1, 0) AS daily_return, equity / max(equity) OVER ({SID} {SO_FAR}) - 1 AS drawdown FROM equity),
 q1 AS (SELECT strategy_id, count(*) AS n, CASE WHEN arg_min(equity, date) <> 0 THEN arg_max(equity, date) / arg_min(equity, date) - 1 ELSE 0 END AS total_return, min(drawdown) AS max_drawdown,
 coalesce(stddev_samp(daily_return) * sqrt(252), 0) AS volatility, CASE WHEN stddev_samp(daily_return) > 0 THEN avg(daily_return) / stddev_samp(daily_return) * sqrt(252) ELSE 0 END AS sharpe_ratio FROM q0 GROUP BY 1),
 q2 AS (SELECT *, CASE WHEN n < 2 THEN 0 WHEN 1 + total_return <= 0 THEN -1 ELSE pow(1 + total_return, 252.0::DOUBLE / n) - 1 END AS annualized_return FROM q1),
 q3 AS (SELECT *, CASE WHEN max_drawdown <> 0 THEN annualized_return / abs(max_drawdown) ELSE 0 END AS calmar_ratio FROM q2)"""
query("m_daily_returns", f"{CURVE} " + select("strategy_id, date", "daily_return", "FROM q0"))(lambda s, d: m.daily_returns(equity(s, d)).select("strategy_id", "date", "daily_return"))
for _name, _column in (("m_total_return", "total_return"), ("m_annualized", "annualized_return"), ("m_max_drawdown", "max_drawdown"), ("m_volatility", "volatility"), ("m_sharpe", "sharpe_ratio"), ("m_calmar", "calmar_ratio")):
    query(_name, f"{CURVE} " + select("strategy_id", _column, "FROM q3"))(lambda s, d, c=_column: m.summary(equity(s, d)).select("strategy_id", c))
query("m_all", f"{CURVE} " + select("strategy_id, n", "total_return; annualized_return; max_drawdown; volatility; sharpe_ratio; calmar_ratio", "FROM q3"))(lambda s, d: m.summary(equity(s, d)))
ANNUAL = f"""y0 AS (SELECT strategy_id, CAST(year(date) AS INTEGER) AS year, arg_max(equity, date) AS last, arg_min(equity, date) AS first, count(*) AS n FROM equity GROUP BY 1, 2),
 y1 AS (SELECT strategy_id, unnest(range(min(year), max(year) + 1))::INTEGER AS year FROM y0 GROUP BY 1),
 y2 AS (SELECT strategy_id, year, last, first, n, last_value(last IGNORE NULLS) OVER (PARTITION BY strategy_id ORDER BY year {SO_FAR}) AS filled, row_number() OVER (PARTITION BY strategy_id ORDER BY year) AS k FROM y1 LEFT JOIN y0 USING (strategy_id, year)),
 y3 AS (SELECT strategy_id, year, CASE WHEN k = 1 THEN CASE WHEN n >= 2 AND first <> 0 THEN last / first - 1 END ELSE filled / lag(filled) OVER (PARTITION BY strategy_id ORDER BY year) - 1 END AS annual_return FROM y2)"""
query("m_annual", f"WITH {EQUITY}, {ANNUAL} " + select("strategy_id, year", "annual_return", "FROM y3 WHERE annual_return IS NOT NULL"))(lambda s, d: m.annual_returns(equity(s, d)))
query(
    "m_monthly",
    f"""WITH {EQUITY}, p0 AS (SELECT strategy_id, CAST(date_trunc('month', date) AS DATE) AS month, arg_max(equity, date) AS last FROM equity GROUP BY 1, 2),
 p1 AS (SELECT strategy_id, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM p0 GROUP BY 1),
 p2 AS (SELECT strategy_id, month, last_value(last IGNORE NULLS) OVER (PARTITION BY strategy_id ORDER BY month {SO_FAR}) AS filled FROM p1 LEFT JOIN p0 USING (strategy_id, month)),
 p3 AS (SELECT strategy_id, month, filled / lag(filled) OVER (PARTITION BY strategy_id ORDER BY month) - 1 AS monthly_return FROM p2) """
    + select("strategy_id, month", "monthly_return", "FROM p3 WHERE monthly_return IS NOT NULL"),
)(lambda s, d: m.monthly_returns(equity(s, d)))


def _partial_years(e):
    """First and last calendar year of each curve, which are not whole."""
    y = e.groupBy("strategy_id").agg(F.min(F.year("date")).alias("a"), F.max(F.year("date")).alias("b"))
    return y.select("strategy_id", F.explode(F.array("a", "b")).alias("year")).distinct()


query(
    "period_return_maps",
    f"""WITH {EQUITY}, {ANNUAL}, ends AS (SELECT strategy_id, min(year) AS a, max(year) AS b FROM y0 GROUP BY 1)
 SELECT strategy_id, '{{' || string_agg('"' || year || '":' || CAST(round(annual_return, 6) AS VARCHAR), ',' ORDER BY year) || '}}' AS annual_returns FROM y3 JOIN ends USING (strategy_id)
 WHERE annual_return IS NOT NULL AND year <> a AND year <> b GROUP BY 1""",
)(lambda s, d: (lambda e: m.period_returns(e, _partial_years(e)))(equity(s, d)))


def benchmarks(spark, sf_dir):
    """The mean weekly close of the brands of each third."""
    k = F.regexp_extract("symbol", "[0-9]+", 0).cast("int")
    return weekly(spark, sf_dir).groupBy(F.concat(F.lit("benchmark_"), (k % 3).cast("string")).alias("benchmark"), "date").agg(F.avg("close").alias("close"))


BENCHMARKS = WEEKLY + ", benchmarks AS MATERIALIZED (SELECT 'benchmark_' || (CAST(regexp_extract(symbol, '[0-9]+') AS INTEGER) % 3) AS benchmark, date, avg(close) AS close FROM bars_w GROUP BY 1, 2)"
query("bench_curve", f"WITH {BENCHMARKS} " + select("benchmark, date", "close / first_value(close) OVER (PARTITION BY benchmark ORDER BY date) * 100000 AS equity", "FROM benchmarks"))(lambda s, d: m.benchmark_curve(benchmarks(s, d)).select("benchmark", "date", "equity"))

# Rebalancing and the portfolio backtest


def members(spark, sf_dir):
    return strategy_members(bars(spark, sf_dir))


@shared
def grid(spark, sf_dir):
    return pf.price_grid(members(spark, sf_dir), weekly(spark, sf_dir))


GRID = f"""{WEEKLY}, {MEMBERS}, g0 AS (SELECT strategy_id, symbol, date, close FROM members JOIN bars_w USING (symbol)),
 g1 AS (SELECT m.strategy_id, m.symbol, t.date, g0.close AS real FROM (SELECT DISTINCT strategy_id, date FROM g0) t JOIN members m USING (strategy_id) LEFT JOIN g0 ON g0.strategy_id = m.strategy_id AND g0.symbol = m.symbol AND g0.date = t.date),
 g2 AS (SELECT *, last_value(real IGNORE NULLS) OVER (PARTITION BY strategy_id, symbol ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS close FROM g1),
 grid AS MATERIALIZED (SELECT strategy_id, date, symbol, close, real IS NULL AS filled FROM (SELECT *, count(close) OVER (PARTITION BY strategy_id, date) AS have, count(*) OVER (PARTITION BY strategy_id, date) AS want FROM g2) WHERE have = want)"""
query("price_grid", f"WITH {GRID} " + select("strategy_id, date, symbol, filled", "close", "FROM grid"))(grid)


def every_frequency(spark, sf_dir):
    dates = grid(spark, sf_dir).select("strategy_id", "date").distinct()
    out = [pf.rebalance_dates(dates, f).select(F.lit(f).alias("frequency"), "strategy_id", "date") for f in ("monthly", "quarterly", "yearly", "five_year")]
    return out[0].union(out[1]).union(out[2]).union(out[3])


_PERIODS = {"monthly": "CAST(date_trunc('month', date) AS VARCHAR)", "quarterly": "CAST(date_trunc('quarter', date) AS VARCHAR)", "yearly": "CAST(date_trunc('year', date) AS VARCHAR)", "five_year": "CAST((year(date) - y0) // 5 AS VARCHAR)"}
query(
    "rebalance_dates",
    f"WITH {GRID}, days AS (SELECT *, min(year(date)) OVER (PARTITION BY strategy_id) AS y0 FROM (SELECT DISTINCT strategy_id, date FROM grid)) " + " UNION ALL ".join(f"SELECT '{f}' AS frequency, strategy_id, min(date) AS date FROM days GROUP BY strategy_id, {p}" for f, p in _PERIODS.items()),
)(every_frequency)


@shared
def schedule(spark, sf_dir):
    """Fixed weights of each strategy on its quarterly rebalance dates."""
    dates = pf.rebalance_dates(grid(spark, sf_dir).select("strategy_id", "date").distinct(), "quarterly")
    return dates.join(members(spark, sf_dir).select("strategy_id", "symbol", "weight"), "strategy_id")


def flawed(spark, sf_dir):
    """The schedule with flaws by strategy: 1 has a negative weight, 2 too large a position, 3 dates off the grid."""
    k = F.col("strategy_id")
    return schedule(spark, sf_dir).withColumns({"weight": F.when((k == 1) & (F.col("symbol") == "Brand#6"), -0.01).when((k == 2) & (F.col("symbol") == "Brand#11"), 0.5).otherwise(F.col("weight")), "date": F.when(k == 3, F.date_add("date", 1)).otherwise(F.col("date"))})


query(
    "weights_validate",
    f"""WITH {GRID}, days AS (SELECT DISTINCT strategy_id, date FROM grid), w0 AS (SELECT strategy_id, CASE WHEN strategy_id = 3 THEN date + 1 ELSE date END AS date, symbol,
 CASE WHEN symbol = 'Brand#6' THEN -0.01 WHEN symbol = 'Brand#11' THEN 0.5 ELSE weight END AS weight FROM (SELECT strategy_id, min(date) AS date FROM days GROUP BY 1, date_trunc('quarter', date)) JOIN members USING (strategy_id)),
 w1 AS (SELECT strategy_id, date, count(*) AS n, sum(weight) AS total, min(weight) AS low, max(weight) AS high FROM w0 GROUP BY 1, 2) """
    + select("strategy_id, date, n, CASE WHEN low < 0 THEN 'negative_weight' WHEN high > 0.3 + 1e-12 THEN 'above_max_position' WHEN total > 1 + 1e-12 THEN 'sum_above_one' WHEN total > 0.95 + 1e-12 THEN 'cash_violated' WHEN (strategy_id, date) NOT IN (SELECT (strategy_id, date) FROM days) THEN 'date_not_in_prices' END AS reason", "total", "FROM w1"),
)(lambda s, d: pf.weights_reason(flawed(s, d), 0.3, 0.05, grid(s, d)))


@shared
def folded(spark, sf_dir):
    return pf.rebalance(grid(spark, sf_dir), schedule(spark, sf_dir))


#: Fractions of a sale's and a purchase's value that costs take.
_SELL, _BUY = "(0.0003::DOUBLE + 0.001::DOUBLE + 0.0005::DOUBLE)", "(0.0003::DOUBLE + 0.0005::DOUBLE)"
_EACH = lambda x, n="n": f"list_transform(range(1, {n} + 1), lambda i: {x})"
_SUM = lambda x, n="n": f"list_sum({_EACH(x, n)})"
FOLD = f"""{GRID}, rebalances AS MATERIALIZED (SELECT strategy_id, date, count(*) AS n, list(symbol ORDER BY symbol) AS names, list(close ORDER BY symbol) AS px, list(weight ORDER BY symbol) AS w, row_number() OVER (PARTITION BY strategy_id ORDER BY date) AS turn
 FROM grid JOIN members USING (strategy_id, symbol) WHERE (strategy_id, date) IN (SELECT (strategy_id, min(date)) FROM grid GROUP BY strategy_id, date_trunc('quarter', date)) GROUP BY 1, 2),
 fold AS (SELECT strategy_id, date, 0::BIGINT AS turn, n, names, px, {_EACH('0.0::DOUBLE')} AS before, {_EACH('0.0::DOUBLE')} AS after, 1e6::DOUBLE AS cash FROM rebalances WHERE turn = 1
 UNION ALL SELECT strategy_id, date, turn, n, names, px, held, {_EACH('CASE WHEN goal[i] < held[i] THEN goal[i] ELSE held[i] + (goal[i] - held[i]) * part END')}, greatest(have - asked * part, 0)
 FROM (SELECT *, CASE WHEN asked > 0 THEN least(1, have / asked) ELSE 1 END AS part
 FROM (SELECT *, old + {_SUM('greatest(held[i] - goal[i], 0) * px[i]')} * (1 - {_SELL}) AS have, {_SUM('greatest(goal[i] - held[i], 0) * px[i]')} * (1 + {_BUY}) AS asked
 FROM (SELECT *, {_EACH('(old + total) * w[i] / px[i]')} AS goal FROM (SELECT *, {_SUM('held[i] * px[i]')} AS total FROM (SELECT r.*, f.cash AS old, f.after AS held FROM fold f JOIN rebalances r ON r.strategy_id = f.strategy_id AND r.turn = f.turn + 1)))))),
 folded AS MATERIALIZED (SELECT strategy_id, date, cash, cash + {_SUM('after[i] * px[i]')} AS equity, unnest(names) AS symbol, unnest(px) AS price, unnest(before) AS before, unnest(after) AS after FROM fold WHERE turn > 0),
 trades AS (SELECT strategy_id, date, symbol, CASE WHEN after < before THEN 'sell' ELSE 'buy' END AS side, abs(after - before) AS shares, price, abs(after - before) * price AS value FROM folded WHERE after <> before)"""
query(
    "bt_portfolio",
    f"""WITH RECURSIVE {FOLD}, spans AS (SELECT *, lead(date) OVER (PARTITION BY strategy_id ORDER BY date) AS until FROM (SELECT DISTINCT strategy_id, date, cash FROM folded)),
 marked AS (SELECT g.strategy_id, g.date, sum(f.after * g.close) + max(f.cash) AS equity FROM grid g JOIN spans s ON s.strategy_id = g.strategy_id AND g.date >= s.date AND (s.until IS NULL OR g.date < s.until)
 JOIN folded f ON f.strategy_id = s.strategy_id AND f.date = s.date AND f.symbol = g.symbol GROUP BY 1, 2) """
    + select("strategy_id, date", "coalesce(equity, 1e6) AS equity", "FROM (SELECT DISTINCT strategy_id, date FROM grid) LEFT JOIN marked USING (strategy_id, date)"),
)(lambda s, d: pf.equity_curve(grid(s, d), folded(s, d)))
query("bt_trades", f"WITH RECURSIVE {FOLD} " + select("strategy_id, date, symbol, side", f"shares; price; value AS trade_value; value * CASE side WHEN 'sell' THEN {_SELL} ELSE {_BUY} END AS cost", "FROM trades"))(lambda s, d: pf.trades(folded(s, d)))
query("bt_holdings", f"WITH RECURSIVE {FOLD} " + select("strategy_id, date, symbol", "after AS shares; after * price / equity AS weight; cash; cash / equity AS cash_weight; equity", "FROM folded"))(lambda s, d: pf.holdings(folded(s, d)))
query("bt_turnover", f"WITH RECURSIVE {FOLD} " + select("strategy_id", "sum(value) / 1e6 AS turnover", "FROM trades GROUP BY 1"))(lambda s, d: pf.turnover(folded(s, d)))

# Construction: every quarter is a portfolio of candidates scored by their month's return

LIMITS = pf.Constraints(max_holdings=8, min_holdings=6, min_score=40.0, max_position_weight=0.2, min_position_weight=0.05, max_industry_weight=0.45, cash_weight_min=0.05, cash_weight_max=0.4)
#: Caps that never bind, for which the allocation is proportional to the scores.
LOOSE = pf.Constraints(max_holdings=8, min_score=40.0, max_position_weight=1.0, max_industry_weight=1.0, cash_weight_min=0.05, cash_weight_max=0.4)


@shared
def candidates(spark, sf_dir):
    from .adapters import resampled

    q = resampled(bars(spark, sf_dir), "quarter")
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 50 + (F.col("close") / F.col("open") - 1) * 20))
    rows = q.join(members(spark, sf_dir).select("symbol", "industry"), "symbol").select(F.date_format("date", "yyyy-MM").alias("portfolio"), "symbol", F.round(score, 6).alias("score"), "industry", F.regexp_extract("symbol", "[0-9]+", 0).cast("int").alias("ordinal"))
    again = rows.where("ordinal % 8 = 0").select("portfolio", "symbol", (F.col("score") - 5).alias("score"), "industry", (F.col("ordinal") + 100).alias("ordinal"))
    return rows.union(again)


CANDIDATES = f"""{BARS}, {MEMBERS}, c0 AS (SELECT strftime(date_trunc('quarter', date), '%Y-%m') AS portfolio, symbol, round(greatest(0, least(100, 50 + (arg_max(close, date) / arg_min(open, date) - 1) * 20)), 6) AS score FROM bars GROUP BY date_trunc('quarter', date), symbol),
 c1 AS (SELECT portfolio, symbol, score, industry, CAST(regexp_extract(symbol, '[0-9]+') AS INTEGER) AS ordinal FROM c0 JOIN members USING (symbol)),
 candidates AS MATERIALIZED (SELECT * FROM c1 UNION ALL SELECT portfolio, symbol, score - 5, industry, ordinal + 100 FROM c1 WHERE ordinal % 8 = 0),
 k0 AS (SELECT *, row_number() OVER (PARTITION BY portfolio, symbol ORDER BY score DESC, ordinal) > 1 AS copy FROM candidates),
 k1 AS (SELECT *, NOT copy AND score >= 40 AS fit FROM k0),
 k2 AS (SELECT *, CASE WHEN fit THEN CAST(row_number() OVER (PARTITION BY portfolio ORDER BY fit DESC, score DESC, ordinal) AS INTEGER) END AS rank FROM k1),
 ranked AS MATERIALIZED (SELECT portfolio, symbol, score, industry, ordinal, rank, CASE WHEN copy THEN 'duplicate symbol with lower score' WHEN score < 40 THEN 'score below threshold 40.00' WHEN rank > 8 THEN 'outside top 8 by composite_score' END AS reason FROM k2)"""
query("rank_candidates", f"WITH {CANDIDATES} " + select("portfolio, symbol, industry, ordinal, rank, reason, reason IS NULL AS selected", "score", "FROM ranked"))(lambda s, d: pf.rank_candidates(candidates(s, d), LIMITS))


def budgeted(spark, sf_dir, limits=LIMITS):
    """Ranked candidates; the macro multiplier of a portfolio goes with its month."""
    multiplier = 0.5 + F.substring("portfolio", 6, 2).cast("int") / 20
    return pf.equity_budget(pf.rank_candidates(candidates(spark, sf_dir), limits).withColumn("multiplier", multiplier), limits)


_BUDGET = "greatest(1 - 0.4::DOUBLE, least(1 - 0.05::DOUBLE, greatest(0, least(1, 0.5::DOUBLE + CAST(substr(portfolio, 6, 2) AS INTEGER) / 20.0::DOUBLE))))"
query("equity_budget", f"WITH {CANDIDATES} " + select("portfolio", f"{_BUDGET} AS equity_budget", "FROM (SELECT DISTINCT portfolio FROM ranked)"))(lambda s, d: budgeted(s, d).select("portfolio", "equity_budget").distinct())


def poured(source: str, budget: str) -> str:
    """CTEs ``pour`` (one row a turn of the allocation under LIMITS) and ``built`` from ranked candidates."""
    got = "list_transform(list_filter(range(1, n + 1), lambda j: ind[j] = ind[i + 1]), lambda j: got[j])"
    return f"""picked AS MATERIALIZED (SELECT portfolio, count(*) AS n, list(symbol ORDER BY rank) AS names, list(industry ORDER BY rank) AS ind, list(greatest(score, 1e-9) ORDER BY rank) AS share, any_value({budget}) AS budget FROM {source} WHERE reason IS NULL GROUP BY 1),
 pour AS (SELECT portfolio, 0::BIGINT AS i, n, names, ind, share, list_transform(share, lambda x: 0.0::DOUBLE) AS got, list_transform(share, lambda x: true) AS open, budget::DOUBLE AS rest, 0.0::DOUBLE AS given, list_sum(share) AS whole, false AS done, false AS stuck FROM picked
 UNION ALL SELECT portfolio, CASE WHEN i = n THEN 0 ELSE i + 1 END, n, names, ind, share, CASE WHEN i < n THEN list_transform(got, lambda g, j: CASE WHEN j = i + 1 THEN g + part ELSE g END) ELSE got END,
 CASE WHEN i < n AND open[i + 1] THEN list_transform(open, lambda o, j: CASE WHEN j = i + 1 THEN room - part > 1e-12 ELSE o END) ELSE open END,
 CASE WHEN i = n THEN rest - given ELSE rest END, CASE WHEN i = n THEN 0 ELSE given + part END, CASE WHEN i = n THEN coalesce(list_sum(list_transform(list_filter(range(1, n + 1), lambda j: open[j]), lambda j: share[j])), 0) ELSE whole END,
 i = n AND (given <= 1e-12 OR rest - given <= 1e-12 OR NOT list_contains(open, true)), i = n AND given <= 1e-12
 FROM (SELECT *, CASE WHEN i < n AND open[i + 1] AND least(rest * share[i + 1] / whole, room) > 1e-12 THEN least(rest * share[i + 1] / whole, room) ELSE 0 END AS part
 FROM (SELECT *, CASE WHEN i < n THEN least(0.2::DOUBLE - got[i + 1], 0.45::DOUBLE - list_sum({got})) END AS room FROM pour WHERE NOT done))),
 given_out AS MATERIALIZED (SELECT portfolio, unnest(names) AS symbol, unnest(ind) AS industry, unnest(got) AS weight FROM pour WHERE done),
 b0 AS (SELECT r.*, w.weight, r.reason IS NULL AS chosen, r.reason IS NULL AND coalesce(w.weight, 0) < 0.05 AS small FROM {source} r LEFT JOIN given_out w ON w.portfolio = r.portfolio AND w.symbol = r.symbol),
 b1 AS (SELECT * EXCLUDE (reason), CASE WHEN small THEN 'weight below min_position_weight after constraints' ELSE reason END AS reason, chosen AND NOT small AS selected, CASE WHEN chosen AND NOT small THEN weight ELSE 0 END AS target_weight FROM b0),
 built AS MATERIALIZED (SELECT *, sum(target_weight) OVER (PARTITION BY portfolio) AS invested_weight FROM b1)"""


POURED = f"WITH RECURSIVE {CANDIDATES}, {poured('ranked', _BUDGET)} "
query("allocate_weights", POURED + select("portfolio, symbol", "weight", "FROM given_out"))(lambda s, d: pf.allocate(budgeted(s, d), LIMITS))
query("portfolio_build", POURED + select("portfolio, symbol, ordinal, selected, reason", "score; target_weight; invested_weight; 1 - invested_weight AS cash_weight", "FROM built"))(
    lambda s, d: pf.build(budgeted(s, d), LIMITS).select("portfolio", "symbol", "ordinal", "score", "selected", "reason", "target_weight", "invested_weight", "cash_weight")
)
query(
    "portfolio_warnings",
    POURED
    + """SELECT portfolio, 'selected holdings below min_holdings (' || n || ' < 6)' AS warning FROM picked WHERE n < 6
 UNION ALL SELECT portfolio, 'remaining equity budget could not be allocated under constraints' FROM pour WHERE stuck UNION ALL SELECT portfolio, symbol || ' reached max_position_weight' FROM given_out WHERE 0.2::DOUBLE - weight <= 1e-12
 UNION ALL SELECT portfolio, industry || ' reached max_industry_weight' FROM given_out GROUP BY portfolio, industry HAVING 0.45::DOUBLE - sum(weight) <= 1e-12 UNION ALL SELECT portfolio, 'unallocated equity budget left as cash' FROM pour WHERE done AND rest > 1e-8
 UNION ALL SELECT portfolio, symbol || ' weight below min_position_weight; left as cash' FROM given_out WHERE weight > 0 AND weight < 0.05
 UNION ALL SELECT DISTINCT portfolio, 'cash_weight below cash_weight_min after allocation' FROM built WHERE 1 - invested_weight < 0.05::DOUBLE - 1e-12
 UNION ALL SELECT DISTINCT portfolio, 'cash_weight above cash_weight_max due to portfolio constraints' FROM built WHERE 1 - invested_weight > 0.4::DOUBLE + 1e-12""",
)(lambda s, d: pf.build_warnings(budgeted(s, d), LIMITS))
query(
    "constraints_check",
    f"""WITH {CANDIDATES}, h AS (SELECT portfolio, symbol, industry, {_BUDGET} * score / sum(score) OVER (PARTITION BY portfolio) AS weight FROM ranked WHERE reason IS NULL),
 v AS (SELECT portfolio, 'max_position_weight' AS rule, symbol AS subject, weight AS value FROM h WHERE weight > 0.2 + 1e-12 UNION ALL SELECT portfolio, 'min_position_weight', symbol, weight FROM h WHERE weight > 0 AND weight < 0.05 - 1e-12
 UNION ALL SELECT portfolio, 'max_industry_weight', industry, sum(weight) FROM h GROUP BY portfolio, industry HAVING sum(weight) > 0.45 + 1e-12 UNION ALL SELECT portfolio, 'weight_sum', 'portfolio', sum(weight) FROM h GROUP BY portfolio HAVING sum(weight) > 1 + 1e-12) """
    + select("portfolio, rule, subject", "value", "FROM v"),
)(lambda s, d: pf.check_constraints(pf.allocate(budgeted(s, d, LOOSE), LOOSE).join(members(s, d).select("symbol", "industry"), "symbol"), LIMITS))
