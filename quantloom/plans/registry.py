"""Registry of queries: name, function of (spark, sf_dir), and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import nullcontext

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .adapters import written_once

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: (bound of the absolute value, decimals kept, what keeps halves off the rounding boundary, where engines differ); beyond, nine digits.
STEPS = ((1e3, 6, 3e-10), (1e6, 4, 3e-8), (1e9, 2, 3e-6))


def rounded(df: DataFrame) -> DataFrame:
    """Doubles rounded by size, NaN as null."""

    def one(c: str) -> Column:
        x = F.when(~F.isnan(c), F.col(c))
        unit = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))) - 8)
        out = F.round(x / unit + 3e-4) * unit
        for bound, digits, nudge in reversed(STEPS):
            out = F.when(F.abs(x) < bound, F.round(x + nudge, digits)).otherwise(out)
        return out.alias(c)

    return df.select(*[one(c) if t == "double" else F.col(c) for c, t in df.dtypes])


#: Queries that use a derived table several times: it is written once a call and read from there.
REPEATED = frozenset(
    "dq_benchmark source_priority_select rebalance_dates weights_validate bt_portfolio bt_trades bt_holdings bt_turnover price_grid weight_schedule constraints_check portfolio_build portfolio_warnings allocate_weights "
    "factor_low_vol factor_availability factor_composite factor_composite_avail factor_snapshot factor_buckets factor_coverage fundamentals_asof fundamentals_eligible run_coverage_summary run_status "
    "ind_ema ind_macd ind_kdj ind_full ml_features sig_macd sig_kdj sig_technical vote_weighted confidence_weighted signal_plugin reco_rank market_overview alert_price alert_pct alert_volume alert_macd_cross alert_all alert_history ml_train_rf ml_predict ml_importance "
    "return_moments return_moments_wide rolling_moments opt_rolling_min_variance opt_rolling_best_sharpe opt_portfolio_stats opt_min_variance opt_target_return opt_frontier opt_max_sharpe opt_max_sharpe_weights alert_all_live".split()
)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; its doubles are rounded."""

    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            with written_once() if name in REPEATED else nullcontext():
                return rounded(f(spark, sf_dir))

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f

    return add


def select(keys: str, doubles: str, tail: str) -> str:
    """SELECT of keys as they are and doubles rounded ('expression AS name' or 'name', separated by ';')."""
    out = [keys] if keys else []
    for item in filter(None, (x.strip() for x in doubles.split(";"))):
        x, _, name = item.rpartition(" AS ") if " AS " in item else (item, "", item)
        cases = " ".join(f"WHEN abs({x}) < {bound} THEN round(({x}) + {nudge}::DOUBLE, {digits})" for bound, digits, nudge in STEPS)
        unit = f"pow(10.0::DOUBLE, floor(log10(abs({x}))) - 8)"
        out.append(f"CASE {cases} WHEN ({x}) IS NOT NULL THEN round(({x}) / {unit} + 3e-4::DOUBLE) * {unit} END AS {name}")
    return f"SELECT {', '.join(out)} {tail}"
