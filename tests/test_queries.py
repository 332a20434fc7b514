"""Registered queries against their SQL in DuckDB, at the smallest scale; ALL_QUERIES=1 runs every one."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from quantloom.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SOME = (
    "ind_full", "ind_ma_app", "ml_features", "sig_technical", "sig_fundamental", "vote_weighted", "reco_rank", "signal_plugin", "holdings_valuation", "strat_sma_cross", "strat_rsi", "bt_single_trades", "bt_single_metrics", "m_all", "m_annual", "m_monthly",
    "price_grid", "rebalance_dates", "weights_validate", "bt_portfolio", "bt_trades", "bt_holdings", "bt_turnover", "portfolio_build", "portfolio_warnings", "rank_candidates", "allocate_weights", "constraints_check", "fundamentals_asof", "fundamentals_rejected_counts", "factor_low_vol", "factor_snapshot", "weight_schedule", "run_coverage_summary", "run_status", "benchmark_coverage", "trade_evidence", "macro_at_signal", "factor_composite_avail", "factor_coverage", "dq_prices", "dq_benchmark", "source_priority_select",
    "macro_obs_reason", "macro_obs_dedupe", "valuation_availability", "return_moments", "opt_max_sharpe", "alert_all", "stream_alerts", "stream_bars_live", "stream_dedupe_live", "stream_alerts_live", "alert_sink", "macro_csv_scan", "bars_sink", "bars_scan", "run_tables_sink", "text_sentiment", "keywords_top", "utterance_entities", "warnings_summary", "curve_downsample", "risk_flags", "stream_rules", "alert_history", "warnings_totals", "bars_table", "bars_provider",
)
NAMES = [n for n in ORACLES if os.environ.get("ALL_QUERIES") or n in SOME]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return v + 0.0
    return str(v) if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(str([plain(r[names.index(c)]) for c in columns]) for r in result.fetchall())
    assert got == want


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES) and set(SOME) <= set(ORACLES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
