"""Moments of wide universes and rolling windows, sliding drawdowns, sweeps over days and message parts against plain computations."""

import datetime as dt
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import factors, optimize, pit, quality, review, text
from quantloom.plans.queries import ORACLES, QUERIES

DAY = dt.date(2020, 1, 1)


def days(n):
    return [DAY + dt.timedelta(days=k) for k in range(n)]


def returns_of(spark, sizes, n, seed=3):
    r = np.random.default_rng(seed)
    x = {u: r.normal(0.001, 0.02, (n, p)) for u, p in sizes.items()}
    rows = [(u, d, f"s{j:04d}", float(v)) for u, m in x.items() for d, line in zip(days(n), m, strict=True) for j, v in enumerate(line)]
    return x, spark.createDataFrame(rows, "universe int, date date, symbol string, ret double")


@pytest.mark.parametrize("segment, dates", [(256, 1024), (7, 10), (1, 1000)])
def test_wide_moments(spark, segment, dates):
    """Segments that do not divide the universe, several chunks of dates, universes of one symbol and of one date."""
    x, rets = returns_of(spark, {1: 23, 2: 1, 3: 8}, 40)
    means, cov = optimize.wide_moments(rets, segment, dates)
    got = {(r.universe, r.a, r.b): r.cov for r in cov.collect()}
    assert len(got) == 23 * 23 + 1 + 64
    for u, m in x.items():
        want = np.atleast_2d(np.cov(m, rowvar=False))
        for i in range(m.shape[1]):
            for j in range(m.shape[1]):
                assert abs(got[u, f"s{i:04d}", f"s{j:04d}"] - want[i, j]) < 1e-12
    assert np.allclose([r["mean"] for r in means.where("universe = 1").orderBy("symbol").collect()], x[1].mean(axis=0))
    one = optimize.wide_moments(rets.where(F.col("date") == F.lit(DAY)), segment, dates)[1]
    assert one.where("cov is not null").count() == 0 and one.count() == len(got)
    pairs = {(r.universe, r.a, r.b): r.cov for r in optimize.moments(rets)[1].collect()}
    assert all(abs(pairs[k] - v) < 1e-12 for k, v in got.items())


def test_wide_universe_has_no_row_a_pair_and_date(spark):
    """Six hundred symbols on 60 dates: what meets is segments."""
    x, rets = returns_of(spark, {1: 600}, 60)
    cov = optimize.wide_moments(rets, 100)[1].toPandas().pivot(index="a", columns="b", values="cov").to_numpy()
    assert np.abs(cov - np.cov(x[1], rowvar=False)).max() < 1e-12


def test_rolling_moments(spark):
    x, rets = returns_of(spark, {1: 4, 2: 1}, 50)
    n = 12
    means, cov = optimize.rolling_moments(rets, n)
    got = {(r.universe, r.date, r.a, r.b): r.cov for r in cov.collect()}
    mean = {(r.universe, r.date, r.symbol): r["mean"] for r in means.collect()}
    assert len(got) == (50 - n + 1) * 17 and len(mean) == (50 - n + 1) * 5
    for (u, d, a, b), v in got.items():
        t = (d - DAY).days + 1
        part = x[u][t - n : t]
        i, j = int(a[1:]), int(b[1:])
        assert abs(v - np.cov(part[:, i], part[:, j])[0, 1]) < 1e-12 and abs(mean[u, d, a] - part[:, i].mean()) < 1e-12
    weights = optimize.min_variance(means, cov, ("universe", "date")).where("universe = 1").collect()
    last = max(r.date for r in weights)
    found = [r.weight for r in sorted(weights, key=lambda r: r.symbol) if r.date == last]
    assert np.allclose(found, optimize.min_variance_weights(np.cov(x[1][-n:], rowvar=False)), atol=1e-9)
    best = optimize.best_sharpe(means, cov, ("universe", "date"))
    assert best.groupBy("universe", "date").agg(F.sum("weight").alias("w")).where("abs(w - 1) > 1e-9").count() == 0
    assert optimize.rolling_moments(rets, 51)[1].count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_sliding_drawdown(spark, n):
    """Windows within a block, over two blocks, of one row, and longer than a series."""
    r = random.Random(n)
    rows = [(s, d, round(100 * 2 ** r.gauss(0, 0.5), 3) if s != "flat" else 5.0) for s, m in (("a", 60), ("b", 39), ("flat", 45)) for d in days(m)]
    df = spark.createDataFrame(rows, "symbol string, date date, close double").withColumn("place", F.datediff("date", F.lit(DAY)))
    first, second, worst = factors.sliding_drawdown("close", "place", n)
    got = {(x.symbol, x.place): x.worst for x in df.withColumns(first).withColumns(second).withColumn("worst", worst).collect()}
    for s in ("a", "b", "flat"):
        c = [x for t, _, x in rows if t == s]
        for i in range(n - 1, len(c)):
            part = c[i - n + 1 : i + 1]
            want = min(x / max(part[: k + 1]) - 1 for k, x in enumerate(part))
            assert abs(got[s, i] - want) < 1e-12


def test_macro_sweeps(spark):
    """Against all pairs, with rows without a date or publication and signals on the very day."""
    r = random.Random(2)
    fields = quality.INDICATORS[:3]
    wide = [(DAY + dt.timedelta(days=r.randrange(60)) if k else None, DAY + dt.timedelta(days=r.randrange(80)) if k % 7 else None, *(round(r.random(), 3) if r.random() > 0.2 else None for _ in fields)) for k in range(60)]
    asked = [DAY + dt.timedelta(days=k) for k in range(-3, 90, 4)]
    macro = spark.createDataFrame(wide, "date date, available_date date, " + ", ".join(f"{f} double" for f in fields))
    signals = spark.createDataFrame([(d,) for d in asked], "signal_date date")
    got = {x.signal_date: x for x in pit.macro_asof(macro, signals).collect()}
    for s in asked:
        public = [w for w in wide if w[0] and w[1] and w[0] <= s and w[1] <= s]
        last = max(((w[1], w[0], *[(v is not None, v or 0) for v in w[2:]]), w) for w in public)[1] if public else (None,) * 5
        x = got[s]
        assert (x.macro_date, x[fields[0]], x[fields[2]]) == (last[0], last[2], last[4])
        assert (x.eligible, x.published_later, x.missing_available) == (len(public), sum(w[1] is not None and w[1] > s for w in wide), sum(w[1] is None for w in wide))
    long = [(i, w[0], w[1]) for w in wide for i, v in zip(fields, w[2:], strict=True) if v is not None]
    one = quality.macro_pit(spark.createDataFrame(long, "indicator string, observation_date date, available_date date"), signals).first()
    have = [len({i for i, o, a in long if o and a and o <= s and a <= s}) for s in asked]
    want = (len(asked), sum(h == 3 for h in have), sum(0 < h < 3 for h in have), sum(h == 0 for h in have), sum(any(o and o > s for _, o, _ in long) for s in asked), sum(any(o and a and o <= s < a for _, o, a in long) for s in asked))
    assert tuple(one) == want
    assert tuple(quality.macro_pit(spark.createDataFrame([], "indicator string, observation_date date, available_date date"), signals.where("false")).first())[:1] == (0,)


MESSAGES = {
    "资金 3.5万 买入": (35000.0, None),
    "capital: 2000 w": (20_000_000.0, None),
    "initial capital is big, 本金为 700": (700.0, None),
    "I want to invest 5000": (100_000.0, None),
    "本金是100w 目标 12.5 % 收益": (1_000_000.0, 0.125),
    "% and 7%": (100_000.0, 0.07),
    "100% sure": (100_000.0, 1.0),
    "": (100_000.0, None),
}


def test_sums_and_percentages(spark):
    df = spark.createDataFrame(list(enumerate(MESSAGES)), "k int, text string")
    got = {r.text: (r.c, r.t) for r in df.select("text", text.capital(F.col("text")).alias("c"), text.target_return(F.col("text")).alias("t")).collect()}
    assert got == {m: (c, t if t is None else pytest.approx(t)) for m, (c, t) in MESSAGES.items()}


def test_holdings_in_messages(spark):
    said = {
        1: ("100股AAPL成本150, 20股苹果公司", "AAPL:100:150,AAPL:20:0"),
        2: ("30 shares TSLA cost 170.5; 5股 特斯拉", "TSLA:30:170.5,TSLA:5:0"),
        3: ("TSLA 50股, 特斯拉 10 shares at 170", "TSLA:50:0,TSLA:10:170"),
        4: ("AAPL 10股@99", "AAPL:10:99"),
        5: ("no holdings, 5%", ""),
        6: ("7股nothing known", ""),
        7: (None, ""),
    }
    names = spark.createDataFrame([("苹果", "AAPL"), ("特斯拉", "TSLA")], "name string, symbol string")
    df = spark.createDataFrame([(k, t) for k, (t, _) in said.items()], "message_id int, text string")
    got = {r.message_id: r.holdings for r in text.entities(df, names).collect()}
    assert got == {k: h for k, (_, h) in said.items()}


def test_messages_with_one_id(spark):
    """Messages with the same message_id or none keep their own symbols and holdings; equal ones do not count twice."""
    said = [(1, "100股AAPL成本150, 20股苹果公司", "AAPL", "AAPL:100:150,AAPL:20:0"), (1, "特斯拉", "TSLA", ""), (1, "特斯拉", "TSLA", ""), (None, "5股特斯拉", "TSLA", "TSLA:5:0"), (None, "5股特斯拉", "TSLA", "TSLA:5:0"), (None, "7股苹果", "AAPL", "AAPL:7:0"), (2, None, "", "")]
    names = spark.createDataFrame([("苹果", "AAPL"), ("特斯拉", "TSLA")], "name string, symbol string")
    df = spark.createDataFrame([r[:2] for r in said], "message_id int, text string")
    got = sorted(str((r.message_id, r.symbols, r.holdings)) for r in text.entities(df, names).collect())
    assert got == sorted(str((k, s, h)) for k, _, s, h in said)


def test_strategies_are_words(spark):
    said = {"schach universität versich": "buy_hold", "the plasma crossed": "buy_hold", "RSI策略": "rsi", "rsi14": "rsi", "use (RSI).": "rsi", "SMA cross": "sma_cross", "smacross": "sma_cross"}
    df = spark.createDataFrame(list(enumerate(said)), "message_id int, text string")
    got = {r.message_id: r.strategy for r in text.entities(df, spark.createDataFrame([], "name string, symbol string")).collect()}
    assert got == dict(enumerate(said.values()))


def test_entities_query_on_long_conversations(spark, tmp_path):
    """Turns from 10 on share their number with the next conversation's; texts and ids may be missing."""
    rows = [(c, t, "user", None if t == 3 else f"universität {t}") for c in (*range(12), -1, None) for t in (0, 3, 10, 21)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    df = QUERIES["utterance_entities"](spark, str(tmp_path))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = duck.sql(ORACLES["utterance_entities"]).select(*df.columns).fetchall()
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))


def test_word_lists_of_any_length(spark, monkeypatch):
    """A list with more words than KEYS is joined at once; the counts are the same."""
    posts = spark.createDataFrame([(1, "good good bad Good"), (2, "利好利好 大跌 good"), (3, None), (4, "nothing")], "post_id int, text string")
    lexicon = spark.createDataFrame([("good", 1), ("bad", -1), ("利好", 1), ("大跌", -1), ("awful", -1)], "word string, polarity int")
    shown = lambda: sorted((r.post_id, r.positive, r.negative) for r in text.sentiment(posts, lexicon).collect())
    want = [(1, 3, 1), (2, 3, 1), (3, 0, 0), (4, 0, 0)]
    assert shown() == want
    monkeypatch.setattr(text, "KEYS", 1)
    assert shown() == want


def test_warning_rules(spark):
    rows = [
        ("warning", "macro", "m", "a.b-c", ["metrics.json", "holdings.parquet#/rows/1"], None), ("info", "factor", "m", "x", None, None), ("info", "factor", "m", "x", [], None),
        ("fatal", "macro", "", "A", None, "invalid_severity"), ("info", "none", "", "A", None, "invalid_scope"), ("info", None, "m", "a", None, "invalid_scope"), ("info", "macro", "  ", "A", None, "empty_message"),
        ("error", "macro", "m", "Upper", None, "invalid_source"), ("error", "macro", "m", None, None, "invalid_source"), ("error", "macro", "m", "a", ["../metrics.json"], "invalid_artifact_reference"), ("error", "macro", "m", "a", ["metrics.json", None], "invalid_artifact_reference"), ("error", "macro", "m", "a", ["unknown.json"], "invalid_artifact_reference"),
    ]
    df = spark.createDataFrame([(k, *r[:5]) for k, r in enumerate(rows)], "k int, severity string, scope string, message string, source string, artifact_refs array<string>")
    judged = review.validate(df)
    assert [r.reason for r in judged.orderBy("k").collect()] == [r[5] for r in rows]
    totals = {(r.dimension, r.value): r.total for r in review.totals(review.categorize(judged.withColumn("run_id", F.lit(1)))).collect()}
    assert totals["severity", "info"] == 2 and totals["severity", "error"] == 0 and totals["scope", "factor"] == 2 and totals["category", "system"] == len(rows) and totals["category", "benchmark"] == 0


def test_benchmarks_of_silent_sources(spark):
    rows = [("A", "x", "2024-01-02", None), ("A", "x", "2024-01-03", None), ("B", "x", None, "1.0"), ("C", "x", "2024-01-02", "1.5"), ("C", "x", "2024-01-03", "1.5")]
    df = spark.createDataFrame(rows, "symbol string, source string, date string, close string")
    asked = spark.createDataFrame([(s, "x") for s in "ABCD"], "symbol string, source string")
    got = {r.symbol: (r.reason, r.n) for r in quality.benchmarks(df, "2024-01-02", "2024-01-03", requested=asked).collect()}
    assert got == {"A": ("invalid_schema", 2), "B": ("invalid_schema", 0), "C": ("success", 2), "D": ("empty_response", 0)}
