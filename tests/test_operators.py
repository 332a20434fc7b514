"""Hand-computed cases, invariances, streams against batches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quantloom.functions import scores as sc
from quantloom.operators import factors, portfolio, quality, strategies, text
from quantloom.operators import metrics as m
from quantloom.plans.adapters import bars
from quantloom.sources import normalize as no
from quantloom.streaming import market

SF = "/root/testdata/sf0.001"
DAY = dt.date(2024, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def test_schedule_backtest_by_hand(spark):
    """Closes 100, 200, 220; all in on the second day without costs: 1000, 1000, 1100."""
    grid = spark.createDataFrame([(0, day(i), "a", c, False) for i, c in enumerate((100.0, 200.0, 220.0))], "strategy_id int, date date, symbol string, close double, filled boolean")
    weights = spark.createDataFrame([(0, day(1), "a", 1.0)], "strategy_id int, date date, symbol string, weight double")
    folded = portfolio.rebalance(grid, weights, 1000.0, portfolio.Costs(0, 0, 0)).cache()
    assert [(t.side, t.shares, t.price) for t in portfolio.trades(folded).collect()] == [("buy", 5.0, 200.0)]
    assert [r.equity for r in portfolio.equity_curve(grid, folded, 1000.0).orderBy("date").collect()] == [1000.0, 1000.0, 1100.0]


def test_portfolio_matches_a_daily_loop(spark):
    """The two-phase backtest against a loop over days."""
    costs, capital = portfolio.Costs(), 10_000.0
    close = {s: [base * (1 + 0.01 * ((i * k) % 7 - 3)) for i in range(30)] for k, (s, base) in enumerate({"a": 10.0, "b": 20.0, "c": 5.0}.items(), 2)}
    grid = spark.createDataFrame([(0, day(i), s, c[i], False) for s, c in close.items() for i in range(30)], "strategy_id int, date date, symbol string, close double, filled boolean")
    target = {"a": 0.4, "b": 0.3, "c": 0.25}
    when = (3, 11, 22)
    weights = spark.createDataFrame([(0, day(i), s, w) for i in when for s, w in target.items()], "strategy_id int, date date, symbol string, weight double")
    got = [r.equity for r in portfolio.equity_curve(grid, portfolio.rebalance(grid, weights, capital), capital).orderBy("date").collect()]
    cash, held, want = capital, dict.fromkeys(target, 0.0), []
    for i in range(30):
        price = {s: close[s][i] for s in target}
        if i in when:
            value = cash + sum(held[s] * price[s] for s in held)
            for s in target:
                more = value * target[s] / price[s] - held[s]
                if more < 0:
                    cash += -more * price[s] * (1 - costs.commission - costs.stamp_tax - costs.slippage)
                    held[s] += more
            buys = {s: value * target[s] / price[s] - held[s] for s in target if value * target[s] / price[s] > held[s]}
            need = sum(n * price[s] * (1 + costs.commission + costs.slippage) for s, n in buys.items())
            scale = min(1, cash / need) if need else 1
            for s, n in buys.items():
                held[s] += n * scale
                cash -= n * scale * price[s] * (1 + costs.commission + costs.slippage)
        want.append(cash + sum(held[s] * price[s] for s in held))
    assert got == pytest.approx(want)


def test_allocation_caps(spark):
    limits = portfolio.Constraints(max_holdings=3, max_position_weight=0.4, max_industry_weight=0.5)
    rows = [("p", "x", 90.0, "i", 1, True, 0.9), ("p", "y", 60.0, "i", 2, True, 0.9), ("p", "z", 30.0, "j", 3, True, 0.9)]
    got = {r.symbol: r.weight for r in portfolio.allocate(spark.createDataFrame(rows, "portfolio string, symbol string, score double, industry string, rank int, selected boolean, equity_budget double"), limits).collect()}
    assert got == pytest.approx({"x": 0.4, "y": 0.1, "z": 0.4})


def test_build_leaves_small_weights_as_cash(spark):
    limits = portfolio.Constraints(max_holdings=2, min_score=10, min_position_weight=0.3, max_position_weight=0.5, max_industry_weight=1.0)
    rows = [("p", "x", 90.0, "i", 1), ("p", "y", 30.0, "j", 2), ("p", "x", 95.0, "i", 3), ("p", "z", 5.0, "i", 4), ("p", "u", 20.0, "i", 5)]
    ranked = portfolio.rank_candidates(spark.createDataFrame(rows, "portfolio string, symbol string, score double, industry string, ordinal int"), limits)
    got = {(r.symbol, r.ordinal): (r.selected, r.reason) for r in portfolio.build(portfolio.equity_budget(ranked.withColumn("multiplier", F.lit(1.0)), limits), limits).collect()}
    assert got["x", 3] == (True, None) and got["y", 2][0] is (got["y", 2][1] is None)
    assert got["x", 1][1] == "duplicate symbol with lower score" and got["z", 4][1] == "score below threshold 10.00" and got["u", 5][1] == "outside top 2 by composite_score"


def test_metrics_by_hand(spark):
    e = spark.createDataFrame([("s", day(i), v) for i, v in enumerate((100.0, 120.0, 90.0, 135.0))], "strategy_id string, date date, equity double")
    r = m.summary(e).first()
    assert r.total_return == pytest.approx(0.35) and r.max_drawdown == pytest.approx(-0.25) and r.annualized_return == pytest.approx(1.35**63 - 1)


def test_single_backtest_matches_a_loop(spark):
    b = bars(spark, SF).where("symbol in ('Brand#1', 'Brand#2')")
    signals = strategies.sma_cross(b).orderBy("symbol", "date").collect()
    got = {(r.symbol, r.date): r.equity for r in strategies.backtest(strategies.sma_cross(b), 1000.0, 0.002).collect()}
    for symbol in ("Brand#1", "Brand#2"):
        cash, shares = 1000.0, 0.0
        for r in (x for x in signals if x.symbol == symbol):
            if r.signal == "buy" and not shares:
                shares, cash = cash / (r.close * 1.002), 0.0
            elif r.signal == "sell" and shares:
                cash, shares = shares * r.close * 0.998, 0.0
            assert got[symbol, r.date] == pytest.approx(cash + shares * r.close)


def test_scores(spark):
    row = spark.createDataFrame([(5.0, None, float("nan"))], "a double, b double, c double").select(
        sc.higher(F.col("a"), 0, 10).alias("h"), sc.lower(F.col("a"), 0, 10).alias("l"), sc.center(F.col("a"), 5, 2).alias("m"), sc.higher(F.col("b"), 0, 1).alias("n"), sc.clip_score(F.col("c"), 50.0).alias("x"), sc.higher(F.col("a"), 1, 1).alias("flat"), sc.average_available(F.col("b"), F.col("a")).alias("v"), sc.average_available(F.col("b")).alias("none"),
    ).first()
    assert tuple(row) == (50.0, 50.0, 100.0, None, 50.0, 50.0, 5.0, 50.0)


def test_weekdays(spark):
    df = spark.range(0, 400).select(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 20).cast("int")).alias("a"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 20 + F.floor(F.col("id") / 20)).cast("int")).alias("b"))
    for r in df.withColumn("n", quality.weekdays(F.col("a"), F.col("b"))).collect():
        assert r.n == sum((r.a + dt.timedelta(days=i)).weekday() < 5 for i in range((r.b - r.a).days))


def test_no_lookahead(spark):
    """Rows after a date do not change the factors on it."""
    b = bars(spark, SF).where("symbol = 'Brand#3'")
    cut = b.agg(F.expr("percentile_approx(unix_date(date), 0.8)")).first()[0]
    step = lambda x: x.transform(factors.momentum).transform(factors.obos).where(F.expr(f"unix_date(date) <= {cut}")).orderBy("date").collect()
    assert step(b) == step(b.where(F.expr(f"unix_date(date) <= {cut}")))


def test_partitions_do_not_matter(spark):
    from quantloom.plans.queries import QUERIES

    before = spark.conf.get("spark.sql.shuffle.partitions")
    out = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out.append(sorted(map(str, QUERIES["sig_sentiment"](spark, SF).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert out[0] == out[1]


def test_cjk_sentiment(spark):
    lexicon = spark.createDataFrame([("好", 1), ("上涨", 1), ("下跌", -1), ("good", 1), ("bad", -1)], "word string, polarity int")
    posts = spark.createDataFrame([(1, "股票上涨 上涨 好 bad"), (2, "bad bad good"), (3, None), (4, "下跌")], "post_id int, text string")
    got = {r.post_id: (r.positive, r.negative, r.label) for r in text.sentiment(posts, lexicon).collect()}
    assert got == {1: (3, 1, "positive"), 2: (1, 2, "negative"), 3: (0, 0, "neutral"), 4: (0, 1, "negative")}


def test_sources(spark, tmp_path):
    csv = tmp_path / "macro.csv"
    csv.write_text("date,available_date,pmi,cpi_yoy,ppi_yoy,m2_yoy,social_financing_yoy,ten_year_yield,usd_cny,policy_score,external_risk_score,source\n# a comment\n2024-01-31,2024-02-09,50.1,x,1,2,3,4,5,6,7,s\n2024-02-29,bad,49,1,1,2,3,4,5,6,7,s\n")
    rows = no.scan_macro_csv(spark, str(csv)).orderBy("date").collect()
    assert len(rows) == 2 and rows[0].cpi_yoy is None and rows[1].available_date is None
    assert no.latest(no.scan_macro_csv(spark, str(csv))).first().pmi == 49
    b = bars(spark, SF).cache()
    no.write_bars(b, str(tmp_path / "bars"), "qfq", 8)
    assert no.scan_bars(spark, str(tmp_path / "bars"), "qfq", ["Brand#4"], 8).count() == b.where("symbol = 'Brand#4'").count()
    no.write_run({"bars": b}, str(tmp_path / "runs"), "r1")
    with pytest.raises(FileExistsError):
        no.write_run({"bars": b}, str(tmp_path / "runs"), "r1")
    # A job that fails leaves neither its claim nor rows; the run can be written again.
    broken = b.select("symbol", F.raise_error(F.lit("broken")).alias("x"))
    with pytest.raises(Exception, match="broken"):
        no.write_run({"bars": b, "broken": broken}, str(tmp_path / "runs"), "r2")
    assert [r.run_id for r in spark.read.parquet(str(tmp_path / "runs" / "bars")).select("run_id").distinct().collect()] == ["r1"]
    no.write_run({"bars": b}, str(tmp_path / "runs"), "r2")


TICK = "symbol string, ts timestamp, price double, volume double, tick_id long"


def test_streams_equal_batches(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(s, start + dt.timedelta(minutes=7 * i), 100.0 + (i * k) % 23, float(1 + 50 * (i % 25 == 24)), i * 10 + k) for i in range(60) for k, s in enumerate(("a", "b"), 3)]
    for part in range(3):
        spark.createDataFrame(rows[part * 40 : part * 40 + 40], TICK).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = spark.createDataFrame(rows, TICK)
    stream = lambda: spark.readStream.schema(TICK).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return sorted(map(str, spark.table(name).collect()))

    assert run(market.alerts(stream(), 0.05, 3.0), "alerts", "append") == sorted(map(str, market.alerts(batch, 0.05, 3.0).collect()))
    assert run(market.bars(stream()), "bars", "complete") == sorted(map(str, market.bars(batch).collect()))
    assert len(run(market.dedupe(stream()), "ticks", "append")) == market.dedupe(batch.union(batch)).count() == 120
    sink = market.sink(str(tmp_path / "sink"))
    for _ in range(2):  # a retried batch replaces itself
        sink(market.alerts(batch, 0.05, 3.0), 0)
    assert spark.read.parquet(str(tmp_path / "sink")).count() == market.alerts(batch, 0.05, 3.0).count()


def test_registered_forest_is_whole(spark):
    """The queries train the forest of the operator's defaults: 100 trees of depth 10."""
    from quantloom.plans import review_plans

    forest = review_plans.model(spark, SF)[1].stages[-1]
    assert forest.getNumTrees == 100 and forest.getOrDefault("maxDepth") == 10


def test_max_sharpe_is_the_maximum(spark):
    """No mix of three assets on a grid beats the weights returned, where the clipped closed form may be beaten."""
    import itertools

    import numpy as np

    from quantloom.operators import optimize as op

    mean = np.array([0.0011, 0.0009, -0.0002])
    cov = np.array([[4.0, 1.5, 1.9], [1.5, 2.0, 1.2], [1.9, 1.2, 3.0]]) * 1e-4
    names = ["a", "b", "c"]
    means = spark.createDataFrame([(1, s, float(x)) for s, x in zip(names, mean, strict=True)], "universe int, symbol string, mean double")
    pairs = spark.createDataFrame([(1, x, y, float(cov[i, j])) for i, x in enumerate(names) for j, y in enumerate(names)], "universe int, a string, b string, cov double")
    few = spark.createDataFrame([(1, 0, s, 1 / 3) for s in names], "universe int, candidate int, symbol string, weight double")
    got = {r.symbol: r for r in op.best_weights(few, means, pairs).collect()}
    assert set(got) == set(names) and abs(sum(r.weight for r in got.values()) - 1) < 1e-9
    sharpe = lambda w: (w @ mean * 252 - 0.02) / np.sqrt(w @ cov @ w * 252)
    grid = [np.array([i, j, 50 - i - j]) / 50 for i, j in itertools.product(range(51), repeat=2) if i + j <= 50]
    best = sharpe(np.array([got[s].weight for s in names]))
    assert abs(best - got["a"].sharpe_ratio) < 1e-9 and all(best >= sharpe(w) - 1e-12 for w in grid)
    falling = op.max_sharpe_weights(-np.abs(mean), cov)
    assert falling.max() == 1 and all(sharpe_of >= 0 for sharpe_of in falling)


def test_batch_alerts_spread_a_symbol(spark):
    """A symbol's ticks are dealt by span of time, not all to one function, and the ticks before a span count."""
    start = dt.datetime(2024, 1, 1)
    gaps = [7, 7, 300, 1, 1, 1, 59, 120]
    ts, rows = start, []
    for i in range(150):
        ts += dt.timedelta(minutes=gaps[i % 8])
        rows.append(("a", ts, 100.0 + (i * 7) % 23, float(1 + 50 * (i % 25 == 24)), i))
    import pandas as pd

    frame = pd.DataFrame(rows, columns=["symbol", "ts", "price", "volume", "tick_id"])
    want = market.step(frame, None, [], 0.05, 3.0)[0]
    df = market.alerts(spark.createDataFrame(rows, TICK), 0.05, 3.0)
    assert sorted((r.ts, r.kind, round(r.value, 9)) for r in df.collect()) == sorted((x.ts.to_pydatetime(), x.kind, round(x.value, 9)) for x in want.itertuples())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "span" in plan


def test_mean_variance_weights(spark):
    """Least variance against a grid of mixes; a target return is met; the frontier runs from the one to the best asset."""
    import itertools

    import numpy as np

    from quantloom.operators import optimize as op

    mean = np.array([0.0010, 0.0006, 0.0002])
    cov = np.array([[4.0, 0.5, 0.3], [0.5, 2.0, 0.4], [0.3, 0.4, 1.0]]) * 1e-4
    names = ["a", "b", "c"]
    means = spark.createDataFrame([(1, s, float(x)) for s, x in zip(names, mean, strict=True)], "universe int, symbol string, mean double")
    pairs = spark.createDataFrame([(1, x, y, float(cov[i, j])) for i, x in enumerate(names) for j, y in enumerate(names)], "universe int, a string, b string, cov double")
    vector = lambda rows: np.array([{r.symbol: r.weight for r in rows}[s] for s in names])
    least = vector(op.min_variance(means, pairs).collect())
    grid = [np.array([i, j, 100 - i - j]) / 100 for i, j in itertools.product(range(101), repeat=2) if i + j <= 100]
    assert abs(least.sum() - 1) < 1e-9 and least @ cov @ least <= min(w @ cov @ w for w in grid) + 1e-12
    met = vector(op.target_return(means, pairs, 0.15).collect())
    assert abs(met.sum() - 1) < 1e-9 and abs(met @ mean * 252 - 0.15) < 1e-9
    near = [w for w in grid if w @ mean * 252 >= 0.15]
    assert met @ cov @ met <= min(w @ cov @ w for w in near) + 1e-12
    points = op.frontier(means, pairs, 5).orderBy("point").collect()
    targets = sorted({r.target for r in points})
    assert len(points) == 15 and abs(targets[0] - least @ mean * 252) < 1e-9 and abs(targets[-1] - mean.max() * 252) < 1e-9


def test_forest_on_held_out_rows(spark):
    """Metrics of rows later than those trained on, a prediction a symbol, importances that sum to 1."""
    from quantloom.operators import ml

    data = ml.dataset(bars(spark, SF).where("symbol in ('Brand#1', 'Brand#2', 'Brand#3')")).cache()
    fitted, early, late = ml.train(data, trees=10, depth=4)
    assert early.agg(F.max("date")).first()[0] <= late.agg(F.max("date")).first()[0] and early.count() + late.count() == data.where("label is not null").count()
    scores = ml.evaluate(fitted, late)
    assert scores and all(v == v for v in scores.values())
    assert sorted(r.symbol for r in ml.predict(fitted, data).collect()) == ["Brand#1", "Brand#2", "Brand#3"]
    assert abs(sum(x for _, x in ml.importance(fitted)) - 1) < 1e-6
