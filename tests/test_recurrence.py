"""The scan of linear recurrences against pandas, and alerts of a stream of ticks against the batch form."""

import datetime as dt
import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from quantloom.operators import alerts, indicators
from quantloom.plans.queries import ORACLES, QUERIES
from quantloom.streaming import market


def by_pandas(rows):
    """A row without a close keeps the averages; one without a full range those of KDJ."""
    out = []
    for symbol, g in pd.DataFrame(rows, columns=["symbol", "date", "high", "low", "close"]).groupby("symbol"):
        g = g.sort_values("date").reset_index(drop=True)
        close = g["close"].dropna()
        fast, slow = (close.ewm(span=n, adjust=False).mean() for n in (12, 26))
        macd = fast - slow
        signal = macd.ewm(span=9, adjust=False).mean()
        low, high = g["low"].rolling(9).min(), g["high"].rolling(9).max()
        rsv = ((g["close"] - low) / (high - low).replace(0, 1e-10) * 100).dropna()
        k = rsv.ewm(com=2, adjust=False).mean()
        d = k.ewm(com=2, adjust=False).mean()
        parts = {"ema12": fast, "ema26": slow, "macd": macd, "macd_signal": signal, "macd_hist": macd - signal, "kdj_k": k, "kdj_d": d, "kdj_j": 3 * k - 2 * d}
        for i, date in enumerate(g["date"]):
            out.append((symbol, date, *(s.reindex(range(len(g))).ffill()[i] for s in parts.values())))
    return out


def price_rows():
    r = random.Random(11)
    rows = []
    for symbol, days, start in (("long", 3000, dt.date(1999, 6, 3)), ("short", 5, dt.date(2001, 12, 30)), ("one", 1, dt.date(2000, 1, 1)), ("thin", 40, dt.date(2000, 1, 1)), ("flat", 400, dt.date(2000, 5, 1)), ("gaps", 700, dt.date(2000, 5, 1))):
        step = 97 if symbol == "thin" else 1  # a few rows a year
        for k in range(days):
            c = 5.0 if symbol == "flat" else round(100 * math.exp(r.gauss(0, 0.3)), 2)
            high, low = c + r.random() * (symbol != "flat"), c - r.random() * (symbol != "flat")
            if symbol == "gaps" and (k < 20 or k % 13 == 0 or 300 < k < 420):
                c = None
            if symbol == "gaps" and k % 57 == 5:
                high = None
            rows.append((symbol, start + dt.timedelta(days=k * step), high, low, c))
    return rows


@pytest.mark.parametrize("block", [None, "month", "place"])
def test_recurrences_against_pandas(spark, block):
    """By years, by months, and by blocks of three rows; blocks without values, series without a full range, and one hot symbol among others."""
    rows = price_rows()
    df = spark.createDataFrame(rows, "symbol string, date date, high double, low double, close double").withColumn("close", F.when(~F.isnan("close"), F.col("close")))
    place = F.datediff("date", F.lit("1999-01-01")) / 3
    cut = {None: None, "month": F.year("date") * 12 + F.month("date"), "place": F.floor(place)}[block]
    got = {(r.symbol, r.date): [r[c] for c in indicators.EWM] for r in indicators.ewm(df, cut).collect()}
    want = by_pandas(rows)
    assert len(got) == len(want) == len(rows)
    for symbol, date, *values in want:
        for g, w in zip(got[symbol, date], values, strict=True):
            assert (g is None and math.isnan(w)) or math.isclose(g, w, rel_tol=1e-9, abs_tol=1e-9), (symbol, date, g, w)


def test_recurrences_spread_a_hot_symbol_without_python(spark):
    df = spark.createDataFrame(price_rows(), "symbol string, date date, high double, low double, close double")
    plan = indicators.ewm(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    # The rows themselves are dealt out by symbol and block, only the blocks' summaries by symbol.
    assert "hashpartitioning(symbol" in plan and "_block" in plan
    assert indicators.ewm(df.where("false")).count() == 0


def test_first_row_has_no_rounding(spark):
    """The averages of a first row are its close, so MACD and its signal are exactly 0 there."""
    rows = [(f"s{k}", dt.date(2000, 1, 1 + i), 2.0, 1.0, 0.1 * k + i / 7) for k in range(50) for i in range(2)]
    out = indicators.ewm(spark.createDataFrame(rows, "symbol string, date date, high double, low double, close double")).where("date = '2000-01-01'").collect()
    assert all(r.ema12 == r.close == r.ema26 and r.macd == 0 and r.macd_signal == 0 for r in out)


TICK = "tick_id long, symbol string, ts timestamp, price double, volume double"


def tick_rows(late_minutes=90):
    """Ticks of three symbols over two days in four files, some of them late by up to ``late_minutes``."""
    r = random.Random(5)
    start = dt.datetime(2024, 3, 1)
    rows = [(k, r.choice(["a", "b", "hot", "hot", "hot"]), start + dt.timedelta(seconds=40 * k + r.randrange(40)), None if k % 97 == 0 else round(r.uniform(50, 150), 2), float(r.randrange(100))) for k in range(4000)]
    rows += [(9000 + k, "a", start + dt.timedelta(minutes=5), 100.0 + k, 1.0) for k in range(4)]  # equal times
    arrival = sorted(rows, key=lambda t: t[2] + dt.timedelta(minutes=r.random() * late_minutes * (t[0] % 3 == 0)))
    return [arrival[k::1][:1000] for k in range(0, len(arrival), 1000)]


RULES = [(k, s, kind, way, t, k % 7 != 3) for k, (s, kind, way, t) in enumerate((s, *x) for s in ("a", "b", "hot", "none") for x in (("price", "above", 140.0), ("price", "below", 60.0), ("pct", "up", 80.0), ("pct", "any", 100.0), ("volume", "above", 1.8), ("macd", "any", 0.0), ("macd", "death", 0.0), ("other", "up", 0.0)))]


def test_rules_on_a_stream(spark, tmp_path):
    """Four batches with late ticks, a restart from the checkpoint after each: the alerts of all kinds are those of the whole table."""
    path = str(tmp_path)
    files = tick_rows()
    rules = spark.createDataFrame(RULES, "rule_id long, symbol string, kind string, direction string, threshold double, active boolean")
    whole = spark.createDataFrame([t for f in files for t in f], TICK)

    def run():
        ticks = spark.readStream.schema(TICK).parquet(f"{path}/in")
        market.run_once(alerts.fired(rules, market.states(ticks, "2 hours")), path)

    for f in files:
        spark.createDataFrame(f, TICK).coalesce(1).write.mode("append").parquet(f"{path}/in")
        run()
    before = spark.read.parquet(f"{path}/out").count()
    end = max(t[2] for f in files for t in f) + dt.timedelta(hours=3)
    spark.createDataFrame([(market.CLOSING, "session", end, None, None)], TICK).coalesce(1).write.mode("append").parquet(f"{path}/in")
    run()
    columns = ["rule_id", "symbol", "date", "kind", "severity"]
    shown = lambda df: sorted((*(str(r[c]) for c in columns), round(r.value, 6)) for r in df.collect())
    got, want = shown(spark.read.parquet(f"{path}/out")), shown(alerts.fired(rules, market.states(whole)))
    assert got == want and 0 < before < len(got)
    assert {k for *_, k, _, _ in want} == {"price", "pct", "volume", "macd"}
    simple = lambda df: sorted((r.symbol, str(r.ts), r.kind, round(r.value, 6)) for r in df.collect())
    assert simple(market.alerts(whole)) == simple(market.batch_alerts(whole, 0.1, 3.0))


def test_too_late_ticks_are_dropped(spark, tmp_path):
    path = str(tmp_path)
    at = lambda h: dt.datetime(2024, 3, 1, h)
    for k, rows in enumerate(([(1, "a", at(10), 1.0, 1.0)], [(2, "a", at(14), 2.0, 1.0)], [(3, "a", at(9), 50.0, 1.0), (4, "a", None, 60.0, 1.0), (market.CLOSING, "end", at(20), None, None)])):
        spark.createDataFrame(rows, TICK).coalesce(1).write.mode("append").parquet(f"{path}/in")
        market.run_once(market.states(spark.readStream.schema(TICK).parquet(f"{path}/in"), "2 hours"), path)
        assert k >= 0
    out = spark.read.parquet(f"{path}/out").orderBy("date").collect()
    assert [(r.close, r.before, r.rows) for r in out] == [(1.0, None, 1), (2.0, 1.0, 2)]


def test_next_state_is_the_batch_state(spark):
    """The fold over ticks, one at a time, against the windows."""
    rows = [t for f in tick_rows() for t in f]
    got = {(r.symbol, r.date): r for r in market.states(spark.createDataFrame(rows, TICK)).collect()}
    for symbol in ("a", "b", "hot"):
        now = [0, None, [], False, None, None, None, None]
        for tick_id, _, ts, price, volume in sorted((t for t in rows if t[1] == symbol), key=lambda t: (t[2], t[0])):
            del tick_id
            want = market.next_state(now, (0, 0, price, volume))
        r = got[symbol, ts]
        assert (r.close, r.volume, r.rows) == (want[1], want[2], want[-1])
        assert np.allclose([r.before, r.macd, r.macd_signal, r.macd1, r.signal1, r.mean19], want[3:9])


@pytest.mark.parametrize("name", ["stream_rules", "stream_rules_live"])
def test_rules_after_a_price_of_zero(spark, tmp_path, name):
    """A price of zero before a tick, or volumes of zero, end no job: the change is infinite or NaN, as in the SQL."""
    prices = [5.0, 0.0, 7.0, 0.0, 0.0, -3.0, 4.0] * 5
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), 50 * (i < 24) + i // 24, s, p, "{}") for s in ("view", "click") for i, p in enumerate(prices)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    df = QUERIES[name](spark, str(tmp_path))
    duck = duckdb.connect()
    duck.execute("SET timezone = 'UTC'")
    duck.execute(f"CREATE VIEW events AS SELECT * REPLACE (ts::TIMESTAMP AS ts) FROM '{tmp_path}/events.parquet/*.parquet'")
    want = duck.sql(ORACLES[name]).select(*df.columns).fetchall()
    shown = lambda rows: sorted(str([*map(str, r[:-1]), None if r[-1] is None or math.isnan(r[-1]) else r[-1]]) for r in rows)
    assert shown(df.collect()) == shown(want) and sum(math.isnan(r[-1]) for r in want) > 10


class Held:
    """State of one key in memory, with the number of writes to maps."""

    def __init__(self):
        self.maps, self.values, self.timers, self.writes = {}, {}, set(), 0

    def getMapState(self, name, *_):
        held = self.maps.setdefault(name, {})

        class Map:
            keys, containsKey, getValue, removeKey = (lambda _: iter(list(held))), (lambda _, k: k in held), (lambda _, k: held.get(k)), (lambda _, k: held.pop(k))

            def updateValue(_, k, v):
                self.writes += 1
                held[k] = v

        return Map()

    def getValueState(self, name, *_):
        class Value:
            exists, get, update = (lambda _: name in self.values), (lambda _: self.values[name]), (lambda _, v: self.values.update({name: v}))

        return Value()

    def listTimers(self):
        return iter(list(self.timers))

    def registerTimer(self, at):
        self.timers.add(at)


@pytest.mark.parametrize("kept", [2**19, 700])
def test_waiting_ticks_are_written_once(monkeypatch, kept):
    """Chunks that all have ticks of every span are not written over for each chunk, and one timer takes what the watermark has passed."""
    monkeypatch.setattr(market, "KEPT", kept, raising=False)
    r, hour = random.Random(3), 3_600_000_000
    ticks = [(r.randrange(10 * hour), k, r.choice([None, 5.0, 6.5, 0.0]), float(r.randrange(9))) for k in range(2000)]
    frame = pd.DataFrame(ticks, columns=["us", "tick_id", "price", "volume"]).assign(numbered=True)
    held, states = Held(), market.TickStates(True, hour)
    states.init(held)
    chunks = [frame[k : k + 100] for k in range(0, len(frame), 100)]
    assert not list(states.handleInputRows(("a",), iter(chunks), TimerValues(-1, -1)))
    assert held.writes == 10 * (1 if kept > 2000 else 3) and held.timers == {3_600_000 - 1}
    got = []
    for watermark in (3 * 3_600_000 + 5, 11 * 3_600_000):
        while due := [t for t in held.timers if t <= watermark]:
            for out in states.handleExpiredTimer(("a",), TimerValues(-1, watermark), ExpiredTimerInfo(min(due))):
                got += out.astype(object).where(out.notna(), None).values.tolist()
            held.timers.remove(min(due))
        assert got[-1][1] // 1000 <= watermark and len(held.timers) == (watermark < 10 * 3_600_000)
    now = [0, None, [], False, None, None, None, None]
    assert got == [["a", *market.next_state(now, t)] for t in sorted(ticks)] and not held.maps["waiting"]


def test_ticks_of_one_time_are_in_order_of_long_ids(spark, tmp_path):
    """Ids that doubles cannot tell apart, beside a tick without one, order ticks of one time in a stream as in a table."""
    at = dt.datetime(2024, 3, 1, 10)
    rows = [(2**53 + 1, "a", at, 3.0, 1.0), (2**53, "a", at, 2.0, 1.0), (None, "a", at, 1.0, 1.0)]
    spark.createDataFrame([*rows, (market.CLOSING, "end", at + dt.timedelta(hours=4), None, None)], TICK).coalesce(1).write.parquet(f"{tmp_path}/in")
    market.run_once(market.states(spark.readStream.schema(TICK).parquet(f"{tmp_path}/in"), "2 hours"), str(tmp_path))
    shown = lambda df: [(r.rows, r.close, r.before) for r in df.orderBy("rows").collect()]
    assert shown(spark.read.parquet(f"{tmp_path}/out")) == shown(market.states(spark.createDataFrame(rows, TICK))) == [(1, 1.0, None), (2, 2.0, 1.0), (3, 3.0, 2.0)]


@pytest.mark.parametrize("sent", [100_000, 0])
def test_states_of_a_stream_are_not_broadcast(spark, tmp_path, monkeypatch, sent):
    """Also in a batch without new ticks, which gives out what has waited: few rules go to the states, many meet them by a shuffle, as in the table."""
    monkeypatch.setattr(alerts, "SENT", sent, raising=False)
    path, ticks = str(tmp_path), [t for f in tick_rows(0) for t in f]
    rules = spark.createDataFrame(RULES, "rule_id long, symbol string, kind string, direction string, threshold double, active boolean")
    rules.coalesce(1).write.parquet(f"{path}/rules")
    rules = spark.read.parquet(f"{path}/rules")
    done = spark._jsparkSession.sharedState().statusStore().executionsList
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    known = {done().apply(i).executionId() for i in range(done().size())}
    for rows in (ticks, [(market.CLOSING, "session", ticks[-1][2] + dt.timedelta(hours=6), None, None)]):
        spark.createDataFrame(rows, TICK).coalesce(1).write.mode("append").parquet(f"{path}/in")
        market.run_once(alerts.fired(rules, market.states(spark.readStream.schema(TICK).parquet(f"{path}/in"), "2 hours")), path)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    plans = [x.physicalPlanDescription() for x in map(done().apply, range(done().size())) if x.executionId() not in known]
    joins = [p for p in plans if "TransformWithState" in p]
    assert len(joins) >= 4 and all(("BuildRight" in p) == (sent > 0) and "BuildLeft" not in p for p in joins)
    shown = lambda df: sorted((r.rule_id, str(r.date), r.kind, r.severity, round(r.value, 6)) for r in df.collect())
    assert shown(spark.read.parquet(f"{path}/out")) == shown(alerts.fired(rules, market.states(spark.createDataFrame(ticks, TICK)))) != []
