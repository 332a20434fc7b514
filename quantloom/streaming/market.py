"""Streams of ticks (symbol, ts, price, volume): bars, deduplication, alerts with state, and the alert sink.

Every function also takes a batch table and then gives the same rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators import alerts as rules
from ..operators.indicators import FAST, SIGNAL, SLOW

MINUTE_US = 60_000_000
#: Seconds of ticks that a task of a batch takes together.
SPAN = 3600
#: A waiting tick; one without a number comes before those of its time that have one.
TICK = np.dtype([("us", "<i8"), ("numbered", "?"), ("tick_id", "<i8"), ("price", "<f8"), ("volume", "<f8")])
#: Ticks that a task holds before it writes them down, and state rows that it gives out together.
KEPT, TAKEN = 2**19, 2**15
#: The tick_id of a row that ends a session, and the state store that timers and maps need.
CLOSING = -1
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def bars(ticks: DataFrame, length: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """OHLCV by tumbling window; ticks later than ``delay`` are dropped (in a stream)."""
    order = F.struct("ts", "tick_id")
    g = ticks.withWatermark("ts", delay).groupBy("symbol", F.window("ts", length).alias("w"))
    out = g.agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("volume").alias("volume"))
    return out.select("symbol", F.col("w.start").alias("start"), "open", "high", "low", "close", "volume")


def dedupe(ticks: DataFrame, key: tuple[str, ...] = ("tick_id",), delay: str = "2 hours") -> DataFrame:
    """One row a key, under retries within ``delay``."""
    df = ticks.withWatermark("ts", delay)
    return df.dropDuplicatesWithinWatermark(list(key)) if ticks.isStreaming else df.dropDuplicates(list(key))


def batch_alerts(ticks: DataFrame, change: float, ratio: float) -> DataFrame:
    """The alerts of a table by windows over a symbol's ticks of SPAN seconds, with the 19 ticks before them carried in."""
    order = [F.asc_nulls_last("ts"), F.asc_nulls_last("tick_id")]
    span = F.coalesce(F.floor(F.col("ts").cast("double") / SPAN), F.lit(2**62)).alias("span")
    rows = ticks.select("symbol", span, "ts", "tick_id", "price", "volume")
    back = W.partitionBy("symbol", "span").orderBy(F.desc_nulls_first("ts"), F.desc_nulls_first("tick_id"))
    # 19 rows a span at most: what a symbol has of them grows with time, not with ticks.
    ends = rows.withColumn("back", F.row_number().over(back)).where("back <= 19")
    tick = F.struct("ts", "tick_id", "price", "volume")
    by_symbol = W.partitionBy("symbol").orderBy("span", *order)
    ends = ends.withColumns({"carry": F.collect_list(tick).over(by_symbol.rowsBetween(-18, 0)), "next": F.lead("span").over(by_symbol)}).where("back = 1 and next is not null")
    carried = ends.select("symbol", F.col("next").alias("span"), F.inline("carry")).withColumn("own", F.lit(False))
    w = W.partitionBy("symbol", "span").orderBy(*order)
    before = w.rowsBetween(-19, -1)
    whole = rows.withColumn("own", F.lit(True)).unionByName(carried).withColumns({"last": F.lag("price").over(w), "n": F.count("volume").over(before), "mean": F.avg("volume").over(before)})
    pct, times = F.col("price") / F.nullif(F.col("last"), F.lit(0.0)) - 1, F.col("volume") / F.nullif(F.col("mean"), F.lit(0.0))
    found = F.array(
        F.when(~F.isnan(pct) & (F.abs(pct) >= change), F.struct(F.lit("pct").alias("kind"), (pct * 100).alias("value"))),
        F.when((F.col("n") == 19) & ~F.isnan(times) & (times > ratio), F.struct(F.lit("volume").alias("kind"), times.alias("value"))),
    )
    return whole.where("own").select("symbol", "ts", F.inline(F.array_compact(found)))


class TickStates(StatefulProcessor):
    """The state row of every tick of a symbol, in order of event time.

    Ticks wait by spans of ``span`` microseconds until the watermark has passed one; then its ticks are taken in order of (ts, tick_id), and only
    the last price, 19 volumes and the averages of MACD stay. So what is held of a symbol is the ticks of the watermark's delay and a span at a time,
    and a tick that comes late, but within the delay, is counted where it belongs. Without ``wait`` the ticks of a batch are taken at its end, span by span.

    Ticks wait as bytes (``TICK``), in parts that are written once: more ticks of a span become another part. A symbol has one timer, that of its first span.
    """

    def __init__(self, wait: bool = True, span: int = MINUTE_US):
        self.wait, self.span = wait, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "span long, part long", "ticks binary")
        self.parts = handle.getValueState("parts", "n long")
        self.carried = handle.getValueState("carried", "rows long, price double, volumes array<double>, priced boolean, ema12 double, ema26 double, macd double, signal double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        part, first, kept, n = self.parts.get()[0] if self.parts.exists() else 0, None, [], 0
        for chunk in rows:
            ticks = np.empty(len(chunk), TICK)
            for c in TICK.names:
                ticks[c] = chunk[c]
            kept.append(ticks)
            n += len(ticks)
            if n >= KEPT:
                part, first, kept, n = part + 1, self.keep(kept, part, first), [], 0
        if n:
            part, first = part + 1, self.keep(kept, part, first)
        self.parts.update((part,))
        if not self.wait:
            yield from self.taken(key, None)
        elif first is not None and all(t > self.end(first) for t in self.handle.listTimers()):
            self.handle.registerTimer(self.end(first))

    def keep(self, ticks: list[np.ndarray], part: int, first: int | None) -> int:
        """Write ticks as a part of their spans; the first span so far."""
        all_ticks = np.concatenate(ticks)
        spans = all_ticks["us"] // self.span
        order = np.argsort(spans, kind="stable")
        values, starts = np.unique(spans[order], return_index=True)
        for span, some in zip(values.tolist(), np.split(order, starts[1:]), strict=True):
            self.waiting.updateValue((span, part), (all_ticks[some].tobytes(),))
        return min(x for x in (first, int(values[0])) if x is not None)

    def end(self, span: int) -> int:
        return (span + 1) * self.span // 1000 - 1

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.taken(key, timerValues.getCurrentWatermarkInMs())

    def taken(self, key: tuple, until: int | None) -> Iterator[pd.DataFrame]:
        """States of the waiting ticks of the spans that end by ``until``, in order; the next span gets the timer."""
        held = sorted(map(tuple, self.waiting.keys()))
        passed = [k for k in held if until is None or self.end(k[0]) <= until]
        now = list(self.carried.get()) if self.carried.exists() else [0, None, [], False, None, None, None, None]
        out = []
        for _, parts in itertools.groupby(passed, key=lambda k: k[0]):
            ticks = []
            for part in parts:
                ticks.append(np.frombuffer(self.waiting.getValue(part)[0], TICK))
                self.waiting.removeKey(part)
            ticks = np.concatenate(ticks)
            ticks = ticks[np.lexsort((ticks["tick_id"], ticks["numbered"], ticks["us"]))]
            for i in range(0, len(ticks), TAKEN):
                us, price, volume = (ticks[c][i : i + TAKEN].tolist() for c in ("us", "price", "volume"))
                out += [(key[0], *next_state(now, (t, None, None if p != p else p, None if v != v else v))) for t, p, v in zip(us, price, volume, strict=True)]
                if len(out) >= TAKEN:
                    yield pd.DataFrame(out, columns=TICK_COLUMNS)
                    out = []
        if out:
            yield pd.DataFrame(out, columns=TICK_COLUMNS)
        self.carried.update(tuple(now))
        if len(passed) < len(held):
            self.handle.registerTimer(self.end(held[len(passed)][0]))

    def close(self) -> None:
        pass


TICK_STATE = "symbol string, us long, close double, volume double, before double, macd double, macd_signal double, macd1 double, signal1 double, mean19 double, known19 long, rows long"
TICK_COLUMNS = [c.split()[0] for c in TICK_STATE.split(", ")]


def next_state(now: list, tick: tuple) -> tuple:
    """The state row of the next tick of a symbol; ``now`` (rows, price, 19 volumes, priced, ema12, ema26, macd, signal) moves on."""
    rows, before, volumes, priced, fast, slow, macd1, signal1 = now
    us, _, price, volume = tick
    macd, signal = macd1, signal1
    if price is not None:
        fast, slow = (fast + FAST * (price - fast), slow + SLOW * (price - slow)) if priced else (price, price)
        macd = fast - slow
        signal = signal1 + SIGNAL * (macd - signal1) if priced else macd
        priced = True
    known = [v for v in volumes if v is not None]
    now[:] = [rows + 1, price, [*volumes, volume][-19:], priced, fast, slow, macd, signal]
    return us, price, volume, before, macd, signal, macd1, signal1, sum(known) / len(known) if known else None, len(known), rows + 1


def states(ticks: DataFrame, delay: str | None = "2 hours", span: int = MINUTE_US) -> DataFrame:
    """The state row of every tick (``alerts.STATE``), that rules look at; in a stream once the watermark has passed the tick's span of microseconds.

    The batch form has the same rows. Ticks later than ``delay`` are dropped in a stream; with None a stream takes each batch's ticks at once, in order within
    the batch only. In both, ticks without a time are left out. A tick whose tick_id is
    CLOSING only moves the watermark: it ends a session.
    """
    real = F.coalesce("tick_id", F.lit(0)) != CLOSING
    if not ticks.isStreaming:
        rows = ticks.where(F.col("ts").isNotNull() & real).select("symbol", F.struct("ts", "tick_id").alias("date"), F.col("price").alias("close"), "volume", *[F.lit(None).cast("double").alias(c) for c in ("high", "low")])
        place = F.row_number().over(W.partitionBy("symbol").orderBy("date"))
        return rules.states(rows.withColumn("_place", place), F.floor(F.col("_place") / 1024)).withColumn("date", F.col("date.ts"))
    ticks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    tick = [F.unix_micros("ts").alias("us"), F.col("tick_id").isNotNull().alias("numbered"), F.coalesce("tick_id", F.lit(0)).cast("long").alias("tick_id"), *[F.col(c).cast("double").alias(c) for c in ("price", "volume")]]
    if delay is None:
        now = ticks.where(F.col("ts").isNotNull() & real).select("symbol", *tick)
        return _tick_dates(now.groupBy("symbol").transformWithStateInPandas(TickStates(False, span), TICK_STATE, "Append", "None"))
    # A condition on the event time stays above the watermark, which a closing row must reach.
    timed = ticks.withWatermark("ts", delay).where(F.when(real, F.col("ts")).isNotNull()).select("symbol", "ts", *tick)
    return _tick_dates(timed.groupBy("symbol").transformWithStateInPandas(TickStates(True, span), TICK_STATE, "Append", "EventTime"))


def _tick_dates(out: DataFrame) -> DataFrame:
    return out.select("symbol", F.timestamp_micros("us").alias("date"), *[c for c in out.columns if c not in ("symbol", "us")])


def alerts(ticks: DataFrame, change: float = 0.1, ratio: float = 3.0, delay: str | None = None, span: int = MINUTE_US) -> DataFrame:
    """Alerts per symbol on a change of ``change`` on the tick before and a volume over ``ratio`` means of the last 19; in a stream from states.

    ``delay`` and ``span`` as for ``states``: None alerts at once, a delay puts late ticks of other batches in order first.
    """
    if not ticks.isStreaming:
        return batch_alerts(ticks, change, ratio)
    pct, times = F.col("close") / F.nullif(F.col("before"), F.lit(0.0)) - 1, F.col("volume") / F.nullif(F.col("mean19"), F.lit(0.0))
    found = F.array(
        F.when(~F.isnan(pct) & (F.abs(pct) >= change), F.struct(F.lit("pct").alias("kind"), (pct * 100).alias("value"))),
        F.when((F.col("known19") == 19) & ~F.isnan(times) & (times > ratio), F.struct(F.lit("volume").alias("kind"), times.alias("value"))),
    )
    return states(ticks, delay, span).select("symbol", F.col("date").alias("ts"), F.inline(F.array_compact(found)))


def sink(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch becomes its own partition of the alert table, written over on a retry."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("sent_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def run_once(stream: DataFrame, path: str, mode: str = "append") -> None:
    """Run a stream over all that is there: each batch becomes a partition of the table ``path``/out, written over on a retry.

    Run again, it goes on from the checkpoint in ``path``/state with what is new since.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/epoch={epoch}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
