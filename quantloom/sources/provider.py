"""Bars from a provider of one's own, as a Spark data source: partitions of symbols, filters on symbol and date handed to the provider.

A provider is an object that workers can import or unpickle, with ``symbols() -> list[str]`` and ``bars(symbols, start, end)``, which yields
Arrow record batches of COLUMNS for some symbols and an inclusive span of dates (None: open). It is asked in tasks, never on the driver,
except for its list of symbols; a lost task asks again.

    bars = read_provider(spark, lambda: MyProvider(key), push_filters=True)
    bars.where("symbol in ('AAPL', 'TSLA') and date >= '2024-01-01'")     # asks for two symbols from that day on

Spark 4.1 keeps one reader for all uses of such a DataFrame in a query, with the filters of the last: with ``push_filters`` use it once a query, and read
again for a second use. Without, filters stay with Spark and the DataFrame may be used like any other.
"""

from __future__ import annotations

import base64
import datetime as dt
import importlib
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

SCHEMA = pa.schema([("symbol", pa.string()), ("date", pa.date32()), *[(c, pa.float64()) for c in ("open", "high", "low", "close", "volume", "amount")]])
COLUMNS = "symbol string, date date, open double, high double, low double, close double, volume double, amount double"
NAME = "market_provider"


class Provider(Protocol):
    def symbols(self) -> list[str]: ...

    def bars(self, symbols: list[str], start: dt.date | None, end: dt.date | None) -> Iterator[pa.RecordBatch]: ...


@dataclass
class FolderProvider:
    """Bars in a folder of Parquet files, one sub-folder ``symbol=...`` a symbol."""

    path: str

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("/") else f"file://{self.path}")

    def _folders(self) -> dict[str, str]:
        store, root = self._open()
        return {unquote(f.base_name.removeprefix("symbol=")): f.path for f in store.get_file_info(fs.FileSelector(root)) if f.base_name.startswith("symbol=")}

    def symbols(self) -> list[str]:
        return sorted(self._folders())

    def bars(self, symbols: list[str], start: dt.date | None, end: dt.date | None) -> Iterator[pa.RecordBatch]:
        store, folders = self._open()[0], self._folders()
        for s in symbols:
            if s not in folders:
                continue
            keep = None
            for bound, test in ((start, pc.greater_equal), (end, pc.less_equal)):
                if bound is not None:
                    now = test(pc.field("date"), pa.scalar(bound, pa.date32()))
                    keep = now if keep is None else keep & now
            for batch in ds.dataset(folders[s], filesystem=store, format="parquet").to_batches(columns=SCHEMA.names[1:], filter=keep):
                yield pa.RecordBatch.from_arrays([pa.array([s] * len(batch), pa.string()), *[batch.column(c).cast(SCHEMA.field(c).type) for c in SCHEMA.names[1:]]], schema=SCHEMA)


@dataclass
class Span(InputPartition):
    symbols: list[str]
    start: dt.date | None
    end: dt.date | None


class ProviderReader(DataSourceReader):
    def __init__(self, provider: Provider, a_task: int, push: bool):
        self.provider, self.a_task, self.push = provider, a_task, push
        self.wanted: set[str] | None = None
        self.start: dt.date | None = None
        self.end: dt.date | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes over what says which symbols and which days; returns the rest to Spark."""
        if not self.push:
            yield from filters
            return
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name == "symbol" and isinstance(f, EqualTo | In):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = asked if self.wanted is None else self.wanted & asked
            elif name == "date" and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and isinstance(f.value, dt.date):
                day = dt.timedelta(days=1)
                if not isinstance(f, LessThan | LessThanOrEqual):
                    low = f.value + day if isinstance(f, GreaterThan) else f.value
                    self.start = low if self.start is None else max(self.start, low)
                if not isinstance(f, GreaterThan | GreaterThanOrEqual):
                    high = f.value - day if isinstance(f, LessThan) else f.value
                    self.end = high if self.end is None else min(self.end, high)
            elif not (name in ("symbol", "date") and isinstance(f, IsNotNull)):  # a provider has no such rows
                yield f

    def partitions(self) -> list[InputPartition]:
        names = sorted(s for s in self.provider.symbols() if self.wanted is None or s in self.wanted)
        if self.start is not None and self.end is not None and self.start > self.end:
            names = []
        return [Span(names[k : k + self.a_task], self.start, self.end) for k in range(0, len(names), self.a_task)] or [Span([], None, None)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        if partition.symbols:
            yield from self.provider.bars(partition.symbols, partition.start, partition.end)


class ProviderSource(DataSource):
    """Options: ``provider``, a pickled maker or the path ``module:name`` of one (called without arguments), ``symbols_a_task`` and ``push_filters``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> ProviderReader:
        maker = self.options["provider"]
        if maker.startswith("pickle:"):
            make = pickle.loads(base64.b64decode(maker[7:]))
        else:
            module, _, name = maker.partition(":")
            make = getattr(importlib.import_module(module), name)
        return ProviderReader(make(), int(self.options.get("symbols_a_task", 50)), self.options.get("push_filters", "false") == "true")


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ProviderSource)


def read_provider(spark: SparkSession, make: Callable[[], Provider] | str, symbols_a_task: int = 50, push_filters: bool = False) -> DataFrame:
    """Bars of the provider that ``make`` (a function, or its path) gives; with ``push_filters`` for one use a query."""
    register(spark)
    maker = make if isinstance(make, str) else "pickle:" + base64.b64encode(cloudpickle.dumps(make)).decode()
    rows = spark.read.format(NAME).option("provider", maker).option("symbols_a_task", symbols_a_task).option("push_filters", str(push_filters).lower()).load()
    # A reader keeps the filters that it was given last; a filter that is always there gives each query a new one.
    return rows.where("symbol is not null")
