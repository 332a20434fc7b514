"""Shared pieces: tables written for reuse, Arrow text buffers, vectorised word hashing, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows and bytes that an Arrow batch carries to Python, and rows of a batch that a Parquet reader makes.
BATCH_ROWS, BATCH_BYTES, READ_ROWS = 1000, 4 << 20, 512
#: Bytes of text that one vectorised step handles (a longer document is handled alone).
CHUNK_BYTES = 300_000

U64 = np.uint64
_local: list[str] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def give_back() -> None:
    """Hand freed memory back to the system at the end of a task: its worker lives on and counts as the executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def row_key() -> F.Column:
    """doc_id as a long; of a row without one a hash of its text, so that rows without ids are told apart by their texts."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit("no id"), F.coalesce("text", F.lit(""))))


def small_batches(spark: SparkSession) -> None:
    """Bounds on what a task holds at a time, so that long documents do not need much memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares: ``spark.checkpoint.dir``; where that is unset the warehouse, and on a local master a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and spark.sparkContext.master.startswith("local["):
        if _local[:1] != [spark.sparkContext.applicationId]:
            _local[:] = [spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-")]
        where = _local[1]
    return where or f"{spark.conf.get('spark.sql.warehouse.dir')}/written"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, group: list[str], order: list[F.Column], keep: list[str]) -> DataFrame:
    """``keep`` and, of each row, its place ``i`` from 0 in its group by ``order``, and the group's number of rows ``n``; null is a group too.

    Rows are sorted by ranges, so a group of any size lies over many tasks, and a row's place is the rows of its group in earlier tasks plus
    those before it in its own. The input's order of rows must be the same each time it is read, as that of a table is: it parts equal rows.
    """
    keys = [F.col(c).asc_nulls_first() for c in group] + order
    rows = df.withColumn("_tie", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*keys, F.col("_tie")).sortWithinPartitions(*keys, "_tie").select(*dict.fromkeys([*group, *keep]), F.monotonically_increasing_id().alias("_at"))
    rows = stash(rows, "ranged").withColumn("_task", F.shiftright("_at", 33))
    tasks = rows.groupBy(*group, "_task").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    by = W.partitionBy(*group)
    before = F.sum("_rows").over(by.orderBy("_task").rowsBetween(W.unboundedPreceding, 0)) - F.col("_rows")
    tasks = tasks.select(*[F.col(c).alias(f"_{c}") for c in group], F.col("_task").alias("__task"), (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(by).alias("n"))
    same = F.col("_task") == F.col("__task")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(tasks, same).select(*keep, (F.col("_at") + F.col("_shift")).alias("i"), "n")


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def chunks(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of parts of a batch."""
    buf, offsets = text_buffer(batch.column(column))
    for i, j in runs(offsets):
        yield i, j, buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: A 64-bit value for each byte, and an odd base for positions.
BYTE64 = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
BASE = U64(0x9E3779B97F4A7C15 | 1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Everything but ASCII letters, digits and bytes of other scripts.
NOT_WORD = np.ones(256, bool)
NOT_WORD[48:58] = NOT_WORD[65:91] = NOT_WORD[97:123] = NOT_WORD[128:] = False

_powers = np.ones(1, U64)


def powers(n: int) -> np.ndarray:
    """BASE ** 0 .. n - 1, modulo 2 ** 64."""
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate([[U64(1)], np.cumprod(np.full(max(n, 4096) - 1, BASE, U64), dtype=U64)])
    return _powers[:n]


BASE_INVERSE = U64(pow(int(BASE), -1, 1 << 64))
_inverse = np.ones(1, U64)


def inverse_powers(n: int) -> np.ndarray:
    """BASE ** -i for i = 0 .. n - 1, modulo 2 ** 64."""
    global _inverse
    if len(_inverse) < n:
        _inverse = np.concatenate([[U64(1)], np.cumprod(np.full(max(n, 4096) - 1, BASE_INVERSE, U64), dtype=U64)])
    return _inverse[:n]


def words(buf: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and the document (row) of every word in a chunk of whole documents."""
    n = len(buf)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~gaps[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = LOWER) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased by ``fold``: a polynomial over per-byte random values."""
    if not len(starts):
        return np.zeros(0, U64)
    out = np.empty(len(starts), U64)
    values, at = BYTE64[fold], 0
    while at < len(starts):  # parts of about CHUNK_BYTES, for very long texts
        low = int(starts[at])
        stop = max(at + 1, int(np.searchsorted(ends, low + CHUNK_BYTES, "right")))
        part = buf[low : int(ends[stop - 1])]
        sums = np.zeros(len(part) + 1, U64)
        np.cumsum(values[part] * powers(len(part)), dtype=U64, out=sums[1:])
        first = starts[at:stop] - low
        out[at:stop] = (sums[ends[at:stop] - low] - sums[first]) * inverse_powers(len(part))[first]
        at = stop
    return mix64(out + (ends - starts).astype(U64))


class Table:
    """Open-addressing table from 64-bit keys (never 0) to row numbers from 0 in order of adding, filled and looked up in bulk."""

    def __init__(self, keys: np.ndarray, room: int = 0):
        size = 1 << max(4, int(2 * max(len(keys), room) + 1).bit_length())
        self.mask = U64(size - 1)
        self.keys, self.rows, self.n = np.zeros(size, U64), np.full(size, -1, np.int32), 0
        self.add(keys)

    def add(self, keys: np.ndarray) -> None:
        """Add distinct keys that are not there; the table must have been made with room for them."""
        left, slot = np.arange(len(keys)), mix64(keys) & self.mask
        while len(left):
            free = np.flatnonzero(self.keys[slot] == 0)
            at, first = np.unique(slot[free], return_index=True)
            mine = left[free[first]]
            self.keys[at], self.rows[at] = keys[mine], self.n + mine
            stay = np.ones(len(left), bool)
            stay[free[first]] = False
            left, slot = left[stay], slot[stay] + U64(1) & self.mask
        self.n += len(keys)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, or -1."""
        slot = mix64(keys) & self.mask
        seen = self.keys[slot]
        out = np.where(seen == keys, self.rows[slot], -1)
        todo = np.flatnonzero((seen != keys) & (seen != 0))
        while len(todo):
            s = slot[todo] = slot[todo] + U64(1) & self.mask
            seen = self.keys[s]
            hit = seen == keys[todo]
            out[todo[hit]] = self.rows[s[hit]]
            todo = todo[~hit & (seen != 0)]
        return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Consecutive values as one list a row."""
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


def binary_array(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Consecutive fixed-width values as one binary a row; counts in values."""
    ends = (np.concatenate([[0], np.cumsum(counts)]) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge table: (node, component), component the smallest node reachable.

    Alternating large-star and small-star steps: each step replaces the edges by at most as many others, and each
    groups by a node after a map-side minimum, so that a hub costs one aggregated row a task, not one task.
    """
    now = stash(edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo < hi").distinct(), "edges")
    size = now.count()
    # The edges shrink from step to step: few rows are read and written by few tasks.
    parts = max(4, size // 500_000)
    now = now.coalesce(parts)
    while size:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo < hi").distinct()
        large = stash(large.coalesce(parts), "large")
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi")
        nxt = small.select(F.col("m").alias("lo"), F.col("hi")).union(small.where("lo <> m").select(F.col("m").alias("lo"), F.col("lo").alias("hi"))).where("lo < hi").distinct()
        nxt = stash(nxt.coalesce(parts), "edges")
        before, size = size, nxt.count()
        done = size == before and nxt.join(now, ["lo", "hi"], "left_semi").count() == size
        now = nxt
        if done:
            break
    stars = now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return stash(stars.union(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()).coalesce(parts), "components")


BITMAP_BITS = 1 << 26


def id_bitmap(ids: DataFrame, column: str, hashed: bool = True):
    """A broadcast bitmap of BITMAP_BITS bits (8 MB whatever the input) that ``in_bitmap`` tests ids against.

    Not ``hashed``: the column holds bit numbers. It has no false negatives; as it fills up, it lets more pass, and the join that follows drops those.
    """
    spark = ids.sparkSession
    cell = cell_of(column) if hashed else F.col(column)
    rows = ids.select(cell.alias("c")).groupBy((F.shiftright("c", 5)).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(c & 31))")).alias("bits")).toArrow()
    bitmap = np.zeros(BITMAP_BITS // 32, "<u4")
    bitmap[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().astype("<u4")
    return spark.sparkContext.broadcast(bitmap.view(np.uint8))


def in_bitmap(bitmap: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return bitmap[cells >> 3] >> (cells & 7).astype(np.uint8) & 1 > 0


def cell_of(column: str) -> F.Column:
    return F.pmod(F.xxhash64(column), F.lit(BITMAP_BITS))


class PrefixHash:
    """Polynomial hashes of all substrings of a buffer from the hashes of its prefixes."""

    def __init__(self, buf: np.ndarray):
        self.sums = np.zeros(len(buf) + 1, U64)
        np.cumsum(BYTE64[buf] * powers(len(buf)), dtype=U64, out=self.sums[1:])
        self.inverse = inverse_powers(len(buf) + 1)

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.inverse[start]
