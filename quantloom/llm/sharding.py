"""Operator 4: minimax contiguous partition of atomic groups into shards.

Equal texts form one atomic group. Groups are ordered by a hash of their text and cut into consecutive shards so
that the largest shard is as small as possible: a binary search over the capacity, each candidate checked greedily. Under
that capacity every cut is laid as near as it can be to an equal share of what is left, so that no shard starves.

The driver never sees the groups. It sees totals of hash ranges (segments): an upper bound on the best capacity
comes from segments taken as atomic, a lower bound from the mean and the largest group, and only the segments in
which a cut can still fall are split further, by another aggregation, until each of them is a single group.

Null text counts as empty. Repeated rows and rows without doc_id are rows like others. Empty tables give no rows. Equal sizes are ordered by hash, rows of a shard by
(bucket, doc_id). A group above the mean shard size gets a shard of its own.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read, stash

SHARDS = 24
HASH_BITS = 60
#: Each refinement splits a segment into 2 ** STEP_BITS.
STEP_BITS = 10
#: Rows that are numbered together, about: no task numbers a whole shard.
CELL_ROWS = 20_000

Segment = tuple[int, int, int, int]  # first hash, width in bits, bytes, groups


def greedy(prefix: list[int], capacity: int, shards: int) -> list[int] | None:
    """Cut positions (ends) of consecutive items under a capacity, or None if more than ``shards`` are needed."""
    cuts, at, n = [], 0, len(prefix) - 1
    while at < n:
        end = bisect.bisect_right(prefix, prefix[at] + capacity) - 1
        if end <= at or len(cuts) == shards:
            return None
        cuts.append(end)
        at = end
    return cuts


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """Binary search for the smallest capacity that a greedy pass can keep with ``shards`` consecutive parts."""
    prefix = [0]
    for s in sizes:
        prefix.append(prefix[-1] + s)
    low, high = max([0, *sizes, -(-prefix[-1] // shards)]), prefix[-1]
    while low < high:
        mid = (low + high) // 2
        if greedy(prefix, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low


def _segments(groups: DataFrame, ranges: list[tuple[int, int]] | None, bits: int) -> list[Segment]:
    """Totals of hash ranges of ``bits`` bits, of the whole table or inside wider ranges."""
    cell = F.shiftrightunsigned("g", bits)
    rows = groups
    if ranges is not None:
        wide = bits + STEP_BITS
        rows = groups.where(F.shiftrightunsigned("g", wide).isin([first >> wide for first, _ in ranges]))
    out = rows.groupBy(cell.alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
    return sorted((r.cell << bits, bits, int(r.bytes), int(r.n)) for r in out.collect())


def level_cuts(prefix: list[int], capacity: int, shards: int) -> list[int]:
    """Cuts (ends) of ``shards`` consecutive parts under a feasible capacity, each as near to an equal share of the rest as possible.

    An end is late enough for the parts after it, and early enough for its own.
    """
    n, first = len(prefix) - 1, [len(prefix) - 1]
    for _ in range(shards - 1):  # the earliest ends, from the back
        first.append(bisect.bisect_left(prefix, prefix[first[-1]] - capacity))
    cuts, at = [], 0
    for k in range(1, shards):
        low, high = max(at, first[shards - k]), bisect.bisect_right(prefix, prefix[at] + capacity) - 1
        goal = prefix[at] + (prefix[n] - prefix[at]) / (shards - k + 1)
        end = bisect.bisect_left(prefix, goal)
        if end and goal - prefix[end - 1] <= prefix[min(end, n)] - goal:
            end -= 1
        at = min(max(end, low), high)
        cuts.append(at)
    return [*cuts, n]


def cut_points(groups: DataFrame, shards: int) -> list[int]:
    """First hash of each shard but the first, for groups (g, bytes)."""
    bits = HASH_BITS - STEP_BITS
    segments = _segments(groups, None, bits)
    largest = groups.agg(F.max("bytes")).first()[0] or 0
    while segments:
        sizes = [s[2] for s in segments]
        prefix = [0]
        for s in sizes:
            prefix.append(prefix[-1] + s)
        low = max(largest, -(-prefix[-1] // shards))
        high = smallest_capacity(sizes, shards)
        splits = lambda i: segments[i][3] > 1 and segments[i][1] > 0  # noqa: B023, E731
        # The k-th cut lies at or beyond where whole segments under the lower bound end, and within k * upper bound.
        wanted, at = set(), 0
        for k in range(1, shards):
            end = max(at, bisect.bisect_right(prefix, prefix[at] + low) - 1)
            last = min(bisect.bisect_left(prefix, k * high + 1), len(segments))
            wanted.update(i for i in range(end, last) if splits(i))
            at = end
        if not wanted:
            # The capacity is settled; segments beside the cuts may still hold a better place.
            cuts = level_cuts(prefix, high, shards)
            wanted = {i for c in cuts[:-1] for i in (c - 1, c) if 0 <= i < len(segments) and splits(i)}
            if not wanted:
                return [segments[c][0] if c < len(segments) else 1 << HASH_BITS for c in cuts[:-1]]
        by_bits: dict[int, list[tuple[int, int]]] = {}
        for i in wanted:
            by_bits.setdefault(segments[i][1], []).append(segments[i][:2])
        kept = [s for i, s in enumerate(segments) if i not in wanted]
        for width, ranges in by_bits.items():
            kept += _segments(groups, ranges, max(0, width - STEP_BITS))
        segments = sorted(kept)
    return []


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    text = F.coalesce("text", F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long").alias("g"))
    rows = stash(sized, "sizes")
    groups = stash(rows.groupBy("g").agg(F.sum("size").alias("bytes")), "groups")
    giants, free, total = [], shards, groups.agg(F.sum("bytes")).first()[0] or 0
    # At most one group a shard can exceed the mean of what is left.
    for r in groups.orderBy(F.desc("bytes"), "g").limit(shards - 1).collect():
        if r.bytes * free <= total:
            break
        giants.append(r.g)
        free, total = free - 1, total - r.bytes
    rest = groups.where(~F.col("g").isin(giants)) if giants else groups
    cuts = cut_points(rest, free)
    shard = F.lit(len(giants)) + sum((F.when(F.col("g") >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    for i, g in enumerate(giants):
        shard = F.when(F.col("g") == g, i).otherwise(shard)
    cells = max(1, rows.count() // (shards * CELL_ROWS))
    placed = rows.withColumn("shard", shard.cast("int")).withColumn("cell", F.pmod(F.xxhash64("doc_id", "g"), F.lit(cells)))
    # A row for each cell, i.e. for about CELL_ROWS rows.
    before = placed.groupBy("shard", "cell").agg(F.count("*").alias("n")).select("shard", "cell", (F.sum("n").over(W.partitionBy("shard").orderBy("cell")) - F.col("n")).alias("before"))
    slot = F.row_number().over(W.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32")) - 1
    return placed.withColumn("in_cell", slot).join(before, ["shard", "cell"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("in_cell")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read(spark, sf_dir, "documents"))
