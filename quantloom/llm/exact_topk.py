"""Operator 5: exact top-k by inner product as a Voronoi kNN join.

Vectors become integers floor(64 * x). With M the largest norm, a data vector y gets one more component
sqrt(M^2 - |y|^2) and a query q a zero, so that the largest inner products are the smallest Euclidean distances.
Queries are grouped by their nearest pivot (a bounded sample of the data). From summaries, i.e. the k + 1 smallest
distances to each pivot and the interval of a group's distances to every pivot, each group of queries gets a bound on
its k-th distance; a data vector is copied only to the groups whose bound it can meet by the triangle inequality. Groups
whose bounds let nearly the same vectors through (judged on a bounded sample) are solved as one, so that a vector is not
copied to both. Groups are solved block by block: a task holds at most QUERY_BLOCK queries and about DATA_BLOCK vectors, and the
blocks' best k are merged for each query. Bounds carry a margin for rounding; scores are exact integers.

Null ids, null vectors and vectors that hold null or non-finite components take no part. Components are 64-bit integers
and scores are ranked exactly whatever their size; a component or score beyond 64 bits is returned as the bound of that
type. Shorter vectors count as padded with zeros. Ties go to the smaller vec_id; rows that share a query's id count as its own
row, and repeated rows count each. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read, small_batches, stash

TOP_K = 20
QUERY_STEP = 20
SCALE = 64
MAX_PIVOTS = 64
QUERY_BLOCK = 2048
DATA_BLOCK = 8192
#: Vectors that groups are compared on, and what joint groups may cost more in comparisons.
SAMPLE, WORSE = 2000, 1.1
INT64 = np.iinfo(np.int64)


def quantized(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of long), norm2 (double), most (the largest magnitude) of the vectors that take part."""
    x = F.col("embedding")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    rows = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & ~bad).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))
    sums = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    return rows.withColumns({"norm2": sums, "most": F.aggregate("v", F.lit(0.0), lambda a, c: F.greatest(a, F.abs(c.cast("double"))))})


def _matrix(column: pa.Array, dim: int, kind: type = np.float64) -> np.ndarray:
    """Rows padded with zeros to ``dim`` components."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy().astype(kind)
    if len(values) == len(column) * dim:
        return values.reshape(-1, dim)
    out = np.zeros((len(column), dim), kind)
    out[np.arange(dim) < lengths[:, None]] = values
    return out


def _lift(v: np.ndarray, top: float | None) -> np.ndarray:
    extra = np.zeros(len(v)) if top is None else np.sqrt(np.maximum(top - (v * v).sum(axis=1), 0))
    return np.concatenate([v, extra[:, None]], axis=1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T), 0))


def joint_groups(kept: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
    """The number of the joint group of each group, from (vector, group) marks on a sample and the groups' queries.

    Two groups become one where that costs hardly more comparisons; it always saves copies. ``most``: queries of a joint group.
    """
    marks, n, label = [kept[:, g] for g in range(kept.shape[1])], sizes.astype(float).tolist(), np.arange(kept.shape[1])
    alive = list(range(len(marks)))
    while True:
        best = None
        for i, g in enumerate(alive):
            for h in alive[i + 1 :]:
                if n[g] + n[h] <= most:
                    both = int((marks[g] | marks[h]).sum())
                    apart = marks[g].sum() * n[g] + marks[h].sum() * n[h]
                    if both * (n[g] + n[h]) <= WORSE * apart:
                        saved = marks[g].sum() + marks[h].sum() - both
                        if best is None or saved > best[0]:
                            best = saved, g, h
        if best is None:
            return np.searchsorted(np.array(alive), label)
        _, g, h = best
        marks[g], n[g] = marks[g] | marks[h], n[g] + n[h]
        alive.remove(h)
        label[label == h] = g


def scores(x: np.ndarray, y: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products of integer rows; ``most`` bounds them. Doubles, 64-bit integers or Python's, whichever is large enough."""
    if most < 2**52:
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    if most < 2**62:
        return x @ y.T
    return x.astype(object) @ y.astype(object).T


def best_rows(score: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Mask of each row's k best columns that are not its ``own`` row; ties to the first. Fewer if there are not so many."""
    if score.dtype == object:
        order = np.array([sorted(range(len(r)), key=lambda j: (o[j], -r[j], j)) for r, o in zip(score, own, strict=True)])[:, :k]
        out = np.zeros(score.shape, bool)
        np.put_along_axis(out, order, True, axis=1)
        return out & ~own
    score = np.where(own, INT64.min, score)
    if score.shape[1] <= k:
        return ~own
    kth = np.partition(score, score.shape[1] - k, axis=1)[:, -k][:, None]
    out = score > kth
    ties = score == kth
    return (out | ties & (np.cumsum(ties, axis=1) <= k - out.sum(axis=1, keepdims=True))) & ~own


def exact_top_k(vectors: DataFrame, is_query: F.Column, k: int = TOP_K, data_block: int = DATA_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best other rows."""
    spark = vectors.sparkSession
    small_batches(spark)
    data = stash(quantized(vectors), "vectors")
    queries = data.where(is_query)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    n, dim, top, most = data.agg(F.count("*"), F.max(F.size("v")), F.max("norm2"), F.max("most")).first()
    n_queries = queries.count()
    if not n or not n_queries:
        return empty
    dim = max(1, dim)  # all vectors may be empty
    kind = "array<int>" if most < 2**31 - 1 else "array<long>"
    data, queries = (t.select("vec_id", F.col("v").cast(kind).alias("v")) for t in (data, queries))
    wide = most * most * dim >= 2**62
    n_pivots = max(4, min(MAX_PIVOTS, int(math.sqrt(n_queries) / 3)))
    sample = data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(SAMPLE, n_pivots)).toArrow()
    sampled = _lift(_matrix(sample.column("v"), dim), top)
    pivots = np.unique(sampled[:n_pivots], axis=0)
    shared = spark.sparkContext.broadcast(pivots)
    margin = 1e-6 * (1 + math.sqrt(top))
    blocks = max(1, -(-n // data_block))

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k + 1 smallest distances to each pivot in its own cell."""
        nearest: dict[int, np.ndarray] = {}
        for batch in batches:
            d = _distances(_lift(_matrix(batch.column("v"), dim), top), shared.value)
            cell = d.argmin(axis=1)
            for c in np.unique(cell):
                nearest[c] = np.sort(np.concatenate([nearest.get(c, np.zeros(0)), d[cell == c, c]]))[: k + 1]
        for c, x in nearest.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c, np.int32)), pa.array(x)], ["cell", "d"])

    close = data.select("v").mapInArrow(summarise, "cell int, d double")
    close = close.withColumn("r", F.row_number().over(W.partitionBy("cell").orderBy("d"))).where(F.col("r") <= k + 1).select("cell", "d").toPandas()  # (k + 1) rows a pivot

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Nearest pivot of each query, the bound on its k-th distance, and its distances to the pivots."""
        for batch in batches:
            d = _distances(_lift(_matrix(batch.column("v"), dim), None), shared.value)
            reach = d[:, close["cell"].to_numpy()] + close["d"].to_numpy()
            bound = np.partition(reach, k, axis=1)[:, k] if reach.shape[1] > k else np.full(len(d), np.inf)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1, dtype=np.int32) * d.shape[1]), pa.array(d.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(d.argmin(axis=1).astype(np.int32)), pa.array(bound), flat], ["query_id", "q", "cell", "bound", "d"])

    grouped = stash(queries.mapInArrow(group, f"query_id long, q {kind}, cell int, bound double, d array<double>"), "queries")
    ends = [f(F.col("d")[j]).alias(f"{name}{j}") for j in range(len(pivots)) for f, name in ((F.min, "lo"), (F.max, "hi"))]
    cells = grouped.groupBy("cell").agg(F.count("*").alias("n"), F.max("bound").alias("bound"), *ends).orderBy("cell").toPandas()  # a row a pivot
    low = cells[[f"lo{j}" for j in range(len(pivots))]].to_numpy()
    high = cells[[f"hi{j}" for j in range(len(pivots))]].to_numpy()
    bounds = cells["bound"].to_numpy() + margin
    ids, sizes = cells["cell"].to_numpy(), cells["n"].to_numpy()

    def reached(v: np.ndarray) -> np.ndarray:
        """Marks (vector, group of queries): whether the vector can be among the k best there."""
        d = _distances(v, shared.value)
        return np.maximum(d[:, None, :] - high, low - d[:, None, :]).max(axis=2) <= bounds

    joint = joint_groups(reached(sampled), sizes, query_block)
    total = np.bincount(joint, sizes).astype(np.int64)
    subs = np.maximum(1, -(-total // query_block))

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each part of each joint group of queries that a vector can serve."""
        for batch in batches:
            near = reached(_lift(_matrix(batch.column("v"), dim), top))
            marks = np.zeros((len(near), len(total)), bool)
            for g, j in enumerate(joint):
                marks[:, j] |= near[:, g]
            row, col = np.nonzero(marks)
            times = subs[col]
            sub = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
            row, col = np.repeat(row, times), np.repeat(col, times)
            at = pa.array(row)
            block = np.asarray(batch.column("block"))[row]
            yield pa.RecordBatch.from_arrays([pa.array(col.astype(np.int32)), pa.array(sub.astype(np.int32)), pa.array(block), batch.column("vec_id").take(at), batch.column("v").take(at)], ["part", "sub", "block", "vec_id", "v"])

    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block")
    candidates = data.select("vec_id", "v", block).mapInArrow(replicate, f"part int, sub int, block int, vec_id long, v {kind}")
    part_of = F.create_map(*[F.lit(int(x)) for c, j in zip(ids, joint, strict=True) for x in (c, j)])
    subs_of = F.create_map(*[F.lit(int(x)) for j, m in enumerate(subs) for x in (j, m)])
    asked = grouped.withColumn("part", part_of[F.col("cell")]).withColumn("sub", F.pmod(F.xxhash64("query_id"), subs_of[F.col("part")]).cast("int"))
    asked = asked.select("part", "sub", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "query_id", "q")

    def solve(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "high": [], "low": []})
        c = c.sort_values("vec_id")
        own = c["vec_id"].to_numpy()
        y, x = _matrix(pa.array(c["v"]), dim, np.int64), _matrix(pa.array(q["q"]), dim, np.int64)
        asks, out = q["query_id"].to_numpy(), []
        limit = float(np.abs(y.astype(float)).max(initial=0)) * float(np.abs(x.astype(float)).max(initial=0)) * dim
        for i in range(0, len(x), 128):
            score = scores(x[i : i + 128], y, limit)
            r, b = np.nonzero(best_rows(score, asks[i : i + 128, None] == own, k))
            found = score[r, b]
            if found.dtype == object:
                # The exact value goes along in two parts, for ranking; what 64 bits cannot hold is cut only in the result.
                halves = [divmod(int(s), 1 << 64) for s in found]
                out.append(pd.DataFrame({"query_id": asks[i + r], "vec_id": own[b], "score": [min(max(int(s), INT64.min), INT64.max) for s in found], "high": [str(h) for h, _ in halves], "low": [str(x) for _, x in halves]}))
            else:
                out.append(pd.DataFrame({"query_id": asks[i + r], "vec_id": own[b], "score": found, "high": [str(s >> 63 >> 1) for s in found.tolist()] if wide else None, "low": [str(s & (1 << 64) - 1) for s in found.tolist()] if wide else None}))
        return pd.concat(out)

    keys = ["part", "sub", "block"]
    partial = asked.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInPandas(solve, "query_id long, vec_id long, score long, high string, low string")
    # Sums of products of 64-bit components have more than 38 digits: the parts above and below 2**64 are ranked one after the other.
    order = [*([F.desc(F.col(c).cast("decimal(38, 0)")) for c in ("high", "low")] if wide else [F.desc("score")]), F.col("vec_id")]
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(*order)).cast("int")
    return partial.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_STEP == 0)
