"""Operator 10: benchmark decontamination by spaced-seed hashing.

Words are runs of ASCII letters, digits and characters of other scripts, A-Z lower-cased. Fixed masks over SPAN
consecutive words keep WEIGHT positions and ignore the others; the hash of the kept words of every window of a
benchmark item and of a document is a seed. Seeds of documents are first tested against a bitmap of fixed size
made of all benchmark seeds. A seed with the words around it is a context; each distinct context of the documents that passes meets
each distinct one of the benchmark with its seed once, however many documents and items share them, and only what stands goes back
to documents and items. Around each hit the two texts are aligned word by word: the hit stands when, in a window of VERIFY words that holds the seed (the whole item if it is
shorter), at least AGREE of the words agree. Substituted words are thus tolerated.

Items below SHORT words get seeds by the shorter SHORT_MASKS too, so that substitutions which the check accepts leave a seed: of
all placements of 3 in 12 to 23 words every one does, of 4 in 16 to 18 words all but six in 1820 at worst; from 24 words on
the long masks miss 50 in 10626 placements of 4, and no fewer.

An item of MIN_WORDS to SPAN - 1 words must occur word for word; shorter ones, null and empty texts match nothing.
A row gets one row, contaminated or not; rows that share a doc_id count as one document, rows without one each by their text.
Repeated rows and ties need no order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NOT_WORD, U64, binary_array, chunks, give_back, mix64, powers, read, row_key, signed, small_batches, stash, word_hashes, words

SPAN = 12
MASKS = ("111111110000", "110110110110", "101101101101", "000011111111", "111000111011")
SHORT, SHORT_MASKS = 24, ("101010011", "110010101", "100111001", "110100011", "110001011")
MIN_WORDS = 6
VERIFY, AGREE = 16, 0.75
#: Bits of the bitmap of benchmark seeds.
BITMAP_BITS = 1 << 26

#: Numbers of the short masks, and of whole items of n words.
FIRST_SHORT, FIRST_EXACT = 100, 200

#: Words that a seed and what goes along for verifying can have.
WIDTH = max(len(m) + 2 * (VERIFY - len(m)) for m in (*MASKS, *SHORT_MASKS))

SEEDS = "id long, mask int, seed long, pos long, n_words long, before int, context binary"


def _windows(h: np.ndarray, doc: np.ndarray, span: int) -> np.ndarray:
    """Positions of windows of ``span`` words that lie in one document."""
    if len(h) < span:
        return np.zeros(0, np.int64)
    return np.flatnonzero(doc[: len(h) - span + 1] == doc[span - 1 :])


def _seed(h: np.ndarray, at: np.ndarray, mask: str, k: int) -> np.ndarray:
    p = powers(len(mask) + 1)
    total = np.full(len(at), U64(k + 1), U64)
    for j, bit in enumerate(mask):
        if bit == "1":
            total += h[at + j] * p[j]
    return mix64(total)


def seeds(docs: DataFrame, key: str, bitmap=None) -> DataFrame:
    """Seeds of every window with the hashed words around them; with a bitmap only those that it has."""
    small_batches(docs.sparkSession)
    masks = [*enumerate(MASKS), *enumerate(SHORT_MASKS, FIRST_SHORT), *((FIRST_EXACT + n, "1" * n) for n in range(MIN_WORDS, SPAN))]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, present = bitmap.value if bitmap is not None else (None, {k for k, _ in masks})
        for batch in batches:
            ids = np.asarray(batch.column("id"))
            for i, j, buf, offsets in chunks(batch):
                starts, ends, doc = words(buf, offsets, NOT_WORD)
                h = word_hashes(buf, starts, ends)
                first = np.searchsorted(doc, np.arange(j - i))
                n_words = np.bincount(doc, minlength=j - i)
                for k, mask in masks:
                    if k not in present:
                        continue
                    span = len(mask)
                    at = _windows(h, doc, span)
                    if bits is None and k >= FIRST_EXACT:  # short items only as a whole
                        at = at[n_words[doc[at]] == span]
                    elif bits is None and k >= FIRST_SHORT:
                        at = at[(n_words[doc[at]] >= SPAN) & (n_words[doc[at]] < SHORT)]
                    seed = _seed(h, at, mask, k)
                    if bits is not None:
                        cell = seed & U64(BITMAP_BITS - 1)
                        keep = bits[(cell >> U64(3)).astype(np.int64)] >> (cell & U64(7)).astype(np.uint8) & 1 > 0
                        at, seed = at[keep], seed[keep]
                    if not len(at):
                        continue
                    own = doc[at]
                    around = max(0, VERIFY - span)
                    low = np.maximum(at - around, first[own])
                    high = np.minimum(at + span + around, first[own] + n_words[own])
                    size = high - low
                    ctx = h[np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[i:j][own], pa.int64()), pa.array(np.full(len(at), k, np.int32)), pa.array(signed(seed)), pa.array(at - first[own]), pa.array(n_words[own].astype(np.int64)), pa.array((at - low).astype(np.int32)), binary_array(ctx, size)],
                        ["id", "mask", "seed", "pos", "n_words", "before", "context"],
                    )
        give_back()

    return docs.select(F.col(key).cast("long").alias("id"), "text").where("id is not null").mapInArrow(task, SEEDS)


def seed_bitmap(bench: DataFrame):
    """A broadcast bitmap of BITMAP_BITS bits of the benchmark's seeds, and the numbers of the masks that they are by."""
    spark = bench.sparkSession
    cell = F.col("seed").bitwiseAND(F.lit(BITMAP_BITS - 1))
    words_ = bench.groupBy((F.shiftrightunsigned(cell, 5)).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, int(seed & {31}))")).alias("bits")).toPandas()  # BITMAP_BITS / 32 rows at most
    bitmap = np.zeros(BITMAP_BITS // 32, "<u4")
    bitmap[words_["word"].to_numpy(dtype=np.int64)] = words_["bits"].to_numpy(dtype=np.int64).astype("<u4")
    present = {r[0] for r in bench.select("mask").distinct().collect()}  # a row a mask at most
    return spark.sparkContext.broadcast((bitmap.view(np.uint8), present))


def aligned(column: pa.Array, skip: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words of each row from word ``skip`` on, in ``width`` columns, and how many there are."""
    size = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]) // 8
    flat = np.frombuffer(b"".join(column.to_pylist()), U64)
    n = size - skip
    at = (np.cumsum(size) - size + skip)[:, None] + np.arange(width)
    return flat[np.minimum(at, max(len(flat) - 1, 0))], np.minimum(n, width)


def verify(hits: DataFrame) -> DataFrame:
    """(of, item_of, agreeing, window) of pairs of contexts that stand: words are aligned at the seed, and the best window counts."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            before, item_before, whole = (batch.column(c).to_numpy().astype(np.int64) for c in ("before", "item_before", "item_words"))
            back = np.minimum(before, item_before)
            a, n = aligned(batch.column("context"), before - back, WIDTH)
            b, m = aligned(batch.column("item_context"), item_before - back, WIDTH)
            n = np.minimum(n, m)
            size = np.where(whole < SPAN, whole, np.minimum(VERIFY, whole))
            need = np.where(whole < SPAN, whole, np.ceil(AGREE * size)).astype(np.int64)
            sums = np.zeros((len(n), WIDTH + 1), np.int64)
            np.cumsum((a == b) & (np.arange(WIDTH) < n[:, None]), axis=1, out=sums[:, 1:])
            start = np.arange(WIDTH)
            stop = start + size[:, None]
            agree = np.where(stop <= n[:, None], np.take_along_axis(sums, np.minimum(stop, WIDTH), axis=1) - sums[:, :WIDTH], -1).max(axis=1)
            keep = np.flatnonzero((agree >= need) & (n >= size))
            at = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column("of").take(at), batch.column("item_of").take(at), pa.array(agree[keep]), pa.array(size[keep])], ["of", "item_of", "agreeing", "window"])

    return hits.mapInArrow(task, "of binary, item_of binary, agreeing long, window long")


def with_context(rows: DataFrame, *more: str) -> DataFrame:
    """Seeds with ``of``, which names their context: the seed, the words around it and the columns ``more``."""
    name = F.concat_ws(" ", "mask", "seed", "before", *more, F.hex("context"))
    return rows.withColumn("of", F.unhex(F.sha2(name, 256)))


def overlaps(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """(doc_id, item_id, agreeing, window): one row per document and item that overlap."""
    own = stash(with_context(seeds(bench, "item_id"), "n_words"), "item_seeds")
    found = stash(with_context(seeds(docs, "doc_id", seed_bitmap(own))).drop("pos", "n_words"), "seeds")
    item = own.groupBy(F.col("of").alias("item_of")).agg(*[F.first(c).alias(n) for c, n in (("mask", "mask"), ("seed", "seed"), ("n_words", "item_words"), ("before", "item_before"), ("context", "item_context"))])
    context = found.groupBy("of").agg(*[F.first(c).alias(c) for c in ("mask", "seed", "before", "context")])
    stands = verify(context.join(item, ["mask", "seed"]))
    most = [F.max(c).alias(c) for c in ("agreeing", "window")]
    items = stands.join(own.select(F.col("of").alias("item_of"), F.col("id").alias("item_id")).distinct(), "item_of").groupBy("of", "item_id").agg(*most)
    return found.select("of", F.col("id").alias("doc_id")).distinct().join(items, "of").groupBy("doc_id", "item_id").agg(*most)


def contamination(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """Per document: contaminated, the number of items it overlaps, the smallest such item, most agreeing words."""
    rows = docs.select("doc_id", "text", row_key().alias("key"))
    found = overlaps(rows.select(F.col("key").alias("doc_id"), "text"), bench).groupBy(F.col("doc_id").alias("key")).agg(F.count("*").alias("n_items"), F.min("item_id").alias("item_id"), F.max("agreeing").alias("agreeing"))
    rows = rows.select("doc_id", "key").join(found, "key", "left")
    return rows.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), "item_id", F.coalesce("agreeing", F.lit(0)).alias("agreeing"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
