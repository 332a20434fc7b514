"""Operator 6: language identification by rank-order n-gram profiles.

A text's letters (A-Z lower-cased, other scripts by simple case folding) form words; every run of anything else is
one blank, and blanks stand at both ends. Its n-grams of 1 to 3 characters are ranked by frequency, ties by n-gram.
The profile of a language is the ranking of the n-grams of all its training texts together. A document gets the
language whose profile its own best ``TOP`` n-grams are least out of place against; an n-gram that a profile lacks
is TOP places out. The score is the share of the largest possible distance that was saved.

Null or empty texts, and texts without letters, are ``und`` with score 0. Ties go to the language first in order.
Without any training row everything is ``und``. Rows without doc_id do not train. Rows are not merged: repeated rows each get their prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, give_back, read, small_batches, stash

TOP = 400
#: Bits of a character in an n-gram.
BITS = 18
UNKNOWN = "und"


def _table() -> np.ndarray:
    """Class of each code point below 0x30000: 0 for what is no letter, else its folded code point."""
    out = np.zeros(0x30000, np.uint64)
    for cp in range(0x30000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            out[cp] = ord(low[0])
    return out


_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    if not _classes:
        _classes.append(_table())
    return _classes[0]


def ranked(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text and their counts, in order of n-gram; none without letters."""
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    table = classes()
    kinds = table[np.minimum(cps, len(table) - 1)]
    padded = np.zeros(len(kinds) + 2, np.uint64)
    padded[1:-1] = kinds
    keep = np.ones(len(padded), bool)
    keep[1:] = (padded[1:] > 0) | (padded[:-1] > 0)
    c = padded[keep]
    if len(c) < 2 or not c.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if c[-1]:
        c = np.append(c, U64(0))
    pairs = c[:-1] << U64(BITS) | c[1:]
    one = c[c > 0] | U64(1 << 3 * BITS)
    two = pairs | U64(2 << 3 * BITS)
    three = (c[:-2] << U64(2 * BITS) | pairs[1:])[c[1:-1] > 0]
    grams = np.concatenate([one, two, three])
    grams.sort()
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[first], np.diff(np.append(first, len(grams)))


def best(grams: np.ndarray, counts: np.ndarray, top: int = TOP) -> np.ndarray:
    """The ``top`` most frequent n-grams in order of rank."""
    order = np.argsort(-counts, kind="stable")[:top]
    return grams[order]


def is_held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def profiles(docs: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, gram, rank) of the most frequent n-grams of each language's training texts."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            keys = np.concatenate([p[0] for p in parts])
            grams, inverse = np.unique(keys, return_inverse=True)
            return grams, np.bincount(inverse, np.concatenate([p[1] for p in parts])).astype(np.int64)

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                got = sums.setdefault(lang, [])
                got.append(ranked(text or ""))
                if len(got) >= 200:
                    sums[lang] = [merged(got)]
        for lang, parts in sums.items():
            grams, n = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])
        sums.clear()
        give_back()

    learned = docs.where(~is_held_out() & F.col("lang").isNotNull()).select("lang", "text")
    counted = learned.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # A window group is a language's distinct n-grams, of which the alphabet allows a fixed number.
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return counted.withColumn("rank", rank - 1).where(F.col("rank") < top).select("lang", "gram", "rank")


def identify(docs: DataFrame, learned: DataFrame, top: int = TOP) -> DataFrame:
    """``docs`` with lang_pred and score added; columns of ``docs`` with these names give way."""
    spark = docs.sparkSession
    small_batches(spark)
    table = learned.toPandas()  # top rows a language
    langs = sorted(table["lang"].unique())
    grams = np.sort(table["gram"].unique()).astype(np.uint64)
    ranks = np.full((len(langs), len(grams) + 1), -1, np.int32)
    for i, lang in enumerate(langs):
        own = table[table["lang"] == lang]
        ranks[i, np.searchsorted(grams, own["gram"].to_numpy().astype(np.uint64))] = own["rank"]
    model = spark.sparkContext.broadcast((langs, grams, ranks))
    docs = docs.drop("lang_pred", "score")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, grams, ranks = model.value
        for batch in batches:
            names, scores = [], []
            for text in batch.column("text").to_pylist():
                own = best(*ranked(text or ""), top) if langs else ()
                if not len(own):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                at = np.searchsorted(grams, own)
                at[(at == len(grams)) | (grams[np.minimum(at, len(grams) - 1)] != own)] = len(grams)
                places = ranks[:, at]
                out = np.where(places < 0, top, np.abs(places - np.arange(len(own)))).sum(axis=1)
                names.append(langs[int(out.argmin())])
                scores.append(max(0.0, 1.0 - float(out.min()) / (top * len(own))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])
        give_back()

    return docs.mapInArrow(score, schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    learned = stash(profiles(docs), "profiles")
    return identify(docs.select("doc_id", "text"), learned).select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score")
