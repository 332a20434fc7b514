"""Operator 3: language-model scoring by prediction by partial matching (PPM).

The text of a document is its words (A-Z lower-cased), single blanks between them and one end symbol. The model is a
byte-context trie up to ORDER bytes, built from the training texts: each node counts the bytes that followed a
context. A byte is coded in the longest context seen; a context in which it never occurred gives its escape mass,
distinct / (distinct + count), and the bytes it knows are excluded in the next shorter one, down to a uniform
distribution over the bytes still possible. A document's score is the log10 probability of all its bytes.

What a context knows, its suffix knows too, so exclusion depends only on the context just escaped from: totals,
escapes and excluded mass are precomputed once per node. The trie is whole, whatever its size. Tasks get the scores of
the frequent runs of ORDER + 1 bytes (at most MAX_NODES); the distinct other runs are coded where their part of the trie
is: all nodes above level SHARED that a run can meet end their contexts in the same SHARED bytes, so the trie is dealt
out by those, and only the levels below, which the alphabet bounds, go to every part. Scores are joined back to the rows.

The unigram base counts words and one end token a text, exactly; the counts of frequent words are sent to the tasks
(at most MAX_WORDS), the other words are joined. Words are told apart by 64-bit hashes.

Null texts are empty: one end token. Rows are scored one by one, repeated or not; op3 never trains on rows without doc_id. Without training rows the model is
uniform over bytes, N and V are 0.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, U64, Table, chunks, list_array, mix64, read, signed, small_batches, stash, word_hashes, words

ORDER = 5
MAX_NODES = 1_000_000
#: Bytes before a symbol that the trie is dealt out by.
SHARED = 3
#: Runs of bytes of a part of the trie, about.
PART_RUNS = 100_000
MAX_WORDS = 500_000
#: Distinct keys that a counting task keeps before it hands them on.
MAX_HELD = 1_000_000
END_BYTE = 10
#: The last model a worker has made ready, by name.
_ready: dict[str, tuple] = {}
END_WORD = int(mix64(np.array([END_BYTE], U64))[0])


def symbols(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """For every symbol the last ORDER + 1 bytes as an integer, and its document. Texts start after ORDER end bytes."""
    sizes = ends - starts + 1
    n_words = np.bincount(doc, minlength=n_docs)
    totals = np.bincount(doc, sizes, minlength=n_docs).astype(np.int64)
    totals[n_words == 0] = 1
    base = np.cumsum(totals + ORDER) - totals
    out = np.full(int(totals.sum()) + ORDER * n_docs, END_BYTE, np.uint8)
    if len(starts):
        at = np.cumsum(sizes) - sizes
        first = np.concatenate([[0], np.cumsum(totals * (n_words > 0))])[doc]
        place = base[doc] + at - first
        length = ends - starts
        inside = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        out[inside + np.repeat(place, length)] = LOWER[buf[inside + np.repeat(starts, length)]]
        more = np.flatnonzero(doc[1:] == doc[:-1])
        out[place[more] + length[more]] = 32
    real = np.ones(len(out), bool)
    real[(base[:, None] - np.arange(1, ORDER + 1)).ravel()] = False
    pos = np.flatnonzero(real)
    gram = np.zeros(len(pos), U64)
    for k in range(ORDER, -1, -1):
        gram = gram << U64(8) | out[pos - k]
    return gram, np.repeat(np.arange(n_docs), totals)


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def counts(docs: DataFrame) -> DataFrame:
    """(kind, key, n): kind 0 words, kind 1 runs of ORDER + 1 bytes, over whole texts."""
    small_batches(docs.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]

        def out(kind: int, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(keys), 100_000):
                k = keys[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(signed(k)), pa.array(n[i : i + 100_000])], ["kind", "key", "n"])

        for batch in batches:
            for i, j, buf, offsets in chunks(batch):
                starts, ends, doc = words(buf, offsets)
                gram, _ = symbols(buf, starts, ends, doc, j - i)
                for kind, keys in enumerate((word_hashes(buf, starts, ends), gram)):
                    if kind == 0:
                        keys = np.append(keys, np.full(j - i, END_WORD, U64))
                    got, n = np.unique(keys, return_counts=True)
                    held[kind].append((got, n.astype(np.int64)))
                    if sum(len(x[0]) for x in held[kind]) > MAX_HELD:
                        held[kind] = [_merge(held[kind])]
                        if len(held[kind][0][0]) > MAX_HELD // 2:
                            yield from out(kind, *held[kind].pop())
        for kind, parts in enumerate(held):
            if parts:
                yield from out(kind, *_merge(parts))

    return docs.select("text").mapInArrow(task, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def least_count(table: DataFrame, most: int) -> int:
    """The smallest power of two that at most ``most`` rows reach with their n."""
    power = F.floor(F.log2("n")).cast("int").alias("p")
    total = 0
    for r in table.groupBy(power).count().orderBy(F.desc("p")).collect():  # 64 rows at most
        total += r["count"]
        if total > most:
            return 2 ** (r.p + 1)
    return 1


def tag(level: int) -> int:
    return level + 1 << 56


def tagged(level: np.ndarray, key: np.ndarray) -> np.ndarray:
    return key.astype(U64) | (level.astype(U64) + U64(1)) << U64(56)


def levels(keys: np.ndarray, n: np.ndarray, wanted: range) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes (level, key, n) of some levels from counted runs of bytes."""
    parts = []
    for k in wanted:
        if len(keys):
            cut, count = _merge([(keys & ((1 << 8 * (k + 1)) - 1), n)])
            parts.append((np.full(len(cut), k), cut, count))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3


def contexts(level: np.ndarray, key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Contexts (level, key, total, kinds, excluded) of nodes."""
    if not len(key):
        return (np.zeros(0, np.int64),) * 5
    up = Table(tagged(level, key)).find(tagged(level - 1, key & ((1 << 8 * level) - 1)))
    n_parent = np.where(level > 0, n[up], 0)
    own, first, inverse = np.unique(tagged(level, key >> 8), return_index=True, return_inverse=True)
    sums = [np.bincount(inverse, w, minlength=len(own)).astype(np.int64) for w in (n, None, n_parent)]
    return level[first], key[first] >> 8, *sums


def frequent_runs(grams: DataFrame, most: int) -> DataFrame:
    """(key, score) of at most ``most`` runs; their contexts are those of all runs."""
    before = F.shiftright("key", 8).alias("before")
    often = grams.where(F.col("n") >= least_count(grams, most)).select("key", "n", before)
    whole = grams.groupBy(before).agg((F.sum("n") + F.count("*")).alias("mass"))
    return often.join(whole, "before").select("key", (F.log10("n") - F.log10("mass")).alias("score"))


def coded(asked: DataFrame, grams: DataFrame) -> DataFrame:
    """(key, score) of distinct runs of bytes, from the whole trie of ``grams``."""
    spark = grams.sparkSession
    shared = (1 << 8 * SHARED) - 1
    low = grams.groupBy(F.col("key").bitwiseAND(shared).alias("key")).agg(F.sum("n").alias("n"))
    sent = spark.sparkContext.broadcast(levels(*_columns(low), range(SHARED)))  # runs of SHARED bytes: bounded by the alphabet
    n_parts = max(1, grams.count() // PART_RUNS)
    part = F.pmod(F.xxhash64(F.shiftright("key", 8).bitwiseAND(shared)), F.lit(n_parts)).alias("part")

    def task(asked: pa.Table, grams: pa.Table) -> pa.Table:
        key = asked.column("key").to_numpy()
        if not len(key):
            return pa.table({"key": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        own = levels(grams.column("key").to_numpy(), grams.column("n").to_numpy(), range(SHARED, ORDER + 1))
        nodes = tuple(np.concatenate(x) for x in zip(sent.value, own, strict=True))
        return pa.table({"key": key, "score": Model(nodes, contexts(*nodes)).code(key.view(U64))})

    left, right = asked.select("key", part), grams.select("key", "n", part)
    return left.groupBy("part").cogroup(right.groupBy("part")).applyInArrow(task, "key long, score double")


class Model:
    """The trie ready for coding."""

    def __init__(self, nodes: tuple[np.ndarray, ...], contexts: tuple[np.ndarray, ...]):
        level, key, n = nodes
        c_level, c_key, total, kinds, excluded = contexts
        self.contexts = Table(tagged(c_level, c_key))
        parent = np.full(len(c_key), -1)
        deep = c_level > 0
        parent[deep] = self.contexts.find(tagged(c_level[deep] - 1, c_key[deep] & ((1 << 8 * (c_level[deep] - 1)) - 1)))
        self.all = np.log10(np.maximum(total + kinds, 1))
        self.escape = np.log10(np.maximum(kinds, 1)) - self.all
        rest = np.where(deep, total[parent] - excluded + kinds[parent] - kinds, 1)
        self.rest = np.log10(np.maximum(rest, 1))
        step = np.where(deep & (rest > 0), np.log10(np.maximum(np.where(deep, kinds[parent] - kinds, 1), 1)) - self.rest, 0.0)
        self.down = np.zeros(len(c_key))
        for k in range(1, ORDER + 1):
            at = np.flatnonzero(c_level == k)
            self.down[at] = step[at] + self.down[parent[at]]
        root = np.flatnonzero(c_level == 0)
        known = int(kinds[root[0]]) if len(root) else 0
        self.uniform = -np.log10(max(1, 256 - known)) if len(root) else -np.log10(256)
        self.nodes = Table(tagged(level, key))
        self.log_n = np.log10(n).astype(np.float32)
        self.fresh = (self.log_n - self.all[self.contexts.find(tagged(level, key >> 8))]).astype(np.float32)
        for name in ("all", "escape", "rest", "down"):
            setattr(self, name, getattr(self, name).astype(np.float32))

    def code(self, gram: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each run after the others."""
        out = np.zeros(len(gram))
        if not len(self.all):
            return out + self.uniform
        row = self.nodes.find(gram | U64(tag(ORDER)))
        top = row >= 0
        out[top] = self.fresh[row[top]]
        todo = np.flatnonzero(~top)
        g = gram[todo]
        start = np.full(len(todo), -1)  # the longest context seen
        below = np.full(len(todo), -1)  # the context just escaped from
        for level in range(ORDER, -1, -1):
            if not len(todo):
                return out
            if level < ORDER:
                row = self.nodes.find(g & U64((1 << 8 * (level + 1)) - 1) | U64(tag(level)))
                hit = row >= 0
                r, s, b = row[hit], start[hit], below[hit]
                out[todo[hit]] = np.where(s < 0, self.fresh[r], self.escape[s] + self.down[s] - self.down[b] + self.log_n[r] - self.rest[b])
                todo, g, start, below = todo[~hit], g[~hit], start[~hit], below[~hit]
            ctx = self.contexts.find(g >> U64(8) & U64((1 << 8 * level) - 1) | U64(tag(level)))
            start = np.where(start < 0, ctx, start)
            below = np.where(ctx >= 0, ctx, below)
        out[todo] = np.where(start >= 0, self.escape[start] + self.down[start], 0.0) + self.uniform
        return out


def is_held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 7 == 2


def _columns(table: DataFrame) -> tuple[np.ndarray, ...]:
    got = table.toArrow()
    return tuple(c.to_numpy() for c in got.columns)


def score_texts(docs: DataFrame, training: DataFrame, most_nodes: int = MAX_NODES, most_words: int = MAX_WORDS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``."""
    spark = docs.sparkSession
    table = stash(counts(training), "counts")
    seen, grams = table.where("kind = 0").select("key", "n"), table.where("kind = 1").select("key", "n")
    n_all, n_distinct = seen.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    bar = least_count(seen, most_words)
    frequent, rare = seen.where(F.col("n") >= bar), seen.where(F.col("n") < bar)
    sent = spark.sparkContext.broadcast((_columns(frequent_runs(grams, most_nodes)), _columns(frequent)))
    small_batches(spark)
    name = uuid.uuid4().hex

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _ready:
            (run, run_score), (key, n) = sent.value
            _ready.clear()
            _ready[name] = (Table(run.view(U64) | U64(tag(ORDER))), run_score, Table(key.view(U64)), np.log10(n + 1.0))
        runs, run_scores, table, logs = _ready[name]
        for batch in batches:
            ids = batch.column("doc_id")
            for i, j, buf, offsets in chunks(batch):
                starts, ends, doc = words(buf, offsets)
                gram, owner = symbols(buf, starts, ends, doc, j - i)
                at = runs.find(gram | U64(tag(ORDER)))
                hit = at >= 0
                score = np.bincount(owner[hit], run_scores[at[hit]], minlength=j - i)
                open_, open_of = gram[~hit], np.bincount(owner[~hit], minlength=j - i)
                h = np.append(word_hashes(buf, starts, ends), np.full(j - i, END_WORD, U64))
                doc = np.append(doc, np.arange(j - i))
                row = table.find(h)
                hit = row >= 0
                known = np.bincount(doc[hit], minlength=j - i)
                base = np.bincount(doc[hit], logs[row[hit]], minlength=j - i)
                left, own = h[~hit], doc[~hit]
                order = np.argsort(own, kind="stable")
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array(np.bincount(doc, minlength=j - i)), pa.array(known), pa.array(base.astype(float)), pa.array(score.astype(float)), list_array(signed(left[order]), np.bincount(own, minlength=j - i), pa.int64()), list_array(signed(open_), open_of, pa.int64())],
                    ["doc_id", "n_tokens", "known", "base", "score", "rare", "open"],
                )

    first = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, "doc_id long, n_tokens long, known long, base double, score double, rare array<long>, open array<long>")
    first = stash(first.withColumn("row", F.monotonically_increasing_id()), "scored")
    found = first.select("row", F.explode("rare").alias("key")).join(rare, "key").groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 1)).alias("rare_base"))
    runs = first.select("row", F.explode("open").alias("key"))
    scores = coded(runs.select("key").distinct(), grams)
    others = runs.join(scores, "key").groupBy("row").agg(F.sum("score").alias("more_score"))
    total = float(np.log10(n_all + n_distinct + 1))
    rows = first.drop("rare", "open").join(found, "row", "left").join(others, "row", "left")
    base = F.col("base") + F.coalesce("rare_base", F.lit(0.0)) - F.col("n_tokens") * total
    return rows.select("doc_id", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = score_texts(docs, docs.where(~is_held_out()))
    return out.select("doc_id", is_held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
