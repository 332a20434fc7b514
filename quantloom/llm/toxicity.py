"""Operator 2: toxicity by weak supervision.

Voters look at a whole text: lexicons of insults by family, two lexicons learned from labelled training rows, and
patterns (several different insults, their density, shouting, an insult near an address). A generative label model
over the counted combinations of votes estimates, by expectation-maximisation, how each voter votes under either
class, and the correlation between voters that the classes do not explain; correlated voters count less. A
logistic classifier is trained on the posteriors of all documents, each Newton step a sum over tasks, and scores every document from
the counts behind the votes.

Labels are used from training rows only, at most LABELLED_ROWS of them (chosen by a hash of doc_id). Votes are counted
over all documents. Null and empty texts score like any text without hits; without labels the model starts from
its priors. Rows without doc_id have no label and are not held out. Each row is scored by itself; several labels of one document count as 1 if any is 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .common import NOT_WORD, U64, binary_array, chunks, read, signed, small_batches, stash, word_hashes, words

#: Bound on the labelled rows that take part in training.
LABELLED_ROWS = 40_000
#: Tasks that add up a Newton step, each for its part of the combinations of features.
FIT_TASKS = 16
THRESHOLD = 0.3
#: Posterior of rows labelled 0 and 1 (labels err), and what such a row counts.
GOLD, GOLD_WEIGHT = (0.02, 0.97), 4.0
#: A learned word is in this share of the toxic training rows and so many times as frequent there.
LEARNED_SHARE, LEARNED_LIFT = 0.012, 12.0
MAX_LEARNED = 400

LEXICONS = {
    "dullness": "idiot idiots idiotic moron morons moronic stupid stupidity dumb dumbass imbecile fool fools cretin dimwit halfwit brainless",
    "worth": "worthless pathetic loser losers pitiful hopeless",
    "filth": "trash garbage scum scumbag filth filthy vermin maggot parasite rat pig pigs",
    "disgust": "disgusting vile repulsive revolting sickening nasty creep creepy ugly",
    "mockery": "clown clowns coward cowards freak freaks liar liars hypocrite jerk bastard bitch crap damn hate",
    "elsewhere": "dumm idioten blöd arschloch versager abschaum widerlich connard imbécile crétin ordure idiota estúpido imbécil basura asqueroso payaso perdedor",
}
ADDRESS = "you your youre u du dich dein ihr tu te toi vous tú eres usted"
FAMILIES = (*LEXICONS, "learned_a", "learned_b")
FEATURES = (*FAMILIES, "different", "dense", "shouting", "addressed", "any")
#: The first voters are the families; "none" votes against.
VOTERS = (*FAMILIES, "different", "dense", "shouting", "addressed", "none")


def hashes(text: str) -> np.ndarray:
    buf = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = words(buf, np.array([0, len(buf)]), NOT_WORD)
    return word_hashes(buf, starts, ends)


def is_held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def sampled_labels(labels: DataFrame, most: int = LABELLED_ROWS) -> DataFrame:
    """(doc_id, gold) of training rows, ``most`` at most; small enough to broadcast."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out()).groupBy("doc_id").agg(F.max("toxic").alias("gold"))
    n = known.count()
    share = min(1.0, 0.9 * most / max(n, 1)) if n > most else 1.0
    return known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))).limit(most)


def learned_words(docs: DataFrame, gold: DataFrame) -> np.ndarray:
    """Hashes of words much more frequent in toxic training rows, most frequent first."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column("gold").to_numpy()
            for i, j, buf, offsets in chunks(batch):
                starts, ends, doc = words(buf, offsets, NOT_WORD)
                h = word_hashes(buf, starts, ends)
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                first = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, bool)
                h, toxic = h[first], label[i:j][doc[first]]
                keys, inverse = np.unique(h, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(np.bincount(inverse, minlength=len(keys))), pa.array(np.bincount(inverse, toxic > 0, minlength=len(keys)).astype(np.int64))], ["word", "n", "toxic"])

    rows = docs.select("doc_id", "text").join(F.broadcast(gold), "doc_id").select("text", "gold")
    n, toxic = gold.agg(F.count("*"), F.coalesce(F.sum((F.col("gold") > 0).cast("int")), F.lit(0))).first()
    if not toxic or toxic == n:
        return np.zeros(0, U64)
    counted = rows.mapInArrow(task, "word long, n long, toxic long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    lift = (F.col("toxic") / toxic) / ((F.col("n") - F.col("toxic") + 0.5) / (n - toxic + 1))
    best = counted.where((F.col("toxic") >= max(4, LEARNED_SHARE * toxic)) & (lift >= LEARNED_LIFT)).orderBy(F.desc("toxic"), "word").limit(MAX_LEARNED)
    return np.array([r.word for r in best.collect()], np.int64).view(U64)


def features(docs: DataFrame, learned: np.ndarray) -> DataFrame:
    """doc_id and x, one byte for each of FEATURES."""
    small_batches(docs.sparkSession)
    keys, family = [], []
    for k, text in enumerate(LEXICONS.values()):
        h = hashes(text)
        keys.append(h)
        family.append(np.full(len(h), k))
    half = len(learned) // 2
    for k, h in enumerate((learned[:half], learned[half:])):
        keys.append(h)
        family.append(np.full(len(h), len(LEXICONS) + k))
    lexicon, family = np.concatenate(keys), np.concatenate(family)
    order = np.argsort(lexicon, kind="stable")
    lexicon, family = lexicon[order], family[order]
    address = np.sort(hashes(ADDRESS))

    def member(h: np.ndarray, among: np.ndarray) -> np.ndarray:
        return among[np.minimum(np.searchsorted(among, h), len(among) - 1)] == h

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for i, j, buf, offsets in chunks(batch):
                n = j - i
                starts, ends, doc = words(buf, offsets, NOT_WORD)
                h = word_hashes(buf, starts, ends)
                x = np.zeros((n, len(FEATURES)))
                hit = np.flatnonzero(member(h, lexicon))
                low, high = np.searchsorted(lexicon, h[hit], "left"), np.searchsorted(lexicon, h[hit], "right")
                for step in range(int((high - low).max(initial=0))):
                    more = low + step < high
                    np.add.at(x, (doc[hit][more], family[low[more] + step]), 1)
                n_words = np.bincount(doc, minlength=n)
                total = np.bincount(doc[hit], minlength=n)
                pairs = np.unique(doc[hit].astype(np.int64) << 32 | (h[hit] >> U64(32)).astype(np.int64))
                near = np.flatnonzero(member(h, address))
                at = np.searchsorted(near, hit)
                close = np.zeros(len(hit), bool)
                for side in (at - 1, np.minimum(at, len(near) - 1)):
                    if len(near):
                        close |= (side >= 0) & (np.abs(near[np.maximum(side, 0)] - hit) <= 4) & (doc[near[np.maximum(side, 0)]] == doc[hit])
                upper = (buf >= 65) & (buf <= 90)
                lower = (buf >= 97) & (buf <= 122)
                ups, lows = (np.diff(np.concatenate([[0], np.cumsum(c)])[offsets]) for c in (upper, lower))
                k = len(FAMILIES)
                x[:, :k] = np.minimum(x[:, :k], 3)
                x[:, k] = np.minimum(np.bincount(pairs >> 32, minlength=n), 4)
                x[:, k + 1] = np.minimum(total * 100 // np.maximum(n_words, 1), 4)
                x[:, k + 2] = ups > 2 * lows
                x[:, k + 3] = np.minimum(np.bincount(doc[hit][close], minlength=n), 2)
                x[:, k + 4] = total > 0
                yield pa.RecordBatch.from_arrays([ids.slice(i, n), binary_array(x.astype(np.uint8).ravel(), np.full(n, len(FEATURES)))], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(task, "doc_id long, x binary")


def votes(x: np.ndarray) -> np.ndarray:
    """1, -1 or 0 of each of VOTERS for rows of features."""
    k = len(FAMILIES)
    out = np.zeros((len(x), len(VOTERS)), np.int64)
    out[:, :k] = x[:, :k] > 0
    out[:, k] = x[:, k] > 1
    out[:, k + 1] = x[:, k + 1] > 0
    out[:, k + 2] = x[:, k + 2] > 0
    out[:, k + 3] = x[:, k + 3] > 0
    out[:, k + 4] = -(x[:, k + 4] == 0).astype(np.int64)
    return out


def posteriors(vote: np.ndarray, gold: np.ndarray, n: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of the toxic class for each combination of votes, the voters' tables, and their correlations.

    ``gold`` (1, -1, or 0 where unknown) anchors the posterior of labelled rows, short of certainty.
    """
    m = vote.shape[1]
    state = vote + 1
    weight = np.ones(m)
    table = np.full((2, m, 3), 1 / 3)
    for j in range(m):
        table[1, j] = 0.15, 0.25, 0.6
        table[0, j] = 0.5, 0.45, 0.05
    prior, post, rho = 0.1, np.zeros(len(n)), np.zeros((m, m))
    total = n.sum()
    for turn in range(2):
        for _ in range(rounds):
            log = [np.log(p) + (weight * np.log(table[y][np.arange(m), state])).sum(axis=1) for y, p in ((0, 1 - prior), (1, prior))]
            post = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
            post = np.where(gold > 0, GOLD[1], np.where(gold < 0, GOLD[0], post))
            prior = min(0.5, max(0.001, float((post * n).sum() / total)))
            for y, p in ((0, 1 - post), (1, post)):
                for v in range(3):
                    table[y, :, v] = ((state == v) * (p * n)[:, None]).sum(axis=0) + 0.5
                table[y] /= table[y].sum(axis=1, keepdims=True)
        if turn == 0:
            # What the classes leave unexplained: correlations of the votes' residuals.
            mean = np.stack([table[y] @ np.array([-1, 0, 1]) for y in (0, 1)])
            rest = [vote - mean[y] for y in (0, 1)]
            cov = sum((r * (p * n)[:, None]).T @ r for r, p in zip(rest, (1 - post, post), strict=True)) / total
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            rho = np.clip(cov / np.outer(sd, sd), -1, 1)
            np.fill_diagonal(rho, 0)
            weight = 1 / (1 + np.abs(rho).sum(axis=1))
    return post, table, rho


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...]
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.weights) + self.bias, -50, 50)))


def voted(seen: DataFrame) -> list[tuple[Row, float]]:
    """((votes v, label g, rows n), posterior) of every combination of votes and label, from the label model over all documents."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.uint8).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([pa.array(votes(x).tolist(), pa.list_(pa.int64())), batch.column("g"), batch.column("n")], ["v", "g", "n"])

    # Votes are 0 and 1, of the last one -1: at most 3 * 2 ** len(VOTERS) rows, of which few occur.
    table = seen.mapInArrow(task, "v array<long>, g int, n long").groupBy("v", "g").agg(F.sum("n").alias("n")).orderBy("v", "g").collect()
    if not table:
        return []
    n = np.array([r.n * (1.0 if r.g == 0 else GOLD_WEIGHT) for r in table])
    post, _, _ = posteriors(np.array([r.v for r in table]), np.array([r.g for r in table]), n)
    return list(zip(table, post.tolist(), strict=True))


def weighed(seen: DataFrame, post: dict[tuple[tuple[int, ...], int], float]) -> DataFrame:
    """x, p and n of every combination of features and label: its posterior from its votes, and what it counts."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.uint8).reshape(-1, len(FEATURES))
            g = batch.column("g").to_pylist()
            n = batch.column("n").to_numpy() * np.where(np.array(g) == 0, 1.0, GOLD_WEIGHT)
            yield pa.RecordBatch.from_arrays([batch.column("x"), pa.array([post[tuple(v), k] for v, k in zip(votes(x).tolist(), g, strict=True)]), pa.array(n)], ["x", "p", "n"])

    return seen.mapInArrow(task, "x binary, p double, n double")


def fit(rows: DataFrame) -> Model:
    """Weighted logistic regression of posteriors p on features x by Newton steps over all rows (x, p, n).

    A task adds up its rows' part of the gradient and the Hessian, a row of fixed width; the driver adds those and solves.
    """
    rows, width = rows.coalesce(FIT_TASKS), len(FEATURES) + 1
    w = np.zeros(width)
    w[-1] = -2.0

    def added(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(1 + width + width * width)
            for batch in batches:
                x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.uint8).reshape(-1, len(FEATURES))
                a = np.column_stack([x.astype(float), np.ones(len(x))])
                n, post = batch.column("n").to_numpy(), batch.column("p").to_numpy()
                p = 1 / (1 + np.exp(-np.clip(a @ at, -30, 30)))
                sums += np.concatenate([[n.sum()], a.T @ (n * (post - p)), ((a * (n * p * (1 - p))[:, None]).T @ a).ravel()])
            yield pa.RecordBatch.from_pydict({"sums": pa.array([sums.tolist()], pa.list_(pa.float64()))})

        parts = sorted(r.sums for r in rows.mapInArrow(task, "sums array<double>").collect())
        total = np.array([math.fsum(c) for c in zip(*parts, strict=True)]) if parts else np.zeros(1 + width + width * width)
        n = max(total[0], 1.0)
        return total[1 : 1 + width] / n - 1e-4 * at, total[1 + width :].reshape(width, width) / n + 1e-4 * np.eye(width)

    if rows.isEmpty():
        return Model((0.0,) * len(FEATURES), -3.0)
    for _ in range(50):
        gradient, hessian = added(w)
        step = np.linalg.solve(hessian, gradient)
        w = w + step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return Model(tuple(w[:-1].tolist()), float(w[-1]))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score, predicted of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    gold = stash(sampled_labels(labels), "gold")
    rows = stash(features(ids, learned_words(ids, gold)), "features")
    label = F.coalesce(F.when(F.col("gold") > 0, 1).otherwise(F.when(F.col("gold").isNotNull(), -1)), F.lit(0))
    seen = stash(rows.join(F.broadcast(gold), "doc_id", "left").groupBy("x", label.alias("g")).agg(F.count("*").alias("n")), "seen")
    post = {(tuple(r.v), r.g): p for r, p in voted(seen)}
    model = fit(stash(weighed(seen, post), "weighed"))
    z = sum((F.conv(F.hex(F.substring("x", k + 1, 1)), 16, 10).cast("double") * w for k, w in enumerate(model.weights)), F.lit(model.bias))
    return rows.withColumn("score", 1 / (1 + F.exp(-z))).select("doc_id", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", F.coalesce(is_held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
