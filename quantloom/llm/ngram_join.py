"""Operator 1: n-gram Jaccard join with signature trees.

A text's set holds its distinct shingles of five words (A-Z lower-cased); with fewer words the whole sequence is its
one shingle; texts without words have an empty set and link with nothing, null texts likewise. Two documents link at
Jaccard similarity 0.8 or more; components of the links are returned.

1. Equal sets become one representative (the smallest doc_id).
2. In one fixed order of shingles, two sets that link share k of their first n - ceil(0.8 n) + k shingles (k is about
   n / 20), so only documents meet that share such a shingle, and only if they have enough shared ones at all. Very
   frequent shingles come last in that order (which any order may do), so that passages which many documents share
   bring few of them together.
3. The documents that meet over a shingle form a signature tree: leaves hold a bitmap of the document's shingles, inner
   nodes the OR of the bitmaps below and the range of set sizes. A dual traversal drops every pair of nodes whose
   largest possible overlap, or whose sizes, cannot reach 0.8, and pairs already in one component.
4. What is left is checked on the sets themselves.

The traversal runs twice: first along neighbours in each tree and with its smallest doc_id, keeping two candidates a
document, which joins large groups of near copies in linear time; then over all pairs between different components,
with no limit. Groups beyond BLOCK documents are traversed as pairs of blocks. Shingles are 64-bit hashes.

Rows that share a doc_id are one document, repeated or with other texts, which then links by any of them; whole copies
of a row are dropped before the trees. A component's id is the smallest doc_id in it, so ties cannot arise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import U64, binary_array, cell_of, chunks, components, give_back, id_bitmap, in_bitmap, list_array, mix64, powers, read, row_key, signed, small_batches, stash, word_hashes, words

WORDS = 5
#: Least number of bits of a signature; it has four bits or more a shingle, in powers of two.
SIGNATURE = 256
FANOUT = 4
#: Documents of one group, and bytes of their signatures, that a task holds on either side.
BLOCK, BLOCK_BYTES = 2000, 1_000_000
#: Bytes of signatures, of all groups, that a task has at once, about.
BUCKET_BYTES = 4_000_000
#: Leaves of a subtree that the first traversal stays in.
NEAR_LEVEL = 2
#: Bytes of signatures compared at a time.
FRONTIER_BYTES = 2_000_000
#: A shingle is frequent if it is in this share of the documents.
HOT_SHARE = 0.005
BLOCK_SHINGLES = 500_000
#: A group is large with more than LARGE_GROUP documents and one in LARGE_GROUPS of all meetings, so that there are at most so many.
LARGE_GROUP, LARGE_GROUPS = 200, 10_000


def shingle_sets(batch: pa.RecordBatch) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each row) for parts of a batch."""
    p = powers(WORDS + 1)
    for i, j, buf, offsets in chunks(batch):
        starts, ends, doc = words(buf, offsets)
        h = word_hashes(buf, starts, ends)
        n = np.bincount(doc, minlength=j - i)
        first = np.cumsum(n) - n
        whole = np.zeros(0, U64)
        if len(h) >= WORDS:
            total = h[: len(h) - WORDS + 1] * p[0]
            for k in range(1, WORDS):
                total += h[k : len(h) - WORDS + 1 + k] * p[k]
            whole = mix64(total)
        out = []
        for a, m in zip(first.tolist(), n.tolist(), strict=True):
            if m >= WORDS:
                s = np.sort(whole[a : a + m - WORDS + 1])
                out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
            elif m:
                out.append(mix64(np.array([(h[a : a + m] * p[:m]).sum(dtype=U64) + U64(m)], U64)))
            else:
                out.append(np.zeros(0, U64))
        yield i, out


def first_pass(docs: DataFrame) -> DataFrame:
    """Rows of two kinds. 1: doc_id, n (set size) and two fingerprints of the set. 0: shingles (as f1) that a hundredth of
    a block of documents have, and in how many of them (n); tasks count block by block.

    Only shingles in the first half of the order are counted; the others come late in it anyway.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, n_docs = [], 0, 0
        names = ["kind", "doc_id", "n", "f1", "f2"]

        def often() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            keep = n >= max(8, n_docs // 100)
            none = pa.nulls(int(keep.sum()), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(none), np.int32)), none, pa.array(n[keep]), pa.array(signed(keys[keep])), none], names)

        for batch in batches:
            ids = batch.column("doc_id")
            for i, sets in shingle_sets(batch):
                sums = np.array([[s.sum(dtype=U64), mix64(s).sum(dtype=U64)] for s in sets], U64)
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(sets), np.int32)), ids.slice(i, len(sets)), pa.array(np.array([len(s) for s in sets])), pa.array(signed(np.ascontiguousarray(sums[:, 0]))), pa.array(signed(np.ascontiguousarray(sums[:, 1])))], names)
                for s in sets:
                    s = s[: np.searchsorted(s, U64(1 << 63))]
                    held.append(s)
                    size, n_docs = size + len(s), n_docs + 1
                    if size > BLOCK_SHINGLES:
                        yield often()
                        held, size, n_docs = [], 0, 0
        if held:
            yield often()
        held.clear()
        give_back()

    rows = docs.select(row_key().alias("doc_id"), "text")
    return rows.mapInArrow(task, "kind int, doc_id long, n long, f1 long, f2 long")


def frequent_shingles(first: DataFrame, share: float = HOT_SHARE) -> DataFrame:
    """Shingles in about ``share`` of all documents or more: their number is at most the mean set size over ``share``."""
    least = max(8, int(share * first.where("kind = 1").count()))
    return first.where("kind = 0").groupBy(F.col("f1").alias("token")).agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("token")


def common_needed(n: int) -> int:
    """Shingles that two sets of n or more must share in their prefixes, which are so much longer."""
    return max(1, n // 20)


def width(n: int) -> int:
    """Bits of the signature of a set of n shingles."""
    return max(SIGNATURE, 1 << (4 * n - 1).bit_length())


def signature(s: np.ndarray) -> bytes:
    bits = np.zeros(width(len(s)), np.uint8)
    bits[(s & U64(len(bits) - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def repeated_ids(every: DataFrame):
    """Bitmap of the ids of several rows; it may let others through, whose rows are then made distinct for nothing."""
    return id_bitmap(every.groupBy("doc_id").count().where("count > 1"), "doc_id")


def without_copies(rows: DataFrame) -> DataFrame:
    """Distinct rows of those marked ``again``, the others as they are, without that column."""
    return rows.where("not again").drop("again").union(rows.where("again").drop("again").distinct())


def features(docs: DataFrame, hot: DataFrame, reps: DataFrame, repeated) -> DataFrame:
    """doc_id, n, signature, prefix (not frequent shingles first, how many of those is ``cold``) of representatives.

    Representatives are told by a bitmap of fixed size, which may let copies through; those only link with equals.
    """
    spark = docs.sparkSession
    tokens = np.sort(hot.toArrow().column("token").to_numpy().view(U64))
    sent, keep = spark.sparkContext.broadcast(tokens), id_bitmap(reps, "rep")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = sent.value
        for batch in batches:
            batch = batch.filter(pa.array(in_bitmap(keep.value, batch.column("cell").to_numpy())))
            ids = batch.column("doc_id")
            again = pa.array(in_bitmap(repeated.value, batch.column("cell").to_numpy()))
            for i, sets in shingle_sets(batch):
                prefix, cold = [], []
                for s in sets:
                    often = np.zeros(len(s), bool)
                    if len(hot):
                        often = hot[np.minimum(np.searchsorted(hot, s), len(hot) - 1)] == s
                    m = len(s) - -(-4 * len(s) // 5) + common_needed(len(s)) if len(s) else 0
                    rare = s[~often][:m]
                    cold.append(len(rare))
                    prefix.append(np.concatenate([rare, s[often][: m - len(rare)]]))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, len(sets)), pa.array(np.array([len(s) for s in sets])), pa.array([signature(s) if len(s) else b"" for s in sets], pa.binary()), list_array(signed(np.concatenate(prefix)), np.array([len(x) for x in prefix]), pa.int64()), pa.array(np.array(cold, np.int32)), again.slice(i, len(sets))],
                    ["doc_id", "n", "signature", "prefix", "cold", "again"],
                )
        give_back()

    rows = docs.select(row_key().alias("doc_id"), "text").withColumn("cell", cell_of("doc_id"))
    return rows.mapInArrow(task, "doc_id long, n long, signature binary, prefix array<long>, cold int, again boolean").where("n > 0")


def meetings(rows: DataFrame) -> DataFrame:
    """(token, doc, size, bytes): documents that meet over a shingle of their prefixes, one shingle for each set of documents; size
    and bytes of signatures of the whole set."""
    own = rows.select(F.col("doc_id").alias("doc"), F.col("n").cast("int").alias("n"), "prefix", "cold")
    # Bytes of a signature, as ``width`` has it.
    weight = F.greatest(F.lit(SIGNATURE), F.pow(F.lit(2), F.length(F.bin(4 * F.col("n") - 1))).cast("long")) / 8
    cold = own.select("doc", "n", F.explode(F.slice("prefix", F.lit(1), F.col("cold"))).alias("token"))
    w = W.partitionBy("token")
    # A set only links with sets of at most a quarter more; in order of size that means with a neighbour.
    by_size = w.orderBy("n")
    near = (F.col("n") * 4 <= F.lag("n").over(by_size) * 5) | (F.lead("n").over(by_size) * 4 <= F.col("n") * 5)
    cold = cold.withColumn("near", near).where("near")
    cold = cold.select("token", "doc", "n", F.count("*").over(w).alias("size"))
    hot = stash(own.where(F.size("prefix") > F.col("cold")).select("doc", "n", F.explode(F.expr("slice(prefix, cold + 1, size(prefix) - cold)")).alias("token")), "hot")
    # A row for each frequent shingle at most.
    shared = hot.groupBy("token").agg(F.count("*").alias("size")).where(F.col("size") > 1).select("token")
    both = stash(cold.where("size > 1").select("token", "doc", "n").union(hot.join(F.broadcast(shared), "token").select("token", "doc", "n")), "shared")
    # Two sets that link share `common_needed` shingles of their prefixes, and the smaller has four fifths of the other's size.
    least = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * 4 / 5) / 20))
    enough = both.groupBy("doc", "n").agg(F.count("*").alias("c")).where(F.col("c") >= least).select("doc")
    kept = stash(both.join(enough, "doc", "left_semi").select("token", "doc", weight.cast("long").alias("w")), "kept")
    groups = kept.groupBy("token").agg(F.count("*").alias("size"), F.sum("w").alias("bytes"), F.bit_xor(F.xxhash64("doc")).alias("members")).where(F.col("size") > 1)
    one = stash(groups.groupBy("members", "size").agg(F.min("token").alias("token"), F.min("bytes").alias("bytes")).select("token", "size", "bytes"), "groups")
    # Of large groups there are few; their rows stay where they are.
    large = F.col("size") > max(LARGE_GROUP, kept.count() // LARGE_GROUPS)
    few, many = one.where(large), one.where(~large)
    met = kept.select("token", "doc").join(F.broadcast(few), "token").union(kept.select("token", "doc").join(many, "token"))
    return stash(met, "meetings")


def _blocks(rows: DataFrame, every: bool) -> DataFrame:
    """Rows dealt to pairs of blocks of their group: (group, side); all pairs, or each block alone and with the first."""
    k = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("bytes") / BLOCK_BYTES))
    rows = rows.withColumn("k", k.cast("int")).withColumn("b", F.pmod(F.xxhash64("doc"), F.col("k")).cast("int"))
    if every:
        pairs = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda x: F.struct(F.least(x, F.col("b")).alias("i"), F.greatest(x, F.col("b")).alias("j")))
    else:
        pairs = F.array(F.struct(F.col("b").alias("i"), F.col("b").alias("j")))
    rows = rows.withColumn("p", F.explode(pairs))
    return rows.select(F.xxhash64("token", "p.i", "p.j").alias("group"), F.when((F.col("b") == F.col("p.j")) & (F.col("p.i") != F.col("p.j")), 1).otherwise(0).alias("side"), "doc", "n", "signature", "component")


class Tree:
    """Signature trees over consecutive documents, one for each set; level 0 are the documents."""

    def __init__(self, sets: np.ndarray, n: np.ndarray, bits: np.ndarray, component: np.ndarray):
        excess = n - np.bitwise_count(bits).sum(axis=1)
        self.levels = [(bits, n, n, excess, component, component, sets)]
        self.children: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sets) > len(np.unique(sets)):
            start = np.flatnonzero(np.concatenate([[True], sets[1:] != sets[:-1]]))
            place = np.arange(len(sets)) - np.repeat(start, np.diff(np.append(start, len(sets))))
            first = np.flatnonzero(place % FANOUT == 0)
            bits, low, high, excess, c_low, c_high, _ = self.levels[-1]
            sets = sets[first]
            self.children.append((first, np.diff(np.append(first, len(place)))))
            self.levels.append((np.bitwise_or.reduceat(bits, first), np.minimum.reduceat(low, first), np.maximum.reduceat(high, first), np.maximum.reduceat(excess, first), np.minimum.reduceat(c_low, first), np.maximum.reduceat(c_high, first), sets))

    def may_link(self, level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether documents below two nodes can link, and the largest possible overlap."""
        bits, low, high, excess, c_low, c_high, _ = self.levels[level]
        keep = (5 * high[a] >= 4 * low[b]) & (5 * high[b] >= 4 * low[a])
        keep &= ~((c_low[a] == c_high[a]) & (c_low[b] == c_high[b]) & (c_low[a] == c_low[b]))
        over = np.zeros(len(a), np.int64)
        at = np.flatnonzero(keep)
        x, y = a[at], b[at]
        shared = np.bitwise_count(bits[x] & bits[y]).sum(axis=1).astype(np.int64)
        over[at] = np.minimum(shared + np.minimum(excess[x], excess[y]), np.minimum(high[x], high[y]))
        keep[at] &= 9 * over[at] >= 4 * (low[x] + low[y])
        return keep, over

    def expand(self, level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of children; of a node with itself each pair once."""
        first, n = self.children[level - 1]
        na, nb = n[a], n[b]
        total = na * nb
        k = np.arange(int(total.sum())) - np.repeat(np.cumsum(total) - total, total)
        width = np.repeat(nb, total)
        x, y = np.repeat(first[a], total) + k // width, np.repeat(first[b], total) + k % width
        keep = np.repeat(a != b, total) | (x <= y)
        return x[keep], y[keep]

    def traverse(self, level: int, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of documents that may link, with their largest possible overlap, from pairs of nodes of a level."""
        most = max(256, FRONTIER_BYTES // (self.levels[0][0].shape[1] * 8))
        stack = [(level, a, b)]
        while stack:
            level, a, b = stack.pop()
            if len(a) > most:
                stack += [(level, a[i : i + most], b[i : i + most]) for i in range(0, len(a), most)]
                continue
            keep, over = self.may_link(level, a, b)
            if level == 0:
                keep &= a != b
                if keep.any():
                    yield a[keep], b[keep], over[keep]
            else:
                # A node with itself has pairs that differ in size or bits only below, so the bounds hold for it too.
                x, y = self.expand(level, a[keep], b[keep])
                if len(x):
                    stack.append((level - 1, x, y))


def _pairs(group: np.ndarray, side: np.ndarray, doc: np.ndarray, n: np.ndarray, component: np.ndarray, bits: np.ndarray, every: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows that may link, from the trees over the rows of each (group, side)."""
    new = np.concatenate([[True], (group[1:] != group[:-1]) | (side[1:] != side[:-1])])
    sets, start = np.cumsum(new) - 1, np.flatnonzero(new)
    tree = Tree(sets, n, bits, component)
    if every:
        two = start[1:][(side[start[1:]] == 1) & (group[start[1:]] == group[start[:-1]])]
        other = sets[two]
        # A block without a counterpart of this width is there for other pairs only if it is a second side.
        alone = np.setdiff1d(np.flatnonzero(side[start] == 0), other - 1)
        yield from tree.traverse(len(tree.levels) - 1, np.concatenate([alone, other - 1]), np.concatenate([alone, other]))
        return
    level = min(NEAR_LEVEL, len(tree.levels) - 1)
    nodes = np.arange(len(tree.levels[level][0]))
    yield from tree.traverse(level, nodes, nodes)
    least = np.minimum.reduceat(doc, start)
    at = np.flatnonzero(doc == least[sets])
    first = np.zeros(len(start), np.int64)
    first[sets[at]] = at
    yield from tree.traverse(0, first[sets], np.arange(len(doc)))


def candidates(rows: DataFrame, every: bool) -> DataFrame:
    """(lo, hi, bound) of documents of one group that may link."""
    dealt = _blocks(rows, every)
    copies = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("bytes") / BLOCK_BYTES)) if every else F.lit(1)
    total = rows.agg(F.sum(F.octet_length("signature") * copies)).first()[0] or 0
    dealt = dealt.withColumn("bucket", F.pmod("group", F.lit(max(1, total // BUCKET_BYTES))))

    def task(table: pa.Table) -> pa.Table:
        group, side, doc, n, component = (table.column(c).to_numpy() for c in ("group", "side", "doc", "n", "component"))
        signs = table.column("signature").combine_chunks()
        ends = np.frombuffer(signs.buffers()[1], np.int32)[signs.offset : signs.offset + len(signs) + 1].astype(np.int64) // 8
        cells, at_cell, bits_of = np.frombuffer(signs.buffers()[2], np.uint64), ends[:-1], np.diff(ends) * 64
        found = []
        # Sets that link differ by a quarter in size at most: those just above a width are folded into its trees too.
        for w in np.unique(bits_of).tolist():
            own = np.flatnonzero(bits_of == w)
            wider = np.flatnonzero((bits_of == 2 * w) & (16 * n <= 5 * w))
            at = np.concatenate([own, wider])
            fold = np.concatenate([np.zeros(len(own), np.int64), np.full(len(wider), w // 64)])
            head = cells[at_cell[at]] | cells[at_cell[at] + fold]
            order = np.lexsort((head, n[at], component[at], side[at], group[at])) if every else np.lexsort((head, n[at], side[at], group[at]))
            place = (at_cell[at][order])[:, None] + np.arange(w // 64)
            bits = cells[place]
            if len(wider):
                bits |= cells[place + fold[order][:, None]]
            del place
            at = at[order]
            for a, b, over in _pairs(group[at], side[at], doc[at], n[at], component[at], bits, every):
                found.append((doc[at[a]], doc[at[b]], over))
        a, b, over = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        keep = np.flatnonzero(lo < hi)
        if not every and len(keep):
            # The smallest and the best partner of each document.
            few = []
            for order in (np.lexsort((lo[keep], hi[keep])), np.lexsort((lo[keep], -over[keep], hi[keep]))):
                at = keep[order]
                few.append(at[np.concatenate([[True], hi[at][1:] != hi[at][:-1]])])
            keep = np.unique(np.concatenate(few))
        elif len(keep):
            order = np.lexsort((hi[keep], lo[keep]))
            keep = keep[order]
            keep = keep[np.concatenate([[True], (lo[keep][1:] != lo[keep][:-1]) | (hi[keep][1:] != hi[keep][:-1])])]
        out = pa.table({"lo": lo[keep], "hi": hi[keep], "bound": over[keep]})
        give_back()
        return out

    found = dealt.groupBy("bucket").applyInArrow(task, "lo long, hi long, bound long")
    if every:
        return found.groupBy("lo", "hi").agg(F.max("bound").alias("bound"))
    few = found.groupBy("hi").agg(F.min("lo").alias("least"), F.max_by("lo", F.struct("bound", -F.col("lo"))).alias("best"))
    return few.select("hi", F.explode(F.array_distinct(F.array("least", "best"))).alias("lo"))


def links(pairs: DataFrame, docs: DataFrame, repeated) -> DataFrame:
    """(a, b) of the pairs (lo, hi) whose sets reach a similarity of 0.8, checked on the sets."""
    wanted = id_bitmap(pairs.select(F.explode(F.array("lo", "hi")).alias("doc")), "doc")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = in_bitmap(wanted.value, batch.column("cell").to_numpy())
            batch = batch.filter(pa.array(keep))
            again = pa.array(in_bitmap(repeated.value, batch.column("cell").to_numpy()))
            for i, found in shingle_sets(batch):
                yield pa.RecordBatch.from_arrays([batch.column("doc").slice(i, len(found)), binary_array(np.concatenate(found), np.array([len(s) for s in found])), again.slice(i, len(found))], ["doc", "set", "again"])
        give_back()

    rows = docs.select(row_key().alias("doc"), "text")
    table = without_copies(stash(rows.withColumn("cell", cell_of("doc")).mapInArrow(sets, "doc long, set binary, again boolean"), "sets"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0
                keep[i] = len(x) > 0 and 100 * both >= 80 * (len(x) + len(y) - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))
        give_back()

    # A large group's pairs share their smaller document: they meet it last, with their own sets, so that a skewed join shows its size.
    first = pairs.select(F.col("lo").alias("a"), F.col("hi").alias("b")).join(table.select(F.col("doc").alias("b"), F.col("set").alias("y")), "b")
    return first.join(table.select(F.col("doc").alias("a"), F.col("set").alias("x")), "a").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def keyed_duplicates(docs: DataFrame) -> DataFrame:
    """key (``row_key``), n_shingles, component (the smallest key) of every row."""
    small_batches(docs.sparkSession)
    first = stash(first_pass(docs), "sets")
    every = first.where("kind = 1")
    equal = every.where("n > 0").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"))
    repeated = repeated_ids(every)
    rows = without_copies(stash(features(docs, frequent_shingles(first), equal.select("rep"), repeated), "features"))
    leaves = rows.select(F.col("doc_id").alias("doc"), "n", "signature")
    met = meetings(rows)
    near = met.join(leaves, "doc").withColumn("component", F.col("doc"))
    one = stash(links(stash(candidates(near, every=False), "pairs"), docs, repeated), "links")
    so_far = components(one)
    joined = met.join(so_far.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    joined = stash(joined, "joined")
    open_ = joined.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("token")
    rest = joined.join(open_, "token", "left_semi").join(leaves, "doc")
    two = links(stash(candidates(rest, every=True), "pairs"), docs, repeated)
    final = components(one.union(two))
    reps = equal.join(final, F.col("rep") == F.col("node"), "left").select("f1", "f2", "n", F.coalesce("component", "rep").alias("component_id"))
    return every.select("doc_id", "n", "f1", "f2").join(reps, ["f1", "f2", "n"], "left").select(F.col("doc_id").alias("key"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component"))


def nameless(docs: DataFrame) -> DataFrame:
    """The keys of rows without doc_id: key, each once."""
    return docs.where("doc_id is null").select(row_key().alias("key")).distinct()


def first_of_groups(docs: DataFrame) -> DataFrame:
    """key, named, n_shingles, component_id: of each row the smallest doc_id in its component, or the smallest key if none has one."""
    keyed = stash(keyed_duplicates(docs), "keyed")
    none = stash(nameless(docs).withColumn("named", F.lit(False)), "nameless")
    if none.isEmpty():
        return keyed.select("key", F.lit(True).alias("named"), "n_shingles", F.col("component").alias("component_id"))
    keyed = keyed.join(none, "key", "left").withColumn("named", F.coalesce("named", F.lit(True)))
    least = keyed.groupBy("component").agg(F.min(F.when(F.col("named"), F.col("key"))).alias("least"))
    return keyed.join(least, "component").select("key", "named", "n_shingles", F.coalesce("least", "component").alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    A row without doc_id takes part; a component without any doc_id has a hash of one of its texts as its id.
    """
    return first_of_groups(docs).select(F.when(F.col("named"), F.col("key")).alias("doc_id"), "n_shingles", "component_id")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
