"""Merkle manifest of documents: trees by language and one over their roots, in blocks laid out in van Emde Boas order.

A tree is cut into aligned blocks of 2**HEIGHT nodes a level; a task hashes one block at a time, and the blocks' roots are the leaves of the next
tier, until one is left. A block is one binary row: its levels are split at half height, the top part is laid out first and then each part
below it, recursively, so that the way from a leaf to the root touches few stretches of it, whatever the size of a stretch. ``address`` computes
where a node lies; building and the look-up of siblings use it. Proofs go down the tiers: a block gets the siblings above its root.

Nulls: a null field is hashed as ``-``; documents without language form a tree of their own, those without doc_id come first. Repeated rows are leaves of
their own, equal ones in any order. A lone leaf is its tree's root. No rows, no tree.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, numbered, read, small_batches, stash

#: Levels of a block above its leaves, and bytes of a digest.
HEIGHT, DIGEST = 8, 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def address(depth: np.ndarray, place: np.ndarray, levels: int) -> np.ndarray:
    """Where the node at ``place`` of level ``depth`` (from the root) lies in a complete tree of ``levels`` levels."""
    if levels == 1:
        return np.zeros(len(depth), np.int64)
    top = levels // 2
    out = np.empty(len(depth), np.int64)
    upper = depth < top
    out[upper] = address(depth[upper], place[upper], top)
    d, x = depth[~upper] - top, place[~upper]
    size = (1 << levels - top) - 1
    out[~upper] = (1 << top) - 1 + (x >> d) * size + address(d, x & (1 << d) - 1, levels - top)
    return out


@functools.cache
def layout(height: int) -> list[list[int]]:
    """Addresses of the nodes of each level, from the leaves up, of a block of ``height`` levels above its leaves."""
    levels = height + 1
    return [address(np.full(1 << d, d), np.arange(1 << d), levels).tolist() for d in range(height, -1, -1)]


def joined(*digests: bytes) -> bytes:
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def height_of(n: int, size: int) -> int:
    """Levels above the leaves of a block: all, unless the block is the only one of its tier."""
    return HEIGHT if n > 1 << HEIGHT else (size - 1).bit_length()


def build(leaves: list[bytes], height: int) -> bytes:
    """A block's nodes in van Emde Boas order; the root is at 0, places without a node are left zero."""
    where = layout(height)
    out = bytearray(((2 << height) - 1) * DIGEST)
    row = leaves
    for level in range(height + 1):
        for at, digest in zip(where[level], row, strict=False):
            out[at * DIGEST : at * DIGEST + DIGEST] = digest
        if level < height:
            row = [joined(*row[k : k + 2]) for k in range(0, len(row), 2)]
    return bytes(out)


def siblings(block: bytes, height: int, size: int, leaf: int) -> tuple[str, bytes]:
    """For each level from ``leaf`` up: R or L, the side of the sibling, or N for none; and the siblings in a row."""
    where, sides, out = layout(height), [], []
    for level in range(height):
        other = leaf ^ 1
        if other < size:
            at = where[level][other] * DIGEST
            out.append(block[at : at + DIGEST])
            sides.append("LR"[other > leaf])
        else:
            sides.append("N")
        leaf, size = leaf >> 1, size + 1 >> 1
    return "".join(sides), b"".join(out)


def fold(leaf: bytes, sides: str, path: bytes) -> bytes:
    at = 0
    for side in sides:
        if side == "N":
            leaf = joined(leaf)
            continue
        other = path[at : at + DIGEST]
        at += DIGEST
        leaf = joined(leaf, other) if side == "R" else joined(other, leaf)
    return leaf


def leaves(docs: DataFrame) -> DataFrame:
    """(lang, doc_id, leaf, tampered): digests of the rows, and of those that are tampered with after the change."""

    def field(c: F.Column) -> F.Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    def digest(**changed: F.Column) -> F.Column:
        return F.unhex(F.sha2(F.concat(*[field(changed.get(c, F.col(c))) for c in FIELDS]).cast("binary"), 256))

    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    number = F.col("n_chars").cast("decimal(20,0)")  # one more than the largest long is no overflow
    return docs.select("lang", F.col("doc_id").cast("long").alias("doc_id"), digest().alias("leaf"), F.when(chosen, digest(n_chars=number + 1)).alias("tampered"))


BLOCK = "group string, block long, n long, size long, nodes binary, root binary, ids array<long>, tampered array<binary>"
BLOCK_SCHEMA = pa.schema([("group", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("size", pa.int64()), ("nodes", pa.binary()), ("root", pa.binary()), ("ids", pa.list_(pa.int64())), ("tampered", pa.list_(pa.binary()))])


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a block, from rows sorted by (group, block, i); holds one block."""
    key: tuple | None = None
    row: list[tuple] = []

    def close() -> pa.RecordBatch:
        group, block, n = key
        digests, ids, tampered = zip(*row, strict=True)
        nodes = build(list(digests), height_of(n, len(row)))
        return pa.RecordBatch.from_pylist([{"group": group, "block": block, "n": n, "size": len(row), "nodes": nodes, "root": nodes[:DIGEST], "ids": list(ids), "tampered": list(tampered)}], BLOCK_SCHEMA)

    for batch in batches:
        for group, block, n, *rest in zip(*(batch.column(c).to_pylist() for c in ("group", "block", "n", "leaf", "id", "tampered")), strict=True):
            if (group, block, n) != key:
                if row:
                    yield close()
                key, row = (group, block, n), []
            row.append(tuple(rest))
    if row:
        yield close()
    give_back()


def tiers(rows: DataFrame) -> list[DataFrame]:
    """Tables of blocks, from the leaves up, of the trees of all groups of rows (group, i, n, leaf, id, tampered)."""
    small_batches(rows.sparkSession)
    out: list[DataFrame] = []
    while True:
        blocked = rows.withColumn("block", F.shiftright("i", HEIGHT)).repartition("group", "block").sortWithinPartitions("group", "block", "i")
        out.append(stash(blocked.mapInArrow(blocks, BLOCK), "blocks"))
        more = out[-1].where(F.col("n") > 1 << HEIGHT)
        rows = more.select("group", F.col("block").alias("i"), F.shiftright(F.col("n") + ((1 << HEIGHT) - 1), HEIGHT).alias("n"), F.col("root").alias("leaf"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("tampered"))
        if more.isEmpty():
            return out


PATH = "group string, i long, sides string, path binary"


def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each leaf of blocks that know the way above them, the whole way."""
    schema = pa.schema([("group", pa.string()), ("i", pa.int64()), ("sides", pa.string()), ("path", pa.binary())])
    for batch in batches:
        for group, block, n, size, nodes, sides, path in zip(*(batch.column(c).to_pylist() for c in ("group", "block", "n", "size", "nodes", "sides", "path")), strict=True):
            found = [siblings(nodes, height_of(n, size), size, k) for k in range(size)]
            rows = ([group] * size, [(block << HEIGHT) + k for k in range(size)], [s + (sides or "") for s, _ in found], [p + (path or b"") for _, p in found])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, schema.types, strict=True)], schema=schema)
    give_back()


def below(upper: DataFrame | None, tier: DataFrame) -> DataFrame:
    """Blocks with the way above their roots; a group's only block has none."""
    if upper is None:
        return tier.withColumns({"sides": F.lit(None).cast("string"), "path": F.lit(None).cast("binary")})
    on = tier["group"].eqNullSafe(upper["group"]) & (tier["block"] == upper["i"])
    return tier.join(upper, on, "left").select(*[tier[c] for c in tier.columns], "sides", "path")


def proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents from blocks with the way to the root: proof, and the root folded from the (tampered) leaf."""
    schema = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_())])
    for batch in batches:
        for n, size, nodes, ids, tampered, sides, path, subroot, root in zip(*(batch.column(c).to_pylist() for c in ("n", "size", "nodes", "ids", "tampered", "sides", "path", "subroot", "top")), strict=True):
            height, rows = height_of(n, size), []
            for k in range(size):
                at = layout(height)[0][k] * DIGEST
                leaf = nodes[at : at + DIGEST]
                own, others = siblings(nodes, height, size, k)
                folded = fold(tampered[k] or leaf, own + sides, others + path)
                rows.append((ids[k], leaf.hex(), subroot.hex(), root.hex(), hashlib.sha256((others + path).hex().encode()).hexdigest(), folded.hex(), folded == root))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
    give_back()


def upward(tables: list[DataFrame], upper: DataFrame | None = None) -> DataFrame:
    """The way above each block of the lowest tier; ``upper`` is that above the groups' roots (group, sides, path)."""
    way = None
    for k in range(len(tables) - 1, -1, -1):
        at = below(way, tables[k])
        if upper is not None:
            tops = upper.select(F.col("group").alias("_g"), F.col("sides").alias("_s"), F.col("path").alias("_p"))
            only = F.col("n") <= 1 << HEIGHT
            at = at.join(tops, only & F.col("group").eqNullSafe(F.col("_g")), "left").withColumns({"sides": F.coalesce("sides", "_s"), "path": F.coalesce("path", "_p")}).drop("_g", "_s", "_p")
        if not k:
            return at
        way = stash(at.mapInArrow(ways, PATH), "ways")
    raise AssertionError


def roots(tables: list[DataFrame]) -> DataFrame:
    """(group, subroot) of all groups: each has one block where its tree ends."""
    out = None
    for tier in tables:
        top = tier.where(F.col("n") <= 1 << HEIGHT).select("group", F.col("root").alias("subroot"))
        out = top if out is None else out.union(top)
    return out


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every document."""
    order = [F.col("doc_id").asc_nulls_first(), F.col("leaf")]
    rows = numbered(leaves(docs), ["lang"], order, ["lang", "doc_id", "leaf", "tampered"])
    trees = tiers(rows.select(F.col("lang").alias("group"), "i", "n", "leaf", F.col("doc_id").alias("id"), "tampered"))
    tops = stash(roots(trees), "subroots")
    by_lang = tops.withColumn("one", F.lit("languages"))
    ranked = stash(numbered(by_lang, ["one"], [F.col("group").asc_nulls_first()], ["group", "subroot", "one"]), "ranked")
    forest = tiers(ranked.select(F.col("one").alias("group"), "i", "n", F.col("subroot").alias("leaf"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("tampered")))
    above = stash(upward(forest).mapInArrow(ways, PATH), "ways")
    root = roots(forest).select(F.col("subroot").alias("top"))  # one row
    langs = stash(ranked.join(above.select("i", "sides", "path"), "i").select("group", "subroot", "sides", "path").crossJoin(F.broadcast(root)), "languages")
    ends = langs.select(F.col("group").alias("_group"), "subroot", "top")
    found = upward(trees, langs)
    return found.join(ends, F.col("group").eqNullSafe(F.col("_group"))).mapInArrow(proofs, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(read(spark, sf_dir, "documents"))
