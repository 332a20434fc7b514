"""Prefix trie of conversations as burst tries: containers of suffixes under trie heads, burst while they are too large, then sorted and swept into nodes.

A turn is known by 16 bytes of a SHA-256 of its role and text. A conversation is cut into segments of SEGMENT turns, so that no row
grows with a conversation; segments after equal beginnings form one trie of their own (a unit), rooted at the node where the beginning ends. Equal segments of a unit are
one row with its number of conversations. At first a unit is one container. A container with more than CONTAINER distinct suffixes
bursts: its root becomes a head, and its suffixes move to one container for each next turn id. What remains is dealt out by
container, sorted by the bytes of the suffix, and swept in one pass that holds the nodes of one path only. Sums over subtrees that span
containers come from pointer doubling over the tree of containers, in as many steps as the logarithm of its depth.

Nulls: rows without conv_id belong to no conversation; a null turn comes first, a null role or text is empty. Equal turn numbers are ordered
by role and text; repeated rows are turns of their own. A conversation without turns is a member of the root. No rows, no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import give_back, numbered, read, small_batches, stash

#: Turns of a segment, bytes of a turn id, distinct suffixes of a container that is not burst, ids hashed as one text.
SEGMENT, ID, CONTAINER, TEXT_IDS = 16, 16, 2048, 2048


def short_hash(*parts: F.Column) -> F.Column:
    return F.unhex(F.substring(F.sha2(F.concat(*parts), 256), 1, 2 * ID))


def prefix_key(unit: F.Column, prefix: F.Column, full: F.Column) -> F.Column:
    """Key of the node at the end of ``prefix`` (ids in a row) in a unit; ``full`` is that of a whole segment."""
    size = F.octet_length(prefix)
    return F.when(size == 0, unit).when(size == SEGMENT * ID, full).otherwise(short_hash(unit, F.lit(b"/"), prefix))


def turns(talks: DataFrame) -> DataFrame:
    """Rows of conversations with their turn's id, characters and place, and the conversation's number of turns."""
    rows = talks.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    rows = rows.withColumn("id", short_hash(F.octet_length("role").cast("string").cast("binary"), F.lit(b":"), F.col("role").cast("binary"), F.col("text").cast("binary"))).withColumn("chars", F.char_length("text").cast("long"))
    return stash(numbered(rows, ["conv"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], ["conv", "id", "chars"]), "turns")


def shared_starts(rows: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """Conversations rebuilt: each begins with the first crc32(conv) % most turns of conversation conv - conv % group.

    (conv, place, id, chars, length); a conversation has a row without id, too, which stands for its existence.
    """
    heads = rows.where(F.col("i") < most - 1).groupBy(F.col("conv").alias("base")).agg(F.sort_array(F.collect_list(F.struct("i", "id", "chars"))).alias("head"))
    taken = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).cast("int")
    convs = rows.where("i = 0").select("conv", "n", taken.alias("h"), (F.col("conv") - F.col("conv") % group).alias("base")).join(heads, "base", "left")
    convs = convs.withColumn("head", F.when(F.col("head").isNotNull() & (F.col("h") > 0), F.slice("head", F.lit(1), F.greatest("h", F.lit(1)))))
    convs = convs.withColumn("given", F.greatest(F.size("head"), F.lit(0)).cast("long")).withColumn("length", F.col("given") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = stash(convs.select("conv", "h", "head", "given", "length"), "convs")
    first = convs.select("conv", F.explode("head").alias("t"), "length").select("conv", F.col("t.i").alias("place"), "t.id", "t.chars", "length")
    own = rows.where(F.col("i") >= taken).join(convs.drop("head"), "conv").select("conv", (F.col("i") - F.col("h") + F.col("given")).alias("place"), "id", "chars", "length")
    stands = convs.select("conv", F.lit(0).cast("long").alias("place"), F.lit(None).cast("binary").alias("id"), F.lit(None).cast("long").alias("chars"), "length")
    return first.unionByName(own).unionByName(stands)


def segments(rebuilt: DataFrame) -> DataFrame:
    """(conv, seg, unit, seq, chars, full, goes_on): the ids of a segment in a row, its unit's key and the key of what may follow it.

    Keys of units are sums of hashes of (number, segment), so that they come from one running sum over a conversation's segments.
    """
    part = F.expr(f"cast(place div {SEGMENT} as long)")
    seen = F.sort_array(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("place", "id", "chars"))))
    rows = rebuilt.groupBy("conv", part.alias("seg")).agg(seen.alias("t"), F.max("length").alias("length"))
    rows = rows.select("conv", "seg", "length", F.unhex(F.array_join(F.transform("t", lambda x: F.hex(x.id)), "")).alias("seq"), F.transform("t", lambda x: x.chars).alias("chars"), (F.col("length") > (F.col("seg") + 1) * SEGMENT).alias("goes_on"))
    rows = rows.withColumn("digest", F.sha2(F.concat(F.col("seg").cast("string").cast("binary"), F.lit(b":"), F.col("seq")), 256))
    sums = {f"v{k}": F.conv(F.substring("digest", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)") for k in range(4)}
    rows = stash(rows.withColumns(sums).drop("digest"), "segments")
    short = rows.where(F.col("length") <= SEGMENT)
    until = W.partitionBy("conv").orderBy("seg").rowsBetween(W.unboundedPreceding, 0)
    long = rows.where(F.col("length") > SEGMENT).withColumns({v: F.sum(v).over(until).cast("decimal(38,0)") for v in sums}).withColumns({f"{v}_before": F.lag(v).over(W.partitionBy("conv").orderBy("seg")) for v in sums})

    def key(number: F.Column, names: list[str]) -> F.Column:
        return short_hash(F.concat_ws(":", number.cast("string"), *[F.col(v).cast("string") for v in names]).cast("binary"))

    columns = ("conv", "seg", "seq", "chars", "goes_on")
    full = F.when(F.octet_length("seq") == SEGMENT * ID, key(F.col("seg") + 1, list(sums))).alias("full")
    top = F.lit(b"").alias("unit")
    return short.select(*columns, top, full).unionByName(long.select(*columns, F.when(F.col("seg") == 0, top).otherwise(key(F.col("seg"), [f"{v}_before" for v in sums])).alias("unit"), full))


NODE = "cid binary, key binary, parent binary, seg long, root boolean, depth long, n long, least long, children long, leaves long, saved long, up array<binary>"


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of containers from rows sorted by (container, suffix); holds the nodes of one path.

    ``leaves`` and ``saved`` are sums over the container; a node that goes on in another unit lists its ancestors within the container in ``up``.
    """
    schema = pa.schema([(name, {"binary": pa.binary(), "long": pa.int64(), "boolean": pa.bool_(), "array<binary>": pa.list_(pa.binary())}[kind]) for name, kind in (x.split() for x in NODE.split(", "))])
    out: list[tuple] = []
    path: list[list] = []  # [key, depth in the segment, n, least, children, leaves, saved, characters of its last turn, goes on]
    now, seq, seg, start, above = None, b"", 0, 0, None

    def close(depth: int) -> None:
        while path and path[-1][1] > depth:
            key, d, n, least, children, leaves, saved, chars, goes_on = path.pop()
            leaves += not children and not goes_on
            saved += (n - 1) * chars
            up = [x[0] for x in path] + [key] if goes_on else None
            out.append((now, key, path[-1][0] if path else above, seg, not path, seg * SEGMENT + d, n, least, children, leaves, saved, up))
            if path:
                p = path[-1]
                p[2], p[3], p[4], p[5], p[6] = p[2] + n, least if p[3] is None else min(p[3], least), p[4] + 1, p[5] + leaves, p[6] + saved

    def emit() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
        out.clear()
        return rows

    for batch in batches:
        for cid, d0, unit, s, ids, chars, n, least, full, goes_on in zip(*(batch.column(c).to_pylist() for c in ("cid", "d", "unit", "seg", "seq", "chars", "n", "least", "full", "goes_on")), strict=True):
            size = len(ids) // ID

            def key(d: int, unit=unit, ids=ids, full=full) -> bytes:
                return unit if not d else full if d == SEGMENT else hashlib.sha256(unit + b"/" + ids[: d * ID]).digest()[:ID]

            if cid != now:
                close(-1)
                now, seg, start, same = cid, s, d0, d0
                above = key(d0 - 1) if d0 else None
                path.append([key(d0), d0, 0, None, 0, 0, 0, chars[d0 - 1] if d0 else 0, False])
            else:
                same = start
                while same < size and ids[same * ID : same * ID + ID] == seq[same * ID : same * ID + ID]:
                    same += 1
                close(same)
            for d in range(same + 1, size + 1):
                path.append([key(d), d, 0, None, 0, 0, 0, chars[d - 1], False])
            last = path[-1]
            last[2], last[3], last[8] = last[2] + n, least if last[3] is None else min(last[3], least), goes_on
            seq = ids
            if len(out) >= 4096:
                yield emit()
    close(-1)
    if out:
        yield emit()
    give_back()


def burst(units: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(suffixes in containers of at most CONTAINER of them, heads): heads have the columns of nodes, but sums of their own node only."""
    active = stash(units.withColumns({"cid": F.col("unit"), "d": F.lit(0)}), "containers")
    kept: list[DataFrame] = []
    heads: list[DataFrame] = []
    for d in range(SEGMENT):
        large = stash(active.groupBy("cid").count().where(F.col("count") > CONTAINER).select("cid"), "large")
        if large.isEmpty():
            break
        kept.append(active.join(large, "cid", "left_anti"))
        over = active.join(large, "cid")
        chars = F.first(F.element_at("chars", d)) if d else F.lit(0)
        above = prefix_key(F.col("unit"), F.expr(f"substring(seq, 1, {ID * (d - 1)})"), F.col("full")) if d else F.lit(None).cast("binary")
        head = over.groupBy("cid", "seg").agg(F.first(above).alias("parent"), F.sum("n").alias("n"), F.min("least").alias("least"), chars.cast("long").alias("chars"))
        heads.append(head.select("cid", F.col("cid").alias("key"), "parent", "seg", F.lit(True).alias("root"), (F.col("seg") * SEGMENT + d).alias("depth"), "n", "least", F.lit(0).cast("long").alias("children"), F.lit(0).cast("long").alias("leaves"), ((F.col("n") - 1) * F.col("chars")).alias("saved"), F.lit(None).cast("array<binary>").alias("up")))
        here = prefix_key(F.col("unit"), F.expr(f"substring(seq, 1, {ID * (d + 1)})"), F.col("full"))
        # A whole segment's key is that of the next unit's root, whose container must be another.
        if d + 1 == SEGMENT:
            here = short_hash(here, F.lit(b"|"))
        active = stash(over.where(F.octet_length("seq") > ID * d).withColumns({"cid": here, "d": F.lit(d + 1)}), "containers")
    for more in kept:
        active = active.unionByName(more)
    union = None
    for head in heads:
        union = head if union is None else union.unionByName(head)
    return active, union


def over_subtrees(tree: DataFrame) -> DataFrame:
    """(cid, anc, leaves, saved) with sums over the subtree of each container: step k adds what lies 2**k to 2**(k+1) - 1 containers below."""
    tree = stash(tree, "tree")
    while not (below := tree.where("anc is not null")).isEmpty():
        gains = below.groupBy(F.col("anc").alias("cid")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        jump = below.select("cid", "anc").join(below.select(F.col("cid").alias("anc"), F.col("anc").alias("next")), "anc").select("cid", "next")
        tree = tree.drop("anc").join(gains, "cid", "left").join(jump, "cid", "left")
        tree = stash(tree.select("cid", F.col("next").alias("anc"), *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")]), "tree")
    return tree


def id_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of at most TEXT_IDS ids of a node, from rows sorted by (node, id), as one text each."""
    key, ids = None, []

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "low": pa.array([ids[0]], pa.int64()), "ids": [",".join(map(str, ids))]})

    for batch in batches:
        for k, c in zip(batch.column("key").to_pylist(), batch.column("conv").to_pylist(), strict=True):
            if ids and (k != key or len(ids) == TEXT_IDS):
                yield row()
                ids = []
            key = k
            ids.append(c)
    if ids:
        yield row()


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ids, from its texts in order; a hash in progress is all that is held."""
    key, state = None, None
    for batch in batches:
        done: list[tuple[bytes, str]] = []
        for k, text in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if state is not None and k == key:
                state.update(b",")
            else:
                if state is not None:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256()
            state.update(text.encode())
        if done:
            yield pa.RecordBatch.from_pydict({"key": pa.array([k for k, _ in done], pa.binary()), "ends": [h for _, h in done]})
    if state is not None:
        yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "ends": [state.hexdigest()]})
    give_back()


def ends_of(rows: DataFrame) -> DataFrame:
    """(key, ends): the hash of the conversations that end at a node. Ids are gathered into texts over ranges first, so one task reads few rows even of a hot node."""
    texts = rows.repartitionByRange("key", "conv").sortWithinPartitions("key", "conv").mapInArrow(id_texts, "key binary, low long, ids string")
    return texts.repartition("key").sortWithinPartitions("key", "low").mapInArrow(digests, "key binary, ends string")


def trie(rebuilt: DataFrame) -> DataFrame:
    """Nodes of the prefix trie of rebuilt conversations (as ``shared_starts`` gives them)."""
    small_batches(rebuilt.sparkSession)
    parts = stash(segments(rebuilt), "parts")
    ends = stash(ends_of(parts.where("not goes_on").select(prefix_key(F.col("unit"), F.col("seq"), F.col("full")).alias("key"), "conv")), "ends")
    units = parts.groupBy("unit", "seg", "seq").agg(F.first("chars").alias("chars"), F.count("*").alias("n"), F.min("conv").alias("least"), F.max("full").alias("full"), F.max("goes_on").alias("goes_on"))
    suffixes, heads = burst(units)
    swept = stash(suffixes.repartition("cid").sortWithinPartitions("cid", "seq").mapInArrow(sweep, NODE), "swept")
    heads = stash(heads, "heads") if heads is not None else swept.where("false")
    goes_on = swept.where("up is not null")
    roots = swept.where("root").unionByName(heads)
    # A unit's root container hangs below the container that has the node where it goes on, any other one below its head.
    anc = F.when(F.col("depth") > F.col("seg") * SEGMENT, F.col("parent")).otherwise(F.col("under"))
    tree = roots.join(goes_on.select("key", F.col("cid").alias("under")), "key", "left").select("cid", anc.alias("anc"), "leaves", "saved")
    sums = over_subtrees(tree)
    # By unit, too: the root of a unit has the key of the node that it continues.
    from_below = goes_on.select(F.col("key").alias("cid"), "seg", F.explode("up").alias("key")).join(sums, "cid").groupBy("key", "seg").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    plus = lambda c: (F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c)
    inner = swept.join(from_below, ["key", "seg"], "left").select("key", "parent", "seg", "depth", "n", "least", "children", plus("leaves"), plus("saved"))
    below = roots.where(F.col("depth") > F.col("seg") * SEGMENT).groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("children"))
    outer = heads.drop("leaves", "saved", "children").join(sums.drop("anc"), "cid").join(below, "key").select(*inner.columns)
    # The root of a unit is the node where the segment before ends: it adds its children there, all else is counted by that node.
    again = (F.col("seg") > 0) & (F.col("depth") == F.col("seg") * SEGMENT)
    nodes = inner.unionByName(outer).select("key", "parent", "depth", "n", "least", "children", *[F.when(again, 0).otherwise(F.col(c)).alias(c) for c in ("leaves", "saved")])
    nodes = nodes.groupBy("key").agg(*[F.max(c).alias(c) for c in ("parent", "depth", "n")], F.min("least").alias("least"), *[F.sum(c).alias(c) for c in ("children", "leaves", "saved")])
    nodes = stash(nodes, "nodes")
    named = nodes.join(nodes.select(F.col("key").alias("parent"), F.col("least").alias("parent_conv_id")), "parent", "left").join(ends, "key", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return named.select(F.col("least").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(nothing)).alias("ends_sha256"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(shared_starts(turns(read(spark, sf_dir, "conversations"))))
