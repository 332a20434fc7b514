"""Operator 8: removal of repeated strings by a hash-compared suffix sort.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else, in this document or another.

1. Of the SEED-byte strings in every LENGTH bytes, the one with the least hash is an anchor. Equal strings of LENGTH
   bytes have equal anchors, so repeats meet over an anchor that occurs twice. Anchor hashes are counted, and the
   repeated ones go to the tasks as a bitmap of fixed size.
2. Around every repeated anchor the bytes that a string of LENGTH bytes can reach are its context. A context that a
   task meets twice needs no comparing: one row stands for it, so that a passage in a third of all documents makes
   a row a task.
3. The contexts of an anchor are sorted by what follows the anchor and by what precedes it, in merge sorts that compare
   suffixes by their longest common extension: a binary search over hashes from prefix polynomial hashes. Neighbours in
   these orders have the longest extensions; extensions are then verified byte by byte. If what neighbours
   share does not settle which strings repeat, hashes of the strings in doubt do, and equal ones are compared by bytes too, as
   are contexts before one stands for others.
4. Each document drops what repeats.

An anchor with more than HOT occurrences would gather its contexts in one task. Those are dealt out by more of the text
around the anchor, in DEALS ways of which every string of LENGTH bytes shares one, so that only contexts with more than
LENGTH - REACH / DEALS equal bytes meet.

Null texts are empty. Texts below LENGTH bytes keep all. Rows with the same doc_id are each other's copies like any
others, each judged by its own text; a row without doc_id counts as any other. Ties cannot arise: strings are judged on the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BITMAP_BITS, U64, PrefixHash, chunks, id_bitmap, in_bitmap, mix64, read, row_key, signed, small_batches, stash

LENGTH = 200
SEED = 56
#: Contexts a task sorts together (a hot anchor's distinct contexts may be more).
BUCKET_ROWS = 8000
#: Occurrences beyond which an anchor's contexts are dealt out, and in how many ways.
HOT, DEALS = 20_000, 6
#: Contexts that a task gathers before it hands them on.
HELD_ROWS = 40_000
NEVER = U64(2**64 - 1)


def _sliding(values: np.ndarray, width: int, ufunc: np.ufunc, fill: int) -> np.ndarray:
    """``ufunc`` over every ``width`` consecutive values, from blocks accumulated in both directions."""
    count = len(values) - width + 1
    full = np.full(-(-len(values) // width) * width, U64(fill), U64)
    full[: len(values)] = values
    blocks = full.reshape(-1, width)
    ahead = ufunc.accumulate(blocks, axis=1).ravel()
    behind = ufunc.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return ufunc(behind[:count], ahead[width - 1 : width - 1 + count])


def anchors(buf: np.ndarray, offsets: np.ndarray, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, PrefixHash]:
    """Positions of the anchors in a chunk of whole documents, and their hashes.

    A position is an anchor if its hash is the least in some window; that depends on the window's bytes alone.
    Windows across documents add a few anchors that do no harm.
    """
    hashes = PrefixHash(buf)
    n, width = len(buf) - seed + 1, length - seed + 1
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, U64), hashes
    value = mix64(hashes.of(np.arange(n), seed))
    value[value == NEVER] = NEVER - U64(1)
    ends = offsets[1:-1]
    inner = (ends[:, None] - np.arange(1, seed)).ravel()  # no seed crosses documents
    value[inner[(inner >= 0) & (inner < n)]] = NEVER
    least = _sliding(value, width, np.minimum, 2**64 - 1)
    around = np.concatenate([np.zeros(width - 1, U64), least, np.zeros(width - 1, U64)])
    pos = np.flatnonzero((_sliding(around, width, np.maximum, 0) == value) & (value != NEVER))
    return pos, value[pos], hashes


def repeated_anchors(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """Anchor hashes that occur twice or more."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, offsets in chunks(batch):
                h, n = np.unique(anchors(buf, offsets, length, seed)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(n)], ["anchor", "n"])

    return docs.select("text").mapInArrow(task, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") > 1)


def _cells(h: np.ndarray) -> np.ndarray:
    return (h & U64(BITMAP_BITS - 1)).astype(np.int64)


ROW = "anchor long, fp long, before int, context binary, doc long, start long, size int, many boolean"


def dealt(pos: np.ndarray, low: np.ndarray, high: np.ndarray, h: np.ndarray, hot: np.ndarray, hashes: PrefixHash, reach: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, group) of contexts: the anchor's hash as the group, for hot anchors groups by more of the text, a row for each."""
    rows, groups = [np.flatnonzero(~hot)], [h[~hot]]
    at = np.flatnonzero(hot)
    for i in range(DEALS if len(at) else 0):
        left, right = reach * i // DEALS, reach - reach * (i + 1) // DEALS
        own = at[(pos[at] - left >= low[at]) & (pos[at] + seed + right <= high[at])]
        rows.append(own)
        groups.append(mix64(hashes.of(pos[own] - left, left + seed + right) + U64(i + 1)))
    return np.concatenate(rows), np.concatenate(groups)


def contexts(docs: DataFrame, repeated: DataFrame, length: int = LENGTH, seed: int = SEED, hot: int = HOT) -> DataFrame:
    """A row for each occurrence of a repeated anchor with its context, as ROW; docs has (key, text).

    A context that a task meets twice repeats for certain: its occurrences come as rows without context (the whole
    of it goes), and one row without document stands for it, so that hot passages make few rows and no hot task.
    """
    cell = F.col("anchor").bitwiseAND(F.lit(BITMAP_BITS - 1)).alias("cell")
    sent = id_bitmap(repeated.select(cell), "cell", hashed=False)
    warm = id_bitmap(repeated.where(F.col("n") > hot).select(cell), "cell", hashed=False)
    reach = length - seed
    names = [c.split()[0] for c in ROW.split(", ")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            anchor, fp, before, size, doc, start = (np.concatenate([h[k] for h in held]) for k in range(6))
            texts = [t for h in held for t in h[6]]
            held.clear()
            order = np.lexsort((fp, anchor))
            anchor, fp, before, size, doc, start = (x[order] for x in (anchor, fp, before, size, doc, start))
            new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (fp[1:] != fp[:-1])])
            new |= differs([texts[i] for i in order.tolist()], new)
            count = np.diff(np.append(np.flatnonzero(new), len(new)))
            many = np.repeat(count > 1, count)
            lead = np.flatnonzero(new & many)
            # Occurrences (with a context where single), then one row for each repeated context.
            at = np.concatenate([np.arange(len(new)), lead])
            with_text = np.concatenate([~many, np.ones(len(lead), bool)])
            text = pa.array([texts[order[i]] if w else None for i, w in zip(at.tolist(), with_text.tolist(), strict=True)], pa.binary())
            no_doc = np.concatenate([np.zeros(len(new), bool), np.ones(len(lead), bool)])
            columns = [signed(anchor[at]), signed(fp[at]), before[at].astype(np.int32), text, pa.array(doc[at], mask=no_doc), start[at], size[at].astype(np.int32), no_doc]
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)

        for batch in batches:
            ids = batch.column("key").to_numpy(zero_copy_only=False)
            for i, _, buf, offsets in chunks(batch):
                pos, h, hashes = anchors(buf, offsets, length, seed)
                keep = in_bitmap(sent.value, _cells(h))
                pos, h = pos[keep], h[keep]
                doc = np.searchsorted(offsets, pos, "right") - 1
                low, high = np.maximum(pos - reach, offsets[doc]), np.minimum(pos + length, offsets[doc + 1])
                keep = high - low >= length
                pos, h, doc, low, high = (x[keep] for x in (pos, h, doc, low, high))
                if not len(pos):
                    continue
                row, group = dealt(pos, low, high, h, in_bitmap(warm.value, _cells(h)), hashes, reach, seed)
                pos, doc, low, high = (x[row] for x in (pos, doc, low, high))
                fp = mix64(hashes.of(low, high - low) + mix64(((pos - low) << 20 | (high - low)).astype(U64)))
                raw = buf.tobytes()
                held.append((group, fp, pos - low, high - low, ids[doc + i], low - offsets[doc], [raw[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)]))
                if sum(len(x[0]) for x in held) > HELD_ROWS:
                    yield out()
        if held:
            yield out()

    return docs.select("key", "text").mapInArrow(task, ROW)


def differs(texts: list[bytes], new: np.ndarray) -> np.ndarray:
    """Marks of rows that are not ``new`` but whose text is not that of the row before: hashes collided."""
    out = np.zeros(len(new), bool)
    for i in np.flatnonzero(~new).tolist():
        out[i] = texts[i] != texts[i - 1]
    return out


class Suffixes:
    """Suffixes of a buffer, each with an end, compared by their longest common extension."""

    def __init__(self, buf: np.ndarray, start: np.ndarray, length: np.ndarray):
        self.buf, self.start, self.length, self.hashes = buf, start, length, PrefixHash(buf)

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes i and j: a binary search over equal hashes."""
        a, b = self.start[i], self.start[j]
        low, high = np.zeros(len(i), np.int64), np.minimum(self.length[i], self.length[j])
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = self.hashes.of(a, mid) == self.hashes.of(b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def verified(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The same by comparing the bytes that hashes call equal, so that a collision changes nothing."""
        size = self.extension(i, j)
        out = size.copy()
        for k in range(0, len(i), 20_000):
            n = size[k : k + 20_000]
            inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            row = np.repeat(np.arange(len(n)), n)
            wrong = np.flatnonzero(self.buf[self.start[i[k : k + 20_000]][row] + inside] != self.buf[self.start[j[k : k + 20_000]][row] + inside])
            np.minimum.at(out, k + row[wrong], inside[wrong])
        return out

    def less(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        n = self.extension(i, j)
        end_i, end_j = n == self.length[i], n == self.length[j]
        last = len(self.buf) - 1
        return np.where(end_i, ~end_j, ~end_j & (self.buf[np.minimum(self.start[i] + n, last)] < self.buf[np.minimum(self.start[j] + n, last)]))

    def sort(self, group: np.ndarray) -> np.ndarray:
        """Order of the suffixes in each group (consecutive numbers from 0): a merge sort, all groups at once."""
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        base, size = first[group], np.diff(np.append(first, len(group)))[group]
        order, width = np.arange(len(group)), 1
        while True:
            todo = np.flatnonzero(size > width)
            if not len(todo):
                return order
            place = todo - base[todo]
            run = place // (2 * width) * (2 * width)
            right = place - run >= width
            mid = np.minimum(run + width, size[todo])
            end = np.minimum(run + 2 * width, size[todo])
            low, high = np.where(right, run, mid), np.where(right, mid, end)
            begin = low.copy()
            me = order[todo]
            while True:
                act = np.flatnonzero(low < high)
                if not len(act):
                    break
                mid_ = (low[act] + high[act]) >> 1
                other = order[base[todo[act]] + mid_]
                # A left element goes before equal right ones.
                ahead = np.where(right[act], ~self.less(me[act], other), self.less(other, me[act]))
                low[act], high[act] = np.where(ahead, mid_ + 1, low[act]), np.where(ahead, high[act], mid_)
            new = base[todo] + np.where(right, place - width, place) + (low - begin)
            out = order.copy()
            out[new] = me
            order, width = out, 2 * width


def inside(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of the ranges start .. start + size - 1."""
    row = np.repeat(np.arange(len(start)), size)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)


#: More than any position in a context.
WIDE = 1 << 32


def joined(row: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges a .. b - 1 of rows, overlapping and touching ones made one, in order."""
    order = np.lexsort((a, row))
    row, a, b = row[order], a[order], b[order]
    if not len(row):
        return row, a, b
    far = np.maximum.accumulate(row * WIDE + b)
    new = np.concatenate([[True], row[1:] * WIDE + a[1:] > far[:-1]])
    first = np.flatnonzero(new)
    return row[first], a[first], far[np.append(first[1:], len(row)) - 1] - row[first] * WIDE


def doubtful(right: Suffixes, begin: np.ndarray, before: np.ndarray, after: np.ndarray, group: np.ndarray, asked: tuple[np.ndarray, np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, offset) of strings that repeat among a group's strings with that offset; asked: (context, offset) in doubt.

    Strings with equal hashes are compared by their bytes with the first of them.
    """
    size_of, first_of = np.bincount(group), np.searchsorted(group, np.arange(int(group.max(initial=-1)) + 1))
    pair = np.unique(group[asked[0]] * WIDE + asked[1])
    g, offset = pair // WIDE, pair % WIDE
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    done = 0
    while done < len(pair):
        stop = max(done + 1, int(np.searchsorted(np.cumsum(size_of[g[done:]]), 200_000, "right")) + done)
        k, member = inside(first_of[g[done:stop]], size_of[g[done:stop]])
        a = offset[done:stop][k]
        fit = (before[member] >= a) & (after[member] >= length - a)
        k, member, a = k[fit], member[fit], a[fit]
        at = begin[member] + before[member] - a
        h = right.hashes.of(at, length)
        order = np.lexsort((h, k))
        k, member, a, at, h = (x[order] for x in (k, member, a, at, h))
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (h[1:] != h[:-1])]) if len(k) else np.zeros(0, bool)
        lead = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0)) if len(k) else np.zeros(0, np.int64)
        other = np.flatnonzero(~new)
        same = np.zeros(len(k), bool)
        for j in range(0, len(other), 10_000):
            o = other[j : j + 10_000]
            step = np.arange(length)
            equal = (right.buf[at[o][:, None] + step] == right.buf[at[lead[o]][:, None] + step]).all(axis=1)
            same[o] = equal
            same[lead[o[equal]]] = True
        out.append((member[same], a[same]))
        done = stop
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def repeats(anchor: np.ndarray, before: np.ndarray, texts: list[bytes], many: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first byte, end) of the ranges that repeated strings cover, in order of context; ``many``: the context occurs twice itself.

    Contexts of one anchor stand together.
    """
    n = len(texts)
    buf = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts])
    begin = np.cumsum(size) - size
    after = size - before
    group = np.cumsum(np.concatenate([[True], anchor[1:] != anchor[:-1]])) - 1
    right = Suffixes(buf, begin + before, after)
    left = Suffixes(buf[::-1].copy(), len(buf) - (begin + before), before)
    r_most, l_most = np.zeros(n, np.int64), np.zeros(n, np.int64)
    spans = []
    for own in (right, left):
        order = own.sort(group)
        a, b = order[:-1], order[1:]
        same = group[a] == group[b]
        a, b = a[same], b[same]
        r, l = right.verified(a, b), left.verified(a, b)  # noqa: E741
        for x in (a, b):
            np.maximum.at(r_most, x, r)
            np.maximum.at(l_most, x, l)
            spans.append((x, r, l))
    x, r, l = (np.concatenate(c) for c in zip(*spans, strict=True))  # noqa: E741
    low = np.maximum(length - r, 0)
    ok = (low <= l) & ~many[x]
    # Strings that begin `a` bytes before the anchor, a from low to high, repeat.
    x, low, high = joined(x[ok], low[ok], l[ok] + 1)
    # In doubt is what lies between the longest extensions on either side but in none of these ranges.
    open_ = np.flatnonzero((length - r_most <= l_most) & ~many)
    edge_row = np.concatenate([open_, x])
    edge = np.concatenate([np.maximum(0, length - r_most[open_]), high])
    stop_row, stop = np.concatenate([x, open_]), np.concatenate([low, l_most[open_] + 1])
    o1, o2 = np.lexsort((edge, edge_row)), np.lexsort((stop, stop_row))
    row, gap, end = edge_row[o1], edge[o1], stop[o2]
    wide = end > gap
    k, offset = inside(gap[wide], (end - gap)[wide])
    more, a = doubtful(right, begin, before, after, group, (row[wide][k], offset), length) if len(k) else (np.zeros(0, np.int64),) * 2
    more, a = more[~many[more]], a[~many[more]]
    x, low, high = np.concatenate([x, more]), np.concatenate([low, a]), np.concatenate([high, a + 1])
    whole = np.flatnonzero(many)
    return joined(np.concatenate([x, whole]), np.concatenate([before[x] - high + 1, np.zeros(len(whole), np.int64)]), np.concatenate([before[x] - low + length, size[whole]]))


def with_keys(docs: DataFrame) -> DataFrame:
    """(doc_id, text, key): doc_id as the key of a row, and where several rows have it, a hash of it and the text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key().alias("key"))
    several = stash(rows.groupBy("key").count().where("count > 1").select("key", F.lit(True).alias("several")), "several")
    if several.isEmpty():
        return rows
    rows = rows.join(several, "key", "left")
    return rows.select("doc_id", "text", F.when(F.col("several"), F.xxhash64("key", F.coalesce("text", F.lit("")))).otherwise(F.col("key")).alias("key"))


def removed(rows: DataFrame, length: int = LENGTH, seed: int = SEED, hot: int = HOT) -> DataFrame:
    """(own_key, spans): the ranges of bytes of each row of (key, text) that repeated strings cover, unmerged."""
    small_batches(rows.sparkSession)
    repeated = stash(repeated_anchors(rows, length, seed), "anchors")
    n_buckets = max(1, (repeated.agg(F.sum("n")).first()[0] or 0) // BUCKET_ROWS)
    # Rows that need no comparing are dealt by document.
    deal = F.when(F.col("context").isNull(), F.xxhash64("doc", "start")).otherwise(F.xxhash64("anchor"))
    found = contexts(rows, repeated, length, seed, hot).withColumn("bucket", F.pmod(deal, F.lit(n_buckets)))

    def task(table: pa.Table) -> pa.Table:
        has_text = np.asarray(table.column("context").is_valid())
        done = table.filter(pa.array(~has_text))
        doc, start, size = (done.column(c).to_numpy() for c in ("doc", "start", "size"))
        out = [(doc, start, start + size)]
        table = table.filter(pa.array(has_text))
        if table.num_rows:
            anchor, fp = table.column("anchor").to_numpy(), table.column("fp").to_numpy()
            order = np.lexsort((fp, anchor))
            table, anchor, fp = table.take(pa.array(order)), anchor[order], fp[order]
            texts = table.column("context").to_pylist()
            new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (fp[1:] != fp[:-1])])
            new |= differs(texts, new)
            first, own = np.flatnonzero(new), np.cumsum(new) - 1
            times = np.bincount(own, np.where(table.column("many").to_numpy(), 2, 1))
            before = table.column("before").to_numpy().astype(np.int64)[first]
            row, a, b = repeats(anchor[first], before, [texts[i] for i in first.tolist()], times > 1, length)
            real = np.asarray(table.column("doc").is_valid())
            doc, start = (table.column(c).filter(pa.array(real)).to_numpy() for c in ("doc", "start"))
            low = np.searchsorted(row, own[real])
            k, span = inside(low, np.searchsorted(row, own[real], "right") - low)
            out.append((doc[k], start[k] + a[span], start[k] + b[span]))
        doc, a, b = (np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True))
        ids, row = np.unique(doc, return_inverse=True)
        row, a, b = joined(row, a, b)
        return pa.table({"own_key": ids[row], "a": a, "b": b})

    hit = found.groupBy("bucket").applyInArrow(task, "own_key long, a long, b long")
    return hit.groupBy("own_key").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, keep_text: bool = False, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``keep_text`` the bytes kept."""
    keyed = with_keys(docs)
    rows = keyed.join(removed(keyed.select("key", "text"), length, seed, hot), F.col("key") == F.col("own_key"), "left").select("doc_id", "text", "spans")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("spans")
            flat = lists.flatten()
            count = np.asarray(lists.value_lengths().fill_null(0))
            row, a, b = joined(np.repeat(np.arange(len(count)), count), flat.field(0).to_numpy(), flat.field(1).to_numpy())
            n_spans, gone = np.bincount(row, minlength=len(count)), np.bincount(row, b - a, minlength=len(count)).astype(np.int64)
            ends, n_bytes, sha, left = np.cumsum(n_spans), [], [], []
            for i, text in enumerate(batch.column("text").cast(pa.large_binary()).to_pylist()):
                text, at, kept = text or b"", 0, []
                for k in range(int(ends[i] - n_spans[i]), int(ends[i])):
                    kept.append(text[at : a[k]])
                    at = int(b[k])
                kept.append(text[at:])
                kept = b"".join(kept)
                n_bytes.append(len(text))
                sha.append(hashlib.sha256(kept).hexdigest())
                left.append(kept if keep_text else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(gone), pa.array(n_spans.astype(np.int64)), pa.array(sha, pa.string()), pa.array(left, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    out = rows.mapInArrow(task, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if keep_text else out.drop("kept")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"))
