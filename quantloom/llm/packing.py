"""Operator 9: sum-of-squares online packing of token sequences.

Each task packs the documents it reads, in the order it reads them, without a shuffle. Full windows are cut off a
document first; what is left goes into the open window whose fill level minimises the sum of the squared numbers of
windows at each level. What is open when a task ends is closed by cutting pieces: full windows, then one window for
each power of two in the remainder, so that no token of padding is needed.

Null text is empty and packs as its end token alone. Empty tables give no rows; copies, repeated rows and rows
without doc_id are packed each.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import SPACE, U64, Table, chunks, give_back, read, small_batches, word_hashes, words

WINDOW = 2048
END_ID = 1
#: Units whose ids a task keeps; when there are more, the half used longest ago goes.
MOST_UNITS = 500_000
#: Units that the tokenizer is asked for at a time, and in one text.
ENCODE_UNITS, TEXT_UNITS = 4_000, 500
#: Sequence ids of a task: its partition number times this, and up.
SEQUENCES_A_TASK = 1 << 36

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

Piece = tuple[int, int, int, bytes]  # doc_id, start, doc_tokens, ids as bytes

LETTER, DIGIT, MARK, OTHER, WHOLE = 1, 2, 3, 4, 5
_CLASS = np.full(256, MARK, np.uint8)
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[128:] = DIGIT, LETTER, LETTER, OTHER
_CLASS[SPACE] = 0
AS_IS = np.arange(256, dtype=np.uint8)
#: Set in the hashes of words that are taken whole, whose case may matter.
WHOLE_SALT = U64(0x5851F42D4C957F2D)


def units(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, documents, kinds and hashes of the units of a chunk, i.e. of parts whose ids do not depend on what is around them.

    The tokenizer drops white space, ignores case and takes runs of letters, single digits and runs of other marks one by
    one. Kind LETTER: one such run or digit. Kind OTHER: an apostrophe with the letters after it, which may be a
    suffix to the tokenizer. Kind WHOLE: a word with characters beyond Latin letters, which may combine, or with the opening
    of a special token.
    """
    starts, ends, _ = words(buf, offsets)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0, U64)
    kind = _CLASS[buf]
    # Letters from U+00C0 to U+017F are two bytes and do not combine; U+0130 has a mark in lower case.
    lead = np.flatnonzero((buf[:-1] >= 0xC3) & (buf[:-1] <= 0xC5))
    code = buf[lead].astype(np.int64) << 8 | buf[lead + 1]
    lead = lead[(code != 0xC397) & (code != 0xC3B7) & (code != 0xC4B0)]
    kind[lead] = kind[lead + 1] = LETTER
    odd = np.concatenate([np.flatnonzero(kind == OTHER), np.flatnonzero((buf[:-1] == 60) & (buf[1:] == 124))])
    whole = np.zeros(len(starts), bool)
    whole[np.searchsorted(starts, odd, "right") - 1] = len(odd) > 0
    size = (ends - starts)[whole]
    kind[np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts[whole], size)] = WHOLE
    first = np.zeros(len(buf) + 1, bool)
    first[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    single = np.flatnonzero((buf[:-1] == 39) & (kind[:-1] == MARK) & (kind[1:] == LETTER))
    first[starts] = True
    single = single[first[single]]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    single = single[~edge[single + 1]]
    first[single + 1] = False
    last = first.copy()
    last[ends] = True
    inside = kind > 0
    first[:-1] &= inside
    last[1:] &= inside
    begin, end = np.flatnonzero(first[:-1]), np.flatnonzero(last[1:]) + 1
    sort = np.where(kind[begin] == WHOLE, WHOLE, LETTER)
    sort[np.searchsorted(begin, single)] = OTHER
    full = np.flatnonzero(sort == WHOLE)
    h = word_hashes(buf, begin, end)
    if len(full):
        h[full] = word_hashes(buf, begin[full], end[full], AS_IS) ^ WHOLE_SALT
    return begin, end, np.searchsorted(offsets, begin, "right") - 1, sort, h


class WordIds:
    """Token ids of texts. The tokenizer is asked once for each unit that a task meets; a table of bounded size keeps the answers.

    Units are told apart by 64-bit hashes.
    """

    def __init__(self, path: str, most: int = MOST_UNITS):
        # Tasks are what runs side by side; threads of the tokenizer would each keep memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.turn = 0
        self._fill(np.zeros(0, U64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, "<u4"))

    def _fill(self, keys: np.ndarray, counts: np.ndarray, used: np.ndarray, ids: np.ndarray) -> None:
        self.table = Table(keys, self.most)
        self.keys, self.counts, self.used, self.ids = keys, counts, used, ids
        self.at = np.cumsum(counts, dtype=np.int64) - counts

    def _tokens(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ask(self, texts: list[bytes], alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units, one after the other, and their numbers; runs that are no unit ``alone`` share a text."""
        found: list[np.ndarray] = [np.zeros(0, "<u4")] * len(texts)
        words_ = [t.decode("utf-8", "replace") for t in texts]
        runs_, rest = np.flatnonzero(~alone), np.flatnonzero(alone).tolist()
        for k in range(0, len(runs_), ENCODE_UNITS):
            parts = [runs_[i : i + TEXT_UNITS] for i in range(k, min(k + ENCODE_UNITS, len(runs_)), TEXT_UNITS)]
            for part, got in zip(parts, self._tokens([" ".join(words_[i] for i in p) for p in parts]), strict=True):
                ends = np.flatnonzero(self.closes[got]) + 1
                if len(ends) != len(part):  # a run of several tokenizer words
                    rest += part.tolist()
                    continue
                for i, ids in zip(part.tolist(), np.split(got, ends[:-1]), strict=True):
                    found[i] = ids
        for k in range(0, len(rest), ENCODE_UNITS):
            some = rest[k : k + ENCODE_UNITS]
            for i, ids in zip(some, self._tokens([words_[i] for i in some]), strict=True):
                found[i] = ids
        return np.concatenate([np.zeros(0, "<u4"), *found]), np.array([len(x) for x in found], np.int32)

    def _learn(self, h: np.ndarray, begin: np.ndarray, end: np.ndarray, sort: np.ndarray, raw: bytes) -> None:
        keys, first = np.unique(h, return_index=True)
        texts = [raw[a:b] if k == WHOLE else raw[a:b].lower() for a, b, k in zip(begin[first].tolist(), end[first].tolist(), sort[first].tolist(), strict=True)]
        ids, counts = self._ask(texts, sort[first] != LETTER)
        used = np.full(len(keys), self.turn, np.int32)
        if len(self.keys) + len(keys) > self.most or len(self.ids) + len(ids) > 8 * self.most:
            recent = np.argsort(-self.used, kind="stable")
            n_kept = min(max(0, self.most - len(keys)) // 2, int(np.searchsorted(np.cumsum(self.counts[recent]), 4 * self.most)))
            keep = np.sort(recent[: max(n_kept, int((self.used == self.turn).sum()))])
            old = self.counts[keep].astype(np.int64)
            place = np.arange(int(old.sum())) - np.repeat(np.cumsum(old) - old, old) + np.repeat(self.at[keep], old)
            self.most = max(self.most, len(keep) + len(keys))
            self._fill(self.keys[keep], self.counts[keep], self.used[keep], self.ids[place])
        self.at = np.append(self.at, len(self.ids) + np.cumsum(counts, dtype=np.int64) - counts)
        self.keys, self.counts, self.used, self.ids = (np.append(x, y) for x, y in ((self.keys, keys), (self.counts, counts), (self.used, used), (self.ids, ids)))
        self.table.add(keys)

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (little-endian 32 bits) of whole documents one after the other, each with the end id, and their numbers."""
        n = len(offsets) - 1
        begin, end, doc, sort, h = units(buf, offsets)
        self.turn += 1
        row = self.table.find(h)
        self.used[row[row >= 0]] = self.turn
        new = np.flatnonzero(row < 0)
        if len(new):
            self._learn(h[new], begin[new], end[new], sort[new], buf.tobytes())
            row = self.table.find(h)
        size = self.counts[row].astype(np.int64)
        out = np.full(int(size.sum()) + n, END_ID, "<u4")
        inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        ids = self.ids[inside + np.repeat(self.at[row], size)]
        out[np.arange(len(ids)) + np.repeat(doc, size)] = ids
        return out, np.bincount(doc, size, minlength=n).astype(np.int64) + 1


class Packer:
    """Open windows by fill level; ``close`` gets the pieces of a window that is done."""

    def __init__(self, close: Callable[[list[Piece]], None], window: int = WINDOW):
        self.close, self.window = close, window
        self.levels = np.zeros(window + 1, np.int64)
        self.open: list[list[list[Piece]]] = [[] for _ in range(window + 1)]

    def place(self, piece: Piece) -> None:
        size = len(piece[3]) // 4
        if size == self.window:
            self.close([piece])
            return
        n = self.levels
        # Change of the sum of squares when a window moves from level h to h + size; level 0 is a new window, a full one leaves.
        gain = 2 * n[size:] + 1
        gain[-1] = 0
        gain[1:] -= 2 * n[1 : self.window + 1 - size] - 1
        gain[1:][n[1 : self.window + 1 - size] == 0] = np.iinfo(np.int64).max
        level = int(gain.argmin())
        pieces = self.open[level].pop() if level else []
        n[level] -= level > 0
        pieces.append(piece)
        if level + size == self.window:
            self.close(pieces)
        else:
            self.open[level + size].append(pieces)
            n[level + size] += 1

    def finish(self) -> None:
        """Close what is open, cutting pieces: fullest windows first."""
        left = [p for level in reversed(self.open) for pieces in level for p in pieces]
        total = sum(len(p[3]) for p in left) // 4
        goals = [self.window] * (total // self.window) + [1 << b for b in range(self.window.bit_length(), -1, -1) if total % self.window >> b & 1]
        left.reverse()
        for goal in goals:
            now, room = [], goal * 4
            while room:
                doc, start, tokens, ids = left.pop()
                now.append((doc, start, tokens, ids[:room]))
                if len(ids) > room:
                    left.append((doc, start + room // 4, tokens, ids[room:]))
                room -= len(now[-1][3])
            self.close(now)
        self.levels[:] = 0
        self.open = [[] for _ in self.open]


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """One row per piece of every document; see the module."""
    small_batches(docs.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        ids_of = WordIds(tokenizer)
        sequence = TaskContext.get().partitionId() * SEQUENCES_A_TASK

        def close(pieces: list[Piece]) -> None:
            nonlocal sequence
            offset = 0
            for doc, start, tokens, ids in pieces:
                rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), tokens, sequence, offset))
                offset += len(ids) // 4
            sequence += 1

        def out() -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            made = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [f.split()[0] for f in SCHEMA.split(", ")])
            rows.clear()
            return made

        packer = Packer(close, window)
        for batch in batches:
            docs = batch.column("doc_id").to_pylist()
            for i, j, buf, offsets in chunks(batch):
                ids, counts = ids_of.encode(buf, offsets)
                raw, at = ids.tobytes(), 0
                for doc, n in zip(docs[i:j], counts.tolist(), strict=True):
                    for start in range(0, n, window):
                        packer.place((doc, start, n, raw[(at + start) * 4 : (at + min(start + window, n)) * 4]))
                    at += n
            if len(rows) > 5000:
                yield out()
        packer.finish()
        if rows:
            yield out()
        del ids_of
        give_back()

    return docs.select("doc_id", "text").mapInArrow(task, SCHEMA)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), tokenizer_path())
