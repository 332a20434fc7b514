"""Texts longer than a vectorised step, repeated rows and rows without doc_id, in every operator on documents."""

import collections
import hashlib
import math
import random
import re

import pytest

from quantloom.llm import common, decontamination, language_id, lm_scoring, ngram_join, packing, pii, sharding, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n long"
WORDS = [f"{a}{b}" for a in "alpha beta gamma delta epsilon zeta eta theta iota kappa".split() for b in range(60)]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(9)
    say = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    long, short, none = say(60_000), say(40), say(30)
    assert len(long) > common.CHUNK_BYTES
    texts = [(1, long), (2, short), (2, short), (3, say(50)), (None, none), (None, none), (None, None), (None, ""), (4, long[:1000] + " mail a.b@example.com " + say(5)), (5, None), (5, None), (6, long + " and mail me at x@y.org")]
    return [(d, t, "en", "s", None, "k", 1) for d, t in texts]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def ids(df, *columns):
    return sorted(str(tuple(r[c] for c in ("doc_id", *columns))) for r in df.collect())


def test_every_row_comes_back(docs, rows):
    want = sorted(f"({d},)" for d, *_ in rows)
    learned = language_id.profiles(docs)
    assert ids(language_id.identify(docs, learned)) == want
    assert ids(pii.report(pii.find(docs, pii.train(docs)))) == want
    assert ids(sharding.shard_documents(docs)) == want
    assert ids(suffix_dedup.remove_repeats(docs)) == want
    assert ids(ngram_join.near_duplicates(docs)) == want


def test_long_text_is_scored_whole(docs, rows):
    """Tokens of the long text and the base score against a count of words; repeated rows score alike."""
    got = lm_scoring.score_texts(docs, docs).collect()
    assert len(got) == len(rows)
    tokens = [[*(t or "").split(), None] for _, t, *_ in rows]
    seen = collections.Counter(w for t in tokens for w in t)
    total, kinds = sum(seen.values()), len(seen)
    want = {d: (len(t), sum(math.log10((seen[w] + 1) / (total + kinds + 1)) for w in t)) for (d, *_), t in zip(rows, tokens, strict=True)}
    for r in got:
        if r.doc_id is not None:
            assert r.n_tokens == want[r.doc_id][0] and abs(r.base_score - want[r.doc_id][1]) < 1e-6 * abs(want[r.doc_id][1])
    for d in (2, 5):
        assert len({r.score for r in got if r.doc_id == d}) == 1
    assert all(r.score < 0 for r in got)


def test_long_text_is_searched_whole(docs, rows):
    """A mail address behind the first CHUNK_BYTES is found where it is."""
    found = {r.doc_id: r for r in pii.report(pii.find(docs, pii.train(docs))).collect()}
    at = {d: t.index("x@y.org") for d, t, *_ in rows if t and "x@y.org" in t}
    assert found[6].n_email == 1 and found[6].base_sha256 == hashlib.sha256(f"email:{at[6]}:{at[6] + 7}".encode()).hexdigest()
    assert found[4].n_email == 1 and found[1].n_email == 0


def test_long_texts_are_deduplicated_whole(docs, rows):
    """Bytes covered by 200-byte strings that start elsewhere, by a set of all of them."""
    texts = [(t or "").encode() for _, t, *_ in rows]
    starts = collections.Counter(t[k : k + 200] for t in texts for k in range(len(t) - 199))
    want = []
    for (d, *_), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for k in range(len(t) - 199):
            if starts[t[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        want.append(str((d, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())))
    assert ids(suffix_dedup.remove_repeats(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want)


def test_long_texts_link(docs):
    """The long text and its copy with a few words more are one component; equal rows are one document."""
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs).where("doc_id is not null").collect()}
    component = {d: c for d, _, c in got}
    assert component[6] == component[1] == 1 and component[2] == 2 and component[4] == 4


def test_repeated_rows_are_packed_each(docs, rows):
    """Every token of every row lies in one piece, within a sequence of 2048."""
    out = packing.pack(docs, packing.tokenizer_path()).collect()
    by_doc = collections.Counter()
    for r in out:
        by_doc[r.doc_id] += r.length
        assert r.offset + r.length <= 2048
    once = {r.doc_id: r.doc_tokens for r in out}
    times = collections.Counter(d for d, *_ in rows)
    assert all(by_doc[d] == n * times[d] for d, n in once.items() if d is not None)
    slots = collections.defaultdict(list)
    for r in out:
        slots[r.sequence_id].append((r.offset, r.length))
    for pieces in slots.values():
        pieces.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:], strict=False)) and pieces[0][0] == 0


def test_passages_late_in_a_long_text(spark, docs, rows):
    """An item that lies behind the first CHUNK_BYTES of a text is found, and in its copies too; repeated items do no harm."""
    long = rows[0][1]
    item = " ".join(long.split()[55_000:55_040])
    bench = spark.createDataFrame([(7, item), (7, item), (8, None), (9, "")], "item_id long, text string")
    got = {r.doc_id: r.contaminated for r in decontamination.contamination(docs, bench).collect() if r.doc_id is not None}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False, 6: True}
