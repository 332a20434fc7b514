"""The ten operators on a small fixture: against brute force, and on nulls, empty and long texts, ties and empty tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import decontamination, exact_topk, language_id, lm_scoring, ngram_join, packing, pii, sharding, suffix_dedup, toxicity
from quantloom.llm import common

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, cell int, bucket string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def make_docs():
    r = random.Random(5)
    say = lambda n: " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))
    passage, base = say(60), say(120).split()
    texts = [None, "", "   \n\t", "One", "one", "a b c d", "é ü ß", "!!! ??? ...", "same " * 300, "x" * 5000, "1" * 3000 + " " + "1 " * 3000]
    texts += [say(n) for n in (4, 5, 6, 30, 80, 200)]
    texts += [" ".join(base), " ".join(base), " ".join(base).upper()]
    for k in (1, 5, 8, 12, 20, 30):
        near = list(base)
        for i in r.sample(range(len(near)), k):
            near[i] = "changed" + str(i)
        texts.append(" ".join(near))
    texts += [say(20) + " " + passage + " " + say(25) for _ in range(5)]
    texts += ["mail me at Jo.Doe@example.com, or a@b.co_m@x.yz. call +1 (017) 555-7713 now", "ip 10.0.0.256 and 192.168.1.77.5, card 4111 1111 1111 1111 x 4111111111111112", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" end', "you idiot, worthless scum", " ".join(say(3000).split())]
    return [(i, t, ("en", "de", None)[i % 3], f"s{i % 2}", None if t is None else len(t), 1.0, 7, "b") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return make_docs()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "doc_id")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, key="doc_id"):
    got = df.collect()
    assert len({r[key] for r in got}) == len(got)
    return {r[key]: r for r in got}


def low(t):
    return (t or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))


def split(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", low(t))


@pytest.mark.parametrize("block", [None, 3])
def test_ngram_join(docs, rows, empty, block, monkeypatch):
    """Also with groups in blocks of a few documents, and buckets of a few signatures."""
    if block:
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 300)
        monkeypatch.setattr(ngram_join, "BUCKET_BYTES", 500)
        monkeypatch.setattr(ngram_join, "LARGE_GROUP", 3)
        monkeypatch.setattr(ngram_join, "FRONTIER_BYTES", 1)
    sets = {}
    for i, t, *_ in rows:
        w = split(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = by_id(ngram_join.near_duplicates(docs))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(s), find(i)) for i, s in sets.items()}
    assert ngram_join.near_duplicates(empty).count() == 0


def test_ngram_join_of_repeated_rows(spark):
    """Each row twice: the pairs of every group still link."""
    r = random.Random(8)
    texts = []
    for _ in range(12):
        base = [f"w{r.randrange(10**6)}" for _ in range(120)]
        texts += [" ".join(base), " ".join([*base[:-1], "end"])]
    rows = [(i, t) for i, t in enumerate(texts)] * 2
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and all(x.component_id == x.doc_id // 2 * 2 for x in got)


def test_rows_without_id(spark):
    """They link, stand for their own group and count for repeated strings."""
    import corpus_pipeline as cp

    r = random.Random(11)
    say = lambda: [f"w{r.randrange(10**6)}" for _ in range(100)]
    a, b, c = say(), say(), say()
    near = lambda x: " ".join([*x[:-1], "end"])
    data = [(None, " ".join(a)), (7, near(a)), (None, " ".join(b)), (None, near(b)), (None, " ".join(b)), (9, " ".join(c))]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    got = ngram_join.near_duplicates(df).collect()
    assert len(got) == 6 and sorted(x.component_id for x in got if x.doc_id is not None) == [7, 9]
    groups = collections.Counter(x.component_id for x in got)
    assert sorted(groups.values()) == [1, 2, 3] and groups[7] == 2 and groups[9] == 1
    kept = cp.keep_first_of_group(spark, df, "").collect()
    assert sorted(x.doc_id for x in kept if x.doc_id is not None) == [7, 9]
    assert [x.text in (" ".join(b), near(b)) for x in kept if x.doc_id is None] == [True]
    gone = suffix_dedup.remove_repeats(df).collect()
    assert len(gone) == 6 and [x.n_removed > 300 for x in sorted(gone, key=lambda x: x.n_removed)] == [False, True, True, True, True, True]


def test_trees_match_all_pairs():
    r = np.random.default_rng(1)
    sets = [np.sort(r.choice(2000, size=int(n), replace=False)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for n in r.integers(20, 60, 60)]
    sets += [np.concatenate([s[:-2], s[:1] + np.uint64(3)]) for s in sets[:20]]
    sets = [np.unique(s) for s in sets]
    bits = np.stack([np.frombuffer(ngram_join.signature(s).ljust(32, b"\0")[:32], np.uint64) for s in sets])
    n = np.array([len(s) for s in sets])
    tree = ngram_join.Tree(np.zeros(len(sets), int), n, bits, np.arange(len(sets)))
    top = len(tree.levels) - 1
    found = {(int(x), int(y)) for a, b, _ in tree.traverse(top, np.array([0]), np.array([0])) for x, y in zip(np.minimum(a, b), np.maximum(a, b), strict=True)}
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (n[i] + n[j] - both):
                assert (j, i) in found


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 8), (8, 7), (7, 30), (4, 4)], "a long, b long")
    got = {r.node: r.component for r in common.components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 30: 7}
    assert common.components(edges.where("a = 0")).count() == 0


def test_toxicity(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2, int(i % 9 == 0)) for i in range(40)] + [(3, 1, None), (3, 1, 1)], "doc_id long, quality int, toxic int")
    got = by_id(toxicity.toxicity(docs, labels))
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert toxicity.toxicity(empty, labels).count() == 0
    assert toxicity.toxicity(docs, labels.where("doc_id < 0")).count() == docs.count()


def test_toxicity_held_out(spark):
    out = toxicity.op2_toxicity(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    hits = sum(r.predicted for r in out if r.toxic)
    wrong = sum(r.predicted for r in out if not r.toxic)
    assert hits >= 0.6 * sum(r.toxic for r in out) and wrong <= 0.1 * len(out)


def test_toxicity_brute_force(spark):
    """Scores against plain loops over words: features, votes, the label model over all documents, and Newton steps on all of them at once."""
    sf = "/root/testdata/sf0.01"
    docs, labels = common.read(spark, sf, "documents"), common.read(spark, sf, "labels")
    got = {r.doc_id: r for r in toxicity.op2_toxicity(spark, sf).collect()}
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    learned = set(toxicity.learned_words(ids, toxicity.sampled_labels(labels)).tolist())
    ordered = toxicity.learned_words(ids, toxicity.sampled_labels(labels)).tolist()
    family = collections.defaultdict(list)
    for k, words in enumerate(toxicity.LEXICONS.values()):
        for w in words.split():
            family[int(toxicity.hashes(w)[0])].append(k)
    for n, h in enumerate(ordered):
        family[h].append(len(toxicity.LEXICONS) + (n >= len(ordered) // 2))
    near = {int(h) for h in toxicity.hashes(toxicity.ADDRESS)}
    assert learned == set(ordered)
    rows, x = docs.select("doc_id", "text").collect(), []
    for r in rows:
        text = (r.text or "").encode()
        h = [int(v) for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", text) for v in toxicity.hashes(w.decode(errors="replace"))[:1]]
        hits = [i for i, v in enumerate(h) if v in family]
        f = [min(3, sum(k in family[h[i]] for i in hits)) for k in range(len(toxicity.FAMILIES))]
        close = sum(any(h[j] in near for j in range(max(0, i - 4), min(len(h), i + 5))) for i in hits)
        ups, lows = (sum(len(m) for m in re.findall(p, text)) for p in (rb"[A-Z]", rb"[a-z]"))
        x.append([*f, min(4, len({h[i] for i in hits})), min(4, len(hits) * 100 // max(1, len(h))), int(ups > 2 * lows), min(2, close), int(bool(hits))])
    x = np.array(x, np.uint8)
    gold = {r.doc_id: max(r.toxic, 0) for r in labels.orderBy("toxic").collect() if r.toxic is not None and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    g = np.array([0 if r.doc_id not in gold else 1 if gold[r.doc_id] else -1 for r in rows])
    weight = np.where(g == 0, 1.0, toxicity.GOLD_WEIGHT)
    keys, back = np.unique(np.column_stack([toxicity.votes(x), g]), axis=0, return_inverse=True)
    n = np.bincount(back.ravel(), weight)
    post = toxicity.posteriors(keys[:, :-1], keys[:, -1], n)[0][back.ravel()]
    a, w = np.column_stack([x.astype(float), np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    w[-1] = -2
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p) / weight.sum())[:, None]).T @ a + 1e-4 * np.eye(len(w)), a.T @ (weight * (post - p)) / weight.sum() - 1e-4 * w)
        w += step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
    want = 1 / (1 + np.exp(-(a @ w)))
    assert max(abs(got[r.doc_id].score - s) for r, s in zip(rows, want.tolist(), strict=True)) < 1e-5
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_toxicity_edges(spark):
    """Repeated rows score alike, a row without id is not held out, one text may be longer than a vectorised step."""
    long = "you are worthless scum. " * 20_000
    given = [(1, long), (1, long), (2, "fine words"), (2, "fine words"), (None, "fine words"), (None, None)]
    docs = spark.createDataFrame(given, "doc_id long, text string").repartition(2)
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    out = toxicity.toxicity(docs, labels).collect()
    assert len(out) == 6 and len({r.score for r in out if r.doc_id == 2}) == 1 and len({r.score for r in out if r.doc_id == 1}) == 1
    assert {r.doc_id for r in out if r.predicted} <= {1}


def test_lm_scoring(docs, rows, empty):
    tokens = {i: [*split(t), None] for i, t, *_ in rows}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = collections.Counter(w for i in train for w in tokens[i])
    n, v = sum(counts.values()), len(counts)
    for most in (1_000_000, 5):  # with all counts sent, and with nearly all joined
        got = by_id(lm_scoring.score_texts(docs, docs.where(~lm_scoring.is_held_out()), most_words=most))
        for i, w in tokens.items():
            base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)
            r = got[i]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(counts[x] > 0 for x in w), n)
            assert abs(r.base_score - base) <= 1e-9 * abs(base) and r.score < 0
    assert by_id(lm_scoring.score_texts(docs, empty))[0].n_known == 0
    assert lm_scoring.score_texts(empty, empty).count() == 0


def test_lm_scoring_keeps_the_whole_trie(docs, rows, monkeypatch):
    """However few runs are sent to the tasks and however the trie is dealt out, scores are those of the whole trie."""
    train = [t for i, t, *_ in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    count = collections.Counter()
    text = lambda t: b"\n" * 5 + b" ".join(split(t)) + b"\n"
    for t in train:
        raw = text(t)
        count.update(raw[e - k - 1 : e] for e in range(6, len(raw) + 1) for k in range(6))
    after = collections.defaultdict(dict)
    for run, n in count.items():
        after[run[:-1]][run[-1]] = n

    def log_p(run):
        out, known = 0.0, {}
        for k in range(5, -1, -1):
            now = after.get(run[5 - k : 5], {})
            free = {s: n for s, n in now.items() if s not in known}
            if not free:
                if now:
                    known = now
                continue
            total = sum(free.values()) + len(free)
            if run[-1] in free:
                return out + math.log10(free[run[-1]] / total)
            out += math.log10(len(free) / total)
            known = now
        return out - math.log10(256 - len(known))

    monkeypatch.setattr(lm_scoring, "PART_RUNS", 500)
    for most in (1_000_000, 5):
        got = by_id(lm_scoring.score_texts(docs, docs.where(~lm_scoring.is_held_out()), most_nodes=most))
        for i, t, *_ in rows:
            raw = text(t)
            want = sum(log_p(raw[e - 6 : e]) for e in range(6, len(raw) + 1))
            assert abs(got[i].score - want) <= 1e-4 * abs(want), (most, i)


def test_ppm_sums_to_one():
    texts = [b"abab cab abba", b"the cat sat", b"", b"zz top abab"]
    buf, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    grams, _ = lm_scoring.symbols(buf, *common.words(buf, off), len(texts))
    keys, n = np.unique(grams, return_counts=True)
    nodes, contexts = {}, {}
    for k in range(lm_scoring.ORDER + 1):
        for key, c in zip((keys & np.uint64((1 << 8 * (k + 1)) - 1)).tolist(), n.tolist(), strict=True):
            nodes[k, key] = nodes.get((k, key), 0) + c
    for (k, key), c in nodes.items():
        x = contexts.setdefault((k, key >> 8), [0, 0, 0])
        x[0], x[1], x[2] = x[0] + c, x[1] + 1, x[2] + (nodes[k - 1, key & (1 << 8 * k) - 1] if k else 0)
    table = lambda d: tuple(map(np.array, zip(*[(*key, *np.atleast_1d(v).tolist()) for key, v in d.items()], strict=True)))
    model = lm_scoring.Model(table(nodes), table(contexts))
    for context in (b"abab ", b"\n\n\n\n\n", b"qqqqq", b"the c"):
        c = int.from_bytes(context, "big")
        assert abs((10 ** model.code(np.array([c << 8 | s for s in range(256)], np.uint64))).sum() - 1) < 1e-5


def test_sharding(docs, rows, empty):
    got = by_id(sharding.shard_documents(docs, 4))
    shards = collections.defaultdict(list)
    for i, t, *_ in rows:
        r, raw = got[i], (t or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 8, zlib.crc32(raw), "bytes")
        shards[r.shard].append(r)
    assert all(sorted(r.slot for r in s) == list(range(len(s))) for s in shards.values())
    where = collections.defaultdict(set)
    for i, t, *_ in rows:
        where[t or ""].add(got[i].shard)
    assert all(len(s) == 1 for s in where.values())
    assert sharding.shard_documents(empty, 4).count() == 0


def least_largest(sizes, k):
    """The smallest largest part over all ways to cut, by dynamic programming."""
    best = [0] + [math.inf] * len(sizes)
    for _ in range(k):
        best = [min((max(best[i], sum(sizes[i:j])) for i in range(j + 1)), default=0) for j in range(len(sizes) + 1)]
    return best[-1]


def test_capacity_is_the_smallest():
    r = random.Random(3)
    for _ in range(200):
        sizes, k = [r.randrange(1, 30) for _ in range(r.randrange(1, 12))], r.randrange(1, 5)
        best = least_largest(sizes, k)
        assert sharding.smallest_capacity(sizes, k) == best
        prefix = [0, *np.cumsum(sizes).tolist()]
        cuts = sharding.level_cuts(prefix, best, k)
        assert len(cuts) == k and cuts == sorted(cuts) and cuts[-1] == len(sizes)
        assert max(prefix[b] - prefix[a] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)) == best


def test_shards_are_minimal_and_level(spark, monkeypatch):
    """Cut points from hash ranges against all groups; then whole tables of documents of like size."""
    r = random.Random(14)
    sizes = {r.randrange(1 << 60): r.randrange(1, 400) for _ in range(900)}
    groups = spark.createDataFrame(list(sizes.items()), "g long, bytes long")
    order = [sizes[g] for g in sorted(sizes)]
    for k in (2, 7):
        points = sharding.cut_points(groups, k)
        got = [sum(v for g, v in sizes.items() if a <= g < b) for a, b in zip([0, *points], [*points, 1 << 60], strict=True)]
        prefix = [0, *np.cumsum(order).tolist()]
        assert len(got) == k and max(got) == sharding.smallest_capacity(order, k) and sum(got) == prefix[-1]
        assert max(got) - min(got) <= 2 * max(order)
    monkeypatch.setattr(sharding, "CELL_ROWS", 10)
    out = sharding.op4_sharding(spark, "/root/testdata/sf0.01").collect()
    total = collections.Counter()
    for x in out:
        total[x.shard] += x.size
    assert len(total) == 24 and max(total.values()) <= 1.2 * min(total.values())  # one document is half a shard
    for shard in range(24):
        own = sorted(x.slot for x in out if x.shard == shard)
        assert own == list(range(len(own)))


def test_exact_topk(spark):
    r = np.random.default_rng(2)
    v = r.normal(size=(300, 8)).astype(np.float32)
    v[50:90] = v[0]
    data = [(i, x.tolist(), 0) for i, x in enumerate(v)] + [(400, None, 0), (401, [None] * 8, 0), (402, [float("nan")] * 8, 0), (403, [float("inf")] * 8, 0), (404, [], 0), (None, [1.0] * 8, 0), (405, [1.0, 2.0], 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    ids = [*range(300), 404, 405]
    q = np.zeros((302, 8), np.int64)
    q[:300] = np.floor(v.astype(float) * 64)
    q[301, :2] = 64, 128
    got = collections.defaultdict(list)
    for x in exact_topk.exact_top_k(df, F.col("vec_id") % 20 == 0, 10, data_block=70, query_block=3).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.vec_id, x.score))
    for i in range(0, 300, 20):
        s = q @ q[i]
        order = sorted((j for j in range(302) if ids[j] != i), key=lambda j: (-s[j], ids[j]))[:10]
        assert got[i] == [(ids[j], s[j]) for j in order]
    assert exact_topk.exact_top_k(df.where("vec_id < 0"), F.col("vec_id") % 20 == 0).count() == 0
    assert len(got) == 15


def test_exact_topk_has_no_bounds(spark):
    """Large components keep their exact scores and order, and groups that share their vectors are solved together."""
    rows = [(0, [1.0, 0.0]), (1, [20000.0, 0.0]), (2, [30000.0, 1.0]), (3, [-3e9, 2.0]), (4, [3e9, 2.0]), (5, [3e9, 2.0]), (20, [4e9, 1e9]), (6, [1e-3, -5e15])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = {i: [math.floor(64 * c) for c in x] for i, x in rows}
    got = collections.defaultdict(list)
    for r in exact_topk.exact_top_k(df, F.col("vec_id") % 20 == 0, 6, data_block=3).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for q in (0, 20):
        exact = {i: sum(a * b for a, b in zip(v[q], x, strict=True)) for i, x in v.items() if i != q}
        order = sorted(exact, key=lambda i: (-exact[i], i))[:6]
        assert got[q] == [(i, min(max(exact[i], -(2**63)), 2**63 - 1)) for i in order]
    whole = np.ones((10, 6), bool)
    assert exact_topk.joint_groups(whole, np.full(6, 100), 300).tolist() == [0, 0, 0, 1, 1, 1]
    apart = np.repeat(np.eye(2, dtype=bool), 5, axis=0)
    assert exact_topk.joint_groups(apart, np.full(2, 100), 300).tolist() == [0, 1]


def test_exact_topk_of_empty_and_huge_vectors(spark):
    """All vectors empty: every score is 0. Scores of 39 digits are ranked exactly, also where negative; repeated rows count each."""
    none = spark.createDataFrame([(0, []), (1, []), (20, []), (3, None)], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in exact_topk.exact_top_k(none, F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 1, 0), (0, 2, 20, 0), (20, 1, 0, 0), (20, 2, 1, 0)]
    rows = [(0, [1e17] * 4), (1, [1e17] * 4), (2, [1.1e17] * 4), (3, [1e16] * 4), (4, [-1e17] * 4), (5, [-1.1e17] * 4), (6, [0.0] * 4), (7, [1e17, 1e17, 1e17, 1e17 + 16]), (2, [1.1e17] * 4)]
    huge = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = exact_topk.exact_top_k(huge, F.col("vec_id") % 20 == 0, 8, data_block=3).orderBy("rank").collect()
    assert [r.vec_id for r in out] == [2, 2, 7, 1, 3, 6, 4, 5]


def test_exact_topk_prunes_structured_data(spark):
    """Well apart clusters: a vector goes to fewer groups of queries than there are, and results stay exact."""
    r = np.random.default_rng(8)
    centre = r.normal(size=(8, 16)) * 40
    v = (centre[np.arange(1600) % 8] + r.normal(size=(1600, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    q = np.floor(v.astype(float) * 64).astype(np.int64)
    got = collections.defaultdict(list)
    for x in exact_topk.exact_top_k(df, F.col("vec_id") % 20 == 0, 20, query_block=12).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.vec_id, x.score))
    for i in range(0, 1600, 20):
        s = q @ q[i]
        assert got[i] == [(j, s[j]) for j in sorted((j for j in range(1600) if j != i), key=lambda j: (-s[j], j))[:20]]


def test_language_id(spark, docs, empty):
    got = by_id(language_id.identify(docs, language_id.profiles(docs)))
    assert {got[i].lang_pred for i in (0, 1, 2, 7)} == {"und"} and all(0 <= r.score <= 1 for r in got.values())
    assert language_id.identify(docs, language_id.profiles(empty)).where("lang_pred <> 'und'").count() == 0
    assert language_id.identify(empty, language_id.profiles(empty)).count() == 0
    out = language_id.op6_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.where("lang_pred = lang").count() >= 0.98 * out.count()


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def fits(kind, v):
    digits = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(x) <= 255 for x in v.split("."))
    if kind == "card":
        odd = [int(c) for c in reversed(digits)]
        return 13 <= len(digits) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(odd)) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def test_pii(docs, rows, empty):
    model = pii.train(docs)
    got = by_id(pii.report(pii.find(docs, model)))
    for i, t, *_ in rows:
        spans = [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, t or "") if fits(k, m[0])]
        assert got[i].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest(), t
        assert set(spans) <= set(got[i].spans.split(",")) | {""}
    red = by_id(pii.redact(docs, model))
    assert all("@example.com" not in (r.text or "") for r in red.values()) and red[0].text is None and len(red) == len(rows)
    assert any("<EMAIL>" in (r.text or "") for r in red.values())
    assert pii.report(pii.find(empty, pii.train(empty))).count() == 0


def without_repeats(texts, length):
    """(bytes, removed, spans, kept) of each text by counting every string."""
    seen, out = collections.Counter(), []
    for t in texts:
        raw = (t or "").encode()
        seen.update(raw[k : k + length] for k in range(len(raw) - length + 1))
    for t in texts:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if seen[raw[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        out.append((len(raw), sum(gone), sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1])), kept))
    return out


@pytest.mark.parametrize(("length", "seed", "hot"), [(200, 56, 20_000), (40, 8, 20_000), (40, 8, 0), (60, 20, 1)])
def test_suffix_dedup(docs, rows, empty, length, seed, hot):
    """Also with every anchor dealt out as a hot one."""
    got = by_id(suffix_dedup.remove_repeats(docs, length, seed, keep_text=True, hot=hot))
    for (i, *_), want in zip(rows, without_repeats([t for _, t, *_ in rows], length), strict=True):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_suffix_dedup_judges_each_row_by_its_text(spark):
    """Rows without id, and different texts under one id, keep what repeats nowhere."""
    r = random.Random(12)
    say = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    a, b = say(400), say(300)
    texts = [(None, a), (1, a), (2, say(50) + b + say(190)), (2, say(500)), (3, b), (None, None), (None, say(100)), (4, a[:199] + "!" + a[200:]), (2, say(500)), (5, ""), (5, "")]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string"), keep_text=True).collect()
    want = [(i, *w) for (i, _), w in zip(texts, without_repeats([t for _, t in texts], 200), strict=True)]
    key = lambda x: (x[0] is None, x)
    assert sorted(((x.doc_id or 0, x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in got), key=key) == sorted(((i or 0, *w) for i, *w in want), key=key)


def test_suffix_dedup_of_random_repeats(spark):
    """Short alphabets, where many strings are in doubt."""
    r = random.Random(13)
    parts = ["".join(r.choice("ab") for _ in range(r.randrange(5, 60))) for _ in range(12)]
    texts = [(i, "".join(r.choice(parts) for _ in range(r.randrange(1, 8)))) for i in range(150)]
    for hot in (20_000, 3):
        got = by_id(suffix_dedup.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string"), 50, 12, keep_text=True, hot=hot))
        for (i, _), want in zip(texts, without_repeats([t for _, t in texts], 50), strict=True):
            assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == want


def test_suffix_sort():
    r = random.Random(4)
    texts = ["".join(r.choice("ab") for _ in range(r.randrange(1, 12))).encode() for _ in range(200)]
    buf = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts])
    s = suffix_dedup.Suffixes(buf, np.cumsum(size) - size, size)
    group = np.repeat([0, 1, 2], [50, 120, 30])
    order = s.sort(group)
    for g in range(3):
        part = [texts[i] for i in order if group[i] == g]
        assert part == sorted(part)


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    pieces = packing.pack(docs, packing.tokenizer_path()).collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    for i, t, *_ in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for s in by_seq.values():
        total = sum(p.length for p in s)
        assert total <= 2048 and (total == 2048 or total & (total - 1) == 0)
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
    assert packing.pack(empty, packing.tokenizer_path()).count() == 0


@pytest.mark.parametrize("most", [1_000_000, 150])
def test_word_ids_match_the_tokenizer(most):
    """Random texts of awkward characters, and the same units again when the table has had to drop some."""
    from tokenizers import Tokenizer

    tok, ids_of, r = Tokenizer.from_file(packing.tokenizer_path()), packing.WordIds(packing.tokenizer_path(), most), random.Random(6)
    parts = ["a", "B", "the", "don't", "d'depuis", "é", "É", "ß", "Œ", "\u0130", "'", "'s", "'LL", "\u2019", "-", ",", "<|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", " ", "\t", "\n", "\u0301", "\u0338", "=", "<", "\xa0", "\x85", "\u3000", "7", "\u0663", "中", "\U0001f642", "×", "\x00", "\x1f", "ǅ", "½", "\u200d", "\u05bc"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(14))) for _ in range(4000)] + [f"a{chr(c)}b {chr(c)}. 1{chr(c)}' ,{chr(c)}" for c in range(1, 0x800)]
    for k in range(0, len(texts), 250):
        raw = [t.encode() for t in texts[k : k + 250]]
        ids, counts = ids_of.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        for t, got in zip(texts[k : k + 250], np.split(ids, np.cumsum(counts)[:-1]), strict=True):
            assert got.tolist() == [*tok.encode(t, add_special_tokens=False).ids, 1], t


def test_levels_minimise_the_sum_of_squares():
    r, closed = random.Random(7), []
    packer, levels = packing.Packer(closed.append, 32), [0] * 33
    for i in range(400):
        n = r.randrange(1, 33)
        best = []
        for h in [0, *[h for h in range(1, 33 - n) if levels[h]], *([32 - n] if n < 32 and levels[32 - n] else [])]:
            after = list(levels)
            after[h] -= h > 0
            after[h + n] += h + n < 32
            best.append((sum(x * x for x in after), h))
        packer.place((i, 0, n, b"\0\0\0\0" * n))
        wanted = min(x for x, _ in best)
        levels = packer.levels[:33].tolist()
        assert sum(x * x for x in levels) == wanted, i
    assert sum(len(p) for p in closed) + sum(len(w) for level in packer.open for w in level) == 400


def test_decontamination(spark, docs, rows, empty):
    r = random.Random(9)
    item = [f"item{r.randrange(10**6)}" for _ in range(40)]
    other = list(item)
    for k in (3, 9, 17, 29):
        other[k] = "swapped"
    bench = spark.createDataFrame([(0, " ".join(item)), (1, "seven short words only stand here alone"), (2, None), (3, ""), (4, "two words"), (5, " ".join(item))], "item_id long, text string")
    extra = [(1000, "before " + " ".join(other).upper() + ", after", "en", "s", 1, 1.0, 1, ""), (1001, "xx seven SHORT words, only stand here alone. yy", "en", "s", 1, 1.0, 1, ""), (1002, " ".join(reversed(item)), "en", "s", 1, 1.0, 1, ""), (1003, "seven short words only stand there alone", "en", "s", 1, 1.0, 1, "")]
    got = by_id(decontamination.contamination(docs.union(spark.createDataFrame(extra, SCHEMA)), bench))
    assert sorted(i for i, x in got.items() if x.contaminated) == [1000, 1001] and got[1000].n_items == 2 and got[1000].item_id == 0
    assert len(got) == len(rows) + 4
    assert decontamination.contamination(empty, bench).count() == 0
    assert decontamination.contamination(docs, bench.where("item_id < 0")).where("contaminated").count() == 0


@pytest.mark.parametrize(("n", "k", "least"), [(12, 3, 1.0), (14, 3, 1.0), (16, 4, 0.98), (20, 3, 1.0), (24, 4, 0.97), (40, 8, 0.8)])
def test_decontamination_recall(spark, n, k, least):
    """Items with k of n words substituted, held against a check of every alignment; rows without id are found too."""
    r = random.Random(n * 100 + k)
    items = [[f"w{r.randrange(10**7)}" for _ in range(n)] for _ in range(60)]
    docs, want = [], set()
    for i, item in enumerate(items):
        other = list(item)
        for j in r.sample(range(n), k):
            other[j] = "other"
        same = [x == y for x, y in zip(item, other, strict=True)]
        size = min(16, n)
        if max(sum(same[j : j + size]) for j in range(n - size + 1)) >= math.ceil(0.75 * size):
            want.add(i)
        docs.append((i, "before it " + " ".join(other) + " after it"))
    docs += [(None, " ".join(items[0])), (None, "nothing here to see at all in any way whatever it may be")]
    bench = spark.createDataFrame(list(enumerate(map(" ".join, items))), "item_id long, text string")
    got = decontamination.contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    found = {x.doc_id for x in got if x.contaminated and x.doc_id is not None}
    assert found <= want and len(found) >= least * len(want)
    assert sorted(x.contaminated for x in got if x.doc_id is None) == [False, True]


def test_decontamination_verifies_contexts_once(spark, monkeypatch):
    """Copies of a passage in many documents and items: each pair of distinct contexts is verified once, and no overlap is lost."""
    r = random.Random(21)
    item, other = ([f"w{r.randrange(10**7)}" for _ in range(30)] for _ in range(2))
    docs = [(i, " ".join(item)) for i in range(60)] + [(100 + i, f"own{i} " + " ".join(other)) for i in range(5)] + [(200, "nothing of the kind is written here in any of these words at all")]
    bench = [(i, " ".join(item)) for i in range(40)] + [(90, " ".join(other)), (91, " ".join(item[:14] + other[14:]))]
    seen = []
    whole = decontamination.verify
    monkeypatch.setattr(decontamination, "verify", lambda hits: seen.append(hits) or whole(hits))
    docs, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontamination.overlaps(docs, bench).collect()}
    want = {(d, i) for d in range(60) for i in [*range(40), 91]} | {(100 + i, k) for i in range(5) for k in (90, 91)}
    # The item of two halves shares 14 words with the one passage and 16 with the other: a window of 16 holds 12 of them.
    assert got == want
    pairs = seen[0]
    assert pairs.count() == pairs.select("of", "item_of").distinct().count() < 60 * 40


def test_language_distances(docs, rows):
    """Predictions against profiles and out-of-place distances computed with dictionaries."""
    def grams(text):
        word = "".join(c.lower()[0] if c.isalpha() else " " for c in text)
        word = " " + " ".join(word.split()) + " "
        out = collections.Counter()
        for n in (1, 2, 3):
            for i in range(len(word) - n + 1):
                g = word[i : i + n]
                if n == 1 and g != " " or n == 2 or n == 3 and g[1] != " ":
                    out[g] += 1
        return out if word.strip() else collections.Counter()

    order = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], len(x[0]) % 3, x[0].replace(" ", chr(0))))][: language_id.TOP]
    sums = collections.defaultdict(collections.Counter)
    for i, t, lang, *_ in rows:
        if lang and zlib.crc32(str(i).encode()) % 4 != 2:
            sums[lang].update(grams(t or ""))
    place = {lang: {g: k for k, g in enumerate(order(c))} for lang, c in sums.items()}
    got = by_id(language_id.identify(docs, language_id.profiles(docs)))
    for i, t, *_ in rows:
        own = order(grams(t or ""))
        if not own:
            assert got[i].lang_pred == "und" and got[i].score == 0
            continue
        away = {lang: sum(abs(p[g] - k) if g in p else language_id.TOP for k, g in enumerate(own)) for lang, p in place.items()}
        best = min(sorted(away), key=lambda x: away[x])
        assert got[i].lang_pred == best and abs(got[i].score - max(0, 1 - away[best] / (language_id.TOP * len(own)))) < 1e-9


def test_label_model_recovers_the_voters():
    """Votes drawn from known accuracies: the posteriors tell the classes apart, and a copied voter counts less."""
    r = np.random.default_rng(15)
    truth = r.random(6000) < 0.15
    m = len(toxicity.VOTERS)
    rate = np.linspace(0.55, 0.9, m)
    vote = (np.where(truth[:, None], r.random((6000, m)) < rate, r.random((6000, m)) < 0.04)).astype(np.int64)
    vote[:, -1] = np.where(vote[:, :-1].any(axis=1), 0, -1)
    vote[:, 1] = vote[:, 0]
    keys, inverse, n = np.unique(vote, axis=0, return_inverse=True, return_counts=True)
    post, table, rho = toxicity.posteriors(keys, np.zeros(len(keys), np.int64), n)
    hit = post[inverse.ravel()] > 0.5
    assert (hit == truth).mean() > 0.97 and rho[0, 1] > 0.9
    assert all(abs(table[1, j, 2] - rate[j]) < 0.1 for j in range(2, m - 1))


def test_span_model_recovers_the_labelers():
    r = random.Random(16)
    counted = collections.Counter()
    for _ in range(5000):
        real = r.random() < 0.7
        counted[tuple((1 if real else -1) * (1 if r.random() < g else -1) for g in (0.95, 0.9, 0.8, 0.75, 0.7, 0.6))] += 1
    model = pii.fit([("card", v, n) for v, n in sorted(counted.items())])
    assert all(abs(a - b) < 0.08 for a, b in zip(model.reliability, (0.95, 0.9, 0.8, 0.75, 0.7, 0.6), strict=True))
    score = lambda v: model.kinds["card"] + sum(a * b for a, b in zip(model.labelers, v, strict=True))
    assert score((1,) * 6) > 0 > score((-1,) * 6)


def test_pii_finds_secrets(spark):
    """Every token and key in the given documents is among the spans, and texts without digits or @ have none."""
    docs = common.read(spark, "/root/testdata/sf0.01", "documents")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    got = by_id(pii.report(pii.find(docs, pii.train(docs))))
    wanted = {i: [m.span(1) for m in re.finditer(r"(?:token|password|api_key|secret) ?[=:] ?\"?([A-Za-z0-9]{16,})", t)] for i, t in texts.items()}
    found = {i: {tuple(map(int, x.split(":")[1:])) for x in got[i].spans.split(",") if x} for i in texts}
    assert sum(map(len, wanted.values())) > 5 and all(set(w) <= found[i] for i, w in wanted.items())
    assert all(not found[i] and got[i].n_spans == 0 for i, t in texts.items() if not re.search(r"[0-9@]", t))
    assert all(got[i].n_added == got[i].n_spans - got[i].n_email - got[i].n_ip - got[i].n_card - got[i].n_phone for i in texts)
    many = spark.createDataFrame([(1, " ".join(f"a{k}@b.co" for k in range(1000)), "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert pii.redact(many, pii.train(many)).first().text == " ".join(["<EMAIL>"] * 1000)


def test_pipeline_edges(spark, rows):
    """Nulls in any column, empty and equal texts, clashing columns, rows without id, and an empty table pass every stage."""
    import corpus_pipeline as cp

    docs = spark.createDataFrame([*rows, rows[13], (None, "some words of a text without an id to keep", None, None, None, 1.0, 7, "b"), (None, None, None, None, None, None, None, None)], SCHEMA)
    for name, stage in cp.STAGES[:-1]:
        got = stage(spark, docs, "/root/testdata/sf0.001")
        assert tuple(got.columns) == cp.COLUMNS, name
        assert stage(spark, docs.where("doc_id < 0"), "/root/testdata/sf0.001").count() == 0
        n = got.count()
        assert 0 < n <= docs.count() and (n == docs.count() or name != "pii"), name
        assert got.where("doc_id is null and text like 'some words%'").count() == 1, name
    assert cp.STAGES[-1][1](spark, docs, "").where("doc_id is null").count() >= 2


def test_pipeline_repeated_rows(spark):
    """One row stays of a group, whether its copies are rows of one document, of several, or of none."""
    import corpus_pipeline as cp

    text = "one two three four five six seven eight nine ten eleven twelve"
    plain = lambda d, t, s="s": (d, t, "en", s, None, 1.0, 7, "b")
    given = [plain(5, text), plain(5, text), plain(6, text + " more"), plain(8, "a b c", "z"), plain(8, "a b c", "y"), plain(9, "d"), plain(None, "some other words without any id here"), plain(None, "some other words without any id here"), plain(10, text), plain(10, "")]
    got = cp.keep_first_of_group(spark, spark.createDataFrame(given, SCHEMA).repartition(3), "").collect()
    assert sorted(map(str, ((r.doc_id, r.source, r.text) for r in got))) == sorted(map(str, ((5, "s", text), (8, "y", "a b c"), (9, "s", "d"), (None, "s", "some other words without any id here"))))
    empty = spark.createDataFrame([plain(1, None), plain(1, ""), plain(2, " "), plain(None, ""), plain(None, None)], SCHEMA)
    assert sorted(str(r.doc_id) for r in cp.keep_first_of_group(spark, empty, "").collect()) == ["1", "2", "None", "None"]


def test_pipeline(spark):
    """The given documents against plain loops: letters, all pairs of shingle sets, every alignment with every benchmark item."""
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in common.read(spark, sf, "documents").collect()}
    left = {i: t for i, t in texts.items() if re.search(r"[^\W\d_]", t)}
    sets = {}
    for i, t in left.items():
        w = split(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
    least = {i: i for i in left}
    for _ in range(3):  # chains of links are short here
        for a in left:
            for b in left:
                both = len(sets[a] & sets[b]) if a < b else 0
                if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                    least[a] = least[b] = min(least[a], least[b])
    left = {i: t for i, t in left.items() if least[i] == i}
    code = collections.defaultdict(lambda: len(code))
    plain = lambda t: np.array([code[w] for w in re.findall(rb"[0-9a-z\x80-\xff]+", low(t))], np.int64)
    items = [plain(r.text) for r in common.read(spark, sf, "benchmark").collect()]

    def leaks(t):
        d = plain(t)
        for item in items:
            n = len(item)
            size = n if n < 12 else min(16, n)
            if n < 6 or len(d) < size:
                continue
            same = d[:, None] == item
            total = sum(same[k : len(d) - size + 1 + k, k : n - size + 1 + k].astype(np.int64) for k in range(size))
            if total.max() >= (n if n < 12 else math.ceil(0.75 * size)):
                return True
        return False

    want = {i for i, t in left.items() if not leaks(t)}
    assert [n for n, _ in cp.STAGES] == ["language_id", "ngram_jaccard_join", "decontamination", "pii", "packing"]
    out = cp.run(spark, sf).collect()
    assert {r.doc_id for r in out} == want and len(want) < len(texts)
    pieces = collections.defaultdict(list)
    for r in out:
        pieces[r.doc_id].append(r)
    for own in pieces.values():
        own.sort(key=lambda r: r.start)
        assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))] and sum(r.length for r in own) == own[0].doc_tokens
