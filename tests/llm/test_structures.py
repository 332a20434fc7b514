"""Conversation tries, Merkle manifests and URL filters: against brute force and their SQL, on nulls, ties, repeated rows and empty tables."""

import collections
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from quantloom.llm import conversation_trie, merkle, oracles, url_filters

TALK = "conv_id long, turn long, role string, text string, i long, n long, key string"
DOC = "doc_id long, source string, lang string, n_chars long, text string, i long, block long, group string"
PAGE = "page_id long, url string, html string, host string, path string, rule string"


def sql_rows(query, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    result = con.execute(query)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(names), sorted(str([row[k] for k in order]) for row in result.fetchall())


def own_rows(df):
    names = sorted(df.columns)
    return names, sorted(str([r[c] for c in names]) for r in df.collect())


def talks():
    r = random.Random(3)
    rows = []
    for c in [*range(0, 40), 100, 101, 102, 103, 205, 300, 307, -5]:
        for t in range(r.randrange(1, 8)):
            rows.append((c, t, ("user", "assistant")[t % 2], r.choice(["hi", "hello", "é ü", "", None, "tell me more"])))
    # Long ones: over several segments, with equal beginnings that end at and around the segments' ends.
    for c, length in ((400, 5), (401, 16), (402, 17), (403, 32), (404, 33), (405, 40), (406, 40), (407, 15)):
        rows += [(c, t, "user", "same") for t in range(length)]
    rows += [(408, t, "user", "same" if t < 30 else "other") for t in range(45)]
    rows += [(500, None, None, None), (500, 1, "user", "a"), (500, 1, "user", "a"), (500, 1, "user", "b"), (501, None, "user", "z"), (None, 0, "user", "lost"), (None, None, None, None)]
    rows += [(601, 3, "user", "only one")]
    return [(*x, 7, 8, "k") for x in rows]


def brute_trie(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    rebuilt = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        rebuilt[c] = tuple(own.get(base, [])[:h] + t[h:])
    members = collections.defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids, leaves, saved = collections.Counter(), collections.Counter(), collections.Counter()
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(rebuilt[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("container", [2048, 3, 1])
def test_conversation_trie(spark, container, monkeypatch):
    """Also with containers that burst early, down to one suffix, and ids hashed a few at a time."""
    monkeypatch.setattr(conversation_trie, "CONTAINER", container)
    rows = talks()
    df = spark.createDataFrame(rows, TALK).repartition(3)
    got = conversation_trie.trie(conversation_trie.shared_starts(conversation_trie.turns(df)))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(str(tuple(r)) for r in got.select(*columns).collect()) == brute_trie(rows)
    assert {t for c, t in got.dtypes if c != "ends_sha256"} == {"bigint"}


def test_conversation_trie_empty(spark):
    none = spark.createDataFrame([], TALK)
    assert conversation_trie.trie(conversation_trie.shared_starts(conversation_trie.turns(none))).count() == 0
    nobody = spark.createDataFrame([(None, 1, "user", "x", 1, 2, "")], TALK)
    assert conversation_trie.trie(conversation_trie.shared_starts(conversation_trie.turns(nobody))).count() == 0


def test_many_ends_of_a_node(spark):
    """A node with more ids than one text holds: the hash is that of all of them in numeric order."""
    ids = list(range(-3000, 3000, 1))
    df = spark.createDataFrame([(b"k", c) for c in ids] + [(b"q", 5)], "key binary, conv long").repartition(5)
    got = {bytes(r.key): r.ends for r in conversation_trie.ends_of(df).collect()}
    assert got == {b"k": hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), b"q": hashlib.sha256(b"5").hexdigest()}


@pytest.mark.parametrize("levels", range(1, 11))
def test_address(levels):
    """A bijection, the root first, every part below the top at half height in one stretch."""
    depth = np.concatenate([np.full(1 << d, d) for d in range(levels)])
    place = np.concatenate([np.arange(1 << d) for d in range(levels)])
    at = merkle.address(depth, place, levels)
    assert sorted(at.tolist()) == list(range((1 << levels) - 1)) and at[0] == 0
    top = levels // 2
    for x in range(1 << top if levels > 1 else 0):
        inside = (depth >= top) & (place >> np.maximum(depth - top, 0) == x)
        own = np.sort(at[inside])
        assert own[-1] - own[0] == len(own) - 1


def documents():
    r = random.Random(4)
    rows = [(k, r.choice(["web", None, "ü"]), "en", None if k % 9 == 0 else k, r.choice(["a b", "", None, "é", "x" * 400_000 if k == 3 else "t"])) for k in range(700)]
    rows += [(1000 + k, "s", "de", 2**63 - 1 if k == 4 else k, "t") for k in range(257)] + [(2000 + k, "s", "fr", k, "t") for k in range(256)]
    rows += [(3000, "s", None, 1, "lone")] + [(3000 + k, "s", "", k, "t") for k in range(1, 4)]
    rows += [(5, "s", "es", 1, "same")] * 3 + [(None, "s", "es", 1, "x"), (None, "s", "es", 1, "y"), (5, "s", "es", 1, "other"), (None, None, None, None, None)]
    return [(*x, 1, 2, "g") for x in rows]


def merkle_rows(rows):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    digest = lambda d, s, lang, n, t: sha("".join(map(field, (d, s, lang, n, t))))
    by_lang = collections.defaultdict(list)
    for d, s, lang, n, t, *_ in rows:
        bad = d is not None and zlib.crc32(str(d).encode()) % 7 == 0
        by_lang[lang].append((d is not None, d or 0, digest(d, s, lang, n, t), d, digest(d, s, lang, None if n is None else n + 1, t) if bad else None))

    def levels(row):
        out = [row]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][k : k + 2])) for k in range(0, len(out[-1]), 2)])
        return out

    trees = {lang: (sorted(x, key=lambda y: y[:3]), levels([y[2] for y in sorted(x, key=lambda y: y[:3])])) for lang, x in by_lang.items()}
    langs = sorted(trees, key=lambda v: (v is not None, (v or "").encode()))
    forest = levels([trees[v][1][-1][0] for v in langs])
    root, out = forest[-1][0], []

    def way(tree, k):
        for level in tree[:-1]:
            yield None if k ^ 1 >= len(level) else (k ^ 1 > k, level[k ^ 1])
            k >>= 1

    for v in langs:
        for k, (_, _, leaf, d, bad) in enumerate(trees[v][0]):
            path = [*way(trees[v][1], k), *way(forest, langs.index(v))]
            x = bad or leaf
            for s in path:
                x = sha(x) if s is None else sha(x + s[1]) if s[0] else sha(s[1] + x)
            out.append((d, leaf, trees[v][1][-1][0], root, sha("".join(s[1] for s in path if s)), x, x == root))
    return sorted(map(str, out))


def test_merkle_manifest(spark):
    rows = documents()
    got = merkle.manifest(spark.createDataFrame(rows, DOC).repartition(4))
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    found = [tuple(r) for r in got.select(*columns).collect()]
    assert sorted(map(str, found)) == merkle_rows(rows)
    # Tampering shows exactly where it happened.
    assert {r[6] for r in found if r[0] is None} == {True}
    assert any(not r[6] for r in found)
    broken = [r for r in found if not r[6]]
    assert all(zlib.crc32(str(r[0]).encode()) % 7 == 0 for r in broken)


def test_merkle_small(spark):
    assert merkle.manifest(spark.createDataFrame([], DOC)).count() == 0
    one = [(1, "s", "en", 3, "abc", 1, 2, "g")]
    assert sorted(str(tuple(r)) for r in merkle.manifest(spark.createDataFrame(one, DOC)).collect()) == merkle_rows(one)


def pages():
    out = []

    def add(url, html=""):
        out.append((len(out), url, html, "h", "p", "r"))

    for _ in range(3):
        add("https://Good.example.COM/de/1?x=1", '<p><a class="x" href="https://friend.org/a">f</a> <a href=\'/own\'>o</a><a href="#top"></a>')
        add("https://bad.net/es/1", '<a href="https://bad2.org">x</a>')
    add("https://www.example.com/en/x#top", "<a HREF=//friend.org/y>")
    add("https://a.www.example.com/en/x", None)
    add("https://www.example.com/fr/", '<a href="mailto:me@x.org">')
    add("https://example.com/en/")
    add("https://myexample.com/en/")
    add("https://friend.org/page", '<img src="https://bad.net/es/pic"><a href="https://good.example.com/">')
    add("https://shill.org/page", '<a href="https://bad.net/es/1">1</a>')
    add("https://shill.org/page?q=://net/es/", '<a href="https://bad.net/fr/1">1</a>')
    add("https://bad2.org/", "")
    add("http://x.net/es/a/b")
    add("http://x.net/en/a/b", '<a href="rel.html">')
    add("http://net/fr/")
    add("ftp://COM")
    add("com/no-scheme", '<a href="https://bad.net/">')
    add(None, '<a href="https://bad.net/">')
    add("", "")
    add("://com/", "x")
    add("http://ÀÉ.org/Ü?q", "<a href='http://ÀÉ.org/'>")
    add("http://x.org?a/com/", "<a href=>")
    return out + out[:2]


def test_url_filters(spark):
    df = spark.createDataFrame(pages(), PAGE).repartition(3)
    got = url_filters.verdicts(df)
    assert own_rows(got) == sql_rows(oracles.oracles()["op13_url_filters"], pages=df)
    rows = {r.page_id: r for r in got.collect()}
    by_url = {u: rows[k] for k, u, *_ in pages()}
    assert by_url["https://Good.example.COM/de/1?x=1"][:5] == (by_url["https://Good.example.COM/de/1?x=1"].page_id, "good.example.com", "/de/1", "com/", "allow")
    assert (by_url["https://a.www.example.com/en/x"].rule, by_url["https://example.com/en/"].rule, by_url["https://myexample.com/en/"].rule) == ("www.example.com/en/", "example.com/en/", "com/")
    assert by_url["http://net/fr/"].verdict == "block" and by_url["ftp://COM"].rule is None
    for u in (None, "", "com/no-scheme"):
        assert (by_url[u].host, by_url[u].path, by_url[u].rule, by_url[u].verdict) == ("", "", None, "allow")
    # Who links to a blocked host is blamed; who is only linked to from there is not.
    assert by_url["https://shill.org/page"].verdict == "block" and by_url["https://bad2.org/"].verdict == "allow"
    assert by_url["https://friend.org/page"].trust > 0.3


def test_propagation_brute_force(spark):
    """Scores against a plain loop over the same whole numbers."""
    df = spark.createDataFrame(pages(), PAGE)
    known = url_filters.judged(df)
    edges = [(r.src, r.dst, r.pages) for r in url_filters.links(known).collect()]
    hosts = {r.host for r in known.collect() if r.host} | {e[0] for e in edges} | {e[1] for e in edges}
    of = collections.defaultdict(list)
    for r in known.collect():
        if r.host:
            of[r.host].append(r.ruled)
    got = {r.host: (r.trust, r.distrust) for r in url_filters.scores(known).collect()}
    assert set(got) == hosts
    for k, verdict in enumerate(("allow", "block")):
        ways = collections.defaultdict(dict)
        for a, b, n in edges:
            a, b = (a, b) if k == 0 else (b, a)
            ways[a][b] = n
        seed = {h: of[h].count(verdict) * url_filters.UNIT // len(of[h]) if of[h] else 0 for h in hosts}
        kept = {h: int(s * (1 - url_filters.DAMPING)) for h, s in seed.items()}
        now = dict(kept)
        for _ in range(url_filters.ROUNDS):
            new = dict(kept)
            for a in hosts:
                out = ways.get(a) or {a: 1}
                for b, n in out.items():
                    new[b] += int(now[a] * (url_filters.DAMPING * (n / sum(out.values()))))
            now = new
        assert {h: got[h][k] for h in hosts} == now


def test_url_filters_empty(spark):
    assert url_filters.verdicts(spark.createDataFrame([], PAGE)).count() == 0
    one = url_filters.verdicts(spark.createDataFrame([(1, "http://a.org/", None, "", "", "")], PAGE), rules=()).collect()
    assert [(r.host, r.rule, r.verdict) for r in one] == [("a.org", None, "allow")]


@pytest.mark.parametrize("name", ["op11_conversation_trie", "op12_merkle_manifest", "op13_url_filters"])
def test_query_against_sql(spark, name):
    from quantloom.llm import queries

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "conversations", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    result = con.execute(oracles.oracles()[name])
    names = [d[0] for d in result.description]
    df = queries.queries()[name](spark, sf)
    assert sorted(df.columns) == sorted(names)
    assert sorted(str([r[c] for c in names]) for r in df.collect()) == sorted(str(list(r)) for r in result.fetchall())
