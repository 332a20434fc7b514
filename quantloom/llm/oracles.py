"""SQL that gives the rows of those queries that SQL can express."""

from __future__ import annotations


def crc32(text: str) -> str:
    """Unsigned CRC-32 of ASCII text."""
    bits = "list_reduce(range(8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b))"
    return f"xor(list_reduce(list_transform(range(1, length({text}) + 1), lambda i: CAST(ascii(substr({text}, i, 1)) AS BIGINT)), lambda c, b: {bits}, 4294967295), 4294967295)"


CONVERSATION_TRIE = f"""
WITH turns AS MATERIALIZED (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i,
  {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS t FROM conversations WHERE conv_id IS NOT NULL),
 talks AS MATERIALIZED (SELECT conv_id, list(t ORDER BY i) AS own, {crc32("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM turns GROUP BY conv_id),
 rebuilt AS MATERIALIZED (SELECT a.conv_id, list_concat(CASE WHEN b.own IS NULL THEN [] ELSE b.own[1:a.h] END, a.own[a.h + 1:]) AS seq FROM talks a LEFT JOIN talks b ON b.conv_id = a.conv_id - a.conv_id % 100),
 members AS MATERIALIZED (SELECT conv_id, d AS depth, seq[1:d] AS path, len(seq) = d AS ends FROM rebuilt, unnest(range(0, len(seq) + 1)) AS r(d)),
 nodes AS MATERIALIZED (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '') AS ids FROM members GROUP BY depth, path),
 saved AS MATERIALIZED (SELECT *, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(path[depth].text) END AS own FROM nodes),
 kids AS (SELECT depth - 1 AS depth, path[1:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1, 2),
 full_nodes AS MATERIALIZED (SELECT s.*, coalesce(k.n, 0) AS n_children FROM saved s LEFT JOIN kids k ON k.depth = s.depth AND k.path = s.path),
 above AS (SELECT d AS depth, path[1:d] AS path, sum(own) AS saved_tokens, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves FROM full_nodes, unnest(range(0, depth + 1)) AS r(d) GROUP BY 1, 2)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, CAST(n.n_children AS BIGINT) AS n_children, CAST(a.n_leaves AS BIGINT) AS n_leaves,
 CAST(a.saved_tokens AS BIGINT) AS saved_tokens, sha256(n.ids) AS ends_sha256
FROM full_nodes n JOIN above a ON a.depth = n.depth AND a.path = n.path LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]
"""


def _leaf(n_chars: str) -> str:
    def field(c: str) -> str:
        return f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"

    return "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


def _levels(name: str, rows: str) -> str:
    """Levels of the trees of groups g with nodes i of n, and for each leaf its siblings' hashes by level."""
    return f"""{name} AS (SELECT g, 0 AS level, i, n, h FROM {rows} UNION ALL
  SELECT g, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY g, level, i // 2, n)"""


MERKLE_MANIFEST = f"""
WITH RECURSIVE leaves AS MATERIALIZED (SELECT doc_id, lang AS g, {_leaf("n_chars")} AS h, CASE WHEN {crc32("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_leaf("(n_chars + 1)")} END AS bad,
  row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents),
 {_levels("trees", "leaves")},
 subroots AS MATERIALIZED (SELECT g AS lang, h, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, count(*) OVER () AS n, 0 AS g FROM trees WHERE n = 1),
 {_levels("forest", "subroots")},
 top AS MATERIALIZED (SELECT h AS root FROM forest WHERE n = 1),
 heights AS MATERIALIZED (SELECT g, max(level) AS height FROM trees GROUP BY g),
 steps AS MATERIALIZED (SELECT l.g AS lang, l.i AS leaf, t.level, t.h AS sibling, t.i > (l.i >> t.level) AS later FROM leaves l JOIN trees t ON t.g IS NOT DISTINCT FROM l.g AND t.i = xor(l.i >> t.level, 1) AND t.n > 1
  UNION ALL SELECT l.g, l.i, h.height + f.level, f.h, f.i > (s.i >> f.level) FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.g JOIN heights h ON h.g IS NOT DISTINCT FROM l.g JOIN forest f ON f.i = xor(s.i >> f.level, 1) AND f.n > 1),
 total AS MATERIALIZED (SELECT h.g AS lang, h.height + (SELECT max(level) FROM forest) AS height, s.h AS subroot FROM heights h JOIN subroots s ON s.lang IS NOT DISTINCT FROM h.g),
 proofs AS MATERIALIZED (SELECT lang, leaf, string_agg(sibling, '' ORDER BY level) AS path FROM steps GROUP BY lang, leaf),
 folds AS (SELECT g AS lang, i AS leaf, 0 AS level, coalesce(bad, h) AS h FROM leaves UNION ALL
  SELECT f.lang, f.leaf, f.level + 1, sha256(CASE WHEN s.sibling IS NULL THEN f.h WHEN s.later THEN f.h || s.sibling ELSE s.sibling || f.h END)
  FROM folds f JOIN total t ON t.lang IS NOT DISTINCT FROM f.lang AND f.level < t.height LEFT JOIN steps s ON s.lang IS NOT DISTINCT FROM f.lang AND s.leaf = f.leaf AND s.level = f.level)
SELECT l.doc_id, l.h AS leaf, t.subroot, top.root, sha256(coalesce(p.path, '')) AS proof_sha256, f.h AS folded_root, f.h = top.root AS verified
FROM leaves l JOIN total t ON t.lang IS NOT DISTINCT FROM l.g JOIN folds f ON f.lang IS NOT DISTINCT FROM l.g AND f.leaf = l.i AND f.level = t.height CROSS JOIN top
LEFT JOIN proofs p ON p.lang IS NOT DISTINCT FROM l.g AND p.leaf = l.i
"""

_REFERENCE = r"""(?i)\s(?:href|src)\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))"""
_AFTER = "CASE WHEN contains({0}, '://') THEN substr({0}, strpos({0}, '://') + 3) ELSE '' END"
_HOST = "translate(regexp_extract({0}, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _rounds(rounds: int, damping: float) -> str:
    """A step of propagation for each round; sums of whole numbers do not depend on their order."""
    out = [f"r0 AS MATERIALIZED (SELECT kind, node, CAST(floor(seed * {1 - damping!r}::DOUBLE) AS BIGINT) AS score FROM seeds WHERE seed > 0)"]
    for k in range(1, rounds + 1):
        out.append(
            f"r{k} AS MATERIALIZED (SELECT kind, node, CAST(sum(score) AS BIGINT) AS score FROM (SELECT * FROM r0 UNION ALL SELECT w.kind, w.dst, CAST(floor(r.score * w.part) AS BIGINT) FROM ways w JOIN r{k - 1} r ON r.kind = w.kind AND r.node = w.node) GROUP BY 1, 2)"
        )
    return ",\n ".join(out)


def url_filters(rules: tuple[tuple[str, str, str], ...], damping: float, rounds: int, unit: int, threshold: int) -> str:
    table = ", ".join(f"('{verdict}', '{host}', '{path}')" for verdict, host, path in rules)
    return f"""
WITH rules AS (SELECT * FROM (VALUES {table}) AS v(verdict, rule_host, rule_path)),
 rows AS MATERIALIZED (SELECT row_number() OVER () AS k, page_id, html, {_HOST.format("a")} AS host, regexp_extract(a, '^[^/?#]*([^?#]*)', 1) AS path FROM (SELECT *, coalesce({_AFTER.format("url")}, '') AS a FROM pages)),
 fits AS (SELECT k, rule_host || rule_path AS rule, verdict, row_number() OVER (PARTITION BY k ORDER BY length(rule_host || rule_path) DESC, rule_host || rule_path) AS r
  FROM rows JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
 known AS MATERIALIZED (SELECT rows.*, f.rule, f.verdict FROM rows LEFT JOIN fits f ON f.k = rows.k AND f.r = 1),
 targets AS (SELECT k, host, trim(regexp_extract(x, '{_REFERENCE}', 1) || regexp_extract(x, '{_REFERENCE}', 2) || regexp_extract(x, '{_REFERENCE}', 3)) AS x
  FROM (SELECT k, host, unnest(regexp_extract_all(html, '{_REFERENCE}')) AS x FROM known WHERE host <> '')),
 whole AS (SELECT k, host, CASE WHEN starts_with(x, '//') THEN 'http:' || x ELSE x END AS x FROM targets),
 linked AS (SELECT DISTINCT k, host AS src, CASE WHEN regexp_matches(x, '(?i)^https?://') THEN {_HOST.format("(" + _AFTER.format("x") + ")")}
  WHEN regexp_matches(x, '^[A-Za-z][A-Za-z0-9+.-]*:|^#|^$') THEN '' ELSE host END AS dst FROM whole),
 edges AS MATERIALIZED (SELECT src, dst, count(*) AS pages FROM linked WHERE dst <> '' GROUP BY 1, 2),
 shares AS MATERIALIZED (SELECT host, count(*) AS n, count(*) FILTER (verdict = 'allow') AS a, count(*) FILTER (verdict = 'block') AS b FROM known WHERE host <> '' GROUP BY host),
 seeds AS MATERIALIZED (SELECT 'trust' AS kind, host AS node, CAST(a AS HUGEINT) * {unit} // n AS seed FROM shares UNION ALL SELECT 'distrust', host, CAST(b AS HUGEINT) * {unit} // n FROM shares),
 nodes AS MATERIALIZED (SELECT host FROM shares UNION SELECT src FROM edges UNION SELECT dst FROM edges),
 moves AS MATERIALIZED (SELECT 'trust' AS kind, src AS node, dst, pages FROM edges UNION ALL SELECT 'distrust', dst, src, pages FROM edges
  UNION ALL SELECT 'trust', host, host, 1 FROM nodes WHERE host NOT IN (SELECT src FROM edges) UNION ALL SELECT 'distrust', host, host, 1 FROM nodes WHERE host NOT IN (SELECT dst FROM edges)),
 ways AS MATERIALIZED (SELECT kind, node, dst, {damping!r}::DOUBLE * (CAST(pages AS DOUBLE) / CAST(sum(pages) OVER (PARTITION BY kind, node) AS DOUBLE)) AS part FROM moves),
 {_rounds(rounds, damping)},
 hosts AS (SELECT n.host, coalesce(t.score, 0) AS trust, coalesce(d.score, 0) AS distrust FROM nodes n LEFT JOIN r{rounds} t ON t.kind = 'trust' AND t.node = n.host LEFT JOIN r{rounds} d ON d.kind = 'distrust' AND d.node = n.host)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN coalesce(distrust, 0) >= {threshold} AND distrust > trust THEN 'block' ELSE 'allow' END) AS verdict,
 coalesce(trust, 0) / {float(unit)!r}::DOUBLE AS trust, coalesce(distrust, 0) / {float(unit)!r}::DOUBLE AS distrust FROM known LEFT JOIN hosts USING (host)
"""


def oracles() -> dict[str, str]:
    from . import url_filters as uf

    rules = tuple((r.verdict, r.host, r.path) for r in uf.RULES)
    return {
        "op11_conversation_trie": CONVERSATION_TRIE,
        "op12_merkle_manifest": MERKLE_MANIFEST,
        "op13_url_filters": url_filters(rules, uf.DAMPING, uf.ROUNDS, uf.UNIT, uf.THRESHOLD),
    }
