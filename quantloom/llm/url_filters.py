"""Verdicts on URLs: rules on hosts and paths, and for what no rule fits the trust and distrust that reach its host over links.

Hosts are the nodes of a graph; an edge weighs the pages of a host that link to the other one (a relative link is one to the own host; a host whose
pages link nowhere keeps what it gets). A host's seed is the share of its pages that a rule allows (trust) or blocks (distrust). Personalised
PageRank spreads trust along the links, and distrust against them: who links to a blocked host is blamed. A host is blocked where
distrust reaches THRESHOLD and exceeds trust. Scores are whole numbers (seeds of at most UNIT, shares rounded down), so that sums do not depend on the order
in which tasks add; ROUNDS steps leave out less than 0.85 ** ROUNDS of a score.

Nulls: a null URL, or one without ``://``, has an empty host and path, is no node of the graph, fits no rule and is allowed. Null html has
no links. Repeated rows are pages of their own. The verdict of a URL is that of its host, whatever its page_id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, stash

#: Share of a score that goes on over links, steps, whole of a score, and the distrust from which a host is blocked.
DAMPING, ROUNDS, UNIT, THRESHOLD = 0.85, 24, 1_000_000_000_000, 500_000_000_000
#: Steps of propagation that are planned as one job.
STEPS_A_JOB = 4


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str


#: Fixed values.
RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))

A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
REFERENCE = r"""(?i)\s(?:href|src)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def lowered(c: F.Column) -> F.Column:
    return F.translate(c, A_TO_Z, A_TO_Z.lower())


def parts(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host and path of a URL; both empty where it is null or has no ``://``."""
    after = F.coalesce(F.when(F.contains(url, F.lit("://")), F.substring(url, F.locate("://", url) + 3, F.length(url))), F.lit(""))
    return lowered(F.regexp_extract(after, r"^([^/?#]*)", 1)), F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def fitting(host: F.Column, path: F.Column, rules: tuple[Rule, ...]) -> tuple[F.Column, F.Column]:
    """(rule, its verdict), null where none fits; the longest wins, then the smaller text, then block."""
    if not rules:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    ranked = sorted(rules, key=lambda r: (-len(r.host + r.path), r.host + r.path, r.verdict != "block"))
    rule = verdict = None
    for r in ranked:
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        rule = F.when(fits, r.host + r.path) if rule is None else rule.when(fits, r.host + r.path)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    return rule, verdict


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Pages with host, path, rule and the rule's verdict."""
    host, path = parts(F.col("url"))
    named = pages.select("page_id", "html", host.alias("host"), path.alias("path"))
    rule, verdict = fitting(F.col("host"), F.col("path"), rules)
    return named.withColumns({"rule": rule, "ruled": verdict})


def links(pages: DataFrame) -> DataFrame:
    """(src, dst, pages): the pages of a host that link to another one or to itself."""
    target = F.transform(F.regexp_extract_all("html", F.lit(REFERENCE), F.lit(0)), lambda x: F.trim(F.concat(*[F.regexp_extract(x, REFERENCE, k) for k in (1, 2, 3)])))
    absolute = F.transform(target, lambda x: F.when(F.startswith(x, F.lit("//")), F.concat(F.lit("http:"), x)).otherwise(x))

    def host_of(x: F.Column) -> F.Column:
        # A scheme other than http has no host that is a page; a fragment is no link.
        return F.when(F.rlike(x, F.lit("(?i)^https?://")), parts(x)[0]).when(F.rlike(x, F.lit("^[A-Za-z][A-Za-z0-9+.-]*:|^#|^$")), "").otherwise(F.col("host"))

    hosts = F.array_distinct(F.transform(absolute, host_of))
    return pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(hosts).alias("dst")).where("dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("pages"))


def scores(pages: DataFrame) -> DataFrame:
    """(host, trust, distrust) of every host that has pages or is linked to, from 0 to UNIT."""
    edges = stash(links(pages), "edges")
    share = lambda v: (F.sum((F.col("ruled") == v).cast("long")) * F.lit(UNIT).cast("decimal(38,0)")).cast("decimal(38,0)")
    seeds = pages.where("host <> ''").groupBy("host").agg(*[F.floor(F.coalesce(share(v), F.lit(0)) / F.count("*")).cast("long").alias(v) for v in ("allow", "block")])
    seeds = stash(seeds, "seeds")
    nodes = seeds.select("host").union(edges.select("src")).union(edges.select("dst")).distinct()
    # Two graphs in one: trust runs along the links, distrust against them; a node without a way on keeps its score.
    ways = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("node"), F.col("dst").alias("to"), "pages").union(edges.select(F.lit("distrust"), "dst", "src", "pages"))
    stuck = nodes.select(F.explode(F.array(F.lit("trust"), F.lit("distrust"))).alias("kind"), F.col("host").alias("node")).join(ways, ["kind", "node"], "left_anti")
    ways = ways.union(stuck.select("kind", "node", "node", F.lit(1).cast("long")))
    total = ways.groupBy("kind", "node").agg(F.sum("pages").alias("total"))
    ways = stash(ways.join(total, ["kind", "node"]).select("kind", "node", "to", (F.lit(DAMPING) * (F.col("pages") / F.col("total"))).alias("part")), "ways")
    start = seeds.select("host", F.explode(F.array(F.struct(F.lit("trust").alias("kind"), F.col("allow").alias("seed")), F.struct(F.lit("distrust").alias("kind"), F.col("block").alias("seed")))).alias("s")).select("s.kind", F.col("host").alias("node"), "s.seed")
    start = stash(start.where("seed > 0"), "start")
    kept = start.select("kind", "node", F.floor(F.col("seed") * F.lit(1 - DAMPING)).cast("long").alias("score"))
    now = kept
    for step in range(1, ROUNDS + 1):
        sent = ways.join(now, ["kind", "node"]).select("kind", F.col("to").alias("node"), F.floor(F.col("score") * F.col("part")).cast("long").alias("score"))
        now = kept.union(sent).groupBy("kind", "node").agg(F.sum("score").alias("score"))
        if step % STEPS_A_JOB == 0:
            now = stash(now, "scores")
    both = now.groupBy("node").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0)).cast("long").alias(k) for k in ("trust", "distrust")])
    return nodes.join(both.withColumnRenamed("node", "host"), "host", "left").na.fill(0, ["trust", "distrust"])


def verdicts(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's trust and distrust from 0 to 1."""
    known = judged(pages, rules)
    of_hosts = stash(scores(known), "hosts")
    rows = known.drop("html").join(of_hosts, "host", "left").na.fill(0, ["trust", "distrust"])
    blocked = (F.col("distrust") >= THRESHOLD) & (F.col("distrust") > F.col("trust"))
    verdict = F.coalesce("ruled", F.when(blocked, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), *[(F.col(c) / F.lit(float(UNIT))).alias(c) for c in ("trust", "distrust")])


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(read(spark, sf_dir, "pages"))
