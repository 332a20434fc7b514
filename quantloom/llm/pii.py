"""Operator 7: personal data by weak-supervision aggregation, in DataFrame functions only.

Four base kinds (email, ip, card, phone) are found by pattern and checked; they always stay. More candidates come from
wider patterns (local phone numbers, masked addresses, secrets after a trigger word, keys by their prefix, dashed id numbers). On every candidate,
base ones too, labelers vote yes, no or nothing: a pattern labeler on its form, a gazetteer labeler on trigger
words before it, and context labelers on what touches it. Votes are counted by combination over all documents;
expectation-maximisation on these counts estimates each labeler's reliability and the posterior of each combination,
and a logistic span classifier is trained on the posteriors. Candidates it accepts are added.

Positions are code points; patterns use possessive loops, so that long runs neither recurse nor backtrack.
Null and empty texts have no spans; ties cannot arise (spans of a kind do not overlap); each row is judged by itself,
repeated ones and those without doc_id too.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

LOCAL = "A-Za-z0-9._%+-"


@dataclass(frozen=True)
class Kind:
    name: str
    #: Only texts with this are searched.
    hint: str
    pattern: str
    #: Group of the pattern that is the span; it ends the match.
    group: int = 0
    base: bool = False
    #: Lower-case trigger words that speak for the kind when they stand before it.
    triggers: str = ""


KINDS = (
    # At the end of a match a local part may begin anew, else it begins where its characters do.
    Kind("email", "@", rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", base=True, triggers="mail|contact|write|correo|courriel"),
    Kind("ip", r"[0-9]\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", base=True, triggers="ip|host|server|address|login"),
    Kind("card", r"(?:[0-9][ -]?){12}[0-9]", r"[0-9]++(?:[ -][0-9]++)++|[0-9]{2,}+", base=True, triggers="card|visa|iban|account|konto|carte|tarjeta"),
    Kind("phone", r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]", base=True, triggers="tel|phone|call|fax|mobil"),
    Kind("local_phone", r"[0-9]{3}[ .-][0-9]{4}", r"(?<![0-9+] ?)(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])", triggers="tel|phone|call|fax|mobil"),
    Kind("masked_email", r"(?i)[(\[]at[)\]]", rf"(?i)[{LOCAL}]{{1,64}}+ ?[(\[]at[)\]] ?[A-Za-z0-9-]{{1,63}}+(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]{{1,63}}+){{1,8}}+", triggers="mail|contact|write"),
    Kind("secret", r"(?i)(?:token|secret|passw|key)", r"(?i)(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)[\"']?[ \t]{0,8}+[=:][ \t]{0,8}+[\"']?([A-Za-z0-9+/_-]{16,}+)", group=1, triggers="token|secret|passw|key"),
    Kind("key_id", "AKIA|ASIA|gh[opsu]_|xox[abps]-|sk[-_]", r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[opsu]_[A-Za-z0-9]{30,}+|xox[abps]-[A-Za-z0-9-]{10,}+|sk[-_][A-Za-z0-9_-]{20,}+)(?![A-Za-z0-9])", triggers="token|secret|key|id|aws"),
    Kind("id_number", r"[0-9]-[0-9]{2}-[0-9]", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", triggers="ssn|social|security|id"),
)
BASE = tuple(k.name for k in KINDS if k.base)
LABELERS = ("form", "trigger", "glued", "crowded", "varied", "repeated")

OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
SPAN = "array<struct<s:int,e:int,v:string,pre:string,post:string>>"


def matches(text: Column, kind: Kind) -> Column:
    """Spans of a pattern with the text before and after, from the pieces between the matches."""
    whole = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group)) if kind.group else whole
    pieces = F.split(text, kind.pattern, -1)
    parts = F.struct(whole.alias("w"), inner.alias("g"), pieces.alias("p"))
    found = F.transform(F.array(parts), lambda x: _positions(x))[0]
    return F.when(text.rlike(kind.hint), found).otherwise(F.array().cast(SPAN))


#: Items of the short array that an aggregate appends to, before it goes into the long one.
RUN = 256


def _more(acc: Column, item: Column, kind: str) -> list[Column]:
    """``item`` appended to the items of an aggregate's state, an array of arrays: appending copies RUN items, not all."""
    full = F.size(acc["run"]) >= RUN
    one = F.array(item).cast(kind)
    return [F.when(full, one).otherwise(F.concat(acc["run"], one)).alias("run"), F.when(full, F.concat(acc["runs"], F.array(acc["run"]))).otherwise(acc["runs"]).alias("runs")]


def _items(acc: Column) -> Column:
    return F.flatten(F.concat(acc["runs"], F.array(acc["run"])))


def _no_items(kind: str) -> list[Column]:
    return [F.array().cast(kind).alias("run"), F.array().cast(f"array<{kind}>").alias("runs")]


def _positions(x: Column) -> Column:
    def step(acc: Column, i: Column) -> Column:
        gap, w, g = F.get(x["p"], i), F.get(x["w"], i), F.get(x["g"], i)
        end = acc["pos"] + F.length(gap) + F.length(w)
        span = F.struct((end - F.length(g)).alias("s"), end.alias("e"), g.alias("v"), F.right(gap, F.lit(40)).alias("pre"), F.left(F.get(x["p"], i + 1), F.lit(20)).alias("post"))
        return F.struct(end.alias("pos"), *_more(acc, span, SPAN))

    start = F.struct(F.lit(0).alias("pos"), *_no_items(SPAN))
    index = F.when(F.size(x["w"]) > 0, F.sequence(F.lit(0), F.size(x["w"]) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(index, start, step, _items)


def luhn(digits: Column) -> Column:
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda acc, i: acc + F.transform(F.array(F.substring(digits, n - i + 1, F.lit(1)).cast("int")), lambda d: F.when(i % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0)))[0],
    )
    return total % 10 == 0


def valid(kind: str, v: Column) -> Column:
    """The check that a match of a base kind must pass."""
    if kind == "ip":
        return v.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        digits = F.regexp_replace(v, "[ -]", "")
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.regexp_replace(v, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def _valid_span(kind: str, x: Column) -> Column:
    return valid(kind, x["v"])


def spans_of(text: Column) -> dict[str, Column]:
    """Candidate spans by kind."""
    out = {}
    for k in KINDS:
        found = matches(text, k)
        if k.base and k.name != "email":
            found = F.filter(found, partial(_valid_span, k.name))
        out[k.name] = found
    return out


def votes(kind: Kind, x: Column) -> list[Column]:
    """1, -1 or 0 of each labeler of LABELERS for a span."""
    v, pre, post = x["v"], F.lower(x["pre"]), x["post"]
    digits = F.regexp_replace(v, "[^0-9]", "")
    if kind.name in ("email", "masked_email"):
        form = F.when(v.rlike(r"(?i)[a-z]{2,}$"), 1).otherwise(-1)
        varied = F.when(v.rlike(r"^[A-Za-z0-9]"), 1).otherwise(-1)
    elif kind.name == "ip":
        form = F.when(v.rlike(r"^(?:0|127|255)\."), -1).otherwise(1)
        varied = F.when(v.rlike(r"^([0-9]+)\.\1\.\1\.\1$"), -1).otherwise(0)
    elif kind.name == "secret":
        form = F.when(v.rlike("[0-9]") & v.rlike("[A-Za-z]"), 1).otherwise(-1)
        varied = F.when(v.rlike(r"(.)\1{5}"), -1).otherwise(1)
    else:
        form = F.when(digits.rlike(r"^0{4}|0{6}$"), -1).otherwise(1)
        varied = F.when(digits.rlike(r"^([0-9])\1*$"), -1).otherwise(1)
    trigger = F.when(pre.rlike(rf"(?:^|[^a-z])(?:{kind.triggers})[^\n]*$"), 1).otherwise(0)
    glued = F.when(pre.rlike(r"[\p{L}0-9]$") & (F.lit(kind.name) != "secret") | post.rlike(r"^[\p{L}0-9]"), -1).otherwise(1)
    crowded = F.when(pre.rlike(r"[0-9][^0-9]+[0-9][^0-9]+[0-9]"), -1).otherwise(0)
    repeated = F.when(F.length(pre) + F.length(post) == 0, -1).otherwise(0)
    return [form, trigger, glued, crowded, varied, repeated]


def _voted(kind: Kind, x: Column) -> Column:
    return F.struct(F.lit(kind.name).alias("kind"), *[v.alias(name) for v, name in zip(votes(kind, x), LABELERS, strict=True)])


def vote_table(docs: DataFrame) -> DataFrame:
    """(kind, vote of each labeler, n): at most 3 ** 6 rows a kind."""
    found = docs.select(*[c.alias(k) for k, c in spans_of(F.coalesce("text", F.lit(""))).items()])
    each = [F.transform(F.col(k.name), partial(_voted, k)) for k in KINDS]
    return found.select(F.explode(F.concat(*each)).alias("c")).select("c.*").groupBy("kind", *LABELERS).agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class Classifier:
    """Weights of the span classifier: by kind, and by labeler."""

    kinds: dict[str, float]
    labelers: tuple[float, ...]
    reliability: tuple[float, ...] = ()

    def score(self, kind: Kind, x: Column) -> Column:
        z = F.lit(self.kinds.get(kind.name, 0.0))
        for w, v in zip(self.labelers, votes(kind, x), strict=True):
            z = z + v * w
        return 1 / (1 + F.exp(-z))

    def accepts(self, kind: Kind, x: Column) -> Column:
        return self.score(kind, x) >= 0.5


def fit(counted: list[tuple[str, tuple[int, ...], int]], rounds: int = 40, steps: int = 300) -> Classifier:
    """Reliabilities by expectation-maximisation over vote combinations, then a logistic classifier on the posteriors."""
    total = sum(n for *_, n in counted)
    m = len(LABELERS)
    kinds = sorted({k for k, *_ in counted})
    if not total:
        return Classifier({}, (0.0,) * m, (0.5,) * m)
    prior = dict.fromkeys(kinds, 0.7)
    good = [0.7] * m
    post = [0.5] * len(counted)
    for _ in range(rounds):
        for i, (kind, vote, _) in enumerate(counted):
            z = math.log(prior[kind] / (1 - prior[kind])) + sum(v * math.log(g / (1 - g)) for v, g in zip(vote, good, strict=True))
            post[i] = 1 / (1 + math.exp(-max(-30, min(30, z))))
        for k in kinds:
            rows = [(p, n) for p, (kind, _, n) in zip(post, counted, strict=True) if kind == k]
            prior[k] = min(0.95, max(0.05, (sum(p * n for p, n in rows) + 7) / (sum(n for _, n in rows) + 10)))
        for j in range(m):
            right = sum(n * (p if vote[j] > 0 else 1 - p) for p, (_, vote, n) in zip(post, counted, strict=True) if vote[j])
            cast = sum(n for _, vote, n in counted if vote[j])
            # Labelers are taken to be better than chance.
            good[j] = min(0.98, max(0.55, (right + 7) / (cast + 10)))
    weights = dict.fromkeys(kinds, 0.0)
    w = [0.0] * m
    for _ in range(steps):
        by_kind, by_labeler = dict.fromkeys(kinds, 0.0), [0.0] * m
        for p, (kind, vote, n) in zip(post, counted, strict=True):
            z = weights[kind] + sum(a * v for a, v in zip(w, vote, strict=True))
            error = (p - 1 / (1 + math.exp(-max(-30, min(30, z))))) * n / total
            by_kind[kind] += error
            for j, v in enumerate(vote):
                by_labeler[j] += error * v
        for k in kinds:
            weights[k] += 2 * by_kind[k]
        w = [a + 2 * d - 0.0005 * a for a, d in zip(w, by_labeler, strict=True)]
    return Classifier(weights, tuple(w), tuple(good))


def train(docs: DataFrame) -> Classifier:
    rows = vote_table(docs).orderBy("kind", *LABELERS).collect()  # 3 ** 6 a kind at most
    return fit([(r["kind"], tuple(r[x] for x in LABELERS), r["n"]) for r in rows])


def find(docs: DataFrame, model: Classifier, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``keep`` columns, and by kind the spans that stay or are added (array of s, e)."""
    text = F.coalesce("text", F.lit(""))
    out = []
    for k, found in zip(KINDS, spans_of(text).values(), strict=True):
        kept = found if k.base else F.filter(found, partial(model.accepts, k))
        out.append(F.transform(kept, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).alias(f"spans_{k.name}"))
    return docs.select("doc_id", *keep, *out)


def _named(kind: str, x: Column) -> Column:
    return F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string"))


def _tagged(kind: str, x: Column) -> Column:
    return F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(f"<{kind.upper()}>").alias("tag"))


def _joined(kinds: tuple[str, ...]) -> Column:
    each = [F.transform(F.col(f"spans_{k}"), partial(_named, k)) for k in kinds]
    return F.concat_ws(",", F.concat(*each))


def report(found: DataFrame) -> DataFrame:
    """The base kinds' counts and digest, all spans, and the number of all spans and of those that the method added."""
    size = lambda k: F.size(f"spans_{k}").cast("long")
    counts = [size(k).alias(f"n_{k}") for k in BASE]
    total = lambda base: sum((size(k.name) for k in KINDS if k.base or not base), F.lit(0).cast("long"))
    return found.select("doc_id", *counts, F.sha2(_joined(BASE), 256).alias("base_sha256"), _joined(tuple(k.name for k in KINDS)).alias("spans"), total(False).alias("n_spans"), (total(False) - total(True)).alias("n_added"))


def redact(docs: DataFrame, model: Classifier) -> DataFrame:
    """``docs`` (columns of documents) with every span replaced by its kind in angle brackets, n_chars anew."""
    found = find(docs, model, ("text", "lang", "source", "n_chars"))
    tagged = [F.transform(F.col(f"spans_{k.name}"), partial(_tagged, k.name)) for k in KINDS]
    spans = F.array_sort(F.concat(*tagged))

    def step(acc: Column, x: Column) -> Column:
        """Overlapping spans become one, under the tag of the first."""
        piece = F.when(x["s"] >= acc["pos"], F.concat(F.substring(F.col("text"), acc["pos"] + 1, x["s"] - acc["pos"]), x["tag"])).otherwise("")
        return F.struct(F.greatest(acc["pos"], x["e"]).alias("pos"), *_more(acc, piece, "array<string>"))

    start = F.struct(F.lit(0).alias("pos"), *_no_items("array<string>"))
    rebuilt = F.aggregate("spans", start, step, lambda acc: F.concat(F.array_join(_items(acc), ""), F.substring(F.col("text"), acc["pos"] + 1, F.length("text"))))
    marked = found.withColumn("spans", spans)
    text = F.when(F.size("spans") > 0, rebuilt).otherwise(F.col("text"))
    n_chars = F.when(F.size("spans") > 0, F.length(rebuilt).cast("long")).otherwise(F.col("n_chars"))
    return marked.select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return report(find(docs, train(docs)))
