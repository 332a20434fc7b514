"""Lexicon sentiment, keywords, and a batch parser of user messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CJK = "[\\u4e00-\\u9fff]"
PLATFORM_WEIGHTS = {"twitter": 0.35, "reddit": 0.35, "weibo": 0.30}
OTHER_WEIGHT = 0.3


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-zà-ÿ]+"), F.lit(0))


def pairs(text: Column) -> Column:
    """Distinct characters and pairs of neighbours of a text, each found in one pass."""
    return F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), F.regexp_extract_all(text, F.lit("(?s)(?=(..))"), F.lit(1))))


#: Keys of a word list that texts are looked through for before they are joined with it; a longer list is joined at once.
KEYS = 100_000


def with_keys(rows: DataFrame, words: DataFrame, key: Column) -> DataFrame:
    """rows with ``_keys``, the distinct keys of ``words``: one broadcast row of KEYS keys at most; null if there are more."""
    some = words.select(key.alias("_key")).distinct().limit(KEYS + 1).agg(F.collect_set("_key").alias("_keys"))
    return rows.crossJoin(F.broadcast(some.select(F.when(F.size("_keys") <= KEYS, F.col("_keys")).alias("_keys"))))


def among(found: Column) -> Column:
    """Distinct items of an array that are among ``_keys``."""
    return F.when(F.col("_keys").isNull(), F.array_distinct(found)).otherwise(F.array_intersect(found, "_keys"))


def small(words: DataFrame) -> DataFrame:
    """A word list marked for broadcast if it has KEYS rows at most; a longer one is joined by a shuffle."""
    return F.broadcast(words) if words.limit(KEYS + 1).count() <= KEYS else words


def holding(rows: DataFrame, words: DataFrame, word: str) -> DataFrame:
    """rows (with a column text) joined with the words that occur in the text: an equi-join on a word's first two characters, then a check."""
    start = F.substring(word, 1, 2)
    keyed = with_keys(rows, words, start).withColumn("_key", F.explode(among(pairs(F.col("text"))))).drop("_keys")
    return keyed.join(words.withColumn("_key", start), "_key").where(F.contains("text", word)).drop("_key")


def sentiment(posts: DataFrame, lexicon: DataFrame, key: str = "post_id") -> DataFrame:
    """positive, negative, score and label of each post, by a lexicon (word, polarity 1 or -1).

    Words without CJK characters match tokens, by a join with the lexicon; in texts with CJK characters its CJK words match as
    substrings.
    """
    cjk_words = lexicon.where(F.col("word").rlike(CJK))
    rows = posts.select(key, F.coalesce("text", F.lit("")).alias("text"))
    plain = lexicon.where(~F.col("word").rlike(CJK))
    # Tokens meet the lexicon where they are split, so that only sums by post are shuffled.
    hits = rows.select(key, F.explode(tokens(F.col("text"))).alias("word")).join(small(plain), "word")
    counted = lambda sign: F.count_if(sign).cast("long")
    latin = hits.groupBy(key).agg(counted(F.col("polarity") > 0).alias("p"), counted(F.col("polarity") < 0).alias("n"))
    times = (F.length("text") - F.length(F.replace("text", "word", F.lit("")))) / F.length("word")
    cjk = holding(rows.where(F.col("text").rlike(CJK)), cjk_words, "word").groupBy(key).agg(F.sum(F.when(F.col("polarity") > 0, times).otherwise(0)).cast("long").alias("p"), F.sum(F.when(F.col("polarity") < 0, times).otherwise(0)).cast("long").alias("n"))
    both = latin.unionByName(cjk).groupBy(key).agg(F.sum("p").alias("positive"), F.sum("n").alias("negative"))
    df = rows.select(key).join(both, key, "left").fillna(0, ["positive", "negative"])
    return labelled(df.withColumn("score", F.when(F.col("positive") + F.col("negative") > 0, F.col("positive") / (F.col("positive") + F.col("negative"))).otherwise(0.5)))


def labelled(df: DataFrame) -> DataFrame:
    return df.withColumn("label", F.when(F.col("score") > 0.6, "positive").when(F.col("score") < 0.4, "negative").otherwise("neutral"))


def by_platform(scored: DataFrame) -> DataFrame:
    """Posts per platform and label; the score counts positive and negative posts only."""
    p, n = F.count_if(F.col("label") == "positive"), F.count_if(F.col("label") == "negative")
    df = scored.groupBy("platform").agg(F.count("*").alias("posts"), p.alias("positive"), n.alias("negative"), F.count_if(F.col("label") == "neutral").alias("neutral"))
    return labelled(df.withColumn("score", F.when(F.col("positive") + F.col("negative") > 0, F.col("positive") / (F.col("positive") + F.col("negative"))).otherwise(0.5)))


def combined(platforms: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """One row: weighted score over platforms, totals, label."""
    w = F.lit(OTHER_WEIGHT)
    for name, x in (PLATFORM_WEIGHTS if weights is None else weights).items():
        w = F.when(F.col("platform") == name, x).otherwise(w)
    df = platforms.withColumn("_w", w).agg(F.sum("posts").alias("posts"), F.sum("positive").alias("positive"), F.sum("negative").alias("negative"), F.coalesce(F.sum(F.col("score") * F.col("_w")) / F.sum("_w"), F.lit(0.5)).alias("score"))
    return labelled(df)


def keywords(posts: DataFrame, stop_words: DataFrame, n: int = 10, by: str = "platform") -> DataFrame:
    """The n most frequent tokens of each group (more than one letter, no stop words; CJK runs of 2 to 4); ties by first seen.

    posts: (by, seq, text). Counts are aggregated map-side before they are ranked.
    """
    cjk = F.regexp_extract_all("text", F.lit(f"{CJK}{{2,4}}"), F.lit(0))
    words = F.posexplode(F.concat(F.filter(tokens(F.col("text")), lambda t: F.length(t) > 1), cjk)).alias("pos", "word")
    df = posts.select(by, "seq", words).join(stop_words, "word", "left_anti")
    counted = df.groupBy(by, "word").agg(F.count("*").alias("n"), F.min(F.struct("seq", "pos")).alias("first"))
    rank = F.row_number().over(W.partitionBy(by).orderBy(F.desc("n"), "first"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= n).select(by, "word", "n", "rank")


def merge_keywords(top: DataFrame, n: int = 10) -> DataFrame:
    """Counts of groups' lists summed, the n largest; ties by word."""
    return top.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(n)


#: Intents in order, with what a message must hold (fixed values).
INTENTS = {
    "backtest": "回测|回檢|backtest|模拟交易|策略测试",
    "optimize": "优化|優化|optimize|最优配置|资产配置|组合优化|馬科維茨|配置",
    "portfolio": "持仓|持倉|portfolio|我的组合|投资组合|仓位|倉位|持股|盈亏|收益如何",
    "market": "市场|市場|market|大盘|大盤|行情|指数|指數|overview",
    "analyze_batch": "批量|batch|多个|多支|多隻|一起分析|全部|所有股票",
    "analyze_single": "分析|查看|评估|評估|analyz|evaluate|诊断|診斷|怎么样|怎麼樣|如何",
}
#: Codes of listed shares: mainland, Hong Kong, Korean, capitals alone and with a two-letter suffix (fixed values).
CODES = r"[0368][0-9]{5}\.(?:SS|SZ)|[0-9]{6}\.KS|[0-9]{4}\.HK|[A-Z]{2,5}\.[A-Z]{2}|(?<![0-9])[036][0-9]{5}(?![0-9])|(?<![A-Za-z0-9])[A-Z]{1,5}(?:-[A-Z])?(?![A-Za-z0-9])"
#: Capitals that are no symbols (fixed values).
NOT_CODES = tuple(
    """POST GET API NLP AI HTTP HTTPS JSON XML HTML CSS SQL URL USA UK EU UN NASA FBI CIA IBM CPU GPU RAM SSD HDD USB PDF DOC XLS PPT CSV TXT JPG PNG GIF MP3 MP4 AVI WAV ZIP RAR
    TAR GZ EXE DLL BAT CMD SH PY JS TS JAVA CPP GO RUST PHP RUBY PERL LUA SWIFT KOTLIN SCALA CLOJURE HASKELL ERLANG ELIXIR DART FLUTTER REACT VUE ANGULAR SVELTE NEXT NUXT DJANGO
    FLASK FASTAPI SPRING LARAVEL SYMFONY RAILS EXPRESS NEST ASPNET HK SS SZ KS SW PA""".split()
)
#: Names of strategies in messages, the first that occurs counts, short ones not inside a word (fixed values).
STRATEGIES = {"buy_hold": "买入持有|買入持有|buy.?hold|持有策略|长期持有|長期持有", "sma_cross": r"均线交叉|均線交叉|(?<!\p{IsLatin})sma.?cross|moving.average|双均线|雙均線", "rsi": r"(?<!\p{IsLatin})rsi(?!\p{IsLatin})|相对强弱|相對強弱"}
#: Words before a sum of money, what may stand between, ten-thousands after it, words for shares, before what a share cost, and between holdings (fixed values).
MONEY, LINKS, MYRIAD, SHARES, COST, BREAKS = ("本金", "资金", "資金", "capital", "initial"), "为為是:", ("万", "萬", "w"), ("股", "shares", "share"), ("平均成本", "成本", "cost", "均价"), ",，、;；"
NUMBER = r"[0-9]+(?:\.[0-9]+)?"


def after(text: Column, words: tuple[str, ...]) -> Column:
    """What follows each occurrence of one of the words, up to the next one."""
    pieces = F.split(text, "|".join(words))
    return F.slice(pieces, 2, F.size(pieces))


def leading(text: Column) -> Column:
    """The number at the start of a text, else empty."""
    return F.regexp_extract(F.ltrim(text), f"^{NUMBER}", 0)


def quantities(text: Column) -> Column:
    """Each number of shares in a text and what follows it, up to the next one."""
    unit = rf"({NUMBER})\s*(?:{'|'.join(SHARES)})"
    pieces = F.split(text, unit)
    return F.transform(F.arrays_zip(F.regexp_extract_all(text, F.lit(unit), F.lit(1)).alias("shares"), F.slice(pieces, 2, F.size(pieces)).alias("rest")), lambda q: F.struct(q["shares"].alias("shares"), q["rest"].alias("rest")))


def symbols(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(CODES), F.lit(0))
    return F.array_distinct(F.filter(found, lambda x: ~x.isin(*NOT_CODES)))


def intent(messages: DataFrame) -> DataFrame:
    """Intent of each message: the first pattern that it holds; several symbols mean a batch, one a single analysis."""
    text = F.coalesce("text", F.lit(""))
    n = F.size(symbols(text))
    out = F.when(n >= 1, "analyze_single").otherwise("unknown")
    for name, pattern in reversed(INTENTS.items()):
        hit = text.rlike(pattern) | (n >= 2) if name == "analyze_batch" else text.rlike(pattern)
        out = F.when(hit, name).otherwise(out)
    return messages.withColumn("intent", out)


def _with_symbol(rows: DataFrame, names: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """rows (keys, text, ...) with the symbol that the text names: a code, or the longest name in it; null if it names none."""
    named = holding(rows.select(*keys, "text"), names, "name").groupBy(*keys).agg(F.max_by("symbol", F.struct(F.length("name"), "name")).alias("_named"))
    return rows.join(named, list(keys), "left").withColumn("symbol", F.coalesce("_named", F.get(symbols(F.col("text")), 0))).drop("_named")


def holdings(messages: DataFrame, names: DataFrame, key: str = "message_id") -> DataFrame:
    """(key, holdings): symbol:shares:cost of each holding that a message states, joined with commas; rows of one key have one text.

    A holding is a number of shares and a name, with what it cost if that follows. In a message without such a one, every part
    between commas is one if it holds a number of shares and a symbol in any order.
    """
    rows = messages.select(key, F.coalesce("text", F.lit("")).alias("text"))
    keys = (key, "pos")
    # What follows a quantity belongs to it as far as the next break: a name, then perhaps what it cost.
    rest = F.split(F.col("h.rest"), f"[{BREAKS}]")[0]
    paid = F.get(after(rest, COST), 0)
    name = F.regexp_extract(F.ltrim(F.when(paid.isNotNull(), F.split(rest, "|".join(COST))[0]).otherwise(rest)), r"^[^0-9\s]+", 0)
    first = rows.select(key, F.posexplode(quantities(F.col("text"))).alias("pos", "h")).select(*keys, F.col("h.shares").alias("shares"), name.alias("text"), leading(F.coalesce(paid, F.lit(""))).alias("cost"))
    first = _with_symbol(first.where("text <> ''"), names, keys).where("symbol is not null")
    others = rows.where(F.size(quantities(F.col("text"))) > 0).join(first.select(key).distinct(), key, "left_anti")
    part = others.select(key, F.posexplode(F.split("text", f"[{BREAKS}]")).alias("pos", "text"))
    prices = F.filter(F.transform(after(F.col("text"), (*COST, "@", r"\bat\b")), leading), lambda x: x != "")
    part = part.select(*keys, F.get(quantities(F.col("text")), 0)["shares"].alias("shares"), "text", F.coalesce(F.get(prices, 0), F.lit("")).alias("cost")).where("shares is not null")
    second = _with_symbol(part, names, keys).where("symbol is not null")
    one = F.struct("pos", F.concat_ws(":", "symbol", "shares", F.when(F.col("cost") == "", "0").otherwise(F.col("cost"))).alias("h"))
    return first.unionByName(second).groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_set(one)), lambda x: x["h"]), ",").alias("holdings"))


def capital(text: Column) -> Column:
    """The first sum after a word for money, in units; 100,000 if none is named."""
    said = F.transform(after(text, MONEY), lambda x: F.regexp_replace(x, rf"^[\s{LINKS}]+", ""))
    sums = F.filter(F.transform(said, lambda x: F.struct(leading(x).alias("amount"), F.ltrim(F.regexp_replace(x, f"^{NUMBER}", "")).alias("rest"))), lambda s: s["amount"] != "")
    one = F.get(sums, 0)
    times = F.when(F.exists(F.array(*map(F.lit, MYRIAD)), lambda u: F.startswith(one["rest"], u)), 10_000.0).otherwise(1.0)
    return F.coalesce(one["amount"].try_cast("double") * times, F.lit(100_000.0))


def target_return(text: Column) -> Column:
    """The first percentage, as a share; null if there is none."""
    ends = F.transform(F.split(text, "%"), lambda x: F.regexp_extract(F.rtrim(x), f"{NUMBER}$", 0))
    stated = F.filter(F.slice(ends, 1, F.size(ends) - 1), lambda x: x != "")
    return F.get(stated, 0).try_cast("double") / 100


def entities(messages: DataFrame, names: DataFrame) -> DataFrame:
    """Symbols (by code, and by name from a table (name, symbol)), strategy, capital, target return, holdings.

    Messages may share a message_id, or have none: what a message holds is found again by its id and a hash of its text.
    """
    text = F.coalesce("text", F.lit(""))
    rows = messages.select("message_id", text.alias("text"), F.struct("message_id", F.sha2(text, 256)).alias("_message"))
    named = holding(rows.select("_message", "text"), names, "name").groupBy("_message").agg(F.array_sort(F.collect_set("symbol")).alias("_named"))
    df = rows.join(named, "_message", "left").join(holdings(rows, names, "_message"), "_message", "left")
    strategy = F.lit("buy_hold")
    for name, pattern in reversed(STRATEGIES.items()):
        strategy = F.when(text.rlike(f"(?i){pattern}"), name).otherwise(strategy)
    every = F.array_distinct(F.concat(F.coalesce("_named", F.array().cast("array<string>")), symbols(text)))
    return df.select("message_id", F.array_join(every, ",").alias("symbols"), strategy.alias("strategy"), capital(text).alias("capital"), target_return(text).alias("target_return"), F.coalesce("holdings", F.lit("")).alias("holdings"))
