"""Queries on mean-variance, ML, alerts, streams, text and review tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alerts as al
from ..operators import ml
from ..operators import optimize as op
from ..operators import review as rv
from ..operators import text as tx
from ..operators.portfolio import trades
from ..sources.shared import new_folder
from ..streaming import market as sm
from .adapters import BARS, MEMBERS, WEEKLY, bars, equity, shared, strategy_members, table, weekly
from .indicator_plans import IND, lag
from .portfolio_plans import _BUY, _SELL, EQUITY, FOLD, GRID, SID, folded, grid, schedule
from .quality_plans import COVERAGE, run_tables
from .registry import ORACLES, query, select

# Mean-variance: a universe is a strategy's five brands


def universe(spark, sf_dir):
    m = strategy_members(bars(spark, sf_dir)).select(F.col("strategy_id").alias("universe"), "symbol")
    return weekly(spark, sf_dir).join(m, "symbol").select("universe", "date", "symbol", "close")


@shared
def rets(spark, sf_dir):
    return op.returns(universe(spark, sf_dir))


RETS = f"""{WEEKLY}, {MEMBERS}, u0 AS (SELECT strategy_id AS universe, date, symbol, close FROM members JOIN bars_w USING (symbol)), u1 AS (SELECT * FROM u0 QUALIFY count(*) OVER (PARTITION BY universe, date) = 5),
 rets AS MATERIALIZED (SELECT universe, date, symbol, ret FROM (SELECT *, close / lag(close) OVER (PARTITION BY universe, symbol ORDER BY date) - 1 AS ret FROM u1) WHERE ret IS NOT NULL),
 means AS MATERIALIZED (SELECT universe, symbol, avg(ret) AS mean FROM rets GROUP BY 1, 2), cov AS MATERIALIZED (SELECT x.universe, x.symbol AS a, y.symbol AS b, covar_samp(x.ret, y.ret) AS cov FROM rets x JOIN rets y ON x.universe = y.universe AND x.date = y.date GROUP BY 1, 2, 3)"""
query("returns_matrix", f"WITH {RETS} " + select("universe, date, symbol", "ret", "FROM rets"))(rets)
query("return_moments", f"WITH {RETS} " + select("universe, a, b", "cov; mean", "FROM cov JOIN (SELECT universe, symbol AS a, mean FROM means) USING (universe, a)"))(lambda s, d: (lambda m: m[1].join(m[0].withColumnRenamed("symbol", "a"), ["universe", "a"]).select("universe", "a", "b", "cov", "mean"))(op.moments(rets(s, d))))
# All brands as one universe, by blocks of four symbols
_ALL = RETS.replace("SELECT strategy_id AS universe, date", "SELECT 0 AS universe, date").replace("PARTITION BY universe, date) = 5", "PARTITION BY universe, date) = 25")


def all_rets(spark, sf_dir):
    return op.returns(universe(spark, sf_dir).withColumn("universe", F.lit(0)))


query("return_moments_wide", f"WITH {_ALL} " + select("universe, a, b", "cov; mean", "FROM cov JOIN (SELECT universe, symbol AS a, mean FROM means) USING (universe, a)"))(
    lambda s, d: (lambda m: m[1].join(m[0].withColumnRenamed("symbol", "a"), ["universe", "a"]).select("universe", "a", "b", "cov", "mean"))(op.wide_moments(all_rets(s, d), 4))
)
#: Weeks of a rolling window.
WINDOW = 52
_ROLL = "(PARTITION BY x.universe, x.symbol, y.symbol ORDER BY x.date ROWS BETWEEN 51 PRECEDING AND CURRENT ROW)"
query(
    "rolling_moments",
    f"WITH {RETS}, roll AS (SELECT x.universe, x.date, x.symbol AS a, y.symbol AS b, covar_samp(x.ret, y.ret) OVER {_ROLL} AS cov, avg(x.ret) OVER {_ROLL} AS mean, count(*) OVER {_ROLL} AS n FROM rets x JOIN rets y ON x.universe = y.universe AND x.date = y.date) "
    + select("universe, date, a, b", "cov; mean", "FROM roll WHERE n = 52"),
)(lambda s, d: (lambda m: m[1].join(m[0].withColumnRenamed("symbol", "a"), ["universe", "date", "a"]).select("universe", "date", "a", "b", "cov", "mean"))(op.rolling_moments(rets(s, d), WINDOW)))
query("opt_rolling_min_variance")(lambda s, d: op.min_variance(*op.rolling_moments(rets(s, d), WINDOW), by=("universe", "date")))
query("opt_rolling_best_sharpe")(lambda s, d: op.best_sharpe(*op.rolling_moments(rets(s, d), WINDOW), by=("universe", "date")))
query("opt_min_variance")(lambda s, d: op.min_variance(*op.moments(rets(s, d))))
query("opt_target_return")(lambda s, d: op.target_return(*op.moments(rets(s, d)), 0.5))
query("opt_frontier")(lambda s, d: op.frontier(*op.moments(rets(s, d)), 8))


def fixed(spark, sf_dir):
    return strategy_members(bars(spark, sf_dir)).select(F.col("strategy_id").alias("universe"), "symbol", "weight")


def stats_sql(source: str, keys: str) -> str:
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    return f"""st AS (SELECT {', '.join('a.' + k for k in keys.split(', '))}, sum(a.weight * b.weight * cov) * 252 AS variance FROM {source} a JOIN {source} b ON {on} JOIN cov c ON c.universe = a.universe AND c.a = a.symbol AND c.b = b.symbol GROUP BY ALL),
 sr AS (SELECT {keys}, sum(weight * mean) * 252 AS annual_return FROM {source} JOIN means USING (universe, symbol) GROUP BY ALL), stats AS (SELECT *, sqrt(variance) AS volatility, (annual_return - 0.02) / nullif(sqrt(variance), 0) AS sharpe_ratio FROM sr JOIN st USING ({keys}))"""


query("opt_portfolio_stats", f"WITH {RETS}, fixed AS (SELECT strategy_id AS universe, symbol, weight FROM members), {stats_sql('fixed', 'universe')} " + select("universe", "annual_return; variance; volatility; sharpe_ratio", "FROM stats"))(lambda s, d: op.stats(fixed(s, d), *op.moments(rets(s, d))))


def candidates(spark, sf_dir):
    """Twenty candidate weightings of each universe."""
    k = F.regexp_extract("symbol", "[0-9]+", 0).cast("int")
    df = fixed(spark, sf_dir).select("universe", "symbol", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("candidate")).withColumn("w", 1.0 + k * F.col("candidate") % 23)
    total = df.groupBy("universe", "candidate").agg(F.sum("w").alias("t"))
    return df.join(total, ["universe", "candidate"]).select("universe", "candidate", "symbol", (F.col("w") / F.col("t")).alias("weight"))


query(
    "opt_max_sharpe",
    f"WITH {RETS}, c0 AS (SELECT strategy_id AS universe, symbol, c::INTEGER AS candidate, 1.0::DOUBLE + CAST(regexp_extract(symbol, '[0-9]+') AS INTEGER) * c % 23 AS w FROM members CROSS JOIN range(20) t(c)), cand AS MATERIALIZED (SELECT universe, symbol, candidate, w / sum(w) OVER (PARTITION BY universe, candidate) AS weight FROM c0), {stats_sql('cand', 'universe, candidate')} "
    + select("universe, candidate", "annual_return; volatility; sharpe_ratio", "FROM stats QUALIFY row_number() OVER (PARTITION BY universe ORDER BY sharpe_ratio DESC, candidate) = 1"),
)(lambda s, d: op.max_sharpe(candidates(s, d), *op.moments(rets(s, d))))
query("opt_max_sharpe_weights")(lambda s, d: op.best_weights(candidates(s, d), *op.moments(rets(s, d))))
query("opt_allocate", f"WITH {BARS}, {MEMBERS} " + select("strategy_id AS universe, symbol", "CASE WHEN symbol = 'Brand#7' THEN 0 ELSE weight * 50000 END AS amount", "FROM members"))(
    lambda s, d: op.allocate(fixed(s, d).where("symbol <> 'Brand#7'"), 50_000.0, fixed(s, d).select("universe", "symbol"))
)

# ML


_models: dict[tuple[str, str], str] = {}


def model(spark, sf_dir):
    """The feature rows, and the model fitted on them: the first query of an application trains and writes it, the others load it."""
    data = ml.dataset(bars(spark, sf_dir))
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _models:
        path = new_folder(spark, "model")
        ml.save(ml.train(data)[0], path)
        _models[key] = path
    return data, ml.load(_models[key])


def ml_train(spark, sf_dir):
    data, fitted = model(spark, sf_dir)
    late = data.where("label is not null and place > 0.8")
    scores = ml.evaluate(fitted, late)
    return late.agg(F.count("*").alias("rows")).select("rows", *[F.lit(v).alias(k) for k, v in scores.items()])


query("ml_train_rf")(ml_train)
query("ml_predict")(lambda s, d: (lambda m: ml.predict(m[1], m[0]))(model(s, d)))
query("ml_importance")(lambda s, d: s.createDataFrame(ml.importance(model(s, d)[1]), "feature string, importance double"))

# Alerts


def rules(spark, sf_dir):
    """Eight rules a brand, some inactive."""
    b = bars(spark, sf_dir).groupBy("symbol").agg(F.avg("close").alias("mean"))
    spec = [("price", "above", None), ("price", "below", None), ("pct", "up", 5.0), ("pct", "down", 5.0), ("pct", "any", 1.0), ("volume", "above", 1.2), ("macd", "any", 0.0), ("macd", "golden", 0.0)]
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(kind).alias("kind"), F.lit(way).alias("direction"), F.lit(t).cast("double").alias("threshold")) for i, (kind, way, t) in enumerate(spec)])
    k = F.regexp_extract("symbol", "[0-9]+", 0).cast("int")
    return b.select("symbol", "mean", F.inline(each)).select((k * 10 + F.col("i")).alias("rule_id"), "symbol", "kind", "direction", F.coalesce("threshold", "mean").alias("threshold"), ((k + F.col("i")) % 6 != 0).alias("active"))


ALERTS = f"""{IND}, l0 AS (SELECT *, {lag('close')} AS prior, {lag('macd')} AS m1, {lag('macd_signal')} AS s1, avg(volume) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING) AS mean19, count(*) OVER (PARTITION BY symbol) AS n, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back FROM ind),
 spec(i, kind, direction, t) AS (VALUES (0, 'price', 'above', NULL), (1, 'price', 'below', NULL), (2, 'pct', 'up', 5.0), (3, 'pct', 'down', 5.0), (4, 'pct', 'any', 1.0), (5, 'volume', 'above', 1.2), (6, 'macd', 'any', 0.0), (7, 'macd', 'golden', 0.0)),
 rules AS (SELECT k * 10 + i AS rule_id, symbol, kind, direction, coalesce(t::DOUBLE, mean) AS threshold FROM (SELECT symbol, avg(close) AS mean, CAST(regexp_extract(symbol, '[0-9]+') AS INTEGER) AS k FROM bars GROUP BY symbol) CROSS JOIN spec WHERE (k + i) % 6 <> 0),
 j AS (SELECT *, (close / prior - 1) * 100 AS x, volume / mean19 AS v, m1 <= s1 AND macd > macd_signal AS golden, m1 >= s1 AND macd < macd_signal AS death FROM rules JOIN (SELECT * FROM l0 WHERE back = 1 AND n >= 2) USING (symbol)),
 alerts AS (SELECT rule_id, symbol, date, kind, CASE kind WHEN 'price' THEN 'warning' WHEN 'pct' THEN CASE WHEN abs(x) >= 10 THEN 'critical' ELSE 'warning' END WHEN 'volume' THEN 'info' ELSE CASE WHEN golden THEN 'info' ELSE 'warning' END END AS severity,
 CASE kind WHEN 'price' THEN close WHEN 'pct' THEN x WHEN 'volume' THEN v ELSE macd - macd_signal END AS value FROM j WHERE CASE kind WHEN 'price' THEN (direction = 'above' AND close > threshold) OR (direction = 'below' AND close < threshold)
 WHEN 'pct' THEN (direction = 'up' AND x >= threshold) OR (direction = 'down' AND x <= -threshold) OR (direction = 'any' AND abs(x) >= threshold) WHEN 'volume' THEN n >= 20 AND v > threshold ELSE (golden AND direction IN ('golden', 'any')) OR (death AND direction IN ('death', 'any')) END)"""
_AL = ("rule_id, symbol, date, kind, severity", "value")
query("alert_all", f"{ALERTS} " + select(*_AL, "FROM alerts"))(lambda s, d: al.every(rules(s, d), bars(s, d)))
for _name, _kind, _f in (("alert_price", "price", al.price), ("alert_pct", "pct", al.pct), ("alert_volume", "volume", al.volume), ("alert_macd_cross", "macd", al.macd_cross)):
    query(_name, f"{ALERTS} " + select(*_AL, f"FROM alerts WHERE kind = '{_kind}'"))(lambda s, d, f=_f: f(rules(s, d), al.latest(bars(s, d))))


def ticks(spark, sf_dir, live=False):
    """Events as ticks, as a table or as a stream of its files."""
    e = table(spark, sf_dir, "events")
    if live:
        e = spark.readStream.schema(e.schema).parquet(f"{sf_dir}/events.parquet*")  # a file or a folder
    return e.select(F.col("event_id").alias("tick_id"), F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), (F.col("user_id") % 50).cast("double").alias("volume"))


def live(spark, sf_dir, step, mode="append"):
    """What a stream over the events has written when it has seen them all, with the epoch of each row."""
    path = new_folder(spark, "stream")
    sm.run_once(step(ticks(spark, sf_dir, live=True)), path, mode)
    return spark.read.parquet(f"{path}/out")


def live_bars(spark, sf_dir):
    """A window's last update."""
    out = live(spark, sf_dir, sm.bars, "update")
    values = [c for c in out.columns if c not in ("symbol", "start", "epoch")]
    return out.groupBy("symbol", "start").agg(F.max_by(F.struct(*values), "epoch").alias("v")).select("symbol", "start", "v.*")


query("stream_bars", "SELECT event_type AS symbol, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, " + select("", "first(value ORDER BY ts, event_id) AS open; max(value) AS high; min(value) AS low; last(value ORDER BY ts, event_id) AS close; sum(user_id % 50) AS volume", "")[7:] + " FROM events GROUP BY event_type, date_trunc('hour', ts)")(
    lambda s, d: sm.bars(ticks(s, d))
)
query("stream_dedupe", "SELECT event_type AS symbol, count(*) AS n FROM events GROUP BY 1")(lambda s, d: sm.dedupe(ticks(s, d).union(ticks(s, d))).groupBy("symbol").agg(F.count("*").alias("n")))
query(
    "stream_alerts",
    """WITH t AS (SELECT event_id, event_type AS symbol, CAST(ts AS TIMESTAMP) AS ts, value AS price, user_id % 50 AS volume, lag(value) OVER w AS prior, avg(user_id % 50) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING) AS mean19, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)) """
    + select("symbol, ts, 'pct' AS kind", "(price / prior - 1) * 100 AS value", "FROM t WHERE prior <> 0 AND abs(price / prior - 1) >= 0.1")
    + " UNION ALL "
    + select("symbol, ts, 'volume' AS kind", "volume / mean19 AS value", "FROM t WHERE rn > 19 AND mean19 > 0 AND volume / mean19 > 3"),
)(lambda s, d: sm.alerts(ticks(s, d)))

# The same as real streams, and the table that alerts are written to
query("stream_bars_live", ORACLES["stream_bars"])(live_bars)
query("stream_dedupe_live", ORACLES["stream_dedupe"])(lambda s, d: live(s, d, lambda t: sm.dedupe(t.union(t))).groupBy("symbol").agg(F.count("*").alias("n")))


HOUR = 60 * sm.MINUTE_US


def ended(spark, sf_dir, step, source=None, delay="2 hours", span="1 hour"):
    """What a stream of ticks has written when its session has ended: a run over the ticks, then one from its checkpoint over the closing row."""
    path = new_folder(spark, "stream")
    given = source(True) if source else ticks(spark, sf_dir, live=True)
    last = (source(False) if source else ticks(spark, sf_dir)).agg((F.max("ts") + F.expr(f"INTERVAL {delay}") + F.expr(f"INTERVAL {span}")).alias("ts"))
    closing = last.select(F.lit(sm.CLOSING).cast("long").alias("tick_id"), F.lit("session").alias("symbol"), "ts", *[F.lit(None).cast("double").alias(c) for c in ("price", "volume")])
    closing.where("false").write.parquet(f"{path}/closing")
    stream = step(given.unionByName(spark.readStream.schema(closing.schema).parquet(f"{path}/closing")))
    sm.run_once(stream, path)
    closing.write.mode("append").parquet(f"{path}/closing")
    sm.run_once(stream, path)
    return spark.read.parquet(f"{path}/out").drop("epoch")


query("stream_alerts_live", ORACLES["stream_alerts"])(lambda s, d: ended(s, d, lambda t: sm.alerts(t, delay="2 hours", span=HOUR)))


def tick_rules(spark, sf_dir):
    """Eight rules a kind of event, some inactive."""
    b = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("symbol")).agg(F.avg("value").alias("mean"))
    spec = [("price", "above", None), ("price", "below", None), ("pct", "up", 900.0), ("pct", "down", 90.0), ("pct", "any", 2000.0), ("volume", "above", 1.9), ("macd", "death", 0.0), ("macd", "golden", 0.0)]
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("kind"), F.lit(x).alias("direction"), F.lit(t).cast("double").alias("threshold")) for i, (k, x, t) in enumerate(spec)])
    return b.select("symbol", "mean", F.inline(each)).select((F.length("symbol") * 10 + F.col("i")).alias("rule_id"), "symbol", "kind", "direction", F.coalesce("threshold", F.col("mean") * F.when(F.col("direction") == "above", 1.9).otherwise(0.1)).alias("threshold"), ((F.length("symbol") + F.col("i")) % 5 != 0).alias("active"))


TICK_RULES = """WITH RECURSIVE t AS MATERIALIZED (SELECT event_type AS symbol, CAST(ts AS TIMESTAMP) AS date, event_id, value AS close, CAST(user_id % 50 AS DOUBLE) AS volume, row_number() OVER w AS rn, lag(value) OVER w AS before,
  avg(user_id % 50) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING) AS mean19 FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
 e AS (SELECT symbol, rn, close AS f, close AS s, 0.0::DOUBLE AS g FROM t WHERE rn = 1
  UNION ALL SELECT t.symbol, t.rn, e.f + 2.0::DOUBLE / 13 * (t.close - e.f), e.s + 2.0::DOUBLE / 27 * (t.close - e.s), e.g + 0.2::DOUBLE * ((e.f + 2.0::DOUBLE / 13 * (t.close - e.f)) - (e.s + 2.0::DOUBLE / 27 * (t.close - e.s)) - e.g) FROM e JOIN t ON t.symbol = e.symbol AND t.rn = e.rn + 1),
 st AS (SELECT t.*, f - s AS macd, g AS sig, lag(f - s) OVER w AS m1, lag(g) OVER w AS s1 FROM t JOIN e USING (symbol, rn) WINDOW w AS (PARTITION BY symbol ORDER BY rn)),
 spec(i, kind, direction, th) AS (VALUES (0, 'price', 'above', NULL), (1, 'price', 'below', NULL), (2, 'pct', 'up', 900.0), (3, 'pct', 'down', 90.0), (4, 'pct', 'any', 2000.0), (5, 'volume', 'above', 1.9), (6, 'macd', 'death', 0.0), (7, 'macd', 'golden', 0.0)),
 rules AS (SELECT length(symbol) * 10 + i AS rule_id, symbol, kind, direction, coalesce(th::DOUBLE, mean * CASE WHEN direction = 'above' THEN 1.9::DOUBLE ELSE 0.1::DOUBLE END) AS threshold FROM (SELECT event_type AS symbol, avg(value) AS mean FROM events GROUP BY 1) CROSS JOIN spec WHERE (length(symbol) + i) % 5 <> 0),
 j AS (SELECT *, (close / before - 1) * 100 AS x, volume / mean19 AS v, m1 <= s1 AND macd > sig AS golden, m1 >= s1 AND macd < sig AS death FROM rules JOIN st USING (symbol) WHERE rn >= 2),
 alerts AS (SELECT rule_id, symbol, date, kind, CASE kind WHEN 'price' THEN 'warning' WHEN 'pct' THEN CASE WHEN abs(x) >= 10 THEN 'critical' ELSE 'warning' END WHEN 'volume' THEN 'info' ELSE CASE WHEN golden THEN 'info' ELSE 'warning' END END AS severity,
  CASE kind WHEN 'price' THEN close WHEN 'pct' THEN x WHEN 'volume' THEN v ELSE macd - sig END AS value FROM j WHERE CASE kind WHEN 'price' THEN (direction = 'above' AND close > threshold) OR (direction = 'below' AND close < threshold)
  WHEN 'pct' THEN (direction = 'up' AND x >= threshold) OR (direction = 'down' AND x <= -threshold) OR (direction = 'any' AND abs(x) >= threshold) WHEN 'volume' THEN rn >= 20 AND mean19 > 0 AND v > threshold ELSE (golden AND direction IN ('golden', 'any')) OR (death AND direction IN ('death', 'any')) END) """
query("stream_rules", TICK_RULES + select(*_AL, "FROM alerts"))(lambda s, d: al.fired(tick_rules(s, d), sm.states(ticks(s, d))))
query("stream_rules_live", ORACLES["stream_rules"])(lambda s, d: ended(s, d, lambda t: al.fired(tick_rules(s, d), sm.states(t, span=HOUR))))


def bars_as_ticks(spark, sf_dir, path):
    """Daily bars as ticks, written in a few files that need not be in order; as a stream one file is a batch."""
    day = F.col("date").cast("timestamp")
    rows = bars(spark, sf_dir).select(F.datediff("date", F.lit("1970-01-01")).cast("long").alias("tick_id"), "symbol", day.alias("ts"), F.col("close").alias("price"), F.col("volume").cast("double").alias("volume"))
    rows.repartitionByRange(2, "ts").write.parquet(path)
    return lambda live: (spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path) if live else spark.read.parquet(path))


def live_rules(spark, sf_dir):
    """Alerts of a stream of daily bars on each symbol's last bar."""
    source = bars_as_ticks(spark, sf_dir, f"{new_folder(spark, 'bars')}/rows")
    known = rules(spark, sf_dir)
    found = ended(spark, sf_dir, lambda t: al.fired(known, sm.states(t, "3650 days", 31 * 24 * HOUR)), source, "3650 days", "31 days")
    last = source(False).groupBy("symbol").agg(F.to_date(F.max("ts")).alias("date"))
    return found.withColumn("date", F.to_date("date")).join(last, ["symbol", "date"]).select("rule_id", "symbol", "date", "kind", "severity", "value")


query("alert_all_live", ORACLES["alert_all"])(live_rules)
_HISTORY = ALERTS.replace("back = 1 AND n >= 2", "rn >= 2").replace("WHEN 'volume' THEN n >= 20", "WHEN 'volume' THEN rn >= 20")
query("alert_history", f"{_HISTORY} " + select(*_AL, "FROM alerts"))(lambda s, d: al.history(rules(s, d), bars(s, d)))


def sent_alerts(spark, sf_dir):
    """Alerts that the sink has taken, one batch twice."""
    path, found = new_folder(spark, "alerts"), sm.alerts(ticks(spark, sf_dir))
    send = sm.sink(path)
    for epoch, kind in enumerate(("pct", "volume", "pct")):
        send(found.where(F.col("kind") == kind), epoch % 2)
    return spark.read.parquet(path).where("sent_at is not null").select("symbol", "ts", "kind", "value")


query("alert_sink", ORACLES["stream_alerts"])(sent_alerts)

# Text: a lexicon of words that the invented documents hold

LEXICON = {"thing": 1, "attion": 1, "thble": 1, "inoran": -1, "ononst": -1, "erble": -1}
STOP = ("the", "of", "and", "to", "in", "de", "la", "der", "die")


def lexicon(spark):
    return spark.createDataFrame(list(LEXICON.items()), "word string, polarity int")


def posts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("post_id"), "source", "text")


def scored(spark, sf_dir):
    return posts(spark, sf_dir).select("post_id", F.col("source").alias("platform")).join(tx.sentiment(posts(spark, sf_dir), lexicon(spark)), "post_id")


_LABEL = "CASE WHEN score > 0.6 THEN 'positive' WHEN score < 0.4 THEN 'negative' ELSE 'neutral' END AS label"
_TOKENS = "regexp_extract_all(lower(text), '[a-zà-ÿ]+')"
SENT = f"""lx(word, polarity) AS (VALUES {', '.join(f"('{w}', {p})" for w, p in LEXICON.items())}), tk AS MATERIALIZED (SELECT doc_id, source, unnest({_TOKENS}) AS word FROM documents),
 hit AS (SELECT doc_id, count(*) FILTER (polarity > 0) AS p, count(*) FILTER (polarity < 0) AS n FROM tk JOIN lx USING (word) GROUP BY 1),
 ps AS MATERIALIZED (SELECT d.doc_id AS post_id, source AS platform, coalesce(p, 0) AS positive, coalesce(n, 0) AS negative, CASE WHEN coalesce(p, 0) + coalesce(n, 0) > 0 THEN p / (p + n) ELSE 0.5 END AS score FROM documents d LEFT JOIN hit USING (doc_id)),
 pl AS (SELECT platform, count(*) AS posts, count(*) FILTER (score > 0.6) AS positive, count(*) FILTER (score < 0.4) AS negative FROM ps GROUP BY 1),
 pf AS (SELECT *, posts - positive - negative AS neutral, CASE WHEN positive + negative > 0 THEN positive / (positive + negative) ELSE 0.5 END AS score FROM pl)"""
query("text_sentiment", f"WITH {SENT} " + select(f"post_id, positive, negative, {_LABEL}", "score", "FROM ps"))(lambda s, d: tx.sentiment(posts(s, d), lexicon(s)))
query("sentiment_platform", f"WITH {SENT} " + select(f"platform, posts, positive, negative, neutral, {_LABEL}", "score", "FROM pf"))(lambda s, d: tx.by_platform(scored(s, d)))
query("sentiment_combined", f"WITH {SENT}, c AS (SELECT sum(posts)::BIGINT AS posts, sum(positive)::BIGINT AS positive, sum(negative)::BIGINT AS negative, sum(score * w) / sum(w) AS score FROM (SELECT *, CASE platform WHEN 'src0' THEN 0.35 WHEN 'src1' THEN 0.35 ELSE 0.3 END::DOUBLE AS w FROM pf)) " + select(f"posts, positive, negative, {_LABEL}", "score", "FROM c"))(
    lambda s, d: tx.combined(tx.by_platform(scored(s, d)), {"src0": 0.35, "src1": 0.35})
)


def top_words(spark, sf_dir):
    stop = spark.createDataFrame([(w,) for w in STOP], "word string")
    return tx.keywords(table(spark, sf_dir, "documents").select(F.col("source").alias("platform"), F.col("doc_id").alias("seq"), "text"), stop)


KEYS = f"""ko AS (SELECT source AS platform, doc_id, unnest(list_filter({_TOKENS}, lambda t: length(t) > 1)) AS word, generate_subscripts(list_filter({_TOKENS}, lambda t: length(t) > 1), 1) AS pos FROM documents),
 kc AS (SELECT platform, word, count(*) AS n, min((doc_id, pos)) AS f FROM ko WHERE word NOT IN ({', '.join(f"'{w}'" for w in STOP)}) GROUP BY 1, 2),
 kt AS MATERIALIZED (SELECT platform, word, n, CAST(row_number() OVER (PARTITION BY platform ORDER BY n DESC, f) AS INTEGER) AS rank FROM kc QUALIFY row_number() OVER (PARTITION BY platform ORDER BY n DESC, f) <= 10)"""
query("keywords_top", f"WITH {KEYS} SELECT platform, word, n, rank FROM kt")(top_words)
query("keywords_merge", f"WITH {KEYS} SELECT word, sum(n)::BIGINT AS n FROM kt GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")(lambda s, d: tx.merge_keywords(top_words(s, d)))

#: Message endings, dealt to the users' messages by number, so that every rule meets rows.
ENDINGS = ("回测 600519.SS 均线交叉 本金5万", "portfolio: 100股AAPL成本150, 20股苹果公司", "market overview", "优化 AAPL,TSLA 目标收益10%", "分析贵州茅台", "持仓 TSLA 50股, 特斯拉 10 shares at 170", "batch everything API 005930.KS", "RSI capital 2000")


def messages(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    k = (F.col("conv_id") * 10 + F.col("turn")).alias("message_id")
    ending = F.get(F.array(*[F.lit(x) for x in ENDINGS]), (F.col("conv_id") % len(ENDINGS)).cast("int"))
    return c.select(k, "conv_id", F.concat(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-zà-ÿ ]", ""), F.lit(" "), ending).alias("text"))


_WANT = ("backtest", "portfolio", "market", "optimize", "analyze_single", "portfolio", "analyze_batch", "analyze_single")
query("utterance_intent", "SELECT conv_id * 10 + turn AS message_id, CASE conv_id % 8 " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(_WANT)) + " END AS intent FROM conversations WHERE role = 'user'")(lambda s, d: tx.intent(messages(s, d)).select("message_id", "intent"))


def names(spark):
    return spark.createDataFrame([("贵州茅台", "600519.SS"), ("苹果", "AAPL"), ("特斯拉", "TSLA")], "name string, symbol string")


query(
    "utterance_entities",
    "SELECT conv_id * 10 + turn AS message_id, CASE conv_id % 8 WHEN 0 THEN '600519.SS' WHEN 1 THEN 'AAPL' WHEN 3 THEN 'AAPL,TSLA' WHEN 4 THEN '600519.SS' WHEN 5 THEN 'TSLA' WHEN 6 THEN '005930.KS' WHEN 7 THEN 'RSI' ELSE '' END AS symbols, CASE conv_id % 8 WHEN 0 THEN 'sma_cross' WHEN 7 THEN 'rsi' ELSE 'buy_hold' END AS strategy, "
    + select("", "CASE conv_id % 8 WHEN 0 THEN 50000 WHEN 7 THEN 2000 ELSE 100000 END AS capital; CASE conv_id % 8 WHEN 3 THEN 0.1 END AS target_return", "")[7:]
    + ", CASE conv_id % 8 WHEN 1 THEN 'AAPL:100:150,AAPL:20:0' WHEN 5 THEN 'TSLA:50:0,TSLA:10:170' ELSE '' END AS holdings FROM conversations WHERE role = 'user'",
)(lambda s, d: tx.entities(messages(s, d), names(s)))

# Review: warnings are made from events


def warnings(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    words = F.array(*[F.lit(x) for x in ("Benchmark missing", "Macro data empty", "Universe is fixed", "cash_weight high", "Fundamental report late", "disk slow", "")])
    k = F.col("event_id")
    return e.select((k % 20).alias("run_id"), k.alias("seq"), F.element_at(words, (k % 7 + 1).cast("int")).alias("message"), F.when(k % 11 == 0, "fatal").otherwise("warning").alias("severity"), F.when(k % 13 == 0, "bad source").otherwise(F.col("event_type")).alias("source"),
        F.element_at(F.array(*map(F.lit, (*rv.SCOPES, "elsewhere"))), (k % 8 + 1).cast("int")).alias("scope"), F.when(k % 3 == 0, F.array(F.lit("metrics.json"), F.element_at(F.array(*map(F.lit, REFERENCES)), (k % len(REFERENCES) + 1).cast("int")))).alias("artifact_refs"))


#: Artifacts that warnings name; the first three are well formed.
REFERENCES = ("holdings.parquet#/rows/3", "warnings.json#", "trades.parquet", "../metrics.json", "other.json", "metrics.json#rows")


WARN = """w AS MATERIALIZED (SELECT event_id % 20 AS run_id, event_id AS seq, list_extract(['Benchmark missing', 'Macro data empty', 'Universe is fixed', 'cash_weight high', 'Fundamental report late', 'disk slow', ''], event_id % 7 + 1) AS message,
 list_extract(['benchmark', 'macro_data', 'universe_bias', 'portfolio_constraints', 'fundamental_data', 'system', 'system'], event_id % 7 + 1) AS category, event_id % 11 = 0 AS fatal, event_id % 13 = 0 AS odd, list_extract(['price_provider', 'benchmark', 'fundamental', 'macro', 'universe', 'factor', 'portfolio', NULL], event_id % 8 + 1) AS scope,
 event_id % 3 = 0 AND event_id % 6 >= 3 AS broken FROM events),
 checked AS MATERIALIZED (SELECT *, CASE WHEN fatal THEN 'invalid_severity' WHEN scope IS NULL THEN 'invalid_scope' WHEN message = '' THEN 'empty_message' WHEN odd THEN 'invalid_source' WHEN broken THEN 'invalid_artifact_reference' END AS reason FROM w)"""
query("warnings_dedupe", f"WITH {WARN} SELECT run_id, message, min(seq) AS seq FROM w GROUP BY 1, 2")(lambda s, d: rv.dedupe(warnings(s, d)))
query("warnings_category", f"WITH {WARN} SELECT run_id, seq, category FROM w")(lambda s, d: rv.categorize(warnings(s, d)).select("run_id", "seq", "category"))
query("warnings_summary", f"WITH {WARN}, k AS (SELECT *, row_number() OVER (PARTITION BY run_id, category ORDER BY seq) AS r FROM w) SELECT run_id, category, count(*) AS total, string_agg(message, ' | ' ORDER BY seq) FILTER (r <= 3) AS samples, count(*) > 3 AS truncated FROM k GROUP BY 1, 2")(lambda s, d: rv.summarize(rv.categorize(warnings(s, d))))
_NAMES = ", ".join(f"('{d}', '{v}')" for d, values in (("category", (*rv.CATEGORIES, "system")), ("severity", rv.SEVERITIES), ("scope", rv.SCOPES)) for v in values)
query(
    "warnings_totals",
    f"""WITH {WARN}, names(dimension, value) AS (VALUES {_NAMES}), seen AS (SELECT run_id, 'category' AS dimension, category AS value FROM w UNION ALL SELECT run_id, 'severity', 'warning' FROM checked WHERE reason IS NULL UNION ALL SELECT run_id, 'scope', scope FROM checked WHERE reason IS NULL)
 SELECT r.run_id, n.dimension, n.value, count(s.value) AS total FROM (SELECT DISTINCT run_id FROM w) r CROSS JOIN names n LEFT JOIN seen s ON s.run_id = r.run_id AND s.dimension = n.dimension AND s.value = n.value GROUP BY ALL""",
)(lambda s, d: rv.totals(rv.validate(rv.categorize(warnings(s, d)))))
query("warnings_validate", f"WITH {WARN} SELECT run_id, seq, reason FROM checked")(lambda s, d: rv.validate(warnings(s, d)).select("run_id", "seq", "reason"))
query("runs_list", "SELECT o_orderkey AS run_id, CAST(o_orderdate AS TIMESTAMP) AS run_time, o_orderstatus AS status FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")(lambda s, d: rv.runs(table(s, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("run_time"), F.col("o_orderstatus").alias("status"))))
query("numeric_summary", f"WITH {BARS} " + select("symbol, count(close) AS count", "min(close) AS min; avg(close) AS mean; max(close) AS max", "FROM bars GROUP BY symbol"))(lambda s, d: rv.numeric_summary(bars(s, d), "close", "symbol"))


def held(spark, sf_dir):
    """The schedule as holdings, cash being what the weights leave."""
    w = schedule(spark, sf_dir).withColumnRenamed("strategy_id", "run_id")
    cash = w.groupBy("run_id", "date").agg((1 - F.sum("weight")).alias("cash_weight"))
    return w.join(cash, ["run_id", "date"])


HELD = f"{GRID}, sd AS (SELECT strategy_id, min(date) AS date FROM (SELECT DISTINCT strategy_id, date FROM grid) GROUP BY 1, date_trunc('quarter', date)), held AS MATERIALIZED (SELECT strategy_id AS run_id, date, symbol, weight, 1 - sum(weight) OVER (PARTITION BY strategy_id, date) AS cash_weight FROM sd JOIN members USING (strategy_id))"
query(
    "holdings_evidence",
    f"WITH {HELD}, d AS (SELECT run_id, date, count(*) AS n, max(cash_weight) AS cash FROM held GROUP BY 1, 2) " + select("run_id, count(*) AS rebalances, max(date) AS latest, arg_max(n, date) AS latest_holdings", "arg_max(cash, date) AS latest_cash; min(cash) AS least_cash; max(cash) AS most_cash", "FROM d GROUP BY run_id"),
)(lambda s, d: rv.holdings_evidence(held(s, d)))
query("factor_evidence", f"WITH {HELD} " + select("run_id, count(*) AS rows, count(DISTINCT symbol) AS symbols, max(date) AS latest, count(*) FILTER (weight > 0.18) AS selected", "min(weight * 100) AS least; max(weight * 100) AS most", "FROM held GROUP BY run_id"))(
    lambda s, d: rv.factor_evidence(held(s, d).select("run_id", "symbol", "date", (F.col("weight") > 0.18).alias("selected"), (F.col("weight") * 100).alias("score")))
)
query("trade_evidence", f"WITH RECURSIVE {FOLD} " + select("strategy_id AS run_id, count(*) AS trades, count(*) FILTER (side = 'buy') AS buys, count(*) FILTER (side = 'sell') AS sells, max(date) AS latest", f"sum(value) AS value; sum(value * CASE side WHEN 'sell' THEN {_SELL} ELSE {_BUY} END) AS cost", "FROM trades GROUP BY 1"))(
    lambda s, d: rv.trade_evidence(trades(folded(s, d)).withColumnRenamed("strategy_id", "run_id"))
)
query("holdings_long", f"WITH {HELD} " + select("run_id, date, symbol", "weight", "FROM held"))(
    lambda s, d: rv.holdings_long(held(s, d).groupBy("run_id", "date").pivot("symbol", [f"Brand#{i}" for i in range(1, 26)]).agg(F.max("weight")), ("run_id", "date"))
)
query("run_rows_latest", f"WITH {HELD} " + select("run_id, date, symbol, CAST(rank AS INTEGER) AS rank", "weight", "FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY date DESC, symbol) AS rank FROM held) WHERE rank <= 7"))(lambda s, d: rv.latest_rows(held(s, d).drop("cash_weight"), 7, "symbol"))
query(
    "curve_downsample",
    f"""WITH {EQUITY}, n AS (SELECT *, row_number() OVER ({SID}) - 1 AS i, count(*) OVER (PARTITION BY strategy_id) AS n FROM equity), p AS (SELECT DISTINCT strategy_id, CAST(round_even(k * (n - 1) / 49.0::DOUBLE, 0) AS BIGINT) AS i FROM n CROSS JOIN range(50) t(k)) """
    + select("strategy_id, date", "equity", "FROM n JOIN p USING (strategy_id, i)"),
)(lambda s, d: rv.downsample(equity(s, d), 50))


def flagged(spark, sf_dir):
    from ..operators.quality import run_status

    c = run_tables(spark, sf_dir)
    status = run_status(c, 3).select("run_id", F.col("status").alias("run_status"))
    return c.join(status, "run_id").withColumns({"warning_count": F.col("run_id") * 40, "reported_warning_count": F.when(F.col("run_id") == 2, 1).otherwise(F.col("run_id") * 40)})


query(
    "risk_flags",
    f"""WITH {COVERAGE}, w AS (SELECT *, run_id * 40 AS n, CASE WHEN run_id = 2 THEN 1 ELSE run_id * 40 END AS reported FROM runs)
 SELECT run_id, 'run_not_complete' AS code, CASE WHEN status = 'failed' THEN 'high' ELSE 'medium' END AS severity FROM w WHERE status <> 'success' UNION ALL SELECT run_id, 'benchmark_not_available', 'medium' FROM w WHERE benchmark_status <> 'available'
 UNION ALL SELECT run_id, 'persisted_warnings', CASE WHEN n >= 100 THEN 'high' ELSE 'medium' END FROM w WHERE n > 0 UNION ALL SELECT run_id, 'warning_count_mismatch', 'medium' FROM w WHERE n <> reported
 UNION ALL SELECT run_id, 'incomplete_price_coverage', CASE WHEN price_coverage_ratio < 0.5 THEN 'high' ELSE 'medium' END FROM w WHERE price_coverage_ratio < 1 UNION ALL SELECT run_id, 'macro_neutral_fallback', 'medium' FROM w WHERE macro_observations = 0
 UNION ALL SELECT run_id, 'holdings_below_minimum', 'medium' FROM w WHERE least_holdings < 3 UNION ALL SELECT run_id, 'insufficient_factor_coverage', 'medium' FROM w WHERE least_factor_coverage < 0.8""",
)(lambda s, d: rv.risk_flags(flagged(s, d)))


def run_metrics(spark, sf_dir):
    h = held(spark, sf_dir).groupBy("run_id").agg(F.max("weight").alias("top_weight"), F.max("cash_weight").alias("cash_weight"))
    return h.withColumns({"max_drawdown": F.when(F.col("run_id") < 4, F.col("run_id") * -0.15), "warning_count": F.col("run_id") % 2})


query(
    "risk_flags_metrics",
    f"""WITH {HELD}, m AS (SELECT run_id, max(weight) AS top, max(cash_weight) AS cash, run_id * -0.15 AS d FROM held GROUP BY run_id) SELECT run_id, 'drawdown' AS category, CASE WHEN d <= -0.35 THEN 'high' WHEN d <= -0.2 THEN 'medium' ELSE 'low' END AS severity FROM m WHERE run_id < 4
 UNION ALL SELECT run_id, 'concentration', CASE WHEN top >= 0.12 THEN 'medium' ELSE 'low' END FROM m UNION ALL SELECT run_id, 'cash_weight', 'medium' FROM m WHERE cash >= 0.3 UNION ALL SELECT run_id, 'pipeline_warnings', 'medium' FROM m WHERE run_id % 2 = 1""",
)(lambda s, d: rv.metric_flags(run_metrics(s, d)))
query("run_consistency", f"WITH {HELD} SELECT run_id, bool_and(t <= 1 + 1e-9) AS weights_ok, run_id <> 2 AS selected_ok, true AS curve_ok FROM (SELECT run_id, date, sum(weight) AS t FROM held GROUP BY 1, 2) GROUP BY 1")(
    lambda s, d: rv.consistency(held(s, d).where("not (run_id = 2 and symbol = 'Brand#11')"), held(s, d).select("run_id", "date", "symbol"), grid(s, d).select(F.col("strategy_id").alias("run_id"), "date").distinct())
)
