"""Normalising raw tables into the library's schemas: aliases, coercion, identifiers, windows, and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of the bar schema and the names that sources use for them (fixed values).
BAR_ALIASES = {
    "date": ("date", "日期", "trade_date"),
    "open": ("open", "Open", "开盘"),
    "high": ("high", "High", "最高"),
    "low": ("low", "Low", "最低"),
    "close": ("close", "Close", "收盘"),
    "volume": ("volume", "Volume", "成交量"),
    "amount": ("amount", "成交额"),
    "amplitude": ("amplitude", "振幅"),
    "pct_change": ("pct_change", "涨跌幅"),
    "change": ("change", "涨跌额"),
    "turnover": ("turnover", "换手率"),
}
RATIOS = ("dividend_yield", "roe", "gross_margin", "net_margin", "debt_ratio")
#: Days of each look-back name (fixed values); ytd is apart, unknown names mean a year.
PERIODS = {"1d": 1, "5d": 5, "1mo": 30, "3mo": 90, "6mo": 180, "1y": 365, "2y": 730, "5y": 1825, "10y": 3650, "max": 3650}
#: Names and codes of supported indexes (fixed values).
INDEXES = {"沪深300": "000300", "中证500": "000905", "中证1000": "000852", "上证指数": "000001", "深证成指": "399001", "创业板指": "399006"}
CRYPTO = ("USDT", "BUSD", "BTC", "ETH", "USDC")


def first_of(df: DataFrame, names: tuple[str, ...], kind: str) -> Column:
    """The first column of several that is there, coerced; null if none is."""
    found = [F.expr(f"try_cast(`{n}` AS {kind})") for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast(kind)


def normalize_bars(df: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The bar schema: aliases resolved, missing columns null, what cannot be read null, unknown columns dropped."""
    return df.select(*by, *[first_of(df, names, "date" if c == "date" else "double").alias(c) for c, names in BAR_ALIASES.items()])


def normalize_fundamentals(df: DataFrame) -> DataFrame:
    """Ratios above 1 are percentages; point_in_time tells whether a publication date is known."""
    fix = {c: F.when(F.abs(c) <= 1, F.col(c)).otherwise(F.col(c) / 100) for c in RATIOS if c in df.columns}
    return df.withColumns(fix).withColumn("point_in_time", F.col("available_date").isNotNull())


def normalize_symbol(symbol: Column) -> Column:
    """Upper case without exchange suffix."""
    return F.regexp_replace(F.upper(F.trim(symbol)), r"\.(SH|SS|SZ|BJ)$", "")


def exchange(symbol: Column) -> Column:
    s = normalize_symbol(symbol)
    return F.when(s.rlike("^(4|8|92)"), "BJ").when(s.rlike("^[569]"), "SH").otherwise("SZ")


def canonical_index(df: DataFrame, column: str = "symbol") -> DataFrame:
    """Six-digit code of an index name or code; null, with a reason, where it is not supported."""
    key = F.upper(F.regexp_replace(F.trim(column), r"\s+", ""))
    key = F.when(key.rlike("^(SH|SZ)") & (F.length(key) == 8), F.substring(key, 3, 6)).otherwise(key)
    key = F.when(key.rlike(r"\.(SH|SS|SZ)$"), F.split(key, r"\.")[0]).otherwise(key)
    table = df.sparkSession.createDataFrame([(k, v) for k, v in {**INDEXES, **{v: v for v in INDEXES.values()}}.items()], "_key string, canonical string")
    out = df.withColumn("_key", key).join(F.broadcast(table), "_key", "left").drop("_key")  # a fixed table of a dozen rows
    return out.withColumn("reason", F.when(F.col("canonical").isNull(), "unsupported_symbol"))


def asset_class(symbol: Column) -> Column:
    crypto = (F.length(symbol) >= 6) & ~symbol.contains(".") & F.upper(symbol).rlike(f"({'|'.join(CRYPTO)})$")
    return F.when(crypto, "crypto").otherwise("stock")


def period_filter(bars: DataFrame, period: str, as_of: str) -> DataFrame:
    end = F.lit(as_of).cast("date")
    start = F.trunc(end, "year") if period == "ytd" else F.date_sub(end, PERIODS.get(period, 365))
    return bars.where(F.col("date").between(start, end))


def prepare_prices(df: DataFrame, start: str, end: str) -> DataFrame:
    """Rows of a window with a positive close; of a date's rows the last by ingest ordinal."""
    ok = df.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")) & (F.col("close") > 0))
    w = W.partitionBy("symbol", "date").orderBy(F.desc("ordinal"))
    return ok.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def universe_fixed(spark: SparkSession, symbols: list[str]) -> DataFrame:
    """Trimmed distinct symbols of a fixed list; such a universe is not point in time."""
    return spark.createDataFrame([(s.strip(),) for s in symbols if s.strip()], "symbol string").distinct().withColumn("point_in_time", F.lit(False))


MACRO_FIELDS = ("pmi", "cpi_yoy", "ppi_yoy", "m2_yoy", "social_financing_yoy", "ten_year_yield", "usd_cny", "policy_score", "external_risk_score")


def scan_macro_csv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Macro rows of CSV files with # comments, with or without a header line; what cannot be read is null."""
    fields = ["date", "available_date", *MACRO_FIELDS, "source"]
    raw = spark.read.schema(T.StructType([T.StructField(f, T.StringType()) for f in fields])).option("header", header).option("comment", "#").option("mode", "PERMISSIVE").csv(path)
    return raw.select(*[F.expr(f"try_cast(trim({c}) AS {'date' if c.endswith('date') else 'double'})").alias(c) if c != "source" else F.col(c) for c in fields])


def latest(df: DataFrame, by: str = "date") -> DataFrame:
    """The last row; no row if there is none."""
    values = [c for c in df.columns if c != by]
    return df.agg(F.max_by(F.struct(by, *values), by).alias("v")).where("v is not null").select("v.*")


def rollup(bars: DataFrame, unit: str) -> DataFrame:
    """Bars of a longer interval: first open, highest high, lowest low, last close, sums."""
    period = F.to_date(F.date_trunc(unit, "date")).alias("period")
    return bars.groupBy("symbol", period).agg(F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "date").alias("close"), F.sum("volume").alias("volume"))


def write_bars(bars: DataFrame, path: str, adjust: str, buckets: int = 64) -> None:
    """Bars partitioned by adjustment and symbol bucket, so that a symbol's reads are pruned to one bucket."""
    bars.withColumns({"adjust": F.lit(adjust), "symbol_bucket": F.pmod(F.xxhash64("symbol"), F.lit(buckets)).cast("int")}).repartition("symbol_bucket").sortWithinPartitions("symbol", "date").write.mode("overwrite").partitionBy("adjust", "symbol_bucket").parquet(path)


def scan_bars(spark: SparkSession, path: str, adjust: str, symbols: list[str] | None = None, buckets: int = 64) -> DataFrame:
    df = spark.read.parquet(path).where(F.col("adjust") == adjust)
    if symbols:
        wanted = reduce(lambda a, b: a | b, (F.col("symbol_bucket") == F.pmod(F.xxhash64(F.lit(s)), F.lit(buckets)).cast("int") for s in symbols))
        df = df.where(wanted & F.col("symbol").isin(symbols))
    return df.drop("adjust", "symbol_bucket")


def save_bars(bars: DataFrame, name: str, path: str, by: str = "market", buckets: int = 16) -> None:
    """Bars as a table in ``path``, partitioned by ``by`` and bucketed by symbol in order of date: windows and joins by symbol read it without a shuffle,
    and a join with a universe that names ``by`` reads its partitions only."""
    bars.repartition(buckets, "symbol").write.mode("overwrite").partitionBy(by).bucketBy(buckets, "symbol").sortBy("symbol", "date").option("path", path).saveAsTable(name)


def of_universe(spark: SparkSession, name: str, universe: DataFrame, by: str = "market") -> DataFrame:
    """The bars of a universe (symbol, ``by``) from such a table: the join prunes partitions as it runs."""
    return spark.table(name).join(universe, [by, "symbol"], "left_semi")


def write_run(tables: dict[str, DataFrame], path: str, run_id: str) -> None:
    """The tables of a run, partitioned by run_id; an existing run is refused.

    A run is claimed by making a file that must not be there, which one job only can do; a job that fails takes back its claim and what it wrote.
    """
    spark = next(iter(tables.values())).sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path
    claim = at(f"{path}/_runs/{run_id}")
    store = claim.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(claim.getParent())
    parts = [at(f"{path}/{name}/run_id={run_id}") for name in tables]
    if not store.createNewFile(claim):
        raise FileExistsError(f"run {run_id} exists")
    try:
        for name, df in tables.items():
            df.write.mode("errorifexists").parquet(f"{path}/{name}/run_id={run_id}")
    except Exception:
        for p in (*parts, claim):
            store.delete(p, True)
        raise


def select_source(quality: DataFrame, priority: DataFrame, data: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of each symbol the rows of the first source, by priority, whose quality reason is success; and every attempt.

    quality: (symbol, source, reason); priority: (source, priority); data: (symbol, source, ...).
    """
    attempts = quality.join(priority, "source")
    w = W.partitionBy("symbol").orderBy("priority")
    ranked = attempts.withColumn("chosen", F.when(F.col("reason") == "success", F.row_number().over(W.partitionBy("symbol", F.col("reason") == "success").orderBy("priority")) == 1).otherwise(False)).withColumn("attempt", F.row_number().over(w))
    return data.join(ranked.where("chosen").select("symbol", "source"), ["symbol", "source"], "left_semi"), ranked
