"""Mean-variance: moments by Spark joins and aggregates, closed forms per group of assets.

Returns are long: (universe, date, symbol, ret). A group (universe, and date for rolling windows) has as many rows as
asset pairs; that is what the grouped Arrow functions see, never the returns.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

YEAR = 252


def returns(prices: DataFrame) -> DataFrame:
    """Changes of (universe, date, symbol, close) on dates where every symbol of the universe has a price."""
    size = prices.groupBy("universe").agg(F.count_distinct("symbol").alias("want"))
    whole = prices.groupBy("universe", "date").agg(F.count_distinct("symbol").alias("have")).join(size, "universe").where("have = want").select("universe", "date")
    w = W.partitionBy("universe", "symbol").orderBy("date")
    df = prices.join(whole, ["universe", "date"]).withColumn("ret", F.col("close") / F.lag("close").over(w) - 1)
    return df.where("ret is not null").select("universe", "date", "symbol", "ret")


def moments(rets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(universe, symbol, mean) and (universe, a, b, cov) of sample covariances: a join on the date, aggregated map-side."""
    means = rets.groupBy("universe", "symbol").agg(F.avg("ret").alias("mean"))
    other = rets.select("universe", "date", F.col("symbol").alias("b"), F.col("ret").alias("rb"))
    cov = rets.withColumnRenamed("symbol", "a").join(other, ["universe", "date"]).groupBy("universe", "a", "b").agg(F.covar_samp("ret", "rb").alias("cov"))
    return means, cov


#: Symbols of a vector segment, and dates whose outer products a task sums at a time.
SEGMENT, DATES = 256, 1024


def wide_moments(rets: DataFrame, segment: int = SEGMENT, dates: int = DATES) -> tuple[DataFrame, DataFrame]:
    """The same as ``moments`` for universes of thousands of symbols, as a Gram matrix by blocks.

    A date's centred returns are a vector in segments of ``segment`` symbols. Two segments of a date meet in one row, so a date has
    (symbols / segment) ** 2 / 2 rows instead of symbols ** 2; the outer products of ``dates`` dates are one matrix product in a task, and the
    sums of those are added up block by block. ``rets`` must have every symbol of a universe on every one of its dates, as ``returns`` gives them.
    """
    means = rets.groupBy("universe", "symbol").agg(F.avg("ret").alias("mean"), F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy("universe").orderBy("symbol")) - 1
    placed = means.withColumns({"segment": F.floor(place / segment).cast("int"), "place": (place % segment).cast("int")})
    centred = rets.join(placed, ["universe", "symbol"]).select("universe", "date", "segment", "place", (F.col("ret") - F.col("mean")).alias("x"))
    vectors = centred.groupBy("universe", "date", "segment").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "x"))), lambda v: v["x"]).alias("v"))
    other = vectors.select("universe", "date", F.col("segment").alias("other"), F.col("v").alias("w"))
    met = vectors.join(other, ["universe", "date"]).where("segment <= other")
    count = rets.groupBy("universe").agg(F.count_distinct("date").alias("all"))
    chunk = F.pmod(F.xxhash64("date"), F.ceil(F.col("all") / dates)).cast("int")
    met = met.join(count, "universe").withColumn("chunk", chunk)

    def product(rows: pd.DataFrame) -> pd.DataFrame:
        x, y = np.stack(rows["v"].to_numpy()), np.stack(rows["w"].to_numpy())
        return rows[["universe", "segment", "other"]].head(1).assign(rows=x.shape[1], sums=[(x.T @ y).ravel()])

    keys = ["universe", "segment", "other"]
    parts = met.groupBy(*keys, "chunk").applyInPandas(product, "universe int, segment int, other int, rows int, sums array<double>")
    # A cell's sum over the chunks: of each chunk one row a cell, added before and after a shuffle.
    cells = parts.select(*keys, "rows", F.size("sums").alias("size"), F.posexplode("sums").alias("cell", "sum")).groupBy(*keys, "cell").agg(F.sum("sum").alias("sum"), F.max("rows").alias("rows"), F.max("size").alias("size"))
    width = F.col("size") / F.col("rows")
    cells = cells.select(*keys, F.floor(F.col("cell") / width).cast("int").alias("row"), (F.col("cell") % width).cast("int").alias("column"), "sum")
    whole = cells.unionByName(cells.where("segment < other").select("universe", F.col("other").alias("segment"), F.col("segment").alias("other"), F.col("column").alias("row"), F.col("row").alias("column"), "sum"))
    name = lambda c, at, seg: placed.select("universe", F.col("symbol").alias(c), F.col("segment").alias(seg), F.col("place").alias(at), "n")
    cov = whole.join(name("a", "row", "segment"), ["universe", "segment", "row"]).join(name("b", "column", "other").drop("n"), ["universe", "other", "column"])
    return means.drop("n"), cov.select("universe", "a", "b", F.when(F.col("n") > 1, F.col("sum") / (F.col("n") - 1)).alias("cov"))


def rolling_moments(rets: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Means (universe, date, symbol, mean) and covariances (universe, date, a, b, cov) of the n dates that end at each date.

    Running sums of centred returns and of their products a date; a window's sums are differences of two of them, whatever n is.
    """
    overall = W.partitionBy("universe", "symbol")
    rows = rets.withColumn("centre", F.avg("ret").over(overall)).withColumn("x", F.col("ret") - F.col("centre"))

    def window(df: DataFrame, keys: tuple[str, ...], *columns: str) -> DataFrame:
        w = W.partitionBy("universe", *keys).orderBy("date")
        sums = {f"_{c}": F.sum(c).over(w.rowsBetween(W.unboundedPreceding, 0)) for c in columns}
        df = df.withColumns({"_rn": F.row_number().over(w), **sums})
        return df.withColumns({c: F.col(f"_{c}") - F.lag(f"_{c}", n, 0.0).over(w) for c in columns}).where(F.col("_rn") >= n).drop("_rn", *sums)

    means = window(rows, ("symbol",), "x").select("universe", "date", "symbol", (F.col("x") / n + F.col("centre")).alias("mean"))
    other = rows.select("universe", "date", F.col("symbol").alias("b"), F.col("x").alias("y"))
    both = rows.select("universe", "date", F.col("symbol").alias("a"), "x").join(other, ["universe", "date"]).withColumn("xy", F.col("x") * F.col("y"))
    sums = window(both, ("a", "b"), "x", "y", "xy")
    return means, sums.select("universe", "date", "a", "b", ((F.col("xy") - F.col("x") * F.col("y") / n) / (n - 1)).alias("cov"))


def _groups(means: DataFrame, cov: DataFrame, by: tuple[str, ...] = ("universe",)) -> DataFrame:
    """One row a pair of assets, with the mean of the first."""
    return cov.join(means.select(*by, F.col("symbol").alias("a"), "mean"), [*by, "a"])


def _matrices(rows: pd.DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    wide = rows.pivot(index="a", columns="b", values="cov").sort_index().sort_index(axis=1)
    mean = rows.drop_duplicates("a").set_index("a")["mean"].loc[wide.index]
    # Moments of too few dates are null: such assets count as constant.
    return list(wide.index), np.nan_to_num(mean.to_numpy(dtype=float)), np.nan_to_num(wide.to_numpy(dtype=float))


def _valid(w: np.ndarray) -> np.ndarray:
    """Not negative, summing to 1; equal weights if nothing is left."""
    w = np.maximum(w, 0)
    return w / w.sum() if w.sum() > 0 else np.full(len(w), 1 / len(w))


def min_variance_weights(cov: np.ndarray) -> np.ndarray:
    inv = np.linalg.pinv(cov).sum(axis=1)
    return _valid(inv / inv.sum() if inv.sum() else inv)


def target_weights(mean: np.ndarray, cov: np.ndarray, target: float) -> np.ndarray:
    """Least variance at an annual target return: the two-constraint closed form; equal weights if it is singular."""
    inv, one, mu = np.linalg.pinv(cov), np.ones(len(mean)), mean * YEAR
    a, b, c = one @ inv @ one, one @ inv @ mu, mu @ inv @ mu
    det = a * c - b * b
    if abs(det) < 1e-12:
        return np.full(len(mean), 1 / len(mean))
    return _valid(inv @ (one * (c - b * target) + mu * (a * target - b)) / det)


def tangency_weights(mean: np.ndarray, cov: np.ndarray, risk_free: float = 0.02) -> np.ndarray:
    raw = np.linalg.pinv(cov * YEAR) @ (mean * YEAR - risk_free)
    return _valid(raw / raw.sum() if raw.sum() else raw)


def max_sharpe_weights(mean: np.ndarray, cov: np.ndarray, risk_free: float = 0.02) -> np.ndarray:
    """The best Sharpe ratio of all weights that are not negative.

    With an asset above the risk-free rate it lies along the y >= 0 that minimises y'Cy / 2 - m'y, found coordinate by
    coordinate; otherwise (no ratio is positive) it is a single asset's, the ratio being quasiconvex there.
    """
    m, c = mean * YEAR - risk_free, cov * YEAR
    own = np.diag(c)
    y = np.zeros(len(m))
    if not (m > 0).any():
        y[np.argmax(np.where(own > 0, m / np.sqrt(np.where(own > 0, own, 1)), -np.inf))] = 1
        return y
    for _ in range(10_000):
        before = y.copy()
        for i in np.flatnonzero(own > 0):
            y[i] = max(0.0, y[i] + (m[i] - c[i] @ y) / own[i])
        if np.abs(y - before).max() <= 1e-13 * np.abs(y).max():
            break
    return _valid(y)


def _solve(means: DataFrame, cov: DataFrame, f, by: tuple[str, ...] = ("universe",)) -> DataFrame:
    """Weights of each universe, or with ``by`` of each universe and window end."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        symbols, mean, c = _matrices(rows)
        return pd.DataFrame({**{k: [rows[k].iloc[0]] * len(symbols) for k in by}, "symbol": symbols, "weight": f(mean, c)})

    types = dict(cov.dtypes)
    return _groups(means, cov, by).groupBy(*by).applyInPandas(one, ", ".join(f"{k} {types[k]}" for k in by) + ", symbol string, weight double")


def min_variance(means: DataFrame, cov: DataFrame, by: tuple[str, ...] = ("universe",)) -> DataFrame:
    return _solve(means, cov, lambda m, c: min_variance_weights(c), by)


def target_return(means: DataFrame, cov: DataFrame, target: float, by: tuple[str, ...] = ("universe",)) -> DataFrame:
    return _solve(means, cov, lambda m, c: target_weights(m, c, target), by)


def best_sharpe(means: DataFrame, cov: DataFrame, by: tuple[str, ...] = ("universe",)) -> DataFrame:
    return _solve(means, cov, max_sharpe_weights, by)


def frontier(means: DataFrame, cov: DataFrame, n: int = 10) -> DataFrame:
    """n points from the least-variance return to the best asset's: (universe, point, target, symbol, weight)."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        symbols, mean, c = _matrices(rows)
        low, high = float(min_variance_weights(c) @ mean) * YEAR, float(mean.max()) * YEAR
        out = [pd.DataFrame({"universe": rows["universe"].iloc[0], "point": i, "target": t, "symbol": symbols, "weight": target_weights(mean, c, t)}) for i, t in enumerate(np.linspace(low, high, n))]
        return pd.concat(out)

    return _groups(means, cov).groupBy("universe").applyInPandas(one, "universe int, point int, target double, symbol string, weight double")


def stats(weights: DataFrame, means: DataFrame, cov: DataFrame, keys: tuple[str, ...] = ("universe",), risk_free: float = 0.02, by: tuple[str, ...] = ("universe",)) -> DataFrame:
    """Annual return, variance, volatility and Sharpe ratio of weights (keys, symbol, weight) by moments of ``by``: joins and sums."""
    ret = weights.join(means, [*by, "symbol"]).groupBy(*keys).agg((F.sum(F.col("weight") * F.col("mean")) * YEAR).alias("annual_return"))
    a = weights.select(*keys, F.col("symbol").alias("a"), F.col("weight").alias("wa"))
    b = weights.select(*keys, F.col("symbol").alias("b"), F.col("weight").alias("wb"))
    var = a.join(cov, [*by, "a"]).join(b, [*keys, "b"]).groupBy(*keys).agg((F.sum(F.col("wa") * F.col("wb") * F.col("cov")) * YEAR).alias("variance"))
    out = ret.join(var, list(keys)).withColumn("volatility", F.sqrt("variance"))
    return out.withColumn("sharpe_ratio", F.when(F.col("volatility") != 0, (F.col("annual_return") - risk_free) / F.col("volatility")))


def max_sharpe(candidates: DataFrame, means: DataFrame, cov: DataFrame) -> DataFrame:
    """Of candidate weights (universe, candidate, symbol, weight) the one with the best Sharpe ratio per universe."""
    scored = stats(candidates, means, cov, ("universe", "candidate"))
    return scored.groupBy("universe").agg(F.max_by(F.struct("candidate", "annual_return", "volatility", "sharpe_ratio"), F.struct("sharpe_ratio", -F.col("candidate"))).alias("v")).select("universe", "v.*")


def best_weights(candidates: DataFrame, means: DataFrame, cov: DataFrame) -> DataFrame:
    """Winner by Sharpe ratio with its weights: of the candidates, the clipped tangency weights (-1) and the maximum (-2)."""
    columns = ("universe", "candidate", "symbol", "weight")
    solved = [_solve(means, cov, f).withColumn("candidate", F.lit(k)).select(*columns) for k, f in ((-1, tangency_weights), (-2, max_sharpe_weights))]
    every = candidates.select(*columns).unionByName(solved[0]).unionByName(solved[1])
    return every.join(max_sharpe(every, means, cov), ["universe", "candidate"])


def allocate(weights: DataFrame, capital: float, symbols: DataFrame) -> DataFrame:
    """Weight times capital of wanted symbols, 0 for unknown ones."""
    return symbols.join(weights, ["universe", "symbol"], "left").select("universe", "symbol", (F.coalesce("weight", F.lit(0.0)) * capital).alias("amount"))
