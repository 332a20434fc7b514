"""Macro dimension scores, regime and equity multiplier."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import average_available, center, clip, clip_score

INPUTS = ("pmi", "cpi_yoy", "ppi_yoy", "m2_yoy", "social_financing_yoy", "ten_year_yield", "policy_score", "external_risk_score")
DIMENSIONS = ("growth_score", "inflation_score", "liquidity_score", "credit_score", "policy", "external_risk")
#: Base multiplier of each regime (fixed values).
BASE = {"recession": 0.6, "slowdown": 0.8, "uncertain": 0.9, "stagflation": 0.75, "recovery": 1.0, "expansion": 1.1}
#: Missing inputs from which nothing is said, and regimes in order: bounds of scores (from, below) that all hold, and others of which one does (fixed values).
MISSING = 5
REGIMES = (
    ("recession", {"growth": (None, 35), "credit": (None, 45)}, {}),
    ("stagflation", {"growth": (None, 45), "inflation": (None, 40)}, {}),
    ("slowdown", {"growth": (None, 50)}, {"liquidity": (None, 50), "credit": (None, 50)}),
    ("recovery", {"growth": (45, 60)}, {"liquidity": (55, None), "credit": (55, None)}),
    ("expansion", {"growth": (60, None), "inflation": (45, None), "liquidity": (45, None)}, {}),
)


def scores(df: DataFrame) -> DataFrame:
    """Six scores of 0-100, 50 where the inputs are missing, and the number of missing inputs."""
    c = F.col
    missing = sum((c(x).isNull().cast("int") for x in INPUTS), F.lit(0))
    return df.withColumns(
        {
            "growth_score": clip_score((c("pmi") - 45) * 10, 50.0),
            "inflation_score": average_available(center(c("cpi_yoy"), 2.2, 4.5), center(c("ppi_yoy"), 1.5, 7.0)),
            "liquidity_score": average_available(clip((c("m2_yoy") - 5) / 8 * 100), clip((4.5 - c("ten_year_yield")) / 2.5 * 100)),
            "credit_score": clip_score((c("social_financing_yoy") - 5) * 10, 50.0),
            "policy": clip_score(c("policy_score"), 50.0),
            "external_risk": clip_score(c("external_risk_score"), 50.0),
            "missing_inputs": missing,
        }
    )


def regime(scored: DataFrame) -> DataFrame:
    """The first regime whose bounds the scores keep; ``uncertain`` if none does or too many inputs are missing."""

    def within(bounds: dict[str, tuple[float | None, float | None]]) -> list[Column]:
        out = []
        for name, (low, high) in bounds.items():
            x = F.col(f"{name}_score")
            out.append((x >= low if low is not None else F.lit(True)) & (x < high if high is not None else F.lit(True)))
        return out

    value = F.when(F.col("missing_inputs") >= MISSING, "uncertain")
    for name, every, some in REGIMES:
        holds = reduce(and_, within(every))
        value = value.when(holds & reduce(or_, within(some)) if some else holds, name)
    return scored.withColumn("regime", value.otherwise("uncertain"))


def multiplier(df: DataFrame) -> DataFrame:
    base = F.lit(0.9)
    for name, x in BASE.items():
        base = F.when(F.col("regime") == name, x).otherwise(base)
    x = base - F.when(F.col("external_risk") < 35, 0.1).otherwise(0.0) + F.when(F.col("policy") > 75, 0.05).otherwise(0.0)
    strong = F.col("regime") == "expansion"
    for d in DIMENSIONS:
        strong &= F.col(d) >= 80
    x = F.when(strong, F.greatest(x, F.lit(1.2))).otherwise(x)
    return df.withColumn("multiplier", F.greatest(F.lit(0.6), F.least(F.lit(1.2), x)))


def at_signals(asof: DataFrame) -> DataFrame:
    """Scores, regime and multiplier of as-of rows; 1.0 where nothing was public."""
    df = multiplier(regime(scores(asof)))
    return df.withColumn("multiplier", F.when(F.col("macro_date").isNull(), 1.0).otherwise(F.col("multiplier")))
