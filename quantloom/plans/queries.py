"""Every registered query and its SQL."""

from __future__ import annotations

from . import factor_plans, indicator_plans, portfolio_plans, quality_plans, review_plans  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
