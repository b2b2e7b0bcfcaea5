"""Audit of a whole library: issues, profiles and their reports in a few shuffles by symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame

from barloom.operators.profile import profile, with_health
from barloom.operators.validate import audit


def audit_library(bars: DataFrame, grid: DataFrame, length: int, symbols: DataFrame | None = None, sizes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(profiles with health, issues)."""
    found = audit(bars, grid, length)
    return with_health(profile(bars, symbols, sizes, found)), found
