"""All queries of the analytics engine by name, and the SQL that answers each on DuckDB."""

from __future__ import annotations

from effectlens.plans import cleaning, importance, modelling, scoring  # noqa: F401  importing registers
from effectlens.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
