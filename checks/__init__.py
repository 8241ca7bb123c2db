"""Registered queries and their DuckDB twins, one per inventory row."""

from . import aggregates, functions, geography, joins, layouts, metrics, published, reports, rows, sources, windows  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
