"""All named queries of the engine and, where SQL can express them, their oracle SQL."""

from __future__ import annotations

from .plans import aggregates, changes, dates, documents, functions, joins, learning, matching, prediction, relational, streams, structures, values, windows  # noqa: F401
from .plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
