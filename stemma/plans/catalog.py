"""Loads every module of queries."""

from stemma.plans import aggregates, composites, extraction, filters, joins, ordered, streams, texts  # noqa: F401
from stemma.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
