"""Every query of the contest engine with its DuckDB equivalent."""

from __future__ import annotations

from bracketry.plans import queries, queries_model, queries_time

__all__ = ["ORACLES", "QUERIES", "queries_model", "queries_time"]

QUERIES = queries.QUERIES
ORACLES = queries.ORACLES
