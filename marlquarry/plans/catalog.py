"""Registered queries over the driver tables and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlquarry.plans import decision_queries, doc_queries, rank_queries

_MODULES = (rank_queries, doc_queries, decision_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: q for m in _MODULES for k, q in m.ORACLES.items()}
