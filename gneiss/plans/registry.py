"""Queries of the core by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gneiss.plans import audit_queries, change_queries, detector_queries, file_queries, finding_queries, graph_queries, verification_queries

_MODULES = (graph_queries, finding_queries, file_queries, change_queries, verification_queries, audit_queries, detector_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL: dict[str, str] = {name: text for m in _MODULES for name, text in m.SQL.items()}
