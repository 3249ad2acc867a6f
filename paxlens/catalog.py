"""Registered queries: every operator on the warehouse tables, with its DuckDB equivalent where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import code_queries, fixture_queries, graph_queries, mining_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = graph_queries.QUERIES | code_queries.QUERIES | mining_queries.QUERIES | fixture_queries.QUERIES
ORACLE_SQL: dict[str, str] = graph_queries.ORACLE_SQL | code_queries.ORACLE_SQL | mining_queries.ORACLE_SQL | fixture_queries.ORACLE_SQL
