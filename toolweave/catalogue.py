"""Registry of the core's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from toolweave import training
from toolweave.plans import conversation_queries, evaluation_queries, fixture_queries, other_queries, source_queries, tool_queries

MODULES = [conversation_queries, tool_queries, evaluation_queries, other_queries, fixture_queries, source_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for m in MODULES for name, (run, _) in m.QUERIES.items()} | training.queries()


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql} | training.oracle_sql()
