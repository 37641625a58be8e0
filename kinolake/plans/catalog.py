"""Queries of the core, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinolake.plans import content_queries, eval_queries, graph_queries, record_queries, store_queries

MODULES = (record_queries, content_queries, graph_queries, eval_queries, store_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for module in MODULES for f in module.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
