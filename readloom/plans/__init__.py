"""Every registered query; each module of this folder adds its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from readloom.plans import cell_queries, count_queries, file_queries, mapping_queries, queries, registry, tool_queries

MODULES = (queries, count_queries, file_queries, tool_queries, cell_queries, mapping_queries)
flagship = queries.flagship


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
