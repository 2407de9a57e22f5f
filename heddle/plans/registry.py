"""Collects the named queries of every plan module."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "hybrid_rrf"

#: Each module has QUERIES (name -> function) and ORACLES (name -> DuckDB SQL).
MODULES: tuple[str, ...] = ("search_plans", "table_plans", "sql_plans", "chunk_plans", "registry_plans", "extra_plans", "service_plans", "index_plans", "stream_plans")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries over the library's own operators."""
    return {name: f for m in MODULES for name, f in import_module(f"heddle.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """The DuckDB SQL of those queries that have one."""
    return {name: sql for m in MODULES for name, sql in import_module(f"heddle.plans.{m}").ORACLES.items()}
