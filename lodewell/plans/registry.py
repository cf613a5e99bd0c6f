"""All queries of the core, by name."""

from __future__ import annotations

import functools
import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodewell.session import ship

#: Modules with QUERIES (name to function of session and directory) and SQL (name to DuckDB text).
MODULES = ["lodewell.plans.changes", "lodewell.plans.retrieval", "lodewell.plans.structure", "lodewell.plans.upkeep"]


def _with_package(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship(spark)
        return query(spark, folder)

    return run


def load(modules: list[str]) -> tuple[dict, dict]:
    queries, sql = {}, {}
    for name in modules:
        m = importlib.import_module(name)
        queries |= {k: _with_package(q) for k, q in m.QUERIES.items()}
        sql |= m.SQL
    return queries, sql
