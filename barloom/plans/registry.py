"""All registered queries over the given tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bar_queries, context_queries, decision_queries, event_queries, inference_queries, label_queries, model_queries, more_queries, preparation_queries, score_queries, smart_money_queries, structure_queries, suite_queries, walked_sql
from .event_queries import flagship

__all__ = ["flagship", "oracle_sql", "queries"]

MODULES = (bar_queries, event_queries, structure_queries, model_queries, more_queries, score_queries, decision_queries, suite_queries, context_queries, preparation_queries, walked_sql, smart_money_queries, inference_queries, label_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
