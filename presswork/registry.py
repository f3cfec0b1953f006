"""All registered queries of the engine and their oracle SQL, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import documents, drafts, feeds, further, judged, related, reports, search, states, texts, tracked

MODULES = (related, judged, further, texts, search, reports, drafts, feeds, tracked, states, documents)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
