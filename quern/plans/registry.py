"""All queries of the core, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.plans import corpus_queries, search_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**search_queries.queries(), **corpus_queries.queries()}


def oracle_sql() -> dict[str, str]:
    return {**search_queries.oracle_sql(), **corpus_queries.oracle_sql()}
